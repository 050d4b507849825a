"""Relational upkeep of the row stores: filters, paging, upserts, counters, cascades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "<SEP>"


def only_columns(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in allowed if c in df.columns])


def file_filter(rows: DataFrame, files: DataFrame, ids: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
    """Rows (file_id) of the named files (file_id, filename): by ids if given, else by part of the name, else all."""
    if ids is not None:
        return rows.filter(F.col("file_id").isin(list(ids)))
    if name:
        return rows.join(files.filter(F.contains(F.lower("filename"), F.lit(name.lower()))).select("file_id"), "file_id", "left_semi")
    return rows


def without(rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return rows.join(kept.select(key), key, "left_anti")


def page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, limit: int = 100, most: int = 1000) -> DataFrame:
    return df.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def after_key(df: DataFrame, key: str, last) -> DataFrame:
    return df.filter(F.col(key) > last).orderBy(key)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of ``old`` with its keys."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def merged_description(old: Column, new: Column, separator: str = SEPARATOR) -> Column:
    """New text appended unless it is empty or already there."""
    o, n = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    return F.when(n == "", o).when(o == "", n).when(F.contains(o, n), o).otherwise(F.concat(o, F.lit(separator), n))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities (entity_id, name, normalized_name, label, description, attributes): label stays, names follow the newer, descriptions and attributes merge."""
    n = new.select("entity_id", *[F.col(c).alias(f"n_{c}") for c in ("name", "normalized_name", "label", "description", "attributes")])
    both = old.join(n, "entity_id", "full_outer")
    return both.select(
        "entity_id",
        F.coalesce("n_name", "name").alias("name"),
        F.coalesce("n_normalized_name", "normalized_name").alias("normalized_name"),
        F.coalesce("label", "n_label").alias("label"),
        merged_description(F.col("description"), F.col("n_description")).alias("description"),
        F.array_distinct(F.concat(F.coalesce("attributes", F.array()), F.coalesce("n_attributes", F.array()))).alias("attributes"),
    )


def update_if_status(df: DataFrame, key: str, value, allowed: Sequence[str], **fields) -> DataFrame:
    """Set fields of one row only while its status is allowed."""
    hit = (F.col(key) == value) & F.col("status").isin(list(allowed))
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in fields.items()})


def status_counts(files: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return files.agg(F.count("*").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses])


def coverage(chunks: DataFrame) -> DataFrame:
    """Share of chunks that are in the graph; 1 without chunks."""
    return chunks.agg(F.coalesce(F.avg(F.col("graph_indexed").cast("double")), F.lit(1.0)).alias("coverage"))


def orphans(entities: DataFrame, *references: DataFrame) -> DataFrame:
    """Entities that no reference (entity_id) names."""
    for ref in references:
        entities = entities.join(ref.select("entity_id"), "entity_id", "left_anti")
    return entities


def drop_file_from_relations(relations: DataFrame, file_id: str) -> DataFrame:
    """Relations (..., file_ids) without the file; those of no other file go."""
    return relations.withColumn("file_ids", F.array_remove("file_ids", file_id)).filter(F.size("file_ids") > 0)


def merged_relations(relations: DataFrame) -> DataFrame:
    """One relation for each (src, dst, type): all files, descriptions in order, without repeats."""
    said = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "description"))), lambda x: x["description"]))
    return relations.groupBy("src", "dst", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("file_ids")))).alias("file_ids"), F.array_join(F.filter(said, lambda x: x != ""), SEPARATOR).alias("description"))


def line_window(docs: DataFrame, offset: int, limit: int) -> DataFrame:
    """Numbered lines [offset, offset + limit) of texts (id, content)."""
    lines = docs.select("id", F.posexplode(F.split("content", "\n")).alias("n", "line"))
    return lines.filter(F.col("n").between(offset, offset + limit - 1)).select("id", (F.col("n") + 1).alias("line_number"), "line")


def find_windows(docs: DataFrame, pattern: str, around: int, most: int, regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Context windows about matching lines, none overlapping the one before: (id, first_line, last_line, text, total_matches)."""
    lines = F.split("content", "\n")
    own = (lambda x: x) if case_sensitive else F.lower
    hit = (lambda x: x.rlike(pattern if case_sensitive else f"(?i){pattern}")) if regex else (lambda x: F.contains(own(x), F.lit(pattern if case_sensitive else pattern.lower())))
    df = docs.select("id", lines.alias("l"))
    df = df.select("id", "l", F.filter(F.sequence(F.lit(1), F.size("l")), lambda i: hit(F.element_at("l", i))).alias("at"))
    start = F.array().cast("array<struct<a:int,b:int>>")
    grow = lambda acc, i: F.when((F.size(acc) > 0) & (F.element_at(F.concat(acc, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))), -2)["b"] >= i - around), acc).otherwise(F.concat(acc, F.array(F.struct(F.greatest(i - around, F.lit(1)).alias("a"), F.least(i + around, F.size("l")).alias("b")))))
    first = lambda acc, i: F.when(F.size(acc) == 0, F.array(F.struct(F.greatest(i - around, F.lit(1)).alias("a"), F.least(i + around, F.size("l")).alias("b")))).otherwise(grow(acc, i))
    df = df.select("id", "l", F.size("at").alias("total_matches"), F.slice(F.aggregate("at", start, first), 1, most).alias("w"))
    return df.select("id", "l", "total_matches", F.inline("w")).select("id", F.col("a").alias("first_line"), F.col("b").alias("last_line"), F.array_join(F.slice("l", F.col("a"), F.col("b") - F.col("a") + 1), "\n").alias("text"), "total_matches")


def sessions(rows: DataFrame, key: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """Add ``session``: a new one after a gap or where time goes back."""
    order = Window.partitionBy(key).orderBy("seq")
    seconds = F.col(ts).cast("timestamp").cast("double")
    step = seconds - F.lag(seconds).over(order)
    starts = F.when((step > gap_minutes * 60) | (step < 0), 1).otherwise(0)
    return rows.withColumn("_starts", starts).withColumn("session", F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")
