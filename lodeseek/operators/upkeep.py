"""Upkeep of knowledge bases and their runs: filters, settings, resets, listings, result shapes, prompts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import token_count

#: What a step that did not end leaves behind, and where a restart goes on from.
STUCK = {"parsing": "uploaded", "indexing": "parsed"}
CUT_MARK = "\n[内容因长度限制已截断]"


def documents_of(files: DataFrame, kb_id: str, status: str | None = None, name: str | None = None) -> DataFrame:
    """Files of a base that are no folders, by status and by part of the name."""
    out = files.filter((F.col("kb_id") == kb_id) & ~F.coalesce("is_folder", F.lit(False)))
    if status:
        out = out.filter(F.col("status") == status)
    return out.filter(F.contains(F.lower("filename"), F.lit(name.lower()))) if name else out


def pending(chunks: DataFrame, exclude: DataFrame | None = None, most: int = 1000) -> DataFrame:
    """The next chunks that the graph lacks, by id."""
    out = chunks.filter(~F.coalesce("graph_indexed", F.lit(False)))
    if exclude is not None:
        out = out.join(exclude.select("chunk_id"), "chunk_id", "left_anti")
    return out.orderBy("chunk_id").limit(min(most, 1000))


def entities_like(entities: DataFrame, keyword: str, top: int) -> DataFrame:
    """The first entities whose name or normal name holds the keyword."""
    return entities.filter(F.contains(F.lower(F.concat_ws("\0", "name", "normalized_name")), F.lit(keyword.lower()))).orderBy("entity_id").limit(top)


def known(asked: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """``asked`` with ``exists``: whether files have its key (content hash, name)."""
    told = files.select(key).distinct().withColumn("_there", F.lit(True))
    return asked.join(told, key, "left").withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def merged_settings(*levels: Column) -> Column:
    """Maps of settings, the later ones first in force; a null value gives none."""
    out = levels[0]
    for own in levels[1:]:
        out = F.map_zip_with(F.coalesce(out, F.create_map().cast("map<string,string>")), F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, low, high: F.coalesce(high, low))
    return out


def restarted(files: DataFrame) -> DataFrame:
    """Files that a stopped run left behind, set back to where work goes on."""
    status = F.col("status")
    for stuck, before in STUCK.items():
        status = F.when(F.col("status") == stuck, before).otherwise(status)
    return files.withColumn("status", status)


def reset_graph(chunks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Chunks as if the graph had never been built, of the files (file_id) only if given."""
    hit = F.lit(True)
    if files is not None:
        chunks = chunks.join(files.select("file_id").distinct().withColumn("_hit", F.lit(True)), "file_id", "left")
        hit = F.col("_hit").isNotNull()
    empty = {"graph_indexed": F.lit(False), "ent_ids": F.lit(None), "extraction_result": F.lit(None)}
    return chunks.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in empty.items() if c in chunks.columns}).drop("_hit")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunk_count"), F.coalesce(F.sum(token_count(F.col("content"))), F.lit(0)).alias("token_count"))


def deleted(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the files gone (file_id); a table without file_id goes by chunk_id through ``chunks``."""
    chunks = tables["chunks"].join(gone.select("file_id"), "file_id", "left_semi").select("chunk_id")
    out = {}
    for name, df in tables.items():
        key, rows = ("file_id", gone) if "file_id" in df.columns else ("chunk_id", chunks)
        out[name] = df.join(rows.select(key).distinct(), key, "left_anti").select(*df.columns)
    return out


def written_back(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Chunks with extraction results (chunk_id, extraction_result, ent_ids) set and marked as indexed."""
    told = results.select("chunk_id", F.col("extraction_result").alias("_r"), F.col("ent_ids").alias("_e"), F.lit(True).alias("_i"))
    out = chunks.join(told, "chunk_id", "left")
    values = {"extraction_result": F.coalesce("_r", "extraction_result"), "ent_ids": F.coalesce("_e", "ent_ids"), "graph_indexed": F.coalesce("_i", "graph_indexed")}
    return out.withColumns(values).select(*chunks.columns)


def with_sources(chunks: DataFrame, files: DataFrame, default: str = "未知来源") -> DataFrame:
    """Chunks with ``source``, the name of their file."""
    return chunks.join(files.select("file_id", F.col("filename").alias("source")), "file_id", "left").withColumn("source", F.coalesce("source", F.lit(default)))


def unit_scores(scores: DataFrame) -> DataFrame:
    """Rerank scores (query_id, score) of queries that go beyond 1, brought to 0 to 1; -1 marks a failure and stays."""
    own = Window.partitionBy("query_id")
    good = F.when(F.col("score") >= 0, F.col("score"))
    low, high = F.min(good).over(own), F.max(good).over(own)
    return scores.withColumn("score", F.when((F.col("score") >= 0) & (high > 1) & (high > low), (F.col("score") - low) / (high - low)).otherwise(F.col("score")))


def search_output(results: DataFrame) -> DataFrame:
    """Results as (content, score, metadata), paths left out."""
    lifted = [c for c in results.columns if c not in ("content", "path", "markdown_path", "original_path")]
    return results.select("content", "score", F.struct(*lifted).alias("metadata"))


def within_budget(items: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """The first items (text, pos) of each key whose tokens fit; if the first does not, it is cut to four characters a token."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    told = items.withColumn("_sum", F.sum(token_count(F.col("text"))).over(order)).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    fits = (F.col("_sum") <= budget) & (budget > 0)
    out = told.filter(fits | ((F.col("_n") == 1) & F.lit(budget > 0)))
    return out.withColumn("text", F.when(fits, F.col("text")).otherwise(F.substring("text", 1, max(1, 4 * budget)))).drop("_sum", "_n")


def answer_context(found: DataFrame, most: int = 8, budget: int = 12_000) -> DataFrame:
    """(query_id, context): the first ``most`` chunks (rank, content, source) under a budget of tokens; the one that crosses it is cut in proportion and marked."""
    own = found.filter((F.col("rank") <= most) & (F.coalesce("content", F.lit("")) != ""))
    n = token_count(F.col("content"))
    before = F.coalesce(F.sum(n).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) == 1
    told = own.select("query_id", "rank", "content", "source", n.alias("n"), before.alias("before"), first.alias("first"))
    room = F.floor(F.length("content") * (budget - F.col("before")) / F.greatest("n", F.lit(1))).cast("int")
    told = told.filter(F.col("first") | (F.col("before") + F.col("n") <= budget) | ((F.col("before") < budget) & (room > 0)))
    text = F.when(F.col("first") | (F.col("before") + F.col("n") <= budget), F.col("content")).otherwise(F.concat(F.substr("content", F.lit(1), room), F.lit(CUT_MARK)))
    said = F.concat(F.lit("【文档 "), F.col("rank").cast("string"), F.lit(" | 来源："), F.coalesce("source", F.lit("未知来源")), F.lit("】\n"), text)
    return told.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", said.alias("x")))), lambda r: r["x"]), "\n\n").alias("context"))


def run_page(items: DataFrame, run_id, offset: int, limit: int, errors_only: bool = False) -> DataFrame:
    """A page of a run's items by index, each with the run's total; an error is a text that is not blank."""
    own = items.filter(F.col("run_id") == run_id).withColumn("is_error", F.btrim(F.coalesce("error", F.lit(""))) != "")
    if errors_only:
        own = own.filter("is_error")
    total = own.agg(F.count("*").alias("total"))
    return own.join(F.broadcast(total), F.lit(True)).orderBy("item_index").offset(offset).limit(limit)


def run_status(items: DataFrame) -> DataFrame:
    """(run_id, total, failed, status): a run fails only if all of its items do."""
    bad = F.btrim(F.coalesce("error", F.lit(""))) != ""
    out = items.groupBy("run_id").agg(F.count("*").alias("total"), F.count_if(bad).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == F.col("total"), "failed").otherwise("completed"))


def neighbours_as_context(vectors: DataFrame, anchors: DataFrame, top_k: int) -> DataFrame:
    """For question making: the nearest vectors (id, vector) of each anchor (id), itself left out: (query_id, id, score, rank)."""
    from lodeseek.operators.retrieval import dense_top_k, ranked

    asked = vectors.join(anchors.select("id"), "id", "left_semi").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = dense_top_k(vectors, asked, top_k + 1, -1.0).filter("id != query_id").drop("rank")
    return ranked(found, [F.col("score").desc(), F.col("id").asc()], top_k)


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the values of the last row of ``right`` at its time or before, by the keys; null where there is none.

    One exchange: both sides stand in one sorted window, and the last value is carried on. No row is paired with another."""
    mark = [c for c in left.columns if c not in (*keys, time)]
    a = left.select(*keys, time, F.lit(1).alias("_side"), F.struct(*mark).alias("_left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, time, F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*mark)).schema[0].dataType).alias("_left"), F.struct(*values).alias("_right"))
    order = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    told = a.unionByName(b).withColumn("_last", F.last("_right", True).over(order)).filter("_side = 1")
    return told.select(*keys, time, "_left.*", *[F.col(f"_last.{v}").alias(v) for v in values])
