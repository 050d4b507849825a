"""From chunks to entities, relations and events: rules, normal forms, identifiers, guards, duplicates."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.functions.text import simhash64
from lodeseek.operators.pairs import close_hashes
from lodeseek.plans.staging import stage

MOST_EVENTS, MOST_ANCHORS, FUZZY, HAMMING = 5, 2, 0.8, 5
# Time formats of events and the resolution each one has.
TIME_FORMATS = (
    ("yyyy-MM-dd'T'HH:mm:ss", "second"),
    ("yyyy-MM-dd HH:mm:ss", "second"),
    ("yyyy-MM-dd'T'HH:mm", "minute"),
    ("yyyy-MM-dd HH:mm", "minute"),
    ("yyyy/MM/dd HH:mm", "minute"),
    ("yyyy年MM月dd日 HH:mm", "minute"),
    ("yyyy-MM-dd", "day"),
    ("yyyy/MM/dd", "day"),
    ("yyyy年MM月dd日", "day"),
)


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def normal_name(name: Column, case_sensitive: bool = False) -> Column:
    """NFKC, no punctuation at the end, single spaces, lower case. ASCII names, the most, need no Python."""
    plain = F.when(F.coalesce(name, F.lit("")).rlike(r"^[\x00-\x7f]*$"), F.coalesce(name, F.lit(""))).otherwise(_nfkc(name))
    out = F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"(?U)^\s+|\s+$", ""), r"[。.，,；;！!？?：:]+$", ""), r"(?U)\s+", " "))
    return out if case_sensitive else F.lower(out)


def entity_id(kb: Column, name: Column, label: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kb, name, label), 256), 1, 32)


def triple_id(kb: Column, source: Column, label: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", kb, source, label, target), 256), 1, 32)


def event_time(text: Column) -> Column:
    """Struct (ts, resolution) by the first format that fits, or null."""
    out = None
    for form, resolution in TIME_FORMATS:
        ts = F.try_to_timestamp(F.btrim(text), F.lit(form))
        value = F.struct(ts.cast("timestamp_ntz").alias("ts"), F.lit(resolution).alias("resolution"))
        out = F.when(ts.isNotNull(), value) if out is None else out.when(ts.isNotNull(), value)
    return out


def rule_events(chunks: DataFrame) -> DataFrame:
    """Events by rule from chunks (chunk_id, content): sentences with a date, an amount or an identifier; five a chunk at most.

    Columns: event_id, chunk_id, summary, time_expr, amount, exact_identifiers, span_start.
    """
    sentences = F.split("content", r"(?<=[。！？!?])|(?<=\.)(?=\s)|\n")
    date = r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?(?:[ T]\d{1,2}:\d{2}(?::\d{2})?)?"
    amount = r"[¥$€£]\s?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?\s?(?:万元|元|USD|EUR|CNY)"
    mark = r"[A-Z]{2,}-?\d{3,}|(?<!\d)\d{11,19}(?!\d)|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
    told = chunks.select("chunk_id", "content", F.posexplode(sentences).alias("seq", "s")).withColumn("s", F.btrim("s"))
    told = told.filter(F.col("s").rlike(f"{date}|{amount}|{mark}"))
    told = told.select(
        "chunk_id", "content", "seq", F.col("s").alias("summary"), F.regexp_extract("s", date, 0).alias("time_expr"), F.regexp_extract("s", amount, 0).alias("amount"),
        F.array_distinct(F.regexp_extract_all("s", F.lit(mark), F.lit(0))).alias("exact_identifiers"), (F.call_function("locate", F.col("s"), F.col("content")) - 1).alias("span_start"),
    )
    return capped_events(told.drop("content"))


def capped_events(events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """Events (chunk_id, seq, summary, ...) of each chunk without repeated summaries, the first ``most``, with their ids."""
    squashed = F.lower(F.regexp_replace("summary", r"(?U)\s+", ""))
    events = events.filter(squashed != "").withColumn("_k", squashed)
    first = events.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id", "_k").orderBy("seq"))).filter("_n = 1")
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("chunk_id").orderBy("seq"))).filter(F.col("_n") <= most)
    return ranked.withColumn("event_id", F.concat(F.lit("ev:"), F.col("chunk_id").cast("string"), F.lit("#"), F.col("_n") - 1)).drop("_n", "_k")


def verification(identifiers: Column, time_expr: Column, content: Column) -> Column:
    """``verified`` if all identifiers and the time expression stand in the chunk, white space aside."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    text = bare(content)
    anchored = F.forall(F.coalesce(identifiers, F.array().cast("array<string>")), lambda i: F.contains(text, bare(i)))
    timed = (F.coalesce(time_expr, F.lit("")) == "") | F.contains(text, bare(time_expr))
    return F.when(anchored & timed, "verified").otherwise("unverified")


def value_weight(value: Column, verified: Column, weights: Mapping[str, float]) -> Column:
    """Weight of a value class, halved if the event is unverified."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), F.lit(0.0)) * F.when(verified == "unverified", 0.5).otherwise(1.0)


@F.pandas_udf(T.BooleanType())
def fuzzy_contains(names: pd.Series, texts: pd.Series) -> pd.Series:
    """Whether a name, or a window of its length that is much like it, stands in a text; white space aside."""

    def one(name: str | None, text: str | None) -> bool:
        name, text = "".join((name or "").split()), "".join((text or "").split())
        if not name or not text:
            return False
        if name in text:
            return True
        match = SequenceMatcher(None, autojunk=False)
        match.set_seq1(name)
        for i in range(len(text) - len(name) + 1):
            match.set_seq2(text[i : i + len(name)])
            if match.real_quick_ratio() >= FUZZY and match.quick_ratio() >= FUZZY and match.ratio() >= FUZZY:
                return True
        return False

    return pd.Series([one(a, b) for a, b in zip(names, texts)])


def near_events(events: DataFrame, most: int = HAMMING) -> DataFrame:
    """Pairs (event_id, earlier_id, distance) of events (event_id, summary) whose SimHash differs in at most ``most`` bits.

    Equal hashes are joined through their first event only. Other pairs are found by comparing blocks of hashes, so a task's
    memory doesn't grow, but their number, and the result, grow with the square of the hashes.
    """
    told = stage(events.select("event_id", simhash64(F.col("summary")).alias("h")), "simhashes")
    first = told.groupBy("h").agg(F.min("event_id").alias("id"))
    same = told.join(first, "h").filter("event_id != id").select("event_id", F.col("id").alias("earlier_id"), F.lit(0).alias("distance"))
    near = close_hashes(stage(first.select("id", "h"), "simhashes-first"), most)
    return same.unionByName(near.select(F.greatest("a", "b").alias("event_id"), F.least("a", "b").alias("earlier_id"), "distance").filter("event_id != earlier_id"))

def gleaned(entities: DataFrame) -> DataFrame:
    """Entities of several rounds (name, label, description, attributes): one each, the longest description, all attributes."""
    longest = F.struct(F.length("description"), F.col("description"))
    return entities.groupBy("name", "label").agg(F.max_by("description", longest).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("attributes")))).alias("attributes"))


def resolved_anchors(anchors: DataFrame, known: DataFrame, ranks: Mapping[str, int], kb: str) -> DataFrame:
    """One label for each name of anchors (name, label, seq): the stored one (name, label) if there is one, else the best by rank, then the first."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair]), F.col("label")), F.lit(9))
    every = anchors.select("name", "label", F.lit(1).alias("age"), rank.alias("rank"), "seq").unionByName(known.select("name", "label", F.lit(0).alias("age"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("seq")))
    best = every.groupBy("name").agg(F.min_by("label", F.struct("age", "rank", "seq", "label")).alias("canonical"), F.array_sort(F.collect_set("label")).alias("labels"))
    return best.select("name", F.col("canonical").alias("label"), F.array_remove("labels", F.col("canonical")).alias("conflicts"), entity_id(F.lit(kb), F.col("name"), F.col("canonical")).alias("entity_id"))


def renamed(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities (name, ...) under the canonical names of their aliases (alias, canonical)."""
    return entities.join(aliases, F.col("name") == F.col("alias"), "left").withColumn("name", F.coalesce("canonical", "name")).drop("alias", "canonical")


def fallback_anchors(identifiers: Column, location: Column, most: int = MOST_ANCHORS) -> Column:
    """Anchors of an event without participants: identifiers, then a short place."""
    place = F.when(F.length(F.btrim(location)).between(1, 30), F.array(F.btrim(location))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.coalesce(identifiers, F.array().cast("array<string>")), place)), 1, most)


def description_parts(text: Column) -> Column:
    """Fragments of a merged description."""
    return F.when(F.contains(text, F.lit("<SEP>")), F.split(text, "<SEP>")).otherwise(F.split(text, "; "))


def needs_merge(text: Column, tokens: Column, fragments: int = 8, budget: int = 1200) -> Column:
    return (F.size(description_parts(text)) >= fragments) | (tokens >= budget)
