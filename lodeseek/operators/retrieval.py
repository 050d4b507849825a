"""Ranked channels and how they are fused. Channels are DataFrames; a batch of queries is one job."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import occurrences, token_count
from lodeseek.operators.pairs import best_pairs

K1, B = 1.5, 0.75
OMITTED = "[content omitted: token budget]"
#: Queries (rows) up to which a batch is broadcast to the scan of the corpus.
BATCH = 10_000


def candidates(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows of ``chunks`` (id, content, pos) that contain any term of a query (query_id, terms), literally and ignoring case."""
    small = queries.limit(BATCH + 1).count() <= BATCH
    if not small:
        raise ValueError(f"more than {BATCH} queries in one batch")
    asked = queries.select("query_id", F.transform("terms", F.lower).alias("terms"))
    lowered = chunks.select("id", "pos", F.lower("content").alias("c"))
    return lowered.join(F.broadcast(asked), F.exists("terms", lambda t: F.contains(F.col("c"), t)))


def bm25(chunks: DataFrame, queries: DataFrame, top_k: int | None = None) -> DataFrame:
    """Okapi BM25 over each query's candidates: query_id, id, score (by the peak), raw, match_count, rank."""
    found = candidates(chunks, queries)
    counts = F.transform("terms", lambda t: occurrences(F.col("c"), t))
    found = found.select("query_id", "id", "pos", F.length("c").alias("len"), counts.alias("tf"))
    stats = found.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    dfs = found.select("query_id", F.posexplode("tf")).filter("col > 0").groupBy("query_id", "pos").agg(F.count("*").alias("df"))
    dfs = dfs.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "df"))).alias("df"))
    told = found.join(F.broadcast(stats.join(dfs, "query_id")), "query_id")
    weight = lambda tf, i: F.when(
        tf > 0,
        F.log((F.col("n") - F.try_element_at("df", i) + 0.5) / (F.try_element_at("df", i) + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))),
    ).otherwise(0.0)
    told = told.withColumn("raw", F.aggregate(F.transform("tf", weight), F.lit(0.0), lambda a, x: a + x)).filter("raw > 0")
    peak = told.groupBy("query_id").agg(F.max("raw").alias("peak"))
    scored = told.join(F.broadcast(peak), "query_id").select("query_id", "id", "pos", "raw", (F.col("raw") / F.col("peak")).alias("score"), F.size(F.filter("tf", lambda x: x > 0)).alias("match_count"))
    return ranked(scored, [F.col("raw").desc(), F.col("pos").asc(), F.col("id").asc()], top_k)


def ranked(df: DataFrame, order: Sequence, top_k: int | None = None, by: str = "query_id") -> DataFrame:
    """Add ``rank`` within a query; a rank filter becomes a partial top-k before the shuffle."""
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return df.filter(F.col("rank") <= top_k) if top_k else df


def dense_top_k(vectors: DataFrame, queries: DataFrame, top_k: int, threshold: float = 0.0) -> DataFrame:
    """Unit vectors (id, vector) by dot product with each query (query_id, query): query_id, id, score, rank."""
    return ranked(best_pairs(vectors, queries, top_k, threshold), [F.col("score").desc(), F.col("id").asc()], top_k)


def fuse(base: DataFrame, other: DataFrame, weight: float = 1.0, k: int = 60) -> DataFrame:
    """Weighted reciprocal-rank fusion of two rankings (query_id, id, rank): query_id, id, score, sources, rank."""
    both = base.select("query_id", "id", "rank", F.lit(1.0).alias("w"), F.lit(0).alias("channel")).unionByName(other.select("query_id", "id", "rank", F.lit(float(weight)).alias("w"), F.lit(1).alias("channel")))
    fused = both.groupBy("query_id", "id").agg(F.sum(F.col("w") / (k + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("sources"), F.min(F.struct("channel", "rank")).alias("first"))
    return ranked(fused, [F.col("score").desc(), F.col("first").asc(), F.col("id").asc()]).drop("first")


def round_robin(*lists: DataFrame) -> DataFrame:
    """Interleave seed lists (id, weight, pos): a repeated id keeps its first place and its largest weight."""
    every = None
    for i, own in enumerate(lists):
        own = own.select("id", "weight", F.struct(F.col("pos"), F.lit(i).alias("list")).alias("place"))
        every = own if every is None else every.unionByName(own)
    merged = every.groupBy("id").agg(F.max("weight").alias("weight"), F.min("place").alias("place"))
    return merged.select("id", "weight", F.row_number().over(Window.orderBy("place")).alias("pos"))


def normalised_seeds(seeds: DataFrame, least: float = 0.01) -> DataFrame:
    """Shares of the total; those below ``least`` go."""
    total = seeds.agg(F.sum("weight").alias("total"))
    return seeds.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.col("weight") / F.col("total")).filter(F.col("weight") >= least).drop("total")


def rerank_order(df: DataFrame, floor: float = 0.85) -> DataFrame:
    """Order by rerank score (query_id, id, score, rerank, exact): exact matches are lifted to the floor, failed ones (-1) come last by retrieval score."""
    df = df.withColumn("rerank", F.when(F.col("exact") & (F.col("rerank") >= 0), F.greatest("rerank", F.lit(floor))).when(F.col("exact"), F.lit(floor)).otherwise(F.col("rerank")))
    failed = F.col("rerank") < 0
    return ranked(df, [failed.asc(), F.when(failed, F.col("score")).otherwise(F.col("rerank")).desc(), F.col("id").asc()])


def least_rerank(df: DataFrame, least: float) -> DataFrame:
    """Drop rows below ``least`` unless a score of the query failed or nothing would be left."""
    own = Window.partitionBy("query_id")
    keeps = (F.min("rerank").over(own) < 0) | (F.max("rerank").over(own) < least) | (F.col("rerank") >= least)
    return df.withColumn("_keep", keeps).filter("_keep").drop("_keep")


def token_budget(df: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, rank, content) in rank order: whole while they fit, then one cut in proportion, then markers."""
    cost = token_count(F.col("content"))
    before = F.coalesce(F.sum("cost").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("cost", cost).withColumn("left", budget - before)
    part = F.floor(F.length("content") * F.col("left") / F.greatest("cost", F.lit(1))).cast("int")
    shown = F.when(F.col("left") <= 0, OMITTED).when(F.col("cost") <= F.col("left"), F.col("content")).when(part > 0, F.concat(F.substr("content", F.lit(1), part), F.lit("\n..." + OMITTED))).otherwise(OMITTED)
    return df.withColumn("content", shown).drop("cost", "left")


def mmr(df: DataFrame, k: int, trade: float = 0.5) -> DataFrame:
    """Greedy maximal marginal relevance of few candidates per query (query_id, id, score, vector): query_id, id, place."""

    def select(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id").reset_index(drop=True)
        known = [v is not None and len(v) > 0 for v in own.vector]
        size = max((len(v) for v, ok in zip(own.vector, known) if ok), default=1)
        m = np.array([v if ok else np.zeros(size) for v, ok in zip(own.vector, known)], float).reshape(len(own), size)
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)
        nearest, taken, free = np.zeros(len(own)), [], np.ones(len(own), bool)
        for _ in range(min(k, len(own))):
            gain = np.where(free, trade * own.score.to_numpy() - (1 - trade) * nearest, -np.inf)
            best = int(gain.argmax())
            taken.append(best)
            free[best] = False
            close = m @ m[best]
            nearest = close if len(taken) == 1 else np.maximum(nearest, close)
        return pd.DataFrame({"query_id": own.query_id.iloc[0], "id": own.id.iloc[taken], "place": np.arange(1, len(taken) + 1)})

    kinds = dict(df.dtypes)
    return df.select("query_id", "id", "score", "vector").groupBy("query_id").applyInPandas(select, f"query_id {kinds['query_id']}, id {kinds['id']}, place int")
