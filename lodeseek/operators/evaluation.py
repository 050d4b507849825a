"""Retrieval metrics as column arithmetic over (query_id, retrieved, gold)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 3, 5, 10)


def precision_at(k: int) -> Column:
    hits = F.size(F.filter(F.slice("retrieved", 1, k), lambda x: F.array_contains("gold", x)))
    return hits / F.lit(float(k))


def recall_at(k: int) -> Column:
    gold = F.size(F.array_distinct("gold"))
    return F.when(gold > 0, F.size(F.array_intersect(F.slice("retrieved", 1, k), F.col("gold"))) / gold).otherwise(0.0)


def f1_at(k: int) -> Column:
    p, r = precision_at(k), recall_at(k)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def ndcg_at(k: int) -> Column:
    gain = lambda i: 1 / F.log2(i.cast("double") + 2)
    got = F.aggregate(F.transform(F.slice("retrieved", 1, k), lambda x, i: F.when(F.array_contains("gold", x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    most = F.least(F.size(F.array_distinct("gold")), F.lit(k))
    ideal = F.aggregate(F.sequence(F.lit(0), F.greatest(most - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + gain(i))
    return F.when(most > 0, got / ideal).otherwise(0.0)


def retrieval_metrics(df: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """recall, f1 and ndcg at each k; null where either side is empty."""
    known = (F.size("retrieved") > 0) & (F.size("gold") > 0)
    columns = [F.when(known, F.round(work(k), 6)).alias(f"{name}_{k}") for k in ks for name, work in (("recall", recall_at), ("f1", f1_at), ("ndcg", ndcg_at))]
    return df.select("query_id", *columns)


def aggregate_metrics(metrics: DataFrame) -> DataFrame:
    """Mean of each metric, a missing one counting 0."""
    names = [c for c in metrics.columns if c != "query_id"]
    return metrics.agg(*[F.round(F.avg(F.coalesce(F.col(n), F.lit(0.0))), 6).alias(n) for n in names])


def overall_score(metrics: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean answer score if there is any, else mean recall at 10."""
    a, b = answers.agg(F.avg("score").alias("a")), metrics.agg(F.avg("recall_10").alias("b"))
    return a.join(b, F.lit(True)).select(F.coalesce("a", "b", F.lit(0.0)).alias("overall_score"))
