"""Mixing sources to target weights by Pareto order sampling.

The sources share all words by weight; no target exceeds ``MOST`` times its source's size, the excess being
shared anew among the others (water filling, in closed form over one row per source). A source whose target is
k times its size and a rest takes k whole copies of each document for certain; the rest is a sample of fixed
size in words: documents are ranked by random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken
in that order up to the document that would pass half its size beyond the rest.

The cut in that order is found without sorting a source: ranks fall into ``BINS`` bins, bins are summed
(pre-aggregated) and accumulated, and only the bin that the quota ends in is ordered. The result is a plan of one
row per source; applying it to documents is a projection.

Defined cases: a null text has size 0; a null source is a source of its own, the last; ``u`` comes from a digest
of id, seed and text, so reruns agree; rows that repeat id and text are taken alike; a document of size 0 may be
copied but takes no words; an empty table gives an empty plan; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm.words import words_of
from lodeseek.plans.staging import stage

WEIGHTS = (1, 2, 3)
MOST = 3
BINS = 4096
SEED = "mix-1"
#: Sources up to which the plan, one row each, is broadcast; a larger plan is joined by a shuffle.
BROADCAST_SOURCES = 20_000


@dataclass(frozen=True)
class Mix:
    """The plan (source, source_size, target, whole, rest, share, mean_pref, cut_bin, cut) and whether it is small."""

    plan: DataFrame
    small: bool
    seed: str
    preference: str | None

    def join(self, df: DataFrame) -> DataFrame:
        plan = self.plan.withColumnRenamed("source", "plan_source")
        return df.join(F.broadcast(plan) if self.small else plan, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def _uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """Above 0 and below 1, from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed), F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _sized(docs: DataFrame, seed: str, preference: str | None, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    text = F.col(f"`{text_col}`")
    wish = F.greatest(F.coalesce(F.col(f"`{preference}`").cast("double"), F.lit(0.0)), F.lit(1e-6)) if preference else F.lit(1.0)
    return docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.size(words_of(text)).cast("long").alias("size"),
        _uniform(F.col(f"`{id_col}`"), text, seed).alias("u"), wish.alias("wish"), *more,
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat in the order of code points, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(x) for x in weights])
    df = sources.withColumn("weight", F.element_at(kinds, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = df.withColumn("left", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    df = df.withColumn("weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    df = df.withColumn("full", most * F.col("source_size") * F.col("weights") < F.col("weight") * F.col("left"))
    df = df.withColumn("unit", F.max(F.when(~F.col("full"), F.col("left") / F.col("weights"))).over(everything))
    return df.select("source", "source_size", F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("unit")).alias("target"))


def _ranked(df: DataFrame) -> DataFrame:
    p = F.least(F.col("share") * F.col("wish") / F.col("mean_wish"), F.lit(1 - 1e-9))
    odds = F.col("u") / (1 - F.col("u"))
    df = df.withColumn("rank", F.when(F.col("share") > 0, odds / (p / (1 - p))))
    return df.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS).cast("int"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, preference: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[Mix, DataFrame]:
    """The plan, and the staged sizes (doc_id, source, size, u, wish) it was made from. ``preference``: a column that inclusion is in proportion to, within a source."""
    sized = stage(_sized(docs, seed, preference, id_col, text_col, source_col), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("wish")).alias("wishes"))
    told = targets(sources.select("source", "source_size"), weights, most).join(sources.select(F.col("source").alias("s"), "wishes"), F.col("source").eqNullSafe(F.col("s")))
    size = F.col("source_size")
    whole = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most))).otherwise(0).cast("long")
    told = told.select("source", "source_size", "target", whole.alias("whole"), F.coalesce(F.col("wishes") / F.nullif(size.cast("double"), F.lit(0.0)), F.lit(1.0)).alias("mean_wish"))
    told = told.withColumn("rest", F.col("target") - F.col("whole") * size)
    told = stage(told.withColumn("share", F.coalesce(F.col("rest") / F.nullif(size.cast("double"), F.lit(0.0)), F.lit(0.0))), "targets")
    first = Mix(told, told.count() <= BROADCAST_SOURCES, seed, preference)
    ranked = _ranked(first.join(sized)).filter(F.col("bin").isNotNull())
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    ends = stage(bins.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))).select(F.col("source").alias("s"), F.col("bin").alias("cut_bin"), "before"), "cut-bins")
    ends_in = F.broadcast(ends) if first.small else ends
    last = ranked.join(ends_in, F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut_bin")))
    last = last.groupBy("source", "rank", "doc_id", "size").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    words = F.col("size") * F.col("n")
    taken = last.withColumn("passed", F.col("before") + F.coalesce(F.sum(words).over(order), F.lit(0))).filter(F.col("passed") + words / 2 <= F.col("rest"))
    cuts = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id", "size")).alias("cut")).select(F.col("source").alias("s2"), "cut")
    plan = told.join(ends.select("s", "cut_bin"), F.col("source").eqNullSafe(F.col("s")), "left").join(cuts, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s", "s2")
    return Mix(stage(plan, "mix-plan"), first.small, seed, preference), sized


def _copies(mix: Mix, sized: DataFrame) -> DataFrame:
    df = _ranked(mix.join(sized))
    own = F.struct("rank", "doc_id", "size")
    extra = F.coalesce((F.col("bin") < F.col("cut_bin")) | ((F.col("bin") == F.col("cut_bin")) & F.coalesce(own <= F.col("cut"), F.lit(False))), F.lit(False))
    return df.withColumn("copies", F.col("whole") + extra.cast("long"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    mix, sized = plan_mix(docs, **options)
    return _copies(mix, sized).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken. No text is shuffled."""
    mix, _ = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    df = _copies(mix, _sized(docs, mix.seed, mix.preference, id_col, text_col, source_col, own)).filter("copies > 0")
    return df.select("own", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("own.*")
