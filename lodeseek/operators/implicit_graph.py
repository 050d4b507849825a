"""The graph made at query time: similar, adjacent and term-sharing chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators.pairs import best_pairs
from lodeseek.operators.retrieval import ranked
from lodeseek.plans.staging import stage

KNN, THRESHOLD, EXPONENT = 12, 0.55, 1.5
ADJACENT_WEIGHT, ADJACENT = 0.5, 3
LEXICAL_WEIGHT, DF_RATIO, CLIQUE, EXACT_WEIGHT = 0.4, 0.2, 32, 0.9
#: Families by priority when edges of several meet.
FAMILIES = ("EXACT_ID", "LEXICAL", "ADJACENT", "SIMILAR", "REAL")


def nearest(vectors: DataFrame, k: int = KNN, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """(u, v, sim): for each of the unit vectors (id, vector) its k nearest above the threshold, ties by id.

    Exact, by blocks (of ``block`` rows, or as many as fit): a task keeps its own k best of a row, so what is shuffled grows with rows times blocks.
    """
    asked = vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    found = best_pairs(vectors, asked, k, threshold, over=True, others=True, asked=block, searched=block)
    return ranked(found.toDF("u", "v", "sim"), [F.col("sim").desc(), F.col("v").asc()], k, "u").drop("rank")


def similar_edges(near: DataFrame, threshold: float = THRESHOLD, exponent: float = EXPONENT) -> DataFrame:
    """(u, v, weight, family) of pairs that are each other's nearest."""
    near = stage(near, "nearest")  # read twice
    back = near.select(F.col("v").alias("u2"), F.col("u").alias("v2"))
    both = near.filter("u < v").join(back, (F.col("u") == F.col("u2")) & (F.col("v") == F.col("v2")), "left_semi")
    return both.select("u", "v", F.pow((F.col("sim") - threshold) / (1 - threshold), F.lit(exponent)).alias("weight"), F.lit("SIMILAR").alias("family"))


def hub_index(edges: DataFrame) -> DataFrame:
    """Largest degree over number of edges; 0 without edges."""
    degree = edges.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    return degree.agg(F.coalesce(F.max("d") / (F.sum("d") / 2), F.lit(0.0)).alias("hub_index"))


def adjacent_edges(chunks: DataFrame, reach: int = ADJACENT, weight: float = ADJACENT_WEIGHT) -> DataFrame:
    """Chunks (id, file_id, chunk_index) at most ``reach`` places and indices on in the same file."""
    after = Window.partitionBy("file_id").orderBy("chunk_index", "id").rowsBetween(1, reach)
    near = chunks.withColumn("near", F.collect_list(F.struct(F.col("id").alias("v"), F.col("chunk_index").alias("j"))).over(after))
    near = near.select(F.col("id").alias("u"), "chunk_index", F.inline("near")).withColumn("gap", F.col("j") - F.col("chunk_index")).filter(F.col("gap").between(1, reach))
    return near.select("u", "v", (F.lit(weight) / F.col("gap")).alias("weight"), F.lit("ADJACENT").alias("family"))


def term_edges(chunks: DataFrame, terms: list[str], exact: bool, seeds: DataFrame | None = None, clique: int | None = CLIQUE) -> DataFrame:
    """Chunks (id, content) that share a query's term: all pairs of few, else pairs with a seed; all pairs of any if ``clique`` is None. Terms are a handful."""
    total = chunks.count()
    held = F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower("content"), t))
    found = chunks.select("id", F.explode(held).alias("term"))
    df = found.groupBy("term").agg(F.count("*").alias("df")).filter("df >= 2")
    if exact:
        weight = F.lit(EXACT_WEIGHT)
    else:
        df = df.filter(F.col("df") / max(total, 1) <= DF_RATIO)
        weight = LEXICAL_WEIGHT * F.log1p(total / F.col("df")) / F.log1p(F.lit(float(total))) * F.least(F.lit(1.0), 8.0 / F.col("df"))
    told = found.join(F.broadcast(df), "term")
    small = told if clique is None else told.filter(F.col("df") <= clique)
    pairs = small.select("term", "df", F.col("id").alias("u")).join(small.select("term", F.col("id").alias("v")), "term").filter("u < v")
    if seeds is not None and clique is not None:
        large = told.filter(F.col("df") > clique)
        stars = large.join(seeds.select("id"), "id", "left_semi").select("term", "df", F.col("id").alias("s")).join(large.select("term", F.col("id").alias("o")), "term").filter("s != o")
        pairs = pairs.unionByName(stars.select("term", "df", F.least("s", "o").alias("u"), F.greatest("s", "o").alias("v")))
    return pairs.select("u", "v", weight.alias("weight"), F.lit("EXACT_ID" if exact else "LEXICAL").alias("family")).distinct()


def combine_edges(*families: DataFrame) -> DataFrame:
    """One edge for each pair: the largest weight, the family of highest priority."""
    every = families[0]
    for own in families[1:]:
        every = every.unionByName(own)
    every = every.filter("weight > 0 AND u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight", "family")
    order = F.array_position(F.array(*[F.lit(x) for x in FAMILIES]), F.col("family"))
    return every.groupBy("u", "v").agg(F.max("weight").alias("weight"), F.min_by("family", order).alias("family"))


def personalization(cosines: DataFrame, seeds: DataFrame, mix: float = 0.6, pool: int = 64) -> DataFrame:
    """Reset vector (node, p): softmax over the best cosines (node, cosine), mixed with the shares of seeds (node, weight)."""
    best = cosines.orderBy(F.col("cosine").desc(), "node").limit(pool)
    top = best.agg(F.max("cosine").alias("top"))
    soft = best.join(F.broadcast(top), F.lit(True)).withColumn("e", F.exp(F.greatest(F.col("cosine") - F.col("top"), F.lit(-60.0))))
    soft = soft.join(F.broadcast(soft.agg(F.sum("e").alias("s"))), F.lit(True)).select("node", (F.col("e") / F.col("s")).alias("q"))
    own = seeds.join(F.broadcast(seeds.agg(F.sum("weight").alias("s"))), F.lit(True)).select("node", (F.col("weight") / F.col("s")).alias("share"))
    both = soft.join(own, "node", "full_outer").select("node", F.coalesce("q", F.lit(0.0)).alias("q"), F.coalesce("share", F.lit(0.0)).alias("share"))
    there = both.agg((F.sum("q") > 0).alias("has_q"), (F.sum("share") > 0).alias("has_s"))
    a = F.when(F.col("has_q") & F.col("has_s"), mix).when(F.col("has_q"), 1.0).otherwise(0.0)
    return both.join(F.broadcast(there), F.lit(True)).select("node", (a * F.col("q") + (1 - a) * F.col("share")).alias("p"))


def anchor_pool(vectors: DataFrame, seeds: DataFrame, query: list[float], nearest_k: int = KNN, top_m: int = 256, cap: int = 512) -> DataFrame:
    """Ids of a bounded part of a large snapshot: the seeds (id), their nearest vectors, and the query's best; seeds stay under the cap."""
    from lodeseek.functions.vectors import dot

    asked = F.array(*[F.lit(float(x)) for x in query])
    own = vectors.join(F.broadcast(seeds.select("id").limit(cap)), "id", "left_semi").select(F.col("id").alias("s"), F.col("vector").alias("sv"))
    near = vectors.join(F.broadcast(own), F.col("id") != F.col("s")).select("s", "id", dot(F.col("vector"), F.col("sv")).alias("sim"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("s").orderBy(F.col("sim").desc(), "id"))).filter(F.col("n") <= nearest_k)
    best = vectors.select("id", dot(F.col("vector"), asked).alias("sim")).orderBy(F.col("sim").desc(), "id").limit(top_m)
    every = own.select(F.col("s").alias("id"), F.lit(0).alias("tier"), F.lit(1.0).alias("sim")).unionByName(near.select("id", F.lit(1).alias("tier"), "sim")).unionByName(best.select("id", F.lit(2).alias("tier"), "sim"))
    return every.groupBy("id").agg(F.min("tier").alias("tier"), F.max("sim").alias("sim")).orderBy("tier", F.col("sim").desc(), "id").limit(cap).select("id", "tier")


def explanations(edges: DataFrame, seeds: DataFrame, scores: DataFrame, cosines: DataFrame, width: int = 4, hops: int = 3, top: int = 3) -> DataFrame:
    """Best paths from seeds (node, weight) over (u, v, weight): (path, score); a hop adds .5 cosine + .3 weight + .2 PageRank, and no node comes twice."""
    both = edges.select("u", "v", "weight").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))
    told = both.join(scores.select(F.col("node").alias("v"), F.col("score").alias("ppr")), "v", "left").join(cosines.select(F.col("node").alias("v"), "cosine"), "v", "left")
    step = told.select("u", "v", (0.5 * F.coalesce("cosine", F.lit(0.0)) + 0.3 * F.col("weight") + 0.2 * F.coalesce("ppr", F.lit(0.0))).alias("gain"))
    order = [F.col("score").desc(), F.col("path")]
    beam = seeds.select(F.array("node").alias("path"), F.col("weight").alias("score")).orderBy(*order).limit(width)
    kept = None
    for _ in range(hops):
        beam = stage(beam, "explanations")
        kept = beam if kept is None else kept.unionByName(beam)
        beam = beam.join(step, F.element_at("path", -1) == F.col("u")).filter(~F.array_contains("path", F.col("v"))).select(F.array_append("path", F.col("v")).alias("path"), (F.col("score") + F.col("gain")).alias("score")).orderBy(*order).limit(width)
    kept = beam if kept is None else kept.unionByName(beam)
    return kept.filter(F.size("path") > 1).orderBy(*order).limit(top)
