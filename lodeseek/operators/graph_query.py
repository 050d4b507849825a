"""Questions to a stored graph: neighbourhoods, PageRank, components, connectivity, event paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.plans.staging import discard, stage


def ppr_edges(edges: DataFrame, count_weight: float = 0.2) -> DataFrame:
    """Weights of typed edges (src, dst, edge_type, value_weight, delta_seconds) by family."""
    per = edges.filter(F.col("edge_type").isin("MENTIONS", "CHUNK_EVENT")).withColumn("chunk", F.col("src"))
    counts = per.groupBy("edge_type", "chunk").agg(F.count("*").alias("n"))
    peaks = counts.groupBy("edge_type").agg(F.max("n").alias("peak"))
    shares = counts.join(F.broadcast(peaks), "edge_type").select(F.col("edge_type").alias("e2"), "chunk", (F.col("n") / F.col("peak")).alias("share"))
    told = edges.join(shares, (F.col("edge_type") == F.col("e2")) & (F.col("src") == F.col("chunk")), "left")
    base = 0.3 + count_weight * F.coalesce("share", F.lit(0.0))
    weight: Column = (
        F.when(F.col("edge_type") == "RELATION", 1.0)
        .when(F.col("edge_type") == "MENTIONS", base)
        .when(F.col("edge_type") == "CHUNK_EVENT", base * (0.3 + 0.7 * F.coalesce("value_weight", F.lit(1.0))))
        .when(F.col("edge_type") == "EVENT_MENTIONS", 0.6)
        .when(F.col("edge_type") == "EVENT_NEXT", 0.5)
        .when(F.col("edge_type") == "EVENT_TEMPORAL", 0.5 * F.greatest(1 - F.coalesce("delta_seconds", F.lit(0.0)) / 86_400, F.lit(0.0)))
        .when(F.col("edge_type") == "EVENT_LOCATION", 0.3)
        .otherwise(1.0)
    )
    return told.select("src", "dst", weight.alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of (src, dst, weight), the larger weight of repeated ones."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def pagerank(edges: DataFrame, reset: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-6, cut: int = 5) -> DataFrame:
    """Personalized PageRank of weighted edges (src, dst, weight) with reset vector (node, p): (node, score).

    Mass of nodes without out-edges returns by the reset vector. The step matrix is staged once; ranks are staged
    every ``cut`` steps, where convergence is checked too, so plans stay short.
    """
    damping = min(0.99, max(0.1, damping))
    total = reset.agg(F.sum("p").alias("s"))
    start = reset.join(F.broadcast(total), F.lit(True)).select("node", (F.col("p") / F.col("s")).alias("p"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(reset.select("node")).distinct()
    out = edges.groupBy("src").agg(F.sum("weight").alias("w"))
    step = stage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("w")).alias("share")), "ppr-step")
    told = nodes.join(start, "node", "left").join(out.select(F.col("src").alias("node"), F.lit(True).alias("goes")), "node", "left")
    told = stage(told.select("node", F.coalesce("p", F.lit(0.0)).alias("p"), F.col("goes").isNull().alias("ends")), "ppr-nodes")
    rank = told.select("node", F.col("p").alias("score"))
    kept = None
    for i in range(1, iterations + 1):
        flow = step.join(rank, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))
        lost = told.filter("ends").join(rank, "node").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
        new = told.join(flow, F.col("node") == F.col("dst"), "left").join(F.broadcast(lost), F.lit(True))
        new = new.select("node", (damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") * F.col("p")) + (1 - damping) * F.col("p")).alias("score"))
        if i % cut and i < iterations:
            rank = new
            continue
        new = stage(new, "ppr")
        moved = new.alias("a").join(rank.alias("b"), "node").agg(F.sum(F.abs(F.col("a.score") - F.col("b.score")))).first()[0] or 0.0
        if kept is not None:
            discard(kept)
        rank = kept = new
        if moved < tolerance:
            break
    return rank


def pagerank_batch(edges: DataFrame, reset: DataFrame, damping: float = 0.85, iterations: int = 30, tolerance: float = 1e-6, cut: int = 5) -> DataFrame:
    """Personalized PageRank of many queries at once: reset vectors (query_id, node, p) to (query_id, node, score).

    As ``pagerank``, but a query holds only the nodes it has reached. Flow and reset are rows of one aggregate, so a step
    is one join by source and one exchange by query and node. Every step is staged, because the next one reads it twice; convergence is checked every ``cut`` steps.
    """
    damping = min(0.99, max(0.1, damping))
    total = Window.partitionBy("query_id")
    start = reset.filter("p > 0").groupBy("query_id", "node").agg(F.sum("p").alias("p"))
    start = stage(start.select("query_id", "node", (F.col("p") / F.sum("p").over(total)).alias("p")), "pprs-start")
    out = edges.groupBy("src").agg(F.sum("weight").alias("w"))
    step = stage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("w")).alias("share")), "pprs-step")
    goes = step.select(F.col("src").alias("node")).distinct()
    rank, kept = start.select("query_id", "node", F.col("p").alias("score")), None
    for i in range(1, iterations + 1):
        flow = step.join(rank, F.col("src") == F.col("node")).select("query_id", F.col("dst").alias("node"), (damping * F.col("score") * F.col("share")).alias("score"))
        lost = rank.join(goes, "node", "left_anti").groupBy("query_id").agg(F.sum("score").alias("lost"))
        back = start.join(lost, "query_id", "left").select("query_id", "node", (F.col("p") * (1 - damping + damping * F.coalesce("lost", F.lit(0.0)))).alias("score"))
        new = flow.unionByName(back).groupBy("query_id", "node").agg(F.sum("score").alias("score"))
        new, old = stage(new, "pprs"), rank
        moved = None
        if i % cut == 0 and i < iterations:
            both = new.unionByName(old.select("query_id", "node", (-F.col("score")).alias("score"))).groupBy("query_id", "node").agg(F.abs(F.sum("score")).alias("moved"))
            moved = both.groupBy("query_id").agg(F.sum("moved").alias("moved")).agg(F.max("moved")).first()[0] or 0.0
        if kept is not None:
            discard(kept)
        rank = kept = new
        if moved is not None and moved < tolerance:
            break
    return rank


def rank_chunks(scores: DataFrame, chunks: DataFrame, events: DataFrame, top_k: int) -> DataFrame:
    """Chunks (chunk_id) by their own score or their events' (event_id, chunk_id), over the best one."""
    own = scores.join(chunks, F.col("node") == F.col("chunk_id")).select("chunk_id", "score")
    lifted = scores.join(events, F.col("node") == F.col("event_id")).select("chunk_id", "score")
    best = own.unionByName(lifted).groupBy("chunk_id").agg(F.max("score").alias("score"))
    peak = best.agg(F.max("score").alias("peak"))
    return best.join(F.broadcast(peak), F.lit(True)).filter("peak > 1e-10").select("chunk_id", (F.col("score") / F.col("peak")).alias("score")).orderBy(F.col("score").desc(), "chunk_id").limit(top_k)


def one_hop(mentions: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chunks of mentions (chunk_id, entity_id) of any seed (entity_id)."""
    return mentions.join(seeds.select("entity_id"), "entity_id", "left_semi").select("chunk_id").distinct()


def two_hop(mentions: DataFrame, relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """Chunks of the seeds' neighbours by relations (src, dst), with the largest weight of a seed (entity_id, weight)."""
    both = relations.select("src", "dst").unionByName(relations.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = both.join(seeds, F.col("src") == F.col("entity_id")).groupBy("dst").agg(F.max("weight").alias("weight"))
    return near.join(mentions, F.col("dst") == F.col("entity_id")).groupBy("chunk_id").agg(F.max("weight").alias("weight"))


def co_mentions(mentions: DataFrame, seeds: DataFrame, scale: float = 0.6, most: int = 64) -> DataFrame:
    """Pairs of a seed chunk and another by shared entities: (u, v, shared, weight), at most ``most`` neighbours a seed, by id."""
    mentions = mentions.select("chunk_id", "entity_id").distinct()
    asked = mentions.join(seeds.select("chunk_id"), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "u")
    pairs = asked.join(mentions.withColumnRenamed("chunk_id", "v"), "entity_id").filter("u != v").groupBy("u", "v").agg(F.count("*").alias("shared"))
    pairs = pairs.withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("v"))).filter(F.col("n") <= most).drop("n")
    peak = pairs.agg(F.max("shared").alias("peak"))
    return pairs.join(F.broadcast(peak), F.lit(True)).select("u", "v", "shared", (F.col("shared") / F.col("peak") * scale).alias("weight")).filter("weight > 0")


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, most_nodes: int | None = None) -> DataFrame:
    """Nodes within ``depth`` hops of the seeds (node) over (src, dst), both ways: (node, depth); nearest first under a cap."""
    both = stage(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "bfs-edges")
    seen = stage(seeds.select("node", F.lit(0).alias("depth")).distinct(), "bfs")
    for d in range(1, depth + 1):
        new = both.join(seen.filter(F.col("depth") == d - 1), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        grown = stage(seen.unionByName(new.select("node", F.lit(d).alias("depth"))), "bfs")
        discard(seen)
        seen = grown
    return seen.orderBy("depth", "node").limit(most_nodes) if most_nodes else seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (node)."""
    told = nodes.select("node")
    return edges.join(told.withColumnRenamed("node", "src"), "src", "left_semi").join(told.withColumnRenamed("node", "dst"), "dst", "left_semi")


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) by smallest reachable node: minima of neighbours, then of their labels, until nothing moves."""
    both = stage(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct(), "cc-edges")
    label = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "node"), "cc")
    while True:
        near = both.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("c2"))
        jump = label.select(F.col("node").alias("n3"), F.col("component").alias("c3"))
        new = label.join(near, F.col("node") == F.col("a"), "left").withColumn("c", F.least("component", "c2")).join(jump, F.col("c") == F.col("n3"), "left")
        new = stage(new.select("node", F.least("c", "c3").alias("component"), (F.least("c", "c3") < F.col("component")).alias("moved")), "cc")
        discard(label)
        label = new
        if not new.filter("moved").limit(1).count():
            return label.select("node", "component")


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of metrics of nodes (node, type) and edges (src, dst, edge_type); chunks count only where nothing else exists."""
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    told = nodes.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    own = told.filter("type != 'chunk'")
    ratios = told.agg(
        F.try_divide(F.count_if((F.col("type") != "chunk") & (F.col("degree") == 0)), F.count_if(F.col("type") != "chunk")).alias("orphan_rate"),
        F.coalesce(F.try_divide(F.sum("degree"), F.count("*")), F.lit(0.0)).alias("avg_degree"),
    )
    sizes = connected(edges).groupBy("component").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n").alias("largest")).join(told.agg(F.count("*").alias("n_nodes")), F.lit(True)).select(F.try_divide(F.greatest(F.coalesce("largest", F.lit(0)), F.when(F.col("n_nodes") > 0, 1).otherwise(0)), F.col("n_nodes")).alias("lcc_ratio"))
    anchored = edges.filter("edge_type = 'EVENT_MENTIONS'")
    events = own.filter("type = 'event'").agg(F.count("*").alias("events"))
    reuse = anchored.agg(F.countDistinct("dst").alias("anchors"), F.countDistinct("src").alias("anchored")).join(events, F.lit(True))
    reuse = reuse.select(F.try_divide("events", "anchors").alias("anchor_reuse"), F.try_divide(F.col("events") - F.col("anchored"), F.col("events")).alias("zero_anchor_rate"))
    return ratios.join(largest, F.lit(True)).join(reuse, F.lit(True))


#: What a graph has to meet.
GATE = {"orphan_rate": ("<=", 0.01), "lcc_ratio": (">=", 0.9), "anchor_reuse": (">=", 2.0), "zero_anchor_rate": ("<=", 0.2)}


def gate(metrics: DataFrame) -> DataFrame:
    """Failed metrics (metric, value); unknown ones do not fail."""
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), ((F.col(n) > x) if op == "<=" else (F.col(n) < x)).alias("fails")) for n, (op, x) in GATE.items()]
    return metrics.select(F.inline(F.array(*rows))).filter("fails").select("metric", "value")


def event_paths(seeds: DataFrame, hops: DataFrame, width: int = 8, depth: int = 5, least: float = 0.15, top: int = 5) -> DataFrame:
    """Beam search of one query over hops (src, dst, edge_type, strength, value_weight, coherent) from seeds (id, sim): (path, score, coherence).

    Candidates of a hop are cut to the beam before they are staged; a path that cannot go on is kept as it is.
    """
    beam = seeds.select(F.array("id").alias("path"), F.lit(0.0).alias("score"), F.array().cast("array<double>").alias("strengths"))
    order = [F.col("score").desc(), F.size("path").desc(), F.col("path")]
    sims = seeds.select(F.col("id").alias("dst"), "sim")
    ways = hops.filter("coherent").filter((F.col("value_weight") >= least) | (F.col("edge_type") == "NEXT")).join(F.broadcast(sims), "dst", "left")
    ways = stage(ways, "hops")  # read in every round
    for _ in range(depth):
        beam = stage(beam, "beam")
        more = beam.join(ways, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        gain = 0.5 * F.coalesce("sim", F.lit(0.0)) + 0.3 * F.col("strength") + 0.2 * F.col("value_weight")
        more = more.select(F.array_append("path", F.col("dst")).alias("path"), (F.col("score") + gain).alias("score"), F.array_append("strengths", F.col("strength")).alias("strengths"), F.slice("path", 1, F.size("path")).alias("from"))
        if not more.limit(1).count():
            break
        stuck = beam.join(more.select("from").distinct(), F.col("path") == F.col("from"), "left_anti")
        best = more.drop("from").groupBy("path").agg(F.max_by("score", "score").alias("score"), F.max_by("strengths", "score").alias("strengths"))
        beam = stuck.unionByName(best).orderBy(*order).limit(width)
    mean = F.when(F.size("strengths") > 0, F.aggregate("strengths", F.lit(0.0), lambda a, x: a + x) / F.size("strengths")).otherwise(0.0)
    return beam.orderBy(*order).limit(top).select("path", F.round("score", 6).alias("score"), F.bround(mean, 6).alias("coherence"))
