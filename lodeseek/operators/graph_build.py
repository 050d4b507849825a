"""From extractions to graph rows: routing, canonical labels, payloads, texts to embed, links and their removal, fallback look-ups.

All of it is column expressions and joins; entities are told apart by their normal name and canonical label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.operators import graph_query
from lodeseek.operators.extraction import normal_name
from lodeseek.operators.store import SEPARATOR

# Labels of relations that count as one.
RELATION_LABELS = {
    "资金转账": ["转账", "转账给", "汇款", "汇款至", "汇入", "汇出", "转入", "转出", "打入", "转给", "付款", "支付", "收款"],
    "通话联系": ["通话", "呼叫", "拨打", "主叫", "被叫", "通联"],
    "驾车经过": ["经过", "途经", "过卡", "驶经", "驶过"],
}
# Labels of entities that count as one.
ENTITY_LABELS = {"手机号": ["电话", "手机", "号码", "电话号码", "手机号码"], "银行账户": ["账号", "银行卡", "卡号", "银行账号"]}
# Labels of entities that give way to a typed one of their name.
PLACEHOLDERS = ["Entity", "代号", "昵称", "别名"]
# What identifiers look like, in order, and the labels they get.
IDENTIFIERS = [
    (r"^1[3-9]\d{9}$", "手机号"),
    (r"^\d{16,19}$", "银行账户"),
    (r"^[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z](?:[·・]?[A-Z0-9]){5,6}$", "车牌"),
    (r"^[A-Z]{2,}\d{3,}", "单号"),
]
NO_LABEL = "其他"
LINKS = ["EVENT_NEXT", "EVENT_TEMPORAL", "EVENT_LOCATION"]


def extractor(doc_type: Column, content: Column) -> Column:
    """'event' for narrative kinds of documents, and for books with dialogue or dates; else 'llm'."""
    kind = F.lower(F.btrim(F.coalesce(doc_type, F.lit(""))))
    told = F.coalesce(content, F.lit("")).rlike(r"[问：:]|说[：“」]|答[:：]|\d{4}[-/年]\d{1,2}[-/月]\d{1,2}")
    return F.when(kind.isin("transcript", "chat_record", "general") | ((kind == "book") & told), "event").otherwise("llm")


def _canonical(label: Column, table: dict[str, list[str]]) -> Column:
    out = label
    for name, own in table.items():
        out = F.when(label.isin(own), name).otherwise(out)
    return out


def relation_label(label: Column) -> Column:
    bare = F.btrim(label)
    return F.when(F.coalesce(label, F.lit("")) == "", "RELATED_TO").otherwise(_canonical(bare, RELATION_LABELS))


def entity_label(label: Column) -> Column:
    return _canonical(F.when(F.coalesce(label, F.lit("")) == "", "Entity").otherwise(label), ENTITY_LABELS)


def anchor_label(label: Column, name: Column) -> Column:
    """One form of separators, synonyms as one; what has no type gets one if its name is an identifier."""
    bare = F.btrim(F.coalesce(label, F.lit("")))
    parts = F.filter(F.split(bare, "[/／]"), lambda x: F.btrim(x) != "")
    form = F.regexp_replace(F.when(bare.rlike("[/／]"), F.array_join(parts, "·")).otherwise(bare), r"\s+", " ")
    form = _canonical(F.when(form == "", NO_LABEL).otherwise(form), ENTITY_LABELS)
    typed = form
    for pattern, fixed in reversed(IDENTIFIERS):
        typed = F.when(F.btrim(F.coalesce(name, F.lit(""))).rlike(pattern), fixed).otherwise(typed)
    return F.when(form.isin(NO_LABEL, "Entity"), typed).otherwise(form)


def _in_order(rows: Column) -> Column:
    """Values of structs (seq, x) by seq, without repeats and empty ones."""
    return F.array_distinct(F.filter(F.transform(F.array_sort(rows), lambda r: r["x"]), lambda x: x.isNotNull() & (x.cast("string") != "")))


def entity_payload(rows: DataFrame) -> DataFrame:
    """Entities said in a chunk, (chunk_id, seq, text, label, attributes, description), one for each normal name and canonical label.

    Placeholders give way to the first typed entity of their name. ``names`` has all labels that it stands for.
    """
    keyed = rows.select("chunk_id", "seq", "text", normal_name(F.col("text")).alias("name"), entity_label(F.col("label")).alias("label"), "attributes", "description")
    by_name = Window.partitionBy("chunk_id", "name")
    typed = F.when(~F.col("label").isin(PLACEHOLDERS), F.struct("seq", "label"))
    keyed = keyed.withColumn("typed", F.min(typed).over(by_name)["label"])
    keyed = keyed.withColumn("kept", F.when(F.col("label").isin(PLACEHOLDERS), F.coalesce("typed", "label")).otherwise(F.col("label")))
    # a typed entity's own words come before those of what it absorbs
    order = F.struct((F.col("label") != F.col("kept")).alias("other"), "seq")
    with_order = keyed.withColumn("seq", order).withColumnRenamed("label", "said")
    attributes = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "attributes"))), lambda r: F.coalesce(r["attributes"], F.array())))
    return with_order.groupBy("chunk_id", "name", F.col("kept").alias("label")).agg(
        F.min_by("text", "seq").alias("text"),
        F.array_distinct(attributes).alias("attributes"),
        F.array_join(_in_order(F.collect_list(F.struct("seq", F.col("description").alias("x")))), SEPARATOR).alias("description"),
        F.array_sort(F.collect_set("said")).alias("names"),
    )


def redirected_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations (chunk_id, source, source_label, target, target_label, label) with ends named by the entities that stayed."""
    ways = entities.select("chunk_id", "name", F.explode("names").alias("said"), F.col("label").alias("kept"))
    out = relations.withColumn("label", relation_label(F.col("label")))
    for end in ("source", "target"):
        own = ways.select("chunk_id", F.col("name").alias(f"{end}_n"), F.col("said").alias(f"{end}_l"), F.col("kept").alias(f"{end}_kept"))
        out = out.withColumn(f"{end}_n", normal_name(F.col(end))).withColumn(f"{end}_l", entity_label(F.col(f"{end}_label")))
        out = out.join(own, ["chunk_id", f"{end}_n", f"{end}_l"], "left").withColumn(end, F.col(f"{end}_n")).withColumn(f"{end}_label", F.coalesce(f"{end}_kept", f"{end}_l"))
        out = out.drop(f"{end}_n", f"{end}_l", f"{end}_kept")
    return out


def entity_text(name: Column, label: Column, description: Column, attributes: Column) -> Column:
    said = F.transform(F.filter(F.coalesce(attributes, F.array()), lambda a: F.btrim(a["text"]) != ""), lambda a: F.when(F.btrim(a["label"]) != "", F.concat(F.btrim(a["label"]), F.lit(":"), F.btrim(a["text"]))).otherwise(F.btrim(a["text"])))
    bare = F.btrim(F.coalesce(description, F.lit("")))
    head = F.array(F.coalesce(name, F.lit("")), F.when(F.coalesce(label, F.lit("")) == "", "Entity").otherwise(label))
    return F.array_join(F.concat(head, F.filter(F.array(bare), lambda x: x != ""), said), " | ")


def triple_text(source: Column, relation: Column, target: Column, description: Column) -> Column:
    base = F.concat_ws(" → ", source, relation, target)
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(base, F.lit(" | "), description)).otherwise(base)


def event_text(summary: Column, action: Column, time_expr: Column, location: Column, amount: Column, participants: Column, objects: Column, identifiers: Column) -> Column:
    """Summary and named slots; an empty slot is left out."""
    slot = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(name), x))
    listed = lambda x: F.array_join(F.coalesce(x, F.array()), "、")
    money = F.when(amount.isNotNull(), F.concat(F.lit("金额:"), amount.cast("string"), F.lit("元")))
    return F.concat_ws(" | ", summary, slot("动作:", action), slot("时间:", time_expr), slot("地点:", location), money, slot("参与者:", listed(participants)), slot("标的:", listed(objects)), slot("编号:", listed(identifiers)))


def add_missing(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` and those rows of ``new`` whose keys it lacks, one of each."""
    first = new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    return old.unionByName(first, allowMissingColumns=True)


def relinked(links: DataFrame, made: DataFrame) -> DataFrame:
    """Links (..., file_id) with those of the made ones' files replaced."""
    return links.join(made.select("file_id").distinct(), "file_id", "left_anti").unionByName(made.select(*links.columns))


def without_file(nodes: DataFrame, edges: DataFrame, file_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, orphans) of a graph without a file.

    Nodes (node, type, file_id): its chunks and events go. Edges (src, dst, edge_type, file_id, file_ids): its mentions and links go,
    relations lose the file, and those of no other file go, as do edges at a node that went. Orphans are the entities without an edge.
    """
    gone = nodes.filter(F.col("type").isin("chunk", "event") & (F.col("file_id") == file_id)).select("node")
    own = F.coalesce(F.col("file_id") == file_id, F.lit(False))
    relation = F.col("edge_type") == "RELATION"
    kept = edges.filter(relation | ~own).withColumn("file_ids", F.when(relation, F.array_remove("file_ids", file_id)).otherwise(F.col("file_ids")))
    kept = kept.filter(~relation | (F.size("file_ids") > 0))
    for end in ("src", "dst"):
        kept = kept.join(gone.withColumnRenamed("node", end), end, "left_anti")
    left = nodes.join(gone, "node", "left_anti")
    touched = kept.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return left, kept.select(*edges.columns), left.filter("type = 'entity'").join(touched, "node", "left_anti").select("node")


def seed_lists(entities: DataFrame, triples: DataFrame, events: DataFrame, fallback: bool = False, least: float = 0.15) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Seed lists (id, weight, pos) of hits (id, score, pos; triples with source_id, target_id; events with value_weight)."""
    first = entities.filter(F.col("id").isNotNull()).select("id", (F.coalesce("score", F.lit(0.0)) * (0.3 if fallback else 1.0)).alias("weight"), "pos")
    ends = triples.select(F.posexplode(F.array("source_id", "target_id")).alias("end", "id"), (F.coalesce("score", F.lit(0.0)) * 0.6).alias("weight"), "pos")
    second = ends.filter(F.col("id").isNotNull()).select("id", "weight", (2 * F.col("pos") + F.col("end")).alias("pos"))
    value = F.when(F.coalesce("value_weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("value_weight"))
    third = events.filter(value >= least).select("id", (F.coalesce("score", F.lit(0.0)) * value).alias("weight"), "pos")
    return first, second, third


def event_path_chunks(events: DataFrame, links: DataFrame, anchors: DataFrame, event_seeds: DataFrame, entity_seeds: DataFrame, most: int | None = 8, scale: float = 0.6) -> DataFrame:
    """Chunks (chunk_id, weight) of events (event_id, chunk_id): of the seed events (event_id, weight) themselves, of events one link (src, dst, edge_type) away,
    and of events anchored at seed entities (entity_id, weight). ``most`` neighbours of a seed count, by id; None: all."""
    own = links.filter(F.col("edge_type").isin(LINKS))
    both = own.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(own.select("dst", "src")).distinct()
    near = both.join(event_seeds, F.col("a") == F.col("event_id")).select(F.col("a").alias("seed"), F.col("b").alias("event"), "weight")
    held = anchors.select("entity_id", "event_id").distinct().join(entity_seeds, "entity_id").select(F.col("entity_id").alias("seed"), F.col("event_id").alias("event"), "weight")

    def first(df: DataFrame) -> DataFrame:
        if most:
            df = df.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy("event"))).filter(F.col("n") <= most)
        return df.select(F.col("event").alias("event_id"), (F.col("weight") * scale).alias("weight"))

    every = event_seeds.select("event_id", "weight").unionByName(first(near)).unionByName(first(held))
    return every.join(events.select("event_id", "chunk_id"), "event_id").groupBy("chunk_id").agg(F.max("weight").alias("weight"))


def fallback_chunks(mentions: DataFrame, relations: DataFrame, entity_seeds: DataFrame, paths: DataFrame) -> DataFrame:
    """The first of these that finds any chunk: two hops from the entities (entity_id, weight), event paths, one hop: (chunk_id, weight, way)."""
    ways = [graph_query.two_hop(mentions, relations, entity_seeds), paths]
    heaviest = mentions.join(entity_seeds, "entity_id").groupBy("chunk_id").agg(F.max("weight").alias("weight"))
    every = None
    for i, own in enumerate([*ways, heaviest]):
        own = own.select("chunk_id", "weight", F.lit(i).alias("way"))
        every = own if every is None else every.unionByName(own)
    return every.join(F.broadcast(every.agg(F.min("way").alias("way"))), "way").select("chunk_id", "weight", F.element_at(F.array(*[F.lit(x) for x in ("two_hop", "event_paths", "one_hop")]), F.col("way") + 1).alias("way"))


def implicit_rank(edges: DataFrame, reset: DataFrame, seeds: DataFrame, vectors: DataFrame, top_k: int = 50, damping: float = 0.8, iterations: int = 100, tolerance: float = 1e-8, cut: int = 5) -> DataFrame:
    """Nodes (node, score) by PageRank of edges (u, v, weight) from a reset vector (node, p); where that scores nothing, by the largest cosine with a seed (node)."""
    from lodeseek.functions.vectors import dot

    both = graph_query.undirected(edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight"))
    scores = graph_query.pagerank(both, reset, damping, iterations, tolerance, cut) if reset.filter("p > 0").limit(1).count() else None
    if scores is None or not scores.filter("score > 0 AND score < double('infinity')").limit(1).count():
        own = seeds.join(vectors, F.col("node") == F.col("id")).select(F.col("id").alias("s"), F.col("vector").alias("sv"))
        near = vectors.join(F.broadcast(own), F.col("id") != F.col("s")).groupBy(F.col("id").alias("node")).agg(F.max(dot(F.col("vector"), F.col("sv"))).alias("score"))
        scores = near.join(seeds, "node", "left_anti")
    return scores.filter("score > 0").orderBy(F.col("score").desc(), "node").limit(top_k)


def expansion(anchors: DataFrame, links: DataFrame, frontier: DataFrame, most: int | None = 200) -> DataFrame:
    """(src, dst, edge_type, shared): events of anchors (event_id, entity_id) that share one with a frontier event (event_id), and, where they share none, those a link away.

    ``most`` of each frontier event, those with most in common first; None: all."""
    own = anchors.select("event_id", "entity_id").distinct()
    asked = own.join(frontier.select("event_id"), "event_id", "left_semi").withColumnRenamed("event_id", "src")
    shared = asked.join(own.withColumnRenamed("event_id", "dst"), "entity_id").filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))
    shared = shared.select("src", "dst", F.lit("SHARED").alias("edge_type"), "shared")
    both = links.select("src", "dst", "edge_type").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))
    near = both.join(frontier.select(F.col("event_id").alias("src")), "src", "left_semi").join(shared.select("src", "dst"), ["src", "dst"], "left_anti")
    near = near.groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type")).withColumn("shared", F.lit(0).cast("long"))
    every = shared.unionByName(near)
    if most is None:
        return every
    return every.withColumn("n", F.row_number().over(Window.partitionBy("src").orderBy(F.col("shared").desc(), "dst"))).filter(F.col("n") <= most).drop("n")


def seed_events(hits: DataFrame, least: float = 0.15, top: int = 10) -> DataFrame:
    """The first hits (id, sim, value_weight) of some value."""
    return hits.filter(F.coalesce("value_weight", F.lit(1.0)) >= least).orderBy(F.col("sim").desc(), "id").limit(top)
