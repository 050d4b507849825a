"""Registered queries of graph building and upkeep, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodeseek.functions.vectors import dot
from lodeseek.operators import graph_build, graph_query, question_making, retrieval, upkeep
from lodeseek.plans.registry import _PLACES, _places, query, r6, table

_N_TOKENS = "CASE WHEN regexp_matches(text, '\\S') THEN greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]'))) ELSE 0 END"
_LABELS = ["转账", "Entity", "电话", "资金/账户", " ", "通话", "", "其他"]


@query(
    """
WITH d AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN ' General' WHEN 1 THEN 'book' WHEN 2 THEN 'laws' END AS doc_type FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR (doc_id % 4 = 1 AND regexp_matches(coalesce(text, ''), '[问：:]|说[：“」]|答[:：]|\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}')) THEN 'event' ELSE 'llm' END AS route FROM d
"""
)
def extractor_routes(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 4 == 0, " General").when(F.col("doc_id") % 4 == 1, "book").when(F.col("doc_id") % 4 == 2, "laws")
    return table(spark, sf_dir, "documents").select("doc_id", graph_build.extractor(kind, F.col("text")).alias("route"))


_PARTS = f"SELECT *, [{', '.join(repr(x) for x in _LABELS)}][p_partkey % 8 + 1] AS label, CASE WHEN p_partkey % 2 = 0 THEN '138' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') ELSE p_name END AS said FROM part"


@query(
    f"""
WITH p AS ({_PARTS})
SELECT p_partkey,
       CASE WHEN label = '' THEN 'RELATED_TO' WHEN label = '转账' THEN '资金转账' WHEN label = '通话' THEN '通话联系' ELSE trim(label) END AS relation_label,
       CASE WHEN label = '' THEN 'Entity' WHEN label = '电话' THEN '手机号' ELSE label END AS entity_label,
       CASE WHEN trim(label) IN ('', '其他', 'Entity') THEN CASE WHEN p_partkey % 2 = 0 THEN '手机号' WHEN trim(label) = 'Entity' THEN 'Entity' ELSE '其他' END
            WHEN label = '电话' THEN '手机号' WHEN label = '资金/账户' THEN '资金·账户' ELSE label END AS anchor_label
FROM p
"""
)
def canonical_labels(spark, sf_dir):
    parts = _labelled(spark, sf_dir)
    return parts.select("p_partkey", graph_build.relation_label(F.col("label")).alias("relation_label"), graph_build.entity_label(F.col("label")).alias("entity_label"), graph_build.anchor_label(F.col("label"), F.col("said")).alias("anchor_label"))


def _labelled(spark, sf_dir):
    label = F.element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("138"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("*", label.alias("label"), said.alias("said"))


_SAID = "SELECT p_partkey % 40 AS chunk_id, p_partkey AS seq, lower(p_brand) AS name, CASE p_partkey % 3 WHEN 0 THEN 'Entity' WHEN 1 THEN 'Product' ELSE 'Maker' END AS label, p_type AS description, CAST(p_size AS VARCHAR) AS size FROM part"


def _said(spark, sf_dir):
    key = F.col("p_partkey")
    label = F.when(key % 3 == 0, "Entity").when(key % 3 == 1, "Product").otherwise("Maker")
    size = F.array(F.struct(F.col("p_size").cast("string").alias("text"), F.lit("size").alias("label")))
    return table(spark, sf_dir, "part").select((key % 40).alias("chunk_id"), key.alias("seq"), F.col("p_brand").alias("text"), label.alias("label"), size.alias("attributes"), F.col("p_type").alias("description"))


@query(
    f"""
WITH s AS ({_SAID}),
t AS (SELECT chunk_id, name, min_by(label, seq) AS typed FROM s WHERE label <> 'Entity' GROUP BY ALL),
k AS (SELECT s.*, CASE WHEN label = 'Entity' THEN coalesce(typed, label) ELSE label END AS kept, label = 'Entity' AND typed IS NOT NULL AS other FROM s LEFT JOIN t USING (chunk_id, name)),
d AS (SELECT chunk_id, name, kept, description, min((CASE WHEN other THEN 1000000000 ELSE 0 END) + seq) AS o FROM k GROUP BY ALL),
z AS (SELECT chunk_id, name, kept, size, min((CASE WHEN other THEN 1000000000 ELSE 0 END) + seq) AS o FROM k GROUP BY ALL)
SELECT a.chunk_id, a.name, a.kept AS label, a.description, b.sizes
FROM (SELECT chunk_id, name, kept, string_agg(description, '<SEP>' ORDER BY o) AS description FROM d GROUP BY ALL) a
JOIN (SELECT chunk_id, name, kept, string_agg(size, ',' ORDER BY o) AS sizes FROM z GROUP BY ALL) b USING (chunk_id, name, kept)
"""
)
def entity_payload(spark, sf_dir):
    made = graph_build.entity_payload(_said(spark, sf_dir))
    return made.select("chunk_id", "name", "label", "description", F.array_join(F.transform("attributes", lambda a: a["text"]), ",").alias("sizes"))


@query(
    f"""
WITH s AS ({_SAID}), t AS (SELECT chunk_id, name, min_by(label, seq) AS typed FROM s WHERE label <> 'Entity' GROUP BY ALL)
SELECT s.chunk_id, s.seq, s.name AS source, coalesce(typed, 'Entity') AS source_label, lower(s.description) AS target, 'Entity' AS target_label, '资金转账' AS label
FROM s LEFT JOIN t USING (chunk_id, name) WHERE s.label = 'Entity'
"""
)
def relation_ends(spark, sf_dir):
    said = _said(spark, sf_dir)
    relations = said.filter("label = 'Entity'").select("chunk_id", "seq", F.col("text").alias("source"), F.col("label").alias("source_label"), F.col("description").alias("target"), F.lit("").alias("target_label"), F.lit("汇款").alias("label"))
    return graph_build.redirected_relations(relations, graph_build.entity_payload(said)).select("chunk_id", "seq", "source", "source_label", "target", "target_label", "label")


@query(
    """
SELECT p_partkey, p_name || ' | ' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ' | ' || p_type ELSE '' END || ' | size:' || p_size || ' | x' AS entity_text,
       p_name || ' → ' || p_brand || ' → ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' | ' || p_type ELSE '' END AS triple_text FROM part
"""
)
def graph_texts(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
    own = lambda text, label: F.struct(text.alias("text"), F.lit(label).alias("label"))
    attributes = F.array(own(F.col("p_size").cast("string"), "size"), own(F.lit(" "), "none"), own(F.lit("x"), ""))
    return table(spark, sf_dir, "part").select("p_partkey", graph_build.entity_text(F.col("p_name"), F.col("p_brand"), said, attributes).alias("entity_text"), graph_build.triple_text(F.col("p_name"), F.col("p_brand"), F.col("p_type"), said).alias("triple_text"))


@query(
    """
SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN ' | 动作:' || event_type ELSE '' END || ' | 时间:' || strftime(ts, '%Y-%m-%d') || ' | 金额:' || user_id || '元 | 参与者:u' || user_id || '、' || event_type AS event_text FROM events
"""
)
def event_texts(spark, sf_dir):
    c, none = F.col, F.lit(None).cast("string")
    events = table(spark, sf_dir, "events")
    made = graph_build.event_text(c("event_type"), F.when(c("event_id") % 2 == 0, c("event_type")), F.date_format("ts", "yyyy-MM-dd"), none, c("user_id"), F.array(F.concat(F.lit("u"), c("user_id").cast("string")), c("event_type")), F.array().cast("array<string>"), F.lit(None).cast("array<string>"))
    return events.select("event_id", made.alias("event_text"))


@query("SELECT DISTINCT l_orderkey AS chunk_id, l_partkey AS entity_id FROM lineitem WHERE l_orderkey % 3 <> 2")
def mention_upserts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id"))
    return graph_build.add_missing(rows.filter("chunk_id % 3 = 0").distinct(), rows.filter("chunk_id % 3 < 2"), "chunk_id", "entity_id")


@query("SELECT o_orderkey AS src, CASE WHEN o_custkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey + 2 END AS dst, o_custkey AS file_id FROM orders")
def relinked_files(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"), F.col("o_custkey").alias("file_id"))
    return graph_build.relinked(orders, orders.filter("file_id % 2 = 1").withColumn("dst", F.col("dst") + 1))


@query(
    """
WITH m AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), k AS (SELECT m.* FROM m JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 <> 0)
SELECT 'nodes' AS what, (SELECT count(*) FROM orders WHERE o_custkey % 5 <> 0) + (SELECT count(*) FROM part) AS n
UNION ALL SELECT 'mentions', count(*) FROM k
UNION ALL SELECT 'relations', count(*) FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'orphans', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM k) AND p_partkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0) AND p_partkey NOT IN (SELECT s_suppkey + 1 FROM supplier WHERE s_suppkey % 3 <> 0)
"""
)
def file_cascade(spark, sf_dir):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    file_ = F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string"))
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    nodes = orders.select(name("o", "o_orderkey").alias("node"), F.lit("chunk").alias("type"), file_.alias("file_id")).unionByName(parts.select(name("p", "p_partkey").alias("node"), F.lit("entity").alias("type"), F.lit(None).cast("string").alias("file_id")))
    mentions = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct().join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    mentions = mentions.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("MENTIONS").alias("edge_type"), file_.alias("file_id"), F.lit(None).cast("array<string>").alias("file_ids"))
    files = F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("f0"))).otherwise(F.array(F.lit("f0"), F.lit("f1")))
    relations = table(spark, sf_dir, "supplier").select(name("p", "s_suppkey").alias("src"), F.concat(F.lit("p"), (F.col("s_suppkey") + 1).cast("string")).alias("dst"), F.lit("RELATION").alias("edge_type"), F.lit(None).cast("string").alias("file_id"), files.alias("file_ids"))
    left, edges, orphans = graph_build.without_file(nodes, mentions.unionByName(relations), "f0")
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(left, "nodes").unionByName(count(edges.filter("edge_type = 'MENTIONS'"), "mentions")).unionByName(count(edges.filter("edge_type = 'RELATION'"), "relations")).unionByName(count(orphans, "orphans"))


@query(
    """
SELECT 'entity' AS list, s_suppkey AS id, round(s_acctbal / 1000 * 0.3, 6) AS weight FROM supplier
UNION ALL SELECT 'triple', unnest([s_suppkey, s_nationkey]), round(s_acctbal / 1000 * 0.6, 6) FROM supplier
UNION ALL SELECT 'event', s_suppkey, round(s_acctbal / 1000 * CASE WHEN s_nationkey = 0 THEN 1.0 ELSE s_nationkey / 25.0 END, 6) FROM supplier WHERE s_nationkey = 0 OR s_nationkey / 25.0 >= 0.15
"""
)
def seed_weights(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("score"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").cast("long").alias("target_id"), (F.col("s_nationkey") / 25.0).cast("double").alias("value_weight"))
    lists = graph_build.seed_lists(own, own, own, fallback=True)
    named = [df.select(F.lit(n).alias("list"), "id", r6("weight").alias("weight")) for n, df in zip(("entity", "triple", "event"), lists)]
    return named[0].unionByName(named[1]).unionByName(named[2])


_PATH_SQL = """
s AS (SELECT o_orderkey AS e, 1.0::DOUBLE / (1 + o_orderkey) AS w FROM orders WHERE o_orderkey % 50 = 0),
b AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders UNION SELECT o_orderkey + 1, o_orderkey FROM orders),
n AS (SELECT s.e AS seed, b.b AS e, w FROM s JOIN b ON b.a = s.e),
h AS (SELECT DISTINCT l_partkey AS seed, l_orderkey AS e, 1.0::DOUBLE / (1 + l_partkey) AS w FROM lineitem WHERE l_partkey % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY e) AS r FROM h),
x AS (SELECT e, w FROM s UNION ALL SELECT e, w * 0.6 FROM n UNION ALL SELECT e, w * 0.6 FROM k WHERE r <= 8),
paths AS (SELECT o_custkey AS chunk_id, max(w) AS weight FROM x JOIN orders ON o_orderkey = x.e GROUP BY 1)
"""


def _paths(spark, sf_dir):
    orders, rows = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    events = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("chunk_id"))
    links = orders.select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"), F.lit("EVENT_NEXT").alias("edge_type"))
    anchors = rows.select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    own = events.filter("event_id % 50 = 0").select("event_id", (1 / (1 + F.col("event_id"))).alias("weight"))
    entities = anchors.filter("entity_id % 50 = 0").select("entity_id", (1 / (1 + F.col("entity_id"))).alias("weight")).distinct()
    return graph_build.event_path_chunks(events, links, anchors, own, entities)


@query(f"WITH {_PATH_SQL} SELECT chunk_id, round(weight, 6) AS weight FROM paths")
def event_path_chunks(spark, sf_dir):
    return _paths(spark, sf_dir).select("chunk_id", r6("weight").alias("weight"))


@query(f"WITH {_PATH_SQL} SELECT chunk_id, round(weight, 6) AS weight, 'event_paths' AS way FROM paths")
def fallback_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    mentions = rows.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()
    # no relation leads anywhere, so the first way finds nothing
    relations = rows.select(F.col("l_partkey").alias("src"), F.col("l_partkey").alias("dst")).filter("src < 0")
    seeds = mentions.filter("entity_id % 50 = 0").select("entity_id", F.lit(1.0).alias("weight")).distinct()
    return graph_build.fallback_chunks(mentions, relations, seeds, _paths(spark, sf_dir)).select("chunk_id", r6("weight").alias("weight"), "way")


@query(
    """
WITH a AS (SELECT DISTINCT l_orderkey AS e, l_partkey AS p FROM lineitem),
s AS (SELECT x.e AS src, y.e AS dst, 'SHARED' AS edge_type, count(*) AS shared FROM a x JOIN a y USING (p) WHERE x.e % 100 = 0 AND x.e <> y.e GROUP BY ALL),
l AS (SELECT o_orderkey AS src, o_orderkey + 1 AS dst FROM orders UNION SELECT o_orderkey + 1, o_orderkey FROM orders),
n AS (SELECT src, dst, 'EVENT_NEXT' AS edge_type, 0 AS shared FROM l WHERE src % 100 = 0 AND src IN (SELECT e FROM a) AND (src, dst) NOT IN (SELECT src, dst FROM s)),
k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shared DESC, dst) AS r FROM (SELECT * FROM s UNION ALL SELECT * FROM n))
SELECT src, dst, edge_type, shared FROM k WHERE r <= 20
"""
)
def event_expansion(spark, sf_dir):
    anchors = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("entity_id"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1).alias("dst"), F.lit("EVENT_NEXT").alias("edge_type"))
    return graph_build.expansion(anchors, links, anchors.filter("event_id % 100 = 0").select("event_id").distinct(), most=20)


# --- upkeep -----------------------------------------------------------------------------------------


@query(
    """
WITH v AS (SELECT * FROM events WHERE event_type = 'view'), l AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view'),
r AS (SELECT user_id, ts, max(event_id) AS last_id FROM v GROUP BY ALL)
SELECT l.event_id, l.user_id, r.last_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts
"""
)
def as_of_views(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_id"))
    return upkeep.as_of(events.filter("event_type <> 'view'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", ["last_id"]).select("event_id", "user_id", "last_id")


@query("SELECT o_orderkey AS file_id FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'high')")
def document_filter(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") % 2).cast("string").alias("kb_id"), (F.col("o_orderkey") % 7 == 0).alias("is_folder"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("filename"))
    return upkeep.documents_of(files, "0", "F", "HIGH").select("file_id")


@query("SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) ORDER BY 1 LIMIT 500")
def pending_chunks(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderstatus") == "F").alias("graph_indexed"))
    return upkeep.pending(chunks, table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_orderkey").alias("chunk_id")).distinct(), 500).select("chunk_id")


@query("SELECT p_partkey AS entity_id FROM part WHERE contains(lower(p_name || chr(1) || p_brand), 'brand#1') ORDER BY 1 LIMIT 40")
def entity_search(spark, sf_dir):
    entities = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("normalized_name"))
    return upkeep.entities_like(entities, "BRAND#1", 40).select("entity_id")


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL) AS exists FROM documents WHERE doc_id % 3 = 1 AND text IS NOT NULL")
def content_exists(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return upkeep.known(docs.filter("doc_id % 3 = 1"), docs.filter("doc_id % 3 = 0"), "content_hash").select("doc_id", "exists")


@query("SELECT o_orderkey, 'general' AS preset, CASE WHEN o_orderstatus = 'F' THEN '800' ELSE '400' END AS size, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS extra FROM orders")
def settings_levels(spark, sf_dir):
    m = lambda **x: F.create_map(*[y for k, v in x.items() for y in (F.lit(k), v)])
    own = m(size=F.when(F.col("o_orderstatus") == "F", F.lit("800")))
    asked = F.when(F.col("o_orderkey") % 2 == 0, m(extra=F.col("o_orderpriority")))
    made = upkeep.merged_settings(m(size=F.lit("400"), preset=F.lit("general")), own, asked)
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("s")).select("o_orderkey", "s.preset", "s.size", "s.extra")


@query("SELECT o_orderkey AS file_id, CASE o_orderstatus WHEN 'O' THEN 'uploaded' WHEN 'P' THEN 'parsed' ELSE 'indexed' END AS status FROM orders")
def restarted_files(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "O", "parsing").when(F.col("o_orderstatus") == "P", "indexing").otherwise("indexed")
    return upkeep.restarted(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), status.alias("status")))


@query(f"SELECT source AS file_id, count(*) AS chunk_count, CAST(sum({_N_TOKENS}) AS BIGINT) AS token_count FROM documents GROUP BY source")
def chunk_statistics(spark, sf_dir):
    return upkeep.chunk_stats(table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("text").alias("content"))).withColumn("token_count", F.col("token_count").cast("long"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_custkey % 4 <> 0) AS chunks, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 4 <> 0) AS mentions")
def file_delete(spark, sf_dir):
    chunks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("file_id"))
    mentions = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey")
    left = upkeep.deleted({"chunks": chunks, "mentions": mentions}, chunks.filter("file_id % 4 = 0").select("file_id").distinct())
    return left["chunks"].agg(F.count("*").alias("chunks")).join(left["mentions"].agg(F.count("*").alias("mentions")), F.lit(True))


@query("SELECT o_orderkey AS chunk_id, o_orderkey % 5 = 0 OR o_orderstatus = 'F' AS graph_indexed, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE '' END AS extraction_result FROM orders")
def extraction_write_back(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    chunks = orders.select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_orderstatus") == "F").alias("graph_indexed"), F.lit("").alias("extraction_result"), F.array().cast("array<string>").alias("ent_ids"))
    results = orders.filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("extraction_result"), F.array(F.lit("e")).alias("ent_ids"))
    return upkeep.written_back(chunks, results).select("chunk_id", "graph_indexed", "extraction_result")


@query("SELECT l_orderkey AS chunk_id, coalesce(p_name, '未知来源') AS source FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) ON p_partkey = l_partkey")
def chunk_sources(spark, sf_dir):
    files = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("filename"))
    return upkeep.with_sources(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("file_id")), files).select("chunk_id", "source")


@query(
    """
WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS id, CASE WHEN l_linenumber = 3 THEN -1.0 WHEN l_orderkey % 2 = 0 THEN l_quantity / 100.0 ELSE l_quantity END AS score FROM lineitem),
w AS (SELECT *, min(score) FILTER (WHERE score >= 0) OVER (PARTITION BY query_id) AS lo, max(score) FILTER (WHERE score >= 0) OVER (PARTITION BY query_id) AS hi FROM s)
SELECT query_id, id, round(CASE WHEN score >= 0 AND hi > 1 AND hi > lo THEN (score - lo) / (hi - lo) ELSE score END, 6) AS score FROM w
"""
)
def rerank_unit_scores(spark, sf_dir):
    score = F.when(F.col("l_linenumber") == 3, -1.0).when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity") / 100).otherwise(F.col("l_quantity").cast("double"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), score.alias("score"))
    return upkeep.unit_scores(rows).select("query_id", "id", r6("score").alias("score"))


_TURNS = f"SELECT conv_id AS query_id, turn AS pos, text, {_N_TOKENS} AS n FROM conversations"


@query(
    f"""
WITH t AS ({_TURNS}), w AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY pos) AS s, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM t)
SELECT query_id, pos, CASE WHEN s <= 30 THEN text ELSE substr(text, 1, 120) END AS text FROM w WHERE s <= 30 OR r = 1
"""
)
def list_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "text")
    return upkeep.within_budget(turns, 30)


@query(
    f"""
WITH t AS ({_TURNS}), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM t), o AS (SELECT * FROM k WHERE rank <= 8 AND coalesce(text, '') <> ''),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1 AS f FROM o),
c AS (SELECT *, CAST(floor(length(text) * (60 - b) / greatest(n, 1)) AS INTEGER) AS room FROM w)
SELECT query_id, string_agg('【文档 ' || rank || ' | 来源：未知来源】' || chr(10) || CASE WHEN f OR b + n <= 60 THEN text ELSE substr(text, 1, room) || chr(10) || '[内容因长度限制已截断]' END, chr(10) || chr(10) ORDER BY rank) AS context
FROM c WHERE f OR b + n <= 60 OR (b < 60 AND room > 0) GROUP BY query_id
"""
)
def answer_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.col("text").alias("content"))
    found = retrieval.ranked(turns, ["pos"]).withColumn("source", F.lit(None).cast("string"))
    return upkeep.answer_context(found, budget=60)


@query("SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 10")
def run_error_page(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("run_id"), F.col("o_orderkey").alias("item_index"), F.when(F.col("o_orderstatus") == "F", "bad").otherwise(" ").alias("error"))
    return upkeep.run_page(items, 0, 10, 20, True).select(F.col("item_index").alias("o_orderkey"), "total")


@query("SELECT o_custkey AS run_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'failed' ELSE 'completed' END AS status FROM orders GROUP BY 1")
def run_statuses(spark, sf_dir):
    return upkeep.run_status(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "bad").alias("error")))


@query(
    """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.e, b.e) / (a.n * b.n) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, id, round(score, 4) AS score, rank FROM k WHERE rank <= 3
"""
)
def question_contexts(spark, sf_dir):
    raw = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    norm = F.sqrt(dot(F.col("e"), F.col("e")))
    vectors = raw.withColumn("n", norm).select("id", F.transform("e", lambda x: x / F.col("n")).alias("vector"))
    found = upkeep.neighbours_as_context(vectors, vectors.filter("id % 100 = 0").select("id"), 3)
    return found.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def _batch_sql(steps: int = 6) -> str:
    step = "r{i} AS (SELECT q, node, sum(x) AS score FROM (SELECT r.q, m.dst AS node, 0.85 * r.score * m.share AS x FROM m JOIN r{j} r ON r.node = m.src UNION ALL SELECT q, node, 0.15 * score FROM r0) GROUP BY ALL)"
    own = ", ".join(step.format(i=i, j=i - 1) for i in range(1, steps + 1))
    return f"WITH {_PLACES}, o AS (SELECT src, count(*) AS w FROM b GROUP BY src), m AS (SELECT b.src, b.dst, 1.0::DOUBLE / o.w AS share FROM b JOIN o USING (src)), r0 AS (SELECT DISTINCT src AS q, src AS node, 1.0::DOUBLE AS score FROM b WHERE src LIKE 'n%'), {own} SELECT q AS query_id, node, round(score, 6) AS score FROM r{steps}"


@query(_batch_sql())
def ppr_batch(spark, sf_dir):
    edges = graph_query.undirected(_places(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    reset = edges.filter("src LIKE 'n%'").select(F.col("src").alias("query_id"), F.col("src").alias("node")).distinct().withColumn("p", F.lit(1.0))
    return graph_query.pagerank_batch(edges, reset, iterations=6, tolerance=0.0).select("query_id", "node", r6("score").alias("score"))


@query(f"SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '{question_making.SPECIFIC}') AS specific FROM conversations WHERE role = 'user'")
def specific_questions(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", question_making.specific(F.col("text")).alias("specific"))


@query()
def questions_apart(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    items = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("attempt"), F.col("text").alias("query"), F.array(F.crc32("text") % 97).alias("gold_chunk_ids"))
    return question_making.told_apart(items).select("attempt", "query")


@query()
def graph_question_context(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("c"), (F.col("p_partkey") % 40).cast("string")).alias("chunk_id"), F.col("p_brand").alias("entity_id")).distinct()
    edges = parts.select(F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst"), F.lit(1.0).alias("weight"))
    return question_making.graph_context(edges, parts, "c1", 4, 2, iterations=10)
