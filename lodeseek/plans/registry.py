"""The engine's registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions.vectors import dot
from lodeseek.operators import chunking, evaluation, event_links, extraction, graph_query, implicit_graph, retrieval, store
from lodeseek.plans.staging import stage
from lodeseek.sources import files
from lodeseek.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TERMS = {"q1": ["the", "tion"], "q2": ["license", "general"], "q3": ["ción", "que", "licensed"]}
#: No two vectors of the driver's table are closer than 0.55, so its graph is made at this threshold.
TAU = 0.25


def query(sql: str | None = None):
    def keep(work: Callable[[SparkSession, str], DataFrame]):
        QUERIES[work.__name__] = work
        if sql:
            ORACLE_SQL[work.__name__] = sql
        return work

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


def exact_sum(name: str) -> F.Column:
    """Sum of doubles that doesn't depend on their order, so that equal sums are ties; where decimals don't hold a value exactly, the plain sum."""
    value = F.col(name)
    exact = value.try_cast("decimal(38,9)")
    return F.when(F.bool_and(value.isNull() | (exact.cast("double").eqNullSafe(value))), F.sum(exact).cast("double")).otherwise(F.sum(value))


# --- text -------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '\\S') THEN greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]'))) ELSE 0 END AS INTEGER) AS n_tokens FROM documents")
def token_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.token_count(F.col("text")).cast("int").alias("n_tokens"))


@query(
    """
WITH s AS (SELECT item_id, list_filter(regexp_extract_all(trim(regexp_replace(text, '\\s+', ' ', 'g')), '[A-Za-z0-9]+|[一-鿿]+'), lambda x: length(x) >= 2) AS t FROM benchmark),
u AS (SELECT item_id, x, min(i) AS i FROM (SELECT item_id, unnest(t) AS x, generate_subscripts(t, 1) AS i FROM s) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM u)
SELECT item_id, string_agg(x, ' ' ORDER BY n) FILTER (WHERE n <= 4) AS terms FROM r GROUP BY item_id
"""
)
def query_terms(spark, sf_dir):
    found = table(spark, sf_dir, "benchmark").select("item_id", tx.query_analysis(F.col("text")).alias("a"))
    return found.select("item_id", F.array_join("a.terms", " ").alias("terms"))


@query()
def exact_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tx.exact_tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256(text) AS content_hash FROM documents) GROUP BY content_hash")
def content_hash_dedupe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))
    return docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT item_id, 'kb://main/file%20' || item_id || '?chunk=c%2F' || item_id AS uri FROM benchmark")
def citation_uri(spark, sf_dir):
    item = F.col("item_id").cast("string")
    return table(spark, sf_dir, "benchmark").select("item_id", tx.citation(F.lit("main"), F.concat(F.lit("file "), item), F.concat(F.lit("c/"), item)).alias("uri"))


# --- ranked channels --------------------------------------------------------------------------------


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("doc_id").alias("pos"))


def _queries(spark):
    return spark.createDataFrame(list(TERMS.items()), "query_id string, terms array<string>")


_BM25 = """
WITH q(query_id, pos, term) AS (VALUES ('q1', 0, 'the'), ('q1', 1, 'tion'), ('q2', 0, 'license'), ('q2', 1, 'general'), ('q3', 0, 'ción'), ('q3', 1, 'que'), ('q3', 2, 'licensed')),
d AS (SELECT doc_id AS id, lower(text) AS c, length(text) AS len FROM documents),
tf AS (SELECT query_id, pos, id, len, CAST((length(c) - length(replace(c, term, ''))) / length(term) AS BIGINT) AS tf FROM q, d),
cand AS (SELECT query_id, id, max(len) AS len FROM tf WHERE tf > 0 GROUP BY ALL),
st AS (SELECT query_id, count(*) AS n, avg(len) AS avgdl FROM cand GROUP BY ALL),
df AS (SELECT query_id, pos, count(*) AS df FROM tf WHERE tf > 0 GROUP BY ALL),
sc AS (SELECT tf.query_id, tf.id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS raw, count(*) AS match_count
       FROM tf JOIN st USING (query_id) JOIN df USING (query_id, pos) WHERE tf > 0 GROUP BY ALL),
rk AS (SELECT *, raw / max(raw) OVER (PARTITION BY query_id) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, id) AS rank FROM sc)
"""


def _bm25(spark, sf_dir, top_k=None):
    return retrieval.bm25(_chunks(spark, sf_dir), _queries(spark), top_k)


@query(_BM25 + "SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, CAST(match_count AS INTEGER) AS match_count FROM rk WHERE rank <= 50")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 50).select("query_id", "id", "rank", r6("score").alias("score"), "match_count")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


_DENSE = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
           FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE score >= 0)
"""


def _dense(spark, sf_dir, top_k):
    vectors = _vectors(spark, sf_dir)
    asked = vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return retrieval.dense_top_k(vectors, asked, top_k)


@query(_DENSE + "SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10).select("query_id", "id", r6("score").alias("score"), "rank")


@query(
    _BM25
    + """, a AS (SELECT query_id, id, rank FROM rk WHERE query_id = 'q1' AND rank <= 50), b AS (SELECT 'q1' AS query_id, id, rank FROM rk WHERE query_id = 'q3' AND rank <= 50),
f AS (SELECT coalesce(a.id, b.id) AS id, coalesce(1.0 / (60 + a.rank), 0) + coalesce(0.5 / (60 + b.rank), 0) AS score FROM a FULL JOIN b ON a.id = b.id)
SELECT id, round(score, 6) AS score FROM f
"""
)
def rrf_hybrid(spark, sf_dir):
    ranks = _bm25(spark, sf_dir, 50)
    fused = retrieval.fuse(ranks.filter("query_id = 'q1'"), ranks.filter("query_id = 'q3'").withColumn("query_id", F.lit("q1")), 0.5)
    return fused.select("id", r6("score").alias("score"))


@query(
    """
WITH l AS (SELECT c_custkey AS id, c_acctbal AS weight, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS pos, 0 AS list FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT o_custkey, sum(o_totalprice), row_number() OVER (ORDER BY sum(o_totalprice) DESC, o_custkey), 1 FROM orders GROUP BY o_custkey),
m AS (SELECT id, max(weight) AS weight, min(pos * 10 + list) AS place FROM l GROUP BY id)
SELECT id, round(weight, 2) AS weight, CAST(row_number() OVER (ORDER BY place) AS INTEGER) AS pos FROM m
"""
)
def round_robin_seeds(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("weight"))
    b = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(exact_sum("o_totalprice").alias("weight"))
    place = lambda df: df.withColumn("pos", F.row_number().over(Window.orderBy(F.col("weight").desc(), "id")))
    return retrieval.round_robin(place(a), place(b)).select("id", F.round("weight", 2).alias("weight"), "pos")


@query()
def token_budget(spark, sf_dir):
    ranks = _bm25(spark, sf_dir, 50).join(_chunks(spark, sf_dir).select("id", "content"), "id")
    return retrieval.token_budget(ranks.select("query_id", "rank", "content"), 2000)


@query()
def mmr_select(spark, sf_dir):
    found = _dense(spark, sf_dir, 30).join(_vectors(spark, sf_dir), "id")
    return retrieval.mmr(found, 10)


@query(
    """
WITH x AS (SELECT l_orderkey AS query_id, l_linenumber AS id, l_quantity / 50 AS score, CASE WHEN l_tax = 0.0 THEN -1 ELSE l_discount * 10 END AS rerank, l_returnflag = 'R' AS exact FROM lineitem),
y AS (SELECT query_id, id, score, exact, CASE WHEN exact THEN greatest(rerank, 0.85) ELSE rerank END AS rerank FROM x)
SELECT query_id, id, round(rerank, 6) AS rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank < 0, CASE WHEN rerank < 0 THEN score ELSE rerank END DESC, id) AS INTEGER) AS rank FROM y
"""
)
def exact_floor_rerank(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") / 50).alias("score"),
        F.when(F.col("l_tax") == 0.0, -1.0).otherwise(F.col("l_discount") * 10).alias("rerank"), (F.col("l_returnflag") == "R").alias("exact"),
    )
    return retrieval.rerank_order(rows).select("query_id", "id", r6("rerank").alias("rerank"), "rank")


# --- links and the implicit graph -------------------------------------------------------------------


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"), F.col("event_id").alias("chunk_index"), F.lit(None).cast("int").alias("span_start"), "ts", F.col("event_type").alias("location"))


_LINKS = """
WITH e AS (SELECT event_id, user_id AS file_id, ts, event_type AS location FROM events),
nx AS (SELECT file_id, event_id AS src, lead(event_id) OVER (PARTITION BY file_id ORDER BY event_id) AS dst, 'EVENT_NEXT' AS edge_type, CAST(NULL AS DOUBLE) AS delta_seconds, 0 AS pos FROM e),
t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS rn FROM e WHERE ts IS NOT NULL),
tm AS (SELECT a.file_id, a.event_id AS src, b.event_id AS dst, 'EVENT_TEMPORAL' AS edge_type, epoch(b.ts) - epoch(a.ts) AS delta_seconds, b.rn - a.rn - 1 AS pos
       FROM t a JOIN t b ON a.file_id = b.file_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 5 WHERE epoch(b.ts) - epoch(a.ts) > 0 AND epoch(b.ts) - epoch(a.ts) <= 86400),
p AS (SELECT *, row_number() OVER (PARTITION BY file_id, location ORDER BY event_id) AS n FROM e WHERE trim(coalesce(location, '')) <> ''),
pr AS (SELECT *, row_number() OVER (PARTITION BY file_id, location ORDER BY ts NULLS LAST, event_id) AS rn FROM p WHERE n <= 50),
lc AS (SELECT a.file_id, a.event_id AS src, b.event_id AS dst, 'EVENT_LOCATION' AS edge_type, epoch(b.ts) - epoch(a.ts) AS delta_seconds, b.rn - a.rn - 1 AS pos
       FROM pr a JOIN pr b ON a.file_id = b.file_id AND a.location = b.location AND b.rn BETWEEN a.rn + 1 AND a.rn + 5),
al AS (SELECT *, 1 AS f FROM nx WHERE dst IS NOT NULL UNION ALL SELECT *, 2 FROM tm UNION ALL SELECT *, 3 FROM lc),
cp AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY f, pos, dst) AS n FROM al)
SELECT file_id, src, dst, edge_type, round(delta_seconds, 3) AS delta_seconds FROM cp WHERE n <= 16
"""


@query(_LINKS)
def event_link_graph(spark, sf_dir):
    return event_links.event_links(_events(spark, sf_dir)).withColumn("delta_seconds", F.round("delta_seconds", 3))


@query(
    """
WITH s AS (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) > 1800 OR epoch(ts) < epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY event_id)) THEN 1 ELSE 0 END AS st FROM events)
SELECT user_id, event_id, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s
"""
)
def session_gap(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("seq", F.col("event_id"))
    return store.sessions(rows, "user_id", "ts").select("user_id", "event_id", F.col("session").cast("long").alias("session"))


_KNN = f"""
WITH s AS (SELECT a.vec_id AS u, b.vec_id AS v, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS n FROM s WHERE sim > {TAU}),
e AS (SELECT a.u, a.v, power((a.sim - {TAU}) / {1 - TAU}, 1.5) AS weight FROM k a JOIN k b ON a.u = b.v AND a.v = b.u WHERE a.n <= 12 AND b.n <= 12 AND a.u < a.v)
"""


@query(_KNN + "SELECT u, v, round(weight, 6) AS weight FROM e")
def sim_edges(spark, sf_dir):
    near = implicit_graph.nearest(_vectors(spark, sf_dir), threshold=TAU)
    return implicit_graph.similar_edges(near, TAU).select("u", "v", r6("weight").alias("weight"))


@query(_KNN + ", d AS (SELECT n, count(*) AS d FROM (SELECT u AS n FROM e UNION ALL SELECT v FROM e) GROUP BY n) SELECT round(coalesce(max(d) / (SELECT count(*) FROM e), 0), 6) AS hub_index FROM d")
def hub_index(spark, sf_dir):
    near = implicit_graph.nearest(_vectors(spark, sf_dir), threshold=TAU)
    return implicit_graph.hub_index(implicit_graph.similar_edges(near, TAU)).select(r6("hub_index").alias("hub_index"))


@query(
    """
WITH c AS (SELECT conv_id * 1000 + turn AS id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id * 1000 + turn) AS rn FROM conversations)
SELECT a.id AS u, b.id AS v, round(0.5 / (b.turn - a.turn), 6) AS weight FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE b.turn - a.turn BETWEEN 1 AND 3
"""
)
def adjacent_edges(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("file_id"), F.col("turn").alias("chunk_index"))
    return implicit_graph.adjacent_edges(turns).select("u", "v", r6("weight").alias("weight"))


_LEX = """
WITH t(term) AS (VALUES ('gnu general'), ('version 2.0'), ('attribution')),
m AS (SELECT term, doc_id AS id FROM t, documents WHERE contains(lower(text), term)),
d AS (SELECT term, count(*) AS df FROM m GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT term, df, 0.4 * ln(1 + n / df) / ln(1 + n) * least(1.0, 8.0 / df) AS weight FROM d, n WHERE df >= 2 AND df / n <= 0.2),
e AS (SELECT a.id AS u, b.id AS v, max(weight) AS weight FROM w JOIN m a USING (term) JOIN m b USING (term) WHERE a.id < b.id AND (df <= 32 OR a.id % 100 = 0 OR b.id % 100 = 0) GROUP BY ALL)
"""
_LEX_TERMS = ["gnu general", "version 2.0", "attribution"]


@query(_LEX + "SELECT u, v, round(weight, 6) AS weight FROM e")
def lexical_edges(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    edges = implicit_graph.term_edges(chunks, _LEX_TERMS, False, chunks.filter("id % 100 = 0"))
    return edges.groupBy("u", "v").agg(r6(F.max("weight")).alias("weight"))


@query(
    _LEX
    + """, x AS (SELECT a.id AS u, b.id AS v, 0.9 AS weight FROM documents_gnu a, documents_gnu b WHERE a.id < b.id AND (a.id % 100 = 0 OR b.id % 100 = 0 OR (SELECT count(*) FROM documents_gnu) <= 32)),
al AS (SELECT u, v, weight, 1 AS f FROM x UNION ALL SELECT u, v, weight, 2 FROM e)
SELECT u, v, round(max(weight), 6) AS weight, CASE min(f) WHEN 1 THEN 'EXACT_ID' ELSE 'LEXICAL' END AS family FROM al GROUP BY u, v
""".replace("documents_gnu", "(SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'gnu general'))")
)
def edge_combine(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    seeds = chunks.filter("id % 100 = 0")
    edges = implicit_graph.combine_edges(implicit_graph.term_edges(chunks, _LEX_TERMS, False, seeds), implicit_graph.term_edges(chunks, ["gnu general"], True, seeds))
    return edges.withColumn("weight", r6("weight"))


# --- stored graph -----------------------------------------------------------------------------------


def _mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("entity_id")).distinct()


@query("SELECT DISTINCT l_orderkey AS chunk_id FROM lineitem WHERE l_partkey % 100 = 0")
def one_hop(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    return graph_query.one_hop(mentions, mentions.filter("entity_id % 100 = 0").select("entity_id").distinct())


@query(
    """
WITH r AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem), b AS (SELECT a, b FROM r UNION SELECT b, a FROM r),
s AS (SELECT DISTINCT l_suppkey AS e, 1.0 / (1 + l_suppkey) AS w FROM lineitem WHERE l_suppkey % 100 = 0),
n AS (SELECT b.b AS e, max(w) AS w FROM b JOIN s ON b.a = s.e GROUP BY b.b)
SELECT l_orderkey AS chunk_id, round(max(w), 6) AS weight FROM n JOIN lineitem ON l_partkey + 1000000 = n.e GROUP BY l_orderkey
"""
)
def two_hop(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    part = F.col("l_partkey") + 1_000_000
    seeds = rows.filter("l_suppkey % 100 = 0").select(F.col("l_suppkey").alias("entity_id"), (1 / (1 + F.col("l_suppkey"))).alias("weight")).distinct()
    mentions = rows.select(F.col("l_orderkey").alias("chunk_id"), part.alias("entity_id")).distinct()
    found = graph_query.two_hop(mentions, rows.select(F.col("l_suppkey").alias("src"), part.alias("dst")).distinct(), seeds)
    return found.select("chunk_id", r6("weight").alias("weight"))


@query(
    """
WITH m AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS e FROM lineitem),
p AS (SELECT a.c AS u, b.c AS v, count(*) AS shared FROM m a JOIN m b USING (e) WHERE a.c % 100 = 0 AND a.c <> b.c GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY v) AS n FROM p)
SELECT u, v, shared, round(shared / max(shared) OVER () * 0.6, 6) AS weight FROM k WHERE n <= 64
"""
)
def co_mention(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    return graph_query.co_mentions(mentions, mentions.filter("chunk_id % 100 = 0").select("chunk_id").distinct()).select("u", "v", "shared", r6("weight").alias("weight"))


def _places(spark, sf_dir):
    """Regions, nations, suppliers and customers as a graph."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nations = table(spark, sf_dir, "nation").select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    suppliers = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))
    customers = table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("src"), name("n", "c_nationkey").alias("dst"))
    return nations.unionByName(suppliers).unionByName(customers)


_PLACES = """e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


@query(f"WITH RECURSIVE {_PLACES}, w AS (SELECT 'n1' AS node, 0 AS depth UNION SELECT b.dst, w.depth + 1 FROM w JOIN b ON b.src = w.node WHERE w.depth < 3) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY node")
def bfs_depth(spark, sf_dir):
    return graph_query.bfs(_places(spark, sf_dir), spark.createDataFrame([("n1",)], "node string"), 3)


@query(
    """
WITH y AS (SELECT DISTINCT n_regionkey AS reg, 'r' || n_regionkey AS node FROM nation UNION SELECT n_regionkey, 'n' || n_nationkey FROM nation
 UNION SELECT n_regionkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_regionkey, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT node, min(node) OVER (PARTITION BY reg) AS component FROM y
"""
)
def components(spark, sf_dir):
    return graph_query.connected(_places(spark, sf_dir))


@query(
    """
WITH d AS (SELECT node, count(*) AS degree FROM (SELECT 'o' || l_orderkey AS node FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) GROUP BY node),
n AS (SELECT DISTINCT 'o' || o_orderkey AS node FROM orders UNION SELECT 'p' || p_partkey FROM part)
SELECT substr(node, 1, 1) AS kind, count(*) AS nodes, count(*) FILTER (WHERE degree IS NULL) AS orphans, CAST(coalesce(max(degree), 0) AS BIGINT) AS max_degree FROM n LEFT JOIN d USING (node) GROUP BY 1
"""
)
def degree_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("node")
    degree = rows.select(name("o", "l_orderkey")).unionByName(rows.select(name("p", "l_partkey"))).groupBy("node").agg(F.count("*").alias("degree"))
    nodes = table(spark, sf_dir, "orders").select(name("o", "o_orderkey")).unionByName(table(spark, sf_dir, "part").select(name("p", "p_partkey")))
    told = nodes.join(degree, "node", "left").groupBy(F.substring("node", 1, 1).alias("kind"))
    return told.agg(F.count("*").alias("nodes"), F.count_if(F.col("degree").isNull()).alias("orphans"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


_STEPS = 10


def _ppr_sql() -> str:
    step = "r{i} AS (SELECT n.node, 0.85 * (coalesce(f.flow, 0)) + 0.15 * n.p AS score FROM nodes n LEFT JOIN (SELECT m.dst, sum(r.score * m.share) AS flow FROM m JOIN r{j} r ON r.node = m.src GROUP BY m.dst) f ON f.dst = n.node)"
    steps = ", ".join(step.format(i=i, j=i - 1) for i in range(1, _STEPS + 1))
    return f"WITH {_PLACES}, o AS (SELECT src, count(*) AS w FROM b GROUP BY src), m AS (SELECT b.src, b.dst, 1.0::DOUBLE / o.w AS share FROM b JOIN o USING (src)), nodes AS (SELECT DISTINCT src AS node, CASE WHEN src IN ('n1', 'n2') THEN 0.5::DOUBLE ELSE 0 END AS p FROM b), r0 AS (SELECT node, p AS score FROM nodes), {steps} SELECT node, round(score, 6) AS score FROM r{_STEPS}"


@query(_ppr_sql())
def ppr_fixed_iters(spark, sf_dir):
    edges = graph_query.undirected(_places(spark, sf_dir).withColumn("weight", F.lit(1.0)))
    reset = spark.createDataFrame([("n1", 1.0), ("n2", 1.0)], "node string, p double")
    return graph_query.pagerank(edges, reset, iterations=_STEPS, tolerance=0.0).select("node", r6("score").alias("score"))


@query()
def beam_paths(spark, sf_dir):
    links = event_links.event_links(_events(spark, sf_dir))
    kind = F.substring("edge_type", 7, 20)
    strength = event_links.edge_strength(kind, F.col("delta_seconds"), F.lit(0), F.lit(0), F.lit(0))
    hops = links.select("src", "dst", kind.alias("edge_type"), strength.alias("strength"), F.lit(0.5).alias("value_weight"), F.lit(True).alias("coherent"))
    seeds = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, sim double")
    return graph_query.event_paths(seeds, hops)


# --- extraction ------------------------------------------------------------------------------------


@query("SELECT p_partkey, lower(trim(p_name)) AS name, substr(sha256('kb:' || lower(trim(p_name)) || ':' || p_brand), 1, 32) AS entity_id FROM part")
def entity_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", extraction.normal_name(F.col("p_name")).alias("name"), "p_brand")
    return parts.select("p_partkey", "name", extraction.entity_id(F.lit("kb"), F.col("name"), F.col("p_brand")).alias("entity_id"))


@query("SELECT event_id, ts AS time_norm, 'second' AS resolution FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events) UNION ALL SELECT event_id + 10000000, date_trunc('day', ts), 'day' FROM events")
def event_times(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    said = events.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("t")).unionByName(events.select(F.col("event_id") + 10_000_000, F.date_format("ts", "yyyy年MM月dd日").alias("t")).toDF("event_id", "t"))
    return said.select("event_id", extraction.event_time(F.col("t")).alias("x")).select("event_id", F.col("x.ts").alias("time_norm"), "x.resolution")


@query()
def rule_events(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    chunks = stage(chunking.chunk(docs).select("chunk_id", "content"), "event-chunks")
    events = extraction.rule_events(chunks).join(chunks, "chunk_id")
    return events.withColumn("verification", extraction.verification(F.col("exact_identifiers"), F.col("time_expr"), F.col("content"))).drop("content")


@query()
def simhash_near_dup(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"), F.col("text").alias("summary"))
    return extraction.near_events(turns)


@query(
    """
WITH b AS (SELECT l_suppkey, min(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END * 10 + ascii(l_returnflag) / 1000.0) AS k, count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY 1),
c AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, CASE WHEN l_suppkey % 2 = 0 THEN 'N' WHEN k < 20 THEN 'R' WHEN k < 30 THEN 'A' ELSE 'N' END AS label, n FROM b)
SELECT name, label, substr(sha256('kb:' || name || ':' || label), 1, 32) AS entity_id FROM c
"""
)
def anchor_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("name"), F.col("l_returnflag").alias("label"), F.lit(1).cast("long").alias("seq"))
    known = table(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").select(F.col("s_suppkey").cast("string").alias("name"), F.lit("N").alias("label")).join(rows.select("name"), "name", "left_semi")
    return extraction.resolved_anchors(rows, known, {"R": 1, "A": 2}, "kb").select("name", "label", "entity_id")


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY length(p_name) DESC, p_name DESC) AS n FROM part)
SELECT p_brand AS name, p_type AS label, max(p_name) FILTER (WHERE n = 1) AS description, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS attributes FROM r GROUP BY ALL
"""
)
def gleaning_merge(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    rows = parts.select(F.col("p_brand").alias("name"), F.col("p_type").alias("label"), F.col("p_name").alias("description"), F.array(F.col("p_size").cast("string")).alias("attributes"))
    return extraction.gleaned(rows).select("name", "label", "description", F.array_join("attributes", ",").alias("attributes"))


# --- stores -----------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, CAST(sum(o_totalprice * 100)::HUGEINT AS BIGINT) AS total_cents, count(*) FILTER (WHERE o_orderstatus = 'F') AS \"n_F\", count(*) FILTER (WHERE o_orderstatus = 'O') AS \"n_O\", count(*) FILTER (WHERE o_orderstatus = 'P') AS \"n_P\" FROM (SELECT o_orderstatus, round(o_totalprice) / 100 AS o_totalprice FROM orders)")
def status_counts(spark, sf_dir):
    files_ = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.round("o_totalprice").cast("long").alias("size"))
    return store.status_counts(files_, ["F", "O", "P"]).withColumnRenamed("total_size", "total_cents")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 50")
def paging(spark, sf_dir):
    return store.page(table(spark, sf_dir, "customer"), [F.col("c_acctbal").desc(), "c_custkey"], 50, 25).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def orphan_entities(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("entity_id"))
    return store.orphans(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entity_id")), used).select(F.col("entity_id").alias("p_partkey"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN round(s_acctbal + 1, 2) ELSE round(s_acctbal, 2) END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, s_name, round(s_acctbal, 2) FROM supplier WHERE s_suppkey % 7 = 0")
def row_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))
    changed = old.filter("s_suppkey % 2 = 0").withColumn("s_acctbal", F.round(F.col("s_acctbal") + 1, 2))
    added = old.filter("s_suppkey % 7 = 0").withColumn("s_suppkey", F.col("s_suppkey") + 1_000_000)
    return store.upsert(old, changed.unionByName(added), "s_suppkey")


@query("SELECT l_suppkey AS src, l_returnflag AS type, count(DISTINCT l_linestatus) AS files, string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) AS file_ids FROM lineitem GROUP BY ALL")
def relation_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.lit(0).alias("dst"), F.col("l_returnflag").alias("type"), F.array("l_linestatus").alias("file_ids"), F.lit("").alias("description"), F.lit(0).alias("seq"))
    small = rows.distinct()
    return store.merged_relations(small).select("src", "type", F.size("file_ids").cast("long").alias("files"), F.array_join("file_ids", ",").alias("file_ids"))


@query("SELECT doc_id AS id, CAST(i AS INTEGER) AS line_number, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), generate_series(3, 5) g(i) WHERE i <= len(l)")
def line_window(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return store.line_window(docs, 2, 3)


@query()
def find_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return store.find_windows(docs, "license", 1, 5)


@query("SELECT DISTINCT o_orderstatus AS label, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))


# --- chunks and sources -----------------------------------------------------------------------------


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))


@query()
def chunk_general(spark, sf_dir):
    return chunking.chunk(_texts(spark, sf_dir), "general", size=400)


@query()
def chunk_semantic(spark, sf_dir):
    pages = files.pages_markdown(table(spark, sf_dir, "pages"))
    return chunking.chunk(pages.select(F.col("page_id").alias("file_id"), F.col("markdown").alias("content")), "semantic", size=400)


@query()
def chunk_laws(spark, sf_dir):
    return chunking.chunk(_texts(spark, sf_dir), "laws")


@query()
def html_to_markdown(spark, sf_dir):
    return files.pages_markdown(table(spark, sf_dir, "pages"))


@query(
    """
SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'
"""
)
def qa_pairs(spark, sf_dir):
    return chunking.qa_pairs(table(spark, sf_dir, "conversations"))


# --- evaluation -------------------------------------------------------------------------------------


def _judged(spark, sf_dir):
    """Orders as queries: their lines by quantity are retrieved, returned ones are gold."""
    rows = table(spark, sf_dir, "lineitem")
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("l_quantity")).alias("q"), "l_linenumber"))), lambda x: x["l_linenumber"])
    gold = F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))))
    return rows.groupBy(F.col("l_orderkey").alias("query_id")).agg(ranked.alias("retrieved"), gold.alias("gold"))


def _metrics_sql() -> str:
    ks = evaluation.KS
    base = """WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS id, l_returnflag = 'R' AS g, row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_quantity, l_linenumber) AS n FROM lineitem),
d AS (SELECT query_id, count(DISTINCT id) FILTER (WHERE g) AS gold FROM r GROUP BY query_id),
gs AS (SELECT query_id, id, bool_or(g) AS g FROM r GROUP BY ALL), x AS (SELECT r.query_id, r.id, r.n, gs.g FROM r JOIN gs USING (query_id, id)),
s AS (SELECT query_id, """
    base += ", ".join(f"count(DISTINCT id) FILTER (WHERE g AND n <= {k}) AS h{k}, count(*) FILTER (WHERE g AND n <= {k}) AS c{k}, coalesce(sum(1 / log2(n + 1)) FILTER (WHERE g AND n <= {k}), 0) AS d{k}" for k in ks)
    base += " FROM x GROUP BY query_id) SELECT query_id, "
    for k in ks:
        p, r = f"(c{k} / {k}.0)", f"(h{k} / gold)"
        base += f"CASE WHEN gold > 0 THEN round({r}, 6) END AS recall_{k}, CASE WHEN gold > 0 THEN round(CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END, 6) END AS f1_{k}, CASE WHEN gold > 0 THEN round(d{k} / list_sum(list_transform(range(least(gold, {k})), lambda i: 1 / log2(i + 2))), 6) END AS ndcg_{k}, "
    return base.rstrip(", ") + " FROM s JOIN d USING (query_id)"


@query(_metrics_sql())
def retrieval_metrics(spark, sf_dir):
    return evaluation.retrieval_metrics(_judged(spark, sf_dir))


# --- streams ----------------------------------------------------------------------------------------


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    return streams.hourly_batch(spark, f"{sf_dir}/events.parquet").withColumn("total", F.round("total", 4))


from lodeseek.plans import more_queries as _more  # noqa: E402, F401  (registers its queries here)
