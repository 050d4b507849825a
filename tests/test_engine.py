import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.engine import KnowledgeBase, Settings
from lodeseek.operators import case_documents as cd


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _vector(texts):
    return texts.map(lambda t: cd.hashed_vector(t).tolist())


def embed(df, source, to):
    return df.withColumn(to, _vector(source))


@pytest.fixture(scope="module")
def base(spark):
    docs = [("f1", "notes.txt", "\n".join(f"alpha line {i} about ships" for i in range(40))), ("f2", "chat.txt", "2024-01-01 10:00 hi\n2024-01-01 10:05 there\n2024-01-01 11:30 later ORD-991\n"), ("f3", "t.csv", "| k | lat |\n| --- | --- |\n| a | 1 |\n| b | 2 |")]
    kb = KnowledgeBase(spark, embed)
    kb.ingest(spark.createDataFrame(docs, "file_id string, filename string, content string"))
    kb.chunks, kb.vectors = kb.chunks.cache(), kb.vectors.cache()
    return kb


@pytest.mark.parametrize("mode", ["vector", "keyword", "hybrid"])
def test_query(spark, base, mode):
    asked = spark.createDataFrame([("q", "where is ORD-991")], "query_id string, text string")
    got = base.query(asked, search_mode=mode, lexical=True).orderBy("rank").collect()
    assert got and got[0].rank == 1 and any("ORD-991" in r.content for r in got[:3]) and len({r.chunk_id for r in got}) == len(got)
    only = base.query(asked, spark.createDataFrame([("f1",)], "file_id string"), search_mode="vector", use_graph=False).collect()
    assert {r.file_id for r in only} == {"f1"}
    assert Settings.options()["rrf_k"] == 60


def test_graph_step(spark, base):
    chunks = base.chunks.withColumn("graph_indexed", F.lit(True)).cache()
    ids = [r.chunk_id for r in chunks.orderBy("chunk_id").collect()]
    mentions = spark.createDataFrame([(i, e) for n, i in enumerate(ids) for e in (f"e{n}", f"e{n + 1}")] + [(ids[0], ids[0])], "chunk_id string, entity_id string")
    kb = KnowledgeBase(spark, embed, chunks, base.vectors, mentions, spark.createDataFrame([("e0", f"e{len(ids)}")], "src string, dst string"))
    asked = spark.createDataFrame([("q", "alpha ships"), ("r", "there")], "query_id string, text string")
    got = kb.query(asked, search_mode="vector", graph_seeds=1).collect()
    assert {r.query_id for r in got} == {"q", "r"} and len({(r.query_id, r.chunk_id) for r in got}) == len(got)
    seeds = spark.createDataFrame([("q", ids[0], 1.0, 1), ("none", "gone", 1.0, 1)], "query_id string, id string, score double, rank int")
    reached, weight = kb._graph(seeds, kb.settings)
    rows = reached.filter("query_id = 'q'").orderBy("rank").collect()
    assert weight == kb.settings.graph_weight and rows[0].id == ids[0] and {r.id for r in rows} == set(ids)
    assert not reached.filter("query_id = 'none'").count()


def test_ingest_replaces(spark, base):
    n = base.chunks.filter("file_id = 'f1'").count()
    kb = KnowledgeBase(spark, embed, base.chunks, base.vectors)
    kb.ingest(spark.createDataFrame([("f1", "n.txt", "new text")], "file_id string, filename string, content string"), "general")
    assert n > 0 and kb.chunks.filter("file_id = 'f1'").count() == 1 and kb.vectors.count() == kb.chunks.count()


def test_kinds_and_chunkers(spark):
    rows = spark.createDataFrame([("a_transcript.txt", ""), ("x.csv", "Q: a"), ("n.txt", "Q: a\nA: b"), ("m.txt", "2024-01-01 10:00 x"), ("z.txt", "plain")], "f string, t string")
    assert [r.k for r in rows.select(cd.kind_of(F.col("f"), F.col("t")).alias("k")).collect()] == ["transcript", "csv", "transcript", "chat", "general"]
    made = cd.transcript("姓名：张三\n时间：今天\n\n问：哪里\n答：这里\n问：谁\n答：我", size=12)
    assert made[0].startswith("姓名") and len(made) >= 3 and all(x.startswith("姓名：张三\n时间：今天\n") for x in made[1:])
    made = cd.chat("2024-01-01 10:00 a\n10:10 b\n11:40 c\n2024-01-02 09:00 d")
    assert [x.split("\n")[0] for x in made] == ["[2024-01-01 10:00 - 2024-01-01 10:10]", "[2024-01-01 11:40 - 2024-01-01 11:40]", "[2024-01-02 09:00 - 2024-01-02 09:00]"]
    assert cd.csv_table("| k | lat | v |\n|---|---|---|\n| a | 1 | x |\n| b | 2 | |") == ["k、v\nk：a；v：x；\nk：b；"]
    assert cd.bullet_family(["1. a", "1.1 b", "text", "# t"]) == "decimal" and cd.bullet_family(["x"]) is None
    assert cd.without_contents(["Contents", "One .... 1", "Two .... 2", "One", "body"]) == ["One", "body"]
    assert cd.tree("1. Top\nintro\n1.1 Sub\nbody") == ["1. Top\nintro", "1.1 Sub\nbody"] or cd.tree("1. Top\nintro\n1.1 Sub\nbody")[-1].endswith("body")
    got = spark.createDataFrame([("One. Two is here! 三。四\nfive",)], "t string").select(cd.sentences(F.col("t")).alias("s")).first().s
    assert got == ["One.", "Two is here!", "三。", "四", "five"]


def test_clusters():
    rng = np.random.default_rng(0)
    m = np.vstack([c + rng.normal(scale=0.01, size=(5, 4)) for c in np.eye(4)[:3]])
    labels = cd.average_linkage(m, 0.3)
    assert len(set(labels.tolist())) == 3 and cd.silhouette(m, labels) > 0.9
    assert " ".join(cd.semantic("Aa bb. Cc dd. 11 22.", size=3)).replace(" ", "") == "Aabb.Ccdd.1122."
