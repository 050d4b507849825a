from pyspark.sql import functions as F

from lodeseek.operators import graph_build as g
from lodeseek.operators import upkeep


def test_labels(spark):
    rows = [("汇款至", "", "x"), (None, None, "13812345678"), (" other ", "通讯／账号", "y"), ("", "其他", "京AB1234"[:7] + "C"), ("呼叫", "Entity", "FB2026-0001"), ("x", "号码", "1234567890123456")]
    df = spark.createDataFrame(rows, "r string, e string, n string")
    got = df.select(g.relation_label(F.col("r")).alias("r"), g.entity_label(F.col("e")).alias("e"), g.anchor_label(F.col("e"), F.col("n")).alias("a")).collect()
    assert [r.r for r in got] == ["资金转账", "RELATED_TO", "other", "RELATED_TO", "通话联系", "x"]
    assert [r.e for r in got] == ["Entity", "Entity", "通讯／账号", "其他", "Entity", "手机号"]
    assert [r.a for r in got] == ["其他", "手机号", "通讯·账号", "车牌", "单号", "手机号"]


def test_payload_keeps_the_order_of_what_was_said(spark):
    rows = [(1, 1, "Bob", "代号", [("a", "k")], "first"), (1, 2, "bob.", "人物", [("b", "k"), ("a", "k")], "second"), (1, 3, "Bob", "人物", None, "second"), (1, 4, "Eve", "昵称", [], None), (2, 1, "Bob", "Entity", [], "")]
    df = spark.createDataFrame(rows, "chunk_id int, seq int, text string, label string, attributes array<struct<text:string,label:string>>, description string")
    got = {(r.chunk_id, r.name): r for r in g.entity_payload(df).collect()}
    bob = got[1, "bob"]
    assert (bob.label, bob.text, bob.description, [tuple(a) for a in bob.attributes], bob.names) == ("人物", "bob.", "second<SEP>first", [("b", "k"), ("a", "k")], ["人物", "代号"])
    assert got[1, "eve"].label == "昵称" and got[2, "bob"].label == "Entity" and got[2, "bob"].description == ""
    assert g.entity_payload(df.limit(0)).count() == 0


def test_implicit_rank_and_its_fallback(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "u string, v string, weight double")
    seeds = spark.createDataFrame([("a",)], "node string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("d", [0.8, 0.6])], "id string, vector array<double>")
    got = [r.node for r in g.implicit_rank(edges, seeds.withColumn("p", F.lit(1.0)), seeds, vectors, iterations=20).collect()]
    assert got == ["b", "a", "c"] or got == ["a", "b", "c"]
    none = g.implicit_rank(edges, seeds.withColumn("p", F.lit(0.0)), seeds, vectors).collect()
    assert [(r.node, round(r.score, 6)) for r in none] == [("d", 0.8), ("b", 0.6)]


def test_seed_events_and_shapes(spark):
    hits = spark.createDataFrame([(1, 0.9, 0.1), (2, 0.8, None), (3, 0.8, 0.5)], "id int, sim double, value_weight double")
    assert [r.id for r in g.seed_events(hits, top=2).collect()] == [2, 3]
    found = spark.createDataFrame([("t", 0.5, "p", "c1")], "content string, score double, path string, chunk_id string")
    row = upkeep.search_output(found).first()
    assert row.content == "t" and row.metadata.asDict() == {"score": 0.5, "chunk_id": "c1"}


def test_resets(spark):
    chunks = spark.createDataFrame([("a", "f1", True, "x"), ("b", "f2", True, "y")], "chunk_id string, file_id string, graph_indexed boolean, extraction_result string")
    one = {r.chunk_id: (r.graph_indexed, r.extraction_result) for r in upkeep.reset_graph(chunks, chunks.filter("file_id = 'f1'")).collect()}
    assert one == {"a": (False, None), "b": (True, "y")}
    assert upkeep.reset_graph(chunks).filter("graph_indexed").count() == 0
    assert [r.file_id for r in upkeep.with_sources(chunks, spark.createDataFrame([("f1", "n")], "file_id string, filename string")).filter("source = '未知来源'").collect()] == ["f2"]


def test_as_of_ties_and_gaps(spark):
    left = spark.createDataFrame([("u", 1, "a"), ("u", 5, "b"), ("v", 9, "c"), (None, 2, "d")], "k string, t int, x string")
    right = spark.createDataFrame([("u", 5, 50), ("u", 2, 20), ("w", 1, 1), (None, 1, 7)], "k string, t int, y int")
    assert sorted((r.x, r.y) for r in upkeep.as_of(left, right, ["k"], "t", ["y"]).collect()) == [("a", None), ("b", 50), ("c", None), ("d", 7)]
    assert upkeep.as_of(left.limit(0), right, ["k"], "t", ["y"]).count() == 0
