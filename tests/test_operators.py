import hashlib
import io
import re
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import text as tx
from lodeseek.functions import vectors as vx
from lodeseek.operators import chunking, evaluation, event_links, extraction, graph_query, implicit_graph, pairs, retrieval, store
from lodeseek.plans import registry
from lodeseek.sources import files
from lodeseek.streaming import events as streams


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("call 13912345678 now", ["13912345678"]),
        ("id 11010119900307123X ok", ["11010119900307123X"]),
        ('the "ORD-991" and 2026 and 12345', ["ORD-991", "12345"]),
        ('plain "no digits here" text', []),
        ("A1b A1b c-2- d_3 e4x f5x", ["A1b", "c-2", "d_3", "e4x"]),
        ('John\'s order "ORD-991"', ["ORD-991"]),
        ("", []),
        (None, []),
    ],
)
def test_exact_tokens(spark, text, want):
    assert one(spark, tx.exact_tokens, text) == want


def test_query_analysis(spark):
    a = one(spark, tx.query_analysis, "请问  ORD-991 in 仓库 where is it")
    assert a.phrase == "ORD-991 in 仓库 where is it" and a.exact == ["ORD-991"] and a.terms == ["ORD", "991", "in", "仓库"]
    assert one(spark, tx.token_count, "ab 知识 c_d!") == 4 and one(spark, tx.token_count, "?!") == 1 and one(spark, tx.token_count, "  ") == 0


def test_simhash(spark):
    def plain(text):
        squeezed = re.sub(r"\s+", "", text)
        runs = re.findall("[一-鿿]|[a-zA-Z0-9]+", squeezed)
        tokens = [g for r in runs for g in ([r] if len(r) == 1 else [r[i : i + 2] for i in range(len(r) - 1)])] if squeezed else ["<empty>"]
        votes = np.zeros(64, int)
        for t in tokens or [squeezed[:16]]:
            v = int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big")
            votes += np.array([1 if v >> b & 1 else -1 for b in range(64)])
        return sum(1 << b for b in range(64) if votes[b] > 0)

    for text in ("张三 transferred 500 to 李四", "abc", "", "x", "!!"):
        assert one(spark, tx.simhash64, text) & (2**64 - 1) == plain(text)


def test_extraction(spark):
    names = spark.createDataFrame([(" ＡＢＣ  Corp。.",), ("x  Y!",), (None,)], "t string").select(extraction.normal_name(F.col("t")).alias("x")).collect()
    assert [r.x for r in names] == ["abc corp", "x y", ""]
    times = ["2024-03-15T10:00:01", "2024/03/15 10:00", "2024年03月15日", "soon", None]
    got = spark.createDataFrame([(t,) for t in times], "t string").select(extraction.event_time(F.col("t")).alias("x")).collect()
    assert [r.x and r.x.resolution for r in got] == ["second", "minute", "day", None, None]
    chunks = spark.createDataFrame([("c", "On 2024-03-15 AB-1234 paid $500. Nothing here. AB-1234 paid $7!\nOn 2024-03-15  AB-1234 paid $500.")], "chunk_id string, content string")
    events = extraction.rule_events(chunks).orderBy("event_id").collect()
    assert [(r.event_id, r.amount, r.exact_identifiers) for r in events] == [("ev:c#0", "$500", ["AB-1234"]), ("ev:c#1", "$7", ["AB-1234"])]
    rows = spark.createDataFrame([(["a 1"], "3月15日", "in 3 月 15 日 a1 came"), (["b"], "", "none"), (None, None, "")], "i array<string>, t string, c string")
    assert [r.v for r in rows.select(extraction.verification(F.col("i"), F.col("t"), F.col("c")).alias("v")).collect()] == ["verified", "unverified", "verified"]
    rows = spark.createDataFrame([("陈锦标", "见 陈 锦标"), ("abcde", "xxabcdfyy"), ("abcde", "zzzz"), ("", "a")], "n string, c string")
    assert [r.v for r in rows.select(extraction.fuzzy_contains("n", "c").alias("v")).collect()] == [True, True, False, False]
    near = spark.createDataFrame([("e1", "money moved to account one"), ("e2", "money moved to account one"), ("e3", "something else entirely happened")], "event_id string, summary string")
    assert [tuple(r) for r in extraction.near_events(near).collect()] == [("e2", "e1", 0)]
    anchors = spark.createDataFrame([("n", "B", 1), ("n", "A", 2), ("m", "C", 3)], "name string, label string, seq long")
    known = spark.createDataFrame([("m", "Z")], "name string, label string")
    got = {r.name: (r.label, r.conflicts) for r in extraction.resolved_anchors(anchors, known, {"A": 1}, "kb").collect()}
    assert got == {"n": ("A", ["B"]), "m": ("Z", ["C"])}


def test_vectors(spark):
    r = spark.sql("SELECT array(3.0d, 4.0d) a, array(4.0d, 3.0d) b, array(0.0d, 0.0d) z").select(vx.cosine(F.col("a"), F.col("b")).alias("c"), vx.cosine(F.col("a"), F.col("z")).alias("z"), vx.unit(F.col("a")).alias("u")).first()
    assert (round(r.c, 9), r.z, r.u) == (0.96, 0.0, [0.6, 0.8])


def test_bm25(spark):
    chunks = spark.createDataFrame([(1, "apple " * 8, 0), (2, "apple pie", 1), (3, "pie and apple and more words here", 2), (4, "nothing", 3)], "id long, content string, pos long")
    queries = spark.createDataFrame([("q", ["Apple", "pie"]), ("none", ["zzz"]), ("empty", [])], "query_id string, terms array<string>")
    got = retrieval.bm25(chunks, queries).orderBy("rank").collect()
    assert {r.query_id for r in got} == {"q"} and got[0].score == 1.0 and got[0].id == 2 and {r.id for r in got} == {1, 2, 3}


def test_fusion_seeds_rerank(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    got = retrieval.fuse(a, b, 0.5).orderBy("rank").collect()
    assert [r.id for r in got] == ["y", "x", "z"] and abs(got[0].score - (1 / 62 + 0.5 / 61)) < 1e-12
    lists = [spark.createDataFrame(x, "id string, weight double, pos int") for x in ([("A", 0.9, 1), ("B", 0.8, 2)], [("B", 0.95, 1), ("C", 0.7, 2)])]
    assert [(r.id, r.weight) for r in retrieval.round_robin(*lists).orderBy("pos").collect()] == [("A", 0.9), ("B", 0.95), ("C", 0.7)]
    seeds = spark.createDataFrame([("a", 99.5), ("b", 0.5)], "id string, weight double")
    assert [r.id for r in retrieval.normalised_seeds(seeds).collect()] == ["a"]
    rows = spark.createDataFrame([("q", 1, 0.1, 0.2, True), ("q", 2, 0.2, 0.9, False), ("q", 3, 0.3, -1.0, False), ("q", 4, 0.4, -1.0, False)], "query_id string, id int, score double, rerank double, exact boolean")
    ordered = retrieval.rerank_order(rows).orderBy("rank").collect()
    assert [r.id for r in ordered] == [2, 1, 4, 3] and ordered[1].rerank == 0.85
    assert retrieval.least_rerank(rows, 0.5).count() == 4 and retrieval.least_rerank(rows.filter("rerank > 0"), 0.5).count() == 1


def test_budget_and_mmr(spark):
    rows = spark.createDataFrame([("q", 1, "a b c"), ("q", 2, "d e f g"), ("q", 3, "h")], "query_id string, rank int, content string")
    got = [r.content for r in retrieval.token_budget(rows, 5).orderBy("rank").collect()]
    assert got == ["a b c", "d e" + "\n..." + retrieval.OMITTED, retrieval.OMITTED]
    rows = spark.createDataFrame([("q", "a", 1.0, [1.0, 0.0]), ("q", "b", 0.99, [1.0, 0.01]), ("q", "c", 0.8, [0.0, 1.0]), ("q", "d", 0.1, None)], "query_id string, id string, score double, vector array<double>")
    assert [r.id for r in retrieval.mmr(rows, 2).orderBy("place").collect()] == ["a", "c"]


def test_metrics(spark):
    rows = spark.createDataFrame([("q", ["a", "b", "c"], ["a", "z"]), ("e", [], ["a"])], "query_id string, retrieved array<string>, gold array<string>")
    got = {r.query_id: r for r in evaluation.retrieval_metrics(rows).collect()}
    assert got["q"].recall_1 == 0.5 and got["q"].f1_1 == round(2 / 3, 6) and got["e"].recall_1 is None
    assert abs(got["q"].ndcg_3 - 1 / (1 + 1 / np.log2(3))) < 1e-6
    mean = evaluation.aggregate_metrics(evaluation.retrieval_metrics(rows)).first()
    assert mean.recall_1 == 0.25
    answers = spark.createDataFrame([], "score double")
    assert evaluation.overall_score(evaluation.retrieval_metrics(rows), answers).first().overall_score == 0.5


def test_event_links(spark):
    rows = [(1, "f", 0, 0, "2024-01-01 00:00:00", "x"), (2, "f", 1, None, "2024-01-01 01:00:00", "x "), (3, "f", 2, 0, "2024-01-16 00:00:00", "x"), (4, "g", 0, 0, None, "")]
    events = spark.createDataFrame(rows, "event_id long, file_id string, chunk_index int, span_start int, ts string, location string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((r.edge_type, r.src, r.dst) for r in event_links.event_links(events).collect())
    assert got == [("EVENT_LOCATION", 1, 2), ("EVENT_LOCATION", 1, 3), ("EVENT_LOCATION", 2, 3), ("EVENT_NEXT", 1, 2), ("EVENT_NEXT", 2, 3), ("EVENT_TEMPORAL", 1, 2)]
    assert event_links.event_links(events, 1).filter("src = 1").count() == 1
    assert event_links.event_links(events.limit(0)).count() == 0


def test_event_links_are_dealt_by_their_number(spark, monkeypatch):
    events = spark.range(400).selectExpr("id AS event_id", "concat('f', id % 40) AS file_id", "id AS chunk_index", "0 AS span_start", "timestamp_seconds(id * 60) AS ts", "concat('x', id % 2) AS location")
    told = lambda: event_links.event_links(events).withColumn("part", F.spark_partition_id()).collect()
    whole = told()
    monkeypatch.setattr(event_links, "ORDERED", 10)
    few = told()
    largest = max(sum(r.part == p for r in few) for p in {r.part for r in few})
    assert largest <= len(few) / 8 and sorted(str(r[:5]) for r in few) == sorted(str(r[:5]) for r in whole)


def test_beam_paths_keeps_links_dealt(spark, monkeypatch):
    from lodeseek.plans import registry

    dealt = []

    def seen(df, name, stage=graph_query.stage):
        if name == "hops":
            dealt.extend(r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect())
        return stage(df, name)

    want = registry.beam_paths(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(graph_query, "stage", seen)
    monkeypatch.setattr(event_links, "ORDERED", 50)
    assert registry.beam_paths(spark, "/root/testdata/sf0.001").collect() == want
    assert len(dealt) >= 16 and max(dealt) <= sum(dealt) / 8


def test_pagerank(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("c", "d", 1.0)]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((4, 4))
    for s, d, w in edges:
        m[names.index(d), names.index(s)] += w
    ends = m.sum(0) == 0
    m = m / np.where(ends, 1, m.sum(0))
    p = np.array([0.75, 0, 0.25, 0])
    x = p.copy()
    for _ in range(200):
        x = 0.85 * (m @ x + x[ends].sum() * p) + 0.15 * p
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    got = {r.node: r.score for r in graph_query.pagerank(df, spark.createDataFrame([("a", 3.0), ("c", 1.0)], "node string, p double"), tolerance=1e-9).collect()}
    assert np.allclose([got[n] for n in names], x, atol=1e-6)
    ranked = graph_query.rank_chunks(spark.createDataFrame(list(got.items()), "node string, score double"), spark.createDataFrame([("a",), ("d",)], "chunk_id string"), spark.createDataFrame([("b", "d")], "event_id string, chunk_id string"), 5).collect()
    assert [r.chunk_id for r in ranked] == ["a", "d"] and ranked[0].score == 1.0


def test_graph_weights_and_connectivity(spark):
    edges = [("c1", "e1", "MENTIONS", None, None), ("c1", "e2", "MENTIONS", None, None), ("c2", "e1", "MENTIONS", None, None), ("e1", "e2", "RELATION", None, None), ("c1", "v1", "CHUNK_EVENT", 0.2, None), ("v1", "v2", "EVENT_TEMPORAL", None, 43_200.0), ("v1", "e1", "EVENT_MENTIONS", None, None)]
    df = spark.createDataFrame(edges, "src string, dst string, edge_type string, value_weight double, delta_seconds double")
    got = {(r.src, r.dst): round(r.weight, 6) for r in graph_query.ppr_edges(df).collect()}
    assert got == {("c1", "e1"): 0.5, ("c1", "e2"): 0.5, ("c2", "e1"): 0.4, ("e1", "e2"): 1.0, ("c1", "v1"): 0.22, ("v1", "v2"): 0.25, ("v1", "e1"): 0.6}
    nodes = spark.createDataFrame([("c1", "chunk"), ("c2", "chunk"), ("e1", "entity"), ("e2", "entity"), ("e3", "entity"), ("v1", "event"), ("v2", "event")], "node string, type string")
    m = graph_query.connectivity(nodes, df.select("src", "dst", "edge_type")).first()
    assert (m.orphan_rate, round(m.lcc_ratio, 6), m.anchor_reuse, m.zero_anchor_rate, m.avg_degree) == (0.2, round(6 / 7, 6), 2.0, 0.5, 2.0)
    failed = {r.metric for r in graph_query.gate(graph_query.connectivity(nodes, df.select("src", "dst", "edge_type"))).collect()}
    assert failed == {"orphan_rate", "lcc_ratio", "zero_anchor_rate"}


def test_beam(spark):
    hops = [("s", "a", "NEXT", 1.0, 0.1, True), ("s", "b", "MENTIONS", 0.9, 0.1, True), ("a", "c", "TEMPORAL", 0.5, 0.5, True), ("c", "s", "NEXT", 1.0, 0.9, True), ("a", "d", "MENTIONS", 1.0, 1.0, False)]
    df = spark.createDataFrame(hops, "src string, dst string, edge_type string, strength double, value_weight double, coherent boolean")
    got = graph_query.event_paths(spark.createDataFrame([("s", 0.9)], "id string, sim double"), df).collect()
    assert [r.path for r in got] == [["s", "a", "c"]] and got[0].score == round(0.3 + 0.02 + 0.15 + 0.1, 6) and got[0].coherence == 0.75


def test_implicit(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, 16))
    m = np.vstack([c + rng.normal(scale=0.05, size=(20, 16)) for c in centres])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    near = implicit_graph.nearest(df, k=5, block=16)
    sims = m @ m.T
    np.fill_diagonal(sims, -1)
    want = {(i, int(j)) for i in range(80) for j in np.argsort(-sims[i], kind="stable")[:5] if sims[i, j] > 0.55}
    assert {(r.u, r.v) for r in near.collect()} == want
    edges = implicit_graph.similar_edges(near)
    assert {(r.u, r.v) for r in edges.collect()} == {(a, b) for a, b in want if a < b and (b, a) in want}
    p = implicit_graph.personalization(spark.createDataFrame([("a", 0.9), ("b", 0.1)], "node string, cosine double"), spark.createDataFrame([("b", 2.0)], "node string, weight double"))
    assert abs(sum(r.p for r in p.collect()) - 1) < 1e-12


def test_pool_and_explanations(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "id long, vector array<double>")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = implicit_graph.anchor_pool(vectors, seeds, [0.0, 1.0], nearest_k=1, top_m=1).collect()
    assert [(r.id, r.tier) for r in got] == [(1, 0), (2, 1), (3, 2)]
    assert [r.id for r in implicit_graph.anchor_pool(vectors, seeds, [0.0, 1.0], 1, 1, cap=1).collect()] == [1]
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5), ("a", "d", 0.1)], "u string, v string, weight double")
    told = lambda rows, name: spark.createDataFrame(rows, f"node string, {name} double")
    paths = implicit_graph.explanations(edges, told([("a", 1.0)], "weight"), told([("b", 1.0)], "score"), told([("c", 1.0)], "cosine")).collect()
    assert [(r.path, round(r.score, 6)) for r in paths] == [(["a", "b", "c"], 2.15), (["a", "b"], 1.5), (["a", "d"], 1.03)]


def test_store(spark):
    old = spark.createDataFrame([("e", "n", "n", "L", "one", ["x"])], "entity_id string, name string, normalized_name string, label string, description string, attributes array<string>")
    new = spark.createDataFrame([("e", "N", "n2", "M", "two", ["y", "x"]), ("f", "f", "f", "F", None, None)], old.schema)
    got = {r.entity_id: r for r in store.upsert_entities(old, new).collect()}
    assert (got["e"].label, got["e"].name, got["e"].description, got["e"].attributes) == ("L", "N", "one<SEP>two", ["x", "y"]) and got["f"].description == ""
    docs = spark.createDataFrame([(1, "a\nhit\nb\nc\nd\nhit\nhit")], "id long, content string")
    got = [(r.first_line, r.last_line, r.total_matches) for r in store.find_windows(docs, "HIT", 1, 5).collect()]
    assert got == [(1, 3, 3), (5, 7, 3)]
    assert store.find_windows(docs, "h.t", 0, 1, regex=True).first().text == "hit"
    rel = spark.createDataFrame([("a", ["f", "g"]), ("b", ["f"])], "src string, file_ids array<string>")
    assert [(r.src, r.file_ids) for r in store.drop_file_from_relations(rel, "f").collect()] == [("a", ["g"])]
    files_ = spark.createDataFrame([("x", "new"), ("y", "done")], "file_id string, status string")
    assert {r.file_id: r.status for r in store.update_if_status(files_, "file_id", "x", ["new"], status="run").collect()} == {"x": "run", "y": "done"}


def test_chunking(spark):
    assert chunking.hard_split("a b c d e", 2) == ["a b ", "c d ", "e"]
    assert chunking.separator("one two\n\nthree", 10) == ["one two", "three"]
    assert chunking.qa("Q: what?\nA: that\nmore\nQ: who?\nA: me\nQ: who?\nA: me") == ["what?\nthat\nmore", "who?\nme"]
    assert chunking.qa("x\ny\nz") == ["x\ny"]
    assert chunking.sections("# A\ntext\n## B\nmore\n```\n# no\n```\n# C\nend") == ["A\ntext", "A → B\nmore\n```\n# no\n```", "C\nend"]
    assert len(chunking.laws("intro\nArticle 1 a\nb\nArticle 2 c")) == 3
    long = "\n".join(f"line {i} of words" for i in range(200))
    parts = chunking.general(long, 50, 0.15)
    assert all(chunking.count_tokens(p) <= 50 for p in parts) and all(f"line {i} of words" in "\n".join(parts) for i in range(200))
    docs = spark.createDataFrame([("f", long), ("g", None), ("h", "")], "file_id string, content string")
    rows = chunking.chunk(docs, "separator", size=100, delimiter="\n").collect()
    assert len(rows) == 200 and all(long[r.start : r.stop] == r.content for r in rows)
    turns = spark.createDataFrame([(1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "q2")], "conv_id long, turn long, role string, text string")
    assert [(r.question, r.answer) for r in chunking.qa_pairs(turns).collect()] == [("q", "a")]


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def test_parsers(spark, tmp_path):
    page = "<html><style>x</style><h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>one<li>two</ul><table><tr><th rowspan=2>k<th>v<tr><td>1|2</table></html>"
    assert files.html_markdown(page) == "# T\n\na **b** [l](u)\n\n* one\n* two\n\n| k | v |\n| --- | --- |\n| k | 1\\|2 |"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    made = {
        "a.txt": "中文".encode("gbk"),
        "b.json": b'{"k": "\xc3\xa9"}',
        "c.csv": b"h1,h2\n1,2\n\n3,4\n",
        "d.docx": _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:document>'}),
        "e.zip": _zip({"ok.md": "inside", "../bad.md": "outside", "x.bin": "no"}),
        "f.bin": b"?",
        "g.json": b"{",
        "h.pptx": _zip({f"ppt/slides/slide{i}.xml": f'<a xmlns:a="x"><a:p><a:t>s{i}</a:t></a:p></a>' for i in (10, 2)}),
        "i.xlsx": _zip({"xl/workbook.xml": '<w xmlns="m"><sheet name="S"/></w>', "xl/sharedStrings.xml": '<s xmlns="m"><si><t>head</t></si></s>', "xl/worksheets/sheet1.xml": '<w xmlns="m"><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row></w>'}),
    }
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.txt"].markdown == "中文" and got["b.json"].markdown == '{\n  "k": "é"\n}'
    assert got["c.csv"].markdown == "| h1 | h2 |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
    assert got["d.docx"].markdown == "one\n\ntwo" and got["e.zip"].markdown == "inside"
    assert got["f.bin"].error.startswith("ValueError") and got["g.json"].error
    assert got["h.pptx"].markdown == "## Slide 1\n\ns2\n\n## Slide 2\n\ns10"
    assert got["i.xlsx"].markdown == "## S\n\n| head |  | 7 |\n| --- | --- | --- |"


def test_eval_items(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"query": "q", "gold_chunk_ids": ["a"]}\n\n{bad\n{"gold_answer": "x"}\n')
    got = [(r.line_number, r.query, r.error) for r in files.read_eval_jsonl(spark, str(tmp_path / "i.jsonl")).collect()]
    assert got == [(1, "q", None), (3, None, "not a JSON object"), (4, None, "query is missing")]


def test_streams(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = streams.run_once(streams.sessions(streams.read_events(spark, path)), "sessions", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(path).count()


def test_rule_events_of_a_long_document(spark, tmp_path):
    from lodeseek.plans import registry

    lines = [f"On 2024-03-15 AB-{1000 + i} paid ${i}. " + "filler " * 1100 for i in range(12)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "AB-7777 paid $3.")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.QUERIES["rule_events"](spark, str(tmp_path)).collect()
    assert {x for r in rows for x in r.exact_identifiers} == {f"AB-{1000 + i}" for i in range(12)} | {"AB-7777"}
    assert {r.verification for r in rows} == {"verified"} and len({r.event_id for r in rows}) == len(rows) == 13


def test_more_queries_than_a_batch(spark, monkeypatch):
    from lodeseek.plans import registry

    vectors = registry._vectors(spark, "/root/testdata/sf0.001").limit(60).localCheckpoint()
    asked = vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    told = lambda: sorted(tuple(r) for r in retrieval.dense_top_k(vectors, asked, 3).collect())
    whole = told()
    monkeypatch.setattr(retrieval, "BATCH", 25)
    assert told() == whole and len({r[0] for r in whole}) == 60


def test_close_hashes_by_blocks(spark):
    rng = np.random.default_rng(3)
    # twelve bits vary, so the others, in which a bucket agrees, are the same for all
    low = [int(x) for x in rng.choice(1 << 12, 300, replace=False)]
    hashes = [(f"e{i:03d}", x - (1 << 62)) for i, x in enumerate(low)]
    want = sorted((a, b, (x ^ y).bit_count()) for i, (a, x) in enumerate(hashes) for b, y in hashes[i + 1 :] if (x ^ y).bit_count() <= 3)
    df = spark.createDataFrame(hashes, "id string, h long")
    for block in (1000, 64):
        found = pairs.close_hashes(df, 3, block)
        got = [(*sorted((r.a, r.b)), r.distance) for r in found.collect()]
        assert sorted(got) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan  # buckets of equal bits, joined, hold more rows than there are pairs to compare


def test_exact_sum_does_not_depend_on_order(spark):
    rows = [("a", 0.1), ("a", 0.2), ("a", 0.3), ("b", 0.3), ("b", 0.2), ("b", 0.1), ("c", 1e300), ("c", None), ("d", None), ("e", float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double").coalesce(1)
    got = {r.k: r.s for r in df.groupBy("k").agg(registry.exact_sum("x").alias("s")).collect()}
    assert got == {"a": 0.6, "b": 0.6, "c": 1e300, "d": None, "e": float("inf")}


def test_texts_go_through_python_in_slices(spark, monkeypatch):
    # no step may turn more than a slice of a batch into objects
    most = {"n": 0}
    batch = pa.RecordBatch.from_pydict({"file_id": [str(i) for i in range(400)], "content": ["word " * 4000] * 400})
    for part in tx.slices(iter([batch]), "content"):
        most["n"] = max(most["n"], part.column("content").nbytes)
    assert 1 << 20 < most["n"] <= tx.SLICE
    seen = []
    monkeypatch.setitem(chunking.PRESETS, "laws", lambda text, **_: seen.append(1) or [text])
    held = {}
    fake = type("Docs", (), {"select": lambda self, *c: self, "mapInArrow": lambda self, run, schema: held.update(run=run)})()
    chunking.chunk(fake, "laws")
    first = next(held["run"](iter([batch])))
    assert first.num_rows == len(seen) < 400 and first.schema.names == [x.split()[0] for x in chunking.SCHEMA.split(", ")]


@pytest.mark.parametrize("asked, searched", [(7, 11), (50, 4000), (None, None)])
def test_best_pairs_score_as_sql_does(spark, asked, searched):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 24)).astype(np.float32)
    m[20:40] = m[0]  # ties, which go by id
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(100, None), (101, [1.0]), (102, [None] * 24), (103, [float("nan")] * 24), (104, [float("inf")] * 24)]

    def told(rows, others, over, threshold):
        df = spark.createDataFrame(rows, "id long, vector array<float>")
        left = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
        scored = df.join(left, F.col("id") != F.col("query_id") if others else F.lit(True)).withColumn("score", vx.dot(F.col("vector"), F.col("query")))
        want = retrieval.ranked(scored.filter(F.col("score") > threshold if over else F.col("score") >= threshold), [F.col("score").desc(), "id"], 5)
        found = pairs.best_pairs(df, left, 5, threshold, over, others, asked, searched)
        got = retrieval.ranked(found, [F.col("score").desc(), "id"], 5)
        return [sorted((r.query_id, r.rank, r.id, str(r.score)) for r in x.collect()) for x in (got, want)]

    for case in ((rows[:60], True, True, 0.25), (rows, False, False, 0.0), (rows[:63], False, False, -1.0)):
        got, want = told(*case)
        assert got == want and len(got) > 200


def test_best_pairs_do_not_pair_rows_in_the_plan(spark):
    vectors = registry._vectors(spark, "/root/testdata/sf0.001")
    plan = retrieval.dense_top_k(vectors, vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
