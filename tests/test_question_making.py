import random

import numpy as np
from pyspark.sql import functions as F

from lodeseek.operators import graph_query
from lodeseek.operators import question_making as qm


def test_specific(spark):
    said = ["", None, "  ", "被讯问人叫什么?", "Who is it?", "in 2024?", "祥园路在哪", "何时", "张三是谁", "②"]
    rows = spark.createDataFrame(list(enumerate(said)), "i int, q string").select("i", qm.specific(F.col("q")).alias("s")).orderBy("i").collect()
    assert [r.s for r in rows] == [False, False, False, False, False, True, True, True, True, True]


def test_told_apart(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["A b", "a B", "c", "d ", " ", None, "e"]) and f"{rng.choice(['Q', 'q '])}{rng.randrange(30)}", rng.sample(["x", "y", "z", "w"], rng.randrange(1, 4)) if i % 9 else None) for i in range(120)]
    rows += [(120, " ", ["n"]), (121, None, ["n"]), (122, "new", ["z", "w", "q"]), (123, "NEW", ["v"])]
    seen_q, seen_g, want = set(), set(), []
    for i, q, g in rows:
        key, gold = "".join((q or "").split()).lower(), frozenset(g or [])
        if key and key not in seen_q and gold not in seen_g:
            seen_q.add(key), seen_g.add(gold), want.append(i)
    df = spark.createDataFrame(rows, "attempt int, query string, gold_chunk_ids array<string>")
    assert sorted(r.attempt for r in qm.told_apart(df).collect()) == want
    assert [r.attempt for r in qm.told_apart(df, 3).orderBy("attempt").collect()] == want[:3]
    assert qm.told_apart(df.limit(0)).count() == 0


def _brute(edges, reset, damping=0.85, rounds=15):
    nodes = sorted({x for e in edges for x in e[:2]} | set(reset))
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[at[b], at[a]] = w
    out = m.sum(0)
    p = np.array([reset.get(n, 0.0) for n in nodes])
    p /= p.sum()
    r = p.copy()
    for _ in range(rounds):
        r = damping * (m @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() * p) + (1 - damping) * p
    return dict(zip(nodes, r))


def test_pagerank_batch(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "a", 1.0), ("d", "a", 1.0)]
    reset = {"q1": {"a": 2.0, "d": 1.0}, "q2": {"b": 1.0}, "q3": {"alone": 1.0}}
    rows = [(q, n, p) for q, own in reset.items() for n, p in own.items()] + [("q4", "a", 0.0)]
    got = graph_query.pagerank_batch(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame(rows, "query_id string, node string, p double"), iterations=15, tolerance=1e-9).collect()
    assert {r.query_id for r in got} == set(reset)
    for q, own in reset.items():
        want = {n: s for n, s in _brute(edges, own).items() if s > 0}
        mine = {r.node: r.score for r in got if r.query_id == q}
        assert mine.keys() == want.keys() and all(abs(mine[n] - want[n]) < 1e-4 for n in want)


def test_graph_context(spark):
    held = [("c1", "e1"), ("c2", "e1"), ("c2", "e2"), ("c3", "e2"), ("c4", "e9")]
    mentions = spark.createDataFrame(held, "chunk_id string, entity_id string")
    edges = mentions.select(F.col("chunk_id").alias("src"), F.col("entity_id").alias("dst"), F.lit(1.0).alias("weight"))
    got = qm.graph_context(edges, mentions, "c1", 3, iterations=10).collect()
    assert {(r.chunk_id, r.round) for r in got} == {("c1", 0), ("c2", 1), ("c3", 2)}
    assert qm.graph_context(edges, mentions, "c4", 2, iterations=5).count() == 0 and qm.graph_context(edges, mentions, "none", 2).count() == 0
