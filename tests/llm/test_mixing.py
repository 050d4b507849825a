import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

from lodeseek.llm import mixing as op


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, got, open_ = Fraction(sum(sizes.values())), {}, set(sizes)
    while True:
        w = sum(weight[s] for s in open_)
        share = {s: total * weight[s] / w for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return got | share
        got |= {s: Fraction(3 * sizes[s]) for s in over}
        total -= sum(3 * sizes[s] for s in over)
        open_ -= over


def brute(rows):
    size = [len(re.findall("[^\x20\x09-\x0d]+", t or "")) for _, t, _ in rows]
    sizes = defaultdict(int)
    for (_, _, s), n in zip(rows, size):
        sizes[s] += n
    target = brute_targets(sizes)
    out = {}
    for s in sizes:
        rest = float(target[s]) - (whole := min(3, int(target[s] // sizes[s]))) * sizes[s] if sizes[s] else (whole := 0)
        order = []
        for (d, t, s2), n in zip(rows, size):
            if s2 == s:
                u = (int(hashlib.md5(f"{'' if d is None else d}|{op.SEED}|{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append((u, d, n))
        passed = 0
        for u, d, n in sorted(order):
            out[d] = (n, sizes[s], float(target[s]), n * (whole + (rest > 0 and passed + n / 2 <= rest)))
            passed += n
    return out


def docs_of(n, seed):
    rng = random.Random(seed)
    kinds = ["b", "a", "é", "𝄞", None, "hot", "tiny", "nil"]
    rows = []
    for i in range(n):
        source = rng.choice(kinds + ["hot"] * 5)
        words = 0 if source == "nil" else min(3000, int(rng.paretovariate(1.2)))
        rows.append((i, None if i % 50 == 0 else " \n".join("w" * rng.randrange(1, 5) for _ in range(words)), source))
    return rows


def test_equals_brute_force(spark):
    for n in (3, 40, 3000):
        rows = docs_of(n, n)
        rows = [r for r in rows if r[2] != "tiny"] + [(10**6, "one", "tiny")]
        docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, size int").repartition(3)
        got = {r.doc_id: r for r in op.mix_report(docs).collect()}
        want = brute(rows)
        assert got.keys() == want.keys()
        taken = Counter()
        for d, (size, source_size, target, words) in want.items():
            r = got[d]
            assert (r.size, r.source_size, r.taken) == (size, source_size, words) and abs(r.target - target) < 1e-6 * max(1, target)
        mixed = op.mix_documents(docs)
        assert mixed.columns == docs.columns
        taken.update(r.doc_id for r in mixed.select("doc_id").collect())
        assert all(taken[d] * r.size == r.taken and taken[d] <= 3 for d, r in got.items())


def test_near_target_and_preference(spark):
    rows = docs_of(3000, 9)
    docs = spark.createDataFrame([(*r, float(r[0] % 2)) for r in rows], "doc_id long, text string, source string, liked double")
    for options in ({}, {"preference": "liked"}):
        by = defaultdict(lambda: [0, 0, 0])
        for r in op.mix_report(docs, **options).collect():
            x = by[r.target, r.source_size]
            x[0], x[1] = x[0] + r.taken, max(x[1], r.size)
            assert r.taken <= 3 * r.size
        assert all(abs(got - target) <= biggest for (target, _), (got, biggest, _) in by.items())


def test_edge_tables(spark):
    schema = "doc_id long, text string, source string"
    assert op.mix_report(spark.createDataFrame([], schema)).count() == 0
    assert op.mix_documents(spark.createDataFrame([], schema)).count() == 0
    only = [(1, None, None), (None, "", "a"), (None, "x y", "a"), (None, "x y", "a")]
    got = op.mix_report(spark.createDataFrame(only, schema)).collect()
    assert len(got) == 4 and sum(r.taken for r in got) == 4
