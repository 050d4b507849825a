import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodeseek.llm import setsketch as op
from lodeseek.llm import buckets, shingles, union_find


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    sets = [set_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(s), str(d if not s else least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def near_rows(n, seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6))) for _ in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(30, 200))] for _ in range(12)]
    rows = []
    for i in range(n):
        text = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(vocab) for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.randrange(0, 8)):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "  ", "\n", "\t"]).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in text)))
    return rows


def test_sets():
    rows = near_rows(60, 3) + [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "one two"), (5, "x" * 50_000)]
    for k in (1, 3, 5):
        texts = pa.array([t for _, t in rows])
        got = shingles.shingle_sets(texts, k)
        assert [len(x) for x in got] == [len(set_of(t, k)) for _, t in rows]
        for i in range(0, 60, 7):
            want = set_of(rows[i][1], k)
            assert [len(np.intersect1d(got[i], g)) for g in got] == [len(want & set_of(t, k)) for _, t in rows]
        for a, b in zip(shingles.shingle_sets(texts.slice(5, 9), k), got[5:14]):
            assert (a == b).all()


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[100:2100])
    x, y, z = op.registers([a, b, np.union1d(a, b)])
    assert (op.merge(x, y) == z).all()
    n = np.array([2000.0])
    far = op.registers([np.unique(pool[2000:])])
    assert op.likely(x[None], y[None], n, n, 0.85).all() and not op.likely(x[None], far, n, n / 2, 0.4).any()


@pytest.mark.parametrize("k, percent, block", [(3, 85, 256), (5, 80, 7)])
def test_equals_brute_force(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(buckets, "BLOCK", block)
    rows = near_rows(300, k) + [(1000, None), (1001, ""), (1002, "one"), (1003, "One"), (None, "lone text of no id"), (7, near_rows(300, k)[7][1])]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, n int, key string").repartition(4)
    got = op.near_duplicates(docs, k, percent / 100).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows, k, percent)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dropping_rows(spark):
    """Repeated and missing ids, ids that are no numbers, clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [("b", base), ("a", base + " more"), (None, base), ("z", "one of its own"), ("a", "an unlike text that has the id of another"), (None, None), ("e", ""), ("e", "")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id string, text string, gone int, row int").repartition(3)
    got = op.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(d), str(t)) for d, t in [rows[1], *rows[3:]])
    assert op.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    root = {}
    for a, b in links:
        root.setdefault(a, {a}), root.setdefault(b, {b})
        if root[a] is not root[b]:
            both = root[a] | root[b]
            root |= dict.fromkeys(both, both)
    got = {r.node: r.component for r in union_find.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: min(s) for n, s in root.items() if len(s) > 1}
