import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from lodeseek.llm import line_dedup as op


def grams(line):
    own = op.form(line.encode())
    return {own[i : i + op.SHINGLE] for i in range(len(own) - op.SHINGLE + 1)} if len(own) >= op.LEAST else None


def brute(rows, similarity):
    lines = [(i, j, grams(x)) for i, (_, t) in enumerate(rows) if t is not None for j, x in enumerate(t.split("\n"))]
    able = [x for x in lines if x[2]]
    root = list(range(len(able)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(able)):
        for b in range(a):
            x, y = able[a][2], able[b][2]
            if len(x & y) >= similarity * len(x | y):
                root[find(a)] = find(b)
    best = {}
    for k, (i, j, _) in enumerate(able):
        place = (rows[i][0] is not None, rows[i][0] or 0, j, i)
        best[find(k)] = min(best.get(find(k), place), place)
    gone = {(i, j) for k, (i, j, _) in enumerate(able) if best[find(k)] != (rows[i][0] is not None, rows[i][0] or 0, j, i)}
    return [None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone) for i, (_, t) in enumerate(rows)], gone


def test_equals_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(6, 30))) for _ in range(15)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = rng.choice(base).split() if rng.random() < 0.5 else [rng.choice(vocab) for _ in range(rng.randrange(1, 25))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = rng.choice(vocab)
            lines.append(" ".join(words).title() if rng.random() < 0.2 else "  ".join(words))
        rows.append((i, "\n".join(lines)))
    rows += [(200, None), (201, ""), (202, "short\nshort\n\n"), (None, base[0]), (203, ("y" * 30_000) + "\n" + "y" * 30_000), (204, "Call 123-4567 now, ask for room 12\ncall 999-0000 now, ask for room 77")]
    docs = spark.createDataFrame([(*r, k, "n") for k, r in enumerate(rows)], "doc_id long, text string, k int, row string").repartition(4)
    got = {r.k: r for r in op.drop_similar_lines(docs).collect()}
    want, gone = brute(rows, op.SIMILARITY)
    assert len(got) == len(rows)
    for k, text in enumerate(want):
        assert got[k].text == text and got[k].n_dropped == sum(i == k for i, _ in gone)
        assert got[k].n_lines == (0 if rows[k][1] is None else rows[k][1].count("\n") + 1)


def test_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a line of some length that repeats")] * 5, "doc_id long, text string")
    assert sorted(r.text for r in op.drop_similar_lines(docs).collect()) == [""] * 4 + ["a line of some length that repeats"]
    assert op.drop_similar_lines(docs.limit(0)).count() == 0


def test_lines_that_differ_in_their_numbers_stay(spark):
    rows = [(i, f"2019-01-{10 + 7 * i} {3 * i + 10}:{41 - 5 * i}:{50 - 9 * i} {17 + 11 * i}.{i} {82 - 13 * i}.8 {1013 + 987 * i}") for i in range(4)]
    much = "the same long sentence stands in both of these documents, but for its page number, which is "
    docs = spark.createDataFrame([*rows, (10, much + "17"), (11, much + "18")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in op.drop_similar_lines(docs).collect()}
    assert got == {**dict(rows), 10: much + "17", 11: ""}


def test_query_settles_short_lines(spark, tmp_path):
    from lodeseek.llm.queries import op4_line_dedup

    texts = {1: "Read more\n\n}\nalone", 2: "read  MORE\n\n}\ncookie setting here", 3: "}\nRead more!\n \ncookie setting hero", 4: "Read more", 5: "}"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_dropped) for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    # 'read more!' shares one shingle of two with 'read more', 'cookie setting hero' ten of twelve with the other
    assert got == {1: (texts[1], 0), 2: ("\ncookie setting here", 2), 3: ("Read more!\n ", 2), 4: ("", 1), 5: ("", 1)}


class _Rows:
    """Stands for a DataFrame: gives the function that a task runs."""

    def mapInArrow(self, run, schema):
        return run


def test_blocks_of_long_lines_are_compared_in_bounded_memory():
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, 600_000, np.uint8).tobytes() for _ in range(10)]
    asking, others = texts[:8], [texts[8], b"of " + texts[7], texts[9], texts[2][:-9], texts[0][:500_000], texts[0][:400_000], texts[2] + b" more", texts[5][1:]]
    name = lambda side, i: f"{side}{i}".encode()
    x, y = ([{"key": name(s, i), "form": t, "c": name(s, i)} for i, t in enumerate(own)] for s, own in (("x", asking), ("y", others)))
    kind = pa.list_(pa.struct([("key", pa.binary()), ("form", pa.binary()), ("c", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([x], kind), pa.array([y], kind)], ["askers", "others"])
    del x, y
    tracemalloc.start()
    got = {(r["a"], r["b"]) for out in op._compared(_Rows(), 80)(iter([batch])) for r in out.to_pylist()}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(name("x", i), name("y", j)) for i, j in ((0, 4), (2, 3), (2, 6), (5, 7), (7, 1))}
    assert peak < 120e6, peak


class _Blocks:
    """Takes the place of a table of blocks, to run what its tasks run."""

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_small_blocks_are_described_together(monkeypatch):
    rng = random.Random(5)
    side = pa.list_(pa.struct([("key", pa.binary()), ("form", pa.binary()), ("c", pa.binary())]))
    own, blocks = lambda k, form: {"key": b"%d" % k, "form": form, "c": b"%d" % k}, []
    for k in range(0, 600, 6):
        form = bytes(rng.choices(b"abcdefghij", k=rng.randrange(20, 300)))
        others = [own(k, form), own(k + 1, form[:-1]), own(k + 2, form[5:]), own(k + 3, b"x" + form[:-2] + b"yz"), own(k + 4, form[: len(form) // 2]), own(k + 5, b"short")]
        blocks.append((others[1:], others))
    blocks.insert(3, ([own(700, b"ab" * 50_000)], [own(701, b"ab" * 50_000), own(702, b"ba" * 50_000)]))
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in blocks], side), pa.array([y for _, y in blocks], side)], ["askers", "others"])

    def parts():
        calls, sets = [], op._sets
        monkeypatch.setattr(op, "_sets", lambda forms: calls.append(len(forms)) or sets(forms))
        links = [tuple(r.values()) for out in op._compared(_Blocks(), 80).run(iter([batch.slice(1)])) for r in out.to_pylist()]
        monkeypatch.setattr(op, "_sets", sets)
        root = {}
        find = lambda x: x if root.get(x, x) == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return {b"%d" % k: find(b"%d" % k) for k in range(703)}, len(calls)

    together, few = parts()
    monkeypatch.setattr(op, "PAIRED", 0, raising=False)
    alone, many = parts()
    classes = lambda found: {frozenset(k for k in found if found[k] == c) for c in found.values()}
    assert classes(together) == classes(alone) and len(classes(alone)) < 600
    assert few < 20 < many


def test_no_text_is_sorted(spark):
    docs = spark.createDataFrame([(k, f"the very same line of text\nanother line of text, number {k * 7919}") for k in range(50)], "doc_id long, text string")
    out = op.drop_similar_lines(docs)
    assert out.agg({"n_dropped": "sum"}).first()[0] >= 49
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "strategy=shuffle_hash" in plan


def test_classes_are_those_that_matter(spark):
    rng = random.Random(6)
    key = lambda k: hashlib.blake2b(str(k).encode(), digest_size=16).digest()
    h = lambda k: int.from_bytes(key(k)[:8], "little", signed=True)
    rows = [(rng.choice([key(-1), key(-2)]), rng.choice([None, rng.randrange(-20, 20)]), rng.randrange(5), key(min(rng.randrange(400), rng.randrange(400)))) for _ in range(900)]
    rows += [(key(-3), 3, k, key(7)) for k in range(5000)]  # one line is frequent
    lines = spark.createDataFrame(rows, "rk binary, doc_id long, line int, key binary").repartition(4)
    shared = spark.createDataFrame([(h(k),) for k in range(0, 400, 2)] * 2, "key long")
    got = {bytes(r.key): r for r in op._classes(lines, shared).collect()}
    held = {}
    for rk, doc, line, own in rows:
        held.setdefault(own, []).append((doc is not None, doc or 0, line, rk))
    needed = {own for own, x in held.items() if len(x) > 1} | {key(k) for k in range(0, 400, 2)} & held.keys()
    assert needed <= got.keys() <= held.keys() and len(got) < len(held)
    for own, r in got.items():
        told, doc, line, rk = min(held[own])
        assert (r.h, r.n) == (int.from_bytes(own[:8], "little", signed=True), len(held[own]))
        assert (r["first"].doc_id, r["first"].line, bytes(r["first"].rk)) == (doc if told else None, line, rk)
