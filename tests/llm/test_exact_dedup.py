import hashlib

import pytest

from lodeseek.llm import exact_dedup as op


def brute(rows):
    best, size = {}, {}
    for doc_id, text in rows:
        key = text or ""
        size[key] = size.get(key, 0) + 1
        if key not in best or (doc_id is not None and (best[key] is None or doc_id > best[key])):
            best[key] = doc_id
    return sorted((str(d), str(best[t or ""]), size[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows)


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "c"), (6, "x" * 200_000), (7, "x" * 200_000), (None, "d"), (8, "d")] + [(100 + i, "hot") for i in range(300)]


@pytest.mark.parametrize("phi", [1 / 2048, 0.5])
def test_report(spark, phi):
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in ROWS], "doc_id long, text string, digest int, row string").repartition(5)
    got = op.exact_dedup(docs, phi=phi).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, bytes(r.digest).hex()) for r in got) == brute(ROWS)
    assert sum(r.kept for r in got) == len({t or "" for _, t in ROWS})
    kept = op.drop_exact_copies(docs, phi=phi)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.exact_dedup(docs).count() == 0
    assert op.drop_exact_copies(docs).count() == 0


def test_misra_gries_bound():
    import pyarrow as pa

    values = [b"h"] * 400 + [str(i).encode() for i in range(600)]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i::7], pa.binary())], ["d"]) for i in range(7)]
    out = next(op.misra_gries(iter(batches), 9)).to_pydict()
    found = dict(zip(out["digest"], out["n"]))
    assert len(found) <= 9 and 400 - 1000 / 10 <= found[b"h"] <= 400
