"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of n-grams of all orders, and a uniform one, are mixed; the weights depend on how
often the context was seen (one bucket for each power of two) and are learned by expectation-maximisation on
counts held out from training: the estimates seen by EM leave those documents out, the final ones take them in.

Work goes in chunks of about a million tokens. A chunk sends each of its distinct n-grams once, as sorted 64-bit
hashes with its own counts, to the part that owns the hash; the part adds up the counts of all chunks and sends
every chunk the totals of what it asked for. A frequent n-gram is one entry per chunk, so no key is hot, and no
table of counts is collected or broadcast. EM runs on the driver over cells of held-out counts (bucket by
quantised estimates), whose number is bounded by the quantisation and not by the corpus.

Defined cases: A-Z count as a-z; a null or empty text has the end token only; a null id has remainder 0, so it
trains; equal rows count and score alike; with nothing to train on every token has the uniform estimate; an empty
table gives no rows; other columns play no part. Two n-grams with one 64-bit hash would share their count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm.bpe import slices
from lodeseek.llm.shingles import mix64, word_hashes
from lodeseek.plans.staging import discard, stage

ORDER = 2
CHUNK_TOKENS = 1 << 21
#: Tokens per part, which bounds what one part adds up.
PART_TOKENS = 1 << 21
#: Steps of estimates in EM's cells, per power of two.
STEPS = 8
ROUNDS = 40
SLICE = 1_000_000
#: Remainders of crc32(id) by 7: not learned from; learned from, but held out from what EM's estimates count.
MODULUS, HELD_OUT, TUNING = 7, 2, 3
_END = np.uint64(0x243F6A8885A308D3)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _squeeze(values: np.ndarray) -> bytes:
    """Integers by byte planes, compressed."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True) if len(values) else b""


def _swell(data: bytes, kind: type) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def remainder(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(MODULUS)), F.lit(0)).cast("int")


_CHUNK = "chunk long, doc_ids binary, nulls binary, lens binary, kinds binary, tokens binary, words binary, n_tokens long, train_tokens long, fit_tokens long, train_docs long, fit_docs long"


def _chunks(docs: DataFrame, id_col: str, text_col: str, chunk_tokens: int) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), remainder(F.col(f"`{id_col}`")).alias("r"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        number = TaskContext.get().partitionId() << 32

        def chunk() -> pa.RecordBatch:
            nonlocal number
            ids, nulls, kinds, lens, tokens = (np.concatenate(x) for x in zip(*held))
            held.clear()
            words, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            by_count = np.argsort(-counts, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[by_count] = np.arange(len(words), dtype=np.uint32)
            row = [number, _squeeze(ids), _squeeze(nulls), _squeeze(lens), _squeeze(kinds), _squeeze(rank[inverse]), _squeeze(words[by_count]), int(lens.sum()), int(lens[kinds != HELD_OUT].sum()), int(lens[(kinds != HELD_OUT) & (kinds != TUNING)].sum()), int((kinds != HELD_OUT).sum()), int(((kinds != HELD_OUT) & (kinds != TUNING)).sum())]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], [x.split()[0] for x in _CHUNK.split(", ")])

        size = 0
        for batch in slices(batches, "text", SLICE):
            hashes, at = word_hashes(batch.column("text"))
            n = batch.num_rows
            lens = np.diff(at) + 1
            tokens = np.empty(len(hashes) + n, np.uint64)
            ends = np.cumsum(lens) - 1
            inside = np.ones(len(tokens), bool)
            inside[ends] = False
            tokens[inside] = hashes
            tokens[ends] = _END
            ids = batch.column("doc_id")
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()).astype(np.uint8), batch.column("r").to_numpy().astype(np.uint8), lens.astype(np.uint32), tokens))
            size += len(tokens)
            if size >= chunk_tokens:
                yield chunk()
                size = 0
        if held:
            yield chunk()

    return rows.mapInArrow(run, _CHUNK)


def _grams(row: dict, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each token, by order; where documents start; kind of each token; lengths."""
    words, tokens, lens, kinds = _swell(row["words"], np.uint64), _swell(row["tokens"], np.uint32), _swell(row["lens"], np.uint32).astype(np.int64), _swell(row["kinds"], np.uint8)
    h = words[tokens]
    starts = np.cumsum(lens) - lens
    out = [h]
    for k in range(2, order + 1):
        before = np.empty_like(h)
        before[1:] = out[-1][:-1]
        before[starts] = np.uint64(k)
        out.append(mix64(before * _STEP + h))
    return out, starts, np.repeat(kinds, lens), lens


def _asked(chunks: DataFrame, order: int, parts: int) -> DataFrame:
    """(part, chunk, body): distinct n-grams of each chunk that the part owns, with the chunk's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, _, kind, _ = _grams(row, order)
                bodies: list[list[bytes]] = [[] for _ in range(parts)]
                for g in grams:
                    keys, inverse = np.unique(g, return_inverse=True)
                    every = np.bincount(inverse[kind != HELD_OUT], minlength=len(keys)).astype(np.uint32)
                    fit = np.bincount(inverse[(kind != HELD_OUT) & (kind != TUNING)], minlength=len(keys)).astype(np.uint32)
                    at = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                    for p in range(parts):
                        a, b = at[p], at[p + 1]
                        bodies[p] += [_squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), _squeeze(every[a:b]), _squeeze(fit[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([row["chunk"]] * parts, pa.int64()), pa.array(bodies, pa.list_(pa.binary()))], ["part", "chunk", "body"])

    return chunks.mapInArrow(run, "part int, chunk long, body array<binary>")


def _answered(asked: DataFrame, order: int) -> DataFrame:
    """(chunk, part, body, known, fit_known): totals of what each chunk asked for, and distinct trained tokens of the part."""

    def add(table: pa.Table) -> pa.Table:
        chunks, part, bodies = table.column("chunk").to_pylist(), table.column("part")[0].as_py(), table.column("body")
        out: list[list[bytes]] = [[] for _ in chunks]
        known = fit_known = 0
        for k in range(order):
            own = [np.cumsum(_swell(b[3 * k].as_py(), np.uint64), dtype=np.uint64) for b in bodies]
            ends = np.cumsum([len(x) for x in own])
            keys, inverse = np.unique(np.concatenate(own), return_inverse=True)
            totals, asked = [], []
            for j in (1, 2):
                asked.append(np.concatenate([_swell(b[3 * k + j].as_py(), np.uint32) for b in bodies]))
                totals.append(np.bincount(inverse, weights=asked[j - 1], minlength=len(keys)).astype(np.uint64))
            tunes = asked[0] > asked[1]  # only n-grams of a chunk's tuning texts need what EM's estimates count
            if k == 0:
                known, fit_known = int((totals[0] > 0).sum()), int((totals[1] > 0).sum())
            for i, b in enumerate(ends):
                seat = slice(b - len(own[i]), b)
                at = inverse[seat]
                out[i] += [_squeeze(totals[0][at]), _squeeze(totals[1][at] * tunes[seat])]
        n = len(chunks)
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part] * n, pa.int32()), "body": pa.array(out, pa.list_(pa.binary())), "known": pa.array([known] * n, pa.int64()), "fit_known": pa.array([fit_known] * n, pa.int64())})

    return asked.groupBy("part").applyInArrow(add, "chunk long, part int, body array<binary>, known long, fit_known long")


def _contexts(counts: list[np.ndarray], starts: np.ndarray, docs: int, tokens: int) -> list[np.ndarray]:
    """How often the context of each token was seen, by order."""
    out = [np.full(len(counts[0]), tokens, np.uint64)]
    for c in counts[:-1]:
        seen = np.empty_like(c)
        seen[1:] = c[:-1]
        seen[starts] = docs
        out.append(seen)
    return out


def _bucket(seen: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, 1 + np.floor(np.log2(np.maximum(seen, 1))), 0).astype(np.int64)


def _estimates(counts: list[np.ndarray], seen: list[np.ndarray]) -> list[np.ndarray]:
    return [c / np.maximum(s, np.uint64(1)) for c, s in zip(counts, seen)]


_COUNTED = "doc_ids binary, nulls binary, lens binary, kinds binary, counts array<binary>, n_known binary, base binary, known long, fit_known long, cells array<long>, weights array<long>"


def _counted(chunks: DataFrame, answers: DataFrame, order: int, sums: dict[str, int]) -> DataFrame:
    """Per chunk: the totals of every token's n-grams, the base scores, and the cells of its tuning tokens."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        right = right.sort_by("part")
        grams, starts, kind, lens = _grams(row, order)
        known, fit_known = sum(right.column("known").to_pylist()), sum(right.column("fit_known").to_pylist())
        every, fit = [], []
        bodies = right.column("body")
        tuning = np.flatnonzero(kind == TUNING)
        for k in range(order):
            inverse = np.unique(grams[k], return_inverse=True)[1].astype(np.uint32)
            grams[k] = None
            told = [np.concatenate([_swell(b[2 * k + j].as_py(), np.uint64) for b in bodies]) for j in (0, 1)]
            every.append(told[0][inverse])
            fit.append(told[1][inverse[tuning]])
        base = np.log10((every[0].astype(np.float64) + 1) / (sums["train_tokens"] + known + 1))
        tuned = lens[_swell(row["kinds"], np.uint8) == TUNING]
        seen = _contexts(fit, np.cumsum(tuned) - tuned, sums["fit_docs"], sums["fit_tokens"])
        cell = _bucket(seen[-1])
        for p in _estimates(fit, seen):
            cell = cell * 1024 + np.where(p > 0, 1 + np.minimum(1022, np.round(-STEPS * np.log2(np.maximum(p, 1e-300)))), 0).astype(np.int64)
        cells, weights = np.unique(cell, return_counts=True)
        values = [row["doc_ids"], row["nulls"], row["lens"], row["kinds"], [_squeeze(c) for c in every], np.add.reduceat((every[0] > 0).astype(np.int64), starts).tobytes(), np.add.reduceat(base, starts).tobytes(), known, fit_known, cells.tolist(), weights.tolist()]
        kinds = [pa.binary()] * 4 + [pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table({x.split()[0]: pa.array([v], t) for x, v, t in zip(_COUNTED.split(", "), values, kinds)})

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(meet, _COUNTED)


def learn_weights(cells: np.ndarray, weights: np.ndarray, order: int, uniform: float, rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Mixture weights (uniform first, then by order) of each bucket, by EM over cells of held-out counts."""
    bucket = cells >> np.int64(10 * order)
    p = np.empty((len(cells), order + 1))
    p[:, 0] = uniform
    for k in range(order):
        step = cells >> np.int64(10 * (order - 1 - k)) & 1023
        p[:, k + 1] = np.where(step > 0, 2.0 ** (-(step - 1) / STEPS), 0)
    out = {}
    for b in np.unique(bucket).tolist():
        own, n = p[bucket == b], weights[bucket == b].astype(np.float64)
        mix = np.full(order + 1, 1 / (order + 1))
        for _ in range(rounds):
            part = own * mix
            mix = (part / part.sum(axis=1, keepdims=True) * n[:, None]).sum(axis=0)
            mix = np.maximum(mix / mix.sum(), 1e-9)
        out[b] = mix / mix.sum()
    return out


def _mixtures(weights: dict[int, np.ndarray], order: int) -> np.ndarray:
    """A row for each of 65 buckets; one that held-out counts never met takes the nearest one's, an unseen context the lower orders' only."""
    rows = np.full((65, order + 1), 1 / (order + 1))
    if weights:
        for b in range(65):
            rows[b] = weights[min(weights, key=lambda x: (abs(x - b), x))]
    return rows


def lm_scores(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK_TOKENS, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    chunks = stage(_chunks(docs, id_col, text_col, chunk_tokens), "lm-chunks")
    names = ("n_tokens", "train_tokens", "fit_tokens", "train_docs", "fit_docs")
    sums = {n: int(v or 0) for n, v in zip(names, chunks.agg(*[F.sum(n) for n in names]).first())}
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sums["n_tokens"] // part_tokens))
    counted = stage(_counted(chunks, _answered(_asked(chunks, order, parts), order), order, sums), "lm-counts")
    discard(chunks)
    told = counted.select("known", "fit_known").first()
    known, fit_known = (told.known, told.fit_known) if told else (0, 0)
    pairs = counted.select(F.explode(F.arrays_zip("cells", "weights")).alias("x")).groupBy("x.cells").agg(F.sum("x.weights").alias("n")).collect()
    weights = learn_weights(np.array([r[0] for r in pairs], np.int64), np.array([r[1] for r in pairs], np.int64), order, 1 / (fit_known + 1))
    mix = _mixtures(weights, order)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lens, kinds = _swell(row["lens"], np.uint32).astype(np.int64), _swell(row["kinds"], np.uint8)
                starts = np.cumsum(lens) - lens
                counts = [_swell(c, np.uint64) for c in row["counts"]]
                seen = _contexts(counts, starts, sums["train_docs"], sums["train_tokens"])
                by_token = mix[_bucket(seen[-1])]
                p = by_token[:, 0] / (known + 1)
                rest = by_token[:, 0].copy()
                for k, (own, s) in enumerate(zip(_estimates(counts, seen), seen), 1):
                    p += by_token[:, k] * own
                    rest += by_token[:, k] * (s > 0)  # an order whose context was never seen gives its weight to the others
                ids = pa.array(_swell(row["doc_ids"], np.int64), mask=_swell(row["nulls"], np.uint8).astype(bool))
                columns = [ids, pa.array(kinds == HELD_OUT), pa.array(lens), pa.array(np.frombuffer(row["n_known"], np.int64)), pa.array(np.full(len(lens), sums["train_tokens"])), pa.array(np.frombuffer(row["base"], np.float64)), pa.array(np.add.reduceat(np.log10(p / rest), starts))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.select("doc_ids", "nulls", "lens", "kinds", "counts", "n_known", "base").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
