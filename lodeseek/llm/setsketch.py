"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is sketched into ``REGISTERS`` registers: each is a truncated minimum of
exponential hashes on a scale of exponential spacing, so sketches of parts merge by the larger register and equal
registers are about as frequent as the sets are similar. Documents with equal sets form one class. Bands of
registers are hashed to buckets; two classes in a bucket may be similar. The joint likelihood of both sketches,
with the known set sizes, drops pairs whose similarity is surely below the threshold; all others are confirmed
on their full sets.

Buckets are not expanded into pairs; lodeseek.llm.buckets says how they become components.

Defined cases: a text without words (or null) has the empty set and is linked with nothing; a null id is passed
over when the smallest id is sought, and is not kept; rows that repeat an id are all kept or all told so by ``kept``; an empty
table gives no rows; other columns play no part. drop_near_duplicates has its own rules for ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import bloom
from lodeseek.llm.bpe import slices
from lodeseek.llm.buckets import bucket_components, distinct_buckets, least_of_components, spanning
from lodeseek.llm.shingles import mix64, shingle_sets
from lodeseek.plans.staging import stage

#: 20 bands of 4: of links with a similarity of 0.8 one in 30,000 shares no band; with 0.85, one in two million.
REGISTERS, ROWS = 80, 4
#: Ratio of the scale, and rate of the exponential hashes.
SCALE, RATE = 1.001, 20.0
#: Pairs are dropped if the similarity sought is less likely than the best one by this factor's logarithm.
DROP = 14.0
#: Bytes of text whose words are hashed at once; some 60 bytes of memory for each.
SLICE = 1_000_000
WORDS, SIMILARITY = 5, 0.8

_SEEDS = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64))
_BY_LOW, _BY_HIGH = ((_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).reshape(2, REGISTERS)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``REGISTERS`` 16-bit registers for each set; zeros for an empty one."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
    start = 0
    while start < len(full):  # blocks that stay in the processor's cache
        stop, held = start, 0
        while stop < len(full) and (stop == start or held + len(sets[full[stop]]) <= 65_536):
            held += len(sets[full[stop]])
            stop += 1
        own = [sets[i] for i in full[start:stop]]
        values = np.concatenate(own)
        at = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]])
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        least = np.empty((len(own), REGISTERS), np.uint32)
        for i in range(REGISTERS):
            least[:, i] = np.minimum.reduceat(low * _BY_LOW[i] + high * _BY_HIGH[i], at)
        waits = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
        out[full[start:stop]] = np.clip(np.floor(1 - np.log(waits) / np.log(SCALE)), 0, 65_535).astype(np.uint16)
        start = stop
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Of similarity ``j``, given how many registers of the first are larger, smaller and equal; ``u`` is the first set's share of both sizes."""
    chance = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
    p, q = chance(u - (1 - u) * j), chance((1 - u) - u * j)
    return more * np.log(p) + less * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))


def likely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float, drop: float = DROP) -> np.ndarray:
    """Which pairs of sketches may reach the similarity."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    most = np.minimum(u / (1 - u), (1 - u) / u)
    args = (more, less, REGISTERS - more - less, u)
    sought = _log_likelihood(np.minimum(most, similarity), *args)[:, 0]
    grid = _log_likelihood(most * np.linspace(0, 1, 64)[None, :], *args)
    best = grid.argmax(axis=1) / 63 * most[:, 0]
    return (most[:, 0] >= similarity - 1e-9) & ((best >= similarity) | (sought >= grid.max(axis=1) - drop))


def sketches(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, key (128-bit digest of the set, null if empty), n, regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            sets = shingle_sets(batch.column("text"), words)
            regs = registers(sets)
            keys = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets]
            columns = [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in regs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "regs"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "doc_id long, key binary, n long, regs binary")


def sets_of(docs: DataFrame, classes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(key, body) of the classes (key, first_id): shingle sets read off the documents anew; a Bloom filter spares all other documents."""
    told = docs.sparkSession.sparkContext.broadcast(bloom.build(classes.filter("first_id is not null").select(F.xxhash64("first_id"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom.may_hold(told.value, batch.column("h").to_numpy().view(np.uint64)) | np.asarray(batch.column("doc_id").is_null())
            for part in slices(iter([batch.filter(pa.array(hit))]), "text", SLICE):
                sets = [x for x in shingle_sets(part.column("text"), words) if len(x)]
                keys = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "body"])

    own = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(own.alias("doc_id"), F.xxhash64(own).alias("h"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, "key binary, body binary")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links."""
    side = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(f"regs_{x}").to_pylist()), np.uint16).reshape(-1, REGISTERS) for x in "ab")
                n_a, n_b = (batch.column(f"n_{x}").to_numpy().astype(np.float64) for x in "ab")
                yield batch.select(["a", "b"]).filter(pa.array(likely(a, b, n_a, n_b, percent / 100)))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("body_a"), batch.column("body_b")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = _common(x, y)
                hit.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    sifted = sized.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(sift, "a binary, b binary")
    body = lambda x: sets.select(F.col("key").alias(x), F.col("body").alias(f"body_{x}"))
    return sifted.join(body("a"), "a").join(body("b"), "b").select("a", "b", "body_a", "body_b").mapInArrow(confirm, "a binary, b binary")


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    """Links between blocks of classes, likeliest pairs first, those of one component left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("askers"), batch.column("others")):
                x, y = left.as_py(), right.as_py()
                sides = []
                for own in (x, y):
                    sides.append((np.frombuffer(b"".join(r["regs"] for r in own), np.uint16).reshape(-1, REGISTERS), np.array([r["n"] for r in own], np.float64), [np.frombuffer(r["body"], np.uint64) for r in own]))
                (regs_x, n_x, sets_x), (regs_y, n_y, sets_y) = sides
                component = {r["key"]: r["c"] for r in x + y}
                at, to, alike = [], [], []
                for i, r in enumerate(x):
                    open_ = np.array([r["c"] != o["c"] for o in y]) & (100 * np.minimum(n_x[i], n_y) >= percent * np.maximum(n_x[i], n_y))
                    js = np.flatnonzero(open_)
                    if len(js):
                        one = np.broadcast_to(regs_x[i], (len(js), REGISTERS))
                        js = js[likely(one, regs_y[js], np.full(len(js), n_x[i]), n_y[js], percent / 100)]
                        at += [i] * len(js)
                        to += js.tolist()
                        alike += (regs_y[js] == regs_x[i]).sum(axis=1).tolist()
                confirmed = lambda k: 100 * (c := _common(sets_x[at[k]], sets_y[to[k]])) >= percent * (n_x[at[k]] + n_y[to[k]] - c)  # noqa: E731, B023
                a, b = [x[i]["key"] for i in at], [y[j]["key"] for j in to]
                found = spanning(a, b, component, confirmed, np.argsort(-np.array(alike, int), kind="stable").tolist())
                yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in found], pa.binary()), pa.array([b[k] for k in found], pa.binary())], ["a", "b"])

    return blocks.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id that links lead to), kept."""
    percent = round(similarity * 100)
    members = stage(sketches(docs, words, id_col, text_col), "sketches")
    classes = stage(members.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("regs").alias("regs")), "classes")
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + i * width, width)) for i in range(REGISTERS // ROWS)])
    buckets = distinct_buckets(classes.select("key", bands.alias("bands")))
    seen = stage(classes.join(buckets.select("key").distinct(), "key", "left_semi"), "candidates")
    sets = stage(sets_of(docs, seen, words, id_col, text_col).join(seen.select("key"), "key", "left_semi"), "sets")
    nodes = seen.select("key", "n", "regs").join(sets.select("key", "body"), "key")
    joined = bucket_components(buckets, lambda pairs: _verified(pairs, seen, sets, percent), nodes, lambda blocks: _compared(blocks, percent), F.length("body"))

    told = least_of_components(joined, classes.select(F.col("key").alias("node"), F.col("first_id").alias("value"))).withColumnRenamed("node", "key")
    named = classes.join(told, "key", "left").select("key", F.when(F.col("least").isNotNull(), F.col("least")).otherwise(F.col("first_id")).alias("component_id"))
    out = members.select("doc_id", "key", F.col("n").alias("n_shingles")).join(named, "key", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that are not the first of their component.

    First is the smallest id, of any type that has an order; rows without id come last. Rows are told apart by a number of their own, so
    a repeated id does no harm; columns may have any names.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), own), "near-rows")
    found = near_duplicates(rows.select("row", F.col(f"own.`{text_col}`").alias("text")), words, similarity, "row", "text")
    linked = stage(found.filter("doc_id != component_id").select(F.col("doc_id").alias("row"), "component_id"), "near-linked")
    linked = linked.unionByName(linked.select(F.col("component_id").alias("row"), "component_id").distinct())
    named = rows.select("row", F.col(f"own.`{id_col}`").alias("id")).join(linked, "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    gone = linked.select("row").join(first.select("first.row"), "row", "left_anti")
    return rows.join(stage(gone, "near-copies"), "row", "left_anti").select("own.*")
