"""Token-id files of patched frame-of-reference blocks.

Ids of consecutive documents, each closed by an end id, form segments of about a million ids. A segment holds
blocks of 512 ids: the block's minimum is subtracted, the rest is packed at the width that a percentile of the
block needs, larger values go to the block's exception list, and an index names where each block and its
exceptions start, so any block can be read alone. Segments are the records of a Parquet container, written
through Spark's committer, so the folder may lie in any store and a lost executor leaves no partial file.

Documents are dealt by ranges of (id, hash of the text) and sorted, so files follow ascending ids.

Defined cases: a null or empty text holds only the end id; null ids come first; rows that repeat an id follow
in the order of their texts; a document is never split over segments, however long; an empty table gives an
empty folder with a schema; other columns play no part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.bpe import encoder, slices

BLOCK = 512
LANE = 64
PERCENTILE = 99
SEGMENT_IDS = 1 << 20
#: Pieces kept by a worker, and bytes of text encoded at once.
CACHE, SLICE = 800_000, 3_000_000
#: Magic, version, block size, ids, blocks, packed words, exceptions.
_HEAD = struct.Struct("<4sHHQIII")
_MAGIC = b"PFR1"


def _widths(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def _lanes(width: int) -> list[tuple[int, int]]:
    """Word and shift of each of the 64 values of a lane, which fills ``width`` words."""
    return [divmod(i * width, 64) for i in range(LANE)]


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Ids (below 2**32) to patched frame-of-reference blocks."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, np.uint64)
    values[:n] = ids
    if n:
        values[n:] = values[n - 1]
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1) if n else np.zeros(0, np.uint64)
    values -= least[:, None]
    at = (BLOCK - 1) * percentile // 100
    width = _widths(np.partition(values, at, axis=1)[:, at]) if n else np.zeros(0, np.uint8)
    over = values >> width[:, None].astype(np.uint64) > 0
    rows, places = np.nonzero(over)
    patches = values[rows, places].astype(np.uint32)
    values[over] = 0
    words = width.astype(np.int64) * (BLOCK // LANE)
    starts = np.concatenate([[0], np.cumsum(words)]).astype(np.uint32)
    patch_starts = np.searchsorted(rows, np.arange(blocks + 1)).astype(np.uint32)
    packed = np.zeros(int(starts[-1]), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.nonzero(width == w)[0]
        lanes = values[own].reshape(-1, LANE)
        out = np.zeros((len(lanes), w), np.uint64)
        for i, (word, shift) in enumerate(_lanes(w)):
            out[:, word] |= lanes[:, i] << np.uint64(shift)
            if shift + w > 64:
                out[:, word + 1] |= lanes[:, i] >> np.uint64(64 - shift)
        packed[starts[own].astype(np.int64)[:, None] + np.arange(w * (BLOCK // LANE))] = out.reshape(len(own), -1)
    head = _HEAD.pack(_MAGIC, 1, BLOCK, n, blocks, len(packed), len(patches))
    return b"".join([head, least.astype("<u4").tobytes(), width.tobytes(), starts.astype("<u4").tobytes(), patch_starts.astype("<u4").tobytes(), packed.astype("<u8").tobytes(), places.astype("<u2").tobytes(), patches.astype("<u4").tobytes()])


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of the blocks ``first`` to ``last`` (not included), all by default."""
    magic, version, size, n, blocks, n_words, n_patches = _HEAD.unpack_from(data)
    if magic != _MAGIC or version != 1 or size != BLOCK:
        raise ValueError("not a segment of this format")
    place = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal place
        out = np.frombuffer(data, kind, count, place)
        place += out.nbytes
        return out

    least, width, starts, patch_starts = take("<u4", blocks), take("u1", blocks), take("<u4", blocks + 1), take("<u4", blocks + 1)
    packed, places, patches = take("<u8", n_words), take("<u2", n_patches), take("<u4", n_patches)
    last = blocks if last is None else min(last, blocks)
    values = np.zeros((max(0, last - first), BLOCK), np.uint64)
    for w in np.unique(width[first:last]).tolist():
        if not w:
            continue
        own = first + np.nonzero(width[first:last] == w)[0]
        lanes = packed[starts[own].astype(np.int64)[:, None] + np.arange(w * (BLOCK // LANE))].reshape(-1, w)
        out = np.empty((len(lanes), LANE), np.uint64)
        for i, (word, shift) in enumerate(_lanes(w)):
            out[:, i] = lanes[:, word] >> np.uint64(shift)
            if shift + w > 64:
                out[:, i] |= lanes[:, word + 1] << np.uint64(64 - shift)
        values[own - first] = (out & np.uint64((1 << w) - 1)).reshape(len(own), BLOCK)
    a, b = int(patch_starts[first]) if blocks else 0, int(patch_starts[last]) if blocks else 0
    rows = np.searchsorted(patch_starts, np.arange(a, b), "right") - 1
    values[rows - first, places[a:b]] = patches[a:b]
    values += least[first:last, None].astype(np.uint64)
    return values.reshape(-1)[: max(0, min(n, last * BLOCK) - first * BLOCK)].astype(np.uint32)


_SEGMENT = "shard int, seq int, ids_before long, n_docs long, n_ids long, doc_ids binary, doc_nulls binary, doc_lens binary, blocks binary"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode and write all texts under ``path`` in ascending order of their ids."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("spread", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "spread").sortWithinPartitions("doc_id", "text").drop("spread")
    end = np.int32(end_id).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seq, before, held, ids, coded = TaskContext.get().partitionId(), 0, 0, 0, [], []

        def segment() -> pa.RecordBatch:
            nonlocal seq, before, held
            values = np.frombuffer(b"".join(coded), np.uint32)
            row = [shard, seq, before, len(ids), len(values), np.array([x or 0 for x in ids], "<i8").tobytes(), bytes(x is None for x in ids), np.array([len(x) // 4 for x in coded], "<u4").tobytes(), pack(values)]
            seq, before, held = seq + 1, before + len(values), 0
            ids.clear(), coded.clear()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int32()] * 2 + [pa.int64()] * 3 + [pa.binary()] * 4)], [x.split()[0] for x in _SEGMENT.split(", ")])

        for batch in slices(batches, "text", SLICE):
            for doc_id, made in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer, cache=CACHE).encode_batch(batch.column("text").to_pylist())):
                ids.append(doc_id)
                coded.append(made + end)
                held += len(made) // 4 + 1
                if held >= segment_ids:
                    yield segment()
        if ids:
            yield segment()

    rows.mapInArrow(write, _SEGMENT).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids). The driver holds one count per shard."""
    segments = spark.read.parquet(path)
    counts = {r.shard: r.n for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(counts):
        base[shard], total = total, total + counts[shard]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = unpack(row["blocks"])
                lens = np.frombuffer(row["doc_lens"], "<u4").astype(np.int64)
                stops = np.cumsum(lens)
                starts = stops - lens
                ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_nulls"], np.bool_))
                crcs = np.array([zlib.crc32(values[a:b].data) for a, b in zip(starts.tolist(), stops.tolist())], np.int64)
                columns = [ids, pa.array(starts + row["ids_before"] + base[row["shard"]]), pa.array(lens), pa.array(crcs)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(values.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return segments.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
