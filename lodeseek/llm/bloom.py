"""A Bloom filter made of blocks, built by all executors and small enough to broadcast.

A hash chooses one block and four bits in it. Hashes are dealt out by block, so each block is made in one
task and nothing is merged. There are 16 bits for each hash up to ``MOST_BLOCKS`` blocks (32 MB in all); beyond that
more hashes pass that were never put in, which costs the caller work and never a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a block, as a power of two.
BLOCK_BITS = 19
MOST_BLOCKS = 512


def _seats(hashes: np.ndarray, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Byte and mask of each hash's four bits; blocks stand end to end."""
    mask = np.uint64((1 << BLOCK_BITS) - 1)
    base = (hashes >> np.uint64(44)) % np.uint64(blocks) << np.uint64(BLOCK_BITS)
    a, b = hashes & mask, hashes >> np.uint64(BLOCK_BITS) & mask | np.uint64(1)
    for k in range(4):
        at = base | (a + np.uint64(k) * b & mask)
        yield (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)


def build(hashes: DataFrame) -> np.ndarray:
    """The filter over the only column of ``hashes``: longs that are well mixed, not null."""
    hashes = hashes.toDF("h")
    blocks = max(1, min(MOST_BLOCKS, -(-hashes.count() * 16 >> BLOCK_BITS)))
    size = 1 << BLOCK_BITS - 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            own = batch.column("h").to_numpy().view(np.uint64)
            for at, bit in _seats(own, blocks):
                for block in np.unique(at // size).tolist():
                    inside = at // size == block
                    np.bitwise_or.at(held.setdefault(block, np.zeros(size, np.uint8)), at[inside] % size, bit[inside])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "bits"])

    block = F.pmod(F.shiftrightunsigned("h", 44), F.lit(blocks))
    out = np.zeros(blocks * size, np.uint8)
    for row in hashes.repartition(block).mapInArrow(fill, "block int, bits binary").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may have been put in; all that were are among them."""
    out = np.ones(len(hashes), bool)
    for at, bit in _seats(hashes, len(bits) >> BLOCK_BITS - 3):
        out &= bits[at] & bit > 0
    return out
