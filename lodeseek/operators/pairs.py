"""All pairs of two tables, block by block: a task holds one block of each side, whatever the tables' sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of hashes; comparisons of hashes held at once; pairs sent on at once.
HASHES, AT_ONCE, SENT = 16_384, 1 << 21, 1 << 18
#: Blocks that a table is cut into at least, so that there is work for many tasks, unless they have fewer rows than this.
SPREAD, FEW = 16, 1024


def block_rows(n: int, most: int, spread: int = SPREAD) -> int:
    """Rows of a block, of n in all."""
    return max(1, min(most, max(FEW, -(-n // spread))))


def part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def close_hashes(hashes: DataFrame, most: int, block: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of rows (id, h) whose 64-bit hashes differ in at most ``most`` bits; a pair comes once, in any order.

    Every pair of blocks is compared, as hashes of like texts share so many bits that buckets of equal bits hold a good part of all pairs.
    """
    n = hashes.count()
    parts = max(1, -(-n // (block or block_rows(n, HASHES))))
    own, every = part("h", parts), F.sequence(F.lit(0), F.lit(parts - 1))
    cells = hashes.select("id", "h", own.alias("own")).withColumn("other", F.explode(every))
    cells = cells.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("second"), "id", "h")
    kind = dict(hashes.dtypes)["id"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()
        second = whole.column("second").to_numpy()
        sides = [whole.filter(pa.array(~second)), whole.filter(pa.array(second))]
        within = not second.any() and whole.column("p")[0] == whole.column("q")[0]
        left, right = sides[0], sides[0] if within else sides[1]
        a, b = (x.column("h").to_numpy().view(np.uint64) for x in (left, right))
        schema = pa.schema([("a", left.schema.field("id").type), ("b", left.schema.field("id").type), ("distance", pa.int32())])
        step = max(1, AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), step):
            bits = np.bitwise_count(a[at : at + step, None] ^ b[None, :])
            hit = np.flatnonzero(bits <= most)
            i, j = hit // max(1, len(b)) + at, hit % max(1, len(b))
            distance = bits.reshape(-1)[hit].astype(np.int32)
            if within:
                keep = i < j
                i, j, distance = i[keep], j[keep], distance[keep]
            for k in range(0, len(i), SENT):
                cut = slice(k, k + SENT)
                ids = [side.column("id").combine_chunks().take(pa.array(x[cut])) for side, x in ((left, i), (right, j))]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(distance[cut])], schema=schema)

    return cells.groupBy("p", "q").applyInArrow(compare, f"a {kind}, b {kind}, distance int")


#: Numbers of a block of queries and of a block of vectors; queries and vectors of a tile; candidates scored at once.
ASKED, SEARCHED, STRIP, TILE, SCORED = 1 << 20, 1 << 23, 256, 4096, 1 << 15


def best_pairs(vectors: DataFrame, queries: DataFrame, k: int, threshold: float, over: bool = False, others: bool = False, asked: int | None = None, searched: int | None = None) -> DataFrame:
    """(query_id, id, score): for each query (query_id, query) vectors (id, vector) by dot product, k at least of the best of each block of vectors.

    Ties go by id. ``over`` leaves out scores equal to the threshold, ``others`` vectors with the query's id. Products of blocks
    in single precision say who can be among the best; their scores are summed in doubles in the order of the elements, as the
    expression ``dot`` and SQL do. Pairs of different lengths, or with nulls, have no score. What is exchanged grows with rows times blocks.
    """
    whole = lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull())
    v = vectors.filter(whole(F.col("vector"))).select("id", F.size("vector").alias("size"), "vector")
    q = queries.filter(whole(F.col("query"))).select("query_id", F.size("query").alias("size"), "query")
    (nv, size), nq = v.agg(F.count("*"), F.max("size")).first(), q.count()
    size = max(1, size or 1)
    q_parts = -(-nq // (asked or block_rows(nq, max(FEW, ASKED // size), 24))) or 1
    v_parts = -(-nv // (searched or max(FEW, SEARCHED // size))) or 1
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("p", part("query_id", q_parts)).withColumn("o", numbers(v_parts))
    right = v.withColumn("o", part("id", v_parts)).withColumn("p", numbers(q_parts))
    kinds = dict(q.dtypes) | dict(v.dtypes)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        by_id = pc.sort_indices(right.column("id"))
        right = right.take(by_id)
        ids, query_ids = right.column("id").combine_chunks(), left.column("query_id").combine_chunks()
        a, b = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 0)) for t, c in ((left, "query"), (right, "vector")))
        rows, at, scores = _best(a, b, k, threshold, over, _codes(query_ids, ids) if others else None)
        return pa.table({"query_id": query_ids.take(pa.array(rows)), "id": ids.take(pa.array(at)), "score": pa.array(scores, pa.float64())})

    return left.groupBy("p", "o", "size").cogroup(right.groupBy("p", "o", "size")).applyInArrow(search, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def _codes(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are."""
    codes = pa.chunked_array([a, b.cast(a.type)]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return codes[: len(a)], codes[len(a) :]


def _best(a: np.ndarray, b: np.ndarray, k: int, threshold: float, over: bool, codes: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, ...]:
    """Rows of a, rows of b (in the order that ties go by) and scores: the k best of each row of a."""
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if not len(a) or not len(b):
        return out[0]
    peaks = [float(np.abs(x).max(initial=0.0)) for x in (a, b)]
    small = all(np.isfinite(p) and p < 1e15 for p in peaks)
    # single precision errs by less than this; other numbers are scored one by one
    slack = 2 * (a.shape[1] + 2) * float(np.finfo(np.float32).eps) * a.shape[1] * peaks[0] * peaks[1] + 1e-25 if small else np.inf
    fast = b.astype(np.float32, copy=False) if small else b
    first = k + (int(np.bincount(codes[1]).max()) if codes is not None else 0)  # so many of a tile, and k are not the query's own
    for top in range(0, len(a), STRIP):
        strip = a[top : top + STRIP]
        near = strip.astype(np.float32, copy=False)
        least = np.full(len(strip), threshold, np.float64)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for start in range(0, len(b), TILE):
            tile = fast[start : start + TILE]
            if small:
                guess = near @ tile.T
                floor = least - slack
                if not start and len(tile) > first:
                    floor = np.maximum(floor, np.partition(guess, len(tile) - first, axis=1)[:, len(tile) - first] - 2 * slack)
                hits = np.flatnonzero(guess >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None])
            else:
                hits = np.arange(len(strip) * len(tile))
            for cut in range(0, len(hits), SCORED):
                i, j = np.divmod(hits[cut : cut + SCORED], len(tile))
                j += start
                if codes is not None:
                    other = codes[0][i + top] != codes[1][j]
                    i, j = i[other], j[other]
                x, y, score = strip[i], b[j], np.zeros(len(i))
                with np.errstate(all="ignore"):
                    for d in range(a.shape[1]):
                        score += x[:, d].astype(np.float64) * y[:, d].astype(np.float64)
                # as in SQL, not-a-number is above all numbers
                rank = np.where(np.isnan(score), np.inf, score)
                keep = rank > threshold if over else rank >= threshold
                i, j, score = (np.concatenate([h, n[keep]]) for h, n in zip(held, (i, j, score)))
                order = np.lexsort((j, -np.nan_to_num(score, nan=np.inf, posinf=np.inf, neginf=-np.inf), ~np.isnan(score), i))
                i, j, score = i[order], j[order], score[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                last = place == k - 1
                least[i[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
                best = place < k
                held = i[best], j[best], score[best]
        out.append((held[0] + top, held[1], held[2]))
    return tuple(np.concatenate(x) for x in zip(*out))
