"""Fuzzy line dedup by MinHash over the whole corpus.

A line's form is its text with A-Z in lower case and white space squeezed; lines of equal form are one class. A class is
described by the set of its character shingles and signed by ``REGISTERS`` minima: a short line by one minimum for each
of as many hash functions, a long one by the minima of as many bins of one hash function, an empty bin taking over the next full
one's; lines of a size between get both signatures. Bands of minima are hashed to buckets, and lodeseek.llm.buckets joins
the classes of a bucket whose exact Jaccard similarity reaches ``SIMILARITY`` into components by union-find. Of each
component the first line (smallest document, then line) is kept in place, all others are taken out of their documents.

Bands lose a link of similarity 0.8 with a chance of 1 in 500, of 0.9 with less than 1 in 100,000. Forms are named by
128-bit digests. Only band hashes and 64 bits of the name go through the exchange of bands; forms are read again, from the
documents that a Bloom filter lets pass, for classes that share a band.

Defined cases: a line shorter than ``least`` bytes of form is never taken out; a form below ``SHINGLE`` bytes has no
shingles and is like equal forms only; a blank line is never taken out; a null or empty text stays as it
is; a null id comes first; of rows that repeat id and text the lines of one are kept; an empty table gives no rows;
other columns pass through, and columns named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.llm import bloom
from lodeseek.llm.bpe import slices
from lodeseek.llm.buckets import bucket_components, distinct_buckets, least_of_components, longs_of, spanning
from lodeseek.llm.shingles import mix64
from lodeseek.plans.staging import discard, forget_shuffles, stage

SHINGLE, SIMILARITY, LEAST = 9, 0.8, 20
REGISTERS, ROWS = 48, 4
#: Distinct shingles from which minima of bins take over.
BINNED = 96
#: Cells in which distinct shingles of a line are counted, from below.
CELLS = 2048
#: Shingles of a line that are counted first.
FIRST = 256
SLICE = 500_000
#: Bytes of lines that are signed at once.
SIGNED_AT_ONCE = 100_000
#: Bytes of forms on either side whose shingles are held at once; some 16 bytes of memory for each.
COMPARED = 1 << 21
#: Pairs, and bytes of forms, up to which rows of small blocks are compared together.
PAIRED, PAIRED_BYTES = 1 << 12, 1 << 16
#: Lines known to a task at once, as signed or sent before.
KNOWN = 1 << 18
#: Lines that one task packs at once, and that one task gets.
PACKED_LINES, DEALT_LINES = 1 << 18, 1 << 19
#: A class with more than one in so many of all lines is broadcast; there are no more than that.
SHARE = 2048

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WIDE = (b"  ", b"\t", b"\x0b", b"\x0c", b"\r")
_SEEDS = mix64(np.arange(1001, 1001 + 2 * REGISTERS, dtype=np.uint64))
_BY_LOW, _BY_HIGH = ((_SEEDS >> np.uint64(32)).astype(np.uint32) | np.uint32(1)).reshape(2, REGISTERS)
_BANDS = REGISTERS // ROWS
_NONE = np.uint32(0xFFFFFFFF)


def form(line: bytes) -> bytes:
    return b" ".join(line.translate(_LOWER).split())


def _name(line: bytes) -> bytes:
    return hashlib.blake2b(line, digest_size=16).digest()


def _hashes(names: list[bytes]) -> np.ndarray:
    """64 bits of each name."""
    return np.ascontiguousarray(np.frombuffer(b"".join(names), np.uint64).reshape(-1, 2)[:, 0])


def shingles_of(forms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all forms in order, repeats included, and how many each form has."""
    body = np.frombuffer(b"".join(forms), np.uint8)
    lens = np.array([len(x) for x in forms], np.int64)
    counts = np.maximum(lens - SHINGLE + 1, 0)
    if len(body) < SHINGLE:
        return np.zeros(0, np.uint64), counts
    eight = np.ndarray(len(body) - SHINGLE + 1, "<u8", body, 0, (1,))  # a window of eight bytes at every byte
    h = body[SHINGLE - 1 :].astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= eight
    for by, shift in ((0xD6E8FEB86659FD93, 32), (0xBF58476D1CE4E5B9, 29)):
        h *= np.uint64(by)
        h ^= h >> np.uint64(shift)
    inside = np.ones(len(body), bool)  # where a shingle begins that ends in its form
    ends = np.cumsum(lens)
    for k in range(1, SHINGLE):
        inside[ends - np.minimum(k, lens)] = False
    return h[inside[: len(h)]], counts


def _by_functions(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    at = np.cumsum(counts) - counts
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), REGISTERS), np.uint32)
    for i in range(REGISTERS):
        out[:, i] = np.minimum.reduceat(low * _BY_LOW[i] + high * _BY_HIGH[i], at)
    return out


def _by_bins(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.full(len(counts) * REGISTERS, _NONE, np.uint32)
    own = np.repeat(np.arange(len(counts)) * REGISTERS, counts) + ((values >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, own, values.astype(np.uint32))
    out = out.reshape(-1, REGISTERS)
    holes = np.flatnonzero((out == _NONE).any(axis=1))
    if len(holes):
        told = out[holes]
        at = np.arange(2 * REGISTERS)
        full = np.where(np.tile(told != _NONE, 2), at, 2 * REGISTERS)
        after = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1][:, :REGISTERS]  # the next full bin
        steps = (after - at[:REGISTERS]).astype(np.uint32)
        out[holes] = np.take_along_axis(told, after % REGISTERS, axis=1) + steps * np.uint32(0x9E3779B1)
    return out


def _banded(signs: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of the bands of each signature."""
    signs = signs.astype(np.uint64).reshape(len(signs), _BANDS, ROWS)
    bands = np.broadcast_to(mix64(np.arange(salt, salt + _BANDS, dtype=np.uint64)), signs.shape[:2]).copy()
    for k in range(ROWS):
        bands = mix64(bands * np.uint64(0xD6E8FEB86659FD93) + signs[:, :, k])
    return bands


def bands_of(forms: list[bytes], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """Band hashes of each form: of none, one or both signatures. Two forms that are similar have one kind in common."""
    out, start = [], 0
    while start < len(forms):  # blocks that stay in the processor's cache
        stop, held = start, 0
        while stop < len(forms) and (stop == start or held + len(forms[stop]) <= SIGNED_AT_ONCE):
            held += len(forms[stop])
            stop += 1
        out += _bands_of(forms[start:stop], similarity)
        start = stop
    return out


def _bands_of(forms: list[bytes], similarity: float) -> list[np.ndarray]:
    values, counts = shingles_of(forms)
    out = [np.zeros(0, np.int64)] * len(forms)
    few = counts * similarity < BINNED
    ends = np.cumsum(counts)
    for limit in (FIRST, None):  # most long lines have enough distinct ones among their first
        many = np.flatnonzero(~few) if limit else np.flatnonzero(~few)[short]
        told = [values[e - n : e][:limit] for e, n in zip(ends[many].tolist(), counts[many].tolist())]
        if told:
            cell = np.zeros(len(many) * CELLS, bool)
            cell[np.repeat(np.arange(len(many)) * CELLS, [len(x) for x in told]) + (np.concatenate(told) >> np.uint64(20) & np.uint64(CELLS - 1)).astype(np.int64)] = True
            surely = np.add.reduce(cell.view(np.uint8).reshape(-1, CELLS), axis=1, dtype=np.uint16)  # at least so many distinct ones
        short = surely * similarity < BINNED if told else np.zeros(0, bool)
    few[many[short]] = True
    for who, signed, salt in (((counts > 0) & few, _by_functions, 1), (counts >= BINNED, _by_bins, 1 + _BANDS)):
        if who.any():
            made = _banded(signed(values[np.repeat(who, counts)], counts[who]), salt).view(np.int64)
            for i, x in zip(np.flatnonzero(who).tolist(), made):
                out[i] = np.concatenate([out[i], x]) if len(out[i]) else x
    return out


def _lines(batch: pa.RecordBatch, least: int) -> Iterator[tuple[int, int, bytes]]:
    """(row, line number, form) of the lines that can be taken out."""
    for i, text in enumerate(pc.cast(batch.column("text"), pa.binary()).to_pylist()):
        if text:
            lower = text.translate(_LOWER)
            # where words stand one space apart, only the ends of lines are to be stripped
            plain = not any(x in lower for x in _WIDE)
            for j, line in enumerate(lower.split(b"\n")):
                own = line.strip() if plain else b" ".join(line.split())
                if own and len(own) >= least:
                    yield i, j, own


def _unknown(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the table does not hold; they are put in, in the place of others."""
    at = (hashes & np.uint64(KNOWN - 1)).astype(np.int64)
    new = known[at] != hashes
    known[at] = hashes
    return new


def _signed(rows: DataFrame, least: int, similarity: float) -> DataFrame:
    """Per line: rk, doc_id, line, head (the row's first), key (its form's name), h (64 bits of it), bands (as bytes, where the task has not just told them; null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(KNOWN, np.uint64)
        for batch in slices(batches, "text", SLICE):
            found = list(_lines(batch, least))
            place = {x: k for k, x in enumerate(dict.fromkeys(x for _, _, x in found))}
            forms = list(place)
            names = [_name(x) for x in forms]
            h = _hashes(names)
            new = [k for k in np.flatnonzero(_unknown(known, h)).tolist() if len(forms[k]) >= SHINGLE]
            told = dict(zip(new, bands_of([forms[k] for k in new], similarity)))
            at = np.array([place[x] for _, _, x in found], np.int64)
            bands = [told.pop(k, None) for k in at.tolist()]  # at its first line only
            own = np.array([i for i, _, _ in found], np.int32)
            head = pa.array(np.diff(own, prepend=np.int32(-1)) != 0)
            own = pa.array(own)
            columns = [batch.column("rk").take(own), batch.column("doc_id").take(own), pa.array([j for _, j, _ in found], pa.int32()), head, pa.array(names, pa.binary()).take(pa.array(at)), pa.array(h.view(np.int64)[at]), pa.array([x if x is None else x.tobytes() for x in bands], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rk", "doc_id", "line", "head", "key", "h", "bands"])

    return rows.mapInArrow(run, "rk binary, doc_id long, line int, head boolean, key binary, h long, bands binary")


def _firsts(columns: np.ndarray) -> np.ndarray:
    """Of rows (two longs of the key, doc_id, line and whether the id is null, two longs of rk, number of lines) one for each key: its first line, all its lines counted."""
    columns = columns[np.lexsort((columns[:, 1], columns[:, 0]))]
    heads = np.ones(len(columns), bool)
    heads[1:] = (columns[1:, :2] != columns[:-1, :2]).any(axis=1)
    alone = heads & np.append(heads[1:], True)
    many = columns[~alone]
    if not len(many):
        return columns
    rk = many[:, 4:6].copy().view(">u8").astype(np.uint64)  # as the engine orders bytes
    many = many[np.lexsort((rk[:, 1], rk[:, 0], many[:, 3] >> 1, many[:, 2], many[:, 3] & 1 ^ 1, many[:, 1], many[:, 0]))]
    new = np.ones(len(many), bool)
    new[1:] = (many[1:, :2] != many[:-1, :2]).any(axis=1)
    first = many[new]
    first[:, 6] = np.add.reduceat(many[:, 6], np.flatnonzero(new))
    return np.concatenate([columns[alone], first])


def _classes(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, h, first, n) of the forms that several lines have or that share a band with others (a few more come along); first is (doc_id, line, rk).

    Lines are dealt by their form as packed bytes, those of equal forms summed up first, so no task gets all lines of a frequent one.
    """
    parts = max(-(-lines.count() // DEALT_LINES), int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = lines.sparkSession.sparkContext.broadcast(bloom.build(shared.select("key").distinct()))

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        own = _firsts(np.concatenate(held))
        part = (mix64(own[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        own, part = own[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        blobs = [own[lo:hi].T.tobytes() for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)])]
        return pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(blobs, pa.binary())], ["part", "body"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            own = np.empty((batch.num_rows, 7), np.int64)
            own[:, :2], own[:, 4:6] = (longs_of(batch.column(k)).reshape(-1, 2) for k in ("key", "rk"))
            own[:, 2] = batch.column("doc_id").fill_null(0).to_numpy()
            own[:, 3] = batch.column("line").to_numpy().astype(np.int64) << 1 | np.asarray(batch.column("doc_id").is_null())
            own[:, 6] = 1
            held.append(own)
            n += len(own)
            if n >= PACKED_LINES:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x.as_py(), np.int64).reshape(7, -1).T for batch in batches for x in batch.column("body")]
        if not held:
            return
        own = _firsts(np.concatenate(held))
        held.clear()
        own = own[(own[:, 6] > 1) | bloom.may_hold(told.value, own[:, 0].view(np.uint64))]
        for lo in range(0, len(own), 100_000):
            some = own[lo : lo + 100_000]
            key, rk = (pa.array([x.tobytes() for x in np.ascontiguousarray(some[:, k : k + 2])], pa.binary()) for k in (0, 4))
            doc = pa.array(np.ascontiguousarray(some[:, 2]), mask=(some[:, 3] & 1).astype(bool))
            first = pa.StructArray.from_arrays([doc, pa.array((some[:, 3] >> 1).astype(np.int32)), rk], ["doc_id", "line", "rk"])
            yield pa.RecordBatch.from_arrays([key, pa.array(np.ascontiguousarray(some[:, 0])), first, pa.array(np.ascontiguousarray(some[:, 6]))], ["key", "h", "first", "n"])

    dealt = lines.select("key", "doc_id", "line", "rk").mapInArrow(deal, "part int, body binary").repartitionById(parts, "part")
    return dealt.mapInArrow(run, "key binary, h long, first struct<doc_id:long,line:int,rk:binary>, n long")


def _forms(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, form) of the classes wanted (key, h, rk), read off the documents (rk, text) that hold their first lines; staged."""
    send = rows.sparkSession.sparkContext.broadcast
    told, places = send(bloom.build(wanted.select("h"))), send(bloom.build(wanted.select(F.xxhash64("rk")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(KNOWN, np.uint64)
        near = (b.filter(pa.array(bloom.may_hold(places.value, b.column("place").to_numpy().view(np.uint64)))) for b in batches)
        for batch in slices(near, "text", SLICE):
            forms = list(dict.fromkeys(x for _, _, x in _lines(batch, SHINGLE)))
            names = [_name(x) for x in forms]
            h = _hashes(names)
            hit = np.flatnonzero(bloom.may_hold(told.value, h))
            hit = hit[_unknown(known, h[hit])].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in hit], pa.binary()), pa.array([forms[k] for k in hit], pa.binary())], ["key", "form"])

    found = rows.select(F.xxhash64("rk").alias("place"), "text").mapInArrow(run, "key binary, form binary").join(wanted.select("key"), "key", "left_semi")
    return stage(found.groupBy("key").agg(F.first("form").alias("form")), "line-forms")


def _distinct(values: np.ndarray) -> np.ndarray:
    """As np.unique, which looks values up in a table first and takes many times as long."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def _sets(forms: list[bytes]) -> list[np.ndarray]:
    values, counts = shingles_of(forms)
    return [_distinct(x) for x in np.split(values, np.cumsum(counts)[:-1])] if forms else []


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, forms: DataFrame, percent: int) -> DataFrame:
    side = lambda x: forms.select(F.col("key").alias(x), F.col("form").alias(f"form_{x}"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "form_a", SLICE):
                own = [x.to_pylist() for x in (batch.column("form_a"), batch.column("form_b"))]
                place = {x: k for k, x in enumerate(dict.fromkeys(own[0] + own[1]))}
                sets = _sets(list(place))
                hit = [_alike(sets[place[x]], sets[place[y]], percent) for x, y in zip(*own)]
                yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "form_a", "form_b").mapInArrow(confirm, "a binary, b binary")


def _parts(rows: list[dict]) -> Iterator[list[dict]]:
    """The rows in parts whose forms hold ``COMPARED`` bytes at most, or one row."""
    own, held = [], 0
    for r in rows:
        if own and held + len(r["form"]) > COMPARED:
            yield own
            own, held = [], 0
        own.append(r)
        held += len(r["form"])
    if own:
        yield own


def _compared(blocks: DataFrame, percent: int) -> DataFrame:
    def described(own: list[dict]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        sets = _sets([r["form"] for r in own])
        n = np.array([len(s) for s in sets])
        return sets, n, np.array([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) for s in sets], np.uint16 if n.max() < 1 << 16 else np.int64)

    def links(x: list[dict], y: list[dict]) -> Iterator[tuple[bytes, bytes]]:
        root: dict = {}
        for own in _parts(x):
            sets_x, n_x, bins_x = described(own)
            for others in _parts(y):
                sets_y, n_y, bins_y = described(others)
                kind, c_y = np.promote_types(bins_x.dtype, bins_y.dtype), np.array([r["c"] for r in others], object)
                at, to = [], []
                for i, r in enumerate(own):
                    # no more shingles in common than the smaller number in each bin
                    most, both = np.minimum(bins_x[i], bins_y).sum(axis=1, dtype=kind).astype(np.int64), n_x[i] + n_y
                    near = np.flatnonzero((100 * most >= percent * (both - most)) & (c_y != r["c"])).tolist()
                    at += [i] * len(near)
                    to += near
                a, b = [own[i]["key"] for i in at], [others[j]["key"] for j in to]
                confirmed = lambda k: _alike(sets_x[at[k]], sets_y[to[k]], percent)  # noqa: E731, B023
                for k in spanning(a, b, {r["key"]: r["c"] for r in own + others}, confirmed, range(len(a)), root):
                    yield a[k], b[k]
                del sets_y  # before the next part's are made

    def together(rows: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
        """The links of many rows of few short forms, each form described once."""
        (n_x, x), (n_y, y) = ((rows.column(k).value_lengths().to_numpy(), rows.column(k).flatten()) for k in ("askers", "others"))
        (key_x, form_x, c_x), (key_y, form_y, c_y) = ([side.field(k).to_pylist() for k in ("key", "form", "c")] for side in (x, y))
        place = {f: k for k, f in enumerate(dict.fromkeys(form_x + form_y))}
        sets = _sets(list(place))
        n = np.array([len(s) for s in sets])
        cells = np.repeat(np.arange(len(sets)) * 256, n) + (np.concatenate(sets) >> np.uint64(56)).astype(np.int64)
        bins = np.bincount(cells, minlength=256 * len(sets)).astype(np.uint16).reshape(-1, 256)
        number = {c: k for k, c in enumerate(dict.fromkeys(c_x + c_y))}
        in_x, in_y = (np.array([number[c] for c in own], np.int64) for own in (c_x, c_y))
        set_x, set_y = (np.array([place[f] for f in own], np.int64) for own in (form_x, form_y))
        pairs = n_x.astype(np.int64) * n_y
        row = np.repeat(np.arange(len(pairs)), pairs)
        k = np.arange(len(row)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        i, j = (np.cumsum(n_x) - n_x)[row] + k // n_y[row], (np.cumsum(n_y) - n_y)[row] + k % n_y[row]
        apart = in_x[i] != in_y[j]
        i, j = i[apart], j[apart]
        near = np.zeros(len(i), bool)
        for lo in range(0, len(i), PAIRED):
            p, q = set_x[i[lo : lo + PAIRED]], set_y[j[lo : lo + PAIRED]]
            most = np.minimum(bins[p], bins[q]).sum(axis=1, dtype=np.int64)
            near[lo : lo + PAIRED] = 100 * most >= percent * (n[p] + n[q] - most)
        i, j = i[near].tolist(), j[near].tolist()
        a, b = [key_x[k] for k in i], [key_y[k] for k in j]
        confirmed = lambda k: _alike(sets[set_x[i[k]]], sets[set_y[j[k]]], percent)
        for k in spanning(a, b, dict(zip(key_x + key_y, c_x + c_y)), confirmed, range(len(a))):
            yield a[k], b[k]

    def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, bool]]:
        """Rows that go together, and whether they are small."""
        held = []
        for k in ("askers", "others"):
            lens = batch.column(k).value_lengths().to_numpy().astype(np.int64)
            ends, size = np.cumsum(lens), np.cumsum(np.append(0, pc.binary_length(batch.column(k).flatten().field("form")).to_numpy()))
            held.append((lens, size[ends] - size[ends - lens]))
        pairs, weights = (held[0][0] * held[1][0]).tolist(), (held[0][1] + held[1][1]).tolist()
        start, n, w = 0, 0, 0
        for k, (own, weight) in enumerate(zip(pairs, weights)):
            if k > start and (n + own > PAIRED or w + weight > PAIRED_BYTES):
                yield batch.slice(start, k - start), n <= PAIRED and w <= PAIRED_BYTES
                start, n, w = k, 0, 0
            n, w = n + own, w + weight
        if start < len(pairs):
            yield batch.slice(start), n <= PAIRED and w <= PAIRED_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, small in groups(batch):
                found = list(together(rows) if small else links(rows.column("askers")[0].as_py(), rows.column("others")[0].as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return blocks.mapInArrow(run, "a binary, b binary")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    """A digest of id and text, the id, the text."""
    own, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return F.unhex(F.md5(F.concat_ws("|", F.coalesce(own.cast("string"), F.lit("")), own.isNull().cast("string"), text))), own.cast("long"), text


def line_components(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(rk, line, kept): the lines of ``least`` bytes and more whose component holds several lines; rk is a digest of id and text.

    Rows that repeat id and text have one rk; their lines come as often as they do, all kept or all not."""
    return _settled(docs, similarity, id_col, text_col, least)[1]


def _settled(docs: DataFrame, similarity: float, id_col: str, text_col: str, least: int) -> tuple[DataFrame, DataFrame]:
    """All lines, as signed, and what line_components gives."""
    rk, own_id, text = _keyed(docs, id_col, text_col)
    rows = docs.select(rk.alias("rk"), own_id.alias("doc_id"), text.alias("text"))
    lines = stage(_signed(rows, least, similarity), "lines")
    place = F.struct("doc_id", "line", "rk")
    shared = distinct_buckets(lines.filter("bands IS NOT NULL").select(F.col("h").alias("key"), "bands"))
    classes = stage(_classes(lines, shared), "line-classes")
    named = shared.withColumnRenamed("key", "h").join(classes.select("h", "key"), "h")
    buckets = stage(named.select("band", "key", "size", "times"), "line-buckets")
    discard(shared)
    wanted = stage(classes.select("key", "h", "first.rk").join(buckets.select("key").distinct(), "key", "left_semi"), "line-candidates")
    forms = _forms(rows, wanted)
    forget_shuffles(docs.sparkSession)
    percent = round(similarity * 100)
    joined = bucket_components(buckets, lambda pairs: _verified(pairs, forms, percent), forms, lambda blocks: _compared(blocks, percent), F.length("form"))
    found = least_of_components(joined, classes.select(F.col("key").alias("node"), F.col("first").alias("value"))).withColumnRenamed("node", "key")
    # classes with several lines, and those with links
    told = classes.join(found, "key", "left").filter("n > 1 OR least IS NOT NULL").select("key", "n", F.coalesce("least", "first").alias("stays"))
    told = stage(told, "line-told")
    total = lines.count()
    hot = F.col("n") > max(SHARE, total // SHARE)
    own = lines.select("rk", "doc_id", "line", "key")
    first = told.filter(hot).select(F.col("key").alias("hot"), F.col("stays").alias("hot_stays"))
    marked = own.join(F.broadcast(first), F.col("key") == F.col("hot"), "left")
    rest = marked.filter("hot IS NULL").drop("hot", "hot_stays").join(told.filter(~hot).select("key", "stays"), "key")
    both = marked.filter("hot IS NOT NULL").select("rk", "doc_id", "line", F.col("hot_stays").alias("stays")).unionByName(rest.select("rk", "doc_id", "line", "stays"))
    return lines, both.select("rk", "line", (F.col("stays") == place).alias("kept"))


def drop_similar_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with lines taken out of the text column, and n_lines, n_dropped. ``least`` of 1 settles every line that is not blank."""
    lines, told = _settled(docs, similarity, id_col, text_col, least)
    by_row = told.filter(~F.col("kept")).groupBy("rk").agg(F.collect_set("line").alias("gone"))
    # of rows that repeat id and text, all lines of the second and later ones go
    twice = stage(lines.filter("head").groupBy("rk").agg(F.count("*").alias("times")).filter("times > 1").select("rk"), "line-repeats")
    repeats = twice.limit(1).count() > 0
    if repeats:
        every = lines.select("rk", "line").join(twice, "rk", "left_semi").groupBy("rk").agg(F.collect_set("line").alias("all"))
        by_row = by_row.join(every, "rk", "full").select("rk", "all", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    by_row = stage(by_row, "line-drops")
    forget_shuffles(docs.sparkSession)
    rk, _, text = _keyed(docs, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0)).alias("own"), rk.alias("rk"), text.alias("text"))
    gone = F.col("gone")
    if repeats:
        rows = rows.join(by_row, "rk", "left").withColumn("nth", F.row_number().over(Window.partitionBy("rk").orderBy(F.lit(0))))
        gone = F.when(F.col("all").isNotNull() & (F.col("nth") > 1), F.col("all")).otherwise(gone)
    else:  # no text is sorted
        rows = rows.join(by_row.hint("shuffle_hash"), "rk", "left")
    # only texts that lose lines are split
    told = rows.select("own", "text", gone.alias("gone")).withColumn("parts", F.when(F.size("gone") > 0, F.split("text", "\n")))
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone")), lambda i: F.get("parts", i))
    kept = [F.col(f"own.`{c}`").alias(c) if c != text_col else F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text")).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return told.select(*kept, F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
