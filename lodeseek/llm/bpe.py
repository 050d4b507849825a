"""BPE encoding and decoding by tree concatenation.

A text is cut into halves down to leaves of ``LEAF`` bytes at most. Every leaf is encoded on its own, all leaves of a batch side by
side; then the tree is joined upwards, all joins of one level side by side. Around a join a window is encoded anew. It starts
where a piece of the left half starts so far from the cut that what follows cannot move it (``MARGIN``), and it grows
until one of its pieces, behind the cut and as far from the window's end, starts where a piece of the right half does. The
tokenizer's splitting remembers nothing across a start of a piece, so left half, window and right half then agree with
the encoding of the whole. A window that has grown to the end of the right half is exact in itself.

A piece that is longer than a leaf, which nothing splits, has a tree of its own, joined by tokens: a window is encoded anew until its first
token is the left side's and its last token the right side's. Then every adjacent pair of tokens stands in one exact encoding
(of the left half, the window or the right half), and a BPE sequence whose adjacent pairs are all exact is the exact
encoding of the whole. Short pieces are encoded by the tokenizers library, once each, and kept in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of added tokens in a
text become their ids, as in the library; other columns pass through, and a column that has the name of the
result is replaced; rows that repeat give equal results; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeseek.llm.shingles import mix64, powers

#: Bytes of the largest leaf of a tree.
LEAF = 1024
#: Bytes that hold the three characters which can decide, at most, where a piece before them ends.
MARGIN = 12
#: Bytes of a window behind the cut, at first.
WIDTH = 48
#: Pieces kept; the cache is emptied when it is full.
CACHE = 250_000
#: Characters of text that are turned into Python objects at once.
SLICE = 1_000_000

#: Characters other than ASCII and Latin letters up to U+017F; a text with one is split by the library.
_OTHER = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]")
#: Classes of bytes in all other texts: 0 white space, 1 letter, 2 digit, 3 anything else.
_CLASS = np.array([0 if b == 32 or 9 <= b <= 13 else 1 if b >= 128 or chr(b).isalpha() else 2 if 48 <= b <= 57 else 3 for b in range(256)], np.uint8)
#: Endings that stay with an apostrophe before them.
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")


def piece_starts(body: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces of byte-level BPE start, for texts end to end that start at ``heads`` and stop at ``ends``, none empty.

    A piece is a run of one class with the space before it, if there is one. Of a run of white space before other
    characters the last character is a piece of its own unless it is such a space. An apostrophe that starts a
    piece keeps an ending.
    """
    n = len(body)
    kind = _CLASS[body]
    first = np.ones(n + 1, bool)
    first[1:n] = kind[1:] != kind[:-1]
    first[heads] = True
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    starts = first[:n].copy()
    spaced = np.zeros(n, bool)
    spaced[1:] = (body[:-1] == 32) & (kind[1:] > 0) & ~head[1:n]
    starts &= ~(spaced & first[:n])
    last = np.flatnonzero((kind == 0) & first[1:] & ~head[1:])  # last of a run of white space, with more of its text behind
    starts[last] = True
    marks = np.flatnonzero((body == 39) & starts & first[:n])
    for ending in _ENDINGS:
        own = marks
        for k, letter in enumerate(ending, 1):
            own = own[own + k < n]
            own = own[(body[own + k] == letter) & ~head[own + k]]
        starts[own + 1] = False
        stop = own + 1 + len(ending)
        starts[stop[(stop < n)]] |= (kind[stop[stop < n]] > 0) | starts[stop[stop < n]]
    return np.flatnonzero(starts)


#: Pieces that are encoded in one call.
GROUP = 2000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class TreeBpe:
    """Exact encoder and decoder of one tokenizer file; ids are little-endian 32-bit integers in bytes."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE, threads: int = 2):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import Split

        spec = json.loads(open(path, encoding="utf-8").read())
        before = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("a byte-level BPE tokenizer without normalizer or prefix space is needed")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]):
            raise ValueError("added tokens must match literally")
        self.full = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.full.model)
        self.grouped = Tokenizer(self.full.model)
        self.letters = _byte_letters()
        self.grouped.pre_tokenizer = Split(self.letters[0], "isolated")
        self.zero = self.full.token_to_id(self.letters[0])
        back = {c: b for b, c in self.letters.items()}
        self.bytes_of = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in self.full.get_vocab(with_added_tokens=True).items()}
        self.added = {x["content"]: np.int32(x["id"]).tobytes() for x in spec["added_tokens"]}
        self.split_added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.leaf, self.most, self.threads = leaf, cache, threads
        self.cache: dict[str, bytes] = {}
        self.joins = 0

    # encoding

    def _spell(self, data: bytes) -> str:
        return data.decode("latin-1").translate(self.letters)

    def _one(self, data: bytes) -> list[int]:
        return self.bare.encode(self._spell(data), add_special_tokens=False).ids

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, c = left[-width:], right[:width]
            ids = self._one(b"".join(map(self.bytes_of.__getitem__, a + c)))
            agree_left = width >= len(left) or (ids[0] == a[0] and len(a) > 1)
            agree_right = width >= len(right) or (ids[-1] == c[-1] and len(c) > 1)
            if agree_left and agree_right:
                return left[: len(left) - len(a)] + ids + right[len(c) :]
            width *= 2

    def _tree(self, data: bytes) -> bytes:
        """Encode one piece that may be long."""
        cuts = [0, len(data)]
        while max(b - a for a, b in zip(cuts, cuts[1:])) > self.leaf:
            cuts = sorted({x for a, b in zip(cuts, cuts[1:]) for x in (a, (a + b) // 2, b)})
        leaves = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(leaves) > 1:
            with ThreadPoolExecutor(self.threads) as pool:
                level = list(pool.map(self._one, leaves))
        else:
            level = [self._one(data)]
        while len(level) > 1:
            level = [self._join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return np.asarray(level[0], np.int32).tobytes()

    def _library_starts(self, body: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As piece_starts, by the library's own splitting."""
        data, split, out = body.tobytes(), self.full.pre_tokenizer.pre_tokenize_str, []
        for a, b in zip(heads.tolist(), ends.tolist()):
            sizes = np.array([len(piece) for piece, _ in split(data[a:b].decode())], np.int64)
            out.append(a + np.cumsum(sizes) - sizes)
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _encode_new(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Short pieces go through the library in long strings, split at the letter of byte 0, which none of them has."""
        short = [x for x in new if len(x) <= self.leaf and b"\0" not in x]
        groups = [self._spell(b"\0".join(short[i : i + GROUP])) for i in range(0, len(short), GROUP)]
        made: list[bytes] = []
        for coded in self.grouped.encode_batch_fast(groups, add_special_tokens=False):
            ids = np.array(coded.ids, np.int32)
            body, start = ids.tobytes(), 0
            for stop in (np.flatnonzero(ids == self.zero) * 4).tolist():
                made.append(body[start:stop])
                start = stop + 4
            made.append(body[start:])
        out = dict(zip(short, made, strict=True))
        if len(self.cache) + len(out) > self.most:
            self.cache.clear()
        self.cache.update(out)
        return out | {x: self._tree(x) for x in new if x not in out}

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        get = self.cache.get
        coded = list(map(get, pieces))
        if missing := coded.count(None):
            at, holes = -1, []
            for _ in range(missing):
                at = coded.index(None, at + 1)
                holes.append(at)
            made = self._encode_new(list(dict.fromkeys([pieces[i] for i in holes])))
            for i in holes:
                coded[i] = made[pieces[i]]
        return coded

    def _coded(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Ids of the different pieces, and which of them each piece is."""
        if not len(starts):
            return [], np.zeros(0, np.int64)
        body = np.frombuffer(data, np.uint8)[starts[0] : stops[-1]].astype(np.uint64) + np.uint64(1)
        up, down = powers(len(body))
        sums = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(body * up, out=sums[1:])
        hashes = mix64((sums[stops - starts[0]] - sums[starts - starts[0]]) * down[starts - starts[0]])
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        return self._ids_of([data[i:j] for i, j in zip(starts[first].tolist(), stops[first].tolist())]), inverse

    def _cuts(self, body: np.ndarray, head: int, end: int) -> np.ndarray:
        """Where the leaves of a text begin and end: halves of halves, at characters' first bytes."""
        levels = max(0, -(-(end - head) // self.leaf) - 1).bit_length()
        cuts = head + (np.arange((1 << levels) + 1) * (end - head) >> levels)
        for _ in range(3):
            inner = cuts[1:-1]
            inner += body[inner] & 0xC0 == 0x80
        return cuts

    def _join_level(self, body: np.ndarray, mask: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, starts_of: Callable) -> None:
        """Join the halves [lo, mid) and [mid, hi): ``mask`` says where pieces start."""
        self.joins += len(lo)
        width = WIDTH
        while len(lo):
            starts = np.flatnonzero(mask)
            b = starts[np.searchsorted(starts, np.maximum(lo, mid - MARGIN), "right") - 1]
            e = np.minimum(hi, mid + width)
            for _ in range(3):
                e -= (e < hi) & (body[np.minimum(e, len(body) - 1)] & 0xC0 == 0x80)
            sizes = e - b
            ends = np.cumsum(sizes)
            heads = ends - sizes
            at = np.repeat(b - heads, sizes) + np.arange(int(ends[-1]))
            found = starts_of(body[at], heads, ends)
            owner = np.searchsorted(heads, found, "right") - 1
            found = at[found]
            agreed = np.where(e == hi, hi, -1)
            meets = np.flatnonzero((found >= mid[owner]) & (found <= e[owner] - MARGIN) & mask[found] & (agreed[owner] < 0))
            agreed[owner[meets[::-1]]] = found[meets[::-1]]  # the first one is written last
            done = agreed >= 0
            spans = (agreed - b)[done]
            mask[np.repeat(b[done] - (np.cumsum(spans) - spans), spans) + np.arange(int(spans.sum()))] = False
            mask[found[done[owner] & (found < agreed[owner])]] = True
            lo, mid, hi = lo[~done], mid[~done], hi[~done]
            width *= 2

    def _encode_trees(self, texts: list[str], starts_of: Callable) -> list[bytes]:
        """The ids of texts, none empty: leaves encoded, then joined level by level."""
        bodies = [x.encode() for x in texts]
        data = b"".join(bodies)
        body = np.frombuffer(data, np.uint8)
        ends = np.cumsum([len(x) for x in bodies])
        heads = ends - [len(x) for x in bodies]
        cuts = [self._cuts(body, a, b) for a, b in zip(heads.tolist(), ends.tolist())]
        leaf_heads, leaf_ends = np.concatenate([x[:-1] for x in cuts]), np.concatenate([x[1:] for x in cuts])
        leaf_starts = starts_of(body, leaf_heads, leaf_ends)
        leaf_stops = np.append(leaf_starts[1:], len(data))
        coded, leaf_code = self._coded(data, leaf_starts, leaf_stops)
        mask = np.zeros(len(data) + 1, bool)
        mask[leaf_starts] = True
        step = 1
        while cuts := [x for x in cuts if len(x) > step + 1]:
            lo, mid, hi = (np.concatenate([x[k::2 * step][: len(x) // (2 * step)] for x in cuts]) for k in (0, step, 2 * step))
            self._join_level(body, mask, lo, mid, hi, starts_of)
            step *= 2
        starts = np.flatnonzero(mask)
        stops = np.append(starts[1:], len(data))
        # pieces that no window changed keep their leaf's ids
        at = np.minimum(np.searchsorted(leaf_starts, starts), len(leaf_starts) - 1)
        same = (leaf_starts[at] == starts) & (leaf_stops[at] == stops)
        code = np.where(same, leaf_code[at], 0)
        more, new_code = self._coded_apart(data, starts[~same], stops[~same])
        code[~same] = new_code + len(coded)
        coded = coded + more
        sizes = np.array([len(x) for x in coded], np.int64) // 4
        flat = np.frombuffer(b"".join(coded), np.int32)
        lens = sizes[code]
        before = np.cumsum(lens) - lens
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - before, lens) + np.arange(int(lens.sum()))]
        cuts = np.append(before, len(ids))[np.searchsorted(starts, np.append(heads, len(data)))].tolist()
        out = ids.tobytes()
        return [out[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]

    def _coded_apart(self, data: bytes, starts: np.ndarray, stops: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """As _coded, for few pieces here and there."""
        pieces = [data[i:j] for i, j in zip(starts.tolist(), stops.tolist())]
        place = {x: k for k, x in enumerate(dict.fromkeys(pieces))}
        return self._ids_of(list(place)), np.array([place[x] for x in pieces], np.int64)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text. Collecting garbage among millions of short-lived strings would only cost time."""
        gc.disable()
        try:
            return self._encode_batch(texts)
        finally:
            gc.enable()

    def _encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, x in enumerate(texts) if x and not _OTHER.search(x) and not any(a in x for a in self.added)]
        if plain:
            for i, ids in zip(plain, self._encode_trees([texts[i] for i in plain], piece_starts)):
                out[i] = ids
        rest = [i for i in sorted({i for i, x in enumerate(texts) if x} - set(plain))]
        runs = [self.split_added.split(texts[i]) if self.split_added else [texts[i]] for i in rest]
        between = [run for own in runs for run in own[::2] if run]
        made = iter(self._encode_trees(between, self._library_starts) if between else [])
        for i, own in zip(rest, runs):
            out[i] = b"".join([self.added[run] if k % 2 else next(made) for k, run in enumerate(own) if run])
        return out

    # decoding

    def decode(self, ids: list[int]) -> str:
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


_encoders: dict[tuple, TreeBpe] = {}


def encoder(path: str, **options) -> TreeBpe:
    """One per worker process."""
    key = (path, *sorted(options.items()))
    if key not in _encoders:
        _encoders[key] = TreeBpe(path, **options)
    return _encoders[key]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the named strings of each hold about ``most`` bytes, one row at least."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers stay for later tasks


def _set(batch: pa.RecordBatch, name: str, values: pa.Array, schema: list[str]) -> pa.RecordBatch:
    columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {name: values}
    return pa.RecordBatch.from_arrays([columns[n] for n in schema], schema)


def _lists(coded: list[bytes]) -> pa.Array:
    starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _mapped(df: DataFrame, name: str, kind: T.DataType, work: Callable[[pa.RecordBatch], pa.Array], by: str) -> DataFrame:
    schema = T.StructType([x for x in df.schema.fields if x.name != name] + [T.StructField(name, kind)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, by) if by else batches:
            yield _set(batch, name, work(batch), names)

    return df.mapInArrow(run, schema)


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` with the ids of each text as an array of integers."""

    def work(batch: pa.RecordBatch) -> pa.Array:
        return _lists(encoder(path, leaf=leaf).encode_batch(batch.column(text_col).to_pylist()))

    return _mapped(docs, ids_col, T.ArrayType(T.IntegerType()), work, text_col)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text that its ids stand for, special tokens included; null ids count as none."""

    def work(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([encoder(path).decode(x.as_py() or []) for x in batch.column(ids_col)], pa.string())

    return _mapped(df, text_col, T.StringType(), work, "")


def bpe_round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", leaf: int = LEAF) -> DataFrame:
    """``docs`` with each text encoded, then decoded from the ids in the same pass; the decoded text replaces the text."""
    schema = T.StructType([x for x in docs.schema.fields if x.name != ids_col] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, leaf=leaf)
        for batch in slices(batches, text_col):
            coded = tree.encode_batch(batch.column(text_col).to_pylist())
            ids = _lists(coded)
            back = pa.array([tree.decode(array("i", x)) for x in coded], pa.string())
            yield _set(_set(batch, text_col, back, batch.schema.names), ids_col, ids, names)

    return docs.mapInArrow(run, schema)
