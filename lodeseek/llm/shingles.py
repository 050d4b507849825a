"""Sets of hashed word shingles, computed for whole Arrow columns at a time.

Words are runs of anything but ASCII white space, A-Z in lower case. A word's hash is a polynomial of its bytes
modulo 2**64, a shingle's a mix of its words' hashes. A text with fewer words than a shingle has its whole
sequence as one shingle; a text without words, or null, has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
#: Value of each byte: 0 for white space, else one more than the byte in lower case.
_VALUE = np.array([0 if b == 32 or 9 <= b <= 13 else (b + 32 if 65 <= b <= 90 else b) + 1 for b in range(256)], np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words start among them (one more entry at the end)."""
    texts = pc.cast(texts, pa.binary())
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(body):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    up, down = powers(len(body))
    values = _VALUE[body]
    inside = values > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    hashes = mix64(np.add.reduceat(values * up, starts) * down[starts]) if len(starts) else np.zeros(0, np.uint64)
    return hashes, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    runs = words[: max(0, len(words) - size + 1)].copy()
    for k in range(1, size):
        runs = mix64(runs * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(runs)])
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= size:
            out.append(np.unique(runs[lo : hi - size + 1]))
        elif hi > lo:
            whole = np.array([hi - lo], np.uint64)
            for k in range(lo, hi):
                whole = mix64(whole * np.uint64(0xA0761D6478BD642F) + words[k : k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
