"""Text columns: token counts, exact identifiers, query terms, hashes."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as a token, and the patterns of exact identifiers and query terms.
TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"
_PHONE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
_ID_CARD = r"(?<!\d)\d{17}[0-9Xx](?!\d)"
_QUOTED = r"([\"'「『“])((?:(?!\1)[^\"'」』”]){2,30})\1"
_CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9\-_]{2,}"
_SEGMENT = r"[A-Za-z0-9]+|[一-鿿]+"
# Instruction words that carry no meaning in a query.
NOISE_WORDS = ("知识库", "帮我", "请问", "请", "告诉我", "查询一下", "查询", "查一下", "查下", "搜一下", "搜索一下", "搜索", "查找一下", "查找", "找一下", "找出", "一下", "所有", "全部", "相关", "有关", "里面", "文档", "文件", "资料")


def token_count(text: Column) -> Column:
    """Words and CJK characters; 1 at least unless blank."""
    n = F.regexp_count(text, F.lit(TOKEN))
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?U)\S"), F.greatest(n, F.lit(1))).otherwise(0)


def _identifies(token: Column) -> Column:
    return token.rlike(r"\d") & (token.rlike(r"(?U)\p{L}") | (F.length(token) >= 5))


def exact_tokens(text: Column, limit: int = 4) -> Column:
    """Phone numbers, ID cards, quoted identifiers, then other identifiers; what an earlier kind consumed is masked for later ones."""
    text = F.coalesce(text, F.lit(""))
    found = lambda x, pattern, group: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    quoted = F.filter(F.transform(found(text, _QUOTED, 2), lambda t: F.btrim(t)), _identifies)
    rest = F.regexp_replace(F.regexp_replace(text, _PHONE, "\u0001"), _ID_CARD, "\u0001")
    # quotes that hold an identifier consume their content, others do not
    rest = F.regexp_replace(rest, r"([\"'「『“])(?=(?:(?!\1)[^\"'」』”])*\d)((?:(?!\1)[^\"'」』”]){2,30})\1", "\u0001")
    other = F.filter(F.transform(found(rest, _CANDIDATE, 0), lambda t: F.btrim(t, F.lit("-_"))), _identifies)
    return F.slice(F.array_distinct(F.concat(found(text, _PHONE, 0), found(text, _ID_CARD, 0), quoted, other)), 1, limit)


def strip_noise(text: Column, words: Sequence[str] = NOISE_WORDS) -> Column:
    """Remove instruction words, longest first, and squeeze white space."""
    pattern = "|".join(sorted(words, key=len, reverse=True))
    return F.btrim(F.regexp_replace(F.regexp_replace(text, pattern, " "), r"(?U)\s+", " "))


def segments(text: Column) -> Column:
    """Runs of letters and digits, or of CJK characters, of length 2 or more."""
    return F.filter(F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0)), lambda t: F.length(t) >= 2)


def query_analysis(text: Column, limit: int = 4) -> Column:
    """Struct (phrase, exact, terms)."""
    exact, phrase = exact_tokens(text, limit), strip_noise(F.coalesce(text, F.lit("")))
    lowered = F.transform(exact, F.lower)
    terms = F.slice(F.array_distinct(F.filter(segments(phrase), lambda t: ~F.array_contains(lowered, F.lower(t)))), 1, limit)
    return F.struct(phrase.alias("phrase"), exact.alias("exact"), terms.alias("terms"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term stands in a text, not overlapping."""
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("long")


def citation(kb: Column, file: Column, chunk: Column) -> Column:
    """Address of a chunk, percent-encoded."""
    encoded = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("kb://"), encoded(kb), F.lit("/"), encoded(file), F.lit("?chunk="), encoded(chunk))


def table_cell(text: Column) -> Column:
    """A cell of a markdown table."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\|", r"\\\\|"), r"\r?\n", " "))


_GRAMS = re.compile("[一-鿿]|[a-zA-Z0-9]+")


@lru_cache(1 << 16)
def _digest(gram: str) -> bytes:
    return hashlib.md5(gram.encode()).digest()[:8]


@F.pandas_udf(T.LongType())
def simhash64(texts: pd.Series) -> pd.Series:
    """64-bit SimHash of CJK characters and of bigrams of alphanumeric runs, as a signed long; null counts as empty."""

    def one(text: str | None) -> int:
        squeezed = "".join((text or "").split())
        grams: Counter[str] = Counter()
        for run in _GRAMS.findall(squeezed):
            grams.update([run] if len(run) == 1 else map("".join, zip(run, run[1:])))
        if not grams:
            grams[squeezed[:16] or "<empty>"] = 1
        bits = np.unpackbits(np.frombuffer(b"".join(map(_digest, grams)), np.uint8)).reshape(len(grams), 64)
        votes = (2 * bits.astype(np.int64) - 1).T @ np.fromiter(grams.values(), np.int64, len(grams))
        return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)

    return texts.map(one)


#: Bytes of text that a Python step turns into objects at a time.
SLICE = 1 << 21


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the named strings of each hold about ``most`` bytes, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers stay for later tasks
