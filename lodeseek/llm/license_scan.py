"""License notices, exact phrases and fuzzy notices with their spans.

Texts are brought to words of letters, digits and non-ASCII bytes in lower case, joined by single spaces. Exact
phrases are found word by word. A notice of m characters may differ by e edits: cut into e + 1 parts, one part at
least must then stand unchanged. One Aho-Corasick pass finds all parts of all notices; each hit names the few words at
which the notice can begin, and the regex library's bounded-error matching settles edits and end for each of them, for
spans of whole words. Of spans of one notice that overlap, the one with the fewest edits stays, then the first.

Phrases and notices are arguments; those given here are common public ones.

Defined cases: a null or empty text has no words and no labels; overlapping places of exact phrases all count; rows that repeat are
judged alike; other columns pass through, and columns named like a result are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodeseek.llm.bpe import slices

# Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Short public notices and their labels.
NOTICES = {
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "licensed under the apache license version 2 0": "apache",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "released under the mit license": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products": "bsd-3-clause",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "subject to the terms of the mozilla public license": "mpl",
    "made available under the terms of the eclipse public license": "epl",
    "licensed under a creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "waived all copyright and related or neighboring rights": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "boost software license version 1 0": "bsl-1.0",
    "this software is provided as is without any express or implied warranty": "zlib",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
}
#: One edit is allowed for so many characters of a notice.
CHARACTERS_PER_EDIT = 12
GRAM = 4
#: Words consist of these bytes, A-Z in lower case; all else separates.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal(text: str | None) -> tuple[str, int]:
    """Words between single spaces (one character for each byte), and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, per_edit: int = CHARACTERS_PER_EDIT):
        import ahocorasick
        import regex

        self.phrases = phrases
        self.notices = []
        parts: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, label) in enumerate(notices.items()):
            edits = len(notice) // per_edit
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                parts.setdefault(notice[a:b], []).append((k, a))
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={edits}}}(?= )")
            self.notices.append((notice, label, edits, pattern))
        # e edits break at most GRAM * e of a notice's character n-grams; where more are missing there is no match
        grams = [[notice[i : i + GRAM] for i in range(len(notice) - GRAM + 1)] for notice, *_ in self.notices]
        self.grams = [(own, len(own) - GRAM * edits) for own, (_, _, edits, _) in zip(grams, self.notices)]
        self.finder = ahocorasick.Automaton()
        for part, uses in parts.items():
            self.finder.add_word(part, (len(part), uses))
        self.finder.make_automaton()

    def exact(self, text: str) -> list[tuple[str, int]]:
        """(label, first word) of every exact phrase, on normal text."""
        out = []
        for phrase, label in self.phrases.items():
            at, seen, word, sought = -1, 0, 0, f" {phrase} "
            while (at := text.find(sought, at + 1)) >= 0:
                word += text.count(" ", seen, at)
                seen = at
                out.append((label, word))
        return out

    def _begins(self, text: str) -> dict[int, set[int]]:
        """Where notices can begin: words' first characters, by notice."""
        out: dict[int, set[int]] = {}
        for end, (size, uses) in self.finder.iter(text):
            for k, offset in uses:
                edits = self.notices[k][2]
                at = end + 1 - size - offset
                space = text.find(" ", max(0, at - edits - 1), at + edits)
                while space >= 0:
                    out.setdefault(k, set()).add(space + 1)
                    space = text.find(" ", space + 1, at + edits)
        return out

    def fuzzy(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(label, first word, last word, edits, likeness) of notices within their edits, on normal text."""
        found = []
        for k, begins in self._begins(text).items():
            notice, label, edits, pattern = self.notices[k]
            grams, least = self.grams[k]
            own = []
            for a in begins:
                near = text[a : a + len(notice) + edits]
                if sum(gram in near for gram in grams) >= least and (m := pattern.match(text, a)) and m.end() > a:
                    own.append((sum(m.fuzzy_counts), a, m.end()))
            taken: list[tuple[int, int]] = []  # in order of their places
            for wrong, a, b in sorted(own):
                i = bisect(taken, (a, b))
                if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
                    taken.insert(i, (a, b))
                    found.append((a, b, label, wrong, 1 - wrong / len(notice)))
        out, word, seen = [], 0, 1  # character 1 begins word 0
        for a, b, label, wrong, likeness in sorted(found):
            word += text.count(" ", seen, a)
            seen = a
            out.append((label, word, word + text.count(" ", a, b), wrong, likeness))
        return out


_scanners: dict[str, Scanner] = {}


def _scanner(*table) -> Scanner:
    """One per table and worker process."""
    key = repr(table)
    if key not in _scanners:
        _scanners[key] = Scanner(*table)
    return _scanners[key]


def license_scan(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, per_edit: int = CHARACTERS_PER_EDIT) -> DataFrame:
    """``docs`` with n_words, places (label, word) of exact phrases, and spans (label, first_word, last_word, edits, likeness) of fuzzy notices."""
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
    span = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("likeness", T.DoubleType())])
    more = [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)), T.StructField("spans", T.ArrayType(span))]
    fields = [x for x in docs.schema.fields if x.name not in {m.name for m in more}]
    place_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64()), ("likeness", pa.float64())]))
    names, kept = [x.name for x in fields + more], [x.name for x in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(phrases, notices, per_edit)
        for batch in slices(batches, text_col):
            counts, places, spans = [], [], []
            for text in batch.column(text_col).to_pylist():
                text, n = normal(text)
                counts.append(n)
                places.append([{"label": a, "word": b} for a, b in scanner.exact(text)])
                spans.append([{"label": a, "first_word": b, "last_word": c, "edits": d, "likeness": e} for a, b, c, d, e in scanner.fuzzy(text)])
            columns = [batch.column(n) for n in kept] + [pa.array(counts, pa.int64()), pa.array(places, place_type), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, T.StructType(fields + more))
