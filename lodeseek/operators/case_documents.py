"""Case documents: what kind a file is, and chunkers for transcripts, chats, tables and sentences."""

from __future__ import annotations

import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.chunking import PRESETS, count_tokens, general, hard_split, pack

#: How kinds of documents are told by name and by content, in order; the first that fits holds. A caller's own table takes this one's place.
FORMATS = [
    ("csv", r"(?i)\.(csv|tsv)$", None),
    ("spreadsheet", r"(?i)\.(xlsx?|ods)$", None),
    ("transcript", r"(?i)transcript|笔录|讯问|询问", r"(?m)^\s*(?:问|Q)\s*[:：]"),
    ("chat", r"(?i)chat|私聊|群聊|聊天|微信", r"(?m)^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}[ T]\d{1,2}:\d{2}"),
]
GAP = timedelta(minutes=30)
# Columns of tables that are left out unless the caller names others.
DROPPED = ("lat", "lon", "latitude", "longitude", "经度", "纬度")


def kind_of(filename: Column, text: Column, formats: list[tuple[str, str | None, str | None]] = FORMATS) -> Column:
    """Kind of a document by ``formats`` (kind, pattern of the name, pattern of the content): by name first, then by content."""
    out = F.lit("general")
    for column, at in ((text, 2), (filename, 1)):
        for row in reversed(formats):
            if row[at]:
                out = F.when(F.coalesce(column, F.lit("")).rlike(row[at]), row[0]).otherwise(out)
    return out


def sentences(text: Column) -> Column:
    """Sentences of CJK and Latin text, paragraph by paragraph."""
    parts = F.split(text, r"\n+|(?<=[。！？；])|(?<=[.!?])\s+(?=[A-ZÀ-Þ一-鿿\"'(])")
    return F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != "")


_SIGNAL = re.compile(r"^\s*(姓名|性别|身份证号|案号|时间|地点|name|case|date|place)\s*[:：]\s*(\S.*)$", re.I)
_TURN = re.compile(r"^\s*(?:问|答|Q|A)\s*[:：]", re.I)
_ASK = re.compile(r"^\s*(?:问|Q)\s*[:：]", re.I)


def transcript(text: str, size: int = 400, **_) -> list[str]:
    """The header is a chunk; questions with their answers are packed, under the header's identity lines if it has two or more."""
    lines = text.split("\n")
    start = next((i for i, x in enumerate(lines) if _TURN.match(x)), len(lines))
    header = "\n".join(lines[:start]).strip()
    signals = [m[0].strip() for x in lines[:start] if (m := _SIGNAL.match(x))]
    prefix = "\n".join(signals) if len(signals) >= 2 else ""
    turns: list[str] = []
    for x in lines[start:]:
        if _ASK.match(x) or not turns:
            turns.append(x)
        else:
            turns[-1] += "\n" + x
    room = max(1, size - count_tokens(prefix))
    body = [f"{prefix}\n{x}" if prefix else x for x in pack([t for t in turns if t.strip()], room)]
    return ([header] if header else []) + body


_STAMPS = (
    (re.compile(r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})[ T](\d{1,2}):(\d{2})(?::(\d{2}))?"), "day"),
    (re.compile(r"^\s*(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{2})(?::(\d{2}))?"), "day"),
    (re.compile(r"^\s*\[?(\d{1,2}):(\d{2})(?::(\d{2}))?\]?\s"), "time"),
)


def stamp(line: str, day: datetime | None = None) -> datetime | None:
    """Time at a line's start; a time of day belongs to the day given."""
    for pattern, kind in _STAMPS:
        if m := pattern.match(line):
            parts = [int(x or 0) for x in m.groups()]
            try:
                if kind == "day":
                    return datetime(*parts)
                base = day or datetime(1900, 1, 1)
                return base.replace(hour=parts[0], minute=parts[1], second=parts[2], microsecond=0)
            except ValueError:
                return None
    return None


def chat(text: str, size: int = 400, gap: timedelta = GAP, **_) -> list[str]:
    """Messages by session: a new one after a gap or where time goes back; each chunk is headed by its time range."""
    messages: list[tuple[datetime | None, str]] = []
    day = None
    for line in text.split("\n"):
        at = stamp(line, day)
        if at or not messages:
            day = at or day
            messages.append((at, line))
        elif line.strip():
            messages[-1] = (messages[-1][0], messages[-1][1] + "\n" + line)
    sessions: list[list[tuple[datetime | None, str]]] = []
    last = None
    for at, body in messages:
        if not sessions or (at and last and not timedelta(0) <= at - last <= gap):
            sessions.append([])
        sessions[-1].append((at, body))
        last = at or last
    out = []
    for own in sessions:
        times = [t for t, _ in own if t]
        head = f"[{times[0]:%Y-%m-%d %H:%M} - {times[-1]:%Y-%m-%d %H:%M}]\n" if times else ""
        out += [head + x for x in pack([b for _, b in own if b.strip()], size)]
    return out


def csv_table(text: str, size: int = 400, drop: tuple[str, ...] = DROPPED, **_) -> list[str]:
    """Rows of markdown tables as ``column：value；`` records under the list of columns, without those to be dropped."""
    rows = [[x.strip() for x in re.split(r"(?<!\\)\|", line.strip().strip("|"))] for line in text.split("\n") if line.strip().startswith("|")]
    rows = [r for r in rows if not all(re.fullmatch(r":?-+:?", x) for x in r)]
    if len(rows) < 2:
        return general(text, size)
    header = rows[0]
    kept = [i for i, name in enumerate(header) if name.strip().lower() not in drop]
    records = ["".join(f"{header[i]}：{r[i]}；" for i in kept if i < len(r) and r[i]) for r in rows[1:] if r != header]
    head = "、".join(header[i] for i in kept)
    return [f"{head}\n{x}" for x in pack([r for r in records if r], max(1, size - count_tokens(head)))]


# Families of numbered headings, the highest level first.
BULLETS = {
    "articles": [
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ],
    "decimal": [
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{,2}[\. 、]",
        r"[0-9]{,2}\.[0-9]{,2}[^a-zA-Z/%~-]",
        r"[0-9]{,2}\.[0-9]{,2}\.[0-9]{,2}",
        r"[0-9]{,2}\.[0-9]{,2}\.[0-9]{,2}\.[0-9]{,2}",
    ],
    "han": [
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{,2}[\)）]",
    ],
    "english": [
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ],
    "markdown": [
        r"^#[^#]",
        r"^##[^#]",
        r"^###.*",
        r"^####.*",
        r"^#####.*",
        r"^######.*",
    ],
}


def bullet_family(lines: list[str]) -> str | None:
    """The family most lines are headed by; long lines that end like sentences count half. All lines vote."""
    votes: Counter[str] = Counter()
    for line in map(str.strip, lines):
        for family, patterns in BULLETS.items():
            if any(re.match(p, line) for p in patterns):
                votes[family] += 1 if len(line) <= 60 and not line.endswith(("。", ".", "；", ";")) else 0.5
    return max(sorted(votes), key=votes.__getitem__) if votes else None


# Titles of tables of contents, without white space.
_CONTENTS = re.compile(r"(contents|目录|目次|tableofcontents|致谢|acknowledge)$", re.I)


def without_contents(lines: list[str]) -> list[str]:
    """Lines without a table of contents: from its heading to where its first entry comes again."""
    out, i = [], 0
    while i < len(lines):
        if _CONTENTS.match(re.sub(r"\s+", "", lines[i])):
            first = next((x.strip() for x in lines[i + 1 :] if x.strip()), "")
            key = re.sub(r"[\s.·…\d]+$", "", first)[:12]
            again = next((j for j in range(i + 2, len(lines)) if key and lines[j].strip().startswith(key) and lines[j].strip() != first), None)
            again = again or next((j for j in range(i + 2, len(lines)) if key and lines[j].strip().startswith(key)), None)
            if again:
                i = again
                continue
        out.append(lines[i])
        i += 1
    return out


def tree(text: str, size: int = 1024, depth: int = 5, **_) -> list[str]:
    """Sections of numbered headings under their ancestors' titles; without headings, packed lines."""
    lines = without_contents(text.split("\n"))
    family = bullet_family(lines)
    if not family:
        return general("\n".join(lines), size, 0.0)
    path: list[tuple[int, str]] = []
    out: list[str] = []
    body: list[str] = []

    def close() -> None:
        if "".join(body).strip():
            head = "\n".join(t for _, t in path)
            out.extend(f"{head}\n{x}" if head else x for x in pack(body, max(1, size - count_tokens(head))))
        body.clear()

    for line in lines:
        level = next((k for k, p in enumerate(BULLETS[family][:depth]) if re.match(p, line.strip())), None)
        if level is None:
            body.append(line)
        else:
            close()
            path[:] = [x for x in path if x[0] < level] + [(level, line.strip())]
    close()
    return out or general(text, size, 0.0)


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clusters by mean cosine distance, cut at the threshold; for the sentences of one document."""
    m = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - m @ m.T
    np.fill_diagonal(d, np.inf)
    label, size = np.arange(len(m)), np.ones(len(m))
    while len(m) > 1:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] <= threshold:
            break
        merged = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[j], d[:, j], d[i, i] = np.inf, np.inf, np.inf
        size[i] += size[j]
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def silhouette(vectors: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance; 0 for one cluster."""
    if len(set(labels.tolist())) < 2:
        return 0.0
    m = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    d = 1 - m @ m.T
    scores = []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(m)) != i)
        if not same.any():
            scores.append(0.0)
            continue
        a = d[i, same].mean()
        b = min(d[i, labels == x].mean() for x in set(labels.tolist()) - {own})
        scores.append((b - a) / max(a, b, 1e-12))
    return float(np.mean(scores))


def hashed_vector(text: str, size: int = 64) -> np.ndarray:
    """Stand-in for a sentence's embedding: counts of character codes, normed."""
    v = np.bincount([ord(c) % size for c in text] or [0], minlength=size).astype(float) * bool(text)
    return v / max(np.linalg.norm(v), 1e-12)


def semantic(text: str, size: int = 400, threshold: float = 0.35, embed=hashed_vector, **_) -> list[str]:
    """Sentences in order, cut where the cluster of their vectors changes or the chunk is full."""
    own = [x.strip() for x in re.split(r"\n+|(?<=[。！？；])|(?<=[.!?])\s+", text) if x.strip()]
    out: list[str] = []
    for start in range(0, len(own), 512):  # clusters are sought among neighbours; every sentence is in one block
        block = own[start : start + 512]
        labels = average_linkage(np.array([embed(x) for x in block]), threshold)
        held: list[str] = []
        for i, x in enumerate(block):
            if held and (labels[i] != labels[i - 1] or count_tokens(" ".join(held)) + count_tokens(x) > size):
                out.append(" ".join(held))
                held = []
            held += hard_split(x, size) if count_tokens(x) > size else [x]
        if held:
            out.append(" ".join(held))
    return [y for x in out for y in (hard_split(x, size) if count_tokens(x) > size else [x])]


PRESETS |= {"transcript": transcript, "chat": chat, "csv": csv_table, "spreadsheet": csv_table, "book": tree, "clusters": semantic}


def case_document(docs: DataFrame) -> DataFrame:
    """Documents (file_id, filename, content) with the preset their kind takes."""
    return docs.withColumn("preset", kind_of(F.col("filename"), F.col("content")))
