"""Documents to chunks. Folds over a text's pieces run per document inside Arrow batches; plain splits stay columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import slices

_TOKEN = re.compile(r"[A-Za-z0-9_]+|[一-鿿]")
SCHEMA = "file_id string, chunk_id string, chunk_index int, content string, start int, stop int, n_tokens int"
_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int32()) for c in SCHEMA.split(", ")])
DEFAULT_TOKENS, DEFAULT_OVERLAP = 1200, 0.15


def count_tokens(text: str) -> int:
    n = sum(1 for _ in _TOKEN.finditer(text))
    return max(n, 1) if text.strip() else 0


def hard_split(text: str, size: int) -> list[str]:
    """Cut at the start of every size-th token."""
    starts = [m.start() for m in _TOKEN.finditer(text)]
    cuts = [0, *starts[size::size], len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:]) if text[a:b].strip()]


def pack(pieces: list[str], size: int, overlap: float = 0.0, joint: str = "\n") -> list[str]:
    """Greedy packing of pieces to at most ``size`` tokens; a new chunk begins with the last share of the one before, from a line's start."""
    out: list[str] = []
    held, n = "", 0
    for piece in pieces:
        for part in hard_split(piece, size) if count_tokens(piece) > size else [piece]:
            cost = count_tokens(part)
            if held and n + cost > size:
                out.append(held)
                tail = held[len(held) - int(len(held) * overlap) :] if overlap else ""
                tail = tail[tail.find("\n") + 1 :] if "\n" in tail else tail
                held, n = tail, count_tokens(tail)
                if n + cost > size:
                    held, n = "", 0
            held, n = (held + joint + part if held else part), n + cost
    if held.strip():
        out.append(held)
    return out


def general(text: str, size: int = DEFAULT_TOKENS, overlap: float = DEFAULT_OVERLAP, delimiter: str = "\n") -> list[str]:
    return pack([x for x in text.split(delimiter) if x.strip()], size, overlap, delimiter)


def separator(text: str, size: int = DEFAULT_TOKENS, delimiter: str = "\n\n") -> list[str]:
    return [part for x in text.split(delimiter) if x.strip() for part in (hard_split(x, size) if count_tokens(x) > size else [x])]


_QUESTION = re.compile(r"^\s*(?:Q|问|Question|问题)\s*[:：.]\s*", re.I)
_ANSWER = re.compile(r"^\s*(?:A|答|Answer|回答)\s*[:：.]\s*", re.I)


def qa(text: str, **_) -> list[str]:
    """Question and answer lines by prefix; without any, lines are paired two by two. Repeated pairs go."""
    pairs: list[list[str]] = []
    lines = [x for x in text.split("\n") if x.strip()]
    if any(_QUESTION.match(x) for x in lines):
        for x in lines:
            if _QUESTION.match(x):
                pairs.append([_QUESTION.sub("", x), ""])
            elif pairs:
                pairs[-1][1] += ("\n" if pairs[-1][1] else "") + _ANSWER.sub("", x)
    else:
        pairs = [[a, b] for a, b in zip(lines[::2], lines[1::2])]
    return list(dict.fromkeys(f"{q.strip()}\n{a.strip()}" for q, a in pairs if q.strip() and a.strip()))


_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")


def sections(text: str, size: int = DEFAULT_TOKENS, **_) -> list[str]:
    """Markdown sections under the path of their headings; code fences do not open sections."""
    out, path, body, fenced = [], [], [], False

    def close() -> None:
        if any(x.strip() for x in body):
            head = " → ".join(fold([t for _, t in path]))
            room = max(1, size - count_tokens(head))
            out.extend(f"{head}\n{part}" if head else part for part in pack(["\n".join(body)], room))
        body.clear()

    for line in text.split("\n"):
        fenced ^= line.lstrip().startswith("```")
        m = None if fenced else _HEADING.match(line)
        if m:
            close()
            level = len(m[1])
            path[:] = [x for x in path if x[0] < level] + [(level, m[2])]
        else:
            body.append(line)
    close()
    return out


def fold(path: list[str], most: int = 4) -> list[str]:
    """A long path as its first part, an ellipsis and its end."""
    return path if len(path) <= most else [path[0], "…", *path[-(most - 2) :]]


_ARTICLE = re.compile(r"^\s*(?:第[一二三四五六七八九十百千零0-9]+条|Article\s+\d+|Section\s+\d+|§\s*\d+)", re.I)


def laws(text: str, size: int = 1024, **_) -> list[str]:
    """One chunk for each article, after what stands before the first."""
    parts: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _ARTICLE.match(line):
            parts.append([])
        parts[-1].append(line)
    return [x for part in parts if "".join(part).strip() for x in pack(["\n".join(part)], size)]


PRESETS: dict[str, Callable[..., list[str]]] = {"general": general, "separator": separator, "qa": qa, "semantic": sections, "book": sections, "laws": laws}


def chunk(docs: DataFrame, preset: str = "general", **params) -> DataFrame:
    """Documents (file_id, content) to chunk rows with their spans; an unknown preset is ``general``."""
    work = PRESETS.get(preset, general)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            rows = []
            for file_id, text in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist()):
                seen = 0
                for i, part in enumerate(work(text or "", **params)):
                    part = part.strip()
                    if part:
                        at = (text or "").find(part, seen)
                        if at >= 0:
                            seen = at + 1
                        rows.append((file_id, f"{file_id}_{i}", i, part, at if at >= 0 else None, at + len(part) if at >= 0 else None, count_tokens(part)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW.types)], schema=_ARROW)

    return docs.select(F.col("file_id").cast("string").alias("file_id"), F.col("content").cast("string").alias("content")).mapInArrow(run, SCHEMA)


def qa_pairs(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) to pairs of a user's turn and the assistant's next one."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("next_role", F.lead("role").over(order)).withColumn("answer", F.lead("text").over(order))
    return paired.filter("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")
