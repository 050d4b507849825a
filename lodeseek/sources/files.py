"""Files to markdown text, by extension. Parsers use the standard library only; a failure is a column, not an exception."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.functions.text import slices

ROWS_PER_TABLE = 200
ENCODINGS = ("utf-8-sig", "utf-8", "gbk", "gb18030")


def decode(data: bytes) -> str:
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode(ENCODINGS[-1], "replace")


def cell(value: object) -> str:
    return re.sub(r"\s*\r?\n\s*", " ", str(value if value is not None else "")).replace("|", "\\|").strip()


def table(rows: list[list[object]], per: int = ROWS_PER_TABLE) -> str:
    """Markdown tables of a header row and at most ``per`` rows each."""
    rows = [[cell(x) for x in r] for r in rows if any(cell(x) for x in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    line = lambda r: "| " + " | ".join(r) + " |"
    body = rows[1:]
    return "\n\n".join("\n".join([line(rows[0]), line(["---"] * width), *map(line, body[i : i + per])]) for i in range(0, max(len(body), 1), per))


class _Markdown(HTMLParser):
    """Headings, paragraphs, lists, links, emphasis, code and tables with spans."""

    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "blockquote", "header", "footer", "main", "nav"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.pre = 0
        self.lists: list[list] = []
        self.links: list[tuple[str, int]] = []
        self.grid: list[list[tuple[str, int, int]]] | None = None
        self.cell: list[str] | None = None
        self.span = (1, 1)

    def put(self, text: str) -> None:
        (self.out if self.cell is None else self.cell).append(text)

    def close_cell(self) -> None:
        """End an open cell, whether or not its end tag was written."""
        if self.cell is not None and self.grid is not None:
            text, self.cell = "".join(self.cell), None
            if not self.grid:
                self.grid.append([])
            self.grid[-1].append((text, *self.span))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "template"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCKS:
            self.put("\n\n")
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
        elif tag == "li":
            own = self.lists[-1] if self.lists else ["ul", 0]
            own[1] += 1
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + (f"{own[1]}. " if own[0] == "ol" else "* "))
        elif tag == "br":
            self.put("\n")
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "a":
            self.put("[")
            self.links.append((a.get("href") or "", 0))
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "table":
            self.grid = []
        elif tag == "tr" and self.grid is not None:
            self.close_cell()
            self.grid.append([])
        elif tag in ("td", "th") and self.grid is not None:
            self.close_cell()
            self.cell, self.span = [], tuple(max(1, int(v)) if (v := a.get(k) or "1").isdigit() else 1 for k in ("rowspan", "colspan"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.put("\n\n")
            if tag in ("ul", "ol") and self.lists:
                self.lists.pop()
        elif tag in ("strong", "b"):
            self.put("**")
        elif tag in ("em", "i"):
            self.put("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag == "a" and self.links:
            self.put(f"]({self.links.pop()[0]})")
        elif tag in ("td", "th"):
            self.close_cell()
        elif tag == "table" and self.grid is not None:
            self.close_cell()
            grid, self.grid = expand(self.grid), None
            self.put("\n\n" + table(grid) + "\n\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def expand(grid: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Cells with row and column spans, repeated into every place they cover."""
    held: dict[tuple[int, int], str] = {}
    for i, row in enumerate(grid):
        j = 0
        for text, down, right in row:
            while (i, j) in held:
                j += 1
            for a in range(min(down, 1000)):
                for b in range(min(right, 1000)):
                    held[i + a, j + b] = text
            j += right
    rows = max((i for i, _ in held), default=-1) + 1
    return [[held.get((i, j), "") for j in range(max((b for a, b in held if a == i), default=-1) + 1)] for i in range(rows)]


def html_markdown(text: str) -> str:
    parser = _Markdown()
    parser.feed(text)
    parser.close()
    out = "\n".join(x.rstrip() if not x.strip() else x.rstrip() for x in "".join(parser.out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?m)^ +(?=[^ *\d])", "", out)).strip()


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _texts(root: ElementTree.Element, block: str, run: str) -> list[str]:
    ends = lambda tag, x: tag.rsplit("}", 1)[-1] == x
    return ["".join(t.text or "" for t in b.iter() if ends(t.tag, run)) for b in root.iter() if ends(b.tag, block)]


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(x for x in _texts(_xml(z, "word/document.xml"), "p", "t") if x.strip())


def pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        return "\n\n".join(f"## Slide {i}\n\n" + "\n".join(x for x in _texts(_xml(z, n), "p", "t") if x.strip()) for i, n in enumerate(slides, 1))


def xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = _texts(_xml(z, "xl/sharedStrings.xml"), "si", "t") if "xl/sharedStrings.xml" in names else []
        titles = [x.get("name") or "" for x in _xml(z, "xl/workbook.xml").iter() if x.tag.endswith("}sheet")]
        out = []
        for i, title in enumerate(titles, 1):
            rows = []
            for row in (x for x in _xml(z, f"xl/worksheets/sheet{i}.xml").iter() if x.tag.endswith("}row")):
                own: dict[int, str] = {}
                for c in (x for x in row if x.tag.endswith("}c")):
                    letters = re.sub(r"\d", "", c.get("r") or "")
                    at = 0
                    for letter in letters:
                        at = at * 26 + ord(letter) - 64
                    value = "".join(v.text or "" for v in c.iter() if v.tag.endswith(("}v", "}t")))
                    own[at or len(own) + 1] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append([own.get(j, "") for j in range(1, max(own, default=0) + 1)])
            out.append(f"## {title}\n\n{table(rows)}")
        return "\n\n".join(out)


def unzip(data: bytes) -> str:
    """Texts of a ZIP's .md and .txt entries; entries that would leave the folder, and all others, are passed over."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in sorted(z.namelist()):
            path = PurePosixPath(name.replace("\\", "/"))
            if not path.is_absolute() and ".." not in path.parts and ":" not in name and path.suffix.lower() in (".md", ".txt"):
                out.append(decode(z.read(name)))
    return "\n\n".join(out)


def read_csv_text(data: bytes) -> str:
    return table([r for r in csv.reader(io.StringIO(decode(data)))])


def _json(data: bytes) -> str:
    return json.dumps(json.loads(decode(data)), ensure_ascii=False, indent=2)


PARSERS: dict[str, Callable[[bytes], str]] = {
    ".txt": decode, ".md": decode, ".markdown": decode, ".json": _json, ".html": lambda b: html_markdown(decode(b)), ".htm": lambda b: html_markdown(decode(b)),
    ".csv": read_csv_text, ".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".zip": unzip,
}


def parse(files: DataFrame) -> DataFrame:
    """Files (path, content as bytes) to (path, markdown, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "content"):
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                work = PARSERS.get(PurePosixPath(path).suffix.lower())
                try:
                    if work is None:
                        raise ValueError("unsupported format")
                    text = work(bytes(data or b""))
                    if not text.strip():
                        raise ValueError("no text")
                    rows.append((path, text, None))
                except Exception as e:  # noqa: BLE001 - one bad file must not end the job; its error is kept
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:500]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["path", "markdown", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, markdown string, error string")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """All files of a folder, parsed."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder))


def pages_markdown(pages: DataFrame) -> DataFrame:
    """Pages (page_id, html) as markdown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            markdown = pa.array([html_markdown(x or "") for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), markdown], names=["page_id", "markdown"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, markdown string")


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items, one object a line: line_number, query, gold_chunk_ids, gold_answer, error."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter(F.trim("line") != "")
    item = F.from_json("line", "query string, gold_chunk_ids array<string>, gold_answer string, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    told = lines.select((F.col("n") + 1).alias("line_number"), item.alias("x"))
    error = F.when(F.col("x._corrupt").isNotNull(), "not a JSON object").when(F.coalesce(F.trim("x.query"), F.lit("")) == "", "query is missing")
    return told.select("line_number", "x.query", "x.gold_chunk_ids", "x.gold_answer", error.alias("error"))


def write_eval_jsonl(items: DataFrame, path: str) -> None:
    items.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
