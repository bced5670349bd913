"""File scans and parsers: files of a directory become one stream of blocks per document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexatlas.work import settled

from lexatlas.schema import BLOCK_DDL

#: File types by their endings.
MARKDOWN, PDF, HTML, DOCX = ("md", "markdown", "txt"), ("pdf",), ("html", "htm"), ("docx",)
SUFFIXES = MARKDOWN + PDF + HTML + DOCX


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, sha256) of every file under ``path`` that can be parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = files.where(suffix(F.col("path")).isin(*SUFFIXES))
    return known.select("path", "content", F.sha2("content", 256).alias("sha256"))


# ---------------------------------------------------------------- markdown, all native

#: The line forms of Markdown that are told apart.
HEADING, TABLE_ROW, LIST_ITEM = r"^(#{1,6})\s+(.+?)\s*#*\s*$", r"^\s*\|.*\|\s*$", r"^\s*(?:[-*+]|\d+[.)])\s+"


def markdown_blocks(documents: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """Blocks of Markdown or plain texts: headings, runs of table rows, list items, and paragraphs of joined lines."""
    lines = documents.select(F.col(document).alias("document"), F.posexplode(F.split(F.col(text), r"\r?\n|\r")).alias("n", "raw")).withColumn("line", F.rtrim("raw"))
    line = F.col("line")
    form = F.when(line.rlike(TABLE_ROW), "table").when(line.rlike(HEADING), "heading").when(line.rlike(LIST_ITEM), "list-item").when(F.trim("line") == "", "blank").otherwise("paragraph")
    lines = lines.withColumn("form", form)
    w = W.partitionBy("document").orderBy("n")
    # a run goes on while its form does; headings and items stand alone, and an item takes no further lines
    starts = (F.col("form") != F.coalesce(F.lag("form").over(w), F.lit(""))) | F.col("form").isin("heading", "list-item")
    runs = lines.withColumn("run", F.sum(starts.cast("int")).over(w)).where("form != 'blank'")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.trim(x["line"]))
    made = runs.groupBy("document", "run", "form").agg(F.array_join(parts, "\n").alias("rows"), F.array_join(parts, " ").alias("joined"))
    body = F.when(F.col("form") == "table", F.col("rows")).when(F.col("form") == "heading", F.regexp_extract("joined", HEADING, 2)).otherwise(F.col("joined"))
    level = F.when(F.col("form") == "heading", F.length(F.regexp_extract("joined", HEADING, 1)))
    order = W.partitionBy("document").orderBy("run")
    return made.select("document", (F.row_number().over(order) - 1).cast("int").alias("ord"), F.col("form").alias("kind"), body.alias("text"), F.lit(None).cast("int").alias("page"), level.cast("int").alias("level"), F.lit(None).cast("double").alias("font_size"), F.lit(False).alias("bold"))


# ---------------------------------------------------------------- HTML

_SKIPPED = {"nav", "header", "footer", "script", "style"}


class _Page(HTMLParser):
    """Collects blocks in document order; skipped elements and all they hold are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.open: list[list] = []
        self.skipping = 0
        self.rows: list[list[str]] | None = None
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIPPED:
            self.skipping += 1
        elif not self.skipping:
            if re.fullmatch("h[1-6]|p|li", tag):
                if tag == "p":
                    self._close("p")
                kind = {"p": "paragraph", "li": "list-item"}.get(tag, "heading")
                block = [kind, [], int(tag[1]) if kind == "heading" else None, tag]
                self.blocks.append(block)
                self.open.append(block)
            elif tag == "table":
                block = ["table", [], None, tag]
                self.blocks.append(block)
                self.rows = []
            elif tag == "tr" and self.rows is not None:
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cell = []

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][3] == tag:
                del self.open[i]
                break

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif not self.skipping:
            if tag in ("td", "th") and self.cell is not None and self.rows:
                self.rows[-1].append("".join(self.cell).strip())
                self.cell = None
            elif tag == "table" and self.rows is not None:
                table = next(b for b in reversed(self.blocks) if b[3] == "table" and not b[1])
                table[1] = [pipe_table(self.rows)]
                self.rows = None
            else:
                self._close(tag)

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        for block in self.open:
            block[1].append(data.strip())
        if self.cell is not None:
            self.cell.append(data.strip())


def pipe_table(rows: list[list[str]]) -> str:
    """Rows of cells as a Markdown table, the first as its head."""
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    if rows:
        lines.insert(1, "|" + "---|" * len(rows[0]))
    return "\n".join(lines)


def parse_html(html: str) -> list[tuple[str, str, int | None]]:
    """(kind, text, level) in order; empty paragraphs are left out."""
    page = _Page()
    page.feed(html)
    page.close()
    found = [(kind, "".join(parts), level) for kind, parts, level, _ in page.blocks]
    return [b for b in found if b[1] or b[0] != "paragraph"]


# ---------------------------------------------------------------- DOCX

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> list[tuple[str, str, int | None]]:
    """(kind, text, level): paragraphs by style, tables where they stand in the document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                n = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = n.get(f"{_W}val") if n is not None else ""
    words = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    out: list[tuple[str, str, int | None]] = []
    for e in body if body is not None else []:
        if e.tag == f"{_W}p" and words(e):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            ident = style.get(f"{_W}val") if style is not None else ""
            name = names.get(ident, ident) or ""
            m = re.match(r"(?i)heading ?(\d)", name)
            if m:
                out.append(("heading", words(e), int(m.group(1))))
            else:
                out.append(("list-item" if name.lower().startswith("list") else "paragraph", words(e), None))
        elif e.tag == f"{_W}tbl":
            out.append(("table", pipe_table([[words(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]), None))
    return out


# ---------------------------------------------------------------- PDF

LINE_DDL = "document string, page int, n int, text string, size double, bold boolean, is_table boolean"


def pdf_lines(files: DataFrame) -> DataFrame:
    """Lines and tables of PDF files, with the largest font size and whether any part is bold, and for each page a row without text,
    so that pages without lines are seen. A file that can't be read has one row, without a page, that holds the error as its text. Needs PyMuPDF on executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import fitz
        except ImportError:
            raise ValueError("PDF files need PyMuPDF") from None
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    pages = list(fitz.open(stream=content, filetype="pdf"))
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}", None, False, False))
                    continue
                for number, page in enumerate(pages, 1):
                    rows.append((path, number, -1, None, None, False, False))
                    n = 0
                    for block in page.get_text("dict")["blocks"]:
                        for line in block.get("lines", []):
                            text = "".join(s["text"] for s in line["spans"]).strip()
                            if text:
                                rows.append((path, number, n, text, max(s["size"] for s in line["spans"]), any(s["flags"] & 16 for s in line["spans"]), False))
                                n += 1
                    for table in page.find_tables().tables:
                        rows.append((path, number, n, pipe_table([[str(c or "").strip() for c in r] for r in table.extract()]), None, False, True))
                        n += 1
            yield pd.DataFrame(rows, columns=["document", "page", "n", "text", "size", "bold", "is_table"]).astype({"page": "Int32", "n": "Int32"})

    return files.mapInPandas(run, LINE_DDL)


def without_running_lines(lines: DataFrame, times: int = 3, longest: int = 80, pages: int = 3) -> DataFrame:
    """Lines without headers and footers: short texts that occur ``times`` times in a document of so many pages."""
    known = lines.where(~F.col("is_table"))
    long_enough = lines.groupBy("document").agg(F.max("page").alias("last")).where(F.col("last") >= pages).select("document")
    running = known.where(F.length("text") < longest).groupBy("document", "text").count().where(F.col("count") >= times).join(long_enough, "document", "left_semi").select("document", "text")
    return known.join(running, ["document", "text"], "left_anti").unionByName(lines.where("is_table"))


def body_sizes(lines: DataFrame, default: float = 10.0) -> DataFrame:
    """(document, body): the commonest font size, rounded to a tenth."""
    counted = lines.where("size is not null").groupBy("document", F.round("size", 1).alias("s")).count()
    most = counted.groupBy("document").agg(F.max_by("s", F.struct("count", -F.col("s"))).alias("body"))
    return lines.select("document").distinct().join(most, "document", "left").select("document", F.coalesce("body", F.lit(default)).alias("body"))


def scanned(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(document, error) of documents of which less than ``share`` of the pages have text. ``lines`` are as :func:`pdf_lines` makes them, and
    a document without pages is one of these, too."""
    pages = lines.where("page is not null").groupBy("document", "page").agg(F.max(F.col("text").isNotNull().cast("int")).alias("has"))
    seen = pages.groupBy("document").agg(F.avg("has").alias("seen"))
    return seen.where(F.col("seen") < share).select("document", F.concat(F.lit("no text on most pages, scanned? "), F.col("document")).alias("error"))


def pdf_blocks(lines: DataFrame, larger: float = 1.15) -> DataFrame:
    """Blocks of PDF lines: a line larger than the body by ``larger`` or bold is a heading, wrapped headings are joined,
    paragraphs end at headings and pages, a page's tables follow its text."""
    clean = without_running_lines(lines)
    clean = clean.join(body_sizes(clean), "document")
    text = F.col("text")
    clean = clean.withColumn("head", ~F.col("is_table") & ((F.col("size") > F.col("body") * larger) | F.col("bold")))
    w = W.partitionBy("document").orderBy("page", F.col("is_table").cast("int"), "n")
    before = lambda c: F.lag(c).over(w)
    begins = text.rlike(r"(?i)^(chapter|section)\b") | text.rlike(r"^\(?[0-9]")
    joins = F.col("head") & before("head") & before("size").eqNullSafe(F.col("size")) & (before("bold") == F.col("bold")) & ~before("text").rlike(r"(?i)^(chapter|section)\b") & ~before("text").rlike(r"[.;:]\s*$") & ~begins
    flows = ~F.col("head") & ~F.col("is_table") & ~before("head") & ~before("is_table") & (before("page") == F.col("page"))
    runs = clean.withColumn("run", F.sum((~F.coalesce(joins | flows, F.lit(False))).cast("int")).over(w))
    kind = F.when(F.max("is_table"), "table").when(F.max("head"), "heading").otherwise("paragraph")
    words = F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"])
    made = runs.groupBy("document", "run").agg(kind.alias("kind"), F.array_join(words, " ").alias("text"), F.min("page").alias("page"), F.max("size").alias("font_size"), F.max("bold").alias("bold"))
    order = W.partitionBy("document").orderBy("run")
    return made.select("document", (F.row_number().over(order) - 1).cast("int").alias("ord"), "kind", "text", "page", F.lit(None).cast("int").alias("level"), "font_size", "bold")


# ---------------------------------------------------------------- all files


def parsed(files: DataFrame) -> DataFrame:
    """Blocks of all files, each by the parser of its type, with ``error``: a file that can't be parsed has one row, with its error
    and no block, and the other files have their blocks. ``document`` is the path. PDF files need PyMuPDF on executors."""
    end = F.coalesce(suffix(F.col("path")), F.lit(""))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    found = parse_docx(content) if path.lower().endswith("docx") else parse_html(content.decode("utf-8", "replace"))
                except Exception as e:
                    rows.append((path, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(path, i, kind, text, None, level, None, False, None) for i, (kind, text, level) in enumerate(found)]
            out = pd.DataFrame(rows, columns=["document", "ord", "kind", "text", "page", "level", "font_size", "bold", "error"])
            yield out.astype({"ord": "Int32", "page": "Int32", "level": "Int32"})

    fine = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    out = fine(markdown_blocks(files.where(end.isin(*MARKDOWN)).select(F.col("path").alias("document"), F.decode("content", "UTF-8").alias("text"))))
    failed = lambda df: df.select("document", *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns[1:-1]], "error")
    out = out.unionByName(files.where(end.isin(*HTML, *DOCX)).select("path", "content").mapInPandas(run, f"{BLOCK_DDL}, error string"))
    out = out.unionByName(failed(files.where(~end.isin(*SUFFIXES)).select(F.col("path").alias("document"), F.concat(F.lit("no parser for "), "path").alias("error"))))
    pdf = files.where(end.isin(*PDF)).select("path", "content")
    if pdf.select("path").isEmpty():
        return out
    lines = settled(pdf_lines(pdf))
    broken = lines.where("page is null").select("document", F.col("text").alias("error")).unionByName(scanned(lines))
    read = lines.where("page is not null and text is not null").join(broken.select("document"), "document", "left_anti")
    return out.unionByName(fine(pdf_blocks(read))).unionByName(failed(broken))


def _strict(blocks: DataFrame) -> DataFrame:
    """The blocks of :func:`parsed`; a file's error is raised where it is met."""
    return blocks.withColumn("document", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("string")).otherwise(F.col("document"))).drop("error")


def file_blocks(files: DataFrame) -> DataFrame:
    """Blocks of Markdown, HTML and DOCX files; a file of another type, or one that can't be parsed, raises when it is read."""
    end = suffix(F.col("path"))
    other = F.raise_error(F.concat(F.lit("no parser for "), "path")).cast("string")
    return _strict(parsed(files.withColumn("path", F.when(end.isin(*MARKDOWN, *HTML, *DOCX), F.col("path")).otherwise(other))))


def all_blocks(files: DataFrame) -> DataFrame:
    """As :func:`file_blocks`, with PDF files, which need PyMuPDF; those with no text on most pages raise."""
    return _strict(parsed(files))


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, link): distinct href targets."""
    return pages.select(key, F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1)))).alias("link"))


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Questions with expected sections from a YAML or JSON list."""
    raw = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # a hand-written file
    try:
        import yaml

        items = yaml.safe_load(raw)
    except ImportError:
        import json

        items = json.loads(raw)
    if not isinstance(items, list):
        raise ValueError("questions must be a list")
    rows = [(str(x["id"]), x["question"], x.get("corpus"), [str(s) for s in x.get("expected_sections") or []], x.get("expected_kinds"), x.get("tags") or []) for x in items]
    return spark.createDataFrame(rows, "id string, question string, corpus string, expected_sections array<string>, expected_kinds array<string>, tags array<string>")
