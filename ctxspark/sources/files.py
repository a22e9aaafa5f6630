"""Reading documents: text, Markdown, HTML, CSV, JSON and DOCX into items; tables of items with upserts."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_bytes, document_id

#: The tags before which a line breaks.
BLOCKS = {"br", "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li"}
SKIPPED = {"script", "style"}
PARSED = "path string, text string, title string, kind string, meta string, error string"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.skip, self.in_title = [], "", 0, False
        self.tables, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self.out.append("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.skip:
            return
        if self.in_title:
            self.title = data.strip()
        if self.cell is not None:
            self.cell.append(data)
        self.out.append(data)


def html_text(html: str) -> tuple[str, str]:
    """(text, title): tags stripped, scripts and styles skipped, a line break before blocks, at most one blank line. The
    title is part of the text."""
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "".join(p.out)).strip(), p.title.strip()


def html_tables(html: str) -> list[str]:
    """The tables as Markdown; short rows are padded."""
    p = _Text()
    p.feed(html)
    p.close()
    return [table_to_markdown(t) for t in p.tables if any(t)]


def table_to_markdown(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * wide, *lines[1:]])


def markdown_table(text: str) -> list[list[str]]:
    """The cells of a Markdown table, its rule left out; a bar behind a backslash is no border."""
    rows = [re.split(r"(?<!\\)\|", line.strip().strip("|")) for line in text.strip().split("\n") if line.strip()]
    cells = [[c.strip().replace("\\|", "|") for c in r] for r in rows]
    return [r for r in cells if not all(re.fullmatch(r":?-+:?", c) for c in r)]


def front_matter(text: str) -> dict:
    """A YAML block as a dictionary; without a YAML library, or where it is no mapping, its plain `key: value` lines."""
    try:
        import yaml

        got = yaml.safe_load(text)
        if isinstance(got, dict):
            return got
    except ImportError:
        pass
    except yaml.YAMLError:
        return {}
    pairs = (line.partition(":") for line in text.split("\n"))
    return {k.strip(): v.strip().strip("\"'") for k, colon, v in pairs if colon and k.strip()}


def markdown(text: str) -> tuple[str, str, dict]:
    """(body, title, metadata) of a Markdown text: its front matter and its headings. The title is the front matter's own
    field or the first heading of the first level."""
    meta: dict = {}
    if m := re.match(r"---\s*\n(.*?)\n---\s*\n?", text, re.S):
        meta = front_matter(m[1])
        text = text[m.end() :]
    found = re.findall(r"^(#{1,6})\s+(.+)$", text, re.M)
    head = next((t.strip() for marks, t in found if len(marks) == 1), "")
    return text, str(meta.get("title") or head), meta | {"headings": [t.strip() for _, t in found]}


def pdf_text(raw: bytes) -> tuple[str, str, dict]:
    """(text, title, metadata) of a PDF, pages apart by a form feed; needs pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs pypdf") from e
    reader = PdfReader(io.BytesIO(raw))
    told = reader.metadata or {}
    pages = [p.extract_text() or "" for p in reader.pages]
    return "\f".join(pages), str(told.get("/Title") or ""), {"author": str(told.get("/Author") or ""), "page_count": len(pages)}


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX; a document type declaration is refused."""
    xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document type declarations are not read")
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(ns + "t")) for p in ElementTree.fromstring(xml).iter(ns + "p"))


def parse(path: str, raw: bytes) -> tuple[str, str, str, dict]:
    """(text, title, kind, metadata) by the path's ending."""
    name = path.rsplit("/", 1)[-1]
    end = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    meta = {"filename": name, "extension": "." + end if end else ""}
    if end == "docx":
        return docx_text(raw), "", "docx", meta
    if end == "pdf":
        text, title, more = pdf_text(raw)
        return text, title, "pdf", meta | more
    text = decode_bytes(raw)
    if end in ("html", "htm"):
        return *html_text(text), "html", meta
    if end in ("md", "markdown"):
        body, title, more = markdown(text)
        return body, title, "markdown", meta | more
    if end in ("csv", "tsv"):
        rows = csv.DictReader(io.StringIO(text), delimiter="\t" if end == "tsv" else ",")
        lines = ["; ".join(f"{k}: {v}" for k, v in r.items() if k and v) for r in rows]
        return "\n".join(lines), "", "csv", meta | {"columns": list(rows.fieldnames or ()), "row_count": len(lines)}
    if end == "json":
        value = json.loads(text)
        more = {"top_level_keys": list(value)} if isinstance(value, dict) else {"item_count": len(value)} if isinstance(value, list) else {}
        return json.dumps(value, indent=2, ensure_ascii=False), "", "json", meta | more
    return text, "", "text", meta | {"line_count": len(text.splitlines())}


def ingest_directory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A row for each file: doc_id, path, text, title, kind, meta (JSON); a file that can't be read keeps its row with
    `error`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    text, title, kind, meta = parse(path, content)
                    rows.append((path, text, title, kind, json.dumps(meta, ensure_ascii=False, default=str), None))
                except Exception as e:  # noqa: BLE001 - a bad file must not end the job
                    rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["path", "text", "title", "kind", "meta", "error"])

    out = raw.mapInArrow(run, PARSED)
    return out.withColumn("doc_id", document_id("path", F.coalesce("text", F.lit(""))))


def parse_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, title, tables) of HTML columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [h or "" for h in batch.column("h").to_pylist()]
            got = [html_text(h) for h in html]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([html_tables(h) for h in html], pa.list_(pa.string()))], names=["id", "text", "title", "tables"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("h")).mapInArrow(run, "id long, text string, title string, tables array<string>")


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The table with rows of the same keys replaced."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a line that doesn't fit fails with its file's name."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Items by vault, so that a vault's reads skip the others' files."""
    items.write.mode(mode).partitionBy("vault").parquet(path)
