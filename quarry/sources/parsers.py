"""Bytes to text: (text, source_format, page_count, table_count) of named contents, in Arrow batches."""

from __future__ import annotations

import io
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = (".txt", ".md", ".markdown", ".rst", ".text")
HTML = (".html", ".htm", ".xhtml")


def detect(name: str, data: bytes) -> str:
    """By extension, else by the first bytes, else text."""
    dot = name.rfind(".")
    ext = name[dot:].lower() if dot > name.rfind("/") else ""
    if ext in TEXT:
        return "text"
    if ext in HTML:
        return "html"
    if ext in (".pdf", ".docx"):
        return ext[1:]
    if data.startswith(b"%PDF-"):
        return "pdf"
    head = data[:64].lstrip().lower()
    return "html" if head.startswith((b"<!doctype", b"<html")) else "text"


def parse_text(data: bytes) -> tuple[str, dict]:
    """A null byte near the start means binary, which has no text. UTF-8 as it stands, a mark at its start kept."""
    if b"\0" in data[:8192]:
        return "", {"source_format": "binary"}
    try:
        return data.decode("utf-8"), {"source_format": "text"}
    except UnicodeDecodeError:
        return data.decode("latin-1"), {"source_format": "text"}


class _Fragments(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        if data.strip():
            self.parts.append(data.strip())


def strip_tags(markup: str) -> str:
    """Text fragments joined by blanks, those of script and style too; the markup itself if there are none."""
    parser = _Fragments()
    parser.feed(markup)
    return " ".join(parser.parts) or markup


def parse_html(data: bytes) -> tuple[str, dict]:
    markup = data.decode("utf-8", "replace")
    try:
        import trafilatura

        text = trafilatura.extract(markup) or strip_tags(markup)
    except ImportError:
        text = strip_tags(markup)
    return text, {"source_format": "html"}


def parse_pdf(data: bytes) -> tuple[str, dict]:
    import pypdf

    pages = pypdf.PdfReader(io.BytesIO(data)).pages
    return "\n".join(p.extract_text() or "" for p in pages), {"source_format": "pdf", "page_count": len(pages)}


def markdown_table(rows: list[list]) -> str:
    cells = [["" if c is None else str(c).replace("|", "/").replace("\n", " ").strip() for c in r] for r in rows]
    lines = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * len(cells[0])) + " |", *lines[1:]]) if lines else ""


def parse_pdf_tables(data: bytes) -> tuple[str, dict]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        tables = [t for p in pdf.pages for t in p.extract_tables()]
        texts = [p.extract_text() or "" for p in pdf.pages]
    parts = [*texts, *(markdown_table(t) for t in tables)]
    return "\n".join(p for p in parts if p), {"source_format": "pdf", "page_count": len(texts), "table_count": len(tables)}


def parse_docx(data: bytes) -> tuple[str, dict]:
    import docx

    return "\n".join(p.text for p in docx.Document(io.BytesIO(data)).paragraphs), {"source_format": "docx"}


def _importable(name: str) -> bool:
    import importlib.util

    return importlib.util.find_spec(name) is not None


PARSERS: dict[str, Callable[[bytes], tuple[str, dict]]] = {"text": parse_text, "html": parse_html}
PARSERS |= {k: f for k, f, lib in (("pdf", parse_pdf, "pypdf"), ("pdf_table", parse_pdf_tables, "pdfplumber"), ("docx", parse_docx, "docx")) if _importable(lib)}


def parse(name: str, data: bytes, hint: str | None = None, parsers=None) -> tuple[str, dict]:
    """Text by the hinted or detected format. An unknown format reads as text; a failure gives no text for binary
    formats and what UTF-8 can show for others."""
    parsers = parsers or PARSERS
    kind = hint or detect(name, data)
    try:
        return parsers.get(kind, parse_text)(data)
    except Exception:
        if b"\0" in data[:8192] or kind in ("pdf", "pdf_table", "docx"):
            return "", {"source_format": "binary-parse-error"}
        return data.decode("utf-8", "replace"), {"source_format": kind}


def parse_files(files: DataFrame, hint: str | None = None, max_bytes: int = 10 << 20, parsers: dict | None = None) -> DataFrame:
    """documents(doc_id, title, content, source_format, page_count, table_count, path) of files(path, length, content).

    The length filter reaches the scan; files without text are left out. doc_id is the file's stem.
    """

    @F.pandas_udf("text string, source_format string, page_count int, table_count int")
    def read(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = []
        for p, c in zip(path, content):
            text, meta = parse(p, bytes(c), hint, parsers)
            rows.append((text, meta.get("source_format"), meta.get("page_count"), meta.get("table_count")))
        return pd.DataFrame(rows, columns=["text", "source_format", "page_count", "table_count"]).astype({"page_count": "Int32", "table_count": "Int32"})

    rows = files.where(F.col("length") <= max_bytes).withColumn("d", read("path", "content"))
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    kept = rows.where(F.trim(F.regexp_replace("d.text", r"\s+", " ")) != "")
    return kept.select(stem.alias("doc_id"), name.alias("title"), F.col("d.text").alias("content"), "d.source_format", "d.page_count", "d.table_count", "path")
