"""Word and SVG files to text by the standard library; PDF and scanned pages where their libraries are installed."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "text string, headings array<string>, tables array<array<array<string>>>, error string"


def local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def docx(data: bytes) -> tuple[str, list, list]:
    """Paragraphs, headings and tables of a Word file, in the order in which they stand."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines, headings, tables = [], [], []

    def text(e: ElementTree.Element) -> str:
        return "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(local(x), "") for x in e.iter())

    def walk(e: ElementTree.Element) -> None:
        for x in e:
            if local(x) == "p":
                if line := text(x).strip():
                    lines.append(line)
                    style = next((v for y in x.iter() if local(y) == "pStyle" for k, v in y.attrib.items() if k.endswith("val")), "")
                    if style.lower().startswith(("heading", "title")):
                        headings.append(line)
            elif local(x) == "tbl":
                rows = [[text(c).strip() for c in r if local(c) == "tc"] for r in x if local(r) == "tr"]
                tables.append(rows)
                lines.extend(" | ".join(r) for r in rows)
            else:
                walk(x)

    walk(body)
    return "\n".join(lines), headings, tables


def svg(data: bytes) -> tuple[str, list, list]:
    """Title, description and text nodes."""
    root = ElementTree.fromstring(data)
    parts = [" ".join("".join(e.itertext()).split()) for name in ("title", "desc", "text") for e in root.iter() if local(e) == name]
    return "\n".join(p for p in parts if p), [], []


def pdf(data: bytes) -> tuple[str, list, list]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as doc:
        pages = [(p.extract_text() or "", p.extract_tables()) for p in doc.pages]
    return "\n\n".join(t for t, _ in pages), [], [[[c or "" for c in r] for r in t] for _, ts in pages for t in ts]


#: Type of file -> parser of its bytes. Add to it for other types.
PARSERS: dict[str, Callable[[bytes], tuple[str, list, list]]] = {"docx": docx, "svg": svg, "pdf": pdf}


def extract(files: DataFrame) -> DataFrame:
    """(id, path, text, headings, tables, error) of scanned files whose type has a parser; a file that can't be parsed has its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, path, kind, data in f.itertuples(index=False):
                try:
                    rows.append((i, path, *PARSERS[kind](bytes(data)), None))
                except Exception as e:  # whatever a broken file brings about is that file's result
                    rows.append((i, path, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "path", "text", "headings", "tables", "error"])

    return files.where(F.col("type").isin(*PARSERS)).select("id", "path", "type", "content").mapInPandas(run, f"id string, path string, {SCHEMA}")
