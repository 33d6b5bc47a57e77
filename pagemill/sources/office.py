"""Text of document files by the standard library, a batch of files at a time (SC3).

A file that can't be read has an error in place of a text; no file stops the others (S11).
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An entry of an archive that unpacks to more is refused.
MOST_BYTES = 256 << 20


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def entry(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError("an entry is too large")
    return z.read(name)


def tree(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data[:4096]:
        raise ValueError("declarations aren't allowed")
    return ET.fromstring(data)


def paragraphs(root: ET.Element, block: str = "p") -> list[str]:
    out = []
    for p in root.iter():
        if local(p.tag) == block:
            parts = [(e.text or "") if local(e.tag) == "t" else "\t" if local(e.tag) == "tab" else "\n" if local(e.tag) == "br" else "" for e in p.iter()]
            out.append("".join(parts))
    return out


def numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(paragraphs(tree(entry(z, "word/document.xml"))))


def pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
        return "\n\n".join(f"<!-- Slide number: {i} -->\n" + "\n".join(paragraphs(tree(entry(z, n)))) for i, n in enumerate(slides, 1))


def rows_as_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join([*r, *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + " --- |" * width, *lines[1:]]) if rows else ""


def column_of(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return max(0, n - 1)


def xlsx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in tree(entry(z, "xl/sharedStrings.xml")) if local(si.tag) == "si"] if "xl/sharedStrings.xml" in names else []
        out = []
        for i, name in enumerate(numbered(names, r"xl/worksheets/sheet(\d+)\.xml"), 1):
            rows = []
            for row in tree(entry(z, name)).iter():
                if local(row.tag) != "row":
                    continue
                cells: list[str] = []
                for c in row:
                    value = next((e.text or "" for e in c.iter() if local(e.tag) in ("v", "t")), "")
                    at = column_of(c.get("r", "")) if c.get("r") else len(cells)
                    cells += [""] * (at - len(cells) + 1)
                    cells[at] = shared[int(value)] if c.get("t") == "s" and value else value
                rows.append(cells)
            out.append(f"## Sheet {i}\n{rows_as_table(rows)}")
        return "\n\n".join(out)


class Reader(HTMLParser):
    BLOCKS = frozenset("address article aside blockquote br dd div dl dt footer form header hr li main nav ol p pre section table tr ul title".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "template", "noscript"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template", "noscript"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.BLOCKS or re.fullmatch("h[1-6]", tag):
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def html(data: bytes) -> str:
    reader = Reader()
    reader.feed(data.decode("utf-8-sig", "replace"))
    reader.close()
    text = re.sub(r"[ \t]*\n\s*", "\n", "".join(reader.parts))
    return re.sub(r" {2,}", " ", text).strip()


def epub(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        home = next(e.get("full-path") for e in tree(entry(z, "META-INF/container.xml")).iter() if local(e.tag) == "rootfile")
        package = tree(entry(z, home))
        folder = home.rpartition("/")[0]
        items = {e.get("id"): e.get("href") for e in package.iter() if local(e.tag) == "item"}
        spine = [items[e.get("idref")] for e in package.iter() if local(e.tag) == "itemref" and e.get("idref") in items]
        return "\n\n".join(html(entry(z, f"{folder}/{h}" if folder else h)) for h in spine)


def plain(data: bytes) -> str:
    return data.decode("utf-8-sig")


def table(data: bytes) -> str:
    return rows_as_table(list(csv.reader(io.StringIO(plain(data), newline=""))))


def json_text(data: bytes) -> str:
    json.loads(plain(data))
    return plain(data)


def xml_text(data: bytes) -> str:
    return "\n".join(t.strip() for t in tree(data).itertext() if t.strip())


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "html": html, "htm": html, "epub": epub, "txt": plain, "md": plain, "csv": table, "json": json_text, "xml": xml_text}


def read_texts(files: DataFrame) -> DataFrame:
    """path, ext, text, error of files (path, ext, content): the text without control characters, or why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for ext, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = error = None
                try:
                    if ext not in READERS:
                        raise ValueError(f"no reader for {ext or 'files without extension'}")
                    text = "".join(c for c in READERS[ext](data) if c in "\n\r\t" or ord(c) >= 32)
                    if not text.strip():
                        text, error = None, "no text"
                except Exception as e:  # noqa: BLE001
                    text, error = None, f"{type(e).__name__}: {e}"[:600]
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "ext", "text", "error"])

    return files.select("path", F.lower("ext").alias("ext"), "content").mapInArrow(run, "path string, ext string, text string, error string")
