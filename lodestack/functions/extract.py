"""Text of documents by type: plain text by built-in expressions, Office, e-book and OpenDocument files by an Arrow
stage that unpacks them. PDF text comes from a reader the caller plugs in; there is none in the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions.paths import BINARY_DOCUMENTS, CONTENT_CAP, TEXT_DOCUMENTS
from lodestack.functions.scalars import ENTITIES


def strip_tags(markup: str) -> str:
    """As scalars.strip_tags, for one value."""
    return re.sub(r"<[^>]*\Z", "", re.sub(r"<[^>]*>", " ", markup)).replace(">", " ")


def node_text(xml: str, tag: str) -> str:
    """As scalars.node_text, for one value."""
    out = []
    for text in re.findall(rf"(?s)<{tag}[^>]*>(.*?)</{tag}>", xml):
        for entity, char in ENTITIES:
            text = text.replace(entity, char)
        out.append(text + " ")
    return "".join(out)


def unpacked_text(content: bytes, ext: str) -> tuple[str, str] | None:
    """(text, doc_type) of a packed document; null if it can't be read or its text is blank."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = archive.namelist()

            def read(name: str) -> str:
                return archive.read(name).decode("utf-8", "replace") if name in names else ""

            if ext == "docx":
                parts = ["word/document.xml"] + [n for n in names if re.match(r"word/(header|footer)[^/]*\.xml$", n)]
                text = "".join(node_text(read(n), "w:t") for n in parts)
            elif ext == "xlsx":
                sheets = [n for n in names if n.startswith("xl/worksheets/sheet")]
                text = node_text(read("xl/sharedStrings.xml"), "t") + "".join(node_text(read(n), "v") for n in sheets)
            elif ext == "pptx":
                text = "".join(node_text(read(n), "a:t") + "\n" for n in names if n.startswith("ppt/slides/slide"))
            elif ext == "epub":
                text = "".join(strip_tags(read(n)) + "\n" for n in names if n.lower().endswith((".xhtml", ".html", ".htm")))
            else:
                text = strip_tags(read("content.xml"))
    except (zipfile.BadZipFile, KeyError, OSError, EOFError):
        return None
    return (text, "odt" if ext in ("odt", "ods", "odp") else ext) if text.strip() else None


def extract(files: DataFrame, pdf_reader: Callable[[bytes], str | None] | None = None) -> DataFrame:
    """(path, mtime, size, doc_type, content) of files (path, mtime, size, ext, content BINARY). Files of other types, empty,
    over the cap, unreadable or blank give no row."""
    ext = F.lower("ext")
    usable = files.where((F.col("size") > 0) & (F.col("size") <= CONTENT_CAP))
    plain = usable.where(ext.isin(*TEXT_DOCUMENTS)).select(
        "path", "mtime", "size", F.lit("text").alias("doc_type"), F.make_valid_utf8(F.col("content").cast("string")).alias("content")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, types, texts = [], [], []
            for i, (kind, content) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                if kind == "pdf":
                    text = pdf_reader(content) if pdf_reader else None
                    found = (text, "pdf") if text and text.strip() else None
                else:
                    found = unpacked_text(content, kind)
                if found:
                    kept.append(i)
                    texts.append(found[0])
                    types.append(found[1])
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(types, pa.string()), pa.array(texts, pa.string())],
                ["path", "mtime", "size", "doc_type", "content"],
            )

    packed = usable.where(ext.isin(*BINARY_DOCUMENTS)).select("path", "mtime", "size", ext.alias("ext"), "content")
    unpacked = packed.mapInArrow(run, "path string, mtime bigint, size bigint, doc_type string, content string")
    return plain.where(F.length(F.trim("content")) > 0).unionByName(unpacked)
