"""Files of several formats to text with a map of its parts. Formats are told by Spark expressions; a task reads each file's bytes."""

from __future__ import annotations

import hashlib
import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.sources.html import status, text_of

#: Formats by media type and, where that tells nothing, by the end of the name.
MEDIA = {
    "text/plain": "text", "text/markdown": "markdown", "text/x-markdown": "markdown", "application/pdf": "pdf", "application/epub+zip": "epub",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "text/html": "html",
}
ENDINGS = {".txt": "text", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".epub": "epub", ".docx": "docx", ".html": "html", ".htm": "html"}
#: XML names of word-processing and book files.
WORD, CONTAINER, PACKAGE = (
    "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}", "{urn:oasis:names:tc:opendocument:xmlns:container}", "{http://www.idpf.org/2007/opf}",
)
NAMES = ("path", "format", "source_hash", "size", "doc_id", "text", "parts", "error")
ARROW_PARTS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("location", pa.string()), ("label", pa.string())]))
#: Bytes of files that a task reads at once.
SLICE = 1 << 20
PART = "array<struct<start: int, end: int, kind: string, location: string, label: string>>"


def format_of(media_type: Column, name: Column) -> Column:
    """The format by media type, else by the longest ending of the name, else null."""
    by_name = F.coalesce(*(F.when(F.endswith(F.lower(name), F.lit(e)), f) for e, f in sorted(ENDINGS.items(), key=lambda x: -len(x[0]))))
    return F.coalesce(*(F.when(media_type == m, f) for m, f in MEDIA.items()), by_name)


def plain_bytes(raw: bytes) -> bytes:
    """Without a byte order mark, lines ending in LF, composed characters; bytes that are no UTF-8 stay as they are."""
    try:
        text = raw.removeprefix(b"\xef\xbb\xbf").decode("utf-8")
    except UnicodeDecodeError:
        return raw
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n")).encode()


def _book(raw: bytes) -> list[tuple[str, str, str, str]]:
    """(text, kind, location, label) of each chapter that the spine names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = next((r.get("full-path") for r in ElementTree.fromstring(z.read("META-INF/container.xml")).iter(CONTAINER + "rootfile")), None)
        package, folder = ElementTree.fromstring(z.read(root)), root.rpartition("/")[0]
        hrefs = {i.get("id"): i.get("href") for i in package.iter(PACKAGE + "item")}
        spine = [i.get("idref") for i in package.iter(PACKAGE + "itemref")]
        texts = [(i, text_of(z.read(f"{folder}/{hrefs[i]}".strip("/")).decode("utf-8", "replace"))) for i in spine if hrefs.get(i)]
    return [(t, "chapter", f"chapter {i}", i) for i, t in texts if t]


def _word(raw: bytes) -> list[tuple[str, str, str, str]]:
    """(text, kind, location, label) of each paragraph; its location is the heading before it."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(WORD + "body")
    out, section, stands_for = [], "", {WORD + "tab": " ", WORD + "br": "\n"}
    for p in body.findall(WORD + "p"):
        text = " ".join("".join(n.text or "" if n.tag == WORD + "t" else stands_for.get(n.tag, "") for n in p.iter()).split())
        style = next((s.get(WORD + "val") for s in p.iter(WORD + "pStyle")), None)
        heading = bool(style) and style.lower().startswith("heading")
        if text:
            section = text if heading else section
            out.append((text, "heading" if heading else "paragraph", section or "paragraph", style or "paragraph"))
    return out


def read_bytes(kind: str | None, raw: bytes) -> tuple[str | None, list[dict], str | None]:
    """Text, its parts and an error. A broken or unknown file is an error, never an exception."""
    try:
        if kind in ("text", "markdown"):
            parts = [(plain_bytes(raw).decode("utf-8").replace("\0", ""), "document", "whole-document", "")]
        elif kind == "html":
            parts = [(text_of(plain_bytes(raw).decode("utf-8")), "document", "whole-document", "")]
        elif kind in ("epub", "docx"):
            parts = _book(raw) if kind == "epub" else _word(raw)
        else:
            return None, [], "UNSUPPORTED_FORMAT"
    except Exception as e:  # noqa: BLE001
        return None, [], f"CORRUPTED: {type(e).__name__}"
    at, spans = 0, []
    for text, kind_, location, label in parts:
        spans.append({"start": at, "end": at + len(text), "kind": kind_, "location": location, "label": label})
        at += len(text) + 2
    return "\n\n".join(p[0] for p in parts), spans, None


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content and media_type (null) of all files below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", F.lit(None).cast("string").alias("media_type"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of SLICE bytes of content, and of one row at least."""
    at, held = 0, 0
    for i, size in enumerate(batch.column("size").to_pylist()):
        if held and held + size > SLICE:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += size
    if batch.num_rows > at:
        yield batch.slice(at)


def materialized(files: DataFrame) -> DataFrame:
    """files (path, content, media_type) to path, format, doc_id, source_hash, text, content_hash, parts, status and error.

    doc_id is by the plain bytes, source_hash by the bytes as they are. Status: OK, EMPTY, LOW_YIELD (archives only) or FAILED with an error. Null contents are empty files.
    """
    content = F.coalesce("content", F.lit(b""))
    known = files.select("path", format_of(F.col("media_type"), F.col("path")).alias("format"), F.sha2(content, 256).alias("source_hash"), F.octet_length(content).alias("size"), content.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                raw = rows.column("content").to_pylist()
                read = [read_bytes(k, c) for k, c in zip(rows.column("format").to_pylist(), raw)]
                hashes = pa.array(["doc_" + hashlib.sha256(plain_bytes(c)).hexdigest() for c in raw], pa.string())
                kept = [rows.column(n) for n in ("path", "format", "source_hash", "size")]
                yield pa.RecordBatch.from_arrays([*kept, hashes, *(pa.array([r[i] for r in read], t) for i, t in enumerate((pa.string(), ARROW_PARTS, pa.string())))], [*NAMES])

    rows = known.mapInArrow(run, f"path string, format string, source_hash string, size int, doc_id string, text string, parts {PART}, error string")
    blank = ~F.rlike("text", F.lit(r"\S"))
    archive = F.col("format").isin("epub", "docx")
    state = F.when(F.col("error").isNotNull(), "FAILED").when(blank, "EMPTY").when(archive, status(F.col("text"), F.col("size"))).otherwise("OK")
    return rows.select("path", "format", "doc_id", "source_hash", "text", F.sha2("text", 256).alias("content_hash"), "parts", state.alias("status"), "error")
