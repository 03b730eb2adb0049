"""Readers of documents and code: recursive scans, text, Word and PDF files, ranges of giant texts."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.operators.paths import CODE_EXTENSIONS, DOC_EXTENSIONS, wanted

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, root: str, extensions: list[str], files_ignored: list[str] = (), folders_ignored: list[str] = ()) -> DataFrame:
    """(path, content) of the wanted files below a folder; contents of other files are not read."""
    root = os.path.expanduser(root)
    if "://" not in root and not os.path.isdir(root):
        raise NotADirectoryError(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    return wanted(files, "path", extensions, files_ignored, folders_ignored).select("path", "content")


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    """Document files; no ignore rules hold for them."""
    return scan(spark, root, DOC_EXTENSIONS)


def scan_code(spark: SparkSession, root: str, files_ignored: list[str] = (), folders_ignored: list[str] = ()) -> DataFrame:
    return scan(spark, root, CODE_EXTENSIONS, files_ignored, folders_ignored)


def decode(content: bytes) -> str:
    """UTF-8 without undecodable bytes, line ends as newlines."""
    return re.sub("\r\n?", "\n", content.decode("utf-8", "ignore"))


def docx_text(content: bytes) -> str:
    """Paragraphs of the body joined by newlines; tables and headers are not read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p"):
        out.append("".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")))
    return "\n".join(out)


def pdf_pages(content: bytes) -> list[list[str]]:
    """Lines of each page; a page that fails is empty. Needs the optional package pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional package pypdf") from e
    out = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            out.append((page.extract_text() or "").splitlines())
        except Exception:  # noqa: BLE001 - a damaged page must not lose the file
            out.append([])
    return out


def read_texts(files: DataFrame) -> DataFrame:
    """(path, text, error) of text, markdown, Word and code files; a file that fails has a null text and its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    texts.append(docx_text(content) if path.lower().endswith(".docx") else decode(content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the scan
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "text", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, error string")


def read_pages(files: DataFrame, reader: Callable[[bytes], list[list[str]]] = pdf_pages) -> DataFrame:
    """(path, page_number, lines) of page files, from 1; a file that fails has no pages."""
    kinds = [pa.string(), pa.int32(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, i, lines) for i, lines in enumerate(reader(content), 1)]
                except RuntimeError:
                    raise
                except Exception:  # noqa: BLE001 - a damaged file has no pages
                    continue
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "page_number", "lines"])

    return files.select("path", "content").mapInArrow(run, "path string, page_number int, lines array<string>")


def text_ranges(spark: SparkSession, sizes: DataFrame, range_bytes: int = 4 << 20, halo: int = 256) -> DataFrame:
    """(path, r, lo, start, part): the ranges of giant text files, read by offset from a shared folder.

    sizes has path and length in bytes. Each task seeks to its range; a character belongs to the range
    its first byte lies in; halo characters on both sides come along. Offsets are in code points: each
    range counts its own, and prefix sums over the ranges of a file give lo; start is lo less the halo.
    """
    grid = sizes.select("path", F.col("length").cast("long").alias("length"), F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0) div {range_bytes})")).alias("r"))
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, length, r in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = r * range_bytes, min(length, (r + 1) * range_bytes)
                with open(path.removeprefix("file://"), "rb") as f:
                    f.seek(max(0, a - 4 * halo))
                    raw = f.read(b - max(0, a - 4 * halo) + 4 * halo)
                at = a - max(0, a - 4 * halo)
                edge = lambda k: next((k + i for i in range(4) if k + i >= len(raw) or raw[k + i] & 0xC0 != 0x80), k)
                lo, hi = edge(at) if a else 0, edge(at + b - a) if b < length else len(raw)
                before = raw[edge(0) if a - 4 * halo > 0 else 0 : lo].decode("utf-8", "replace")[-halo:]
                body, after = raw[lo:hi].decode("utf-8", "replace"), raw[hi:].decode("utf-8", "ignore")[:halo]
                rows.append((path, r, len(body), len(before), before + body + after))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "r", "n", "halo", "part"])

    read = grid.repartition("path", "r").mapInArrow(run, "path string, r long, n long, halo long, part string")
    before = Window.partitionBy("path").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    lengths = read.select("path", "r", "n").withColumn("lo", F.coalesce(F.sum("n").over(before), F.lit(0))).select("path", "r", "lo")
    return read.join(lengths, ["path", "r"]).select("path", "r", "lo", (F.col("lo") - F.col("halo")).alias("start"), "n", "part")
