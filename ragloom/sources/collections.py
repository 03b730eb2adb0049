"""Collections of a registry: files to chunks by type and extension, and all collections to the store."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunkers, code_chunks, ingest, paths
from ragloom.sources import files

_CHUNK = ["id", "text", "file_path"]


def document_chunks(found: DataFrame, reader: Callable[[bytes], list[list[str]]] = files.pdf_pages) -> DataFrame:
    """(id, text, file_path, ...) of document files (path, content) by extension: headings, pages or windows.

    A file that cannot be read, and one of another kind, has no chunk; it never stops the others.
    """
    pdf = T.extension(F.col("path")) == ".pdf"
    pages = chunkers.chunk_pages(files.read_pages(found.where(pdf), reader)).withColumn("format", F.lit("pdf"))
    texts = chunkers.chunk_documents(files.read_texts(found.where(~pdf)).where("error IS NULL"))
    return texts.unionByName(pages, allowMissingColumns=True).withColumn("source_type", F.lit("doc"))


def collection_chunks(spark: SparkSession, root: str, rag_type: str, files_ignored: list[str] = (), folders_ignored: list[str] = (), reader: Callable = files.pdf_pages) -> DataFrame:
    """The chunks of a folder: of documents (doc) or of code (src); another type has none."""
    kind = (rag_type or "").strip().lower()
    if kind == "doc":
        return document_chunks(files.scan_documents(spark, root), reader)
    if kind == "src":
        read = files.read_texts(files.scan_code(spark, root, files_ignored, folders_ignored)).where("error IS NULL")
        code = read.select(F.col("path").alias("file_path"), chunkers.collapse_blank_lines(F.col("text")).alias("text"))
        return code_chunks.chunk_code(code).withColumn("source_type", F.lit("src"))
    return spark.createDataFrame([], "id string, text string, file_path string, source_type string")


def update_all(spark: SparkSession, registry: list[tuple[str, str, str]], store: str, make: Callable = ingest.hashing_embedder, reader: Callable = files.pdf_pages) -> DataFrame:
    """New chunks of all collections (name, root, type), embedded and stored in one job; paths become portable.

    The order is that of the registry, then of the paths and ids, so that the first of repeated ids stays the same.
    """
    roots = spark.createDataFrame([(name, root) for name, root, _ in registry], "name string, root string")
    own = [collection_chunks(spark, root, kind, reader=reader).select(*_CHUNK).withColumns({"collection": F.lit(name.upper()), "_n": F.lit(n)}) for n, (name, root, kind) in enumerate(registry)]
    if not own:
        return spark.createDataFrame([], "id string, text string, file_path string, collection string")
    rows = paths.encode_paths(reduce(DataFrame.unionByName, own), roots, "file_path", "portable")
    rows = rows.withColumn("id", F.expr("CASE WHEN startswith(id, file_path) THEN concat(portable, substring(id, length(file_path) + 1)) ELSE id END"))
    return ingest.update(rows.select("id", "text", F.col("portable").alias("file_path"), "collection", F.struct("_n", "portable", "id").alias("seq")), store, make=make)
