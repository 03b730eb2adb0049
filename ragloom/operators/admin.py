"""Catalogue: counts, sizes, listing, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators.paths import collection_types


def counts(chunks: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """(collection, chunks): stored chunks of each collection; registered ones without chunks have 0.

    Names are compared in upper case without outer blanks; null is a collection of its own.
    """
    got = chunks.groupBy(F.upper(F.trim("collection")).alias("collection")).agg(F.count("*").alias("chunks"))
    if registry is None:
        return got
    names = registry.select(F.upper(F.trim("name")).alias("collection")).distinct()
    return names.join(got, "collection", "full").select("collection", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def info(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """(collection, collection_type, chunks, bytes, size), and a row of the total whose collection is TOTAL."""
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes")
    own = chunks.groupBy(F.upper(F.trim("collection")).alias("collection")).agg(F.count("*").alias("chunks"), size)
    typed = collection_types(own, registry)
    total = own.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).select(F.lit("TOTAL").alias("collection"), "chunks", "bytes", F.lit("ALL").alias("collection_type"))
    every = typed.unionByName(total)
    return every.withColumn("size", T.human_size(F.col("bytes"))).select("collection", "collection_type", "chunks", "bytes", "size")


def ingest_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: folders, files with chunks, skipped files, chunks, and the folder with most files.

    files has file_path (each file once or more) and wanted; the first folder by name wins a tie.
    """
    folder = F.regexp_extract("file_path", "^(.*)/[^/]*$", 1)
    seen = files.where("file_path IS NOT NULL").groupBy("file_path").agg(F.max("wanted").alias("wanted"), F.first(folder).alias("folder"))
    done = chunks.where("file_path IS NOT NULL").groupBy("file_path").agg(F.count("*").alias("n"))
    rows = seen.join(done, "file_path", "left").select("file_path", "folder", F.col("wanted").alias("wanted"), F.coalesce("n", F.lit(0)).alias("n"))
    folders = rows.groupBy("folder").agg(F.count_if(F.col("wanted")).alias("files"), F.count_if(~F.col("wanted")).alias("skipped"), F.sum(F.when(F.col("wanted"), F.col("n")).otherwise(0)).alias("chunks"))
    most = F.min_by("folder", F.struct((-F.col("files")).alias("a"), F.col("folder").alias("b")))
    return folders.agg(F.count("*").alias("folders"), F.sum("files").alias("files"), F.sum("skipped").alias("skipped"), F.sum("chunks").alias("chunks"), F.max("files").alias("most_files"), most.alias("largest_folder"))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def collections(spark: SparkSession, path: str) -> list[str]:
    """The collections of a store, by name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName()[len("collection=") :] for s in fs.listStatus(p) if s.getPath().getName().startswith("collection="))


def remove(spark: SparkSession, path: str, collection: str, force: bool = False, confirm=lambda name: False) -> bool:
    """Drop a collection's folder; an unknown one is refused, and so is one that is not confirmed unless forced."""
    if collection not in collections(spark, path):
        raise KeyError(collection)
    if not force and not confirm(collection):
        return False
    fs, p = _fs(spark, f"{path}/collection={collection}")
    return bool(fs.delete(p, True))


def clean(spark: SparkSession, path: str, phrase: str) -> bool:
    """Drop the whole store if the phrase is exactly DELETE ALL."""
    fs, p = _fs(spark, path)
    return phrase == "DELETE ALL" and fs.exists(p) and bool(fs.delete(p, True))


def store_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(bytes, size) of the files below a folder, from their metadata."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select("bytes", T.human_size(F.col("bytes")).alias("size"))
