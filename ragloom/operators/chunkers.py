"""Chunkers of documents: character windows, headings, pages, newline-aware pieces.

All chunkers take a table with a path column and a text column and give one row for each chunk, with
a content-addressed id. Null texts and paths give no chunk. Offsets count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragloom.functions import text as T

WINDOW, OVERLAP = 2000, 200


def _windows(text: Column, size: int, overlap: int) -> Column:
    """Array of (start, piece) of the sliding windows of a text; pieces are stripped."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), T.strip(F.substring(text, s + 1, F.lit(size))).alias("piece")))


def chunk_windows(docs: DataFrame, path: str = "path", text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of size characters that overlap; blank texts and pieces give none, starts ignore stripped blanks."""
    rows = docs.where(F.length(T.strip(F.col(text))) > 0).select(F.col(path).alias("file_path"), F.explode(_windows(F.col(text), size, overlap)).alias("w"))
    rows = rows.select("file_path", "w.start", "w.piece").where(F.length("piece") > 0)
    end = F.col("start") + F.length("piece")
    return rows.select(
        F.concat("file_path", F.lit(":char"), "start", F.lit("-"), end, F.lit("-"), T.short_hash(F.col("piece"))).alias("id"),
        F.col("piece").alias("text"), "file_path", F.col("start").alias("start_char"), end.alias("end_char"),
    )


def newline_pieces(text: str, size: int) -> list[str]:
    """Pieces of at most size characters of one text, found in one walk."""
    at, out = 0, []
    while len(text) - at > size:
        line_end = text.rfind("\n", at, at + size)
        stop = line_end + 1 if line_end - at > size // 2 else at + size
        out.append(text[at:stop])
        at = stop
    return [*out, text[at:]]


def split_at_newlines(text: Column, size: int) -> Column:
    """Pieces of at most size characters; a cut goes behind the last newline of the second half, if there is one.

    Texts within the size stay in the JVM; longer ones go through Arrow, as a fold over an array would be quadratic.
    """
    long = F.pandas_udf(lambda s: s.map(lambda t: None if t is None else newline_pieces(t, size)), "array<string>")
    return F.when(F.length(text) <= size, F.array(text)).otherwise(long(F.when(F.length(text) > size, text)))


def chunk_headings(docs: DataFrame, path: str = "path", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Blocks that begin at a line with # at its start; blank blocks give none but count; long blocks are split at newlines."""
    shift = F.startswith(F.col(text), F.lit("#")).cast("int")  # a text that begins with # has an empty block before it
    blocks = docs.where(F.col(text).isNotNull()).select(F.col(path).alias("file_path"), shift.alias("shift"), F.posexplode(F.split(F.col(text), "(?dm)^(?=#)", -1)).alias("i", "raw"))
    blocks = blocks.select("file_path", (F.col("i") + F.col("shift")).alias("block_index"), T.strip(F.col("raw")).alias("block")).where(F.length("block") > 0)
    pieces = blocks.select("file_path", "block_index", F.posexplode(split_at_newlines(F.col("block"), size)).alias("piece_index", "text"))
    return pieces.select(
        F.concat("file_path", F.lit(":md"), "block_index", F.lit("-"), "piece_index", F.lit("-"), T.short_hash(F.col("text"))).alias("id"), "text", "file_path", "block_index", "piece_index"
    )


def chunk_pages(pages: DataFrame, path: str = "path", page: str = "page_number", lines: str = "lines", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of each page; the page is stripped first, blank pages give none."""
    rows = pages.select(F.col(path).alias("file_path"), F.col(page).alias("page_number"), T.strip(F.array_join(lines, "\n", "")).alias("t")).where(F.length("t") > 0)
    rows = rows.select("file_path", "page_number", F.explode(_windows(F.col("t"), size, overlap)).alias("w")).select("file_path", "page_number", "w.start", "w.piece").where(F.length("piece") > 0)
    end = F.col("start") + F.length("piece")
    return rows.select(
        F.concat("file_path", F.lit(":p"), "page_number", F.lit("-char"), "start", F.lit("-"), end, F.lit("-"), T.short_hash(F.col("piece"))).alias("id"),
        F.col("piece").alias("text"), "file_path", "page_number", F.col("start").alias("start_char"), end.alias("end_char"),
    )


def split_oversize(chunks: DataFrame, limit: int = 12000, id_: str = "id", text: str = "text", seq: str = "seq") -> DataFrame:
    """Chunks above the embedder's limit become pieces of half of it, behind all others; was_split, seq and piece give the order."""
    over = F.length(text) > limit
    pieces = F.when(over, split_at_newlines(F.col(text), limit // 2)).otherwise(F.array(F.col(text)))
    rows = chunks.where(F.col(text).isNotNull()).withColumn("was_split", over).select("*", F.posexplode(pieces).alias("piece", "_rl_text"))
    new_id = F.when(F.col("was_split"), F.concat(F.col(id_), F.lit("#split"), F.col("piece"), F.lit("_"), T.short_hash(F.col("_rl_text")))).otherwise(F.col(id_))
    return rows.withColumn(id_, new_id).withColumn(text, F.col("_rl_text")).drop("_rl_text")


def collapse_blank_lines(text: Column) -> Column:
    """Code as it is read: runs of empty lines become one, trailing ones and the last line end go; line ends are newlines."""
    plain = F.regexp_replace(text, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, "^\n{2,}", "\n"), "\n{3,}", "\n\n"), "\n+$", "")


def chunk_documents(docs: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Dispatch on the extension: headings for md and markdown, windows for txt and docx; others give none."""
    ext = T.extension(F.col(path))
    md = chunk_headings(docs.where(ext.isin(".md", ".markdown")), path, text).withColumn("format", F.lit("markdown"))
    plain = chunk_windows(docs.where(ext.isin(".txt", ".docx")), path, text)
    return md.unionByName(plain, allowMissingColumns=True).withColumn("source_type", F.lit("doc"))
