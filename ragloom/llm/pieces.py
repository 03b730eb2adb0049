"""Cutting oversized items at natural boundaries, by ranges.

An item is read in ranges of RANGE characters with a halo on each side; they are sliced from a stored
text in one walk, or read by offset from a giant file (sources.files.text_ranges, file_pieces), and no
later stage needs the whole text of a piece's item. Each range detects its boundaries and keeps, for each cell of the
item's grid, the best one: paragraph, line, sentence, word, any safe place, any place. Boundary
tables of neighbouring ranges are stitched by taking the best of each cell. The cut of cell k is the
best boundary in its search window, the last quarter before k times the step, so every piece fits
the limit whatever its neighbours choose, and all cuts are found independently, without a walk along
the item. Pieces are emitted by offset from the ranges they cover.

With step s and window w: length of a piece = cut(k) - cut(k-1) + overlap <= s + w - 1 + overlap <= limit.

Defined cases: null text gives no piece; an item within its limit, the empty text included, is one
piece; a null limit, or one below 1, does not limit; a null or negative overlap is 0, and an overlap
above half the limit is cut to it. Offsets count code points of the item's text. A key that is null
is dropped; keys must be unique (each stored row counts as an item). A cut never parts CR LF, a
character from its combining marks, joiners or selectors, if any other place exists in the window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.runtime import cut
from ragloom.sources.files import text_ranges

#: Characters of a range and of the halo on each side of it.
RANGE, HALO = 8192, 48
#: Ranges of one text that are handed on at once.
AT_ONCE = 256
#: Strengths of boundaries.
PARAGRAPH, LINE, SENTENCE, WORD, SAFE, ANY = 5, 4, 3, 2, 1, 0

_PATTERNS = (
    (WORD, re.compile(r"\s(?=\S)")),
    (SENTENCE, re.compile(r"[.!?;:…][\"'”’)\]]*\s(?=\S)|[。！？；][」』”’）]?(?=.)", re.S)),
    (LINE, re.compile(r"(?:\r\n|\n|\r| |\x85)")),
    (PARAGRAPH, re.compile(r"(?:\r?\n[ \t]*){2,}| |\n(?=#{1,6} |```)")),
)
_EXTENDS = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟऀ-ःऺ-ॏัิ-ฺ็-๎᪰-᫿᷀-᷿‌‍⃐-⃿゙゚︀-️︠-︯\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef\U000e0020-\U000e007f]|(?<=‍).|(?<=\r)\n")


def step_of(limit: Column, overlap: Column) -> Column:
    """The grid's step: 4/5 of the room beside the overlap, 1 at least."""
    return F.greatest(F.lit(1), F.floor((limit - overlap) * 4 / 5).cast("long"))


def window_of(limit: Column, overlap: Column) -> Column:
    """Characters before a grid line where its cut may lie."""
    room = limit - overlap
    return F.greatest(F.lit(1), F.least(room - step_of(limit, overlap) + 1, step_of(limit, overlap)))


def best_in_windows(text: str, start: int, own_from: int, own_to: int, step: int, window: int) -> list[tuple[int, int, int]]:
    """(cell, strength, position) of the best boundary of each cell in [own_from, own_to) of text.

    text begins at item offset start; a boundary at offset x cuts before the character x.
    """
    n = len(text)
    strength = np.zeros(n + 1, dtype=np.int8)
    strength[:] = SAFE
    for value, pattern in _PATTERNS:
        for m in pattern.finditer(text):
            if strength[m.end()] < value:
                strength[m.end()] = value
    for m in _EXTENDS.finditer(text):
        strength[m.start()] = ANY
    at = np.arange(own_from, own_to)
    cell = (at + step - 1) // step  # a cut at k * step belongs to cell k
    inside = (cell >= 1) & (at > cell * step - window)
    at, cell = at[inside], cell[inside]
    if not len(at):
        return []
    value = strength[at - start].astype(np.int64)
    order = np.lexsort((at, value, cell))
    last = np.append(np.flatnonzero(np.diff(cell[order])), len(order) - 1)
    keep = order[last]
    return list(zip(cell[keep].tolist(), value[keep].tolist(), at[keep].tolist()))


def ranges(items: DataFrame, key: str, text: str, limit: str, overlap: str) -> DataFrame:
    """(k, n, lim, ov, r, lo, hi, start, part): the ranges [lo, hi) of the items above their limit; part has them with halos from start on."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("k"), F.col(text).alias("t"), F.length(text).cast("long").alias("n"), F.col(limit).cast("long").alias("lim"), F.greatest(F.lit(0), F.coalesce(F.col(overlap), F.lit(0))).cast("long").alias("o")
    )
    rows = rows.withColumn("lim", F.when(F.col("lim") >= 1, F.col("lim"))).withColumn("ov", F.least("o", F.floor(F.col("lim") / 2)))
    kind = dict(items.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                n = len(text)
                lows = np.arange(0, n, RANGE)
                for a in range(0, len(lows), AT_ONCE):  # a giant text leaves in several batches
                    some = lows[a : a + AT_ONCE]
                    starts = np.maximum(0, some - HALO)
                    same = pa.array(np.full(len(some), i, np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), pa.array(np.full(len(some), n, np.int64)), batch.column(2).take(same), batch.column(3).take(same), pa.array(some // RANGE), pa.array(some), pa.array(np.minimum(some + RANGE, n)), pa.array(starts), pa.array([text[s : x + RANGE + HALO] for s, x in zip(starts.tolist(), some.tolist())], pa.string())],
                        names=["k", "n", "lim", "ov", "r", "lo", "hi", "start", "part"],
                    )

    return rows.where("n > lim").select("k", "t", "lim", "ov").mapInArrow(run, f"k {kind}, n long, lim long, ov long, r long, lo long, hi long, start long, part string")


def cuts(parts: DataFrame, key_type: str) -> DataFrame:
    """(k, n, lim, ov, cell, cut): the best boundary of each cell, stitched over the ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, cell, value, at = [], [], [], []
            cols = batch.to_pydict()
            for i, part in enumerate(cols["part"]):
                for c, v, x in best_in_windows(part, cols["start"][i], cols["lo"][i], cols["hi"][i], cols["step"][i], cols["win"][i]):
                    src.append(i)
                    cell.append(c)
                    value.append(v)
                    at.append(x)
            take = pa.array(src, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(j).take(take) for j in range(4)] + [pa.array(cell, pa.int64()), pa.array(value, pa.int32()), pa.array(at, pa.int64())],
                names=["k", "n", "lim", "ov", "cell", "value", "at"],
            )

    lim, ov = F.col("lim"), F.col("ov")
    schema = f"k {key_type}, n long, lim long, ov long, cell long, value int, at long"
    own = parts.select("k", "n", "lim", "ov", "lo", "hi", "start", "part", step_of(lim, ov).alias("step"), window_of(lim, ov).alias("win")).mapInArrow(run, schema)
    best = own.groupBy("k", "cell").agg(F.max(F.struct("value", "at")).alias("b"), F.first("n").alias("n"), F.first("lim").alias("lim"), F.first("ov").alias("ov"))
    inner = best.select("k", "n", "lim", "ov", "cell", F.col("b.at").alias("cut")).where((F.col("cell") * step_of(lim, ov) < F.col("n")))
    return inner


def spans(parts: DataFrame, key_type: str) -> DataFrame:
    """(k, piece_no, start_char, end_char, own_start) of the pieces of oversized items.

    own_start is where the piece goes on from the one before; start_char lies the overlap before it.
    """
    found = cuts(parts, key_type)
    lim, ov = F.col("lim"), F.col("ov")
    ends = parts.where("r = 0").select("k", "n", "lim", "ov", F.ceil(F.col("n") / step_of(lim, ov)).cast("long").alias("cell"), F.col("n").alias("cut"))
    every = found.join(ends.select("k", F.col("cell").alias("last")), "k").where("cell < last").drop("last").select("k", "n", "lim", "ov", "cell", "cut").unionByName(ends)
    # the cut before is that of the cell before: each cut is sent to its own and to the next cell, no window over an item
    both = every.select("k", "cell", F.struct("n", "lim", "ov", "cut").alias("own"), F.lit(None).cast("long").alias("prev")).unionByName(
        every.where("cut < n").select("k", (F.col("cell") + 1).alias("cell"), F.lit(None).cast("struct<n:long,lim:long,ov:long,cut:long>").alias("own"), F.col("cut").alias("prev"))
    )
    paired = both.groupBy("k", "cell").agg(F.max("own").alias("own"), F.max("prev").alias("prev")).where("own IS NOT NULL")
    start = F.coalesce("prev", F.lit(0))
    return paired.select(
        "k", (F.col("cell") - 1).alias("piece_no"), F.greatest(F.lit(0), start - F.when(F.col("prev").isNotNull(), F.col("own.ov")).otherwise(0)).alias("start_char"), F.col("own.cut").alias("end_char"), start.alias("own_start")
    )


def _assembled(shards: DataFrame) -> DataFrame:
    """(k, piece_no, start_char, end_char, own_start, text) from the ranges (r, lo, hi, start, part) each piece covers."""
    from_, to = F.greatest("start_char", "lo"), F.least("end_char", "hi")
    text = F.substring("part", (from_ - F.col("start") + 1).cast("int"), (to - from_).cast("int"))
    each = F.array_sort(F.collect_list(F.struct("r", text.alias("s"))))  # ranges of one piece
    joined = shards.groupBy("k", "piece_no", "start_char", "end_char", "own_start").agg(F.array_join(F.transform(each, lambda x: x["s"]), "").alias("text"))
    return joined.select("k", F.col("piece_no").cast("int").alias("piece_no"), "start_char", "end_char", "own_start", "text")


def pieces(items: DataFrame, key: str, text: str = "text", limit: str = "max_chars", overlap: str = "overlap_chars", only_cut: bool = False) -> DataFrame:
    """(key, piece_no, start_char, end_char, own_start, text): all pieces of all items.

    only_cut leaves out the items that fit their limit.
    """
    kind = dict(items.dtypes)[key]
    parts = ranges(items, key, text, limit, overlap)
    cut_spans = spans(parts, kind)
    cover = cut_spans.withColumn("r", F.explode(F.expr(f"sequence(start_char div {RANGE}, (end_char - 1) div {RANGE})")))
    out = _assembled(cover.join(parts.select("k", "r", "lo", "hi", "start", "part"), ["k", "r"])).withColumnRenamed("k", key)
    if only_cut:
        return out
    n = F.length(text).cast("long")
    whole = items.where(F.col(key).isNotNull() & F.col(text).isNotNull() & ~F.coalesce((n > F.col(limit)) & (F.col(limit) >= 1), F.lit(False))).select(
        key, F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_char"), n.alias("end_char"), F.lit(0).cast("long").alias("own_start"), F.col(text).alias("text")
    )
    return out.unionByName(whole)


def with_limits(items: DataFrame, registry: DataFrame) -> DataFrame:
    """items with max_chars and overlap_chars of their collection; names match without case and outer blanks."""
    name = lambda c: F.upper(F.trim(c))
    limits = registry.groupBy(name(F.col("name")).alias("_rl_name")).agg(F.max("max_chars").alias("max_chars"), F.max_by("overlap_chars", "max_chars").alias("overlap_chars"))
    rows = items.drop("max_chars", "overlap_chars").withColumn("_rl_name", name(F.col("collection")))
    return rows.join(limits, "_rl_name", "left").drop("_rl_name")


def file_pieces(spark: SparkSession, sizes: DataFrame, limit: int, overlap: int, range_bytes: int = 4 << 20) -> DataFrame:
    """(path, piece_no, start_char, end_char, own_start, text): the pieces of giant files (path, length in bytes).

    Workers seek to byte ranges with halos, prefix sums of the ranges' lengths give their offsets in
    characters, and pieces are put together by offset from the ranges they cover; no file is loaded as
    a whole. A file within the limit is one piece; an empty one has none.
    """
    read = cut(text_ranges(spark, sizes, range_bytes, HALO).where("n > 0"))
    total = read.groupBy("path").agg(F.sum("n").alias("total"))
    rows = read.join(total, "path").select(F.col("path").alias("k"), F.col("total").alias("n"), F.lit(limit).cast("long").alias("lim"), F.lit(min(max(0, overlap), limit // 2)).cast("long").alias("ov"), "r", "lo", (F.col("lo") + F.col("n")).alias("hi"), "start", "part")
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / range_bytes), F.floor((b - 1) / range_bytes)))
    # ranges hold at most range_bytes characters; both sides meet in the cells of a grid of that many
    laid = spans(rows, "string").withColumn("cell", cells(F.col("start_char"), F.col("end_char")))
    grid = rows.select("k", "r", "lo", "hi", cells(F.col("lo"), F.col("hi")).alias("cell"))
    met = laid.join(grid, ["k", "cell"]).where("lo < end_char AND hi > start_char").drop("cell", "lo", "hi").distinct()
    return _assembled(met.join(rows.select("k", "r", "lo", "hi", "start", "part"), ["k", "r"])).withColumnRenamed("k", "path")
