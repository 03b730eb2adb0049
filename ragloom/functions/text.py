"""Scalar text functions as column expressions.

All of them pass null through unless the docstring says otherwise; lengths and offsets count code
points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end and begin a stripped text.
WHITESPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))
# Line ends besides CR LF.
LINE_ENDS = "".join(map(chr, [10, 11, 12, 13, 28, 29, 30, 133, 8232, 8233]))
# Words of licence texts; a word inside another counts with it.
LICENSE_WORDS = [
    "copyright", "license", "licensed", "all rights reserved",
    "permission is hereby granted", "permission is granted",
    "software is provided", 'provided "as is"', "provided 'as-is'",
    "without warranty", "express or implied",
    "in no event shall", "authors be held liable",
    "redistribute", "modification", "sublicense",
    "apache license", "mit license", "bsd license", "gpl",
    "gnu general public", "lgpl", "mozilla public license",
    "creative commons", "public domain",
    "this file is part of", "originally written by",
    "spdx-license-identifier",
]


def strip(c: Column) -> Column:
    """Without white space at both ends, the Unicode kind included."""
    return F.trim(c, F.lit(WHITESPACE))


def split_lines(c: Column) -> Column:
    """Lines at every kind of line end; a final line end begins no line. Empty text has no line."""
    parts = F.split(c, "\r\n|[" + LINE_ENDS + "]", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def short_hash(c: Column) -> Column:
    """First eight hex digits of the MD5 of the UTF-8 text."""
    return F.left(F.md5(c.cast("binary")), F.lit(8))


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 3).cast("int")


def is_separator(line: Column) -> Column:
    """A line comment of three or more drawing characters only."""
    return F.trim(line, F.lit(WHITESPACE)).rlike(r"^//\s*[-=*#~_]{3,}$")


def license_hits(text: Column) -> Column:
    """Number of licence words that the text contains, each once."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in LICENSE_WORDS), F.lit(0))


def is_license(text: Column) -> Column:
    """Two licence words, or a copyright line with a year."""
    return (license_hits(text) >= 2) | F.lower(text).rlike(r"copyright\s*(\(c\)|©)?\s*\d{4}")


def fence_language(node_type: Column, path: Column) -> Column:
    """Language of a chunk's fence; code units other than functions and leftovers count as markdown."""
    low = F.lower(F.coalesce(path, F.lit("")))
    code = F.coalesce(node_type.isin("function", "leftover_block"), F.lit(False))
    return F.when(code, F.when(low.endswith(".c") | low.endswith(".h"), "c").otherwise("cpp")).otherwise("markdown")


def source_label(path: Column, source: Column, id_: Column, page: Column, start: Column, end: Column) -> Column:
    """The path (else source, else id; empty counts as missing) with its page and lines; 0 counts as missing."""
    base = F.coalesce(F.nullif(path, F.lit("")), F.nullif(source, F.lit("")), id_)
    for old, new in (("DOCS", "/docs/"), ("SRC", "/src/"), ("EXAMPLES", "/examples/")):
        base = F.replace(F.replace(base, F.lit("{" + old + "}/"), F.lit(new)), F.lit(f"${old}$/"), F.lit(new))
    page, start, end = (F.nullif(x.cast("int"), F.lit(0)) for x in (page, start, end))
    lines = F.when(start.isNotNull() & end.isNotNull() & (start != end), F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(F.coalesce(start, end).cast("string"))
    place = F.concat_ws(", ", F.when(page.isNotNull(), F.concat(F.lit("p "), page.cast("string"))), lines)
    return F.when(place == "", base).otherwise(F.concat(base, F.lit(" : "), place))


def normalise_links(c: Column) -> Column:
    """Markdown links to repository paths: a target that begins with / keeps its trimmed text (or itself,
    if that is empty), a text that begins with / becomes the target; links whose parts are equal, and
    all others, stay."""
    link = r"\[([^\]]+)\]\(([^)]+)\)"

    def fix(found: Column) -> Column:
        text, target = F.regexp_extract(found, link, 1), F.regexp_extract(found, link, 2)
        bare, aim = strip(text), strip(target)
        make = lambda a, b: F.concat(F.lit("["), a, F.lit("]("), b, F.lit(")"))
        return (
            F.when(bare == aim, found)
            .when(F.startswith(target, F.lit("/")), make(F.when(bare == "", target).otherwise(bare), target))
            .when(F.startswith(bare, F.lit("/")), make(bare, bare))
            .otherwise(found)
        )

    between = F.split(c, link, -1)
    links = F.transform(F.regexp_extract_all(c, F.lit(link), F.lit(0)), fix)
    return F.array_join(F.zip_with(between, links, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def safe_name(c: Column) -> Column:
    """All but letters, digits, _, . and - become _."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_.-]", "_")


def chat_file_name(user: Column, at: Column) -> Column:
    return F.concat(safe_name(user), F.lit("_"), F.lower(F.date_format(at, "dd_MMM_yyyy_HH_mm_ss")), F.lit(".json"))


def human_size(n: Column) -> Column:
    """Bytes in words; nothing for 0."""
    f = lambda d, unit: F.format_string("%.2f " + unit, n / F.lit(float(d)))
    return (
        F.when(n <= 0, "")
        .when(n < 1024, F.concat(n.cast("string"), F.lit(" bytes")))
        .when(n < 1024**2, f(1024, "KB"))
        .when(n < 1024**3, f(1024**2, "MB"))
        .otherwise(f(1024**3, "GB"))
    )


def users(c: Column) -> Column:
    """name -> password of a list "a:b,c:d", split at the first colon and trimmed; items without one are skipped, the last wins."""
    items = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(items, lambda x: F.struct(strip(F.regexp_extract(x, r"^([^:]*):", 1)).alias("key"), strip(F.regexp_extract(x, r"^[^:]*:([\s\S]*)$", 1)).alias("value")))
    merged = F.aggregate(pairs, F.expr("map()").cast("map<string,string>"), lambda acc, x: F.map_concat(F.map_filter(acc, lambda k, v: k != x["key"]), F.map_from_arrays(F.array(x["key"]), F.array(x["value"]))))
    return merged


def temperature(model: Column) -> Column:
    """1 for small models, whose temperature is fixed, else 0."""
    return F.when(model.rlike(r"-(mini|nano)"), 1).otherwise(0)


def session_id() -> Column:
    """Eight random small letters and digits."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz0123456789")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substring(letters, F.floor(F.rand() * 36).cast("int") + 1, F.lit(1))), "")


def extension(name: Column) -> Column:
    """Lower-case last extension; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*(\.[^./]*)$", 1))
