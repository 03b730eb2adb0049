import hashlib

import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as T


def ev(spark, c, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(c.alias("r")).first().r


def test_strip_and_lines(spark):
    s = "\x1c\x85  a b \x1f\n"
    assert ev(spark, T.strip(F.col("x")), x=s) == s.strip()
    for s in ("a\r\nb\n", "a\x0bb\x0cc\x1cd\x85e f", "", "x", "\n\n"):
        assert ev(spark, T.split_lines(F.col("x")), x=s) == s.splitlines()
    assert ev(spark, T.strip(F.col("x")), x=None) is None


def test_hash(spark):
    for s, h in (("alpha", "2c1743a3"), ("b", "92eb5ffe"), ("hé😀", "7510e1df")):
        assert ev(spark, T.short_hash(F.col("x")), x=s) == h == hashlib.md5(s.encode()).hexdigest()[:8]


@pytest.mark.parametrize(("line", "yes"), [("// ---", True), ("// --", False), ("//===*~", True), ("// -a-", False), ("---", False), ("  // ___ ", True)])
def test_separator(spark, line, yes):
    assert ev(spark, T.is_separator(F.col("x")), x=line) is yes


@pytest.mark.parametrize(("text", "yes"), [("// Copyright (c) 2010 X", True), ("// Copyright X Corp", False), ("// licensed to you", True), ("// see license file", False), ("// LGPL", True), ("// GPL", False)])
def test_license(spark, text, yes):
    assert ev(spark, T.is_license(F.col("x")), x=text) is yes


@pytest.mark.parametrize(
    ("path", "source", "page", "start", "end", "want"),
    [
        ("/docs/a.pdf", None, 3, 0, 0, "/docs/a.pdf : p 3"),
        ("/docs/a.pdf", None, 0, 10, 20, "/docs/a.pdf : 10-20"),
        ("/docs/a.pdf", None, 0, 10, 10, "/docs/a.pdf : 10"),
        ("/docs/a.pdf", None, 3, 10, 20, "/docs/a.pdf : p 3, 10-20"),
        ("/docs/a.pdf", None, 0, 0, 0, "/docs/a.pdf"),
        ("{SRC}/x.cpp", None, 0, 0, 0, "/src/x.cpp"),
        ("$SRC$/x.cpp", None, 0, 0, 0, "/src/x.cpp"),
        ("", "s", 0, 0, 0, "s"),
        (None, None, 0, 0, 0, "the-id"),
    ],
)
def test_source_label(spark, path, source, page, start, end, want):
    c = T.source_label(F.col("p"), F.col("s"), F.lit("the-id"), F.col("g"), F.col("a"), F.col("b"))
    assert ev(spark, c, p=path, s=source, g=page, a=start, b=end) == want


@pytest.mark.parametrize(("node", "path", "want"), [("function", "a.h", "c"), ("function", "a.hpp", "cpp"), ("leftover_block", "A.C", "c"), ("class", "a.cpp", "markdown"), (None, "a.pdf", "markdown")])
def test_fence(spark, node, path, want):
    assert ev(spark, T.fence_language(F.col("n"), F.col("p")), n=node, p=path) == want


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("[ a.cpp ](/src/a.cpp)", "[a.cpp](/src/a.cpp)"),
        ("[/src/a.cpp](a.cpp)", "[/src/a.cpp](/src/a.cpp)"),
        ("[x](http://e)", "[x](http://e)"),
        ("[ /a ](/a)", "[ /a ](/a)"),
        ("[/a]( /a )", "[/a]( /a )"),
        ("[  ](/docs/p.pdf)", "[/docs/p.pdf](/docs/p.pdf)"),
        ("no link", "no link"),
        ("a [x](/b) c [/d](e) f", "a [x](/b) c [/d](/d) f"),
        ("", ""),
    ],
)
def test_links(spark, link, want):
    assert ev(spark, T.normalise_links(F.col("x")), x=link) == want


def test_small_functions(spark):
    assert [ev(spark, T.human_size(F.lit(n).cast("long"))) for n in (0, 5, 2048, 3 << 20, 5 << 30)] == ["", "5 bytes", "2.00 KB", "3.00 MB", "5.00 GB"]
    assert ev(spark, T.users(F.col("x")), x="a:b, c : d:e ,bad,a:z,:q") == {"a": "z", "c": "d:e", "": "q"}
    assert ev(spark, T.users(F.col("x")), x=None) == {}
    assert [ev(spark, T.temperature(F.lit(m))) for m in ("x-mini", "x-nano-1", "big")] == [1, 1, 0]
    ids = {r.r for r in spark.range(50).select(T.session_id().alias("r")).collect()}
    assert len(ids) > 45 and all(len(i) == 8 and i.isalnum() for i in ids)
    assert ev(spark, T.chat_file_name(F.col("x"), F.lit("2024-03-05 06:07:08").cast("timestamp")), x="jö/x y") == "jö_x_y_05_mar_2024_06_07_08.json"
    assert [ev(spark, T.extension(F.col("x")), x=n) for n in (".h", "a.H", "a/.b", "a.b.cpp", "x")] == ["", ".h", "", ".cpp", ""]
    assert ev(spark, T.token_estimate(F.lit("abcdefgh"))) == 2
