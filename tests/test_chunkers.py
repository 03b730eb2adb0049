import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ragloom.functions import text as T
from ragloom.operators import chunkers as C
from ragloom.operators import code_chunks as K
from ragloom.plans import reference_queries


def rows(spark, texts):
    return spark.createDataFrame([(f"/d/{k}.txt", t) for k, t in enumerate(texts)], "path string, text string")


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("abcdefghijkl", 10, 2, [(0, 10, "abcdefghij"), (8, 12, "ijkl")]),
        ("abcdefghi", 10, 2, [(0, 9, "abcdefghi"), (8, 9, "i")]),
        ("abcdefgh", 10, 2, [(0, 8, "abcdefgh")]),
        ("ab      cdef", 4, 1, [(0, 2, "ab"), (6, 8, "cd"), (9, 12, "def")]),
        (" \n ", 10, 2, []),
        ("", 10, 2, []),
        (None, 10, 2, []),
    ],
)
def test_windows(spark, text, size, overlap, want):
    got = C.chunk_windows(rows(spark, [text]), size=size, overlap=overlap).orderBy("start_char").collect()
    assert [(r.start_char, r.end_char, r.text) for r in got] == want


@pytest.mark.parametrize(("text", "want"), [("# a\nx\n## b\ny\n", [(1, "# a\nx"), (2, "## b\ny")]), ("intro\n# a\n#include <x>\n", [(0, "intro"), (1, "# a"), (2, "#include <x>")]), ("x #no\n", [(0, "x #no")]), ("", [])])
def test_headings(spark, text, want):
    got = C.chunk_headings(rows(spark, [text])).orderBy("block_index").collect()
    assert [(r.block_index, r.text) for r in got] == want


@pytest.mark.parametrize(("text", "want"), [("abcdef\nghijklm", ["abcdef\n", "ghijklm"]), ("abc\ndefghijklm", ["abc\ndefghi", "jklm"]), ("abcde\nfghijklm", ["abcde\nfghi", "jklm"]), ("abcdefghij", ["abcdefghij"]), ("", [""])])
def test_split(spark, text, want):
    assert rows(spark, [text]).select(C.split_at_newlines(F.col("text"), 10).alias("p")).first().p == want


def _split(text, size):
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            k = text.rfind("\n", at, end)
            end = k + 1 if k > at + size // 2 else end
        out.append(text[at:end])
        at = end
    return out


def test_split_against_a_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab\n\r😀") for _ in range(rng.randrange(200))) for _ in range(80)]
    got = rows(spark, texts).select("text", C.split_at_newlines(F.col("text"), 13).alias("p")).collect()
    assert all(r.p == _split(r.text, 13) for r in got)


def test_all_pieces_of_long_blocks_come_out(spark, tmp_path):
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abc \n😀") for _ in range(n))
    texts = ["# a\n" + prose(7000) + "\n## b\n" + prose(300), prose(2500), "x" * 4001, "#\n#\n" + prose(2000), " \n", "", None]
    spark.createDataFrame([(k, "s", t) for k, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in reference_queries.QUERIES["chunk_markdown"](spark, str(tmp_path)).collect()]
    want = []
    for k, text in enumerate(texts):
        for i, raw in enumerate(re.split("(?m)^(?=#)", text or "")):
            block = raw.strip(T.WHITESPACE)
            want += [(f"/s/{k}.txt", i, j, hashlib.md5(p.encode()).hexdigest()) for j, p in enumerate(_split(block, 2000)) if block]
    assert sorted(got) == sorted(want) and max(r[2] for r in want) >= 3


def test_oversize_goes_last(spark):
    df = spark.createDataFrame([(0, "i0", "x" * 25), (1, "i1", "short"), (2, None, None)], "seq long, id string, text string")
    got = C.split_oversize(df, 20).orderBy("was_split", "seq", "piece").collect()
    assert [r.id.split("_")[0] for r in got] == ["i1", "i0#split0", "i0#split1", "i0#split2"]


def test_pages_and_dispatch(spark):
    pages = spark.createDataFrame([("/p.pdf", 1, ["", "ab", "cd "]), ("/p.pdf", 2, []), ("/p.pdf", 3, None)], "path string, page_number int, lines array<string>")
    assert [(r.page_number, r.text) for r in C.chunk_pages(pages).collect()] == [(1, "ab\ncd")]
    docs = spark.createDataFrame([("/a.MD", "# x"), ("/b.txt", "y"), ("/c.doc", "z")], "path string, text string")
    assert {(r.file_path, r.format) for r in C.chunk_documents(docs).collect()} == {("/a.MD", "markdown"), ("/b.txt", None)}


def test_blank_lines(spark):
    for text in ("a\n\n\nb\n\n", "\n\n\na", "", "a\r\n\r\n\r\nb"):
        got = rows(spark, [text]).select(C.collapse_blank_lines(F.col("text")).alias("t")).first().t
        assert got == "".join(K.read_lines(text))
    assert K.read_lines("a\n\n\nb\n\n") == ["a\n", "\n", "b"]


CODE = """// Copyright (c) 2020 Someone. All rights reserved.
#include <x>

// doc
// ----
static int f(const char* a, int b = 3, ...) { return a[0] == '{'; }

/* doc
 */
void N::g(struct S s, int (*cb)(int), T& t) {
}
namespace n {
class A final : public B { int m() { return 1; } };
enum E { X };
}
int table[] = { 1, 2 };
struct P;
"""


def test_code_units():
    got = {r[6]: r for r in K.chunks_of("/s/a.cpp", CODE) if r[5] != "leftover_block"}
    assert {k: v[5] for k, v in got.items()} == {"f": "function", "N::g": "function", "A": "class", "E": "enum"}
    assert got["f"][1].startswith("\n// doc\nstatic") and got["f"][8] == "a"
    assert got["N::g"][8] == "s,cb,t" and got["N::g"][9] == "N::g(s, cb, t)"
    assert got["N::g"][1].startswith("void")  # a comment of several lines ends the walk
    left = [r for r in K.chunks_of("/s/a.cpp", CODE) if r[5] == "leftover_block"]
    assert not any("Copyright" in r[1] for r in left) and any("int table" in r[1] for r in left)
    spans = [(r[3], r[4]) for r in got.values()]
    covered = {k for a, b in spans for k in range(a, b + 1)} | {k for r in left for k in range(r[3], r[4] + 1)}
    assert all(k in covered or not line.strip() for k, line in enumerate(K.read_lines(CODE), 1))


def test_leftover_newlines():
    assert [(r[1], r[3], r[4]) for r in K.chunks_of("a.c", "int a;\nint b;\n")] == [("int a;\n\nint b;", 1, 2)]


def test_code_edge_cases(spark):
    df = spark.createDataFrame([("/a.c", ""), ("/b.c", None), (None, "int x;"), ("/c.c", "}}} {{{ \"unclosed"), ("/d.c", "x" * 100000)], "file_path string, text string")
    assert {r.file_path for r in K.chunk_code(df).collect()} <= {"/c.c", "/d.c"}
