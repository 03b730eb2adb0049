import random

from ragloom.llm import pieces as op

S = "seq long, text string, max_chars int, overlap_chars int, k long, n string, lim int"


def cut(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], S)
    out = {}
    for p in op.pieces(df, "seq").collect():
        out.setdefault(p.seq, []).append(p)
    return {k: sorted(v, key=lambda p: p.piece_no) for k, v in out.items()}


def check(text, limit, overlap, got):
    assert [p.piece_no for p in got] == list(range(len(got)))
    assert "".join(text[p.own_start : p.end_char] for p in got) == text
    for a, p in enumerate(got):
        assert p.text == text[p.start_char : p.end_char] and len(p.text) <= limit
        if a:
            assert p.own_start == got[a - 1].end_char and p.start_char == max(0, p.own_start - min(overlap, limit // 2))


def test_round_trip_of_many_kinds(spark):
    rng = random.Random(3)
    alphabet = ["a", "b ", ". ", "\n", "\r\n", "\n\n", "é", "é", "日本。", "😀", "👩‍👩‍👧", "x" * 30]
    rows = []
    for k in range(40):
        text = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 5, 300, 6000])))
        rows.append((k, text, rng.choice([1, 2, 40, 333, 1000]), rng.choice([0, 1, 25, 400])))
    got = cut(spark, rows)
    for k, text, limit, overlap in rows:
        check(text, limit, overlap, got[k])


def test_giant_item_over_many_ranges(spark):
    text = ("A sentence ends here. " * 40 + "\n\n") * 120
    got = cut(spark, [(1, text, 700, 60)])[1]
    check(text, 700, 60, got)
    assert len(text) > 10 * op.RANGE and sum(text[p.end_char - 1].isspace() for p in got) > 0.99 * len(got)


def test_boundaries_are_natural(spark):
    text = "one two three. " * 10 + "\n\n" + "four five six. " * 10
    got = cut(spark, [(1, text, 195, 0)])[1]  # the break lies in the first search window
    assert got[0].text.endswith("\n\n")


def test_defined_cases(spark):
    rows = [(1, None, 10, 0), (2, "", 10, 0), (3, "long enough text", None, 3), (4, "x" * 50, 0, 0), (5, "x" * 50, 20, None), (None, "y" * 50, 10, 0), (6, "z" * 50, 20, -4)]
    got = cut(spark, rows)
    assert sorted(got) == [2, 3, 4, 5, 6]
    assert len(got[2]) == len(got[3]) == len(got[4]) == 1
    check("x" * 50, 20, 0, got[5])
    check("z" * 50, 20, 0, got[6])


def test_no_rows_and_no_long_rows(spark):
    assert cut(spark, []) == {}
    assert len(cut(spark, [(1, "short", 10, 2)])[1]) == 1


def test_limits_match_without_case(spark):
    items = spark.createDataFrame([(1, " docs ", "t", 5), (2, None, "t", 5), (3, "NONE", "t", 5)], "seq long, collection string, text string, max_chars int")
    registry = spark.createDataFrame([("DOCS", 20, 3)], "name string, max_chars int, overlap_chars int")
    got = {r.seq: r.max_chars for r in op.with_limits(items, registry).collect()}
    assert got == {1: 20, 2: None, 3: None}


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(5)
    texts = {"a.txt": "".join(rng.choice(["word ", "é日😀. ", "\n\n", "x" * 9]) for _ in range(4000)), "b.txt": "short", "c.txt": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    sizes = spark.createDataFrame([(str(tmp_path / n), len(t.encode())) for n, t in texts.items()], "path string, length long")
    for range_bytes in (1000, 5000):
        got: dict = {}
        for p in op.file_pieces(spark, sizes, 700, 60, range_bytes).collect():
            got.setdefault(p.path.rsplit("/", 1)[1], []).append(p)
        assert set(got) == {"a.txt", "b.txt"} and [p.text for p in got["b.txt"]] == ["short"]
        check(texts["a.txt"], 700, 60, sorted(got["a.txt"], key=lambda p: p.piece_no))
