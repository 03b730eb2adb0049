from ragloom.llm.rank_fusion import leximin

S = "qid long, id string, score double, collection_name string, g string, pct double"


def run(spark, rows, top=None):
    got = leximin(spark.createDataFrame([(*r, "x", 9.0) for r in rows], S), top=top).collect()
    return {(r.qid, r.position): (r.id, list(r.pcts)) for r in got}


def test_weak_list_is_not_masked(spark):
    rows = [(1, "a", 1000.0, "X"), (1, "b", 900.0, "X"), (1, "c", 10.0, "X"), (1, "a", 0.1, "Y"), (1, "b", 0.2, "Y"), (1, "c", 0.3, "Y")]
    got = run(spark, rows)
    assert got[(1, 1)][0] == "b" and got[(1, 1)][1] == [2 / 3, 2 / 3]


def test_null_nan_missing_repeats_and_case(spark):
    rows = [(1, "a", 1.0, "X"), (1, "a", 1.0, " x "), (1, "b", float("nan"), "X"), (1, "c", None, "X"), (1, "b", 5.0, "Y"), (None, "z", 1.0, "X"), (1, None, 1.0, "X"), (1, "q", 1.0, None), (2, "a", None, "X")]
    got = run(spark, rows)
    assert got == {(1, 1): ("a", [0.0, 1.0]), (1, 2): ("b", [0.0, 1.0])}


def test_ties_and_zeros(spark):
    got = run(spark, [(1, x, s, "X") for x, s in (("a", 0.0), ("b", -0.0), ("c", 1.0))], top=2)
    assert [got[(1, k)][0] for k in (1, 2)] == ["c", "a"] and got[(1, 2)][1] == [2 / 3]


def test_empty(spark):
    assert run(spark, []) == {}


def test_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [(q, f"i{rng.randrange(30)}", float(rng.randrange(12)), rng.choice("XYZ")) for q in range(3) for _ in range(90)]
    best = {}
    for q, i, s, c in rows:
        best[q, c, i] = max(s, best.get((q, c, i), s))
    want = {}
    for q in range(3):
        lists = {c: [s for (a, b, _), s in best.items() if (a, b) == (q, c)] for c in "XYZ"}
        items = {i for (a, _, i) in best if a == q}
        vec = {i: sorted(sum(x <= best[q, c, i] for x in lists[c]) / len(lists[c]) if (q, c, i) in best else 0.0 for c in "XYZ") for i in items}
        for k, i in enumerate(sorted(items, key=lambda i: ([-x for x in vec[i]], i)), 1):
            want[q, k] = (i, vec[i])
    assert run(spark, rows) == want
