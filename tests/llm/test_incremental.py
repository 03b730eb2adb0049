import random

import pytest

from ragloom.llm import incremental as op
from ragloom.llm.components import components

S = "seq long, batch_no int, text string, file_path string, collection string, key long, norm string"


def test_shared_in_order():
    assert op.shared_in_order("a b c d".split(), "a x c d".split()) == 3
    assert op.shared_in_order([], ["a"]) == 0
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert op.shared_in_order(a, b) == table[-1][-1]


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def _units(rng, n):
    words = [f"w{k}" for k in range(900)]
    return [" ".join(rng.choice(words) for _ in range(60)) for _ in range(n)]


def _edit(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_against_brute_force(spark):
    rng = random.Random(8)
    base = _units(rng, 30)
    opening = "Notes for the maintainers of this part of the tool which all of these share. "
    rows, seq = [], 0
    for batch in range(3):
        for _ in range(30):
            kind = rng.randrange(5)
            text = rng.choice(base) if kind < 3 else opening + _units(rng, 1)[0]
            if kind == 1:
                text = text.upper().replace(" ", ",  ", 9)
            if kind == 2:
                text = _edit(rng, text, 5)
            rows.append((seq, batch, text, f"/p{seq % 7}", rng.choice(["A", " a", None]), 1, "x"))
            seq += 1
    hot = _units(rng, 1)[0]
    for k in range(25):  # a group of near-copies of one unit
        rows.append((seq, 1 + k % 2, _edit(rng, hot, 1), None, "B", 1, "x"))
        seq += 1
    rows += [(seq, 1, None, None, None, 1, "x"), (None, 1, hot, None, None, 1, "x"), (seq + 1, None, hot, None, None, 1, "x"), (seq + 2, 0, "", None, None, 1, "x"), (seq + 3, 2, " \n", None, None, 1, "x"), (seq + 4, 2, "?!", None, None, 1, "x"), (seq + 5, 2, "a b", "", "", 1, "x"), (seq + 6, 2, "A, b", "", "", 1, "x")]
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}

    order = sorted((r for r in rows if None not in r[:3]), key=lambda r: (r[1], r[0]))
    words = [op.words_of(r[2]) for r in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in range(len(order)):
        for a in range(b):
            p, q = words[a], words[b]
            same = op.shared_in_order(p, q) >= op.SAME * max(len(p), len(q)) if p and q else p == q and "".join(order[a][2].split()) == "".join(order[b][2].split())
            if same:
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    first = {}
    for k in range(len(order)):
        first[find(k)] = min(first.get(find(k), order[k][0]), order[k][0])
    want = {(first[find(k)], r[0]) for k, r in enumerate(order) if r[1] > 0 and first[find(k)] < r[0]}
    assert got == want


def test_scattered_edits(spark):
    rng = random.Random(3)
    rows = []
    for k, n in enumerate([100] * 30 + [5, 6, 7, 8, 9] * 4):
        words = [f"s{k}x{rng.randrange(10**6)}" for _ in range(n)]
        changed = range(4, n, 5) if n == 100 else [n // 2]  # every fifth word, or the middle one
        edited = [f"e{rng.randrange(10**6)}" if j in changed else w for j, w in enumerate(words)]
        rows += [(k, 0, " ".join(words), None, "A", 1, "x"), (1000 + k, 1, " ".join(edited), None, "A", 1, "x")]
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}
    assert got == {(k, 1000 + k) for k in range(50)}


def test_repeat_of_a_copy_alone(spark):
    base = [f"b{k}" for k in range(100)]
    copy = ["c"] * 1 + base[1:95] + [f"c{k}" for k in range(5)]  # 94 of 100 words
    far = copy[:60] + [f"f{k}" for k in range(18)] + copy[78:]  # 82 of the copy, 77 of the first text
    long = copy + [f"l{k}" for k in range(24)]  # 100 of 124 of the copy, 94 of 124 of the first text
    rows = [(k, b, " ".join(w), None, "A", 1, "x") for k, (b, w) in enumerate([(0, base), (1, copy), (2, far), (3, long)])]
    links = lambda rows: {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}
    assert links(rows) == {(0, 1), (0, 2), (0, 3)}


def test_lone_texts_meet_linked_ones(spark):
    head = [f"d{k}" for k in range(120)]  # with these words, all keys the other two share are keys of the head
    near = head[:110]
    lone = head[:89] + [f"x{k}" for k in range(21)]  # 89 of 110 of the near one, 89 of 120 of the head
    rows = [(k, 1, " ".join(w), None, "A", 1, "x") for k, w in enumerate([head, near, lone])]
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}
    assert got == {(0, 1), (0, 2)}


def test_empty(spark):
    assert op.link_batches(spark.createDataFrame([], S)).collect() == []


def _batch(spark, texts, at):
    return spark.createDataFrame([(at + k, t, "/f", "C") for k, t in enumerate(texts)], "seq long, text string, file_path string, collection string")


def test_store_is_opened_again(spark, tmp_path):
    rng = random.Random(4)
    path = f"file://{tmp_path}/store"
    store = op.Store(spark, path, 2)
    units = _units(rng, 4)
    assert store.add(_batch(spark, units, 0)).collect() == []
    store.close()
    store = op.Store(spark, path)
    assert store.state["batches"] == 1 and store.buckets == 2
    again = {(r.seq_a, r.seq_b) for r in store.add(_batch(spark, [*units[:2], _edit(rng, units[3], 4)], 10)).collect()}
    assert again == {(0, 10), (1, 11), (3, 12)}
    assert store._stored("facts").count() == 5 and store._stored("exact").count() == 5
    store.close()


def test_batch_that_broke_off_is_added_again(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    store = op.Store(spark, f"file://{tmp_path}/store", 2)
    units = _units(rng, 4)
    store.add(_batch(spark, units, 0))
    monkeypatch.setattr(op.Store, "_write_manifest", lambda self: 1 / 0)
    try:
        store.add(_batch(spark, [_edit(rng, units[0], 2)], 10))
    except ZeroDivisionError:
        pass
    store.close()
    monkeypatch.undo()
    store = op.Store(spark, f"file://{tmp_path}/store")
    assert [tuple(r) for r in store.add(_batch(spark, [_edit(rng, units[0], 2), units[1]], 20)).collect()] in ([(0, 20), (1, 21)], [(1, 21), (0, 20)])
    assert store._stored("facts").count() == 5
    store.close()


def test_recall_at_the_edge(spark):
    """Scattered edits at similarities of 0.80 to 0.85, with words of a small vocabulary, so that keys are hot."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows, seq = [], 0
    for n in (20, 40, 80, 200):
        for k in range(60):
            text = [rng.choice(words) for _ in range(n)]
            edited = list(text)
            for j in rng.sample(range(n), int(n * rng.uniform(0.15, 0.199))):
                edited[j] = rng.choice(words)
            rows += [(seq, 0, " ".join(text), None, "A", 1, "x"), (100_000 + seq, 1, " ".join(edited), None, "A", 1, "x")]
            seq += 1
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}
    want = {(k, 100_000 + k) for k in range(seq)}
    assert len(got & want) >= 0.97 * len(want)


def test_hot_and_saturated_keys(spark, monkeypatch):
    """A third of the texts share an opening, another third are near-copies of one unit; both go over several batches."""
    monkeypatch.setattr(op, "HOT", 4)
    monkeypatch.setattr(op, "PAGE", 2)
    rng = random.Random(9)
    opening = " ".join(f"o{k}" for k in range(60))
    body = [f"b{k}" for k in range(60)]
    rows = []
    for seq in range(120):
        if seq % 3 == 0:
            text = opening + " " + " ".join(f"u{seq}x{k}" for k in range(40))
        elif seq % 3 == 1:
            text = _edit(rng, " ".join(body), 3)
        else:
            text = " ".join(f"v{seq}x{k}" for k in range(50))
        rows.append((seq, seq // 40, text, None, "A", 1, "x"))
    rows += [(200 + k, 3, _edit(rng, rows[3 * k][2], 8), None, "A", 1, "x") for k in range(20)]
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S), history=-1).collect()}
    want = {(1, s) for s in range(120) if s % 3 == 1 and s > 1} | {(3 * k, 200 + k) for k in range(20)}
    assert got == want


def test_pages_lead_on(spark, monkeypatch):
    """Texts whose keys are all saturated find their partner on a later page."""
    monkeypatch.setattr(op, "HOT", 1)
    monkeypatch.setattr(op, "PAGE", 1)
    common = [f"c{k}" for k in range(12)]
    rows = [(k, 0, " ".join(common + [f"t{k}y{j}" for j in range(9)]), None, "A", 1, "x") for k in range(6)]
    monkeypatch.setattr(op, "FREE", 1000)
    rows += [(100 + k, 1, rows[k][2].replace(f"t{k}y4", "zz"), None, "A", 1, "x") for k in range(6)]
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S)).collect()}
    assert got == {(k, 100 + k) for k in range(6)}


def _whole(spark, rows):
    got = {(r.seq_a, r.seq_b) for r in op.link_batches(spark.createDataFrame(rows, S), history=-1).collect()}
    words, root = {r[0]: op.words_of(r[2]) for r in rows}, {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for b in words:
        for a in words:
            if a < b and find(a) != find(b) and op.shared_in_order(words[a], words[b]) >= op.SAME * max(len(words[a]), len(words[b])):
                i, j = find(a), find(b)
                root[max(i, j)] = min(i, j)
    return got, {(find(k), k) for k in words if find(k) != k}


def test_crowds_are_compared_as_a_whole(spark, monkeypatch):
    """Texts with many keys of their own that share a saturated opening, and every other word after it, within and over batches."""
    monkeypatch.setattr(op, "HOT", 4)
    monkeypatch.setattr(op, "PAGE", 2)
    monkeypatch.setattr(op, "LOCAL", 0)
    opening, rows = [f"o{k}" for k in range(60)], []
    for k in range(40):
        rows.append((k, k % 2, " ".join(opening + [f"u{k}x{j}" for j in range(40)]), None, "A", 1, "x"))
    for k in range(40):
        for side in (0, 1):
            tail = [f"p{k}x{j}" if j % 2 else f"p{k}y{side}x{j}" for j in range(40)]
            rows.append((100 + 100 * side + k, k % 2 + side, " ".join(opening + tail), None, "A", 1, "x"))
    got, want = _whole(spark, rows)
    assert want == {(100 + k, 200 + k) for k in range(40)}
    assert got == want


def test_crowd_of_one_shingle(spark):
    """Texts that repeat one word have one shingle, so that a hot key can't be split."""
    rows = [(100 * (n % 2) + n, n % 2, "na " * n, None, "A", 1, "x") for n in range(26, 66)]
    got, want = _whole(spark, rows)
    assert got == want == {(26, r[0]) for r in rows if r[0] > 26}


def test_united():
    assert op.united([]) == []
    assert sorted(op.united([(5, 3), (9, 8), (3, 9), (1, 2), (2, 1), (7, 7)])) == [(1, 1), (2, 1), (3, 3), (5, 3), (7, 7), (8, 3), (9, 3)]


def test_store_of_another_format_is_refused(spark, tmp_path):
    store = op.Store(spark, f"file://{tmp_path}/store", 2)
    del store.state["format"]
    store.add(_batch(spark, ["a b c d e f"], 0))
    store.close()
    with pytest.raises(ValueError):
        op.Store(spark, f"file://{tmp_path}/store")


def test_weights():
    assert op.weights_of({}) is None
    counts = {"f_path,0": [1, 9], "f_path,1": [9, 1], "f_coll,0": [5, 5], "f_coll,1": [5, 5], "f_shared,3": [10, 0], "f_shared,0": [0, 10], "f_ratio,2": [10, 10]}
    w = op.weights_of(counts)
    assert w["f_path"][1] > 0 > w["f_path"][0] and abs(w["f_coll"][0]) < 1e-9 and w["f_shared"][3] > w["f_shared"][0]
