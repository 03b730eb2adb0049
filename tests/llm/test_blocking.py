import random

import numpy as np
import pyarrow as pa

from ragloom.llm import blocking
from ragloom.llm import incremental as op

NAMES = [c.split()[0] for c in blocking.BLOCK.split(", ")]


def test_packed():
    for x in ([], [5], [0, 255], [-3, 253, 7], [0, 65535], [1 << 40, (1 << 40) + 70000], [-(1 << 63), (1 << 63) - 1, 0]):
        x = np.array(x, np.int64)
        assert blocking.unpacked(blocking.packed(x)).tolist() == x.tolist()


def test_keys_are_stored_packed(spark, tmp_path):
    """A row holds the keys of many texts."""
    store = op.Store(spark, f"file://{tmp_path}/store", 2)
    rng = random.Random(7)
    texts = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)), "/f", "C") for k in range(40)]
    store.add(spark.createDataFrame(texts, "seq long, text string, file_path string, collection string"))
    rows = store._stored("keys").collect()
    assert len(rows) <= 2 * op.LEVELS
    assert sum(len(r.key) // 8 for r in rows) == 40 * op.KEYS
    store.close()


def _decided(texts, rules, chunk):
    """(stored keys with their texts, hot keys, crowds, pairs) of a batch that is sent in chunks."""
    rows = []
    for at in range(0, len(texts), chunk):
        raw = texts[at : at + chunk]
        made = op.Sketch()([op.words_of(t) for t in raw], raw)
        seq = pa.array(range(at, at + len(raw)), pa.int64())
        rows.append(pa.RecordBatch.from_arrays([seq, pa.array([None] * len(raw), pa.int32()), pa.array([1] * len(raw), pa.int32()), *made.values()], names=["seq", "path", "coll", *made]))
    own = pa.Table.from_batches(blocking.sent(rules, False)(iter(rows)))
    keys, hot, crowds, pairs = set(), set(), set(), set()
    for level in range(1, rules.levels + 1):
        out = blocking.decided(rules, level, False, False)(own, own.slice(0, 0)).to_pylist()
        for r in out:
            if r["what"] == blocking.PAIRS:
                pairs |= set(zip(blocking.unpacked(r["key"]).tolist(), blocking.unpacked(r["seq"]).tolist()))
            elif r["what"] in (blocking.KEYS, blocking.CROWD):
                to = keys if r["what"] == blocking.KEYS else crowds
                to |= set(zip(np.frombuffer(r["key"], "<u8").tolist(), blocking.unpacked(r["seq"]).tolist()))
            elif r["what"] == blocking.HOT:
                hot |= set(np.frombuffer(r["key"], "<u8").tolist())
        own = pa.Table.from_pylist([r for r in out if r["what"] in (blocking.OPEN, blocking.SPLIT)], own.schema)
    return keys, hot, crowds, pairs


def test_chunks_make_no_difference():
    """Keys that are hot for sure in a chunk are split there, the others where all of a key come together."""
    rng = random.Random(11)
    opening = " ".join(f"o{k}" for k in range(40))
    texts = [opening + " " + " ".join(f"u{rng.randrange(400)}" for _ in range(40)) for _ in range(90)] + ["na " * k for k in range(26, 60)]
    rng.shuffle(texts)
    rules = blocking.Rules(4, 3, 2, 2, 0.8, (0,))
    whole = _decided(texts, rules, len(texts))
    assert all(whole)
    for chunk in (1, 7, 30):
        assert _decided(texts, rules, chunk) == whole


def test_crossed():
    """All pairs of a crowd, but for those of one unit and those that bounds exclude, against a plain loop."""
    rng = np.random.default_rng(2)
    n = 80
    sets = rng.integers(-(1 << 63), 1 << 63, (4, n), dtype=np.int64) | rng.integers(-(1 << 63), 1 << 63, (4, n), dtype=np.int64)
    rows = pa.table({"key": rng.integers(0, 3, n), "seq": rng.permutation(n), "unit": rng.integers(0, 9, n), "new": rng.random(n) < 0.5, "n": pa.array(rng.integers(180, 420, n), pa.int32()), **{f"s{k}": sets[k] for k in range(4)}})
    rules = blocking.Rules(4, 3, 2, 2, 0.8, (0,))
    out = blocking.crossed(rules)(rows)
    got = sorted(zip(out["a"].to_pylist(), out["b"].to_pylist()))
    texts, want = rows.to_pylist(), []
    lost = lambda x, y: sum(((x[f"s{k}"] & ~y[f"s{k}"]) & (2**64 - 1)).bit_count() for k in range(4))
    for x in texts:
        for y in texts:
            need = -(-4 * max(x["n"], y["n"]) // 5)
            if x["key"] == y["key"] and x["unit"] != y["unit"] and y["new"] and (not x["new"] or x["seq"] < y["seq"]) and min(x["n"], y["n"]) >= need and lost(x, y) <= x["n"] - need and lost(y, x) <= y["n"] - need:
                want.append((x["seq"], y["seq"]))
    assert got == sorted(want) and want


def test_words_of_ascii_texts():
    """The short way for ASCII texts gives the words of the general one."""
    every = "".join(map(chr, range(128)))
    for text in (every, " ".join(every), every[::-1], "", "A_b-C1.2", "a\x1fb\x0bc"):
        assert op.words_of(text) == op._WORD.findall(text.lower())
    assert op.words_of("Stra\u00dfe_\u0130x \u00c9t\u00e9") == op._WORD.findall("Stra\u00dfe_\u0130x \u00c9t\u00e9".lower())


def test_smallest_shingles():
    """The smallest are those of a whole sort, also of texts of few different shingles."""
    rng = random.Random(5)
    texts = [[rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) + str(rng.randrange(m)) for _ in range(n)] for k, m, n in ((1, 1, 300), (2, 1, 400), (26, 99, 500), (26, 99, 25), (3, 2, 90), (26, 99, 3), (26, 999, 2000)) for _ in range(9)]
    h = np.array([hash(w) % (1 << 64) for t in texts for w in t], np.uint64)
    lengths = np.array([len(t) for t in texts])
    some = op.Sketch._lists(h, lengths, op.SPAN, lengths > op.SHORT, op.KEYS).to_pylist()
    every = op.Sketch._lists(h, lengths, op.SPAN, lengths > op.SHORT, None).to_pylist()
    order = lambda l: sorted(x % (1 << 64) for x in l)  # noqa: E731, E741
    assert [x and [v % (1 << 64) for v in x] for x in some] == [x and order(x)[: op.KEYS] for x in every]
