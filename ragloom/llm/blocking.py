"""Blocking keys and candidate pairs as packed arrays, for the incremental record linkage.

A row of BLOCK holds many entries of one bucket: arrays in binary columns, whole numbers as narrow as they allow. Spark moves and stores such
rows; the functions here work on the arrays of one chunk of texts, or on one bucket of the batch and of the store. No
function knows more than that, and none reads settings of its module: what decides is in a Rules that is sent along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = "what int, level int, bucket int, key binary, seq binary, n binary, more binary"
#: Entries that are not decided; entries of a hot key whose combinations have been made already; keys that the store is
#: met under; hot keys; texts of saturated keys; pairs (a in key, b in seq); facts of texts.
OPEN, SPLIT, KEYS, HOT, CROWD, PAIRS, CARDS = range(7)
CARD = np.dtype([("seq", "<i8"), ("n", "<i4"), ("path", "<i8"), ("coll", "<i8"), ("sets", "<u8", 4)])
#: Stands for null in the path and coll of a card; hashes of 32 bits don't reach it.
NULL = 1 << 40
#: Pairs that are looked at at once.
SLICE = 1_000_000
FOUND = "a long, b long, shared int, n_a int, n_b int, path_a int, path_b int, coll_a int, coll_b int"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as differences from the smallest, in 1, 2, 4 or 8 bytes."""
    if not len(x):
        return b""
    base = int(x.min())
    span = int(x.max()) - base
    width = 1 if span < 1 << 8 else 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    rest = x.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64))
    return bytes([width]) + np.int64(base).tobytes() + rest.astype(f"<u{width}").tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.int64)
    return (np.frombuffer(blob, f"<u{blob[0]}", offset=9).astype(np.uint64) + np.frombuffer(blob, "<u8", 1, 1)).view(np.int64)


class Rules(NamedTuple):
    hot: int
    levels: int
    gap: int
    page: int
    same: float
    #: The value of the bucket column for each bucket, which the tables' hash sends to as many files.
    labels: tuple[int, ...]


class Entries(NamedTuple):
    """key, seq, n of a text, size of its list (at most 255), and the 32 upper bits of the shingles that follow."""

    key: np.ndarray
    seq: np.ndarray
    n: np.ndarray
    size: np.ndarray
    after: np.ndarray

    def at(self, rows: np.ndarray) -> Entries:
        return Entries(*(x[rows] for x in self))

    def blobs(self) -> tuple[bytes, ...]:
        return self.key.tobytes(), packed(self.seq), packed(self.n), self.size.tobytes() + self.after.tobytes()


def _joined(parts: list[Entries], width: int) -> Entries:
    empty = Entries(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint8), np.empty((0, width), np.uint32))
    return Entries(*map(np.concatenate, zip(empty, *parts)))


def _width(rules: Rules, level: int) -> int:
    """How many of the shingles that follow an entry of a level its combinations can take."""
    return rules.gap * (rules.levels - level)


def _entries(rows: pa.Table, what: int, width: int) -> Entries:
    parts = []
    for key, seq, n, more in zip(*(rows.column(c).to_pylist() for c in ("key", "seq", "n", "more")), strict=True) if (rows := rows.filter(pc.equal(rows["what"], what))).num_rows else ():
        k = np.frombuffer(key, "<u8")
        after = np.frombuffer(more, "<u4", offset=len(k)).reshape(len(k), width) if what == OPEN else np.empty((len(k), width), np.uint32)
        size = np.frombuffer(more, np.uint8, len(k)) if what == OPEN else np.zeros(len(k), np.uint8)
        parts.append(Entries(k, unpacked(seq), unpacked(n).astype(np.int32), size, after))
    return _joined(parts, width)


class Rows:
    """Rows of BLOCK to be."""

    def __init__(self, rules: Rules):
        self.rules, self.rows = rules, []

    def add(self, what: int, level: int, bucket: int, *blobs: bytes) -> None:
        self.rows.append((what, level, self.rules.labels[bucket], *blobs, *[b""] * (4 - len(blobs))))

    def spread(self, what: int, level: int, by: np.ndarray, blobs: Callable[[np.ndarray], tuple[bytes, ...]]) -> None:
        """A row for each bucket of by; blobs gives those of some of the entries."""
        bucket = (by % np.uint64(len(self.rules.labels))).astype(np.uint16 if len(self.rules.labels) < 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.flatnonzero(np.diff(bucket[order], append=-1 if bucket.dtype == np.int64 else np.uint16(len(self.rules.labels)))) + 1
        for lo, hi in zip([0, *ends[:-1]], ends):
            self.add(what, level, int(bucket[order[lo]]), *blobs(order[lo:hi]))

    def columns(self) -> list[pa.Array]:
        kinds = [pa.int32()] * 3 + [pa.binary()] * 4
        return [pa.array([r[k] for r in self.rows], kind) for k, kind in enumerate(kinds)]

    def table(self) -> pa.Table:
        return pa.Table.from_arrays(self.columns(), names=[c.split()[0] for c in BLOCK.split(", ")])


def mixed(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The keys of the combinations of keys with further shingles."""
    h = (key ^ (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def combined(e: Entries, rules: Rules, level: int) -> Entries:
    """The entries of the next level: each with the next gap shingles of its own list."""
    parts, width = [], _width(rules, level + 1)
    for g in range(1, rules.gap + 1):
        x = e.at(np.flatnonzero(e.size > g))
        parts.append(x._replace(key=mixed(x.key, x.after[:, g - 1]), after=x.after[:, g : g + width]))
    return _joined(parts, width)


def listed(rows: pa.RecordBatch, rules: Rules) -> Entries:
    """The entries of the first level of texts with columns seq, n, v, w."""
    width, parts = _width(rules, 1), []
    seq, n = (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("seq", "n"))
    for name in ("v", "w"):
        lists = rows.column(rows.schema.get_field_index(name))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        value = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        start, size = (np.cumsum(lengths) - lengths)[doc], lengths[doc]
        pos = np.arange(len(value)) - start
        upper = (value >> np.uint64(32)).astype(np.uint32)
        after = [upper[start + (pos + g) % np.maximum(size, 1)] for g in range(1, width + 1)]
        parts.append(Entries(value, seq[doc], n[doc].astype(np.int32), np.minimum(size, 255).astype(np.uint8), np.stack(after, axis=1) if after else np.empty((len(value), 0), np.uint32)))
    return _joined(parts, width)


def sent(rules: Rules, probe: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to entries of all levels and cards, by bucket.

    A key that more than hot texts of one chunk hold is hot for sure and is split here, so that a shared opening does not
    bring all texts into one bucket. Its texts are sent without what follows them, if there is a store to probe; if not,
    one of them tells that it is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out, e = Rows(rules), listed(rows, rules)
            for level in range(1, rules.levels + 1):
                sure = np.zeros(len(e.key), bool)
                if level < rules.levels and len(e.key):
                    _, place, count = np.unique(e.key, return_inverse=True, return_counts=True)
                    sure = (count > rules.hot)[place] & (e.size > 1)
                rest, split = e.at(~sure), e.at(sure)
                out.spread(OPEN, level, rest.key, lambda at: rest.at(at).blobs())  # noqa: B023
                tell = split if probe else split.at(np.unique(split.key, return_index=True)[1])
                out.spread(SPLIT, level, tell.key, lambda at: tell.at(at).blobs()[:3])  # noqa: B023
                if not len(split.key):
                    break
                e = combined(split, rules, level)
            column = lambda c: rows.column(rows.schema.get_field_index(c))  # noqa: B023, E731
            cards = np.empty(rows.num_rows, CARD)
            for c in ("seq", "n", "path", "coll"):
                cards[c] = pc.fill_null(column(c).cast(pa.int64()), NULL).to_numpy(zero_copy_only=False)
            for k in range(4):
                cards["sets"][:, k] = column(f"s{k}").to_numpy(zero_copy_only=False).view(np.uint64)
            out.spread(CARDS, 0, cards["seq"].astype(np.uint64), lambda at: (b"", b"", b"", cards[at].tobytes()))  # noqa: B023
            yield pa.RecordBatch.from_arrays(out.columns(), names=[c.split()[0] for c in BLOCK.split(", ")])

    return run


def _within(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether the values of x are among those of an ordered array."""
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _near(n: np.ndarray, m: np.ndarray, same: float) -> np.ndarray:
    return np.minimum(n, m) >= same * np.maximum(n, m) - 1e-9


def _ordered(e: Entries) -> Entries:
    return e.at(np.lexsort((e.seq, e.key)))


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number) of each value of an ordered array."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return first, np.diff(np.append(first, len(key)))


def decided(rules: Rules, level: int, probe: bool, recount: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One bucket's entries of a level, with what is stored in it: keys, hot keys, crowds and pairs, and entries of the next level."""

    def run(own: pa.Table, stored: pa.Table) -> pa.Table:
        out, width = Rows(rules), _width(rules, level)
        others, own = own.filter(pc.not_equal(own["level"], level)), own.filter(pc.equal(own["level"], level))
        if not own.num_rows and not (recount and stored.num_rows):
            return others
        home = rules.labels.index((own if own.num_rows else stored)["bucket"][0].as_py())
        e, split = _ordered(_entries(own, OPEN, width)), _entries(own, SPLIT, width)
        told = stored.filter(pc.equal(stored["what"], HOT))["key"].to_pylist()
        known = np.sort(np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, "<u8") for x in told)]))
        told = np.unique(split.key)
        first, count = _groups(e.key)
        keys = e.key[first]
        old = _within(keys, known)
        hot = old | (count > rules.hot) | _within(keys, told)
        new = np.union1d(keys[hot & ~old], told[~_within(told, known)])
        is_hot = np.repeat(hot, count)
        cleft = is_hot & (e.size > 1) & (level < rules.levels)
        a, b = [], []

        def met(x: Entries, i: np.ndarray, y: Entries, j: np.ndarray, later: bool) -> None:
            good = _near(x.n[i], y.n[j], rules.same)
            if later:
                good &= x.seq[i] < y.seq[j]
            a.append(x.seq[i[good]])
            b.append(y.seq[j[good]])

        member = e.at(~is_hot)
        at, step = np.arange(len(member.key)), 1
        while len(at := at[at + step < len(member.key)]):
            at = at[member.key[at] == member.key[at + step]]
            met(member, at, member, at + step, True)
            step += 1
        many = e.at(is_hot & ~cleft)
        first, count = _groups(many.key)
        anchors = [member]
        if len(first):
            start, number = np.repeat(first, count), np.repeat(count, count)
            for page in range(rules.page):
                j = np.flatnonzero(number > page)
                met(many, start[j] + page, many, j, True)
            place = np.arange(len(start)) - start
            anchors.append(many.at((place < rules.page) & ~_within(many.key, known)))
            out.add(CROWD, level, home, many.key.tobytes(), packed(many.seq))
        blocks = [x for x in zip(*(stored.column(c).to_pylist() for c in ("what", "key", "seq", "n"))) if x[0] == KEYS]
        if probe and blocks:
            probing = _ordered(_joined([e, split], width))
            first, count = _groups(probing.key)
            for _, key, seq, n in blocks:
                key, seq, n = np.frombuffer(key, "<u8"), unpacked(seq), unpacked(n).astype(np.int32)
                lo, hi = (np.searchsorted(key, probing.key[first], side) for side in ("left", "right"))
                lo, number = np.repeat(lo, count), np.repeat(hi - lo, count)
                j = np.flatnonzero(number)
                lo, number = lo[j], number[j]
                cuts = np.searchsorted(np.cumsum(number), np.arange(SLICE, number.sum() + SLICE, SLICE), "right") if len(j) else []
                x = Entries(key, seq, n, None, None)
                for s, t in zip([0, *cuts], [*cuts, len(j)]):
                    if s < t:
                        m = number[s:t]
                        i = np.repeat(lo[s:t] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        met(x, i, probing, np.repeat(j[s:t], m), False)
        kept = _ordered(_joined(anchors, width))
        if len(kept.key):
            out.add(KEYS, level, home, *kept.blobs()[:3])
        if recount:
            every = np.sort(np.concatenate([member.key, *(np.frombuffer(x[1], "<u8") for x in blocks)]))
            first, count = _groups(every)
            often = every[first[count > rules.hot]]
            new = np.union1d(new, often[~_within(often, known)])
        if len(new):
            out.add(HOT, level, home, new.tobytes())
        if level < rules.levels:
            more = combined(e.at(cleft), rules, level)
            out.spread(OPEN, level + 1, more.key, lambda at: more.at(at).blobs())
        if a and len(a := np.concatenate(a)):
            b = np.concatenate(b)
            out.spread(PAIRS, 0, b.astype(np.uint64), lambda at: (packed(a[at]), packed(b[at])))
        return pa.concat_tables([others.cast(out.table().schema), out.table()])

    return run


def _cards(rows: pa.Table) -> np.ndarray:
    cards = np.concatenate([np.empty(0, CARD), *(np.frombuffer(x, CARD) for x in rows["more"].to_pylist())])
    return cards[np.argsort(cards["seq"], kind="stable")]


def introduced(rules: Rules) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One bucket of pairs by b, each once with the number of keys it shares; with b's cards to the bucket of a."""

    def run(pairs: pa.Table, cards: pa.Table) -> pa.Table:
        out = Rows(rules)
        if not pairs.num_rows:
            return out.table()
        cards = _cards(cards)
        a, b = (np.concatenate([unpacked(x) for x in pairs[c].to_pylist()]) for c in ("key", "seq"))
        order = np.lexsort((a, b))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        a, b, shared = a[first], b[first], np.diff(np.append(first, len(a))).astype(np.int32)
        place = np.searchsorted(cards["seq"], b)

        def blobs(at: np.ndarray) -> tuple[bytes, ...]:
            own, of = np.unique(place[at], return_inverse=True)
            return packed(a[at]), packed(of), packed(shared[at]), cards[own].tobytes()

        out.spread(PAIRS, 1, a.astype(np.uint64), blobs)
        return out.table()

    return run


def possible(x: np.ndarray, y: np.ndarray, same: float) -> np.ndarray:
    """Whether the texts of two cards can be the same unit, by word sets alone."""
    need = np.ceil(np.maximum(x["n"], y["n"]) * same - 1e-9)
    lost = lambda p, q: np.bitwise_count(p["sets"] & ~q["sets"]).sum(axis=1, dtype=np.int64)
    return (lost(x, y) <= x["n"] - need) & (lost(y, x) <= y["n"] - need)


def excluded(rules: Rules) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """One bucket of pairs by a, without those that word sets exclude, as rows of FOUND."""

    def run(pairs: pa.Table, cards: pa.Table) -> pa.Table:
        every, parts = _cards(cards) if pairs.num_rows else None, [(np.empty(0, CARD), np.empty(0, CARD), np.empty(0, np.int32))]
        for a, of, shared, known in zip(*(pairs[c].to_pylist() for c in ("key", "seq", "n", "more"))):
            known = np.frombuffer(known, CARD)
            place, of, shared = np.searchsorted(every["seq"], unpacked(a)), unpacked(of), unpacked(shared).astype(np.int32)
            for s in range(0, len(of), SLICE):
                x, y = every[place[s : s + SLICE]], known[of[s : s + SLICE]]
                good = possible(x, y, rules.same)
                parts.append((x[good], y[good], shared[s : s + SLICE][good]))
        x, y, shared = map(np.concatenate, zip(*parts))
        value = lambda c: pa.array(np.where(c == NULL, 0, c).astype(np.int32), mask=c == NULL)
        columns = [pa.array(x["seq"]), pa.array(y["seq"]), pa.array(shared), pa.array(x["n"]), pa.array(y["n"]), value(x["path"]), value(y["path"]), value(x["coll"]), value(y["coll"])]
        return pa.Table.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


CROSSED = "key long, seq long, unit long, new boolean, n int, s0 long, s1 long, s2 long, s3 long"


def crossed(rules: Rules) -> Callable[[pa.Table], pa.Table]:
    """Rows of CROSSED of whole crowds to the pairs (a, b) of texts of different units that lengths and word sets allow; b is new."""

    def run(rows: pa.Table) -> pa.Table:
        texts = np.empty(rows.num_rows, CARD)
        column = lambda c: rows[c].to_numpy()
        for c in ("seq", "n"):
            texts[c] = column(c)
        for k in range(4):
            texts["sets"][:, k] = column(f"s{k}").view(np.uint64)
        order = np.lexsort((texts["n"], column("key")))
        texts, key, unit, new = texts[order], column("key")[order], column("unit")[order], column("new").astype(bool)[order]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for start, count in zip(*_groups(key)):
            n, own = texts["n"][start : start + count], start + np.flatnonzero(new[start : start + count])
            # lengths are in order: those that can be near are a range, taken too wide by one
            lo = start + np.searchsorted(n, np.floor(texts["n"][own] * rules.same) - 1)
            hi = start + np.searchsorted(n, np.ceil(texts["n"][own] / rules.same) + 1, "right")
            sums = np.cumsum(hi - lo)
            cuts = [0, *np.searchsorted(sums, np.arange(SLICE, sums[-1] if len(sums) else 0, SLICE)), len(own)]
            for s, t in zip(cuts, cuts[1:]):
                if s == t:
                    continue
                m = (hi - lo)[s:t]
                j = np.repeat(own[s:t], m)
                i = np.repeat(lo[s:t] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                good = (unit[i] != unit[j]) & (~new[i] | (texts["seq"][i] < texts["seq"][j]))
                i, j = i[good], j[good]
                good = _near(texts["n"][i], texts["n"][j], rules.same)
                i, j = i[good], j[good]
                good = possible(texts[i], texts[j], rules.same)
                a.append(texts["seq"][i[good]])
                b.append(texts["seq"][j[good]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seq) of rows of BLOCK."""
    for rows in batches:
        for key, seq in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("key", "seq"))):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(key, "<i8")), pa.array(unpacked(seq))], names=["key", "seq"])
