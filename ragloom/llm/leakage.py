"""Held-out test passages inside training texts, by template canonicalisation.

Words are runs of letters and digits, without case; format characters inside them are dropped.
Numbers, names and units become typed placeholders, and every window of SPAN canonical words is
hashed. Windows of documents are joined with the windows of the test items on that hash; then the
slots are checked: equal slots make an exact leak (at least SPAN consecutive words of the item),
slots that map one-to-one onto other values make a re-parameterised one, anything else is none.

The names and units are read from the items: names are words that occur there only with a capital,
also inside sentences; units are words that follow a number in several items. Documents are not
asked for capitals, as case doesn't count.

The items' window hashes are sent to the workers, which drop all other windows before the join, if
there are at most BROADCAST_WINDOWS; beyond it every window is shuffled to the same join. The items
are counted before anything of them is sent; at most BROADCAST_ITEMS windows are broadcast whole. A window
joins at most as many rows as there are items with it; documents are never joined with each other.

Defined cases: null and empty texts hold no window; items shorter than SPAN words leak nothing;
repeated rows give one case; ids that are null are dropped; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ragloom.runtime import cut

SPAN = 12
#: Item windows whose hashes are broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Item windows that are broadcast with their words (about 400 bytes each); more are joined by a shuffle, in SALT copies.
BROADCAST_ITEMS, SALT = 30_000, 16
#: A word is a unit if it follows a number in so many items.
UNIT_ITEMS = 3
#: Words a worker remembers the hashes of; on reaching it the memory starts anew.
MEMO = 500_000
_WORD = re.compile(r"[^\W_]+")
_FORMAT = re.compile("[­؜᠎​-‏‪-‮⁠-⁤﻿]")


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = _FORMAT.sub("", text)
    return _WORD.findall(text.lower())


def uses(text: str) -> dict[str, tuple[bool, bool, bool]]:
    """word -> whether a text has it in small letters, as a name, as a unit."""
    out: dict[str, tuple[bool, bool, bool]] = {}
    found = [(m.group(), m.start()) for m in _WORD.finditer(text)]
    for k, (w, at) in enumerate(found):
        plain = not w[0].isupper()
        name = not plain and k > 0 and not re.search(r"[.!?:]\s*$", text[max(0, at - 4) : at])
        unit = k > 0 and found[k - 1][0][0].isdigit() and w.isalpha() and plain
        a, b, c = out.get(w.lower(), (False, False, False))
        out[w.lower()] = (a or plain, b or name, c or unit)
    return out


def lexicon(items: DataFrame) -> dict[str, str]:
    """word -> placeholder, counted over the items (item_id, text); only names and units come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(w, *map(int, u)) for t in batch.column(0).to_pylist() for w, u in uses(t).items()]
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["word", "plain", "name", "unit"])

    words = items.where("text IS NOT NULL").select("text").mapInArrow(run, "word string, plain int, name int, unit int")
    rated = words.groupBy("word").agg(F.max("plain").alias("plain"), F.max("name").alias("name"), F.sum("unit").alias("unit"))
    named = F.when((F.col("name") > 0) & (F.col("plain") == 0), "<name>").when(F.col("unit") >= UNIT_ITEMS, "<unit>")
    return dict(map(tuple, rated.select("word", named.alias("as")).where("`as` IS NOT NULL").collect()))


def slot(word: str, lex: dict[str, str]) -> str | None:
    """The placeholder of a word, None if it stays itself."""
    return "<number>" if word[0].isdigit() else lex.get(word)


class Windows:
    """Canonical hashes of all windows of a list of texts."""

    def __init__(self, lex: dict[str, str], span: int = SPAN):
        self.lex, self.span, self.memo = lex, span, {}

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, text number, place in the text) of every window."""
        counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        flat = [w for t in texts for w in t]
        n = len(flat) - self.span + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in set(flat).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(slot(w, self.lex) or w)
        h = np.fromiter(map(memo.__getitem__, flat), dtype=np.uint64, count=len(flat))
        total, power = np.zeros(n, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(self.span):
                total += h[j : j + n] * power
                power *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
        ends = np.cumsum(counts)
        text = np.repeat(np.arange(len(texts)), counts)[:n]
        at = np.arange(n)
        good = at + self.span <= ends[text]
        return total[good].view(np.int64), text[good], (at - (ends - counts)[text])[good]


_ITEM = "item_id long, h long, item_at int, item_words array<string>, slots array<string>"


def item_windows(items: DataFrame, lex: dict[str, str]) -> DataFrame:
    """All windows of the test items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(lex)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            h, n, at = windows(words)
            cut_ = [words[i][a : a + SPAN] for i, a in zip(n.tolist(), at.tolist())]
            slots = [[slot(w, lex) or "" for w in ws] for ws in cut_]
            lists = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids[n], pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(cut_, lists), pa.array(slots, lists)], names=["item_id", "h", "item_at", "item_words", "slots"])

    return items.mapInArrow(run, _ITEM)


_DOC = "doc_id long, h long, doc_at int, doc_words array<string>"


def document_windows(docs: DataFrame, lex: dict[str, str], only: np.ndarray | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, doc_at, doc_words) of the windows whose hash is among only, or of all windows."""
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast((lex, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, only = known.value
        windows = Windows(lex)
        if only is not None:
            first = np.zeros(1 << 20, dtype=bool)
            first[only & 0xFFFFF] = True
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            h, n, at = windows(words)
            if only is not None:
                maybe = np.flatnonzero(first[h & 0xFFFFF])
                maybe = maybe[np.isin(h[maybe], only)]
                h, n, at = h[maybe], n[maybe], at[maybe]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[n], pa.int64()),
                    pa.array(h, pa.int64()),
                    pa.array(at, pa.int32()),
                    pa.array([words[i][a : a + SPAN] for i, a in zip(n.tolist(), at.tolist())], pa.list_(pa.string())),
                ],
                names=["doc_id", "h", "doc_at", "doc_words"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).where(F.col(key).isNotNull() & F.col(text).isNotNull()).mapInArrow(run, _DOC)


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, doc_id, kind, windows): kind is exact or reparameterised; one row for a pair."""
    known = cut(items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct())
    lex = lexicon(known)
    seen = Observation()
    rows = cut(item_windows(known, lex).observe(seen, F.count("*").alias("n")))
    n = seen.get["n"]
    only = np.array([r[0] for r in rows.select("h").distinct().collect()], dtype=np.int64) if n <= BROADCAST_WINDOWS else None
    own = document_windows(docs, lex, only, doc_key, text)
    if n <= BROADCAST_ITEMS:
        found = own.join(F.broadcast(rows), "h")
    else:  # a window of a common instruction may be hot on both sides
        salted = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        found = own.withColumn("salt", F.pmod(F.xxhash64("doc_id", "doc_at"), F.lit(SALT)).cast("int")).join(salted, ["h", "salt"])
    same = F.expr("item_words = doc_words")
    pairs = F.expr("filter(zip_with(arrays_zip(slots, item_words), doc_words, (i, d) -> struct(i.slots AS s, i.item_words AS i, d AS d)), x -> x.s <> '')")
    found = (
        found.withColumn("exact", same)
        .withColumn("p", F.when(~same, pairs))
        .withColumn("renamed", F.expr("NOT exact AND size(array_distinct(p)) = size(array_distinct(transform(p, x -> struct(x.s, x.i)))) AND size(array_distinct(p)) = size(array_distinct(transform(p, x -> struct(x.s, x.d))))"))
        .where("exact OR renamed")
    )
    return (
        found.groupBy("item_id", "doc_id")
        .agg(F.when(F.max("exact"), "exact").otherwise("reparameterised").alias("kind"), F.countDistinct("item_at").alias("windows"))
    )
