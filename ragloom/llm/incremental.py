"""Near-duplicates of new batches against all that was accepted, by incremental record linkage.

Two texts are the same unit if they share SAME (4/5) of the words of the longer one in order; case,
blanks and punctuation don't count. A Store is a folder of tables: exact hashes, blocking keys
(packed arrays by bucket, see blocking.py), facts and units of the accepted texts (bucketed by number), their facts once
more as packed cards, crowds, their texts, links, and a log of merged units; a manifest names the last batch that was accepted as a whole, so that a store
can be closed, opened again by its path, and a batch that broke off be added again. add() reads its
own batch; it probes the key tables (the stored side is not shuffled), scores candidate pairs by
fields with learned weights, verifies them by their longest common subsequence, joins the links by
union-find into the smallest number of the units touched, and appends what is new. History is never
sketched or compared again.

Blocking keys: the KEYS smallest hashes of a text's SPAN-word shingles; texts of up to SHORT words
have all their two-word shingles instead, those of up to SHORT / SAME words have both, so that texts
of 4/5 the length always meet in one family.

Hot keys: a key that more than HOT texts hold (a shared opening, boilerplate) is split: its texts
get the hashes of it and each of the next GAP shingles of their own list instead, and again up to
LEVELS shingles. Hot keys are found in each batch, by exact counts; every RECOUNT batches those stored are counted
too. They stay hot. What was stored under a key before it became hot (at most HOT texts a batch
since the last count) stays there, and new texts go on probing it. A key that is still hot and can't be split (many
texts with LEVELS neighbouring smallest shingles in common, or of one shingle) has a crowd: its texts first meet the
first PAGE of them, which unites copies at little cost, and then all others of the crowd, stored or new, that are not
of their unit by then. Only equal units and exact bounds exclude pairs of a crowd. So the work for a crowd without
copies grows with the square of its texts.

Candidates: pairs that share a key; lengths alone, and then word sets of BITS bits, exclude those
that cannot reach 4/5 (an exact bound). All others are verified.

Weights: log-odds of the agreement levels of four fields, from counts over all verified pairs of all
batches (96 numbers in the manifest). They label pairs with a score and drop none.

Recall: with j, the share of common shingles, a pair shares no key with chance (1 - j) ** KEYS at
the first level. Measured by tests against brute force at similarities of 0.80 to 0.85.

Defined cases: rows with a null seq, batch or text are not units and get no link; texts without
words (empty, punctuation) are one unit only with texts that are equal without blanks and case;
repeated rows are repeats; an empty batch is accepted and has no links; other columns are not read.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm import blocking
from ragloom.llm.components import components
from ragloom.runtime import cut, new_dir, shuffle_width

SAME = 0.8
SPAN, KEYS, SHORT = 3, 16, 24
HOT, LEVELS, GAP, PAGE = 16, 3, 2, 8
#: Without effect since all of a crowd meet; the name is kept for callers that set it.
FREE = 8
#: Batches after which the stored keys are counted anew.
RECOUNT = 4
#: Rows of hot keys or of wanted numbers that are broadcast; larger ones are joined by a shuffle.
BROADCAST = 200_000
#: Links of a batch that are united on the driver; more are united by joins.
LOCAL = 50_000
#: Texts of a bucket of the store, if the session's number of shuffle partitions allows as many buckets.
BUCKET_ROWS = 50_000
#: Bits of the word sets that exclude pairs without their texts.
BITS = 256
SETS = ["s0", "s1", "s2", "s3"]
MEMO = 500_000
#: Of the tables; stores of others are refused.
FORMAT = 3
#: Logs of merged units that are kept before they become one.
LOGS = 8
_WORD = re.compile(r"[^\W_]+")
#: ASCII characters in lower case, and blanks for those that are not of words.
_ASCII = "".join(chr(c).lower() if chr(c).isalnum() else " " for c in range(128))


def words_of(text: str) -> list[str]:
    return text.translate(_ASCII).split() if text.isascii() else _WORD.findall(text.lower())


def shared_in_order(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for w in b:
        m = at.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Sketch:
    """Exact hashes, shingle lists and word sets of lists of words."""

    @staticmethod
    def _distinct(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different values of each text, in order."""
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        keep = np.ones(len(doc), dtype=bool)
        keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
        return doc[keep], value[keep]

    def __init__(self):
        self.memo: dict[str, int] = {}

    @staticmethod
    def _lists(h: np.ndarray, lengths: np.ndarray, span: int, wanted: np.ndarray, most: int | None) -> pa.ListArray:
        """The smallest distinct hashes of the runs of span words of the wanted texts, in order; null for the others."""
        n = max(0, len(h) - span + 1)
        total, power = np.zeros(n, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(span):
                total += h[j : j + n] * power
                power *= np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
            total *= np.uint64(0xBF58476D1CE4E5B9)
            total ^= total >> np.uint64(32)
        doc = np.repeat(np.arange(len(lengths)), lengths)[:n]
        good = (np.arange(n) + span <= np.cumsum(lengths)[doc]) & wanted[doc]
        doc, value = doc[good], total[good]
        if most is None:
            doc, value = Sketch._distinct(doc, value)
        else:
            number = np.bincount(doc, minlength=len(lengths))
            bound = (np.minimum(3 * most / np.maximum(number, 1), 0.99) * 2.0**64).astype(np.uint64)
            low = value < bound[doc]
            some, small = Sketch._distinct(doc[low], value[low])
            few = np.bincount(some, minlength=len(lengths)) < most  # only they need all of their shingles
            rest = few[doc]
            more, large = Sketch._distinct(doc[rest], value[rest])
            keep = ~few[some]
            doc, value = np.concatenate([some[keep], more]), np.concatenate([small[keep], large])
            order = np.argsort(doc, kind="stable")
            doc, value = doc[order], value[order]
            start = np.flatnonzero(np.diff(doc, prepend=-1))
            rank = np.arange(len(doc)) - np.repeat(start, np.diff(np.append(start, len(doc))))
            doc, value = doc[rank < most], value[rank < most]
        offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
        np.cumsum(np.bincount(doc, minlength=len(lengths)), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)), mask=pa.array(~wanted))

    def __call__(self, texts: list[list[str]], raw: list[str]) -> dict[str, pa.Array]:
        memo = self.memo
        flat = [w for t in texts for w in t]
        if len(memo) > MEMO:
            memo.clear()
        for w in set(flat).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w)
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        norm = [" ".join(t) if t else "\x00" + "".join(r.split()).lower() for t, r in zip(texts, raw)]
        h = np.fromiter(map(memo.__getitem__, flat), dtype=np.uint64, count=len(flat))
        bits = np.zeros((len(texts), BITS), dtype=bool)
        bits[np.repeat(np.arange(len(texts)), lengths), (h % np.uint64(BITS)).astype(np.int64)] = True
        sets = np.packbits(bits, axis=1).view(np.int64)
        hash_of = lambda seed: pa.array(np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in norm), dtype=np.uint64, count=len(norm)).view(np.int64))
        return {
            "h1": hash_of(0),
            "h2": hash_of(7),
            "n": pa.array(lengths.astype(np.int32)),
            "v": self._lists(h, lengths, SPAN, lengths > SHORT, KEYS),
            "w": self._lists(h, lengths, 2, (lengths > 1) & (lengths <= SHORT / SAME), None),
            **{name: pa.array(np.ascontiguousarray(sets[:, k])) for k, name in enumerate(SETS)},
            "norm": pa.array(norm, pa.string()),
        }


_SKETCH = "seq long, path int, coll int, h1 long, h2 long, n int, v array<long>, w array<long>, s0 long, s1 long, s2 long, s3 long, norm string"


def sketches(batch: DataFrame) -> DataFrame:
    """One row for each stored row that has a seq and a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for rows in batches:
            raw = rows.column(3).to_pylist()
            made = sketch([words_of(t) for t in raw], raw)
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], *made.values()], names=["seq", "path", "coll", *made])

    hashed = lambda c: F.when(c.isNotNull(), F.hash(c))
    rows = batch.where("seq IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("seq").cast("long"), hashed(F.col("file_path")).alias("p"), hashed(F.lower(F.trim("collection"))).alias("c"), "text").mapInArrow(run, _SKETCH)


def similarity(a: str, b: str) -> Column:
    """Words shared in order, as a share of the longer text."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            p, q = x.split(" "), y.split(" ")
            out.append(shared_in_order(p, q) / max(len(p), len(q)))
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")(a, b)


def possible() -> Column:
    """Whether two texts can be the same unit, by word sets alone.

    Words of one text whose bit the other lacks are not shared, so their number bounds what is lost.
    """
    need = F.ceil(F.greatest("n_a", "n_b") * F.lit(SAME) - 1e-9)
    lost = lambda x, y: sum((F.bit_count(F.col(f"{k}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{k}_{y}")))) for k in SETS), F.lit(0))
    return (lost("a", "b") <= F.col("n_a") - need) & (lost("b", "a") <= F.col("n_b") - need)


FIELDS = {"f_shared": 4, "f_ratio": 3, "f_path": 2, "f_coll": 2}


def weights_of(counts: dict[str, list[int]]) -> dict[str, list[float]] | None:
    """Log-odds of each field's levels; counts has, for "field,level", the pairs that are repeats and that are not."""
    same = sum(counts.get(f"f_path,{k}", (0, 0))[0] for k in range(2))
    other = sum(counts.get(f"f_path,{k}", (0, 0))[1] for k in range(2))
    if not same or not other:
        return None
    out = {}
    for field, levels in FIELDS.items():
        at = [counts.get(f"{field},{k}", (0, 0)) for k in range(levels)]
        out[field] = [float(np.log((m + 0.5) / (same + 0.5 * levels) / ((u + 0.5) / (other + 0.5 * levels)))) for m, u in at]
    return out


def scored(pairs: DataFrame, weights: dict[str, list[float]] | None) -> DataFrame:
    """pairs with the fields' agreement levels and their score, a label."""
    levels = {
        "f_shared": F.when(F.col("shared") >= 8, 3).when(F.col("shared") >= 4, 2).when(F.col("shared") >= 2, 1).otherwise(0),
        "f_ratio": F.when(F.least("n_a", "n_b") >= 0.98 * F.greatest("n_a", "n_b"), 2).when(F.least("n_a", "n_b") >= 0.9 * F.greatest("n_a", "n_b"), 1).otherwise(0),
        "f_path": F.coalesce((F.col("path_a") == F.col("path_b")).cast("int"), F.lit(0)),
        "f_coll": F.coalesce((F.col("coll_a") == F.col("coll_b")).cast("int"), F.lit(0)),
    }
    rows = pairs.withColumns(levels)
    if weights is None:
        return rows.withColumn("score", F.lit(0.0))
    parts = [F.element_at(F.array(*map(F.lit, weights[f])), F.col(f) + 1) for f in FIELDS]
    return rows.withColumn("score", sum(parts[1:], parts[0]))


def united(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, root) of the nodes of pairs; root is the smallest node of the component."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return [(x, top(x)) for x in list(up)]


class Store:
    """The accepted units below a path; add() links a batch and accepts it."""

    #: Tables bucketed by their join key, and their columns besides the batch.
    TABLES = {
        "exact": (("h1", "h2"), "h1 long, h2 long, root long"),
        "keys": (("bucket",), "bucket int, what int, key binary, seq binary, n binary"),
        "crowds": (("key",), "key long, seq long, n int, s0 long, s1 long, s2 long, s3 long"),
        "cards": (("bucket",), "bucket int, more binary"),
        "facts": (("seq",), "seq long, n int, path int, coll int, s0 long, s1 long, s2 long, s3 long"),
        "units": (("seq",), "seq long, root long"),
    }

    #: Further partition columns than the batch, and their values.
    PARTS = {"keys": {"level": tuple(range(1, LEVELS + 1))}}

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or new_dir(spark, "units")
        self.id = xxhash.xxh64_hexdigest(self.path)
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.state = self._read_manifest() or {"format": FORMAT, "batches": 0, "buckets": buckets or shuffle_width(spark), "merged": 0, "counts": {}}
        if self.state.get("format") != FORMAT:
            raise ValueError(f"the store at {self.path} was made in another format; link its batches into a new one")
        self.buckets = self.state["buckets"]
        self.labels = self._labels()
        for name, (keys, columns) in self.TABLES.items():
            by, parts = ", ".join(keys), ["batch", *self.PARTS.get(name, {})]
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(name)} ({columns}, {' int, '.join(parts)} int) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY ({', '.join(parts)}) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self._fs.mkdirs(self._fs_path(f"{self.path}/{name}"))  # a table may be without rows so far
            if self.state["batches"]:
                spark.catalog.recoverPartitions(self._name(name))

    # -- files

    def _name(self, table: str) -> str:
        return f"ragloom_{table}_{self.id}"

    def _read_manifest(self) -> dict | None:
        folder = self._fs_path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return None
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{names[-1]}").first()[0]) if names else None

    def _write_manifest(self) -> None:
        """A new numbered file, renamed when it is whole."""
        name = f"{self.path}/manifest/{self.state['batches']:08d}"
        out = self._fs.create(self._fs_path(name + ".tmp"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        self._fs.rename(self._fs_path(name + ".tmp"), self._fs_path(name + ".json"))

    def _labels(self) -> tuple[int, ...]:
        """For each bucket a number that the hash of the bucketed tables sends there."""
        found: dict[int, int] = {}
        wide = 16 * self.buckets
        while len(found) < self.buckets:
            wide *= 2
            label = F.col("id").cast("int")
            rows = self.spark.range(wide).select(F.pmod(F.hash(label), F.lit(self.buckets)).alias("b"), label.alias("x")).groupBy("b").agg(F.min("x")).collect()
            found = {r[0]: r[1] for r in rows}  # a row a bucket
        return tuple(found[b] for b in range(self.buckets))

    def _append(self, df: DataFrame, name: str, placed: bool = False) -> None:
        """Store rows; those that are placed lie in partitions by bucket."""
        keys, columns = self.TABLES[name]
        df = df.select(*(c.split()[0] for c in columns.split(", ")), F.lit(self.state["batches"]).alias("batch"), *self.PARTS.get(name, {}))
        (df if placed else df.repartition(self.buckets, *keys)).write.insertInto(self._name(name))

    def _stored(self, name: str) -> DataFrame | None:
        """A table without the batch at hand; None before the first batch."""
        n = self.state["batches"]
        return self.spark.table(self._name(name)).where(F.col("batch") < n).drop("batch") if n else None

    def _own(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name)).where(F.col("batch") == self.state["batches"]).drop("batch")

    def _files(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.path}/{name}")

    def _put(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/batch={self.state['batches']}")

    def _forget_unfinished(self) -> None:
        """Remove what a batch that broke off has left."""
        n = self.state["batches"]
        for name in [*self.TABLES, "rows", "merged", "links"]:
            self._fs.delete(self._fs_path(f"{self.path}/{name}/batch={n}"), True)
        for name in self.TABLES:
            specs = [""] + [f", {column} = {v}" for column, values in self.PARTS.get(name, {}).items() for v in values]
            for spec in specs[1:] or specs:
                self.spark.sql(f"ALTER TABLE {self._name(name)} DROP IF EXISTS PARTITION (batch = {n}{spec})")

    def close(self) -> None:
        """Forget the tables' names; their files stay and can be opened again."""
        for name in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(name)}")

    def links(self) -> DataFrame:
        """(seq_a, seq_b, batch) of all accepted batches."""
        if not self.state["batches"]:
            return self.spark.createDataFrame([], "seq_a long, seq_b long, batch int")
        return self._files("links", "seq_a long, seq_b long").where(F.col("batch") < self.state["batches"])

    # -- blocking keys

    @staticmethod
    def _small(df: DataFrame, rows: int) -> DataFrame:
        """df, to be broadcast if it has at most BROADCAST rows."""
        return F.broadcast(df) if rows <= BROADCAST else df

    def _rules(self) -> blocking.Rules:
        return blocking.Rules(HOT, LEVELS, GAP, PAGE, SAME, self.labels)

    def _blocked(self, fresh: DataFrame) -> tuple[DataFrame, bool]:
        """Store the keys and cards of the batch; (pairs that meet under a key, packed, whether some keys are saturated).

        A level of hot keys and their combinations a round; a round meets what the store has of its level.
        """
        n, what = self.state["batches"], F.col("what")
        rules = self._rules()
        rows, made, crowds = fresh.mapInArrow(blocking.sent(rules, n > 0), blocking.BLOCK), [], 0
        recount = n > 0 and n % RECOUNT == 0
        for level in range(1, LEVELS + 1):
            seen = Observation()
            stored = self.spark.table(self._name("keys")).where((F.col("batch") < n) & (F.col("level") == level)).drop("batch", "level")
            out = rows.groupBy("bucket").cogroup(stored.groupBy("bucket")).applyInArrow(blocking.decided(rules, level, n > 0, recount), blocking.BLOCK)
            made.append(cut(out.observe(seen, F.count_if(what == blocking.CROWD).alias("crowds"), F.count_if(what.isin(blocking.OPEN, blocking.SPLIT)).alias("open"))))
            crowds += seen.get["crowds"]
            rows = made[-1].where(what.isin(blocking.OPEN, blocking.SPLIT))
            if not seen.get["open"] and not recount:
                break
        self._append(made[0].where(what == blocking.CARDS), "cards", placed=True)
        every = made[0]
        for out in made[1:]:
            every = every.unionAll(out)
        self._append(every.where(what.isin(blocking.KEYS, blocking.HOT)), "keys", placed=True)
        if crowds:
            crowd = every.where(what == blocking.CROWD).mapInArrow(blocking.opened, "key long, seq long")
            self._append(crowd.join(fresh.select("seq", "n", *SETS), "seq"), "crowds")
        return every.where(what == blocking.PAIRS), crowds > 0

    # -- candidates

    def _met(self, pairs: DataFrame) -> DataFrame:
        """Pairs that word sets don't exclude, with fields, from packed ones."""
        n = self.state["batches"]
        rules = self._rules()
        cards = self.spark.table(self._name("cards")).where(F.col("batch") <= n)
        side = lambda df: df.select("bucket", "more").groupBy("bucket")
        pairs = pairs.select("bucket", "key", "seq").groupBy("bucket").cogroup(side(cards.where(F.col("batch") == n))).applyInArrow(blocking.introduced(rules), blocking.BLOCK)
        return pairs.groupBy("bucket").cogroup(side(cards)).applyInArrow(blocking.excluded(rules), blocking.FOUND)

    def _possible(self, met: DataFrame) -> DataFrame:
        """The same from rows (a, b)."""
        n = self.state["batches"]
        facts = self.spark.table(self._name("facts")).where(F.col("batch") <= n).drop("batch")
        side = lambda df, s: df.select(*(F.col(c).alias(f"{c}_{s}" if c != "seq" else s) for c in df.columns))
        pairs = met.repartition(self.buckets, "a").groupBy("a", "b").agg(F.count("*").cast("int").alias("shared"))
        pairs = pairs.hint("shuffle_hash").join(side(facts, "a"), "a")
        pairs = pairs.join(side(self._own("facts"), "b").hint("shuffle_hash"), "b").where(possible())
        return pairs.select(*(c.split()[0] for c in blocking.FOUND.split(", ")))

    def _verified(self, pairs: DataFrame) -> tuple[DataFrame, int]:
        """(pairs with score and sim, their number), from pairs with fields."""
        n = self.state["batches"]
        seen = Observation()
        pairs = cut(scored(pairs, weights_of(self.state["counts"])).observe(seen, F.count("*").alias("n")))
        found = seen.get["n"]
        if not found:
            return pairs.withColumn("sim", F.lit(0.0)), 0
        rows = self._files("rows", _SKETCH).select("seq", "norm", "batch")
        wanted = self._small(pairs.select(F.col("a").alias("seq")).union(pairs.select("b")).distinct(), 2 * found)
        texts = rows.join(wanted, "seq", "left_semi")
        both = pairs.join(texts.where(F.col("batch") == n).select(F.col("seq").alias("b"), F.col("norm").alias("norm_b")), "b")
        both = both.join(texts.select(F.col("seq").alias("a"), F.col("norm").alias("norm_a")), "a")
        return cut(both.withColumn("sim", similarity("norm_a", "norm_b")).drop("norm_a", "norm_b")), found

    def _learn(self, verified: DataFrame) -> None:
        """Add the batch's counts of agreement levels; a few rows reach the driver, whatever the number of pairs."""
        rows = verified.groupBy(*FIELDS, (F.col("sim") >= SAME).alias("y")).count().collect()
        counts = self.state["counts"]
        for r in rows:
            for field in FIELDS:
                at = counts.setdefault(f"{field},{r[field]}", [0, 0])
                at[0 if r["y"] else 1] += r["count"]

    def _crossed(self, roots: DataFrame) -> DataFrame:
        """(a, b) of the texts of a crowd whose units differ, but for those that lengths and word sets exclude."""
        n = self.state["batches"]
        crowd = self.spark.table(self._name("crowds")).where(F.col("batch") <= n).withColumn("new", F.col("batch") == n).drop("batch")
        if n:
            crowd = crowd.join(self._own("crowds").select("key").distinct(), "key", "left_semi")
        unit, units = F.col("seq"), self._stored("units")
        if units is not None:
            crowd = self._top(crowd.join(units, "seq", "left"), "root").withColumnRenamed("root", "known")
            unit = F.coalesce("known", "seq")
        crowd = crowd.withColumn("unit", unit).join(roots.withColumnRenamed("node", "unit"), "unit", "left").withColumn("unit", F.coalesce("root", "unit"))
        crowd = crowd.select(*(c.split()[0] for c in blocking.CROSSED.split(", "))).groupBy(F.pmod(F.hash("key"), F.lit(self.buckets)))
        return crowd.applyInArrow(blocking.crossed(self._rules()), "a long, b long")

    # -- one batch

    @contextmanager
    def _plans(self, adaptive: bool):
        """Static plans as wide as the buckets for the many small even jobs; adaptive ones where keys may be skewed."""
        conf = {"spark.sql.adaptive.enabled": str(adaptive).lower(), "spark.sql.shuffle.partitions": str(self.buckets)}
        before = {k: self.spark.conf.get(k) for k in conf}
        try:
            for k, v in conf.items():
                self.spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def add(self, batch: DataFrame) -> DataFrame:
        """(seq_a, seq_b): each row of the batch that repeats a unit, with the unit's first row.

        The batch is accepted once the manifest is written; a batch that fails before leaves nothing.
        """
        self._forget_unfinished()
        with self._plans(False):
            first, fresh = self._sketched(batch)
            pairs, crowded = self._blocked(fresh)
            verified, n = self._verified(self._met(pairs))
            if n:
                self._learn(verified)
            linked = verified.where(F.col("sim") >= SAME).select("a", "b")
            edges, roots = self._roots(linked)
            if crowded:
                more, n = self._verified(self._possible(self._crossed(roots)))
                if n:
                    edges, roots = self._roots(linked.unionByName(more.where(F.col("sim") >= SAME).select("a", "b")))
            own_rows = self._united(first, edges, roots)
        with self._plans(True):  # one text may be a third of the rows
            rows = self._files("rows", _SKETCH).where(F.col("batch") == self.state["batches"])
            links = rows.select("seq", "h1", "h2").join(own_rows.select("h1", "h2", "root"), ["h1", "h2"]).where("root < seq")
            self._put(links.select(F.col("root").alias("seq_a"), F.col("seq").alias("seq_b")), "links")
        number = self.state["batches"]
        self.state["batches"] += 1
        self._write_manifest()
        self._release()
        return self.links().where(F.col("batch") == number).select("seq_a", "seq_b")

    def _sketched(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(first row of each text of the batch with the root it is known under, the texts that are new)."""
        self._put(sketches(batch).withColumn("rid", F.monotonically_increasing_id()), "rows")
        rows = self._files("rows", _SKETCH + ", rid long").where(F.col("batch") == self.state["batches"]).drop("batch")
        first, seen = rows.groupBy("h1", "h2").agg(F.min("seq").alias("seq"), F.min_by("rid", "seq").alias("rid")), Observation()
        exact = self._stored("exact")
        first = first.withColumn("old", F.lit(None).cast("long")) if exact is None else first.hint("shuffle_hash").join(exact.select("h1", "h2", F.col("root").alias("old")), ["h1", "h2"], "left")
        first = cut(first.observe(seen, F.count("*").alias("n")))
        fresh = rows.drop("h1", "h2", "norm").join(self._small(first.where("old IS NULL").select("rid"), seen.get["n"]), "rid", "left_semi").drop("rid")
        self._append(fresh.select("seq", "n", "path", "coll", *SETS), "facts")
        return first.drop("rid"), fresh

    def _top(self, df: DataFrame, column: str) -> DataFrame:
        """df with the column's units replaced by those they were merged into."""
        for log in self.state.get("logs", []):
            moved = self._files("merged", "node long, root long").where(F.col("batch") == log).select(F.col("node").alias(column), F.col("root").alias("_up"))
            df = df.join(self._small(moved, self.state["merged"]), column, "left").withColumn(column, F.coalesce("_up", column)).drop("_up")
        return df

    def _roots(self, linked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links with the unit of their stored side, (node, root) of the units and texts that they join)."""
        units = self._stored("units")
        edges = linked.withColumn("root", F.lit(None).cast("long")) if units is None else linked.join(units.select(F.col("seq").alias("a"), "root"), "a", "left")
        seen = Observation()
        edges = cut(self._top(edges, "root").observe(seen, F.count("*").alias("n")))
        pairs = edges.select(F.coalesce("root", "a").alias("a"), "b")
        if seen.get["n"] > LOCAL:
            return edges, components(pairs)
        return edges, F.broadcast(self.spark.createDataFrame(united([tuple(r) for r in pairs.collect()]), "node long, root long"))

    def _united(self, first: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
        """Join the links' units, store the new texts' units, and return (h1, h2, root) of the batch's texts."""
        if self.state["batches"]:
            moved = roots.where("root < node").join(edges.where("root IS NOT NULL").select(F.col("root").alias("node")).distinct(), "node", "left_semi")
            seen = Observation()
            self._put(moved.observe(seen, F.count("*").alias("n")).select("node", "root"), "merged")
            if seen.get["n"]:
                self.state["merged"] += seen.get["n"]
                self.state["logs"] = [*self.state.get("logs", []), self.state["batches"]]
                self._compact_merged()
        labels = first.where("old IS NULL").select("seq").join(roots.select(F.col("node").alias("seq"), "root"), "seq", "left").select("seq", F.coalesce("root", "seq").alias("root"))
        self._append(labels, "units")
        own = self._top(first.select("h1", "h2", "seq", "old"), "old").join(self._own("units"), "seq", "left")
        own = cut(own.select("h1", "h2", "old", F.coalesce("old", "root").alias("root")))
        self._append(own.where("old IS NULL").select("h1", "h2", "root"), "exact")
        return own

    def _compact_merged(self) -> None:
        """Make one log of many; each of them is small, as only units that met late are in it."""
        logs = self.state["logs"]
        if len(logs) <= LOGS:
            return
        every = self._files("merged", "node long, root long").where(F.col("batch").isin(logs)).select("node", "root")
        self._put(cut(self._top(every, "root")), "merged")  # cut first: the newest log is replaced by it
        self.state["logs"] = [self.state["batches"]]

    def _release(self) -> None:
        """Let go of the batch's plans, shuffle files and checkpoints, which otherwise wait for a full heap."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def link_batches(batches: DataFrame, history: int = 0, path: str | None = None) -> DataFrame:
    """(seq_a, seq_b) of the rows of the later batches, each batch linked and accepted in turn.

    With a path, the store there is gone on with: its number of batches must be that of the numbers
    that were linked before.
    """
    spark = batches.sparkSession
    sizes = {r[0]: r[1] for r in batches.where("batch_no IS NOT NULL").groupBy("batch_no").count().collect()}  # one row a batch
    numbers = sorted(sizes)
    if not numbers:
        return spark.createDataFrame([], "seq_a long, seq_b long")
    store = Store(spark, path, min(shuffle_width(spark), max(2, -(-sum(sizes.values()) // BUCKET_ROWS))))
    done = store.state["batches"]
    for number in numbers[done:]:
        store.add(batches.where(F.col("batch_no") == number))
    out = store.links()
    store.close()
    later = [k for k, number in enumerate(numbers) if number > history]
    return out.where(F.col("batch").isin(later)).select("seq_a", "seq_b").distinct()
