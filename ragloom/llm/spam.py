"""Keyword-stuffed, link-list and tag pages: bagged trees over content and link features.

Features are counted over each whole text. High-precision rules give weak labels to the clear
pages; bagged decision trees are fitted on a bounded sample of labelled pages (FIT_ROWS of each
label, those with the smallest hash of their id) and rate every page. Page ratings are then
smoothed with the spam rate of the page's host.

Defined cases: null, empty and blank texts are no spam; a page without a host is smoothed with the
rate of all pages; repeated ids give one row; with no page of one of the two labels there is
nothing to learn, and no page is spam but those the rules label so. Other columns are not read.

A host may hold any share of the pages: rates are sums with map-side partial sums, and are joined
back over salted copies of the rates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.runtime import cut

#: Pages of each weak label that the trees are fitted on.
FIT_ROWS = 4000
TREES, DEPTH, LEAF, SEED = 15, 5, 10, 11
#: Weight of the host's rate against the page's own rating, and pages a host's rate is shrunk by.
HOST_WEIGHT, HOST_PRIOR = 0.15, 20.0
SALT = 16

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a an and are as at be been but by can cannot could did do does for from had has have how if in into is it its
    may most no not of often on once one only or other our out over she should since so some such than that the their
    then there these they this to was we were what when where which while who why will with would you your
    aber als am an auch auf aus bei bis da das dass dem den der des die doch ein eine einem einen einer er es für
    gilt hat hier im ist man mit nach nicht noch nur ob oder schon sich sie sind sollte um und vom von vor was weil wenn
    wer werden wie wird zu zum zur
    au aux avant avec ce ces cette dans de des du elle en encore est et il ils la le les leur mais ne ni on ou où par
    pas pour qu que qui sans se si sont sur un une
    al antes como con cuando del el ella en es esta este esto ha hasta la las lo los más no o para pero por porque
    puede que se según si sin sobre solo su sus un una y ya""".split()
)
_URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+", re.I)
_MARK = re.compile(r"<[^<>]{0,2000}>")
_ENTRY = re.compile(r"[\r\n]+|(?<=[.!?。！？])\s+|\s*[|]\s*")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_LETTERS = re.compile(r"[^\W_]")
FEATURES = ["link_share", "links_per_word", "function_share", "sentence_share", "distinct_pairs", "top_share", "tag_share", "comma_share", "bar_share", "entry_words", "log_words", "repeat_share"]


def features(text: str) -> list[float]:
    """The values of FEATURES of a text; -1 in the first if it has no letter or digit."""
    if not _LETTERS.search(text):
        return [-1.0] + [0.0] * (len(FEATURES) - 1)
    size = len(text)
    link_chars = links = 0
    if "://" in text or "www." in text:
        found = _URL.findall(text)
        links, link_chars = len(found), sum(map(len, found))
        text = _URL.sub(" ", text)
    if "<" in text:
        text = _MARK.sub(" ", text)
    tags = text.count("#") - text.count("\n#")
    raw = text.split()
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    function = sum(map(FUNCTION_WORDS.__contains__, words))
    counts = Counter(words)
    top = max((c for w, c in counts.items() if w not in FUNCTION_WORDS), default=0)
    pairs = len(set(zip(words, words[1:])))
    entries, in_sentences, seen = 0, 0, Counter()
    for entry in _ENTRY.split(low):
        own = entry.split()
        if not own:
            continue
        entries += 1
        seen[entry] += 1
        if len(own) >= 5:
            own_function = sum(w.strip("'’\"(,;:") in FUNCTION_WORDS for w in own)
            if own_function >= 2 and own_function * 8 >= len(own):
                in_sentences += len(own)
    total = max(1, len(raw))
    return [
        link_chars / size,
        links / (links + n + 1),
        function / max(1, n),
        min(1.0, in_sentences / total),
        pairs / max(1, n - 1),
        top / max(1, n),
        max(0, tags) / total,
        text.count(",") / total,
        text.count("|") / total,
        len(raw) / max(1, entries),
        float(np.log1p(n)),
        1 - len(seen) / max(1, entries),
    ]


def weak_label(x: np.ndarray) -> np.ndarray:
    """1: clearly spam, 0: clearly prose, -1: unlabelled; rows are values of FEATURES."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    some = f["link_share"] >= 0
    thin = (f["function_share"] < 0.08) & (f["sentence_share"] < 0.1) & some
    kinds = (f["link_share"] > 0.4) | (f["tag_share"] > 0.3) | (f["comma_share"] > 0.2) | (f["bar_share"] > 0.15) | (f["top_share"] > 0.12)
    spam = thin & kinds & ((f["log_words"] > np.log1p(15)) | (f["links_per_word"] > 0.1))
    prose = (f["sentence_share"] > 0.7) & (f["function_share"] > 0.15) & (f["link_share"] < 0.25)
    return np.where(spam, 1, np.where(prose, 0, -1))


class Trees:
    """Bagged decision trees (Gini, quantile thresholds); values are probabilities."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
        self.trees = []
        for _ in range(TREES):
            rows = rng.integers(0, len(x), len(x))
            use = rng.permutation(x.shape[1])[: max(3, 2 * x.shape[1] // 3)]
            self.trees.append(self.grow(x[rows], y[rows], use, DEPTH))

    def grow(self, x, y, use, depth):
        rate = float(y.mean())
        if depth == 0 or rate in (0.0, 1.0) or len(y) < 2 * LEAF:
            return rate
        best = (0.0, None, None)
        here = rate * (1 - rate) * len(y)
        for j in use:
            right = x[:, j][:, None] > self.cuts[j][None, :]
            n1, p1 = right.sum(0), (right & (y[:, None] > 0)).sum(0)
            n0, p0 = len(y) - n1, y.sum() - p1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = here - np.where(n1 > 0, p1 * (1 - p1 / n1), 0) - np.where(n0 > 0, p0 * (1 - p0 / n0), 0)
            gain[(n1 < LEAF) | (n0 < LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, self.cuts[j][k])
        if best[1] is None:
            return rate
        side = x[:, best[1]] > best[2]
        return best[1], best[2], self.grow(x[~side], y[~side], use, depth - 1), self.grow(x[side], y[side], use, depth - 1)

    def _rate(self, node, x, out, rows):
        if not isinstance(node, tuple):
            out[rows] += node
            return
        side = x[rows, node[0]] > node[1]
        self._rate(node[2], x, out, rows[~side])
        self._rate(node[3], x, out, rows[side])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for tree in self.trees:
            self._rate(tree, x, out, np.arange(len(x)))
        return out / len(self.trees)


def page_features(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """(doc_id, host, label, x): the features and the weak label of every page with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([features(t) for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weak_label(x), pa.int32()), pa.array(list(x), pa.list_(pa.float64()))],
                names=["doc_id", "host", "label", "x"],
            )

    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "^[A-Za-z]*:?//([^/]+)", 1))
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), host.alias("host"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "doc_id long, host string, label int, x array<double>")


def fit(pages: DataFrame) -> Trees | None:
    """Trees of a bounded sample, the same for any partitioning: FIT_ROWS pages of each label, those with the smallest hashes.

    The share of hashes that holds about FIT_ROWS and a quarter more is taken from the labels' counts, so
    that no partition sends more than its part of them to the driver.
    """
    sizes = {r[0]: r[1] for r in pages.where("label IN (0, 1)").groupBy("label").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    place = F.xxhash64("doc_id")
    parts = []
    for label in (0, 1):
        edge = min(2**63 - 1, int((1.25 * FIT_ROWS + 200) / sizes[label] * 2**64) - 2**63)
        near = pages.where((F.col("label") == label) & (place <= edge)).groupBy("doc_id").agg(F.max("x").alias("x"))
        rows = sorted(near.select(place.alias("at"), "doc_id", "x").collect())[:FIT_ROWS]
        parts.append(np.array([r.x for r in rows]))
    return Trees(np.vstack(parts), np.concatenate([np.zeros(len(parts[0])), np.ones(len(parts[1]))]))


def rate(docs: DataFrame, key: str = "doc_id", text: str = "text", url: str = "url") -> DataFrame:
    """(doc_id, page_score, host_rate, score, spam) of every page with a text."""
    pages = cut(page_features(docs, key, text, url))
    trees = fit(pages)
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(3).flatten()).reshape(-1, len(FEATURES))
            p = trees(x) if trees else (weak_label(x) == 1).astype(float)
            p[x[:, 0] < 0] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p)], names=["doc_id", "host", "p"])

    own = pages.mapInArrow(run, "doc_id long, host string, p double").groupBy("doc_id").agg(F.max(F.struct("p", "host")).alias("o")).select("doc_id", "o.p", "o.host")
    prior = own.agg(F.avg("p").alias("all"))
    hosts = own.where("host <> ''").groupBy("host").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    scored = (
        own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int"))
        .join(hosts, ["host", "salt"], "left")
        .join(F.broadcast(prior))  # one row
        .withColumn("host_rate", (F.coalesce("s", F.lit(0.0)) + HOST_PRIOR * F.col("all")) / (F.coalesce("n", F.lit(0)) + HOST_PRIOR))
        .withColumn("score", (1 - HOST_WEIGHT) * F.col("p") + HOST_WEIGHT * F.col("host_rate"))
    )
    return scored.select("doc_id", F.col("p").alias("page_score"), "host_rate", "score", (F.col("score") > 0.5).alias("spam"))
