"""Repair of text from scanned pages: furniture, broken words, misread characters, paragraphs.

Furniture: the outer lines of pages are compared under a key in which confusable characters are one
and numbers are a mark. A key that enough pages of a document hold on the same side is a running
header or footer; lines with a number that follows the page numbers by the offset most pages agree
on are page numbers, also when misread.

Misread characters: a noisy channel. Each suspicious word has itself and the words that one known
confusion away as candidates; the channel's probabilities are estimated from all words, the language model has word and word-pair counts of all pages. Viterbi decodes each line over
its candidates; a line with a word that is decoded as another one holds a misread character. A word
whose count the noise of a frequent neighbour explains has no claim to be a word of its own.

Broken words: the last word of a body line ends in a hyphen (or soft hyphen) and goes on in the next
body line; it is broken if the joined word is better attested than the compound with its hyphen.

All counts cover all pages. Documents are never collected: pages are the unit; key and offset votes
are aggregated on the map side; the neighbouring body lines of a page come from windows over blocks
of BLOCK pages and then over blocks, so that a document with any share of the pages is spread. The
workers get the counts of at most SETTLED frequent words for which no candidate is frequent enough to
be decoded (a bounded table that only saves lookups, whatever its size); all other words are looked
up by a join, so that its keys are rare ones.

Defined cases: null paths or pages are dropped; null and empty pages have no lines; a page stored
twice counts once; line numbers are 1-based places in lines; null lines are blank; other columns
are not read.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.runtime import cut

#: Outer lines of each side that may be furniture, and the share of pages that must agree.
EDGE, SHARE = 3, 0.25
#: The share for lines that look like body text.
PROSE_SHARE = 0.6
#: Share of the pages that must agree on the offset of their page numbers.
AGREE = 0.05
#: A line form is furniture everywhere if this share of its lines in so many documents is.
FORM_SHARE, FORM_DOCS = 0.8, 3
BLOCK = 64
#: Words whose counts the workers hold. What is asked of the join does not change the result.
SETTLED = 60_000
#: A candidate must be so many times as frequent as the word; one that is SURE times as frequent shows what noise does.
FACTOR, SURE = 10, 20
#: Weight of the pair model, and the noise level before it is estimated.
LAMBDA, NOISE = 0.6, 0.003

# Confusions of recognisers, read form and true form.
CONFUSIONS = [
    ("c", "e"), ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("@", "a"),
    ("0", "o"), ("1", "l"), ("1", "i"), ("|", "l"), ("|", "i"), ("!", "i"), ("!", "l"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"),
    ("8", "b"), ("rn", "m"), ("vv", "w"), ("ri", "n"), ("cl", "d"), ("f", "t"), ("b", "h"), ("ii", "n"), ("nn", "m"), ("li", "h"),
    ("q", "g"), ("2", "z"), ("ii", "u"), ("m", "rn"), ("h", "li"), ("d", "cl"), ("n", "ri"),
]
_FOLD = [("rn", "m"), ("vv", "w"), ("ri", "n"), ("cl", "d")]
_FOLD_ONE = str.maketrans({"c": "e", "f": "t", "b": "h", "0": "o", "5": "s", "1": "i", "9": "g", "|": "i", "!": "i", "6": "h", "l": "i", "@": "a", "$": "s", "8": "h"})
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "!": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9", "b": "6", "Z": "2", "z": "2"})
_NUMBER = re.compile(r"(?<![\w.])(?:\d+|(?=[\dlI|!OoSsBgbZz]*\d)[\dlI|!OoSsBgbZz]{2,5}|[lI|])(?![\w.,]?\w)")
_ROMAN = re.compile(r"[ivxlcIVXLC1|!]+")
_VALUE = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_HYPHENS = "-\xad‐¬"
_STRIP = ".,;:()[]{}\"'?“”‘’«»*"
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def roman(text: str) -> int | None:
    total, last = 0, 0
    for ch in reversed(text.lower()):
        v = _VALUE.get(ch)
        if v is None:
            return None
        total += v if v >= last else -v
        last = max(last, v)
    return total


def numbers_of(line: str) -> list[tuple[str, int]]:
    """(style, value) of the page numbers a line may show."""
    s = plain(line).strip()
    out = []
    for m in _NUMBER.finditer(s):
        out.append(("arabic", int(m.group().translate(_DIGITS)[:9])))
    bare = s.strip("[](){}-–— .").replace("|", "i").replace("!", "i").replace("1", "i")
    if bare and _ROMAN.fullmatch(bare):
        if (v := roman(bare)) is not None:
            out.append(("roman", v))
        if "l" in bare.lower() and (v := roman(bare.lower().replace("l", "i"))) is not None:
            out.append(("roman", v))
    return out


def bare_number(line: str) -> bool:
    """Whether a line holds nothing but a number, perhaps in brackets or dashes."""
    s = plain(line).strip().strip("[](){}-–—_*~. ")
    return bool(s) and len(s) <= 8 and (bool(_NUMBER.fullmatch(s)) or bool(_ROMAN.fullmatch(s)) or s.isdigit())


def edge_key(line: str) -> str:
    """Lines that differ in numbers and confusable characters only have one key."""
    s = _NUMBER.sub("#", plain(line).strip())
    s = " ".join("#" if w.strip("[]().") and _ROMAN.fullmatch(w.strip("[]().")) and len(s.split()) == 1 else w for w in s.split()).lower()
    for a, b in _FOLD:
        s = s.replace(a, b)
    return s.translate(_FOLD_ONE)


def layout(line: str) -> str:
    """The form of a line: capitals, numbers and punctuation without the words."""
    s = plain(line).strip()
    if bare_number(s) and not any(c.isdigit() for c in s):
        return "roman"
    s = re.sub(r"\s{2,}", "  ", _NUMBER.sub("#", s))
    out = []
    for w in re.split(r"(\s+|[^\w#]+)", s):
        out.append("A" if w.isalpha() and w.isupper() and len(w) > 1 else "T" if w[:1].isupper() and w.isalnum() else "w" if w.isalnum() else w)
    return "".join(out)


_EDGES = "path string, page int, line_no int, side string, rank int, key string, bare boolean, title boolean, prose boolean, form string, style string, value int"


def edges(pages: DataFrame) -> DataFrame:
    """The outer lines of all pages; a line with several possible numbers has a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, page, lines in zip(*(c.to_pylist() for c in batch.columns)):
                full = [(i, x) for i, x in enumerate(lines or [], 1) if x and x.strip()]
                for side, outer in (("top", full), ("bottom", full[::-1])):
                    for rank, (i, x) in enumerate(outer[:EDGE]):
                        words = x.split()
                        title = 2 <= len(words) <= 8 and x.strip()[-1] not in ".,;:!?-" and all(w[:1].isupper() or w in ("and", "of", "the", "in", "for", "to", "a", "on") for w in words)
                        for style, value in numbers_of(x) or [(None, None)]:
                            rows.append((path, page, i, side, rank, edge_key(x), bare_number(x), title, x.rstrip()[-1] in ".,;:" + _HYPHENS or len(words) > 9, layout(x), style, value))
            columns = list(zip(*rows)) if rows else [()] * 12
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int32())
            names = ["path", "page", "line_no", "side", "rank", "key", "bare", "title", "prose", "form", "style", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return pages.mapInArrow(run, _EDGES)


def furniture(pages: DataFrame) -> DataFrame:
    """(path, page, line_no) of running headers, running footers and page numbers."""
    outer = cut(edges(pages))
    sizes = pages.where("size(lines) > 0").groupBy("path").agg(F.count("*").alias("pages"))
    need = F.greatest(F.lit(2), F.ceil(F.col("pages") * SHARE))
    often = F.when(F.col("prose"), F.ceil(F.col("pages") * PROSE_SHARE)).otherwise(need)
    keyed = outer.where("NOT bare").groupBy("path", "side", "key").agg(F.count_distinct("page").alias("n"), F.max("prose").alias("prose")).join(sizes, "path").where((F.col("n") >= need) & (F.col("n") >= often)).select("path", "side", "key")
    by_key = outer.join(keyed, ["path", "side", "key"], "left_semi")
    votes = outer.where("style IS NOT NULL").groupBy("path", "side", "style", (F.col("value") - F.col("page")).alias("shift")).agg(F.count_distinct("page").alias("n"))
    agree = F.greatest(F.lit(2), F.ceil(F.col("pages") * AGREE))
    best = votes.join(sizes, "path").where(F.col("n") >= agree).groupBy("path", "side", "style").agg(F.max(F.struct("n", "shift")).alias("b")).select("path", "side", "style", "b.shift")
    numbered = outer.join(best, ["path", "side", "style"]).where("value - page = shift AND (bare OR title OR rank = 0 AND length(key) < 60)")
    # a title in the slot that other pages of the document fill with furniture
    slots = by_key.where("rank = 0").groupBy("path", "side").agg(F.count_distinct("page").alias("n")).join(sizes, "path").where("n * 2 >= pages AND pages > 2").select("path", "side")
    titled = outer.where("title AND rank = 0 AND side = 'top'").join(slots, ["path", "side"], "left_semi")
    cols = ["path", "page", "line_no"]
    sure = cut(by_key.select(*cols).union(numbered.select(*cols)).union(titled.select(*cols)).distinct())
    # lines of documents that show their furniture once: a form that is furniture in nearly all other documents
    forms = outer.where("form = 'roman' OR (NOT bare OR form <> '#') AND (form LIKE '%#%' OR title)").groupBy("path", "page", "line_no", "side", "form").agg(F.min("rank").alias("rank"))
    rated = forms.join(sure.withColumn("sure", F.lit(1)), cols, "left").groupBy("side", "form").agg(F.count("*").alias("n"), F.count("sure").alias("k"), F.approx_count_distinct("path", 0.02).alias("docs"))
    good = rated.where((F.col("docs") >= FORM_DOCS) & (F.col("k") >= FORM_SHARE * F.col("n"))).select("side", "form")
    return sure.union(forms.where("rank <= 1").join(good, ["side", "form"], "left_semi").select(*cols)).distinct()


def single_pages(pages: DataFrame) -> DataFrame:
    """(path, page, lines), each page once."""
    rows = pages.where("path IS NOT NULL AND page_number IS NOT NULL").select("path", F.col("page_number").cast("int").alias("page"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    return rows.groupBy("path", "page").agg(F.max("lines").alias("lines"))


def bodies(pages: DataFrame, outer: DataFrame) -> DataFrame:
    """(path, page, body, before, after): body lines of each page, and the body lines next to them."""
    marks = outer.groupBy("path", "page").agg(F.collect_set("line_no").alias("marks"))  # six lines of a page at most
    rows = pages.join(marks, ["path", "page"], "left").select(
        "path", "page",
        F.expr("filter(transform(lines, (x, i) -> struct(i + 1 AS no, coalesce(x, '') AS text)), l -> NOT coalesce(array_contains(marks, l.no), false))").alias("body"),
    )
    real = F.expr("filter(body, l -> trim(l.text) <> '')")
    rows = cut(rows.withColumn("real", real).select("path", "page", "body", F.expr("get(real, 0).text").alias("first"), F.expr("get(real, size(real) - 1).text").alias("last"), F.floor(F.col("page") / BLOCK).alias("block")))
    order = Window.partitionBy("path", "block").orderBy("page")
    up, down = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("in_before", F.last("last", ignorenulls=True).over(up)).withColumn("in_after", F.first("first", ignorenulls=True).over(down))
    blocks = rows.groupBy("path", "block").agg(F.min_by("first", F.when(F.col("first").isNotNull(), F.col("page"))).alias("b_first"), F.max_by("last", F.when(F.col("last").isNotNull(), F.col("page"))).alias("b_last"))
    of_path = Window.partitionBy("path").orderBy("block")
    blocks = blocks.select(
        "path", "block",
        F.last("b_last", ignorenulls=True).over(of_path.rowsBetween(Window.unboundedPreceding, -1)).alias("p_last"),
        F.first("b_first", ignorenulls=True).over(of_path.rowsBetween(1, Window.unboundedFollowing)).alias("n_first"),
    )
    return rows.join(blocks, ["path", "block"]).select("path", "page", "body", F.coalesce("in_before", "p_last").alias("before"), F.coalesce("in_after", "n_first").alias("after"))


def word_parts(token: str) -> list[str]:
    """The words of a token, as they are counted; identifiers are split."""
    t = token.strip(_STRIP)
    if not t:
        return []
    if "_" in t:
        parts = [x for x in t.split("_") if x]
    elif _CAMEL.search(t):
        parts = _CAMEL.split(t)
    else:
        parts = [t]
    out = []
    for p in parts:
        out += [x for x in re.split(r"[-/]", p) if x]
    return [x.lower().strip(_STRIP) for x in out if x.strip(_STRIP)]


_LABEL = re.compile(r"[a-z]\d{1,3}")
_LETTER = re.compile(r"[^\W\d_]")


def candidates(word: str) -> dict[str, tuple[str, str]]:
    """True forms one confusion away, with the confusion."""
    out = {}
    for a, b in CONFUSIONS:
        i = word.find(a)
        while i >= 0:
            out.setdefault(word[:i] + b + word[i + len(a) :], (a, b))
            i = word.find(a, i + 1)
    if sum(c in "01!|5$69@8éèêáàíóú" for c in word) > 1:
        fixed = word.translate(str.maketrans("01!|5$69@8éèêáàíóú", "olilssbgabeeeaaiou"))
        out.setdefault(fixed, ("0", "o"))
    return out


def broken_end(line: str) -> str | None:
    """The part before the hyphen that ends a line, None if there is none."""
    s = line.rstrip()
    if len(s) < 2 or s[-1] not in _HYPHENS or s[-2] in _HYPHENS or not s[-2].isalnum() and s[-2] not in "!|@$":
        return None
    return s.split()[-1]


def segments(body: list[dict], before: str | None, after: str | None):
    """(line number, text, its words, head of a broken word or None, tail token or None) of the lines with text."""
    real = [(x["no"], x["text"]) for x in body if x["text"].strip()]
    out = []
    prev = before
    for k, (no, text) in enumerate(real):
        follow = real[k + 1][1] if k + 1 < len(real) else after
        tokens = text.split()
        carried = prev is not None and broken_end(prev) is not None
        head = broken_end(text)
        tail = follow.split()[0] if head and follow and follow.split() else None
        inner = tokens[1 if carried else 0 : len(tokens) - (1 if head else 0)]
        out.append((no, text, inner, head, tail))
        prev = text
    return out


def _flat(tokens: list[str]) -> list[str]:
    return [p for t in tokens for p in word_parts(t)]


def halves(head: str, tail: str) -> tuple[str, str]:
    """The last word before the hyphen and the first after it, as counted."""
    a = re.split(r"[-/_]", head.rstrip(_HYPHENS).strip(_STRIP))[-1].lower().strip(_STRIP)
    b = re.split(r"[-/_]", tail.strip(_STRIP))[0].lower().strip(_STRIP)
    return a, b


def model(pages: DataFrame) -> DataFrame:
    """(key, n): counts of words, of word pairs ("a b") and of compounds ("a-b") over all body lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["key", "n"])
        for batch in batches:
            for body, before, after in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                for _, _, inner, _, _ in segments(body, before, after):
                    words = _flat(inner)
                    count.update(words)
                    count.update(map(" ".join, zip(words, words[1:])))
                    for t in inner:
                        if "-" in t.strip(_STRIP + "-"):
                            parts = [x for x in t.strip(_STRIP).lower().split("-") if x]
                            count.update("-".join(x) for x in zip(parts, parts[1:]))
            if len(count) > 200_000:
                yield flush()
                count = Counter()
        yield flush()

    return pages.mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


class Known:
    """Counts of a page's keys, and those every worker holds."""

    def __init__(self, found: dict[str, int], settled: dict[str, int]):
        self.found, self.settled = found, settled

    def get(self, key: str, default: int = 0) -> int:
        n = self.found.get(key)
        return self.settled.get(key, default) if n is None else n


def settle(counts: DataFrame) -> tuple[dict[str, int], dict[tuple[str, str], float], int]:
    """(counts of frequent words beyond doubt, confusion probabilities over all words, number of words).

    Candidates are met with their counts by a join; to the driver come a row for each confusion, a
    histogram, and the words above the count that at most SETTLED words reach.
    """
    words = counts.where("NOT contains(key, ' ') AND NOT contains(key, '-')")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chances: Counter = Counter()
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) if rows else [()] * 4, kinds)], names=["key", "word", "n", "rule"])
        rule_of = {rule: k for k, rule in enumerate(CONFUSIONS)}
        for batch in batches:
            rows = []
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(c, w, n, rule_of[rule]) for c, rule in candidates(w).items()]
                for k, (_, b) in enumerate(CONFUSIONS):
                    if b in w:
                        chances[k] += n
            yield make(rows)
        yield make([(None, None, n, k) for k, n in chances.items()])

    asked = cut(words.select("key", "n").mapInArrow(run, "key string, word string, n long, rule int"))
    met = cut(asked.where("word IS NOT NULL").join(words.select("key", F.col("n").alias("c")), "key").where(F.col("c") >= FACTOR * F.col("n")).select("word", "n", "rule", "c"))
    seen = {CONFUSIONS[r.rule]: r.n for r in met.where(F.col("c") >= SURE * F.col("n")).groupBy("rule").agg(F.sum("n").alias("n")).collect()}
    chances = {CONFUSIONS[r.rule]: r.n for r in asked.where("word IS NULL").groupBy("rule").agg(F.sum("n").alias("n")).collect()}
    noise = {rule: min(0.05, max(1e-4, (seen.get(rule, 0) + 1) / (chances.get(rule, 0) + 1 / NOISE))) for rule in CONFUSIONS}
    sure = cut(words.where(F.col("key").rlike(r"^\p{L}+$") & (F.col("n") >= 3)).join(met.select(F.col("word").alias("key")).distinct(), "key", "left_anti").select("key", "n"))
    size = F.floor(F.log2("n") * 8).cast("int")
    held, least = 0, None
    for r in sorted(sure.groupBy(size.alias("size")).count().collect(), reverse=True):
        held += r["count"]
        if held > SETTLED:
            break
        least = r.size
    settled = {} if least is None else {r.key: r.n for r in sure.where(size >= least).collect()}
    total = words.agg(F.sum("n")).first()[0] or 1
    return settled, noise, int(total)


def doubtful(word: str, settled: dict[str, int]) -> bool:
    return word not in settled and bool(_LETTER.search(word) or re.search(r"[!|@$]", word)) and not _LABEL.fullmatch(word)


def _keys(body, before, after, settled) -> set[str]:
    """All counts that decoding a page needs."""
    keys = set()
    for _, _, inner, head, tail in segments(body, before, after):
        words = _flat(inner)
        for k, w in enumerate(words):
            if doubtful(w, settled):
                options = [w, *candidates(w)]
                keys.update(options)
                for o in options:
                    if k:
                        keys.add(f"{words[k - 1]} {o}")
                    if k + 1 < len(words):
                        keys.add(f"{o} {words[k + 1]}")
                keys.update(x for x in words[max(0, k - 1) : k + 2])
        if head and tail:
            a, b = halves(head, tail)
            keys.update((a + b, f"{a}-{b}", a, b, *candidates(a + b), *(c + b for c in candidates(a))))
    return keys.difference(settled)


def decode(words: list[str], n: Known, settled: dict[str, int], noise: dict, total: int) -> list[str]:
    """Viterbi over the candidates of each word of a line."""
    columns = []
    for w in words:
        own = n.get(w, 0)
        options = [(w, 0.0, max(own, 0.5))]
        if doubtful(w, settled):
            explained = 0.0
            for c, rule in candidates(w).items():
                count = n.get(c, 0)
                if count >= FACTOR * max(own, 1):
                    p = noise.get(rule, NOISE)
                    options.append((c, math.log(p), count))
                    explained += count * p
            odd = bool(re.search(r"[^\W\d_]*[\d!|@$][^\W\d_]|[^\W\d_][!|@$0156]", w)) and not _LABEL.fullmatch(w)
            if len(options) > 1 and (own <= 2 + 6 * explained or odd):
                options[0] = (w, 0.0, 0.01)  # the noise of its neighbours explains its count
        columns.append(options)
    if not any(len(c) > 1 for c in columns):
        return words
    best = [[(math.log(o[2] / total) + o[1], -1) for o in columns[0]]]
    for k in range(1, len(columns)):
        row = []
        for o in columns[k]:
            unigram = o[2] / total
            top = None
            for j, q in enumerate(columns[k - 1]):
                pair = n.get(f"{q[0]} {o[0]}", 0) if q[2] >= 1 and o[2] >= 1 else 0
                p = LAMBDA * pair / max(q[2], pair, 1) + (1 - LAMBDA) * unigram
                score = best[-1][j][0] + math.log(p) + o[1]
                if top is None or score > top[0]:
                    top = (score, j)
            row.append(top)
        best.append(row)
    j = max(range(len(best[-1])), key=lambda x: best[-1][x][0])
    out = []
    for k in range(len(columns) - 1, -1, -1):
        out.append(columns[k][j][0])
        j = best[k][j][1]
    return out[::-1]


def is_broken(head: str, tail: str, n: Known) -> bool:
    """Whether the word goes on without its hyphen."""
    if head[-1] in "\xad¬":
        return True
    a, b = halves(head, tail)
    if not a or not b or not (_LETTER.match(b) or b[0] in "!|01569@$"):
        return False
    if tail[:1].isupper() and not head[:-1].isupper():
        return False
    joined = max([n.get(a + b, 0), *(n.get(c, 0) // 2 for c in candidates(a + b))])
    compound = n.get(f"{a}-{b}", 0)
    if joined or compound:
        return joined > compound
    return not (n.get(a, 0) >= 3 and n.get(b, 0) >= 3 and len(a) > 2 and len(b) > 2)


_OUT = "path string, page int, line_no int, text string, repaired string, misread boolean, broken boolean"


def repaired_lines(scan: DataFrame, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(body lines with their repair and noise, furniture)."""
    pages = cut(single_pages(scan))
    outer = cut(furniture(pages))
    body = cut(bodies(pages, outer).withColumn("pid", F.xxhash64("path", "page")))
    counts = cut(model(body))
    known = scan.sparkSession.sparkContext.broadcast(settle(counts))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled = known.value[0]
        for batch in batches:
            pid, key = [], []
            for own, lines, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                found = _keys(lines, before, after, settled)
                pid += [own] * len(found)
                key += found
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(key, pa.string())], names=["pid", "key"])

    asked = body.select("pid", "body", "before", "after").mapInArrow(keys, "pid long, key string")
    answered = asked.join(counts, "key").groupBy("pid").agg(F.collect_list(F.struct("key", "n")).alias("counts"))  # keys of one page
    joined = body.join(answered, "pid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled, noise, total = known.value
        for batch in batches:
            rows = []
            for path, page, lines, before, after, found in zip(*(c.to_pylist() for c in batch.columns)):
                n = Known({x["key"]: x["n"] for x in found or []}, settled)
                for no, text, inner, head, tail in segments(lines, before, after):
                    words = _flat(inner)
                    said = decode(words, n, settled, noise, total)
                    wrong = words != said or any(mixed_number(t) or inner_capital(t, n) for t in inner)
                    broken = bool(head and tail and is_broken(head, tail, n))
                    if head and tail and not wrong and broken:
                        wrong = misread_half(head, tail, n)
                    rows.append((path, page, no, text if with_text else None, repair(text, words, said, broken) if with_text else None, wrong, broken))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "page", "line_no", "text", "repaired", "misread", "broken"])

    return joined.select("path", "page", "body", "before", "after", "counts").mapInArrow(run, _OUT), outer


def mixed_number(token: str) -> bool:
    """A number with a letter that was read for a digit."""
    t = token.strip(_STRIP)
    return bool(re.fullmatch(r"(?=.*\d)[\d.,]*[lIO|][\dlIO|.,]*", t)) and not t.isdigit()


def inner_capital(token: str, n: Known) -> bool:
    """A capital O read for an o inside a word in small letters."""
    t = token.strip(_STRIP)
    if "O" not in t[1:] or t.isupper() or not re.search(r"[a-z]O|O[a-z]", t[1:] if t[0] != "O" else t):
        return False
    low = t.lower()
    return n.get(low) >= 3 or not re.search(r"[a-z]O[a-z]{2,}", t)


def misread_half(head: str, tail: str, n: Known) -> bool:
    """Whether the part of a broken word that stands on its first line holds the confusion."""
    a, b = halves(head, tail)
    if n.get(a + b, 0):
        return False
    return any(n.get(c + b, 0) for c in candidates(a))


def repair(text: str, words: list[str], said: list[str], broken: bool) -> str:
    """The line with its decoded words, without a trailing hyphen if its word goes on."""
    out = text.strip()
    for w, s in zip(words, said):
        if w != s:
            out = re.sub(re.escape(w), lambda m, s=s: s.capitalize() if m.group()[:1].isupper() else s, out, count=1, flags=re.I)
    return out[:-1] if broken and out[-1:] in _HYPHENS else out


def noise_of(scan: DataFrame) -> DataFrame:
    """(path, page_number, line_no, kind): the places of furniture, broken words and misread characters."""
    lines, outer = repaired_lines(scan, with_text=False)
    kinds = F.array_compact(F.array(F.when(F.col("broken"), "broken_word"), F.when(F.col("misread"), "misread")))
    body = lines.where("misread OR broken").select("path", "page", "line_no", F.explode(kinds).alias("kind"))
    return body.unionByName(outer.withColumn("kind", F.lit("furniture"))).select("path", F.col("page").alias("page_number"), "line_no", "kind")


def paragraphs(scan: DataFrame) -> DataFrame:
    """(path, page_number, paragraph_no, text, last_page): readable paragraphs, over page ends too.

    A paragraph ends at a blank line or at a line clearly shorter than the page's lines that ends a
    sentence. A page's last paragraph that does not end goes on with the next page's first one, without
    a blank between them if a word is broken there; it stands at the page where it begins.
    """
    lines, _ = repaired_lines(scan)
    width = Window.partitionBy("path", "page")
    order = width.orderBy("line_no")
    long = F.max(F.length("text")).over(width)
    ends = F.trim("text").rlike(r"[.!?:]['\")]*$") & (F.length("text") < long * 0.75)
    rows = lines.withColumn("ends", ends).withColumn("gap", (F.col("line_no") - F.lag("line_no").over(order)) > 1)
    rows = rows.withColumn("starts", (F.coalesce("gap", F.lit(False)) | F.coalesce(F.lag("ends").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("no", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.array_sort(F.collect_list(F.struct("line_no", "repaired", "broken", "ends")))  # lines of one page
    grouped = rows.groupBy("path", "page", "no").agg(piece.alias("p"))
    glued = "aggregate({0}, '', (acc, x) -> concat(acc, x.{1}, CASE WHEN x.broken THEN '' ELSE ' ' END))"
    last = F.max("no").over(width)
    parts = cut(grouped.select("path", "page", F.col("no").cast("int").alias("no"), F.expr(glued.format("p", "repaired")).alias("text"), F.expr("element_at(p, -1).broken").alias("broken"), F.expr("element_at(p, -1).ends").alias("ends"), (F.col("no") == last).alias("last")))
    parts = parts.withColumn("text", F.rtrim("text")).withColumn("open", F.col("last") & ~F.col("ends"))
    chained = parts.join(_chains(parts), ["path", "page"])
    goes_on = (F.col("no") == 0) & F.col("goes_on")
    at = F.when(goes_on, F.col("anchor")).otherwise(F.col("page"))
    tail = F.when(goes_on | F.col("open"), F.lit(-1)).otherwise(F.col("no"))  # the open end of a page and what goes on with it
    whole = chained.groupBy("path", at.alias("page_number"), tail.alias("tail")).agg(F.array_sort(F.collect_list(F.struct("page", "no", "text", "broken"))).alias("q"))
    return whole.select("path", "page_number", F.expr("q[0].no").alias("paragraph_no"), F.trim(F.expr(glued.format("q", "text"))).alias("text"), F.expr("element_at(q, -1).page").alias("last_page"))


def _chains(parts: DataFrame) -> DataFrame:
    """(path, page, goes_on, anchor): whether a page's first paragraph goes on from earlier, and from which page.

    Windows go over blocks of pages and then over blocks, as a document may have any share of the pages.
    """
    pages = parts.groupBy("path", "page").agg(F.max("open").alias("open"), (F.max("no") == 0).alias("single")).withColumn("block", F.floor(F.col("page") / BLOCK))
    order = Window.partitionBy("path", "block").orderBy("page")
    of_path = Window.partitionBy("path").orderBy("block")
    before = of_path.rowsBetween(Window.unboundedPreceding, -1)
    ends = pages.groupBy("path", "block").agg(F.max_by("open", "page").alias("b_open")).withColumn("b_open", F.lag("b_open").over(of_path))
    pages = pages.withColumn("in_open", F.lag("open").over(order)).join(ends, ["path", "block"])
    pages = pages.withColumn("goes_on", F.coalesce("in_open", "b_open", F.lit(False)))
    pages = pages.withColumn("begins", F.when(~(F.col("goes_on") & F.col("single")), F.col("page")))
    up = order.rowsBetween(Window.unboundedPreceding, -1)
    firsts = pages.groupBy("path", "block").agg(F.max("begins").alias("b_begins")).withColumn("b_begins", F.last("b_begins", ignorenulls=True).over(before))
    pages = pages.withColumn("in_begins", F.last("begins", ignorenulls=True).over(up)).join(firsts, ["path", "block"])
    return pages.select("path", "page", "goes_on", F.coalesce("in_begins", "b_begins", "page").alias("anchor"))


def pages_of_chunks(chunks: DataFrame) -> DataFrame:
    """(path, page_number, lines): pages put together again from their windows (file_path, page_number, start_char, text).

    Windows overlap; each adds what goes beyond the one before. Rows with a null path, page or text are
    dropped, a null start is 0; a page stored twice has the same windows.
    """
    rows = chunks.where("file_path IS NOT NULL AND page_number IS NOT NULL AND text IS NOT NULL")
    windows = F.array_sort(F.collect_set(F.struct(F.coalesce("start_char", F.lit(0)).alias("s"), F.col("text").alias("t"))))  # of one page
    longer = "CASE WHEN x.s >= length(acc) THEN concat(acc, CASE WHEN length(acc) > 0 AND x.s > length(acc) THEN '\n' ELSE '' END, x.t) WHEN x.s + length(x.t) <= length(acc) THEN acc ELSE concat(acc, substring(x.t, length(acc) - x.s + 1)) END"
    joined = rows.groupBy(F.col("file_path").alias("path"), "page_number").agg(windows.alias("w")).withColumn("t", F.expr(f"aggregate(w, '', (acc, x) -> {longer})"))
    return joined.select("path", "page_number", F.split("t", "\r\n|\n|\r").alias("lines"))
