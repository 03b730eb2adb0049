"""Source files nobody wrote by hand: generated, minified, vendored, or data saved as code.

Vendored copies are found by Merkle hashes computed bottom-up over the directory trees: a file's
hash is that of its text without white space differences, a directory's that of the multiset of its
children's hashes, names left out. A subtree that occurs in MIN_REPOS or more unrelated repositories
marks all files below it as copies. Repositories are unrelated if the hashes of their own folders (the
uppermost ones that hold no other repository's files) differ, so that mirrors of one repository count
once, whatever their names. Files with less code than MIN_CODE characters prove
nothing on their own.

Generated, minified and data files are told by header and layout rules on each text: a marker in the
opening comments that says the file itself is a tool's output; functions that are numbered siblings;
dense long lines; texts that are mostly literals or an encoded dump.

A copy that only one repository holds has no partner, so that hashes cannot tell it. Its reason is
"foreign", apart from "vendored": the opening comments (a release banner or upstream note that names
the file's own library), or a folder kept for foreign code.

A directory's hash is a sum and an exclusive or over its children, so that a directory with any
share of all files is combined on the map side; levels are cut, each is made once. Hot hashes are
aggregated by (hash, repository) first, and both joins on keys that many files share (a hash, a
folder) meet SALT copies of the small side. Files ask only for folders at depths where a shared
folder lies. No group is collected.

Defined cases: null paths or texts are dropped; a null repository is taken from the path; the same
path stored twice is one file (flagged if any of its texts is); empty texts are never flagged; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.runtime import cut

MIN_REPOS = 2
MIN_CODE = 200
SALT = 16

_OPENING = re.compile(r"\A[﻿\s]*(?:(?://[^\n]*|/\*[\s\S]*?\*/)\s*)+")
_OUTPUT = re.compile(
    r"""\bgenerated\b[^\n]{0,80}\b(?:by|from|with)\b[^\n]{0,120}(?:[\s*/#]*[^\n]{0,120})?\bdo\s+not\s+(?:edit|modify)
    |\b(?:automatically|auto|machine)[\s-]*(?:generated|created|produced|written)\b[^\n]{0,40}\b(?:by|from|with|using)\b
    |\b(?:file|code|source|header)\s+(?:is|was|has\s+been)\s+(?:automatically\s+|auto-?\s*|machine[-\s])?(?:generated|created|produced)\b[^\n]{0,40}\b(?:by|from|with|using)\b
    |<auto-?generated\b|@generated\b|\bAUTO-?GENERATED\s*(?::|\bfile\b)
    |^[\s/*\#]*@@\w+:\w+=
    |\bgenerated\s+by\s+[\w.+-]+\s+(?:v(?:ersion)?\s*)?\d+(?:\.\d+)+
    |\bchanges\s+(?:\w+\s+){0,4}(?:will|would)\s+be\s+(?:lost|overwritten)""",
    re.I | re.X | re.M,
)
_BY_HAND = re.compile(r"\b(?:by\s+hand|hand-?\s*(?:written|maintained|edited)|maintained\s+manually|was\s+(?:once\s+)?auto-?generated\s+once|once\s+generated|not\s+generated)\b", re.I)
_FUNCTION = re.compile(r"^[A-Za-z_][^\n;={}()]*?[\s*&]((?:\w+::)*~?\w+)\s*\(", re.M)
_NUMBERED = re.compile(r"\d+")
_STRING = re.compile(r'"(?:[^"\\\n]|\\.)*"')
_LITERAL = re.compile(r"(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d[\d.]*(?:[eE][-+]?\d+)?)[uUlLfF]*\s*[,;}\n]")
_COMMENT = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/")
_WORDY = re.compile(r"[A-Za-z_]\w*")
_DUMP = re.compile(r"^(?:[0-9a-fA-F]{6,16}[:\s]+)?(?:[0-9a-fA-F]{2,8}[\s|]+){7,}.*$|^[A-Za-z0-9+/=]{50,}$", re.M)
_BLOB = re.compile(r'"(?:\\x[0-9a-fA-F]{2}|[A-Za-z0-9+/=]){40,}"')
# Folders that hold foreign code.
FOREIGN = frozenset("third_party third-party thirdparty 3rdparty vendor vendored extern external externals deps contrib node_modules".split())
_UPSTREAM = re.compile(r"\bupstream\s+copy\b|\bpublic\s+release\b|\bsingle-(?:file|header)\s+library\b|\bvendored\s+(?:from|copy)\b", re.I)
_VERSION = re.compile(r"\bv?\d+\.\d+(?:\.\d+)*\b")


def foreign(path: str, text: str) -> bool:
    """Whether the path or the opening comments say that the file comes from another project."""
    parts = path.lower().split("/")
    if FOREIGN.intersection(parts[2:-1]):
        return True
    opening = _OPENING.match(text)
    if not opening:
        return False
    head = opening.group()
    stem = re.sub(r"(?:[_-](?:core|impl|amalgamated|all))?\.\w+$", "", parts[-1])
    named = len(stem) > 3 and any(stem in line.lower() and (_VERSION.search(line) or _UPSTREAM.search(line)) for line in head.split("\n"))
    return named and bool(_UPSTREAM.search(head) or "spdx-license-identifier" in head.lower())


def numbered(code: str) -> float:
    """Share of the functions whose names differ only in numbers, if there are several."""
    names = _FUNCTION.findall(code)
    if len(names) < 3:
        return 0.0
    last, runs = None, 0
    for name in names:
        found = _NUMBERED.findall(name)
        now = int(found[-1][:9]) if found else None
        runs += now is not None and (last is None and now <= 1 or last is not None and now == last + 1)
        last = now
    return runs / len(names)


def kind(text: str) -> str | None:
    """generated, minified, data or None of one text."""
    body = text.strip()
    if not body:
        return None
    opening = _OPENING.match(text)
    if opening:
        head = opening.group()
        for m in _OUTPUT.finditer(head):
            start = head.rfind("\n", 0, m.start()) + 1
            end = head.find("\n", m.end())
            if not _BY_HAND.search(head[start : end if end >= 0 else len(head)]):
                return "generated"
    code = _COMMENT.sub(" ", text) if "//" in text or "/*" in text else text
    size = len(code)
    dense = "".join(code.split())
    if not dense:
        return None
    dumps = sum(len(m) for m in _DUMP.findall(text))
    if dumps > 0.5 * len(body):
        return "data"
    literals = sum(map(len, _LITERAL.findall(code)))
    blobs = sum(map(len, _BLOB.findall(code))) if '"' in code else 0
    if (literals + blobs > 0.5 * size or blobs > 0.5 * size) and size > 400:
        return "data"
    lines = [x for x in code.split("\n") if x.strip()]
    longest = max(map(len, lines))
    if longest > 500:
        long_chars = sum(n for x in lines if len(x) > 300 and (n := len(_STRING.sub("", x))) > 300)  # a long literal is none
        if long_chars > 0.5 * size and len(dense) > 0.88 * size and len(_WORDY.findall(code)) * 40 > size:
            return "minified"
    if numbered(code) >= 0.6:
        return "generated"
    return None


def content_kinds(files: DataFrame) -> DataFrame:
    """(file_path, kind) of the texts that their own content gives away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            texts = [t.replace("\r\n", "\n") for t in batch.column(1).to_pylist()]
            got = [(p, k) for p, t in zip(paths, texts) if (k := kind(t) or ("foreign" if t.strip() and foreign(p, t) else None))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.string()), pa.array([k for _, k in got], pa.string())], names=["file_path", "kind"])

    rows = files.where("file_path IS NOT NULL AND text IS NOT NULL").select("file_path", "text")
    return rows.mapInArrow(run, "file_path string, kind string")


_NODE = ["path", "lowest", "highest", "h", "g", "code", "is_file"]


def merkle(files: DataFrame) -> DataFrame:
    """(path, depth, lowest, highest, h, g, code, is_file): the nodes of all trees with two hashes each.

    lowest and highest are the least and greatest repository below a node. A path stored with several
    texts has a node for each, but only one of them counts in its folder.
    """
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    repo = F.coalesce("repo", F.try_element_at(F.split(F.ltrim("file_path", F.lit("/")), "/"), F.lit(2)), F.lit(""))
    leaf = files.where("file_path IS NOT NULL AND text IS NOT NULL").select("file_path", repo.alias("repo"), plain.alias("t"))
    leaf = leaf.select(F.col("file_path").alias("path"), "repo", F.xxhash64("t").alias("h"), F.hash("t", F.length("t")).cast("long").alias("g"), F.length("t").cast("long").alias("code"))
    leaf = leaf.groupBy("path", "h", "g").agg(F.max("code").alias("code"), F.min("repo").alias("lowest"), F.max("repo").alias("highest"))
    leaf = cut(leaf.withColumns({"depth": F.size(F.split("path", "/")), "is_file": F.lit(True)}))
    deepest = leaf.agg(F.max("depth")).first()[0] or 0
    out, below = [leaf.select("depth", *_NODE)], None
    for d in range(deepest, 1, -1):
        own = leaf.where(F.col("depth") == d).groupBy("path").agg(F.max(F.struct("h", "g", "code")).alias("x"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
        here = own.select("path", "lowest", "highest", "x.h", "x.g", "x.code")
        here = here if below is None else here.unionByName(below.select(here.columns))
        both = F.xxhash64("h", "g")
        below = here.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path")).agg(
            F.min("lowest").alias("lowest"),
            F.max("highest").alias("highest"),
            F.xxhash64(F.bit_xor(both), F.sum(F.pmod(both, F.lit(1_000_000_007))), F.count("*")).alias("h"),
            F.hash(F.bit_xor(F.hash("g", "h")), F.sum(F.pmod(F.hash("h"), F.lit(999_983)).cast("long")), F.count("*")).cast("long").alias("g"),
            F.sum("code").alias("code"),
            F.lit(False).alias("is_file"),
        )
        below = cut(below.withColumn("depth", F.lit(d - 1)))
        out.append(below.select("depth", *_NODE))
    nodes = out[0]
    for x in out[1:]:
        nodes = nodes.unionByName(x)
    return nodes


def shared_subtrees(nodes: DataFrame) -> DataFrame:
    """(h, g, repos): hashes of subtrees that MIN_REPOS or more unrelated repositories hold."""
    own = nodes.where("lowest = highest").withColumnRenamed("lowest", "repo")
    roots = own.where("NOT is_file").groupBy("repo", "depth").agg(F.bit_xor(F.xxhash64("h", "g")).alias("root")).groupBy("repo").agg(F.min_by("root", "depth").alias("root"))
    held = own.where(F.col("code") >= MIN_CODE).groupBy("h", "g", "repo").agg(F.lit(1).alias("one"))
    kept = held.join(roots, "repo", "left").groupBy("h", "g", F.coalesce("root", F.xxhash64("repo")).alias("root")).agg(F.lit(1).alias("one"))
    return kept.groupBy("h", "g").agg(F.count("*").alias("repos")).where(F.col("repos") >= MIN_REPOS)


def _salted(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def vendored(files: DataFrame) -> DataFrame:
    """(file_path, repos) of the files below a shared subtree."""
    nodes = merkle(files)
    salt = F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int").alias("salt")
    marked = cut(nodes.select("path", "depth", "is_file", "h", "g", salt).join(_salted(shared_subtrees(nodes)), ["h", "g", "salt"]).select("path", "depth", "is_file", "repos"))
    own = marked.where("is_file").select(F.col("path").alias("file_path"), "repos")
    dirs = marked.where("NOT is_file")
    depths = sorted(r[0] for r in dirs.select("depth").distinct().collect())  # as many as levels
    if not depths:
        return own.groupBy("file_path").agg(F.max("repos").alias("repos"))
    wanted = F.array(*map(F.lit, depths))
    paths = nodes.where("is_file").select("path", salt).distinct()
    ups = paths.select(F.col("path").alias("file_path"), "salt", F.explode(F.filter(wanted, lambda k: k < F.size(F.split("path", "/")))).alias("depth"))
    ups = ups.select("file_path", "salt", F.concat_ws("/", F.slice(F.split("file_path", "/"), F.lit(1), F.col("depth"))).alias("path"))
    through = ups.join(_salted(dirs.select("path", "repos")), ["path", "salt"]).select("file_path", "repos")
    return own.unionByName(through).groupBy("file_path").agg(F.max("repos").alias("repos"))


def not_hand_written(files: DataFrame) -> DataFrame:
    """(file_path, kinds): every file that nobody wrote by hand, with the reasons."""
    reasons = content_kinds(files).unionByName(vendored(files).select("file_path", F.lit("vendored").alias("kind"))).distinct()
    return reasons.groupBy("file_path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))  # five kinds at most
