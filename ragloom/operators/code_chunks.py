"""Syntax-aware chunks of C and C++ files, and the leftovers between them.

A scanner over tokens finds functions, classes, structs and enums with a body at file, namespace or
linkage level (members stay inside their class), in one pass over each file, with its own small
grammar of heads; the parser is a parameter. Files that do not parse give what whole units they have.
Lines are 1-based lines of the collapsed file, inclusive.

Known gap: macros that change the grammar, old-style parameter declarations and elaborated types
without a body are not recognised as a full grammar would.

Defined cases: null paths or texts give no chunk; empty files give none; a text of any length is one
row's work; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ragloom.functions import clex
from ragloom.functions.text import LICENSE_WORDS

SCHEMA = """id string, text string, file_path string, start_line int, end_line int, node_type string, name string,
parameter_count int, parameters string, long_name string"""
_SEPARATOR = re.compile(r"^//\s*[-=*#~_]{3,}$")
_YEAR = re.compile(r"copyright\s*(?:\(c\)|©)?\s*\d{4}")
_AGGREGATES = frozenset(("class", "struct", "union", "enum"))


def short_hash(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()[:8]


def read_lines(text: str) -> list[str]:
    """Lines with their newline; runs of empty lines are one, trailing ones are gone, the last has no newline."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    plain = re.sub("\n{3,}", "\n\n", re.sub("^\n{2,}", "\n", plain)).rstrip("\n")
    return plain.splitlines(keepends=True) if "\n" not in plain or not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", plain) else re.findall("[^\n]*\n|[^\n]+", plain)


class Unit:
    """A code unit: kind, name, parameter names, first and last token."""

    __slots__ = ("first", "kind", "last", "name", "parameters")

    def __init__(self, kind: str, name: str, parameters: list[str], first: int, last: int):
        self.kind, self.name, self.parameters, self.first, self.last = kind, name, parameters, first, last


def _qualified(words: list[str], kinds: list[str], at: int) -> tuple[int, str]:
    """(first token, spelling) of the qualified name that ends at a token."""
    k = at
    if k and kinds[k - 1] == "~":
        k -= 1
    while k >= 2 and kinds[k - 1] == "::" and kinds[k - 2] in ("i", ">"):
        k -= 2
        if kinds[k] == ">":
            depth = 1
            while k and depth:
                k -= 1
                depth += (kinds[k] == ">") - (kinds[k] == "<")
            k -= 1
    if k and kinds[k - 1] == "::":
        k -= 1
    return k, "".join(words[k : at + 1])


def _parameters(words: list[str], kinds: list[str], a: int, b: int) -> list[str]:
    """Names of the declared parameters between two brackets; unnamed, defaulted and variadic ones don't count."""
    out, depth, start = [], 0, a
    for k in range(a, b + 1):
        x = kinds[k] if k < b else ","
        if k < b and x in ("(", "[", "{", "<"):
            depth += 1
        elif k < b and x in (")", "]", "}", ">"):
            depth -= 1
        elif x == "," and depth == 0:
            part = range(start, k)
            if len(part) > 1 and not any(kinds[j] in ("=", "...") for j in part):
                pointer = next((j + 1 for j in part if kinds[j] == "(" and kinds[j + 1] in ("*", "&")), None)
                if pointer is not None:
                    names = [j for j in range(pointer, k) if kinds[j] == "i"][:1]
                else:
                    tail = k - 1
                    while tail > start and kinds[tail] == "]":
                        while tail > start and kinds[tail] != "[":
                            tail -= 1
                        tail -= 1
                    names = [tail] if kinds[tail] == "i" and tail > start and kinds[tail - 1] != "::" and kinds[tail - 1] not in _AGGREGATES and not all(kinds[j] in ("const", "volatile") for j in range(start, tail)) else []
                out += [words[j] for j in names]
            start = k + 1
    return out


def scan(text: str, language: str = "cpp") -> tuple[list[Unit], list[tuple[int, int]]]:
    """(units in order, token places) of a text."""
    if "\\\n" in text:
        text = text.replace("\\\n", "  ")
    places = clex.places(text, language)
    words = [text[a:b] for a, b in places]
    kinds = list(map(clex.CLASSES[language].__getitem__, words))
    live = [k for k, x in enumerate(kinds) if x != "#"]
    words, kinds = [words[k] for k in live], [kinds[k] for k in live]
    n, out, p, start = len(kinds), [], 0, 0
    depth_at: list[int] = []
    while p < n:
        x = kinds[p]
        if x in (";", "}"):
            start = p + 1
        elif x == "{":
            head = kinds[start:p]
            bare = start
            while head[:1] == ["template"]:
                k, level = bare + 1, 0
                while k < p:
                    level += (kinds[k] == "<") - (kinds[k] == ">")
                    k += 1
                    if level == 0:
                        break
                bare, head = k, kinds[k:p]
            if head[:1] == ["namespace"] or head[:2] == ["inline", "namespace"] or head[:2] == ["extern", "s"] and len(head) == 2:
                depth_at.append(p)
                start = p = p + 1
                continue
            end, level = p + 1, 1
            while end < n and level:
                level += (kinds[end] == "{") - (kinds[end] == "}")
                end += 1
            if level:
                start = p = p + 1
                continue
            open_ = next((k for k in range(bare, p) if kinds[k] == "(" and k > bare and kinds[k - 1] == "i" and "=" not in kinds[bare:k]), None)
            kind = next((w for w in head if w in _AGGREGATES), None)
            if open_ is not None and (kind is None or kinds[bare] not in ("enum", "class", "union") and not (kinds[bare] == "struct" and kinds[p - 1] == "i" and open_ > p)):
                level, close = 0, open_
                while close < p:
                    level += (kinds[close] == "(") - (kinds[close] == ")")
                    if level == 0:
                        break
                    close += 1
                _, name = _qualified(words, kinds, open_ - 1)
                out.append(Unit("function", name, _parameters(words, kinds, open_ + 1, close), live[bare], live[end - 1]))
                start = end
            elif kind in ("class", "struct", "enum") and "=" not in head:
                at = bare + head.index(kind)
                ids = [k for k in range(at + 1, p) if kinds[k] == "i"]
                stop = next((k for k in range(at, p) if kinds[k] == ":"), p)
                ids = [k for k in ids if k < stop]
                final = len(ids) > 1 and words[ids[-1]] == "final"
                name = _qualified(words, kinds, ids[-2] if final else ids[-1])[1] if ids else "anonymous"
                out.append(Unit(kind, name, [], live[at], live[end - 1]))
                start = p = end
                continue
            else:
                start = p if "=" in head else end
            p = end
            continue
        p += 1
    return out, places


def leading_comment(lines: list[str], at: int, gap: int = 2) -> list[str]:
    """The comment lines above line index at: line comments and lines that open a block comment; separators are skipped."""
    out: list[str] = []
    blanks = 0
    k = at - 1
    while k >= 0:
        s = lines[k].strip()
        if s.startswith("//") or "/*" in s:
            if not _SEPARATOR.match(s):
                out.append(lines[k])
                blanks = 0
        elif not s:
            blanks += 1
            if blanks > gap:
                break
            out.append(lines[k])
        else:
            break
        k -= 1
    return out[::-1]


def is_license(text: str) -> bool:
    low = text.lower()
    return sum(w in low for w in LICENSE_WORDS) >= 2 or bool(_YEAR.search(low))


def without_licenses(lines: list[str]) -> list[str]:
    """Lines without licence comments, and without separators before the first content."""
    out, k, content = [], 0, False
    while k < len(lines):
        s = lines[k].strip()
        if s.startswith("/*"):
            end = k
            while end < len(lines) - 1 and "*/" not in lines[end]:
                end += 1
            block = lines[k : end + 1]
            if not is_license("".join(block)):
                out += block
                content = True
            k = end + 1
        elif s.startswith("//"):
            end = k
            while end + 1 < len(lines) and (lines[end + 1].strip().startswith("//") or not lines[end + 1].strip()):
                end += 1
            block = lines[k : end + 1]
            if not is_license("".join(block)):
                for line in block:
                    t = line.strip()
                    if content or not _SEPARATOR.match(t):
                        out.append(line)
                    content = content or bool(t) and not _SEPARATOR.match(t)
            k = end + 1
        else:
            out.append(lines[k])
            content = content or bool(s)
            k += 1
    return out


def chunks_of(path: str, text: str, parse: Callable = scan, doubled: bool = True) -> list[tuple]:
    """The rows of SCHEMA of one file: units in order, then leftovers."""
    lines = read_lines(text)
    if not lines:
        return []
    base = path.rsplit("/", 1)[-1]
    joined = "".join(lines)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    units, places = parse(joined, "c" if path.lower().endswith(".c") else "cpp")
    line_of = lambda offset: max(0, joined.count("\n", 0, offset))
    rows, covered = [], set()
    for u in units:
        a, b = line_of(places[u.first][0]), line_of(places[u.last][1] - 1)
        body = "".join(leading_comment(lines, a) + lines[a : b + 1])
        function = u.kind == "function"
        rows.append(
            (
                f"{base}:{a + 1}-{b + 1}-{short_hash(body)}", body, path, a + 1, b + 1, u.kind, u.name,
                len(u.parameters) if function else None, ",".join(u.parameters) if function else None,
                f"{u.name}({', '.join(u.parameters)})" if function else None,
            )
        )
        covered.update(range(a, b + 1))
    k = 0
    while k < len(lines):
        if k in covered:
            k += 1
            continue
        end = k
        while end < len(lines) and end not in covered:
            end += 1
        kept = [x for x in without_licenses(lines[k:end]) if not (x.strip().startswith("//") and "----" in x)]
        rest = ("\n" if doubled else "").join(kept)
        if rest.strip():
            rows.append((f"{base}:{k + 1}-{end}-{short_hash(rest)}", rest, path, k + 1, end, "leftover_block", None, None, None, None))
        k = end
    return rows


def chunk_code(files: DataFrame, path: str = "file_path", text: str = "text", parse: Callable = scan, doubled: bool = True) -> DataFrame:
    """All chunks of all files; doubled keeps the doubled newlines of leftovers, on which their ids depend."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in chunks_of(p, t, parse, doubled)]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return files.where(f"`{path}` IS NOT NULL AND `{text}` IS NOT NULL").select(path, text).mapInArrow(run, SCHEMA)
