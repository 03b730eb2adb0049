"""Functions paired with the comment that documents them.

Heads of functions are recognised by a generalised LL parser over a graph-structured stack, so that
the ambiguous head grammar needs no look-ahead; a head that no derivation fits is passed over and
the scan goes on behind the next ; or }, so that broken files yield their whole functions. Verdicts
are remembered by the shape of a head.

A description stands directly above its function: no blank line lies between, while template,
preprocessor and separator lines don't count. It may lie in the chunk itself, or at the end of the
leftover block whose last line is just before the chunk's first; both are joined on file and line.
Descriptions need a sentence of WORDS words or more: tags without text, the bare name, markers,
banners, tool directives and commented-out code are none.

Templates: a description whose text, with the function's own name and numbers left out, documents at
least the share TEMPLATE_SHARE of the corpus's function names (and TEMPLATE_NAMES of them) is
boilerplate; exact hash counts mark it (column repeats) and pairs() can drop it. A unit copied with
its function under one name is none.

Valid bodies: with their code, pairs say whether the function parses as a whole (column valid), so
that whole functions can be taken out of broken files.

Defined cases: null file_path or text gives no pair; a null line joins no leftover block; chunks
stored twice give one pair (the longest code); empty and very long texts are handled as any other;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import clex
from ragloom.llm import syntax
from ragloom.runtime import cut

WORDS = 5
TEMPLATE_SHARE, TEMPLATE_NAMES = 0.01, 5
MEMO = 100_000

_TYPE_WORDS = sorted(syntax._TYPES | syntax._MODIFIERS)
_ANY = "any"  # a terminal that is neither bracket nor brace nor end
#: The grammar of a head up to its parameters, and of what follows them.
GRAMMAR: dict[str, list[list[str]]] = {
    "before": [["template", "<", "angles", ">", "before"], ["specs", "declarator"], ["declarator"]],
    "angles": [[], ["within", "angles"], ["<", "angles", ">", "angles"], ["(", "balanced", ")", "angles"]],
    "within": [[_ANY]],
    "specs": [["spec"], ["spec", "specs"]],
    "spec": [[w] for w in _TYPE_WORDS] + [["qualified"], ["struct", "qualified"], ["class", "qualified"], ["union", "qualified"], ["enum", "qualified"], ["typename", "qualified"], ["pointer"], ["extern", "s"], ["[", "[", "balanced", "]", "]"]],
    "pointer": [["*"], ["&"], ["&&"]],
    "qualified": [["part"], ["part", "::", "qualified"], ["::", "qualified"]],
    "part": [["i"], ["i", "<", "angles", ">"]],
    "declarator": [["qualified"], ["qualified", "::", "~", "i"], ["~", "i"], ["operators"], ["qualified", "::", "operators"]],
    "operators": [["operator", "any"], ["operator", "any", "any"], ["operator", "[", "]"], ["operator", "(", ")"], ["operator", "qualified"]],
    "after": [["(", "balanced", ")", "tail"]],
    "balanced": [[], [_ANY, "balanced"], ["(", "balanced", ")", "balanced"], ["[", "balanced", "]", "balanced"], ["<", "balanced"], [">", "balanced"], ["{", "balanced", "}", "balanced"]],
    "tail": [[], ["const", "tail"], ["volatile", "tail"], ["noexcept", "tail"], ["noexcept", "(", "balanced", ")", "tail"], ["throw", "(", "balanced", ")", "tail"], ["i", "tail"], ["&", "tail"], ["&&", "tail"], ["try", "tail"], ["->", "specs"], [":", "starts"]],
    "starts": [["start"], ["start", ",", "starts"]],
    "start": [["qualified", "(", "balanced", ")"], ["qualified", "{", "balanced", "}"]],
}
_NOT_ANY = frozenset("( ) [ ] { } < > ;".split())


def recognise(start: str, tokens: tuple[str, ...]) -> bool:
    """Generalised LL: all descriptors (grammar place, stack node, input place) are worked off once."""
    end = len(tokens)
    root = ("", 0)
    edges: dict[tuple, set] = {root: set()}  # stack node -> (return place, parent)
    popped: dict[tuple, set] = {}
    todo: list[tuple] = []
    seen: set[tuple] = set()

    def add(place, node, i):
        d = (place, node, i)
        if d not in seen:
            seen.add(d)
            todo.append(d)

    def call(name, back, parent, i):
        node = (name, i)
        if node not in edges:
            edges[node] = set()
            for k in range(len(GRAMMAR[name])):
                add((name, k, 0), node, i)
        if (back, parent) not in edges[node]:
            edges[node].add((back, parent))
            for j in popped.get(node, ()):
                add(back, parent, j)

    done = ("", -1, 0)
    call(start, done, root, 0)
    while todo:
        place, node, i = todo.pop()
        if place == done:
            if i == end:
                return True
            continue
        name, k, dot = place
        body = GRAMMAR[name][k]
        if dot == len(body):
            if i not in popped.setdefault(node, set()):
                popped[node].add(i)
                for back, parent in edges[node]:
                    add(back, parent, i)
            continue
        symbol, behind = body[dot], (name, k, dot + 1)
        if symbol in GRAMMAR:
            call(symbol, behind, node, i)
        elif i < end and (tokens[i] == symbol or symbol == _ANY and tokens[i] not in _NOT_ANY):
            add(behind, node, i + 1)
    return False


_HEADS: dict[tuple, int] = {}
_CLASS = frozenset(("class", "struct", "union"))
_STATEMENT = frozenset("if for while switch do return else case default enum namespace = goto".split())
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def folded(tokens: tuple[str, ...]) -> tuple[list[str], list[int]] | None:
    """Tokens with what brackets hold made one, and their places; None if brackets don't match.

    The brackets' content is regular for the head grammar, so heads of any length stay short.
    """
    out, at, open_ = [], [], []
    for j, t in enumerate(tokens):
        if t in _CLOSER:
            if not open_:
                out.append(t)
                at.append(j)
            open_.append(_CLOSER[t])
        elif open_ and t == open_[-1]:
            open_.pop()
            if not open_:
                if at[-1] < j - 1:
                    out.append(_ANY)
                    at.append(at[-1] + 1)
                out.append(t)
                at.append(j)
        elif t in (")", "]", "}"):
            return None
        elif not open_:
            out.append(t)
            at.append(j)
    return None if open_ else (out, at)


def head_name(tokens: tuple[str, ...]) -> int:
    """Index of the ( of the parameters if the tokens are the head of a function, else -1."""
    known = _HEADS.get(tokens)
    if known is not None:
        return known
    if len(_HEADS) > MEMO:
        _HEADS.clear()
    at = -1
    short = folded(tokens) if tokens and tokens[0] not in _STATEMENT else None
    if short is not None:
        fold, places = short
        groups = angles = 0
        for j, t in enumerate(fold):
            if t == "(":
                # before the parameters, brackets stand within template arguments or attributes only
                if groups <= angles and j and (fold[j - 1] == "i" or "operator" in fold[max(0, j - 3) : j]) and recognise("before", tuple(fold[:j])) and recognise("after", tuple(fold[j:])):
                    at = places[j]
                    break
                groups += fold[j - 1] != "operator" if j else 1
            angles += t == "<"
    _HEADS[tokens] = at
    return at


def functions(text: str) -> list[tuple[str, int, int, int]]:
    """(unqualified name, start of the item, start of the head, end of the body) of whole functions."""
    if "\\\n" in text:
        text = text.replace("\\\n", "  ")  # splices, places kept
    spans = clex.places(text, "cpp")
    spelled = [text[a:b] for a, b in spans]
    kinds = list(map(clex.CLASSES["cpp"].__getitem__, spelled))
    if "#" in kinds:
        keep, _ = syntax.branches(spelled, "cpp", False)
        spans, spelled, kinds = [spans[k] for k in keep], [spelled[k] for k in keep], [kinds[k] for k in keep]
    n = len(kinds)
    out = []
    p = start = 0
    while p < n:
        k = kinds[p]
        if k == ";" or k == "}":
            start = p + 1
        elif k == ":" and p and kinds[p - 1] in ("public", "private", "protected"):
            start = p + 1
        elif k == "{":
            head = tuple(kinds[start:p])
            at = head_name(head)
            if at < 0 and (head[:1] == ("namespace",) or head[:2] == ("extern", "s") or any(t in _CLASS for t in head) and "(" not in head and "=" not in head and "enum" not in head):
                start = p + 1
                p += 1
                continue
            depth, q = 1, p + 1
            while q < n and depth:
                depth += (kinds[q] == "{") - (kinds[q] == "}")
                q += 1
            if depth:  # the body has no end: it is no whole function, but others may follow
                p += 1
                start = p
                continue
            if at >= 0:
                name = start + at - 1
                word = spelled[name]
                if kinds[name] != "i":
                    word = "operator" + "".join(spelled[name - (2 if spelled[name - 1] != "operator" else 0) + 1 : name + 1]) if name else word
                elif name and kinds[name - 1] == "~":
                    word = "~" + word
                out.append((word, spans[start][0], spans[start][0], spans[q - 1][1]))
                start = q
            elif head and ("=" in head or head[0] in ("enum", "typedef") or any(t in _CLASS for t in head)):
                p = q  # an initialiser or a type: its declarators follow
                continue
            else:
                start = q
            p = q
            continue
        p += 1
    return out


_SEPARATOR = re.compile(r"^(?://+|/\*+)?[\s/*]*[-=*#~_+]{3,}(?:[^-=*#~_+]*[-=*#~_+]{3,})?[\s/*]*$")
_BANNER = re.compile(r"[-=*#~_+]{3,}")


def above(lines: list[str]) -> str | None:
    """The comment that ends just above, given the lines above a function; None if there is none."""
    k = len(lines) - 1
    inside = False  # a block comment spans the lines walked over
    while k >= 0:
        s = lines[k].strip()
        if not s:
            return None
        if s.startswith("#") or k and lines[k - 1].rstrip().endswith("\\") or re.match(r"template\s*<", s) or s.startswith("//") and _SEPARATOR.match(s):
            k -= 1
            continue
        break
    got: list[str] = []
    while k >= 0:
        s = lines[k].strip()
        if inside:
            got.append(s)
            if s.startswith("/*"):
                inside = False
            elif "/*" in s:
                return clean(got)  # code stands before the comment
        elif s.startswith("//"):
            if not _SEPARATOR.match(s):
                got.append(s)
        elif s.endswith("*/"):
            got.append(s)
            if not s.startswith("/*"):
                if "/*" in s:
                    got.pop()
                    break
                inside = True
        else:
            break
        k -= 1
    if inside:  # its beginning is not in this text
        return clean(got)
    return clean(got) if got else None


_LEAD = re.compile(r"^(?://[/!]*<?|/\*[*!]*<?|\*+(?!/))\s?")
_MARK = re.compile(r"^[\W_]*(?:todo|fixme|xxx|hack|bug|note to self|ctor|dtor|field \d+)\b", re.I)
_TOOL = re.compile(r"^\W*(?:nolint\w*|clang-format|cppcheck-\w+|iwyu|lint\b|coverity|lcov_\w+|gcov\w*|pragma|nosonar|vim?:|-\*-|doxygen|@?suppress\w*|eslint\S*|pylint\S*|fallthrough|@generated|region\b|endregion\b|sonar\S*|pvs\S*|pclint\S*|uncrustify\S*|astyle\S*|indent-?o\w*)", re.I)
_TAG = re.compile(r"[@\\](?:(?:t?param)(?:\s*\[[^\]]*\])?\s+[\w.]+|(?:brief|short|details?|returns?|result|note|remarks?|warning|retval\s+\S+|throws?\s+\S+|exception\s+\S+|see|sa|since|deprecated|todo|pre|post|ingroup\s+\S+|defgroup\s+\S+|author|date|version|file|fn|class|struct|p|c|a|b|e|ref|li|par|copydoc|internal))(?![a-z])", re.I)
_CODE = re.compile(r"[;{}]\s*$|^\s*[{}#]|\w\s*(?:->|::)\s*\w+\s*\(|[=!<>]=|^\s*(?:if|for|while|switch|return)\s*\(|\)\s*;")
_WORDS = re.compile(r"[^\W\d_][^\W_]*(?:[-'’_.][^\W_]+)*|[぀-ヿ㐀-鿿가-힯]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n\s*\n")


def clean(got: list[str]) -> str:
    """Lines of a comment, last first, as text."""
    out = []
    for s in reversed(got):
        s = s.strip()
        if s.endswith("*/"):
            s = s[:-2].rstrip("* \t") if not s.startswith("/*") or len(s) > 3 else ""
        s = _LEAD.sub("", s).strip()
        out.append(s)
    return "\n".join(out).strip()


def described(comment: str | None) -> str | None:
    """The describing text of a comment, None if it has no sentence of WORDS words."""
    if not comment:
        return None
    kept = []
    for line in comment.split("\n"):
        if _BANNER.search(line) or _TOOL.match(line) or _MARK.match(line) or _CODE.search(line):
            kept.append("")
            continue
        tagless = _TAG.sub("\n\n", line)
        kept.append(tagless.strip(" \t"))
    text = "\n".join(kept).strip()
    text = re.sub(r"\n{3,}", "\n\n", text)
    if any(len(_WORDS.findall(s)) >= WORDS for s in _SENTENCE.split(text)):
        return text
    return None


def tail_comment(text: str) -> str | None:
    """The comment that ends a leftover block, whose newlines are doubled."""
    lines = text.split("\n")
    if len(lines) > 1 and not any(lines[1::2]):
        lines = lines[0::2]  # each line was joined with one newline more
    else:
        lines = text.replace("\n\n", "\n").split("\n")
    if lines and lines[-1] == "" and text.endswith("\n"):
        lines = lines[:-1]
    return above([x.rstrip("\r") for x in lines])


_PARTS = "file_path string, line int, kind string, func_name string, code string, comment string, rest boolean"


def parts(chunks: DataFrame, with_code: bool = True) -> DataFrame:
    """Functions with the comment found in their chunk, and the comments that end leftover blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, node, start, end, text in zip(*(c.to_pylist() for c in batch.columns)):
                if node == "leftover_block":
                    if end is not None and "/" in text:
                        comment = tail_comment(text)
                        if comment:
                            rows.append((path, end + 1, "tail", None, None, comment, False))
                    continue
                text = text.replace("\r\n", "\n")
                first_seen = False
                for name, item, _, stop in functions(text):
                    lines = text[:item].split("\n")[:-1]
                    comment = above(lines)
                    # nothing but lines that don't count stands above the first item: the block before may end in its comment
                    open_ = not first_seen and comment is None and node == "function" and all(x.strip() == "" or x.strip().startswith(("#", "template")) or _SEPARATOR.match(x.strip()) for x in lines) and not (lines and lines[-1].strip() == "")
                    first_seen = True
                    rows.append((path, start, "function", name, text[item:stop] if with_code else None, comment, open_))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_()))],
                names=["file_path", "line", "kind", "func_name", "code", "comment", "rest"],
            )

    rows = chunks.where("file_path IS NOT NULL AND text IS NOT NULL AND node_type IN ('function', 'class', 'struct', 'leftover_block')")
    return rows.select("file_path", "node_type", F.col("start_line").cast("int"), F.col("end_line").cast("int"), "text").mapInArrow(run, _PARTS)


def pairs(chunks: DataFrame, with_code: bool = True, drop_templates: bool = True) -> DataFrame:
    """(file_path, func_name, code, description, repeats; valid, if the code is asked for) of documented functions."""
    describe = F.pandas_udf(lambda s: s.map(described), "string")
    found = cut(parts(chunks, with_code))
    own = found.where("kind = 'function'")
    tails = found.where("kind = 'tail'").groupBy("file_path", "line").agg(F.max("comment").alias("tail"))
    joined = own.join(tails, ["file_path", "line"], "left")
    text = F.coalesce("comment", F.when(F.col("rest"), F.col("tail")))
    documented = joined.withColumn("description", describe(text)).where("description IS NOT NULL")
    one = documented.groupBy("file_path", "func_name").agg(F.max(F.struct(F.length("code").alias("n"), "code", "description")).alias("x")).select("file_path", "func_name", "x.code", "x.description")
    bare = F.regexp_replace(F.expr("replace(lower(description), lower(func_name), '')"), r"(?U)[\d\W_]+", " ")
    keyed = one.withColumn("h", F.xxhash64(bare))
    names = keyed.groupBy("h", "func_name").agg(F.count("*").alias("n"))  # exact, and a hot template is spread over its names
    counts = names.groupBy("h").agg(F.count("*").alias("names"), F.sum("n").alias("repeats"))
    total = names.agg(F.count_distinct("func_name").alias("total")).withColumn("one", F.lit(1))  # one row
    common = counts.where(F.col("names") >= TEMPLATE_NAMES).withColumn("one", F.lit(1)).join(F.broadcast(total), "one").where(F.col("names") >= TEMPLATE_SHARE * F.col("total")).select("h", "repeats")
    out = keyed.join(common, "h", "left")
    if drop_templates:
        out = out.where("repeats IS NULL")
    if with_code:
        parses = F.pandas_udf(lambda s: s.map(lambda code: not syntax.check(code, "cpp")), "boolean")
        out = out.withColumn("valid", parses("code"))
    return out.select("file_path", "func_name", "code", "description", F.coalesce("repeats", F.lit(1)).alias("repeats"), *(["valid"] if with_code else []))
