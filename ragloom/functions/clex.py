"""Tokens of C and C++ texts, as the grammar needs them.

Line splices are joined first. Comments and white space are skipped; a directive is one token;
names become "i", numbers "0", strings "s", characters "c", what no token begins with "?"; keywords
and punctuation stay themselves. Unclosed comments, strings and characters become "?" as well.
"""

from __future__ import annotations

import re

# The keywords of the two languages.
_BOTH = """auto break case char const continue default do double else enum extern float for goto if inline int long
register return short signed sizeof static struct switch typedef union unsigned void volatile while"""
C_KEYWORDS = frozenset((_BOTH + " restrict _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local").split())
CPP_KEYWORDS = frozenset(
    (
        _BOTH
        + """ alignas alignof asm bool catch char8_t char16_t char32_t class concept consteval constexpr constinit const_cast
    co_await co_return co_yield decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept
    nullptr operator private protected public reinterpret_cast requires static_assert static_cast template this
    thread_local throw true try typeid typename using virtual wchar_t"""
    ).split()
)
_STRING = r'"(?:[^"\\\n]|\\.)*"'
_CHAR = r"'(?:[^'\\\n]|\\.)+'"
_NUMBER = r"\.?\d(?:[eEpP][+-]|'[0-9A-Za-z]|[\w.])*"
_PUNCT = r"<<=|>>=|<=>|\.\.\.|->\*|::|->|\+\+|--|&&|\|\||<<|[-+*/%&|^<>=!]=|[-+*/%&|^<>=!~?:;,.(){}\[\]]"
_DIRECTIVE = r"\#(?:[^\n/]|/(?![/*])|/\*[\s\S]*?\*/|//[^\n]*)*"
_SKIP = r"(?:\s+|//[^\n]*|/\*[\s\S]*?\*/)*"
_CPP = r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\([\s\S]*?\)\2"|'


def _pattern(raw: str) -> re.Pattern:
    group = raw.replace(r"\2", r"\2")
    name = r"(?:u8|[uUL])?" + _STRING + r"|[uUL]?" + _CHAR + r"|[A-Za-z_$][\w$]*"
    return re.compile(_SKIP + "(" + group + name + "|" + _NUMBER + "|/[*]|" + _PUNCT + "|" + _DIRECTIVE + r"|\S|$)")


PATTERN = {"c": _pattern(""), "cpp": _pattern(_CPP)}
_PUNCTS = frozenset("<<= >>= <=> ... ->* :: -> ++ -- && || << -= += *= /= %= &= |= ^= <= >= == != - + * / % & | ^ < > = ! ~ ? : ; , . ( ) { } [ ]".split())
_SPLICE = re.compile(r"\\\r?\n")
#: Spellings a process remembers the class of; on reaching it the memory starts anew.
MEMO = 300_000


class Classes(dict):
    """spelling -> class."""

    def __init__(self, keywords: frozenset[str]):
        super().__init__()
        self.keywords = keywords

    def __missing__(self, t: str) -> str:
        if len(self) > MEMO:
            self.clear()
        first = t[:1]
        if t in _PUNCTS:
            kind = t
        elif first == "#":
            return "#"
        elif first.isdigit() or first == "." and t[1:2].isdigit():
            kind = "0"
        elif t[-1:] == '"' and len(t) > 1:
            kind = "s"
        elif t[-1:] == "'" and len(t) > 2:
            kind = "c"
        elif first.isalpha() or first in "_$":
            kind = t if t in self.keywords else "i"
        else:
            kind = "?"
        self[t] = kind
        return kind


CLASSES = {"c": Classes(C_KEYWORDS), "cpp": Classes(CPP_KEYWORDS)}


def splice(text: str) -> str:
    return _SPLICE.sub(" ", text) if "\\\n" in text or "\\\r" in text else text


def spellings(text: str, language: str) -> list[str]:
    """The tokens of a spliced text as spelled."""
    found = PATTERN[language].findall(text)
    if language == "cpp":
        found = [f[0] for f in found]
    while found and not found[-1]:
        found.pop()
    return found


def places(text: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of the same tokens."""
    out = [m.span(1) for m in PATTERN[language].finditer(text)]
    while out and out[-1][0] == out[-1][1]:
        out.pop()
    return out
