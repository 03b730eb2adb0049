"""Syntax check of C and C++ files: recursive descent over statements, precedence climbing over
expressions, panic-mode recovery.

The parser works on token classes (names, numbers and strings are one class each), so statements of
the same shape have the same key; their verdicts are remembered, and only the first of each shape is
parsed. Unknown names, types and missing includes don't matter. Of a preprocessor conditional one
whole branch is enough: the first branches are tried, then the last ones. After an error the parser
skips to the end of the statement and goes on, so that all errors of a file are found.

Defined cases: null text is no file and gets no verdict; an empty or blank text is valid; null
language is cpp, as for all extensions but .c; repeated rows of a path are one case, invalid if any
of its texts is invalid; a null path is dropped; a null repo is a repo of its own in the rates.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions import clex

#: Statement shapes a worker remembers; on reaching it the memory starts anew.
MEMO = 200_000
#: Python's limit of nested calls while a text is parsed; its frames lie on the heap, so that depth is bounded by memory.
NESTED_CALLS = 100_000_000

_TYPES = frozenset("char double float int long short signed unsigned void bool wchar_t char8_t char16_t char32_t _Bool _Complex auto".split())
_MODIFIERS = frozenset(
    """const volatile static extern inline register typedef virtual explicit friend mutable constexpr consteval constinit
    thread_local restrict _Atomic _Noreturn _Thread_local""".split()
)
_BINARY = {
    "||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<=>": 7, "<<": 8, ">>": 8, "+": 9, "-": 9,
    "*": 10, "/": 10, "%": 10, "->*": 11,
}
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_UNARY = frozenset("+ - ! ~ * & ++ -- &&".split())
_CASTS = frozenset("static_cast dynamic_cast reinterpret_cast const_cast".split())
_DIRECTIVES = frozenset("define undef include include_next import if ifdef ifndef elif elifdef elifndef else endif error warning pragma line ident embed".split())
_CONDITIONS = re.compile(r"#\s*(if|ifdef|ifndef|elif|elifdef|elifndef|else|endif)\b")
_NAME = re.compile(r"#\s*([a-z_]*)")


class Wrong(Exception):
    def __init__(self, at: int, why: str):
        self.at, self.why = at, why


class Parser:
    """One pass over a list of token classes. memo is shared by all files of a language."""

    def __init__(self, t: list[str], language: str, memo: dict):
        self.n = len(t)
        self.t = t + ["", "", ""]
        self.cpp = language == "cpp"
        self.memo = memo
        self.errors: list[tuple[int, str]] = []
        stops = [k for k, x in enumerate(t) if x == ";" or x == "{" or x == "}"]
        self.next = nxt = [self.n] * (self.n + 2)
        a = 0
        for k in stops:
            nxt[a : k + 1] = [k] * (k + 1 - a)
            a = k + 1

    # -- helpers

    def need(self, p: int, what: str) -> int:
        if self.t[p] != what:
            raise Wrong(p, f"expected {what}, found {self.t[p] or 'end of file'}")
        return p + 1

    def trial(self, f, p: int, *args):
        kept = len(self.errors)
        try:
            return f(p, *args)
        except Wrong:
            del self.errors[kept:]
            return None

    # -- expressions

    def expression(self, p: int, comma: bool = True, angle: bool = True) -> int:
        p = self.assignment(p, angle)
        while comma and self.t[p] == ",":
            p = self.assignment(p + 1, angle)
        return p

    def assignment(self, p: int, angle: bool = True) -> int:
        t = self.t
        if t[p] == "throw" and self.cpp:
            return p + 1 if t[p + 1] in (";", ")", ",", ":") else self.assignment(p + 1, angle)
        if t[p] == "{":
            return self.braces(p)
        p = self.binary(p, 0, angle)
        if t[p] == "?":
            p = p + 1 if t[p + 1] == ":" else self.expression(p + 1)
            return self.assignment(self.need(p, ":"), angle)
        if t[p] in _ASSIGN:
            return self.assignment(p + 1, angle)
        return p

    def binary(self, p: int, least: int, angle: bool) -> int:
        p = self.unary(p)
        t = self.t
        while True:
            op, width = t[p], 1
            if op == ">":
                if not angle:
                    return p
                if t[p + 1] == ">":
                    op, width = ">>", 2
                elif t[p + 1] == ">=":
                    return self.assignment(p + 2, angle)
            level = _BINARY.get(op)
            if level is None or level <= least:
                return p
            p = p + 2 if self.cpp and t[p + 1] == "..." else self.binary(p + width, level, angle)  # a fold

    def unary(self, p: int) -> int:
        t = self.t
        x = t[p]
        if x in _UNARY:
            return self.unary(p + 1)
        if x == "sizeof" or x in ("alignof", "_Alignof"):
            if t[p + 1] == "...":
                p += 1
            if t[p + 1] == "(":
                q = self.trial(self.type_name, p + 2)
                if q is not None and t[q] == ")":
                    return self.postfix(q + 1)
            return self.unary(p + 1)
        if x == "(":
            q = self.trial(self.type_name, p + 1)
            if q is not None and t[q] == ")":
                after = t[q + 1]
                if after == "{":
                    return self.postfix(self.braces(q + 1))
                if after in ("i", "0", "s", "c", "(", "!", "~", "sizeof", "this", "nullptr", "true", "false", "new", "::") or after in _CASTS or (after in _UNARY and t[q - 1] != "i"):
                    r = self.trial(self.unary, q + 1)
                    if r is not None:
                        return r
        if self.cpp:
            if x == "new" or x == "::" and t[p + 1] == "new":
                return self.new(p + (x == "::"))
            if x == "delete":
                p += 1
                if t[p] == "[":
                    p = self.need(p + 1, "]")
                return self.unary(p)
            if x in ("co_await", "co_yield"):
                return self.unary(p + 1)
            if x == "noexcept":
                return self.need(self.expression(self.need(p + 1, "(")), ")")
            if x == "requires":
                return self.postfix(self.requires_expression(p))
        return self.postfix(self.primary(p))

    def new(self, p: int) -> int:
        t = self.t
        p += 1
        if t[p] == "(":
            p = self.arguments(p)
        p = self.specifiers(p)
        while t[p] in ("*", "&", "const"):
            p += 1
        while t[p] == "[":
            p = self.need(self.expression(p + 1), "]")
        if t[p] == "(":
            return self.arguments(p)
        return self.braces(p) if t[p] == "{" else p

    def primary(self, p: int) -> int:
        t = self.t
        x = t[p]
        if x in ("0", "c"):
            return p + 1
        if x == "s":
            while t[p] == "s" or t[p] == "i" and (t[p + 1] == "s" or t[p - 1] == "s"):
                p += 1
            return p
        if x == "i" or x == "::" and self.cpp:
            if x == "i" and t[p + 1] == "s":
                return self.primary(p + 1)
            return self.name(p)
        if x == "(":
            if t[p + 1] == "{":
                return self.need(self.block(p + 1), ")")
            if self.cpp and t[p + 1] == "..." and t[p + 2] in _BINARY:
                return self.need(self.unary(p + 3), ")")
            return self.need(self.expression(p + 1), ")")
        if x == "_Generic":
            p = self.assignment(self.need(p + 1, "("))
            while t[p] == ",":
                p = p + 2 if t[p + 1] == "default" else self.type_name(p + 1)
                p = self.assignment(self.need(p, ":"))
            return self.need(p, ")")
        if self.cpp:
            if x in ("this", "nullptr", "true", "false"):
                return p + 1
            if x == "[":
                return self.lambda_(p)
            if x in _CASTS:
                p = self.need(self.type_name(self.need(p + 1, "<")), ">")
                return self.need(self.expression(self.need(p, "(")), ")")
            if x == "typeid":
                p = self.need(p + 1, "(")
                q = self.trial(self.type_name, p)
                return q + 1 if q is not None and t[q] == ")" else self.need(self.expression(p), ")")
            if x in _TYPES or x in ("typename", "decltype"):
                q = self.specifiers(p)
                if t[q] == "(":
                    return self.arguments(q)
                if t[q] == "{":
                    return self.braces(q)
            if x == "operator":
                return self.operator(p)
        raise Wrong(p, f"expected an expression, found {x or 'end of file'}")

    def name(self, p: int, is_type: bool = False) -> int:
        """A name, with scopes and template arguments in C++."""
        t = self.t
        if not self.cpp:
            if t[p] != "i":
                raise Wrong(p, f"expected a name, found {t[p] or 'end of file'}")
            return p + 1
        if t[p] == "::":
            p += 1
        while True:
            if t[p] == "template":
                p += 1
            if t[p] == "operator":
                return self.operator(p)
            if t[p] == "~":
                p += 1
            if t[p] != "i":
                raise Wrong(p, f"expected a name, found {t[p] or 'end of file'}")
            p += 1
            if t[p] == "<":
                q = self.trial(self.template_arguments, p)
                if q is not None and (is_type or t[q] not in ("i", "0", "s", "c")):
                    p = q
            if t[p] != "::":
                return p
            p += 1

    def template_arguments(self, p: int) -> int:
        t = self.t
        p = self.need(p, "<")
        if t[p] == ">":
            return p + 1
        while True:
            q = self.trial(self.type_name, p)
            if q is None or t[q] not in (",", ">", "..."):
                q = self.assignment(p, angle=False)
            if t[q] == "...":
                q += 1
            if t[q] == ",":
                p = q + 1
                continue
            return self.need(q, ">")

    def postfix(self, p: int) -> int:
        t = self.t
        while True:
            x = t[p]
            if x == "(":
                p = self.arguments(p)
            elif x == "[":
                p = self.need(self.expression(p + 1), "]")
            elif x == "." or x == "->":
                p += 1
                if self.cpp:
                    p = self.name(p)
                else:
                    p = self.need(p, "i")
            elif x == "++" or x == "--":
                p += 1
            elif x == "{" and self.cpp and t[p - 1] in ("i", ">"):
                q = self.trial(self.braces, p)
                if q is None or t[q] not in (";", ",", ")", ".", "}", "]", "(", "+", "-", "*", "/", "==", "!=", ":", "?"):
                    return p
                p = q
            else:
                return p

    def arguments(self, p: int) -> int:
        t = self.t
        p = self.need(p, "(")
        if t[p] == ")":
            return p + 1
        while True:
            if t[p] in _TYPES or t[p] in ("const", "struct", "enum", "union") or not self.cpp and t[p] in _MODIFIERS:
                q = self.trial(self.type_name, p)  # macros and va_arg take types
                p = q if q is not None and t[q] in (",", ")") else self.assignment(p)
            else:
                p = self.assignment(p)
            if t[p] == "...":
                p += 1
            if t[p] != ",":
                return self.need(p, ")")
            p += 1

    def braces(self, p: int) -> int:
        """An initialiser list."""
        t = self.t
        e = self.next[p + 1] if p + 1 < self.n else self.n
        if t[e] == "}":
            inner = t[p + 1 : e]
            if not inner:
                return e + 1
            if len(inner) > 6 and set(inner[0::2]) <= {"0", "s", "c", "i"} and (set(inner[1::2]) == {","}):
                return e + 1
        p = self.need(p, "{")
        while t[p] != "}":
            while t[p] == "." and t[p + 1] == "i" or t[p] == "[":
                p = p + 2 if t[p] == "." else self.need(self.expression(p + 1), "]")
                if t[p] == "=":
                    p += 1
                    break
            p = self.assignment(p)
            if t[p] == "...":
                p += 1
            if t[p] == ",":
                p += 1
            elif t[p] != "}":
                raise Wrong(p, f"expected , or }} in a list, found {t[p] or 'end of file'}")
        return p + 1

    def lambda_(self, p: int) -> int:
        t = self.t
        p += 1
        while t[p] != "]":
            if t[p] not in ("&", "=", "i", "this", "*", ",", "..."):
                raise Wrong(p, "not a lambda's captures")
            p += 1
            if t[p] == "=" and t[p - 1] == "i":
                p = self.assignment(p + 1)
        p += 1
        if t[p] == "<":
            p = self.template_parameters(p)
        if t[p] == "(":
            p = self.parameters(p)
        while t[p] in ("mutable", "constexpr", "noexcept", "static"):
            p += 1
        if t[p] == "->":
            p = self.type_name(p + 1)
        if t[p] == "requires":
            p = self.constraint(p + 1)
        return self.block(p)

    def operator(self, p: int) -> int:
        t = self.t
        p += 1
        if t[p] == "(" and t[p + 1] == ")" or t[p] == "[" and t[p + 1] == "]":
            return p + 2
        if t[p] in ("new", "delete"):
            return p + 3 if t[p + 1] == "[" else p + 1
        if t[p] == "s":
            return p + 2 if t[p + 1] == "i" else p + 1
        if t[p] in _BINARY or t[p] in _ASSIGN or t[p] in _UNARY or t[p] in (",", "->"):
            return p + 2 if t[p] == ">" and t[p + 1] in (">", ">=") else p + 1
        return self.type_name(p)

    # -- types and declarators

    def attributes(self, p: int) -> int:
        t = self.t
        while True:
            if t[p] == "[" and t[p + 1] == "[":
                depth, p = 2, p + 2
                while depth:
                    if not t[p]:
                        raise Wrong(p, "unclosed attribute")
                    depth += (t[p] == "[") - (t[p] == "]")
                    p += 1
            elif t[p] in ("alignas", "_Alignas"):
                q = self.trial(self.type_name, self.need(p + 1, "("))
                p = q + 1 if q is not None and t[q] == ")" else self.need(self.expression(p + 2), ")")
            else:
                return p

    def specifiers(self, p: int) -> int:
        """Modifiers and one type."""
        t, got = self.t, False
        while True:
            p = self.attributes(p)
            x = t[p]
            if x in _MODIFIERS and (self.cpp or x not in ("virtual", "explicit", "friend", "mutable")):
                p += 1
                if x == "explicit" and t[p] == "(":
                    p = self.need(self.expression(p + 1), ")")
            elif x in _TYPES and (not got or got == "word"):
                p, got = p + 1, "word"
            elif not got and x in ("struct", "class", "union", "enum"):
                p, got = self.aggregate(p), "type"
            elif not got and x == "typename":
                p += 1
            elif not got and x == "decltype":
                p, got = self.need(self.expression(self.need(p + 1, "(")), ")"), "type"
            elif not got and (x == "i" or x == "::" and self.cpp):
                p, got = self.name(p, True), "type"
            else:
                break
        if not got:
            raise Wrong(p, f"expected a type, found {t[p] or 'end of file'}")
        return p

    def aggregate(self, p: int) -> int:
        """struct, class, union or enum, with or without a body."""
        t, kind = self.t, self.t[p]
        p = self.attributes(p + 1)
        if kind == "enum" and self.cpp and t[p] in ("class", "struct"):
            p += 1
        named = False
        if t[p] == "i" or t[p] == "::" and self.cpp:
            p, named = self.name(p), True
            if self.cpp and t[p] == "i" and t[p + 1] in ("{", ":"):
                p += 1  # final, or a macro before the name
        if kind == "enum":
            if t[p] == ":" and self.cpp:
                p = self.specifiers(p + 1)
            if t[p] != "{":
                if not named:
                    raise Wrong(p, "enum without name or body")
                return p
            p += 1
            while t[p] != "}":
                p = self.attributes(self.need(p, "i"))
                if t[p] == "=":
                    p = self.assignment(p + 1)
                if t[p] == ",":
                    p += 1
                elif t[p] != "}":
                    raise Wrong(p, f"expected , or }} in an enum, found {t[p] or 'end of file'}")
            return p + 1
        if t[p] == ":" and self.cpp and named and t[self.next[p]] == "{":
            p += 1
            while True:
                while t[p] in ("public", "private", "protected", "virtual"):
                    p += 1
                p = self.name(p)
                if t[p] == "...":
                    p += 1
                if t[p] != ",":
                    break
                p += 1
        if t[p] != "{":
            if not named:
                raise Wrong(p, f"{kind} without name or body")
            return p
        return self.scope(p + 1, "class")

    def pointers(self, p: int) -> int:
        t = self.t
        while t[p] in ("*", "const", "volatile", "restrict") or self.cpp and t[p] in ("&", "&&"):
            p += 1
        if self.cpp and t[p] == "i" and t[p + 1] == "::" and t[p + 2] == "*":
            p += 3
        return p

    def type_name(self, p: int) -> int:
        p = self.specifiers(p)
        return self.abstract(p)

    def abstract(self, p: int) -> int:
        t = self.t
        p = self.pointers(p)
        if t[p] == "(" and t[p + 1] in ("*", "&", "&&"):
            p = self.need(self.abstract(p + 1), ")")
        while True:
            if t[p] == "[":
                p = p + 2 if t[p + 1] == "]" else self.need(self.expression(p + 1), "]")
            elif t[p] == "(" and (q := self.trial(self.parameters, p)) is not None:
                p = q
            else:
                return p

    def declarator(self, p: int, abstract: bool = False) -> tuple[int, bool]:
        """(place after it, whether it is a function's)."""
        t = self.t
        p = self.pointers(p)
        p = self.attributes(p)
        function = False
        if t[p] == "..." and self.cpp:
            p += 1
        if t[p] == "(" and (t[p + 1] in ("*", "&", "&&", "(") or t[p + 1] == "i" and t[p + 2] in (")", "::")):
            p, function = self.declarator(p + 1, abstract)
            p = self.need(p, ")")
        elif t[p] == "i" or self.cpp and t[p] in ("::", "operator", "~"):
            p = self.name(p)
        elif not abstract:
            raise Wrong(p, f"expected a name, found {t[p] or 'end of file'}")
        p = self.attributes(p)
        while True:
            if t[p] == "[":
                p = p + 2 if t[p + 1] == "]" else self.need(self.expression(p + (2 if t[p + 1] == "static" else 1)), "]")
            elif t[p] == "(":
                q = self.trial(self.parameters, p)
                if q is None:
                    return p, function
                p, function = q, True
                p = self.after_parameters(p)
            else:
                return p, function

    def after_parameters(self, p: int) -> int:
        t = self.t
        if not self.cpp:
            return p
        while t[p] in ("const", "volatile", "noexcept", "&", "&&", "throw") or t[p] == "i" and t[p + 1] in ("{", ";", "=", "i", "const", "override"):
            if t[p] in ("noexcept", "throw") and t[p + 1] == "(":
                p = p + 3 if t[p + 2] == ")" else self.need(self.expression(p + 2), ")")
            else:
                p += 1
        if t[p] == "->":
            p = self.type_name(p + 1)
        return self.constraint(p + 1) if t[p] == "requires" else p

    def constraint(self, p: int) -> int:
        """What follows a requires clause's keyword: primaries joined by && and ||."""
        t = self.t
        while True:
            if t[p] == "(":
                p = self.need(self.expression(p + 1), ")")
            elif t[p] == "requires":
                p = self.requires_expression(p)
            else:
                p = p + 1 if t[p] in ("true", "false") else self.name(p, is_type=True)
            if t[p] not in ("&&", "||"):
                return p
            p += 1

    def requires_expression(self, p: int) -> int:
        t = self.t
        p += 1
        if t[p] == "(":
            p = self.parameters(p)
        p = self.need(p, "{")
        while t[p] != "}":
            if t[p] == "{":
                p = self.need(self.expression(p + 1), "}")
                if t[p] == "noexcept":
                    p += 1
                if t[p] == "->":
                    p = self.name(p + 1, is_type=True)
            elif t[p] == "typename":
                p = self.name(p + 1, is_type=True)
            elif t[p] == "requires" and t[p + 1] != "{" and self.trial(self.requires_expression, p) is None:
                p = self.expression(p + 1)
            else:
                p = self.expression(p)
            p = self.need(p, ";")
        return p + 1

    def parameters(self, p: int) -> int:
        t = self.t
        p = self.need(p, "(")
        if t[p] == ")":
            return p + 1
        while True:
            if t[p] == "...":
                return self.need(p + 1, ")")
            p = self.specifiers(p)
            p, _ = self.declarator(p, abstract=True)
            if t[p] == "=" and self.cpp:
                p = self.assignment(p + 1)
            if t[p] != ",":
                return self.need(p, ")")
            p += 1

    def template_parameters(self, p: int) -> int:
        t = self.t
        p = self.need(p, "<")
        if t[p] == ">":
            return p + 1
        while True:
            if t[p] == "template":
                p = self.template_parameters(p + 1)
            if t[p] in ("typename", "class") and t[p + 1] in ("i", ",", ">", "=", "..."):
                p += 1
                if t[p] == "...":
                    p += 1
                if t[p] == "i":
                    p += 1
                if t[p] == "=":
                    p = self.type_name(p + 1)
            else:
                p = self.specifiers(p)
                p, _ = self.declarator(p, abstract=True)
                if t[p] == "=":
                    p = self.assignment(p + 1, angle=False)
            if t[p] != ",":
                return self.need(p, ">")
            p += 1

    # -- declarations and statements

    def declaration(self, p: int, where: str) -> int:
        t = self.t
        x = t[p]
        if where == "class" and self.cpp and (x == "~" or x == "explicit" or x == "operator" or x in ("i", "virtual", "inline", "constexpr", "friend")):
            q = self.trial(self.constructor, p)
            if q is not None:
                return self.function_rest(q)
        elif where == "file" and self.cpp and x in ("i", "inline", "constexpr", "::"):
            q = self.trial(self.constructor, p)
            if q is not None and t[q] in ("{", ":", "try", "="):
                return self.function_rest(q)
        p = self.specifiers(p)
        if t[p] == ";":
            return p + 1
        if self.cpp and t[p] in ("&", "&&", "[") and (t[p] == "[" or t[p + 1] == "["):  # structured binding
            p = p + 1 if t[p] == "[" else p + 2
            while t[p] == "i":
                p += 1
                if t[p] == ",":
                    p += 1
            p = self.need(p, "]")
            if t[p] == ":":
                return p
            return self.need(self.assignment(self.need(p, "=")), ";")
        first = True
        while True:
            if t[p] == ":" and where == "class":
                p, function = p, False
            else:
                p, function = self.declarator(p)
            if function and first and (t[p] in ("{", "try") or t[p] == ":" and self.cpp):
                if where == "block":
                    raise Wrong(p, "a function inside a function")
                return self.function_rest(p)
            if t[p] == ":" and where == "class":
                p = self.assignment(p + 1)
            if function and self.cpp and t[p] == "=" and t[p + 1] in ("0", "default", "delete"):
                p += 2
            elif t[p] == "=":
                p = self.assignment(p + 1)
            elif t[p] == "(" and not function:
                p = self.arguments(p)
            elif t[p] == "{" and not function and self.cpp:
                p = self.braces(p)
            if t[p] == ",":
                p, first = p + 1, False
                continue
            return self.need(p, ";")

    def constructor(self, p: int) -> int:
        """A declarator without a type: constructors, destructors, conversions."""
        t = self.t
        while t[p] in ("explicit", "virtual", "inline", "constexpr", "friend"):
            p += 1
        conversion = t[p] == "operator"
        q = self.name(p)
        if not conversion and t[q - 1] != "i" and t[q - 1] != ">" or t[q] != "(":
            raise Wrong(q, "not a constructor")
        return self.after_parameters(self.parameters(q))

    def function_rest(self, p: int) -> int:
        t = self.t
        if t[p] == "try":
            p += 1
        if t[p] == "=":
            if t[p + 1] not in ("0", "default", "delete"):
                raise Wrong(p + 1, "expected default or delete")
            return self.need(p + 2, ";")
        if t[p] == ":":
            while True:
                p = self.name(p + 1)
                p = self.braces(p) if t[p] == "{" else self.arguments(p)
                if t[p] != ",":
                    break
        if t[p] == ";":
            return p + 1
        return self.block(p)

    def scope(self, p: int, where: str) -> int:
        """Items up to the closing brace, with recovery."""
        t = self.t
        while True:
            if t[p] == "}":
                return p + 1
            if not t[p]:
                raise Wrong(p, "unclosed {")
            p = self.safely(self.item, p, where)

    def safely(self, f, p: int, *args) -> int:
        """f(p); after an error the place after the statement it is in."""
        try:
            return f(p, *args)
        except Wrong as e:
            self.errors.append((e.at, e.why))
            return self.recover(p, e.at)

    def recover(self, p: int, at: int) -> int:
        t, depth = self.t, 0
        q = p
        while t[q]:
            x = t[q]
            if x == "{":
                depth += 1
            elif x == "}":
                depth -= 1
                if depth < 0:
                    return q if q > p else q + 1
                if depth == 0 and q >= at:
                    return q + 1
            elif x == ";" and depth == 0 and q >= at:
                return q + 1
            q += 1
        return q

    def item(self, p: int, where: str) -> int:
        t = self.t
        x = t[p]
        if x == ";":
            return p + 1
        e = self.next[p]
        stop = t[e]
        if stop == ";" or stop == "{":  # a prototype, a member, or the head of a function
            key = (where, stop, *t[p:e])
            known = self.memo.get(key)
            if known is None:
                known = self.shape(key, t[p:e], where, stop)
            if known:
                return e + 1 if stop == ";" else self.block(e)
        if self.cpp:
            if x == "namespace" or x == "inline" and t[p + 1] == "namespace":
                p = p + 1 if x == "namespace" else p + 2
                p = self.attributes(p)
                while t[p] == "i" or t[p] == "::" or t[p] == "inline":
                    p += 1
                if t[p] == "=":
                    return self.need(self.name(p + 1), ";")
                return self.scope(self.need(p, "{"), "file")
            if x == "template":
                p += 1
                if t[p] == "<":
                    p = self.template_parameters(p)
                if t[p] == "requires":
                    p = self.constraint(p + 1)
                if t[p] == "concept":
                    return self.need(self.expression(self.need(self.attributes(self.need(p + 1, "i")), "=")), ";")
                return self.item(p, where)
            if x == "extern" and t[p + 1] == "s":
                return self.scope(p + 3, "file") if t[p + 2] == "{" else self.item(p + 2, where)
            if x == "using":
                if t[p + 1] == "namespace":
                    return self.need(self.name(p + 2), ";")
                if t[p + 1] == "i" and t[p + 2] == "=":
                    return self.need(self.type_name(p + 3), ";")
                return self.need(self.name(p + (2 if t[p + 1] == "typename" else 1)), ";")
            if where == "class" and x in ("public", "private", "protected"):
                return self.need(p + 1, ":")
        if x in ("static_assert", "_Static_assert") or x == "i" and t[p + 1] == "(" and where == "file" and not self.cpp and t[p + 2] in ("sizeof",):
            return self.need(self.arguments(p + 1), ";")
        return self.declaration(p, where)

    def shape(self, key: tuple, tokens: list[str], where: str, stop: str) -> bool:
        """Whether the tokens up to stop are a whole declaration, or (before a brace) the head of a function."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        sub = Parser(tokens + ([";"] if stop == ";" else ["{", "}"]), "cpp" if self.cpp else "c", {})
        sub.next = [sub.n] * (sub.n + 2)  # no memory inside
        for k in range(len(tokens), -1, -1):
            sub.next[k] = len(tokens)
        ok = False
        if tokens and tokens[0] not in ("namespace", "template", "extern", "using", "public", "private", "protected", "struct" if stop == "{" and "(" not in tokens else "", "static_assert", "_Static_assert"):
            try:
                ok = (sub.statement_fresh(0) if where == "block" else sub.declaration(0, where)) == sub.n and not sub.errors
            except Wrong:
                ok = False
        self.memo[key] = ok
        return ok

    def block(self, p: int) -> int:
        p = self.need(p, "{")
        t, nxt, memo = self.t, self.next, self.memo
        while True:
            x = t[p]
            if x == "}":
                return p + 1
            if not x:
                raise Wrong(p, "unclosed {")
            e = nxt[p]
            if t[e] == ";":
                key = ("block", ";", *t[p:e])
                known = memo.get(key)
                if known is None:
                    known = self.shape(key, t[p:e], "block", ";")
                if known:
                    p = e + 1
                    continue
            p = self.safely(self.statement, p)

    def statement(self, p: int) -> int:
        t = self.t
        x = t[p]
        if x == "{":
            return self.block(p)
        if x == "if" or x == "while" or x == "switch":
            e = self.next[p]
            key = (x, *t[p:e]) if t[e] == "{" else None
            if key is not None and self.memo.get(key):
                q = e
            else:
                q = p + 2 if x == "if" and t[p + 1] == "constexpr" else p + 1
                q = self.condition(self.need(q, "("), x)
                if key is not None and q == e:
                    self.memo[key] = True
            q = self.statement(q)
            if x == "if" and t[q] == "else":
                return self.statement(q + 1)
            return q
        return self.statement_fresh(p)

    def condition(self, p: int, kind: str) -> int:
        """( has been read; up to after ). C++ allows a declaration, and one before a semicolon."""
        t = self.t
        if self.cpp:
            q = self.trial(self.declaration, p, "block")
            if q is None:
                q = self.trial(self.expression_statement, p)
            if q is not None:
                p = q
            q = self.trial(self.condition_declaration, p)
            if q is not None and t[q] == ")":
                return q + 1
        return self.need(self.expression(p), ")")

    def condition_declaration(self, p: int) -> int:
        p = self.specifiers(p)
        p, _ = self.declarator(p)
        return self.assignment(self.need(p, "="))

    def expression_statement(self, p: int) -> int:
        return self.need(self.expression(p), ";")

    def statement_fresh(self, p: int) -> int:
        t = self.t
        x = t[p]
        if x == ";":
            return p + 1
        if x == "{":
            return self.block(p)
        if x in ("if", "while", "switch"):
            return self.statement(p)
        if x == "for":
            return self.for_(p)
        if x == "do":
            p = self.need(self.statement(p + 1), "while")
            return self.need(self.need(self.expression(self.need(p, "(")), ")"), ";")
        if x == "return" or x == "co_return":
            return p + 2 if t[p + 1] == ";" else self.need(self.expression(p + 1), ";")
        if x == "break" or x == "continue":
            return self.need(p + 1, ";")
        if x == "goto":
            return self.need(self.need(p + 1, "i"), ";")
        if x == "case":
            p = self.binary(p + 1, 0, True)
            if t[p] == "...":
                p = self.binary(p + 1, 0, True)
            p = self.need(p, ":")
            return p if t[p] == "}" else self.statement(p)
        if x == "default":
            p = self.need(p + 1, ":")
            return p if t[p] == "}" else self.statement(p)
        if x == "i" and t[p + 1] == ":" :
            return p + 2 if t[p + 2] == "}" else self.statement(p + 2)
        if x == "try" and self.cpp:
            p = self.block(p + 1)
            if t[p] != "catch":
                raise Wrong(p, "try without catch")
            while t[p] == "catch":
                p = self.block(self.parameters(p + 1))
            return p
        if x in ("using", "static_assert", "_Static_assert", "namespace", "template"):
            return self.item(p, "file")
        q, error = None, None
        try:
            q = self.need(self.expression(p), ";")
        except Wrong as e:
            error = e
        if q is not None:
            return q
        try:
            return self.declaration(p, "block")
        except Wrong as e:
            raise (e if e.at >= error.at else error) from None

    def for_(self, p: int) -> int:
        t = self.t
        e = self.next[p]
        for _ in range(2):
            if t[e] == ";":
                e = self.next[e + 1]
        key = ("for", *t[p:e]) if t[e] == "{" else None
        if key is not None and self.memo.get(key):
            return self.block(e)
        q = self.need(p + 1, "(")
        r = self.trial(self.range_, q) if self.cpp else None
        if r is not None:
            q = r
        else:
            if t[q] == ";":
                q += 1
            else:
                r = self.trial(self.declaration, q, "block")
                q = r if r is not None else self.expression_statement(q)
            q = q + 1 if t[q] == ";" else self.expression_statement(q)
            q = q + 1 if t[q] == ")" else self.need(self.expression(q), ")")
        if key is not None and q == e:
            self.memo[key] = True
        return self.statement(q)

    def range_(self, p: int) -> int:
        t = self.t
        p = self.specifiers(p)
        if t[p] == "[" or t[p] in ("&", "&&") and t[p + 1] == "[":
            p = p + 1 if t[p] == "[" else p + 2
            while t[p] in ("i", ","):
                p += 1
            p = self.need(p, "]")
        else:
            p, _ = self.declarator(p)
        return self.need(self.expression(self.need(p, ":")), ")")

    def file(self) -> list[tuple[int, str]]:
        p, t = 0, self.t
        while p < self.n:
            if t[p] == "}":
                self.errors.append((p, "unmatched }"))
                p += 1
            else:
                p = self.safely(self.item, p, "file")
        return self.errors


def branches(spelled: list[str], language: str, last: bool) -> tuple[list[int], list[tuple[int, str]]]:
    """(places of the tokens of one branch of each conditional, errors of the directives)."""
    keep, errors, stack = [], [], []  # stack: [taken now, taken before, seen else, outer on]
    on = True
    for k, s in enumerate(spelled):
        if s[:1] != "#":
            if on:
                keep.append(k)
            continue
        m = _CONDITIONS.match(s)
        if not m:
            name = _NAME.match(s).group(1)
            if on and name not in _DIRECTIVES and s[1:].strip():
                errors.append((k, f"unknown directive #{name}"))
            continue
        word, rest = m.group(1), s[m.end() :].split("/")[0].strip()
        if word in ("if", "ifdef", "ifndef"):
            never = word == "if" and rest == "0" or word == "ifdef" and rest == "__cplusplus" and language == "c"
            other = not never and last and has_else(spelled, k)
            stack.append([on, not never and not other, False, k])
            on = on and not never and not other
        elif not stack:
            errors.append((k, f"#{word} without #if"))
        elif word == "endif":
            on = stack.pop()[0]
        else:
            top = stack[-1]
            if top[2]:
                errors.append((k, f"#{word} after #else"))
            if word == "else":
                top[2] = True
                on = top[0] and not top[1]
            else:
                take = top[0] and not top[1] and not (last and has_else(spelled, k))
                on, top[1] = take, top[1] or take
    errors += [(top[3], "#if without #endif") for top in stack]
    return keep, errors


def has_else(spelled: list[str], k: int) -> bool:
    """Whether an #elif or #else of the same conditional follows."""
    depth = 0
    for s in spelled[k + 1 :]:
        if s[:1] == "#" and (m := _CONDITIONS.match(s)):
            word = m.group(1)
            if word in ("if", "ifdef", "ifndef"):
                depth += 1
            elif word == "endif":
                if depth == 0:
                    return False
                depth -= 1
            elif depth == 0:
                return True
    return False


_SHAPES: dict[str, dict] = {"c": {}, "cpp": {}}


def check(text: str, language: str) -> list[tuple[int, str]]:
    """(line, cause) of all errors of a text, none if it is valid."""
    language = "c" if language == "c" else "cpp"
    if sys.getrecursionlimit() < NESTED_CALLS:
        sys.setrecursionlimit(NESTED_CALLS)
    joined = clex.splice(text.lstrip("﻿"))
    spelled = clex.spellings(joined, language)
    kinds = list(map(clex.CLASSES[language].__getitem__, spelled))
    best = None
    directives = "#" in kinds
    conditional = directives and any(s[:1] == "#" and _CONDITIONS.match(s) for s in spelled)
    for last in (False, True) if conditional else (False,):
        keep, errors = branches(spelled, language, last) if directives else (range(len(kinds)), [])
        own = [kinds[k] for k in keep] if directives else kinds
        found = errors + [(keep[a] if a < len(own) else len(spelled), why) for a, why in Parser(own, language, _SHAPES[language]).file()]
        if not found:
            return []
        if best is None or len(found) < len(best):
            best = found
    spans = clex.places(joined, language)
    starts = [s for s, _ in spans] + [len(joined)]
    spliced = [m.start() for m in clex._SPLICE.finditer(text)] if len(joined) != len(text) else []
    out = []
    for k, why in sorted(best):
        at = starts[min(k, len(starts) - 1)]
        out.append((joined.count("\n", 0, at) + 1 + sum(x <= at for x in spliced), why))
    return out


_SCHEMA = "file_path string, repo string, language string, n_errors int, first_line int, first_cause string, errors array<struct<line:int,cause:string>>"
_ERRORS = pa.list_(pa.struct([("line", pa.int32()), ("cause", pa.string())]))


def verdicts(files: DataFrame) -> DataFrame:
    """The errors of every stored file text; n_errors 0 is a valid one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, repos, languages = (batch.column(k) for k in range(3))
            all_errors = [check(t, lang) for t, lang in zip(batch.column(3).to_pylist(), languages.to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    paths,
                    repos,
                    languages,
                    pa.array([len(e) for e in all_errors], pa.int32()),
                    pa.array([e[0][0] if e else None for e in all_errors], pa.int32()),
                    pa.array([e[0][1] if e else None for e in all_errors], pa.string()),
                    pa.array([[{"line": a, "cause": b} for a, b in e] for e in all_errors], _ERRORS),
                ],
                names=["file_path", "repo", "language", "n_errors", "first_line", "first_cause", "errors"],
            )

    ext = F.lower(F.regexp_extract("file_path", r"(\.[^./]*)$", 1))
    language = F.coalesce(F.lower(F.trim("language")), F.when(ext == ".c", "c").otherwise("cpp"))
    rows = files.where(F.col("file_path").isNotNull() & F.col("text").isNotNull()).select("file_path", "repo", language.alias("language"), "text")
    return rows.mapInArrow(run, _SCHEMA)


def rates(verdict: DataFrame) -> DataFrame:
    """Files, invalid files and acceptance for each repository and language."""
    files = verdict.groupBy("file_path").agg(F.max("n_errors").alias("n"), F.min("repo").alias("repo"), F.min("language").alias("language"))
    return files.groupBy("repo", "language").agg(
        F.count("*").alias("files"),
        F.sum((F.col("n") > 0).cast("int")).alias("invalid"),
        F.round(1 - F.sum((F.col("n") > 0).cast("int")) / F.count("*"), 6).alias("acceptance"),
    )
