"""Declarations in source text: a scan of tokens that follows statements and blocks.

Comments and strings are skipped.  A statement begins behind ``;``, ``{`` or ``}`` or on a new line; modifiers and attributes
may stand before its keyword.  Blocks know what opened them, so a method is a name with parentheses and a
block directly inside of a class, and a C function one outside of any function.  Python is parsed.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple


class Found(NamedTuple):
    name: str
    kind: str
    line: int
    visibility: str


@dataclass(frozen=True)
class Family:
    """Languages that are scanned alike: keywords with the kind that they declare, and what may stand before them."""

    extensions: tuple[str, ...]
    kinds: dict[str, str]
    modifiers: frozenset[str]
    long_quotes: bool = False  # whether '...' holds texts, not single characters
    classes: frozenset[str] = frozenset()  # keywords whose blocks have methods
    open_functions: bool = False  # whether functions need no keyword


RUST = Family(("rs",), {"fn": "Function", "struct": "Struct", "enum": "Enum", "trait": "Trait", "const": "Const", "static": "Const", "type": "TypeAlias"}, frozenset({"pub", "async", "unsafe", "const", "extern", "default"}))
SCRIPT = Family(
    ("ts", "tsx", "js", "jsx", "mjs", "cjs", "ets", "vue", "svelte"),
    {"function": "Function", "class": "Class", "interface": "Interface", "enum": "Enum", "struct": "Component", "const": "Const", "let": "Const", "var": "Const", "type": "TypeAlias"},
    frozenset({"export", "default", "async", "abstract", "declare", "const", "public", "private", "protected", "static", "readonly", "override", "get", "set"}), True, frozenset({"class", "struct"}),
)
GO = Family(("go",), {"func": "Function", "type": "Struct"}, frozenset())
C = Family(
    ("c", "cc", "cpp", "cxx", "h", "hpp"), {"struct": "Struct", "class": "Class", "enum": "Enum", "union": "Struct", "namespace": ""},
    frozenset({"static", "inline", "extern", "typedef", "constexpr", "virtual", "explicit"}), False, frozenset({"struct", "class", "union"}), True,
)
FAMILIES = {e: f for f in (RUST, SCRIPT, GO, C) for e in f.extensions}
EXTENSIONS = (*FAMILIES, "py")
#: Words that stand before parentheses or blocks without being names.
CONTROL = frozenset({"if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "function", "new", "throw", "await", "typeof", "super"})


@lru_cache(maxsize=2)
def _tokens(long_quotes: bool) -> re.Pattern:
    quoted = r"'(?:\\.|[^'\\\n])*+'?" if long_quotes else r"'(?:\\[^'\n]++|[^'\\\n])'"
    return re.compile(rf'//[^\n]*+|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"?|`(?:\\.|[^`\\])*+`?|{quoted}|(?P<word>[A-Za-z_$][\w$]*+)|(?P<mark>::|[^\w\s]|\n)', re.S)


class _Scan:
    def __init__(self, family: Family, text: str):
        self.family, self.found = family, []
        self.tokens: list[str] = []
        self.lines: list[int] = []
        line, at = 1, 0
        for m in _tokens(family.long_quotes).finditer(text):
            line, at = line + text.count("\n", at, m.start()), m.start()
            if m.lastgroup:
                self.tokens.append(m[0])
                self.lines.append(line)

    def word(self, i: int) -> bool:
        return i < len(self.tokens) and (self.tokens[i][0].isalpha() or self.tokens[i][0] in "_$")

    def past(self, i: int, newlines: bool = True) -> int:
        """``i`` or the next token that is no line break."""
        while newlines and i < len(self.tokens) and self.tokens[i] == "\n":
            i += 1
        return i

    def closed(self, i: int) -> int:
        """The token behind the bracket that closes the one at ``i``."""
        depth, pairs = 0, {"(": ")", "[": "]", "<": ">", "{": "}"}
        left, right = self.tokens[i], pairs[self.tokens[i]]
        for k in range(i, len(self.tokens)):
            depth += (self.tokens[k] == left) - (self.tokens[k] == right)
            if not depth:
                return k + 1
            if left == "<" and self.tokens[k] in "{};":
                return i
        return len(self.tokens)

    def has_block(self, i: int) -> bool:
        """Whether a name at ``i - 1`` has parameters and a block behind them."""
        if i < len(self.tokens) and self.tokens[i] == "<":
            i = self.closed(i)
        if i >= len(self.tokens) or self.tokens[i] != "(":
            return False
        k = self.closed(i)
        while k < len(self.tokens) and self.tokens[k] not in ("{", ";", "}", "=", ","):
            k += 1
        return k < len(self.tokens) and self.tokens[k] == "{"

    def add(self, i: int, kind: str, head: list[str]) -> None:
        shown = "Public" if {"pub", "export", "public"} & {*head} else "Internal" if {"private", "protected"} & {*head} or self.family is C and "static" in head else "Unknown"
        self.found.append(Found(self.tokens[i], kind, self.lines[i], shown))

    def declared(self, i: int, head: list[str]) -> int | None:
        """Add what the keyword at ``i`` declares; the token of its name, or null."""
        family, key = self.family, self.tokens[i]
        k = i + 1
        if family is GO and key == "func" and k < len(self.tokens) and self.tokens[k] == "(":
            k = self.closed(k)
        if family is SCRIPT and k < len(self.tokens) and self.tokens[k] == "*":
            k += 1
        if not self.word(k):
            return None
        kind = family.kinds[key]
        if family is GO and key == "type":
            kind = {"struct": "Struct", "interface": "Interface"}.get(self.tokens[k + 1] if k + 1 < len(self.tokens) else "", "")
        if family is C:
            end = k
            if key == "enum" and self.tokens[k] in ("class", "struct") and self.word(k + 1):
                k = end = k + 1
            while end < len(self.tokens) and self.tokens[end] not in ("{", ";", "(", ")", "=", ","):
                end += 1
            if end >= len(self.tokens) or self.tokens[end] != "{":
                return None  # a use, not a definition
        if kind:
            self.add(k, kind, head)
        return k

    def exported(self, i: int) -> int:
        """Names of ``export { a, b as c }`` from the bracket at ``i``."""
        end = self.closed(i)
        fresh = True
        for k in range(i + 1, end - 1):
            if fresh and self.word(k) and self.tokens[k] != "type":
                self.found.append(Found(self.tokens[k], "Export", self.lines[k], "Public"))
                fresh = False
            fresh = fresh or self.tokens[k] == ","
        return end

    def run(self) -> list[Found]:
        family, blocks = self.family, []
        head: list[str] = []
        fresh, opener, i = True, "", 0
        while i < len(self.tokens):
            t = self.tokens[i]
            if t == "\n":
                if not fresh:
                    head, fresh = [], True
            elif t in "{};":
                if t == "{" and fresh and "export" in head:
                    i = self.exported(i)
                    head = []
                    continue
                if t == "{":
                    blocks.append(opener)
                elif t == "}" and blocks:
                    blocks.pop()
                head, fresh, opener = [], True, ""
            elif fresh and t in "@#" and i + 1 < len(self.tokens):  # an attribute or decorator
                i += 1
                if self.tokens[i] != "[":
                    i += 1
                if i < len(self.tokens) and self.tokens[i] in "([":
                    i = self.closed(i)
                continue
            elif fresh and t == "(" and head[-1:] == ["pub"]:
                i = self.closed(i)
                continue
            elif fresh and t in family.modifiers and not (family is SCRIPT and self.tokens[i + 1 : i + 2] in (["("], ["<"])) and not (t in family.kinds and not (self.word(i + 1) and self.tokens[i + 1] in (family.kinds.keys() | family.modifiers))):
                head.append(t)
            elif fresh and t in family.kinds:
                name = self.declared(i, head)
                if name is not None:
                    opener, i = t, name
                fresh = False
            elif self.word(i) and t not in CONTROL and (fresh and blocks[-1:] and blocks[-1] in family.classes and not family.open_functions or family.open_functions and not opener and all(b in family.classes or b in ("namespace", "extern") for b in blocks)) and self.has_block(i + 1):
                self.add(i, "Method" if blocks and blocks[-1] in family.classes else "Function", head)
                fresh, opener = False, "function"
            elif family.open_functions and t == "extern":
                opener = "extern"
            else:
                fresh = False
            i += 1
        return self.found


def declarations(extension: str, text: str) -> list[Found]:
    """What ``text`` declares, in order of lines; a name is declared once a line, publicly if it can be."""
    if extension == "py":
        found = _python(text)
    else:
        family = FAMILIES.get(extension)
        found = _Scan(family, text).run() if family else []
    best: dict[tuple[int, str], Found] = {}
    for f in found:
        held = best.get((f.line, f.name))
        if held is None or f.visibility == "Public" != held.visibility:
            best[f.line, f.name] = f
    return sorted(best.values(), key=lambda f: (f.line, f.name))


def _python(text: str) -> list[Found]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):  # another version's syntax: by lines
        lines = ((no, re.match(r"\s*+(?:async\s++)?(def|class)\s++(\w++)", line)) for no, line in enumerate(text.split("\n"), 1))
        return [Found(m[2], "Class" if m[1] == "class" else "Function", no, "Unknown") for no, m in lines if m]
    kinds = {ast.FunctionDef: "Function", ast.AsyncFunctionDef: "Function", ast.ClassDef: "Class"}
    return [Found(n.name, kinds[type(n)], n.lineno, "Unknown") for n in ast.walk(tree) if type(n) in kinds]
