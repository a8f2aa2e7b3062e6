"""Boolean filter expressions: a parser to a tree, a printer and a compiler to a Column.

`!` binds tightest, then `&`, `^`, `|`; all are left-associative and parentheses group. A name starts with a letter or an
underscore and goes on with letters, digits, underscores, brackets and hyphens; `\\[`, `\\]` and `\\/` stand for the character.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAME = re.compile(r"(?:[A-Za-z_]|\\[\[\]/])(?:[A-Za-z0-9_\[\]-]|\\[\[\]/])*")
_LEVELS = ("|", "^", "&")


class ParseError(ValueError):
    pass


@dataclass(frozen=True)
class Name:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Not:
    arg: object

    def __str__(self) -> str:
        return f"!{self.arg}"


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def fail(self, wanted: str):
        line = self.text.count("\n", 0, self.at) + 1
        found = "end of content" if self.at >= len(self.text) else f"content {self.text[self.at :].splitlines()[0]!r}"
        raise ParseError(f"Unexpected {found}. expecting {wanted} line {line}\n")

    def level(self, k: int = 0):
        if k == len(_LEVELS):
            return self.unary()
        left = self.level(k + 1)
        while self.skip() == _LEVELS[k]:
            self.at += 1
            left = Binary(_LEVELS[k], left, self.level(k + 1))
        return left

    def unary(self):
        c = self.skip()
        if c == "!":
            self.at += 1
            return Not(self.unary())
        if c == "(":
            self.at += 1
            inner = self.level()
            if self.skip() != ")":
                self.fail('")"')
            self.at += 1
            return inner
        m = _NAME.match(self.text, self.at)
        if not m:
            self.fail("<name>")
        self.at = m.end()
        return Name(re.sub(r"\\(.)", r"\1", m[0]))


def parse(text: str):
    """The tree; ParseError says what was expected and in which line."""
    parser = _Parser(text)
    tree = parser.level()
    if parser.skip():
        parser.fail("end of content")
    return tree


def compile_expression(tree, lookup: Callable[[str], Column] = F.col) -> Column:
    """A Column; `lookup` gives the Column of a name."""
    if isinstance(tree, str):
        tree = parse(tree)
    if isinstance(tree, Name):
        return lookup(tree.name)
    if isinstance(tree, Not):
        return ~compile_expression(tree.arg, lookup)
    left, right = compile_expression(tree.left, lookup), compile_expression(tree.right, lookup)
    return {"&": lambda: left & right, "|": lambda: left | right, "^": lambda: left != right}[tree.op]()


def all_of(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def any_of(*conditions: Column) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
