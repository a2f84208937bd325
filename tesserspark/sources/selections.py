"""A language of atom selections, read into a predicate on the atoms' columns.

    name A B*         species, with * and ? for any characters; also type, element, elements, names, types, species
    index 0:5 9       atom numbers from 0, ranges with both ends; bynum counts from 1
    prop x > 2        a coordinate, as it is or as ``prop abs z``, with < <= > >= == !=
    all, none         every atom, no atom
    not, and, or, ()  in this order of strength
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_TOKEN = re.compile(r"\s*([()]|<=|>=|==|!=|<|>|[^\s()<>=!]+)")
_LABELS = {"name", "names", "type", "types", "element", "elements", "species"}
_WORDS = {"and", "or", "not", "(", ")", *_LABELS, "index", "bynum", "prop", "all", "none"}
_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if m is None:
                raise self.error("an unknown sign")
            self.tokens.append(m[1])
            at = m.end()

    def error(self, what: str) -> ValueError:
        return ValueError(f"selection {self.text!r}: {what}")

    def next(self, wanted: str | None = None) -> str:
        if not self.tokens:
            raise self.error(f"ends where {wanted or 'more'} should follow")
        return self.tokens.pop(0)

    def taken(self, word: str) -> bool:
        if self.tokens and self.tokens[0] == word:
            self.tokens.pop(0)
            return True
        return False

    def any_of(self) -> Column:
        out = self.all_of()
        while self.taken("or"):
            out = out | self.all_of()
        return out

    def all_of(self) -> Column:
        out = self.one()
        while self.taken("and"):
            out = out & self.one()
        return out

    def values(self, what: str) -> list[str]:
        out = []
        while self.tokens and self.tokens[0] not in _WORDS:
            out.append(self.tokens.pop(0))
        if not out:
            raise self.error(f"{what} needs a value")
        return out

    def one(self) -> Column:
        word = self.next("a condition")
        if word == "not":
            return ~self.one()
        if word == "(":
            out = self.any_of()
            if not self.taken(")"):
                raise self.error("a parenthesis is not closed")
            return out
        if word in ("all", "none"):
            return F.lit(word == "all")
        if word in _LABELS:
            return self.labelled(self.values(word))
        if word in ("index", "bynum"):
            return self.numbered(self.values(word), int(word == "bynum"))
        if word == "prop":
            return self.property()
        raise self.error(f"{word!r} is not understood")

    def labelled(self, names: list[str]) -> Column:
        plain, patterns = [n for n in names if not set("*?") & set(n)], [n for n in names if set("*?") & set(n)]
        out = F.col("species").isin(plain) if plain else F.lit(False)
        for p in patterns:
            out = out | F.col("species").rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$")
        return out

    def numbered(self, ranges: list[str], base: int) -> Column:
        out = F.lit(False)
        for r in ranges:
            m = re.fullmatch(r"(\d+)(?:[:-](\d+))?", r)
            if not m:
                raise self.error(f"{r!r} is no atom number and no range")
            out = out | F.col("atom").between(int(m[1]) - base, int(m[2] or m[1]) - base)
        return out

    def property(self) -> Column:
        name = self.next("a coordinate")
        absolute = name == "abs"
        name = self.next("a coordinate") if absolute else name
        sign, value = self.next("a comparison"), self.next("a number")
        if name not in ("x", "y", "z") or sign not in _COMPARE:
            raise self.error("a property is x, y or z, compared with a number")
        try:
            number = float(value)
        except ValueError:
            raise self.error(f"{value!r} is no number") from None
        return _COMPARE[sign](F.abs(name) if absolute else F.col(name), F.lit(number))


def selected(text: str) -> Column:
    reader = _Reader(text)
    out = reader.any_of()
    if reader.tokens:
        raise reader.error(f"{reader.tokens[0]!r} is not understood")
    return out
