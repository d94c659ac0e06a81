"""Scholarly text as a stream of tokens: names, initials, years, punctuation.

Each token has a kind of one letter, so the kinds of a text are a string of their own and a printed style is a short
pattern over that string; where it matches, the tokens say where in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

# Letters that open a name, letters within one, dashes, and particles of surnames.
UPPER = "A-ZÀ-ÖØ-ÞĀ-ɏ"
LETTER = "A-Za-zÀ-ÖØ-öø-ÿĀ-ɏ"
DASHES = "-‐‑‒–—"
PARTICLES = (
    "de", "del", "della", "da", "do", "dos", "das", "di", "du", "van", "von", "der", "den", "ten", "ter", "la", "le", "el", "al", "bin", "ibn",
    "abu", "mac", "mc", "st",
)
# What may follow a surname.
SUFFIXES = ("Jr", "Sr", "2nd", "3rd", "II", "III", "IV")

#: Kind, and what a token of it looks like; the first that fits at a place wins.
KINDS = (
    ("e", r"\bet\s+al\b\.?"),
    ("a", r"\band\b|&"),
    ("y", r"\b(?:19|20)\d{2}[a-z]?\b"),
    ("n", r"\d+"),
    ("j", rf"\b(?:{'|'.join(SUFFIXES)})\b\.?"),
    ("I", rf"\b[{UPPER}]\.(?:\s*-\s*[{LETTER}]\.)?"),
    ("C", rf"\b[{UPPER}]{{1,4}}(?![{LETTER}'’])"),
    ("N", rf"\b(?:(?:{'|'.join(PARTICLES)})\s+)*[{UPPER}](?:[{LETTER}'’]|[{re.escape(DASHES)}](?=[{LETTER}]))+"),
    ("w", rf"[{LETTER}](?:[{LETTER}'’]|[{re.escape(DASHES)}](?=[{LETTER}]))*"),
    ("c", ","), ("m", ";"), ("k", ":"), ("s", r"[.]"), ("z", r"[?!]"), ("q", "[\"“”«»]"), ("(", r"\("), (")", r"\)"), ("o", r"\S"),
)
#: How an entry behind a bare number opens: a surname, perhaps behind particles, and a comma.
SURNAME_COMMA = re.compile("w{0,2}[NC]{1,2}c")
_SCANNER = re.compile("|".join(f"({p})" for _, p in KINDS))
_LETTERS = "".join(k for k, _ in KINDS)


@dataclass
class Lexemes:
    """The tokens of ``text``: their kinds, starts and ends."""

    text: str

    def __post_init__(self) -> None:
        found = list(_SCANNER.finditer(self.text))
        self.kinds = "".join(_LETTERS[m.lastindex - 1] for m in found)
        self.starts = [m.start() for m in found]
        self.ends = [m.end() for m in found]

    def match(self, shape: re.Pattern, at: int = 0) -> Shape | None:
        m = shape.match(self.kinds, at)
        return Shape(self, m) if m else None

    def search(self, shape: re.Pattern) -> Shape | None:
        m = shape.search(self.kinds)
        return Shape(self, m) if m else None

    def start(self, token: int) -> int:
        return self.starts[token] if token < len(self.starts) else len(self.text)


@dataclass
class Shape:
    """A pattern of kinds found in a text; its groups as stretches of the text."""

    of: Lexemes
    found: re.Match

    def text(self, group: int = 0) -> str:
        a, b = self.found.span(group)
        return self.of.text[self.of.starts[a] : self.of.ends[b - 1]] if b > a >= 0 else ""

    def words(self, group: int = 0) -> list[str]:
        a, b = self.found.span(group)
        return [w for k in range(a, b) for w in self.of.text[self.of.starts[k] : self.of.ends[k]].split()] if a >= 0 else []

    @cached_property
    def begin(self) -> int:
        return self.of.start(self.found.start())

    @cached_property
    def before(self) -> str:
        return self.of.text[: self.begin]

    @cached_property
    def after(self) -> str:
        end = self.found.end()
        return self.of.text[self.of.ends[end - 1] if end else 0 :]
