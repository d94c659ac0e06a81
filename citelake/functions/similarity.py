"""Similarities that Spark has no expression for: plain functions, and Arrow-batched UDFs of them."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType


def fold(text: str | None) -> str:
    """Lower case without accents."""
    parts = unicodedata.normalize("NFKD", text or "")
    return "".join(c for c in parts if not unicodedata.combining(c)).lower()


def alike(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel: one big integer holds a whole row."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - bin(row).count("1")


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * common subsequence / total length; two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * _common_subsequence(a, b) / total


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words, and the shared words with either side's rest."""
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    shared, only_a, only_b = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if shared and (not only_a or not only_b):
        return 100.0
    common, rest_a, rest_b = " ".join(shared), " ".join(only_a), " ".join(only_b)
    with_a, with_b = f"{common} {rest_a}".strip(), f"{common} {rest_b}".strip()
    best = indel_ratio(with_a, with_b)
    if common:  # the shared words are a prefix of both
        best = max(best, 200.0 * len(common) / (len(common) + len(with_a)), 200.0 * len(common) / (len(common) + len(with_b)))
    return best


@pandas_udf(StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    return text.map(fold)


@pandas_udf(DoubleType())
def alike_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def token_set_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


# Loose accents of broken LaTeX text and the combining marks they stand for.
_LOOSE = {"´": "́", "`": "̀", "¨": "̈", "ˆ": "̂", "˜": "̃", "¸": "̧", "ˇ": "̌", "˚": "̊", "¯": "̄", "˘": "̆", "˝": "̋"}


def compose_accents(text: str | None) -> str:
    """Loose accents before (a cedilla after) their letter become the accented letter."""
    text, out, i = text or "", [], 0
    while i < len(text):
        c = text[i]
        if c in _LOOSE and c != "¸":
            j = i + 1
            while j < len(text) and text[j] == " ":
                j += 1
            whole = unicodedata.normalize("NFC", text[j] + _LOOSE[c]) if j < len(text) and text[j].isalpha() else ""
            if len(whole) == 1:
                out.append(whole)
                i = j + 1
                continue
        elif c == "¸" and out and out[-1].isalpha():
            whole = unicodedata.normalize("NFC", out[-1] + _LOOSE[c])
            if len(whole) == 1:
                out[-1] = whole
                i += 1
                continue
        out.append(c)
        i += 1
    return "".join(out)


@pandas_udf(StringType())
def compose_accents_udf(text: pd.Series) -> pd.Series:
    return text.map(compose_accents)
