"""Secret scans: known patterns, and a token-efficiency test for random strings.

A long unbroken string is taken as a secret when a byte-level BPE vocabulary spends many tokens on it:
natural words and names need few tokens for their characters, random strings about one for every two.
Strings that are random by design but no secrets are left out first: whole digests of the usual lengths, whole
UUIDs (what else a string holds beside them is tested by itself), and identifiers: numbers, and names whose
parts are words (``camelCase``, ``snake_case``, paths).  A part is a word if the vocabulary itself needs few
tokens for it, so the token ratio decides about everything else, with or without digits.

Spans are in code points with an exclusive end, in order of start, then kind, then end.  Kinds, in their order:
assign, access, hex (the base patterns, leftmost and non-overlapping for each kind) and random (the method's).
A string that a base span touches is not reported as random again.  Nulls in the text count as empty; every row
is kept, repeated rows and rows without a doc_id too.  Whole texts are read, of any length.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from citelake.llm.common import empty_if_null, map_arrow, schema_of, texts_of

KINDS = ("assign", "access", "hex", "random")
# The base patterns.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of 16 or more characters; shorter runs hold no longer match
HEX = re.compile(r"[0-9a-f]{32,}")  # likewise
NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
#: Characters that make up the strings which the token-efficiency test looks at, and how many it takes at least:
#: shorter strings hold too few tokens for a ratio to mean anything.
STRING, SHORTEST = r"[A-Za-z0-9+/_=-]", 20
#: Characters for each token at and below which a string counts as random.
MOST_CHARS_PER_TOKEN = 2.2
#: Characters for each token from which a part of a name counts as a word.
WORD_CHARS_PER_TOKEN = 3.0
#: Digest lengths in hex: CRC to SHA-512; a hex string of such a length is a known digest.
DIGEST_CHARS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
NUMBER = re.compile(r"[0-9+/_=-]+")
#: Parts of names: letters in one case, or capitalised.
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=2)
def vocabulary(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("citelake", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_known(string: str, encoding) -> bool:
    """Digests, numbers, and identifiers: names that words of the vocabulary cover for the most part."""
    if HEXADECIMAL.fullmatch(string) and len(string) in DIGEST_CHARS or NUMBER.fullmatch(string):
        return True
    parts = [w for w in PART.findall(string) if len(w) >= 3]
    if sum(map(len, parts)) < 0.7 * len(string):
        return False
    words = sum(len(w) for w in parts if len(w) >= WORD_CHARS_PER_TOKEN * len(encoding.encode_ordinary(w)))
    return words >= 0.7 * len(string)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns."""
    out = []
    if ":" in text or "=" in text:
        if NAMES.search(text):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@lru_cache(maxsize=8)
def _strings(shortest: int) -> re.Pattern:
    return re.compile(f"{STRING}{{{shortest},}}")


def random_spans(
    text: str, encoding, taken: list[tuple[int, int, int]], most: float = MOST_CHARS_PER_TOKEN, shortest: int = SHORTEST
) -> list[tuple[int, int, int]]:
    """Spans of strings that the vocabulary is inefficient on, outside ``taken`` (in order of start)."""
    out = []
    starts = [x for x, _, _ in taken]
    reach = [0, *accumulate((y for _, _, y in taken), max)]  # the furthest end of the first n spans
    for m in _strings(shortest).finditer(text):
        edges = [m.start(), *(x for u in UUID.finditer(text, m.start(), m.end()) for x in u.span()), m.end()]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            string = text[a:b]
            if b - a < shortest or reach[bisect_left(starts, b)] > a or is_known(string, encoding):
                continue
            if b - a <= most * len(encoding.encode_ordinary(string)):
                out.append((a, 3, b))
    return out


def spans_of(text: str, encoding, most: float = MOST_CHARS_PER_TOKEN, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, in order."""
    base = base_spans(text)
    return sorted(base + random_spans(text, encoding, base, most, shortest))


def scan_documents(
    docs: DataFrame, ranks_path: str, pattern: str, most: float = MOST_CHARS_PER_TOKEN, shortest: int = SHORTEST
) -> DataFrame:
    """doc_id, spans ``array<struct<kind,start,end>>`` by start, then kind."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = vocabulary(ranks_path, pattern)
        found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(t, enc, most, shortest)] for t in texts_of(batch)]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    own = docs.select("doc_id", empty_if_null())
    return map_arrow(own, run, schema_of(own, ["doc_id"], "spans array<struct<kind:string,start:int,end:int>>"))


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping spans are replaced as one."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_documents(
    docs: DataFrame, ranks_path: str, pattern: str, most: float = MOST_CHARS_PER_TOKEN, shortest: int = SHORTEST
) -> DataFrame:
    """The rows of ``docs`` with secrets replaced in ``text``; a null text stays null, ``n_chars`` follows the text."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = vocabulary(ranks_path, pattern)
        out = [mask(t, spans_of(t, enc, most, shortest)) if t else t for t in batch.column("text").to_pylist()]
        at = {"text": pa.array(out, pa.string())}
        if "n_chars" in names:
            at["n_chars"] = pa.array([None if t is None else len(t) for t in out], pa.int64())
        return pa.RecordBatch.from_arrays([at.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

    return map_arrow(docs, run, docs.schema)
