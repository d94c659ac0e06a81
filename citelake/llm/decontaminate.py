"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are folded to their lower-cased letters and digits (as UTF-8 bytes).  An item of m
folded bytes may occur with up to k = ``rate`` * m edits.  By the q-gram lemma such an occurrence keeps at
least m - q + 1 - k*q of the item's q-grams, and its matches lie on diagonals (place in the text less place in
the item) that differ by k at most.  So matches are counted in bands of 2(k+1) diagonals that overlap by half;
bands that reach the bound are verified by banded alignment of the whole item against the region.

An item shorter than ``SHORTEST`` folded bytes would allow edits that make another item of it: it has to stand
unchanged between word bounds.  Items of fewer than ``Q`` folded bytes (a yes, a number) have no q-gram, are
no evidence of a leak, and match nothing.

The benchmark is held by every worker, in slices of about ``SLICE_BYTES`` bytes of text, 24 bytes of index each
(its size is summed first; a larger benchmark takes more passes over the documents, which carry their spans
along, so the number of slices changes no row).  Matches of a text are expanded ``EXPANDED`` at a time and
only their counts by band are held, so a q-gram that text and benchmark repeat takes time, not memory.

Every row gives one row, also rows that share a doc_id and rows with a null doc_id.  Null texts have no
matches, null items match nothing.  Repeated items are matched each on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import empty_if_null, map_arrow, texts_of

Q = 8
RATE = 0.1
SHORTEST = 24
SLICE_BYTES = 4 << 20
EXPANDED = 1 << 20
_MAP_BITS = 21
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, and the place of each in the lower-cased UTF-8 text."""
    raw = np.frombuffer(_lowered(text).encode("utf-8", "replace"), np.uint8)
    at = np.flatnonzero(_KEEP[raw])
    return raw[at], at


def grams(folded: np.ndarray) -> np.ndarray:
    """Every q-gram as one 64-bit number."""
    if len(folded) < Q:
        return np.zeros(0, np.uint64)
    w = folded.astype(np.uint16)
    w = (w[:-1] | w[1:] << np.uint16(8)).astype(np.uint32)
    w = (w[:-2] | w[2:] << np.uint32(16)).astype(np.uint64)
    return w[:-4] | w[4:] << np.uint64(32)


def budget(m: int, rate: float) -> int:
    """Edits allowed in an item of ``m`` folded bytes; never so many that the lemma demands no q-gram."""
    return max(0, min(int(rate * m), (m - Q) // Q)) if m >= SHORTEST else 0


@dataclass
class BenchmarkIndex:
    ids: np.ndarray
    items: list[bytes]
    rate: float

    def __post_init__(self) -> None:
        sizes = np.array([len(x) for x in self.items], np.int64)
        self.sizes, self.edits = sizes, np.array([budget(int(m), self.rate) for m in sizes], np.int64)
        self.needed = np.maximum(1, sizes - Q + 1 - self.edits * Q)
        each = [grams(np.frombuffer(x, np.uint8)) for x in self.items]
        keys = np.concatenate([np.zeros(0, np.uint64), *each])
        item = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        place = np.concatenate([np.zeros(0, np.int32), *(np.arange(len(x), dtype=np.int32) for x in each)])
        first = np.argsort(keys, kind="stable")
        self.item, self.place = item[first], place[first]
        self.keys, begin, count = np.unique(keys[first], return_index=True, return_counts=True)
        self.begin, self.count = begin.astype(np.int32), count.astype(np.int32)
        self.seen = np.zeros(1 << _MAP_BITS, bool)
        self.seen[(self.keys * _SPREAD) >> np.uint64(64 - _MAP_BITS)] = True

    def band_counts(self, at: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """((item, band) rows in order, counts) of the matches of text places ``at`` with keys ``where``."""
        ends = np.cumsum(self.count[where], dtype=np.int64)
        rows, counts = np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
        done = 0
        while done < len(at):
            base = ends[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, base + EXPANDED, side="right")))
            n = self.count[where[done:upto]].astype(np.int64)
            entry = np.repeat(self.begin[where[done:upto]] - np.cumsum(n) + n, n) + np.arange(n.sum())
            item, diagonal = self.item[entry].astype(np.int64), np.repeat(at[done:upto], n) - self.place[entry]
            band = np.floor_divide(diagonal, self.edits[item] + 1)
            # a diagonal lies in the band that starts in its own half and in the one before
            both = np.concatenate([rows, np.stack([np.tile(item, 2), np.concatenate([band, band - 1])])], axis=1)
            rows, which = np.unique(both, axis=1, return_inverse=True)
            counts = np.bincount(which.ravel(), np.concatenate([counts, np.ones(2 * len(item), np.int64)])).astype(np.int64)
            done = upto
        return rows, counts

    def matches(self, folded: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item number, start, end, edits) of the best occurrence in each run of bands that pass."""
        g = grams(folded)
        at = np.flatnonzero(self.seen[(g * _SPREAD) >> np.uint64(64 - _MAP_BITS)])
        if not len(at):
            return []
        where = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        same = self.keys[where] == g[at]
        at, where = at[same], where[same]
        if not len(at):
            return []
        rows, counts = self.band_counts(at, where)
        passed = counts >= self.needed[rows[0]]
        out: list[tuple[int, int, int, int]] = []
        text = None
        for j, b in rows[:, passed].T.tolist():
            if text is None:
                text = folded.tobytes()
            k, m = int(self.edits[j]), int(self.sizes[j])
            low, high = b * (k + 1) - k, (b + 2) * (k + 1) + k + m
            low, high = max(0, low), min(len(text), high)
            if (hit := align(self.items[j], text[low:high], k)) is None:
                continue
            found = (j, low + hit[0], low + hit[1], hit[2])
            if out and out[-1][0] == j and found[1] < out[-1][2]:  # the neighbouring band's view of the same place
                out[-1] = min(out[-1], found, key=lambda x: (x[3], x[1]))
            else:
                out.append(found)
        return out


def align(item: bytes, region: bytes, k: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the cheapest occurrence of ``item`` in ``region`` with at most ``k`` edits.

    Start and end in the region are free.  Row by row over the item, only over the band of region places
    that an occurrence with ``k`` edits can reach.
    """
    if (at := region.find(item)) >= 0:  # the alignment without edits
        return at, at + len(item), 0
    m, n = len(item), len(region)
    slack = n - m + k  # places at which an occurrence may start
    if k == 0 or slack < 0:
        return None
    b = np.frombuffer(region, np.uint8)
    width = slack + k + 1
    # cell c of row i stands for region place i + c - k; cost and start of the best way there
    place = np.arange(width) - k
    big = m + n + 1
    cost = np.where((place >= 0) & (place <= n), 0, big)
    start = place.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        place = i + np.arange(width) - k
        ok = (place >= 1) & (place <= n)
        differs = np.ones(width, np.int64)
        differs[ok] = b[place[ok] - 1] != item[i - 1]
        diagonal = np.where(ok, cost + differs, big)
        above = np.append(cost[1:], big) + 1
        take = diagonal <= above
        cost_now = np.where(take, diagonal, above)
        start_now = np.where(take, start, np.append(start[1:], 0))
        cost_now[(place < 0) | (place > n)] = big
        # insertions: each cell may be reached from any cell to its left, at one edit a step
        left = cost_now - steps
        source = np.maximum.accumulate(np.where(left == np.minimum.accumulate(left), steps, 0))
        cost, start = cost_now[source] + steps - source, start_now[source]
        if cost.min() > k:
            return None
    end = int(cost.argmin())
    return (int(start[end]), m + end - k, int(cost[end])) if cost[end] <= k else None


def _indexes(docs: DataFrame, benchmark: DataFrame, rate: float, slice_bytes: int) -> Iterator[Broadcast]:
    """The broadcast index of each slice of the benchmark, about ``slice_bytes`` of text each."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = own.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-total // slice_bytes))
    for k in range(n):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        items = sorted((r["item_id"], fold(r["text"])[0].tobytes()) for r in rows)
        items = [(i, x) for i, x in items if len(x) >= Q]
        yield docs.sparkSession.sparkContext.broadcast(
            BenchmarkIndex(np.array([i for i, _ in items], np.int64), [x for _, x in items], rate)
        )


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """doc_id and spans ``array<struct<item_id,start,end,edits>>`` (bytes of the lower-cased text), a row for each row."""
    out = docs.select("doc_id", empty_if_null(), F.array().cast(SPANS).alias("spans"))
    for index in _indexes(docs, benchmark, rate, slice_bytes):
        out = map_arrow(out, _scanner(index), out.schema)
    return out.select("doc_id", F.array_sort("spans").alias("spans"))


SPANS = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"
_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))


def _at_word_bounds(raw: bytes, start: int, end: int) -> bool:
    return not (start and _KEEP[raw[start - 1]]) and not (end < len(raw) and _KEEP[raw[end]])


def spans_of(text: str, index: BenchmarkIndex) -> list[dict]:
    folded, at = fold(text)
    if len(folded) < Q or not len(index.keys):
        return []
    found = [
        {"item_id": int(index.ids[j]), "start": int(at[min(a, len(at) - 1)]), "end": int(at[b - 1]) + 1, "edits": e, "short": index.sizes[j] < SHORTEST}
        for j, a, b, e in index.matches(folded)
    ]
    if any(s["short"] for s in found):
        raw = _lowered(text).encode("utf-8", "replace")
        found = [s for s in found if not s["short"] or _at_word_bounds(raw, s["start"], s["end"])]
    return [{k: s[k] for k in ("item_id", "start", "end", "edits")} for s in found]


def _scanner(index):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [spans_of(t, index.value) for t in texts_of(batch)]
        found = [a + b for a, b in zip(batch.column("spans").to_pylist(), found, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, _KIND)], names=["doc_id", "text", "spans"])

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item occurs; null texts stay."""
    for index in _indexes(docs, benchmark, rate, slice_bytes):
        docs = map_arrow(docs, _keeper(index), docs.schema)
    return docs


def _keeper(index):
    return lambda batch: batch.filter(pa.array([not spans_of(t, index.value) for t in texts_of(batch)]))
