"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes puts a cut wherever its low bits are zero, so cuts depend only on
the bytes just before them: an insertion shifts positions but moves no other cut.  Chunks have at least
``LEAST`` bytes and, by forced cuts, about ``MOST`` at most (a short rest joins the last chunk).  A chunk
repeats when its digest occurs before, in a document with a smaller doc_id or earlier in the same one.
Runs of repeating chunks are removed from ``least_run`` bytes on, so that a few common words that happen to
make a chunk stay; 0 removes every one.  The first occurrence of a chunk always stays.

The gear table is 32 bits wide, so the hash is a function of the last 32 bytes and can be computed for all
positions at once.  Nulls in the text count as empty; rows with a null doc_id, or with the same doc_id, are
not compared with each other and lose only what repeats within their own text; every row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import empty_if_null, map_arrow, stage, texts_of

LEAST, MOST, MASK_BITS, LEAST_RUN = 24, 512, 5, 96
DIGEST = np.dtype([("hi", "<i8"), ("lo", "<i4")])
_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """Rolling hash at every byte, h = (h << 1) + gear[byte], by doubling the window."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
    return h


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    if not n:
        return []
    h = gear(np.frombuffer(data, np.uint8).copy())
    places = np.flatnonzero((h >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, at = [], 0
    for place in places.tolist():
        if place - at < LEAST:
            continue
        while place - at > MOST:
            at += MOST
            out.append(at)
        if place - at >= LEAST:
            out.append(place)
            at = place
    while n - at > MOST:
        at += MOST
        out.append(at)
    if out and n - at < LEAST:
        out[-1] = n
    elif at < n:
        out.append(n)
    return out


def _digests(data: bytes, ends: list[int]) -> list[bytes]:
    at, out = 0, []
    for end in ends:
        out.append(hashlib.blake2b(data[at:end], digest_size=12).digest())
        at = end
    return out


def chunk_rows(docs: DataFrame) -> DataFrame:
    """One row for each chunk digest of a document: hi, lo (96-bit digest), doc_id."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, digest = [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            found = set(_digests(data, cuts(data)))
            own += [doc] * len(found)
            digest += found
        raw = np.frombuffer(b"".join(digest), DIGEST)
        return pa.RecordBatch.from_arrays(
            [pa.array(raw["hi"].copy()), pa.array(raw["lo"].copy()), pa.array(own, pa.int64())], names=["hi", "lo", "doc_id"]
        )

    own = docs.select("doc_id", empty_if_null()).where("doc_id is not null")
    return map_arrow(own, run, "hi long, lo int, doc_id long")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, gone ``array<struct<hi,lo>>``: digests that also occur in a document with a smaller doc_id.

    The first holder of a digest is a plain minimum, combined before the shuffle; only digests with more
    than one holder are joined back, so unique chunks never meet each other again.
    """
    rows = stage(chunk_rows(docs))
    shared = rows.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    later = rows.join(shared.select("hi", "lo", "first"), ["hi", "lo"]).where("doc_id > first")
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))


def kept_bytes(data: bytes, gone: set[bytes], least_run: int = LEAST_RUN) -> tuple[bytes, int, int, int]:
    """What stays of a text, its chunks, removed bytes, and maximal removed runs; ``gone``: digests held elsewhere."""
    ends = cuts(data)
    seen = set(gone)
    runs: list[list[int]] = []  # start and end of runs of repeating chunks
    at = 0
    for end, d in zip(ends, _digests(data, ends), strict=True):
        if d not in seen:
            seen.add(d)
        elif runs and runs[-1][1] == at:
            runs[-1][1] = end
        else:
            runs.append([at, end])
        at = end
    runs = [r for r in runs if r[1] - r[0] >= least_run]
    places = [0, *(x for r in runs for x in r), len(data)]
    kept = b"".join(data[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
    return kept, len(ends), len(data) - len(kept), len(runs)


def dedup_chunks(docs: DataFrame, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, n_bytes, n_chunks, n_removed, n_spans, kept (binary) for every document."""
    repeated = repeated_chunks(docs)
    joined = docs.select("doc_id", empty_if_null()).join(repeated, "doc_id", "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(5)]
        gone = batch.column("gone")
        at, null = gone.offsets.to_numpy(), gone.is_null().to_pylist()
        held = gone.values.slice(at[0], at[-1] - at[0])
        raw = np.empty(len(held), DIGEST)
        raw["hi"], raw["lo"] = (held.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        raw, at = raw.tobytes(), (at - at[0]).tolist()
        for k, text in enumerate(texts_of(batch)):
            data = text.encode("utf-8", "surrogatepass")
            own = () if null[k] else (raw[i : i + 12] for i in range(12 * at[k], 12 * at[k + 1], 12))
            kept, chunks, removed, spans = kept_bytes(data, set(own), least_run)
            for c, v in zip(cols, (len(data), chunks, removed, spans, kept), strict=True):
                c.append(v)
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            names=["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept"],
        )

    return map_arrow(joined, run, "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept binary")
