"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that a document with a smaller doc_id holds.

Only strings that can match are ever sorted.  Every ``LENGTH``-byte string (window) has an anchor, the least
hashed ``GRAM``-byte string in it, so equal windows have equal anchors; consecutive windows mostly share one.

1. Documents are dealt to batches.  Each batch sends the distinct hashes of its anchors to buckets by hash,
   a few packed bytes each; a bucket answers each batch with the anchors that other batches hold too.
2. For anchors held by several documents, a batch sends the bytes that the anchor's windows cover (its
   context) to the bucket, equal contexts once with the places of all their occurrences.
3. In a bucket, the windows of all distinct contexts go through a family of suffix arrays (suffixes cut to
   ``LENGTH`` bytes).  Contexts come in batches by first document.  A batch gets a suffix array, which is merged
   with each level's in one pass: where neighbours agree in ``LENGTH`` bytes, the batch repeats what the level
   holds, and takes over the level's first document.  What is new becomes a level, and levels of about equal size
   merge, so sizes grow geometrically and a suffix is moved a logarithmic number of times.
4. Spans go back to the batches, which cut them out of the texts.

Matches never cross documents, overlaps count, and windows are judged on the input.  Nulls in the text count
as empty; rows with a null doc_id are kept whole, take no part and are not shuffled; rows sharing a doc_id are
judged each by their own text and do not count as smaller than each other.  A text of any length goes through in
pieces.  Batches and buckets grow in number with the input, not in size, and each is a partition of its own.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import empty_if_null, parts_for, text_bytes

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # places of a window's anchor
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
#: windows of a text that go through at once
PIECE = 1 << 19
#: windows sorted at once
SORTED = 1 << 18
KEY_BYTES = 5

_U = np.uint64
_P = 0x9FB21C651E98DF25
_PLACE = _U((1 << 28) - 1)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    """Polynomial hash of the ``GRAM`` bytes from every place on, by doubling."""
    one = b.astype(_U) + _U(1)
    two = one[:-1] * _U(_P) + one[1:]
    four = two[:-2] * _U(pow(_P, 2, 1 << 64)) + two[2:]
    eight = four[:-4] * _U(pow(_P, 4, 1 << 64)) + four[4:]
    sixteen = eight[:-8] * _U(pow(_P, 8, 1 << 64)) + eight[8:]
    return sixteen[:-4] * _U(pow(_P, 4, 1 << 64)) + four[16:]


@dataclass
class Anchors:
    """Anchors of a batch of texts: text number, first and last owned window, place, and hash."""

    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    place: np.ndarray
    key: np.ndarray


def _pieces(texts: list[bytes]):
    """(text number, offset, bytes) such that every window lies in one piece; gathered into blocks."""
    block, size = [], 0
    for row, t in enumerate(texts):
        for at in range(0, max(0, len(t) - LENGTH + 1), PIECE):
            block.append((row, at, t[at : at + PIECE + LENGTH - 1]))
            size += len(block[-1][2])
            if size >= PIECE:
                yield block
                block, size = [], 0
    if block:
        yield block


def find_anchors(texts: list[bytes]) -> Anchors:
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for block in _pieces(texts):
        b = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
        grams = _gram_hashes(b)
        m = (_mix(grams, 1) & ~_PLACE) | np.arange(len(grams), dtype=_U)
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: -(SPAN - 16)], m[SPAN - 16 :])  # least of SPAN places, for every window
        sizes = np.array([len(p) for _, _, p in block], np.int64)
        starts = np.cumsum(sizes) - sizes
        inside = np.zeros(len(b) + 1, np.int8)
        inside[starts] += 1
        np.add.at(inside, starts + sizes - LENGTH + 1, -1)
        windows = np.flatnonzero(np.cumsum(inside[: len(m)], dtype=np.int8))
        anchor = (m[windows] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        place, low, high = anchor[new], windows[new], windows[np.append(new[1:], len(windows)) - 1]
        piece = np.searchsorted(starts, low, side="right") - 1
        shift = np.array([at for _, at, _ in block], np.int64)[piece] - starts[piece]
        for col, x in zip(
            out, (np.array([r for r, _, _ in block], np.int64)[piece], low + shift, high + shift, place + shift, _mix(grams[place], 2)), strict=True
        ):
            col.append(x)
    empty = np.zeros(0, np.int64)
    return Anchors(*(np.concatenate([empty.astype(_U) if k == 4 else empty, *c]) for k, c in enumerate(out)))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)


def _short(keys: np.ndarray) -> np.ndarray:
    return keys & _U((1 << 8 * KEY_BYTES) - 1)


def _pack(short: np.ndarray) -> bytes:
    return short.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view(_U).ravel()


def _texts(rows: pa.Table) -> tuple[list, list[bytes], np.ndarray]:
    """doc_ids and texts of a batch in an order that is the same every time, and which rows take part."""
    ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return [ids[i] for i in order], [texts[i] for i in order], np.array([ids[i] is not None for i in order], bool)


def _taking_part(ids: list, texts: list[bytes]) -> list[bytes]:
    return [t if i is not None else b"" for i, t in zip(ids, texts, strict=True)]


def _stretches(starts: np.ndarray, end: int) -> list[tuple[int, int]]:
    """(start, end) of stretches that begin at ``starts`` and reach to the next one, the last one to ``end``."""
    return list(zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True)) if len(starts) else []


# --- 1: which anchors do several batches hold ------------------------------------------------------


def _send_keys(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        ids, texts, _ = _texts(rows)
        keys = np.unique(find_anchors(_taking_part(ids, texts)).key)
        bucket = _bucket_of(keys, buckets)  # ascending with the keys
        which, first = np.unique(bucket, return_index=True)
        blobs = [_pack(_short(keys[a:b])) for a, b in _stretches(first, len(keys))]
        batch = rows.column("batch")[0].as_py()
        return pa.table(
            [pa.array(which, pa.int32()), pa.array([batch] * len(which), pa.int32()), pa.array(blobs, pa.binary())],
            names=["bucket", "batch", "keys"],
        )

    return run


def _answer_keys(rows: pa.Table) -> pa.Table:
    """The keys of a bucket that at least two batches sent, for each of them."""
    each = [_unpack(k) for k in rows.column("keys").to_pylist()]
    keys = np.sort(np.concatenate(each))
    shared = np.unique(keys[1:][keys[1:] == keys[:-1]])
    blobs = []
    for own in each:
        at = np.searchsorted(shared, own)
        at[at == len(shared)] = 0
        blobs.append(_pack(own[shared[at] == own]) if len(shared) else b"")
    out = pa.table([rows.column("batch"), rows.column("bucket"), pa.array(blobs, pa.binary())], names=["batch", "bucket", "keys"])
    return out.filter(pa.array([bool(b) for b in blobs]))


# --- 2: contexts of the shared anchors --------------------------------------------------------------


_CHUNK = 1 << 19
_WEIGHTS: list[np.ndarray] = []


def _weights() -> list[np.ndarray]:
    """Powers of the byte weight and of its inverse, for one chunk and a context beyond it."""
    if not _WEIGHTS:
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(_CHUNK + 256, _U(base))
            steps[0] = 1
            _WEIGHTS.append(np.multiply.accumulate(steps))
    return _WEIGHTS


def _context_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from running sums of weighted bytes, chunk by chunk."""
    up, down = _weights()
    out = np.zeros(len(starts), _U)
    order = np.argsort(starts, kind="stable")
    bounds = np.searchsorted(starts[order], np.arange(0, len(data) + _CHUNK, _CHUNK))
    for k, (p, q) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if p == q:
            continue
        mine, base = order[p:q], k * _CHUNK
        part = data[base : base + _CHUNK + 255]
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        at = starts[mine] - base
        out[mine] = _mix((sums[at + sizes[mine]] - sums[at]) * down[at], 3)
    return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


def _send_contexts(buckets: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _NO_CONTEXTS
        ids, texts, _ = _texts(rows)
        a = find_anchors(_taking_part(ids, texts))
        bucket, short = _bucket_of(a.key, buckets), _short(a.key)
        # shared with other batches, by the answers; or with other documents of this batch
        combined = [
            _unpack(k) | _U(b) << _U(40)
            for b, k in zip(answers.column("bucket").to_pylist(), answers.column("keys").to_pylist(), strict=True)
        ]
        known = np.sort(np.concatenate([np.zeros(0, _U), *combined]))
        own = short | bucket.astype(_U) << _U(40)
        at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        shared = known[at] == own if len(known) else np.zeros(len(own), bool)
        doc = np.array([i if i is not None else 0 for i in ids], np.int64)
        order = np.lexsort((doc[a.row], own))
        same = own[order][1:] == own[order][:-1]
        group = np.cumsum(np.concatenate([[0], ~same])) if len(order) else np.zeros(0, np.int64)
        if len(order):
            edge = np.flatnonzero(np.concatenate([[True], ~same]))
            last = np.append(edge[1:], len(order)) - 1
            several = doc[a.row[order[edge]]] != doc[a.row[order[last]]]
            shared[order[several[group]]] = True
        pick = np.flatnonzero(shared)
        if not len(pick):
            return _NO_CONTEXTS
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(sizes) - sizes)[a.row[pick]] + a.low[pick]
        length = a.high[pick] - a.low[pick] + LENGTH
        offset = a.place[pick] - a.low[pick]
        digest = _context_hashes(data, starts, length) + _mix(own[pick], 4) * _U(131) + offset.astype(_U)
        order = np.lexsort((digest, bucket[pick]))
        pick, starts, length, offset, digest = pick[order], starts[order], length[order], offset[order], digest[order]
        fresh = np.concatenate([[True], digest[1:] != digest[:-1]])
        number = np.cumsum(fresh) - 1
        which, first = np.unique(bucket[pick], return_index=True)
        out = []
        for k, (p, q) in zip(which, _stretches(first, len(pick)), strict=True):
            part = np.arange(p, q)
            one = part[fresh[p:q]]
            rows_used, row_at = np.unique(a.row[pick[part]], return_inverse=True)
            out.append(
                {
                    "bucket": int(k),
                    "keys": _pack(short[pick[one]]),
                    "sizes": length[one].astype(np.uint8).tobytes(),
                    "offsets": offset[one].astype(np.uint8).tobytes(),
                    "data": data[_ranges(starts[one], length[one])].tobytes(),
                    "context": (number[part] - number[p]).astype(np.uint32).tobytes(),
                    "row_at": row_at.astype(np.uint32).tobytes(),
                    "low": a.low[pick[part]].astype(np.uint32).tobytes(),
                    "rows": rows_used.astype(np.uint32).tobytes(),
                    "docs": doc[rows_used].tobytes(),
                    "batch": rows.column("batch")[0].as_py(),
                }
            )
        return pa.Table.from_pylist(out, schema=_CONTEXTS)

    return run


_BLOBS = ("keys", "sizes", "offsets", "data", "context", "row_at", "low", "rows", "docs")
_CONTEXTS = pa.schema([("bucket", pa.int32()), ("batch", pa.int32()), *((n, pa.binary()) for n in _BLOBS)])
_NO_CONTEXTS = _CONTEXTS.empty_table()


# --- 3: the family of suffix arrays -----------------------------------------------------------------


def _suffix_array(windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct windows in order, the first document of each, and each given window's place among them."""
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    edge = np.flatnonzero(fresh)
    place = np.empty(len(windows), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return ranked[edge], np.minimum.reduceat(docs[order], edge) if len(edge) else docs[:0], place


class LevelFamily:
    """Levels of suffix arrays of distinct windows with their first documents, of geometrically growing size."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _scan(self, array: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which windows of a suffix array no level holds; ``first`` takes over the levels' first documents."""
        fresh = np.ones(len(array), bool)
        for known, known_docs in self.levels:
            both = np.concatenate([known, array])
            order = np.argsort(both, kind="stable")  # two runs in order: merged in one pass
            merged = both[order]
            # equal windows are neighbours, the level's before the batch's
            left = np.flatnonzero(merged[1:] == merged[:-1])
            held = order[left + 1] - len(known)
            first[held] = np.minimum(first[held], known_docs[order[left]])
            fresh[held] = False
        return fresh

    def scan(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """First document of each window among this batch and the levels, which stay as they are."""
        array, first, place = _suffix_array(windows, docs)
        self._scan(array, first)
        return first[place]

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """As ``scan``; then what is new in the batch becomes a level, and levels of about equal size merge."""
        array, first, place = _suffix_array(windows, docs)
        fresh = self._scan(array, first)
        if fresh.any():
            self.levels.append((array[fresh], first[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            both, docs_of = np.concatenate([b, a]), np.concatenate([y, x])
            order = np.argsort(both, kind="stable")
            self.levels.append((both[order], docs_of[order]))
        return first[place]


def _judge(rows: pa.Table) -> pa.Table:
    """Spans of a bucket's contexts that repeat an earlier document, for each batch."""
    col = {n: rows.column(n).to_pylist() for n in (*_BLOBS, "batch")}

    def all_of(name: str, kind) -> list[np.ndarray]:
        return [np.frombuffer(x, kind) for x in col[name]]

    keys = np.concatenate([_unpack(x) for x in col["keys"]])
    sizes = np.concatenate(all_of("sizes", np.uint8)).astype(np.int64)
    offsets = np.concatenate(all_of("offsets", np.uint8)).astype(np.int64)
    data = np.frombuffer(b"".join(col["data"]), np.uint8)
    starts = np.cumsum(sizes) - sizes
    n_contexts = [len(x) for x in col["sizes"]]
    base = np.cumsum([0, *n_contexts[:-1]])
    context = np.concatenate([x.astype(np.int64) + b for x, b in zip(all_of("context", np.uint32), base, strict=True)])
    row_at = [x.astype(np.int64) for x in all_of("row_at", np.uint32)]
    doc = np.concatenate([d[r] for d, r in zip(all_of("docs", np.int64), row_at, strict=True)])
    row = np.concatenate([x[r] for x, r in zip(all_of("rows", np.uint32), row_at, strict=True)])
    batch = np.repeat(np.array(col["batch"], np.int64), [len(r) for r in row_at])
    low = np.concatenate(all_of("low", np.uint32)).astype(np.int64)
    del col

    # equal contexts of all batches become one
    digest = _context_hashes(data, starts, sizes) + _mix(keys, 4) * _U(131) + offsets.astype(_U)
    _, one, number = np.unique(digest, return_index=True, return_inverse=True)
    keys, sizes, offsets, starts = keys[one], sizes[one], offsets[one], starts[one]
    mine = number[context]
    first = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(first, mine, doc)

    # their windows, batch by batch in order of first document
    n_windows = sizes - LENGTH + 1
    by_first = np.argsort(first, kind="stable")
    family, window_first = LevelFamily(), np.zeros(int(n_windows.sum()), np.int64)
    window_at = np.zeros(len(one), np.int64)
    window_at[by_first] = np.cumsum(n_windows[by_first]) - n_windows[by_first]
    done = 0
    while done < len(by_first):
        upto = done + max(1, int(np.searchsorted(np.cumsum(n_windows[by_first[done : done + SORTED]]), SORTED, side="right")))
        part = by_first[done:upto]
        places = _ranges(starts[part], n_windows[part])
        windows = data[places[:, None] + np.arange(LENGTH)].view(f"S{LENGTH}").ravel()
        at = window_at[part[0]]
        window_first[at : at + len(places)] = family.add(windows, np.repeat(first[part], n_windows[part]))
        done = upto
    del family

    # spans: runs of windows that an earlier document holds
    spans = []
    for at in range(0, len(mine), SORTED // 16):
        part = np.arange(at, min(at + SORTED // 16, len(mine)))
        n = n_windows[mine[part]]
        who = np.repeat(np.arange(len(part)), n)
        repeated = window_first[_ranges(window_at[mine[part]], n)] < doc[part][who]
        begins = repeated & np.concatenate([[True], ~repeated[:-1] | (who[1:] != who[:-1])])
        ends = repeated & np.concatenate([~repeated[1:] | (who[1:] != who[:-1]), [True]])
        window = low[part][who] + np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        spans.append((part[who[begins]], window[begins], window[ends] + LENGTH))
    which, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))

    order = np.lexsort((begin, row[which], batch[which]))
    which, begin, end = which[order], begin[order], end[order]
    owners, at = np.unique(batch[which], return_index=True)
    out = []
    for k, (p, q) in zip(owners, _stretches(at, len(which)), strict=True):
        packed = np.stack([row[which[p:q]].astype(np.uint32), begin[p:q].astype(np.uint32), end[p:q].astype(np.uint32)])
        out.append({"batch": int(k), "spans": packed.tobytes()})
    return pa.Table.from_pylist(out, schema=pa.schema([("batch", pa.int32()), ("spans", pa.binary())]))


# --- 4: cut ----------------------------------------------------------------------------------------


def _cut(rows: pa.Table, found: pa.Table) -> pa.Table:
    ids, texts, _ = _texts(rows)
    blobs = [np.frombuffer(x, np.uint32).reshape(3, -1) for x in found.column("spans").to_pylist()]
    row, begin, end = np.concatenate([np.zeros((3, 0), np.uint32), *blobs], axis=1).astype(np.int64)
    order = np.argsort(row, kind="stable")
    row, begin, end = row[order], begin[order], end[order]
    bound = np.searchsorted(row, np.arange(len(ids) + 1))
    kept, removed, spans = [], [], []
    for k, text in enumerate(texts):
        p, q = bound[k], bound[k + 1]
        if p == q:
            kept.append(text)
            removed.append(0)
            spans.append(0)
            continue
        depth = np.zeros(len(text) + 1, np.int32)
        np.add.at(depth, begin[p:q], 1)
        np.add.at(depth, end[p:q], -1)
        gone = np.cumsum(depth[:-1]) > 0
        kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        removed.append(int(gone.sum()))
        spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
    sums = [hashlib.sha256(x).hexdigest() for x in kept]
    return pa.table(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
            pa.array(spans, pa.int64()), pa.array(sums, pa.string()), pa.array(kept, pa.binary()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def dedup_substrings(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_bytes`` the remaining bytes.

    The batched texts are one exchange that all three steps reading them reuse.
    """
    total = text_bytes(docs)
    batches, buckets = parts_for(total, BATCH_BYTES, 12), parts_for(total, BUCKET_BYTES, 12)
    text = empty_if_null().cast("binary").alias("text")
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).cast("int").alias("batch")
    own = docs.where("doc_id is not null").select(number, "doc_id", text)
    dealt = own.repartitionById(batches, "batch").groupBy("batch")
    keys = dealt.applyInArrow(_send_keys(buckets), "bucket int, batch int, keys binary").repartitionById(buckets, "bucket")
    answers = keys.groupBy("bucket").applyInArrow(_answer_keys, "batch int, bucket int, keys binary").repartitionById(batches, "batch")
    contexts = dealt.cogroup(answers.groupBy("batch")).applyInArrow(
        _send_contexts(buckets), "bucket int, batch int, " + ", ".join(f"{n} binary" for n in _BLOBS)
    )
    spans = contexts.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(_judge, "batch int, spans binary")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        done = _cut(rows, found) if rows.num_rows else _cut(rows.slice(0, 0), found.slice(0, 0))
        return done if keep_bytes else done.drop_columns(["kept"])

    judged = dealt.cogroup(spans.repartitionById(batches, "batch").groupBy("batch")).applyInArrow(cut, out + (", kept binary" if keep_bytes else ""))
    # rows without a doc_id take no part: they are whole, wherever they are
    none = F.lit(0).cast("long")
    whole = docs.where("doc_id is null").select("doc_id", text).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), *([F.col("text").alias("kept")] if keep_bytes else []),
    )
    return judged.unionByName(whole)
