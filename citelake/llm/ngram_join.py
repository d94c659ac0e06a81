"""N-gram Jaccard join with filters under several global token orders.

Each document's set holds its distinct word shingles.  Documents with equal sets form a class, found by a
digest of the set.  Between classes, a pair can only reach the similarity if the first tokens of both sets
under any global order of tokens share one; so

1. an inverted index of the first tokens under one order (rare shingles first, then by hash) gives lists of
   classes; within a list, every class is paired with the list's first one only;
2. pairs whose signatures (a bit for each bucket of tokens that a set has, under a byte for each token) leave too
   little in common are dropped; pairs must also share first tokens under further orders (other hashes) - the filters
   are intersected;
3. what is left is verified on the whole sets, and linked classes are joined to components;
4. lists that still hold more than one component are tested completely across components, with the positions
   in the index's order bounding the overlap and the filters of the further orders before each verification:
   short lists (``SHORT_LIST``) by pairs (steps 2, 3), longer ones in blocks of about ``LIST_BLOCK`` classes and
   ``LIST_TOKENS`` tokens, each a group that gives back only links that join components.  Blocks get signatures first,
   then the whole sets of those classes that still have a partner.  So no group of copies is expanded into its pairs,
   and no component is lost.

Whole sets take twice the place of the texts, so they are made only for what the signatures leave, and in shares of
bounded size (``SHARE_TOKENS``), one after the other.  How many pairs share a first token by chance grows faster than the
input; such pairs end at the signatures.

What a list needs to know of all its members (its first class, its size) is a minimum or a sum combined before the
shuffle and an equi-join, which adaptive execution splits where a token is hot; no list goes through one task.

How rare a shingle is only shapes the order, which any fixed numbers do correctly: every task reports, for some
``REPORT_TOKENS`` shingles at a time, those that occur in at least ``OFTEN`` different sets, the reports are summed over all documents,
and the ``MOST_LEVELS`` most frequent ones are held by all workers.

Words are runs of other characters than space, tab, line feed, vertical tab, form feed and carriage return,
with A-Z lower-cased.  A document with fewer words than a shingle has its whole sequence as its one shingle;
without words its set is empty and it links with nothing.  Nulls in the text count as empty.  Rows with a
null doc_id take no part and get a null component.  Rows that share a doc_id count each by its own text: they can
belong to different components, which then may have the same smallest doc_id and differ in ``component``.  Texts of
any length go through in blocks.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import empty_if_null, free_name, map_arrow, quoted, slices, small_batches, stage, unstage
from citelake.llm.components import components

WORDS = 5
PERCENT = 80
OFTEN = 3
MOST_LEVELS = 200_000
SHORT_LIST, LIST_BLOCK, LIST_TOKENS = 24, 2048, 1 << 20
#: a share of whole sets to verify: tokens that travel with its pairs or blocks (as a part of all tokens, or so many), and its pairs
SHARE_PART, SHARE_TOKENS, SHARE_PAIRS = 1 / 8, 32 << 20, 100_000
#: shingles that report the common ones among them together
REPORT_TOKENS = 4 << 20
#: text bytes hashed at once
BLOCK = 1 << 19

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_P = 0x9FB21C651E98DF25  # odd; its powers weigh the bytes of a word
_POWERS: list[np.ndarray] = []
_Q = [_U(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(64)]
_MAP_BITS = 22


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x + _U((salt * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte weight and of its inverse, up to ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 16)
        _POWERS[:] = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            steps = np.full(n, _U(base))
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~_GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((_LOWER[raw].astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[str], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order; texts are hashed together in blocks."""
    at = 0
    while at < len(texts):
        block, size = [], 0
        while at < len(texts) and (not block or size + len(texts[at]) <= BLOCK):
            block.append(texts[at].encode("utf-8", "surrogatepass"))
            size += len(block[-1]) + 1
            at += 1
        starts, hashes = word_hashes(b"\n".join(block))
        first = np.cumsum([0] + [len(b) + 1 for b in block])
        bounds = np.searchsorted(starts, first)
        all_shingles = np.zeros(max(0, len(hashes) - words + 1), _U)
        for j in range(words if len(all_shingles) else 0):
            all_shingles += hashes[j : len(hashes) - words + 1 + j] * _Q[j]
        all_shingles = mix(all_shingles)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(all_shingles[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * np.array(_Q[: b - a], _U)).sum(dtype=_U)[None])
            else:
                yield hashes[:0]


def set_digest(s: np.ndarray) -> int:
    """64-bit digest of a set, as a signed number."""
    return int((mix(s, 7).sum(dtype=_U) ^ mix(np.array([len(s)], _U), 8)[0]).astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Size of a set, then a bit for each of 2**k buckets (4 to 8 for a token) that one of its tokens is in."""
    buckets = max(64, 1 << (4 * len(s) - 1).bit_length())
    held = np.zeros(buckets, bool)
    held[(s & _U(buckets - 1)).astype(np.int64)] = True
    return np.array([len(s)], _U).tobytes() + np.packbits(held, bitorder="little").tobytes()


def halved(bits: np.ndarray) -> np.ndarray:
    """Signature bits (numbers of 64 bits, the last axis) over half as many buckets."""
    half = bits.shape[-1] // 2
    return bits[..., :half] | bits[..., half:]


def may_reach(n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Which sets (sizes, rows of signature bits as many as ``bits``) can be similar to one: a bucket that only one
    of two sets has holds a token that the other one lacks."""
    common = np.minimum(n - np.bitwise_count(bits & ~others).sum(1, dtype=np.int64), sizes - np.bitwise_count(others & ~bits).sum(1, dtype=np.int64))
    return 100 * common >= percent * (n + sizes - common)


def signatures_allow(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    n, m, x, y = int(x[0]), int(y[0]), x[1:], y[1:]
    if 100 * min(n, m) < percent * max(n, m):
        return False
    while len(x) != len(y):
        x, y = (halved(x), y) if len(x) > len(y) else (x, halved(y))
    return bool(may_reach(n, x, np.array([m]), y[None], percent)[0])


def with_partner(signatures: list[bytes], roots: np.ndarray, percent: int) -> np.ndarray:
    """Which sets have one of another root that their signatures allow them to be similar to."""
    rows = [np.frombuffer(x, _U) for x in signatures]
    sizes, widths = np.array([int(r[0]) for r in rows]), np.array([len(r) - 1 for r in rows])
    out = np.zeros(len(rows), bool)
    for width in np.unique(widths).tolist():
        # similar sets differ in size by less than a factor of 2 (if over 50 %), in buckets by one halving or a few
        own = np.flatnonzero(widths == width)
        wider = np.flatnonzero((widths > width) & (100 * sizes[own].max() >= percent * sizes))
        both = np.concatenate([own, wider])
        bits = np.zeros((len(both), width), _U)
        for k, x in enumerate(both.tolist()):
            b = rows[x][1:]
            while len(b) > width:
                b = halved(b)
            bits[k] = b
        n, root = sizes[both], roots[both]
        for k in range(len(own)):
            able = (root != root[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
            able[:k] = False
            able = np.flatnonzero(able)
            able = able[may_reach(int(n[k]), bits[k], n[able], bits[able], percent)]
            if len(able):
                out[both[able]] = out[own[k]] = True
    return out


def first_tokens(n: int, percent: int = PERCENT) -> int:
    """How many first tokens of a set of ``n`` a similar set must meet."""
    return n + (-percent * n) // 100 + 1


class Levels:
    """Frequency levels of the most frequent shingles; all others have level 0."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.level = np.minimum(62, 1 + np.log2(np.maximum(counts[order], 1)).astype(np.int64)).astype(_U)
        self.seen = np.zeros(1 << _MAP_BITS, bool)
        self.seen[self.hashes >> _U(64 - _MAP_BITS)] = True

    def order(self, s: np.ndarray) -> np.ndarray:
        """A number for each token: rarer levels first, then by hash."""
        out = mix(s, 1) >> _U(6)
        maybe = np.flatnonzero(self.seen[s >> _U(64 - _MAP_BITS)])
        if len(maybe) and len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, s[maybe]), len(self.hashes) - 1)
            same = self.hashes[at] == s[maybe]
            out[maybe[same]] |= self.level[at[same]] << _U(58)
        return out


def prefix(s: np.ndarray, order: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set under an order, in that order."""
    k = first_tokens(len(s), percent)
    if k < len(s):
        few = np.argpartition(order, k - 1)[:k]
        return s[few[np.argsort(order[few])]]
    return s[np.argsort(order)]


def document_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of two kinds: each document's set size, digest and signature, and each batch's frequent shingles with counts."""

    def report(pool: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        tokens = np.sort(np.concatenate(pool))
        edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
        n = np.diff(edge)
        return tokens[edge[:-1]][n >= OFTEN].astype(np.int64), n[n >= OFTEN]

    def rows(ids: pa.Array, marks: pa.Array, n: np.ndarray, digests: np.ndarray, signatures: pa.Array, is_shingle: bool) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(n), is_shingle))
        return pa.RecordBatch.from_arrays(
            [ids, marks, pa.array(n, pa.int64()), pa.array(digests, pa.int64()), signatures, kinds],
            names=["doc_id", "text_mark", "n", "digest", "signature", "is_shingle"],
        )

    def reported(pool: list[np.ndarray]) -> pa.RecordBatch:
        which, n = report(pool)
        return rows(pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.int64()), n, which, pa.nulls(len(n), pa.binary()), True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            sizes, digests, signatures = [], [], []
            for s in shingle_sets(batch.column("text").to_pylist(), words):
                sizes.append(len(s))
                digests.append(set_digest(s))
                signatures.append(signature(s) if len(s) else None)
                if len(s) and digests[-1] not in seen:
                    seen.add(digests[-1])
                    pool.append(s)
                    held += len(s)
            marks = pa.array(signatures, pa.binary())
            yield rows(batch.column("doc_id"), batch.column("text_mark"), np.array(sizes, np.int64), np.array(digests, np.int64), marks, False)
            if held >= REPORT_TOKENS:
                yield reported(pool)
                seen, pool, held = set(), [], 0
        if pool:
            yield reported(pool)

    small_batches(docs.sparkSession)
    own = docs.select("doc_id", empty_if_null()).withColumn("text_mark", F.xxhash64("text"))
    return own.mapInArrow(run, "doc_id long, text_mark long, n long, digest long, signature binary, is_shingle boolean")


def frequency_levels(reports: DataFrame) -> Levels:
    """The most frequent shingles of all documents, at most ``MOST_LEVELS`` (they only shape the order)."""
    rows = reports.where("is_shingle").groupBy("digest").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.desc("n"), "digest").limit(MOST_LEVELS).toArrow()
    return Levels(top["digest"].to_numpy().astype(np.int64).view(_U), top["n"].to_numpy())


def index_rows(docs: DataFrame, levels: Broadcast, words: int, percent: int) -> DataFrame:
    """(token, cls, n, pos) for the first tokens of each set; equal sets of a batch give their rows once."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, cls, size, pos = [], [], [], []
        seen: set[int] = set()
        for s in shingle_sets(batch.column("text").to_pylist(), words):
            if len(s) and (digest := set_digest(s)) not in seen:
                seen.add(digest)
                p = prefix(s, levels.value.order(s), percent)
                tokens.append(p)
                cls.append(np.full(len(p), digest, np.int64))
                size.append(np.full(len(p), len(s), np.int32))
                pos.append(np.arange(len(p), dtype=np.int32))
        if not tokens:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(tokens).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (cls, size, pos))],
            names=["token", "cls", "n", "pos"],
        )

    rows = docs.where("doc_id is not null").select(empty_if_null())
    return map_arrow(rows, run, "token long, cls long, n int, pos int")


def class_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cls, tokens) of the classes in ``wanted`` (cls, doc_id), the tokens as packed sorted numbers.

    ``wanted`` is broadcast: with the classes of at most ``SHARE_PAIRS`` pairs it is bounded, and texts aren't shuffled.
    """
    rows = F.broadcast(wanted).join(docs.select("doc_id", empty_if_null()).where("doc_id is not null"), "doc_id")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        # a doc_id may come in several rows with different texts; the class's own text gives the class's digest
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        kept = [(c, s.tobytes()) for c, s in zip(batch.column("cls").to_pylist(), sets, strict=True) if set_digest(s) == c]
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _ in kept], pa.int64()), pa.array([t for _, t in kept], pa.binary())], names=["cls", "tokens"]
        )

    return map_arrow(rows.select("cls", "text"), run, "cls long, tokens binary")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


#: Salts of the further orders that a pair must share first tokens under.
FURTHER_ORDERS = (2, 3)


def further_prefix(s: np.ndarray, salt: int, percent: int) -> np.ndarray:
    """The first tokens of a set under a further order, sorted for comparing."""
    return np.sort(prefix(s, mix(s, salt), percent))


def passes_filters(a: np.ndarray, b: np.ndarray, percent: int, salts: tuple[int, ...] = FURTHER_ORDERS) -> bool:
    """First tokens in common under each of the further orders: what no similar pair can fail."""
    return all(_shared(further_prefix(a, salt, percent), further_prefix(b, salt, percent)) > 0 for salt in salts)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = _shared(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, docs: DataFrame, first: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that pass the filters and reach the similarity, staged; ``first``: (cls, doc_id, signature).

    Signatures meet all pairs; whole sets are made for the pairs that these leave, share by share.
    """

    def meet(rows: DataFrame, values: DataFrame, fn, schema: str) -> DataFrame:
        u, v = (values.toDF(x, f"value_{x}") for x in "uv")
        return map_arrow(rows.join(u, "u").join(v, "v").select("u", "v", "value_u", "value_v"), fn, schema)

    def close(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = list(zip(batch.column("value_u").to_pylist(), batch.column("value_v").to_pylist(), strict=True))
        n = pa.array([int(np.frombuffer(a, _U, 1)[0] + np.frombuffer(b, _U, 1)[0]) for a, b in both], pa.int64())
        kept = pa.array([signatures_allow(a, b, percent) for a, b in both], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), n], names=["u", "v", "n"]).filter(kept)

    def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = zip(batch.column("value_u").to_pylist(), batch.column("value_v").to_pylist(), strict=True)
        both = ((np.frombuffer(a, _U), np.frombuffer(b, _U)) for a, b in both)
        return batch.select(["u", "v"]).filter(pa.array([passes_filters(a, b, percent) and similar(a, b, percent) for a, b in both], pa.bool_()))

    left = stage(meet(pairs, first.select("cls", "signature"), close, "u long, v long, n long"))
    out = []
    for share in shares(left, ["u"], first):
        sets = stage(class_sets(docs, _members(share).join(first.select("cls", "doc_id"), "cls"), words))
        out.append(stage(meet(share.select("u", "v"), sets, alike, "u long, v long")))
        unstage(sets)
    unstage(left)
    return together(out)


def shares(rows: DataFrame, by: list[str], first: DataFrame) -> list[DataFrame]:
    """``rows`` in parts by a hash of ``by``, so that the tokens ``n`` that travel with a part are bounded, and its rows are few."""
    all_tokens = first.agg(F.sum("n")).first()[0] or 0
    size = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    parts = max(1, -(-size["rows"] // SHARE_PAIRS), -(-size["tokens"] // max(SHARE_TOKENS, int(all_tokens * SHARE_PART))))
    return [rows.where(F.pmod(F.xxhash64(*by), F.lit(parts)) == k) for k in range(parts)]


def together(frames: list[DataFrame]) -> DataFrame:
    out = reduce(DataFrame.unionByName, frames)
    out.staged_paths = [p for f in frames for p in f.staged_paths]
    return out


def _able(n: Column, m: Column, n_pos: Column, m_pos: Column, percent: int) -> Column:
    """Sizes that allow the similarity, if no token before this one is shared: what comes after it bounds the overlap."""
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (F.least(n - n_pos, m - m_pos) * (100 + percent) >= percent * (n + m))


def _of_lists(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with values of their whole lists: combined before the shuffle, then an equi-join."""
    return rows.join(rows.groupBy("token").agg(*(v.alias(k) for k, v in values.items())), "token")


def linked_classes(docs: DataFrame, first: DataFrame, levels: Levels, words: int, percent: int) -> DataFrame:
    """Links (u, v) between classes that connect all classes that similarity connects; ``first``: (cls, doc_id, n, signature)."""
    spark = docs.sparkSession
    index = index_rows(docs, spark.sparkContext.broadcast(levels), words, percent)
    # two numbers a token: what is shuffled here is the most that lies on disk at once
    heads = index.groupBy("token").agg(F.min("cls").alias("head"), F.max("cls").alias("last"))
    heads = stage(heads.where("head < last").drop("last"))
    lists = stage(index.join(heads, "token"))

    own = lists.where("cls = head").select("token", F.col("n").alias("head_n"), F.col("pos").alias("head_pos")).distinct()
    stars = lists.where("cls != head").join(own, "token").where(_able(F.col("n"), F.col("head_n"), F.col("pos"), F.col("head_pos"), percent))
    stars = stage(stars.select(F.col("head").alias("u"), F.col("cls").alias("v")).distinct())
    links = verified(stars, docs, first, words, percent)

    # lists that the links so far leave in more than one component, without rows that no partner's size suits
    roots = components(links)
    rooted = lists.drop("head").distinct().join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    rooted = stage(rooted)
    placed = _of_lists(rooted, low_n=F.min("n"))
    least = F.greatest(F.col("low_n"), F.ceil(F.col("n") * percent / 100))
    placed = placed.where((F.col("n") - F.col("pos")) * (100 + percent) >= percent * (F.col("n") + least)).drop("low_n")
    span = {"size": F.count("*"), "tokens_in": F.sum("n"), "members": F.bit_xor(F.xxhash64("cls")), "low": F.min("root"), "high": F.max("root")}
    several = stage(_of_lists(placed, **span).where("low < high").drop("low", "high"))
    unstage(heads, lists, rooted, roots)

    short = several.where(F.col("size") <= SHORT_LIST)
    a, b = (short.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cls", "n", "pos", "root"))) for s in "uv")
    cross = a.join(b, "token").where(
        (F.col("cls_u") < F.col("cls_v"))
        & (F.col("root_u") != F.col("root_v"))
        & _able(F.col("n_u"), F.col("n_v"), F.col("pos_u"), F.col("pos_v"), percent)
    )
    cross = cross.select(F.col("cls_u").alias("u"), F.col("cls_v").alias("v")).distinct()
    cross = stage(cross.join(stars, ["u", "v"], "left_anti"))
    # of long lists with the same members one is enough, as it is tested completely
    long = several.where(F.col("size") > SHORT_LIST)
    long = long.join(long.groupBy("size", "members").agg(F.min("token").alias("token")).select("token"), "token", "left_semi")
    # one after the other, so that what one step shuffled is free before the next
    by_pairs = verified(cross, docs, first, words, percent)
    by_blocks = block_links(long, docs, first, words, percent)
    unstage(stars, several, cross)
    return together([links, by_pairs, by_blocks])


def block_links(lists: DataFrame, docs: DataFrame, first: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (u, v) between different roots of each list (token, cls, root, size, tokens_in), found in blocks, staged.

    A list of up to ``LIST_BLOCK`` classes and ``LIST_TOKENS`` tokens is one block; a larger one is cut into parts
    by hash, and every two parts (and each part by itself) make a block, so memory is bounded and every pair meets.
    Signatures tell which classes of a block have a partner there; the whole sets of these follow, share by share.
    """
    parts = F.ceil(F.greatest(F.col("size") / LIST_BLOCK, F.col("tokens_in") / LIST_TOKENS)).cast("int")
    part = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = lists.withColumn("parts", parts).withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = ["token", "i", "j"]
    rows = rows.select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cls", "root", F.col("n").cast("long").alias("n"))

    def able(block: pa.Table) -> pa.Table:
        signatures, root = block.column("signature").to_pylist(), block.column("root").to_numpy()
        return block.drop_columns(["signature"]).filter(pa.array(with_partner(signatures, root, percent), pa.bool_()))

    def run(block: pa.Table) -> pa.Table:
        cls, root = block.column("cls").to_numpy(), block.column("root").to_numpy()
        found = join_roots([np.frombuffer(t, _U) for t in block.column("tokens").to_pylist()], root, percent)
        return pa.table([pa.array([cls[x] for x, _ in found], pa.int64()), pa.array([cls[y] for _, y in found], pa.int64())], names=["u", "v"])

    signed = rows.join(first.select("cls", "signature"), "cls").select(*block, "cls", "root", "n", "signature")
    left = stage(signed.groupBy(*block).applyInArrow(able, "token long, i int, j int, cls long, root long, n long"))
    out = []
    for share in shares(left, block, first):
        wanted = share.select("cls").distinct().join(first.select("cls", "doc_id"), "cls")
        sets = stage(class_sets(docs, wanted, words))
        out.append(stage(share.drop("n").join(sets, "cls").groupBy(*block).applyInArrow(run, "u long, v long")))
        unstage(sets)
    unstage(left)
    return together(out)


class Overlaps:
    """Sizes of intersections among sets, counted for many pairs at once over ``columns`` tokens at a time."""

    def __init__(self, sets: list[np.ndarray], columns: int):
        sizes = [len(s) for s in sets]
        _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[number] > 1  # a token of one set adds to no overlap
        column = np.cumsum(times > 1)[number[shared]] - 1
        order = np.argsort(column, kind="stable")
        self.owner, self.column = np.repeat(np.arange(len(sets)), sizes)[shared][order], column[order]
        self.n, self.columns = len(sets), columns
        self.bounds = np.searchsorted(self.column, np.arange(0, int((times > 1).sum()) + columns, columns))

    def counts(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(others)), np.float32)
        for k, (p, q) in enumerate(zip(self.bounds[:-1], self.bounds[1:], strict=True)):
            held = np.zeros((self.n, self.columns), np.float32)
            held[self.owner[p:q], self.column[p:q] - k * self.columns] = 1
            out += held[rows] @ held[others].T
        return out


def join_roots(sets: list[np.ndarray], roots: np.ndarray, percent: int, rows: int = 256, columns: int = 2048) -> list[tuple[int, int]]:
    """Similar pairs that join different roots, enough to connect what similarity connects.

    ``rows`` sets are held against all others at once: first by the filters of the further orders, one after the
    other; only sets with a partner that passes all of them are verified.
    """
    sizes = np.array([len(s) for s in sets])
    filters = [Overlaps([further_prefix(s, salt, percent) for s in sets], columns) for salt in FURTHER_ORDERS]
    whole = Overlaps(sets, columns)
    label = np.unique(roots, return_inverse=True)[1]
    out: list[tuple[int, int]] = []
    for at in range(0, len(sets), rows):
        if (label == label[0]).all():
            break
        mine, others = np.arange(at, min(at + rows, len(sets))), np.arange(len(sets))
        able = label[mine][:, None] != label[None]
        for test in filters:
            mine, others, able = _left(mine, others, able)
            if len(mine):
                able &= test.counts(mine, others) > 0
        mine, others, able = _left(mine, others, able)
        if not len(mine):
            continue
        overlap = whole.counts(mine, others)
        alike = able & (100 * overlap >= percent * (sizes[mine][:, None] + sizes[others][None] - overlap))
        for x, near in zip(mine.tolist(), alike, strict=True):
            for y in others[near].tolist():
                if label[y] != label[x]:
                    out.append((x, y))
                    label[label == label[y]] = label[x]
    return out


def _left(rows: np.ndarray, others: np.ndarray, able: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows and others that still have a pair, and their part of the matrix."""
    r, o = np.flatnonzero(able.any(1)), np.flatnonzero(able.any(0))
    return rows[r], others[o], able[np.ix_(r, o)]


def _members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("u", "v")).alias("cls")).distinct()


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """For every row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach), component
    (a number that no other component has; null without shingles or doc_id) and text_mark (xxhash64 of the text)."""
    docs = docs.select("doc_id", "text")
    reports = stage(document_sets(docs, words))
    each = reports.where("not is_shingle").select("doc_id", "text_mark", F.col("n").alias("n_shingles"), F.col("digest").alias("cls"))
    # documents with one digest have one set, and so one signature
    first = reports.where("not is_shingle and n > 0 and doc_id is not null").groupBy(F.col("digest").alias("cls"))
    first = stage(first.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    levels = frequency_levels(reports)
    each = stage(each)
    unstage(reports)
    links = linked_classes(docs, first, levels, words, percent)
    rooted = components(links)
    joined = first.select("cls", "doc_id").join(rooted.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = joined.groupBy("root").agg(F.min("doc_id").alias("least"))
    of_class = stage(joined.join(least, "root").select("cls", "root", "least"))
    unstage(first, links, rooted)
    able = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    own = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return each.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", own.alias("component_id"), F.when(able, F.col("root")).alias("component"), "text_mark"
    )


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that with the smallest doc_id, then text mark.

    Rows are told apart by doc_id and text: rows that share a doc_id are decided each by its own text; of rows that
    share both, one stays.  Rows without words or without a doc_id stay, all of them.
    """
    mark, nth, names = free_name("text_mark", docs.columns), free_name("row_mark", docs.columns), docs.columns
    found = similar_documents(docs, words, percent)
    kept = found.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "text_mark")).alias("k"))
    kept = kept.select("k.doc_id", F.col("k.text_mark").alias(mark)).distinct()
    marked = docs.withColumn(mark, F.xxhash64(empty_if_null()))
    alike = marked.where("doc_id is not null").join(kept, ["doc_id", mark], "left_semi")
    # of equal (doc_id, text) the row with the smallest hash of all its columns, whichever task reads it
    row = F.struct(*(quoted(c) for c in names))
    one = alike.groupBy("doc_id", mark).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(nth)).select(f"{nth}.*")
    wordless = empty_if_null().rlike(r"^[\x20\x09-\x0D]*$")
    return one.unionByName(docs.where(F.col("doc_id").isNull() | wordless))
