"""Approximate nearest neighbours by inner product: one vantage-point tree for each shard.

Largest inner product becomes nearest neighbour by one more coordinate, sqrt(M^2 - |x|^2) with M the
shard's largest norm (0 for queries), so the triangle inequality holds.  A tree halves its points by their
distance to a vantage point down to leaves of ``LEAF`` points and keeps, for each half, the range of
distances seen.  For a query, the ranges bound the distance to any point of a leaf from below; leaves are
visited in order of that bound, and a leaf is skipped when ``factor`` times the bound exceeds the distance
of the k-th neighbour found so far.  ``factor`` 1 makes the search exact, larger factors skip more.

A worker holds one shard at a time: shard rows come first, then its queries stream past in batches.
Final scores are computed in double precision on the original vectors, the same way for equal vectors,
and ties go to the smaller id.  Vectors that are null, zero, or hold null or non-finite components take no
part, nor do null ids; a query is compared only with vectors of its own length; rows sharing its id are
left out as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEAF = 128
SHARD_ROWS = 8192
QUERY_BLOCK = 512
PAIRS = 1 << 18  # candidate pairs held before only the best k of each query stay


@dataclass
class VantageTree:
    ids: np.ndarray
    points: np.ndarray  # original vectors, double
    leaves: list[np.ndarray] = field(default_factory=list)
    bounds: list[list[tuple[int, float, float]]] = field(default_factory=list)  # of a leaf: (vantage, least, most)
    vantages: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        norms = np.einsum("ij,ij->i", self.points, self.points)
        self.top = float(norms.max())
        self.lifted = np.column_stack([self.points, np.sqrt(np.maximum(self.top - norms, 0.0))])
        self.squares = np.einsum("ij,ij->i", self.lifted, self.lifted)
        rng = np.random.Generator(np.random.PCG64(len(self.ids)))
        waiting = [(np.arange(len(self.ids)), [])]
        while waiting:
            rows, path = waiting.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                self.bounds.append(path)
                continue
            # the point farthest from a random one spreads the distances
            far = self._distances(rows, int(rng.choice(rows)))
            v = int(rows[far.argmax()])
            d = self._distances(rows, v)
            half = np.argsort(d, kind="stable")
            mid = len(rows) // 2
            for part in (half[:mid], half[mid:]):
                waiting.append((rows[part], [*path, (len(self.vantages), float(d[part].min()), float(d[part].max()))]))
            self.vantages.append(v)

    def _distances(self, rows: np.ndarray, v: int) -> np.ndarray:
        return np.sqrt(np.maximum(self.squares[rows] + self.squares[v] - 2 * self.lifted[rows] @ self.lifted[v], 0.0))

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[list, list]:
        """Ids and scores of the k best of this shard for each query, best first; fewer if there are fewer."""
        m = len(qids)
        lifted = np.column_stack([queries, np.zeros(m)])
        q2 = np.einsum("ij,ij->i", queries, queries)
        size, eps = queries.shape[1] + 8, np.finfo(np.float64).eps
        # bounds of rounding: in distances, which are roots of differences, and between fast and exact scores
        slack = 8 * np.sqrt(size * eps) * (np.sqrt(self.top) + np.sqrt(q2))
        blur = 4 * size * eps * np.sqrt(self.top * q2)
        low = np.zeros((m, len(self.leaves)))
        if self.vantages:
            v = self.lifted[self.vantages]
            away = np.sqrt(np.maximum(q2[:, None] + self.squares[self.vantages][None] - 2 * lifted @ v.T, 0.0))
            for leaf, path in enumerate(self.bounds):
                for at, least, most in path:
                    np.maximum(low[:, leaf], np.maximum(least - away[:, at], away[:, at] - most), out=low[:, leaf])
        order = np.argsort(low, axis=1, kind="stable")
        best = np.full((m, k), -np.inf)
        least = np.full(m, -np.inf)  # the k-th best score so far
        rows_of_m = np.arange(m)
        none = np.zeros(0, np.int64)
        done, waiting, n_waiting = (none, none, np.zeros(0)), [], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            asked, rows, fast = map(np.concatenate, zip(*waiting, strict=True))
            ok = fast >= (least - blur)[asked]
            asked, rows = asked[ok], rows[ok]
            new = (asked, rows, self._exact(rows, queries, asked))
            return self._first(*map(np.concatenate, zip(done, new, strict=True)), k)

        for step in range(len(self.leaves)):
            leaf_of = order[:, step]
            radius = np.sqrt(np.maximum(q2 + self.top - 2 * least, 0.0))
            active = rows_of_m[factor * low[rows_of_m, leaf_of] <= radius + slack]
            if not len(active):
                continue
            by_leaf = active[np.argsort(leaf_of[active], kind="stable")]
            for part in np.split(by_leaf, np.flatnonzero(np.diff(leaf_of[by_leaf])) + 1):
                rows = self.leaves[leaf_of[part[0]]]
                s = queries[part] @ self.points[rows].T
                s[self.ids[rows][None] == qids[part][:, None]] = -np.inf
                both = np.concatenate([best[part], s], axis=1)
                best[part] = np.partition(both, len(rows), axis=1)[:, len(rows) :]
                least[part] = best[part].min(axis=1)
                # every row that may be among the k best or tie with the last of them
                at, which = np.nonzero((s >= (least - blur)[part][:, None]) & (s > -np.inf))
                waiting.append((part[at], rows[which], s[at, which]))
                n_waiting += len(at)
                if n_waiting > PAIRS:
                    done, waiting, n_waiting = settled(), [], 0
        if waiting:
            done = settled()
        asked, rows, scores = done
        cut = np.searchsorted(asked, rows_of_m[1:])
        return np.split(self.ids[rows], cut), np.split(scores, cut)

    def _exact(self, rows: np.ndarray, queries: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Scores of pairs, summed in order: the same sum for equal vectors."""
        out, some = np.empty(len(rows)), max(1, (1 << 20) // queries.shape[1])
        for at in range(0, len(rows), some):
            part = slice(at, at + some)
            out[part] = np.cumsum(self.points[rows[part]] * queries[asked[part]], axis=1)[:, -1]
        return out

    def _first(self, asked: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """The k best pairs of each query, equal scores by id."""
        order = np.lexsort((self.ids[rows], -scores, asked))
        asked, rows, scores = asked[order], rows[order], scores[order]
        ok = np.arange(len(asked)) - np.searchsorted(asked, asked) < k
        return asked[ok], rows[ok], scores[ok]


def usable(column: str) -> Column:
    """The vector can take part: not null, not zero, only finite components."""
    c = F.col(column)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(c, lambda x: x != 0), F.lit(False))


def _matrix(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    vec = batch.column("vec").take(pa.array(rows))
    flat, at = vec.values.to_numpy(zero_copy_only=False), vec.offsets.to_numpy()
    return batch.column("id").take(pa.array(rows)).to_numpy(), [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _by_length(ids: np.ndarray, vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    lengths = np.array([len(v) for v in vectors])
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield ids[at], np.array([vectors[i] for i in at], np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int, factor: float, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, the k nearest found of all rows.

    ``vectors`` has vec_id and embedding.  Queries go to every shard; only k rows a query and shard come back.
    """
    own = vectors.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), is_query.alias("q"))
    own = own.where(F.col("id").isNotNull() & usable("vec"))
    shards = max(1, -(-vectors.select("vec_id").count() // shard_rows))
    index = own.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vec")
    asked = own.where("q").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "id", "vec")
    # one shard a task: the shard's number is the partition's
    dealt = index.unionByName(asked).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vecs, trees = None, [], [], None
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            for s in np.unique(shard):
                if s != current:
                    current, ids, vecs, trees = s, [], [], None
                rows = np.flatnonzero((shard == s) & (kind == 0))
                if len(rows):
                    some, vs = _matrix(batch, rows)
                    ids.append(some)
                    vecs += vs
                rows = np.flatnonzero((shard == s) & (kind == 1))
                if not len(rows) or not ids:
                    continue
                if trees is None:
                    trees = {x.shape[1]: VantageTree(i, x) for i, x in _by_length(np.concatenate(ids), vecs)}
                for at in range(0, len(rows), QUERY_BLOCK):
                    for qids, q in _by_length(*_matrix(batch, rows[at : at + QUERY_BLOCK])):
                        if q.shape[1] in trees:
                            found, scores = trees[q.shape[1]].search(qids, q, k, factor)
                            n = [len(x) for x in found]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.repeat(qids, n)), pa.array(np.concatenate(found)), pa.array(np.concatenate(scores))],
                                names=["query_id", "vec_id", "score"],
                            )

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
