"""Toxicity by a classifier chain over labelled categories.

Categories are predicted one after the other.  Each has a linear (logistic) model over the words and word
beginnings of a document and a few measures of its form; every model but the first also gets the probabilities of the
categories before it.  In training those probabilities are out-of-fold predictions (``FOLDS`` folds by hash
of doc_id), so a later model sees earlier ones as they will be on new documents; in prediction they come
from models fitted on all training rows.

Training uses at most ``sample`` labelled rows with non-null text and labels (those with the smallest hash
of doc_id), a documented bound; of rows that share a doc_id each text counts.  All words and word beginnings that
``LEAST_DOCS`` of them hold are features, and come back to the driver as numbers, so what it holds is bounded by the
sample.  Where a category has only one class, its probability is constant; without labels it is 0.
Prediction reads whole texts; null and empty texts get probabilities 0; every row is kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import map_arrow, quoted, schema_of

SAMPLE = 4000
FOLDS = 5
LEAST_DOCS = 5
#: Lengths of the word beginnings that count as features beside the words.
BEGINNINGS = (4, 5, 6, 7)
MEMO_WORDS = 100_000
#: Least scale (a quarter of the squared log ratio between classes) at which a word takes part.
LEAST_SCALE = 0.05
#: Texts whose features a worker holds at once.
AT_ONCE = 256
THRESHOLD = 0.5
WORDS = re.compile(r"[^\W\d_]+")
FORM = 6


def form(text: str, words: list[str]) -> list[float]:
    """Measures of form: length, capitals, symbols, digits, different words, repeated lines."""
    n = len(text)
    letters = sum(map(len, words))
    lines = text.split("\n")
    raw = text.encode("utf-8", "replace")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    symbols = len(raw) - len(raw.translate(None, b"#$%&*|!<>{}[]~^=+"))
    return [
        math.log1p(n) / 10,
        upper / max(1, letters),
        symbols / max(1, n),
        digits / max(1, n),
        len(set(words)) / max(1, len(words)),
        1 - len(set(lines)) / max(1, len(lines)),
    ]


def features_of(word: str) -> list[str]:
    """The word, and the beginnings of a longer word (with a mark, as they are no words)."""
    return [word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)]


def weights_of(counts: Counter | dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their weights: sqrt(count) * idf, scaled to unit length."""
    if not counts:
        return np.zeros(0, np.int64), np.zeros(0)
    at = np.fromiter(counts.keys(), np.int64, len(counts))
    x = np.sqrt(np.fromiter(counts.values(), np.float64, len(counts))) * idf[at]
    return at, x / math.sqrt(float(x @ x))


@dataclass
class Rows:
    """Sparse rows: word numbers and weights, row starts; dense columns beside them."""

    at: np.ndarray
    x: np.ndarray
    starts: np.ndarray
    dense: np.ndarray

    def product(self, w: np.ndarray, v: np.ndarray, b: float) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.dense)), np.diff(np.append(self.starts, len(self.at))))
        return np.bincount(owner, self.x * w[self.at], minlength=len(self.dense)) + self.dense @ v + b

    def take(self, rows: np.ndarray) -> Rows:
        ends = np.append(self.starts, len(self.at))
        each = [np.arange(ends[r], ends[r + 1]) for r in rows]
        sizes = np.array([len(e) for e in each], np.int64)
        pick = np.concatenate([np.zeros(0, np.int64), *each])
        return Rows(self.at[pick], self.x[pick], np.cumsum(sizes) - sizes, self.dense[rows])

    def beside(self, column: np.ndarray) -> Rows:
        return Rows(self.at, self.x, self.starts, np.column_stack([self.dense, column]))


@dataclass
class Linear:
    w: np.ndarray
    v: np.ndarray
    b: float

    def probabilities(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(rows.product(self.w, self.v, self.b), -30, 30)))


def fit(rows: Rows, y: np.ndarray, words: int, ridge: float = 2e-4, steps: int = 150, rate: float = 0.3) -> Linear:
    """Logistic regression by Adam on all rows; a constant where there is one class.

    Words enter scaled by the square of the log ratio of their weights in the two classes, so that the few words
    that tell a category stand out from the many that do not; the scale is folded into the weights.
    """
    n, d = len(y), rows.dense.shape[1]
    mean = float(np.clip(y.mean() if n else 0.0, 1e-6, 1 - 1e-6))
    model = Linear(np.zeros(words), np.zeros(d), math.log(mean / (1 - mean)))
    if not n or y.min() == y.max():
        return model
    owner = np.repeat(np.arange(n), np.diff(np.append(rows.starts, len(rows.at))))
    mine, one = y[owner] > 0, float(rows.x.mean()) if len(rows.x) else 1.0
    yes = np.bincount(rows.at[mine], rows.x[mine], minlength=words) / one + 1.0
    no = np.bincount(rows.at[~mine], rows.x[~mine], minlength=words) / one + 1.0
    scale = np.log((yes / (y.sum() + 2)) / (no / (n - y.sum() + 2))) ** 2 / 4
    told = scale[rows.at] >= LEAST_SCALE  # words that tell nothing get no weight
    at, owner, x = rows.at[told], owner[told], (rows.x * scale[rows.at])[told]
    theta = np.concatenate([model.w, model.v, [model.b]])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, v, b = theta[:words], theta[words:-1], theta[-1]
        z = np.bincount(owner, x * w[at], minlength=n) + rows.dense @ v + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        grad = np.concatenate([np.bincount(at, x * g[owner], minlength=words), rows.dense.T @ g, [g.sum()]])
        grad[:-1] += ridge * theta[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Linear(theta[:words] * np.where(scale >= LEAST_SCALE, scale, 0.0), theta[words:-1], float(theta[-1]))


@dataclass
class ToxicityChain:
    categories: list[str]
    words: dict[str, int] = field(default_factory=dict)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0))
    models: list[Linear] = field(default_factory=list)
    memo: dict[str, list[int]] = field(default_factory=dict)  # of a worker, bounded

    def rows_of(self, texts: list[str]) -> Rows:
        known, memo, at, x, starts, dense, n = self.words, self.memo, [], [], [], [], 0
        for text in texts:
            words = WORDS.findall(text.lower())
            counts: dict[int, int] = {}
            for word, times in Counter(words).items():
                own = memo.get(word)
                if own is None:
                    if len(memo) >= MEMO_WORDS:
                        memo.clear()
                    own = memo[word] = [known[f] for f in features_of(word) if f in known]
                for f in own:
                    counts[f] = counts.get(f, 0) + times
            a, b = weights_of(counts, self.idf)
            starts.append(n)
            n += len(a)
            at.append(a)
            x.append(b)
            dense.append(form(text, words))
        return Rows(
            np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *x]), np.array(starts, np.int64),
            np.array(dense, np.float64).reshape(len(texts), FORM),
        )

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories): each category's probability given the ones before it."""
        if not self.models:
            return np.zeros((len(texts), len(self.categories)))
        if len(texts) > AT_ONCE:  # features of a whole batch would take many times its size
            return np.concatenate([self.probabilities(texts[k : k + AT_ONCE]) for k in range(0, len(texts), AT_ONCE)])
        rows = self.rows_of([t or "" for t in texts])
        out = []
        for model in self.models:
            out.append(model.probabilities(rows))
            rows = rows.beside(out[-1])
        p = np.column_stack(out)
        p[[not t for t in texts]] = 0.0
        return p


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int = SAMPLE) -> ToxicityChain:
    """Fit the chain; ``categories`` maps each name, in the order of the chain, to an SQL condition over ``labels``."""
    spark, names = docs.sparkSession, list(categories)
    marked = labels.select("doc_id", *(F.expr(c).cast("int").alias(f"y{k}") for k, c in enumerate(categories.values())))
    marked = marked.dropna().groupBy("doc_id").agg(*(F.max(f"y{k}").alias(f"y{k}") for k in range(len(names))))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()  # the documented bound
    chain = ToxicityChain(names)
    if not chosen:
        return chain
    y_of = {r["doc_id"]: [r[f"y{k}"] for k in range(len(names))] for r in chosen}
    listed = spark.createDataFrame([(i,) for i in sorted(y_of)], "doc_id long")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("text is not null").join(F.broadcast(listed), "doc_id", "left_semi")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, n, dense = [], [], []
        for text in batch.column("text").to_pylist():
            found = WORDS.findall(text.lower())
            counts: Counter[str] = Counter()
            for word, times in Counter(found).items():
                for f in features_of(word):
                    counts[f] += times
            words.append(list(counts))
            n.append(list(counts.values()))
            dense.append(form(text, found))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("mark"), pa.array(words, pa.list_(pa.string())),
                pa.array(n, pa.list_(pa.int32())), pa.array(dense, pa.list_(pa.float64())),
            ],
            names=["doc_id", "mark", "words", "n", "form"],
        )

    counted = map_arrow(texts, count, "doc_id long, mark long, words array<string>, n array<int>, form array<double>").persist()
    common = counted.select(F.explode("words").alias("word")).groupBy("word").count().where(F.col("count") >= LEAST_DOCS)
    top = common.orderBy(F.desc("count"), "word").collect()
    chain.words = {r["word"]: k for k, r in enumerate(top)}
    # only listed words come to the driver
    sent = spark.sparkContext.broadcast(chain.words)

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, n = [], []
        for words, counts in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist(), strict=True):
            both = [(sent.value[w], c) for w, c in zip(words, counts, strict=True) if w in sent.value]
            at.append([a for a, _ in both])
            n.append([c for _, c in both])
        kind = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("mark"), pa.array(at, kind), pa.array(n, kind), batch.column("form")],
            names=["doc_id", "mark", "at", "n", "form"],
        )

    numbered = map_arrow(counted, number, "doc_id long, mark long, at array<int>, n array<int>, form array<double>")
    rows = numbered.toArrow().combine_chunks().sort_by([("doc_id", "ascending"), ("mark", "ascending")])
    counted.unpersist()
    n_rows = rows.num_rows
    chain.idf = np.log((1 + n_rows) / (1 + np.array([r["count"] for r in top], float))) + 1
    flat = lambda c: rows.column(c).combine_chunks() if n_rows else None
    at, n, forms = flat("at"), flat("n"), flat("form")
    if n_rows:
        numbers, starts = at.flatten().to_numpy().astype(np.int32), np.diff(at.offsets.to_numpy(), prepend=0)[1:]
        x = np.sqrt(n.flatten().to_numpy()) * chain.idf[numbers]
        owner = np.repeat(np.arange(n_rows), starts)
        x /= np.sqrt(np.bincount(owner, x * x, minlength=n_rows))[owner]
        data = Rows(numbers, x, np.cumsum(starts) - starts, forms.flatten().to_numpy().reshape(n_rows, FORM))
    else:
        data = Rows(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, FORM)))
    ids = rows.column("doc_id").to_numpy()
    y = np.array([y_of[i] for i in ids.tolist()], float).reshape(n_rows, len(names))
    fold = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % FOLDS
    for k in range(len(names)):
        chain.models.append(fit(data, y[:, k], len(top)))
        if k + 1 < len(names):
            before = np.zeros(n_rows)
            for f in range(FOLDS):
                held, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                before[held] = fit(data.take(rest), y[rest, k], len(top)).probabilities(data.take(held))
            data = data.beside(before)
    return chain


def score(docs: DataFrame, chain: ToxicityChain, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs``, then p_<category> double for each category."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # the words of the sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value.probabilities(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in keep), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(p.shape[1]))],
            names=[*keep, *(f"p_{c}" for c in chain.categories)],
        )

    own = docs.select(*map(quoted, dict.fromkeys([*keep, "text"])))
    return map_arrow(own, run, schema_of(own, keep, ", ".join(f"p_{c} double" for c in chain.categories)))


def without(docs: DataFrame, chain: ToxicityChain, category: str, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose probability of ``category`` is below ``threshold``."""
    sent, at = docs.sparkSession.sparkContext.broadcast(chain), chain.categories.index(category)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = sent.value.probabilities(batch.column("text").to_pylist())
        return batch.filter(pa.array(p[:, at] < threshold))

    return map_arrow(docs, run, docs.schema)
