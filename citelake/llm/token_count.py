"""Token counts of a unigram vocabulary without building the tokens: count-only Viterbi.

An Aho-Corasick automaton enumerates the vocabulary matches that end at each character; dynamic
programming carries only the best score and the number of pieces on the best path.  Tie rules are those of
the SentencePiece library's optimised unigram encoder: of equally good paths to a position the one whose
last piece starts earliest stays, and a character without a piece of its own costs the lowest score of the
vocabulary less ten and counts as its UTF-8 bytes (byte fallback).

No piece spans a cut before a space marker (or a line feed), so runs between cuts are scored on their own
and remembered in a bounded table.  The library adds scores over a whole text in single precision; sums
agree exactly as long as they are exact there, which ``rank_scores`` makes sure of for texts of up to some
60,000 pieces.  Nulls in the text count as empty, an empty text has no tokens, every row is kept.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from citelake.llm.common import empty_if_null, map_arrow, texts_of

SPACE = "▁"
#: Fixed values of the SentencePiece library: piece type numbers, model type, and the penalty of an unknown character.
NORMAL, USER_DEFINED, UNUSED, UNIGRAM, UNKNOWN_PENALTY = 1, 4, 5, 1, 10.0
MEMO_RUNS = 500_000


def rank_scores(model_path: str) -> bytes:
    """A unigram model made of a merge-type model's pieces: the score falls with the log of the rank, in 1/16 steps."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = UNIGRAM
    rank = 0
    for p in proto.pieces:
        if p.type == NORMAL:
            p.score = -round(16 * math.log2(rank + 2)) / 16
            rank += 1
    return proto.SerializeToString()


class UnigramCounter:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != UNIGRAM or not proto.trainer_spec.byte_fallback:
            raise ValueError("a unigram model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        scores = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("pieces that hold a space after a letter are not supported")
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.single = {p for p in scores if len(p) == 1}
        self.cut_lines = not any("\n" in p for p in scores)
        self.automaton = ahocorasick.Automaton()
        for p, s in scores.items():
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.memo: dict[str, int] = {}

    def _count_run(self, run: str) -> int:
        n = len(run)
        best: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(run):  # for one end the longest comes first
            ends[end].append(match)
        for end in range(n):
            at = end + 1
            for length, score in ends[end]:
                value = best[at - length] + score
                if best[at] is None or value > best[at]:
                    best[at], count[at] = value, count[at - length] + 1
            if run[end] not in self.single:
                value = best[end] + self.unknown
                if best[at] is None or value > best[at]:
                    best[at], count[at] = value, count[end] + len(run[end].encode("utf-8", "surrogatepass"))
        return count[n]

    def _remembered(self, run: str) -> int:
        known = self.memo.get(run)
        if known is None:
            if len(self.memo) >= MEMO_RUNS:
                self.memo.clear()
            known = self._count_run(run)
            if len(run) <= 64:
                self.memo[run] = known
        return known

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = self.prefix + text.replace(" ", SPACE)
        lines = text.split("\n") if self.cut_lines else [text]
        total, get = len(lines) - 1, self._remembered
        for line in lines:
            if SPACE * 2 in line:
                total += sum(map(get, re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", line)))
                continue
            bare, *words = line.split(SPACE)
            if bare:
                total += get(bare)
            total += sum([get(SPACE + w) for w in words])
        return total


@lru_cache(maxsize=2)
def counter(model_path: str) -> UnigramCounter:
    """One counter for each worker process; of a merge-type file the pieces with ``rank_scores``."""
    return UnigramCounter(rank_scores(model_path))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(model_path)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([c.count(t) for t in texts_of(batch)], pa.int64())], names=["doc_id", "n_tokens"]
        )

    return map_arrow(docs.select("doc_id", empty_if_null()), run, "doc_id long, n_tokens long")
