"""SentencePiece (merge type) encoding and decoding with a prefix table.

For merge-type vocabularies the encoding of every prefix of a text ends in one certain token, and that
token is the only vocabulary match ending there which is *compatible* with the last token of the prefix
before it.  So one left-to-right pass stores the last token of each prefix (candidates come from an
Aho-Corasick automaton) and the ids are read off backwards.

Two tokens are compatible when, undoing both sides' merges from the latest one backwards, no pair at
their seam would have merged earlier than the merge being undone.

The text is cut at places that no piece spans (before a space marker; at line feeds when no piece holds
one), so each run between two cuts is encoded on its own and remembered in a bounded table.

Nulls in the text are taken as empty; an empty text has no ids and decodes to an empty text.
"""

from __future__ import annotations

import codecs
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from citelake.llm.common import empty_if_null, map_arrow, texts_of

SPACE = "▁"
#: Fixed values of the SentencePiece model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Most remembered runs a worker holds; the table starts afresh beyond it.
MEMO_RUNS = 400_000


def _one_each(err: UnicodeDecodeError) -> tuple[str, int]:
    return "�", err.start + 1


codecs.register_error("citelake-one-each", _one_each)


class _Memo(dict):
    """Run of text -> ids, computed on first use and emptied when full."""

    def __init__(self, encode_run, prefix: str):
        super().__init__()
        self.encode_run, self.prefix = encode_run, prefix

    def __missing__(self, run: str) -> tuple[int, ...]:
        if len(self) >= MEMO_RUNS:
            self.clear()
        ids = self.encode_run(self.prefix + run)
        if len(run) <= 64:
            self[run] = ids
        return ids


class PieceCodec:
    """Encoder and decoder of one merge-type SentencePiece model file."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models without text normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self._decoding_table(proto)
        self._merge_tables(normal)
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that hold a space after a letter are not supported")
        self.cut_lines = not any("\n" in p for p in normal)
        self._after_space = _Memo(self._encode_run, SPACE)
        self._bare = _Memo(self._encode_run, "")

    # --- tables -----------------------------------------------------------------------------------

    def _decoding_table(self, proto) -> None:
        self.byte_id = {}
        self.shown = []
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_id[b] = i
                # high bytes pass through as escaped surrogates until whole sequences are decoded
                self.shown.append(chr(b) if b < 0x80 else chr(0xDC00 + b))
            elif p.type == CONTROL:
                self.shown.append("")
            elif p.type == UNKNOWN:
                self.shown.append(proto.trainer_spec.unk_surface)
            else:
                self.shown.append(p.piece.replace(SPACE, " "))
        self.hidden = {i for i, p in enumerate(proto.pieces) if p.type == CONTROL}

    def _merge_tables(self, normal: dict[str, tuple[int, float]]) -> None:
        """Merge order, halves of each token's last merge, and the automaton of tokens that merging reaches."""
        by_score: dict[float, list[str]] = {}
        for piece, (_, score) in normal.items():
            if len(piece) > 1:
                by_score.setdefault(score, []).append(piece)
        #: pieces of equal score, allowed only for runs of the space marker: they merge from the left
        tied = [p for group in by_score.values() if len(group) > 1 for p in group]
        if any(set(p) != {SPACE} for p in tied):
            raise ValueError("pieces of equal score other than runs of spaces are not supported")
        if tied and min(by_score) != normal[tied[0]][1]:
            raise ValueError("runs of spaces must merge last")
        self.run_id = {len(p): normal[p][0] for p in tied}
        self.longest_run = max(self.run_id, default=1)
        if tied and self._merged_runs(2 * self.longest_run) != [self.longest_run] * 2:
            raise ValueError("long runs of spaces must merge to blocks of the longest piece")
        loose = set(tied)
        chars = [p for p in normal if len(p) == 1]
        merged = sorted((p for p in normal if len(p) > 1 and p not in loose), key=lambda p: -normal[p][1])
        order = {p: k for k, p in enumerate(chain(chars, merged))}
        self.base = len(chars)
        self.model_id = [normal[p][0] for p in order]
        self.length = [len(p) for p in order]
        self.halves: list[tuple[int, int]] = [(k, k) for k in range(len(chars))]
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for p in chars:
            self.automaton.add_word(p, (1, order[p]))
        for p in merged:
            pair = self._last_merge(p, order)
            if pair:
                self.halves.append(pair)
                self.joined[pair] = order[p]
                self.automaton.add_word(p, (len(p), order[p]))
            else:  # merging never makes this piece
                self.halves.append((order[p], order[p]))
        self.automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}

    def _merged_runs(self, n: int) -> list[int]:
        """Lengths that ``n`` single markers merge to when the leftmost possible pair always goes first."""
        parts = [1] * n
        while True:
            at = next((i for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in self.run_id), None)
            if at is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    @staticmethod
    def _last_merge(piece: str, order: dict[str, int]) -> tuple[int, int] | None:
        parts = list(piece)
        while len(parts) > 2:
            rank, at = min(
                ((order.get(a + b, len(order)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            )
            if rank == len(order):
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (order[parts[0]], order[parts[1]]) if all(p in order for p in parts) else None

    # --- encoding ---------------------------------------------------------------------------------

    def compatible(self, left: int, right: int) -> bool:
        """True if merging leaves ``left`` and ``right`` as neighbours."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            known = self._fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        halves, joined = self.halves, self.joined
        bound = len(halves)  # merges at the seam count from here on only if they come before this one
        while True:
            if joined.get((left, right), bound) < bound:
                return False
            if left < self.base and right < self.base:
                return True
            # undo the later of the two merges; of equal ones the right one, as the left goes first
            if left > right:
                bound, left = left, halves[left][1]
            else:
                # a seam pair of the same rank lies further left, so it would have merged first
                bound, right = right + 1, halves[right][0]

    def _encode_run(self, run: str) -> tuple[int, ...]:
        """Ids of a run without inner cuts: prefix table forwards, ids backwards."""
        n = len(run)
        last = [-1] * (n + 1)  # internal number of the last token of each prefix; -1: a character outside
        size = [1] * (n + 1)
        done = [False] * (n + 1)
        done[0] = True
        fits = self.compatible
        for end, (length, token) in self.automaton.iter(run):
            end += 1
            if done[end]:
                continue
            start = end - length
            before = last[start]
            if before < 0 or fits(before, token):
                last[end], size[end], done[end] = token, length, True
        out: list[int] = []
        at = n
        while at:
            if last[at] < 0:
                out += [self.byte_id[b] for b in reversed(run[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
            else:
                out.append(self.model_id[last[at]])
                at -= size[at]
        out.reverse()
        return tuple(out)

    def _spaces(self, n: int) -> list[int]:
        if not n:
            return []
        lone = list(self._encode_run(SPACE))
        if not self.run_id:
            return lone * n
        whole, rest = divmod(n, self.longest_run)
        out = [self.run_id[self.longest_run]] * whole
        for length in self._merged_runs(rest):
            out += [self.run_id[length]] if length > 1 else lone
        return out

    def _encode_words(self, words: list[str], first_bare: bool) -> list[int]:
        """Words parted by single spaces; every word but a bare first one has a marker before it."""
        if "" not in words[first_bare:]:
            out = list(self._bare[words[0]]) if first_bare and words[0] else []
            out.extend(chain.from_iterable(map(self._after_space.__getitem__, words[first_bare:])))
            return out
        out = list(self._bare[words[0]]) if first_bare and words[0] else []
        run = 0  # markers waiting for a word
        lone = self._encode_run(SPACE)
        for word in words[first_bare:]:
            run += 1
            if word:
                ids = self._after_space[word]
                if run > 1 and ids[: len(lone)] == lone:  # the word leaves its marker to the run
                    out += self._spaces(run)
                    ids = ids[len(lone) :]
                elif run > 1:
                    out += self._spaces(run - 1)
                out += ids
                run = 0
        return out + self._spaces(run)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text`` as the library gives them, without begin and end ids."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        bare = not self.dummy_prefix
        if not self.cut_lines or "\n" not in text:
            return self._encode_words(text.split(" "), bare)
        feed = self.byte_id[10]
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(feed)
                bare = True
            elif not line and not bare:
                out += self._encode_run(SPACE)
                continue
            if line:
                out += self._encode_words(line.split(" "), bare)
        return out

    # --- decoding ---------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids: byte pieces are joined to characters, broken bytes become U+FFFD."""
        if self.hidden.isdisjoint(ids):
            text = self._joined(ids)
        else:  # control pieces show nothing, but part byte pieces
            parts: list[list[int]] = [[]]
            for i in ids:
                if i in self.hidden:
                    parts.append([])
                else:
                    parts[-1].append(i)
            ids = [i for part in parts for i in part]
            text = "".join(map(self._joined, parts))
        return text[1:] if self.dummy_prefix and ids and self.pieces[ids[0]].startswith(SPACE) else text

    def _joined(self, ids: list[int]) -> str:
        text = "".join(map(self.shown.__getitem__, ids))
        try:
            text.encode()
        except UnicodeEncodeError:
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "citelake-one-each")
        return text


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each worker process and model file."""
    return PieceCodec(model_path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids ``array<int>``, decoded text; nulls in text count as empty, every row is kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        ids = [c.encode(t) for t in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())],
            names=["doc_id", "ids", "decoded"],
        )

    return map_arrow(docs.select("doc_id", empty_if_null()), run, "doc_id long, ids array<int>, decoded string")


def encoded_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode_documents`` gives, as digests.

    Hashing next to the encoder keeps the ids from crossing to the JVM and back.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(model_path)
        decimal = [str(i) for i in range(len(c.pieces))]
        counts, sums, back = [], [], []
        for text in texts_of(batch):
            ids = c.encode(text)
            counts.append(len(ids))
            sums.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(back, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(
        docs.select("doc_id", empty_if_null()), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
