"""Operator 2: SentencePiece encoding and decoding with a unigram model.

A model file's pieces and scores are read as they stand, whatever kind of model wrote them: the encoding of a text is the
sequence of pieces of largest total score (Viterbi). The pieces are kept in a double-array trie over UTF-8 bytes, which
gives all pieces that begin at a place in one walk. White space is a piece's marker ``▁``, put before the text too; a
character that no piece begins with is unknown, scored 10 below the lowest piece, and falls back to its bytes' pieces.
Pieces that the file declares as user-defined score 0.1 below their length times the largest score, as in the public
library. Ties go to the longer last piece. Sums are in double precision. Decoding joins pieces, takes bytes' pieces for bytes (a byte that is no UTF-8
becomes U+FFFD) and the marker for a space, and drops the first one.

No piece goes on with a marker after another character, so the best sequence of a text is that of its words, each with the
markers before it, one after another; a word's is found once and kept, in a memo of bounded size. A vocabulary of which that
isn't true is encoded text by text.

Edge cases: a null text is the empty text, which has no ids; rows are encoded one by one, so repeated rows, ties and null
doc_ids need no care; an empty table gives no rows; columns other than doc_id and text are not read. NUL characters are
characters like others.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from math import inf

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import text_batches
from codeloom.sources.scip import fields

MARK = "▁"
#: Fixed values of the file format: types of pieces.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of each id of a SentencePiece model file."""
    out = []
    with open(path, "rb") as f:
        for number, value in fields(f.read()):
            if number == 1:
                own = dict(fields(value))
                score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                out.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
    return out


class DoubleArray:
    """A trie in two arrays: from state s, byte b leads to t = base[s] + b + 1 if check[t] = s; slot base[s] has a value."""

    def __init__(self, keys: list[tuple[bytes, int]]):
        keys = sorted(keys)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free = 1
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            end = -1
            if len(keys[lo][0]) == depth:
                end, lo = keys[lo][1], lo + 1
            spans, at = [], lo
            while at < hi:
                b, first = keys[at][0][depth], at
                while at < hi and keys[at][0][depth] == b:
                    at += 1
                spans.append((b, first, at))
            want = ([0] if end >= 0 else []) + [b + 1 for b, _, _ in spans]
            while self.check[free] >= 0:
                free += 1
                self._grow(free + 300)
            base = max(1, free - want[0])
            while any(self.check[base + w] >= 0 for w in want):
                base += 1
                self._grow(base + 300)
            self.base[state] = base
            for w in want:
                self.check[base + w] = state
            if end >= 0:
                self.value[base] = end
            todo += [(base + b + 1, first, last, depth + 1) for b, first, last in spans]

    def _grow(self, size: int) -> None:
        if size > len(self.base):
            more = len(self.base)
            self.base += [0] * more
            self.check += [-1] * more
            self.value += [-1] * more

    def prefixes(self, raw: bytes, at: int) -> list[tuple[int, int]]:
        """(end, value) of each key that begins at ``at``, shortest first."""
        base, check, value, out, s = self.base, self.check, self.value, [], 0
        n, size = len(raw), len(self.base)
        while True:
            t = base[s]
            if t and check[t] == s and value[t] >= 0 and at:
                out.append((at, value[t]))
            if at == n:
                return out
            t += raw[at] + 1
            if t >= size or check[t] != s or not t:
                return out
            s, at = t, at + 1


#: Places after which what is settled is let go.
SETTLED = 1 << 12


def _places(size: int, n: int):
    """Scores, pieces and where they begin, of so many places of a text of ``n`` bytes: compact where it is long."""
    if n <= SETTLED:
        return [-inf] * size, [-1] * size, [0] * size
    return array("d", [-inf]) * size, array("i", [-1]) * size, array("i", [0]) * size


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float, int]]

    def __post_init__(self):
        own = [(p, k) for k, (p, _, t) in enumerate(self.pieces) if t in (NORMAL, USER) and p]
        scores = [self.pieces[k][1] for _, k in own if self.pieces[k][2] == NORMAL]
        low, high = min(scores, default=0.0), max(scores, default=0.0)
        self.scores = [s if t != USER else len(p.encode()) * high - 0.1 for p, s, t in self.pieces]
        self.unknown_score = low - 10
        self.unknown = next((k for k, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        self.byte = {int(p[3:5], 16): k for k, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.of_byte = {k: b for b, k in self.byte.items()}
        self.trie = DoubleArray([(p.encode(), k) for p, k in own])
        self.longest = max([4, *(len(p.encode()) for p, _ in own)])
        self.apart = not any(re.search(rf"[^{MARK}]{MARK}", p) for p, _ in own)
        line = any("\n" in p for p, _ in own)  # a character that no piece has is cut out, too
        self.cut = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+" if line or not self.byte else rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        self.memo: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the pieces of largest total score of a text with markers.

        A place that no piece of a sequence so far goes beyond is in every sequence: what comes before it is settled there, so
        of a long text without spaces little is held as a rule, and 16 bytes a byte of text where pieces overlap throughout.
        """
        raw = text.encode()
        n = len(raw)
        prefixes, scores, unknown = self.trie.prefixes, self.scores, self.unknown_score
        out: list[int] = []
        base = at = reach = 0  # scores and pieces are held from ``base`` on
        best, piece, begin = _places(min(n, SETTLED + self.longest) + 1, n)
        best[0], room = 0.0, len(best) - 1 - self.longest if n > SETTLED else n  # places from which every piece fits
        while at < n:
            here = at - base
            if here >= SETTLED and at == reach:
                self._settle(raw, base, here, piece, begin, out)
                score, base, here = best[here], at, 0
                best, piece, begin = _places(SETTLED + self.longest + 1, n)
                best[0] = score
            elif here > room:
                more = _places(len(best), n)
                best, piece, begin = best + more[0], piece + more[1], begin + more[2]
                room = len(best) - 1 - self.longest
            b = raw[at]
            end = at + (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)
            score, single = best[here], False
            if end > reach:
                reach = end
            if score > -inf:
                for to, k in prefixes(raw, at):
                    single |= to == end
                    s = score + scores[k]
                    place = to - base
                    if s > best[place]:
                        best[place], piece[place], begin[place] = s, k, here
                    if to > reach:
                        reach = to
                if not single:
                    s, place = score + unknown, end - base
                    if s > best[place]:
                        best[place], piece[place], begin[place] = s, -1, here
            at = end
        self._settle(raw, base, n - base, piece, begin, out)
        return out

    def _settle(self, raw: bytes, base: int, at: int, piece, begin, out: list[int]) -> None:
        """Add the ids of the best sequence from ``base`` to ``at`` places on."""
        held: list[int] = []
        while at:
            k = piece[at]
            if k >= 0:
                held.append(k)
            elif self.byte:
                held += [self.byte[b] for b in reversed(raw[base + begin[at] : base + at])]
            elif held[-1:] != [self.unknown]:
                held.append(self.unknown)
            at = begin[at]
        held.reverse()
        if not self.byte and held[:1] == [self.unknown] == out[-1:]:
            held = held[1:]
        out += held

    def encode(self, text: str | None, limit: int = 1_000_000, longest: int = 64) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        if not self.apart:
            return np.array(self.viterbi(marked), dtype="<u4").tobytes()
        out, memo = [], self.memo
        for word in self.cut(marked):
            got = memo.get(word)
            if got is None:
                got = np.array(self.viterbi(word), dtype="<u4").tobytes()
                if len(word) <= longest:
                    if len(memo) >= limit:
                        memo.clear()
                    memo[word] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        parts, held = [], bytearray()
        if not hasattr(self, "shown"):
            self.shown = [None if t == BYTE else "" if t == CONTROL else " ⁇ " if t == UNKNOWN else p.replace(MARK, " ") for p, _, t in self.pieces]
        for k in np.frombuffer(ids, dtype="<u4").tolist():
            s = self.shown[k]
            if s is None:
                held.append(self.of_byte[k])
                continue
            if held:
                parts.append(held.decode(errors="replace"))
                held = bytearray()
            parts.append(s)
        if held:
            parts.append(held.decode(errors="replace"))
        return "".join(parts).removeprefix(" ")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each Python worker, kept over its tasks."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(read_model(path))
    return _vocabularies[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text; the model file is read where the worker runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.encode(t) for t in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the ids of ``encode`` and their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([v.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    n = (F.octet_length("ids") / 4).cast("long")
    return both.select("doc_id", n.alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("decoded_sha256"))
