"""Operator 4: harmonic packing of token ids into sequences of a fixed capacity.

A document's ids are cut into full sequences and a rest. A rest of more than capacity / (k + 1) and at most capacity / k ids is
of class k, and a bin of class k takes exactly k rests, whole. Class ``CLASSES`` takes all shorter rests, one after another;
one that goes over the end of its bin is cut there. The room that k rests leave in a bin, which would be padding, is filled
with the first ids of the documents that come next, the only other cut. So a document is in about two pieces, and no
sequence but a task's last one is short. Each task fills its own bins, one open bin a class, without a shuffle; at its end
the fewer than ``CLASSES ** 2 / 2`` rests in bins that were not filled are laid one after another and cut at the capacity.

Edge cases: a null text is the empty text, which has the end id alone; rows are packed one by one, so repeated rows, ties
and null doc_ids need no care; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import text_batches
from codeloom.llm.tokens import encoder

CLASSES = 7
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: (doc_id, start, length, ids as bytes, ids of the document)
Piece = tuple[int | None, int, int, bytes, int]


class Packer:
    """The bins of one task. ``add`` and ``finish`` return the sequences that are done, as lists of pieces."""

    def __init__(self, capacity: int, classes: int = CLASSES):
        self.capacity, self.classes = capacity, classes
        self.bins: list[list[Piece]] = [[] for _ in range(classes + 1)]
        self.short = 0  # ids in the open bin of the last class
        self.filled: list[Piece] = []  # a bin with all its rests and room left
        self.room = 0

    def add(self, doc_id: int | None, raw: bytes) -> list[list[Piece]]:
        n, at, done, capacity = len(raw) // 4, 0, [], self.capacity
        if self.room:
            at = min(n, self.room)
            self.filled.append((doc_id, 0, at, raw[: 4 * at], n))
            self.room -= at
            if not self.room:
                done.append(self.filled)
        while n - at >= capacity:
            done.append([(doc_id, at, capacity, raw[4 * at : 4 * (at + capacity)], n)])
            at += capacity
        rest = n - at
        if not rest:
            return done
        k = capacity // rest
        if k >= self.classes:
            left = capacity - self.short
            own = self.bins[self.classes]
            own.append((doc_id, at, min(rest, left), raw[4 * at : 4 * (at + min(rest, left))], n))
            self.short += min(rest, left)
            if self.short == capacity:
                done.append(own)
                more = rest - left
                self.bins[self.classes], self.short = [(doc_id, n - more, more, raw[4 * (n - more) :], n)] if more else [], more
            return done
        own = self.bins[k]
        own.append((doc_id, at, rest, raw[4 * at :], n))
        if len(own) == k:
            self.bins[k] = []
            room = capacity - sum(p[2] for p in own)
            if room:
                self.filled, self.room = own, room
            else:
                done.append(own)
        return done

    def open(self) -> list[Piece]:
        """Pieces of the bins that are not filled."""
        return [p for b in ([self.filled] if self.room else []) + self.bins for p in b]

    def finish(self) -> list[list[Piece]]:
        done, sequence, room = [], [], self.capacity
        for doc_id, at, length, raw, n in self.open():
            while length:
                take = min(length, room)
                sequence.append((doc_id, at, take, raw[: 4 * take], n))
                at, length, raw, room = at + take, length - take, raw[4 * take :], room - take
                if not room:
                    done.append(sequence)
                    sequence, room = [], self.capacity
        return done + [sequence] if sequence else done


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id`` and ``offset`` in that sequence, from 0 and gapless.

    A sequence_id is the partition's number times 2^33 and a count. A task holds its open bins only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer), Packer(capacity)
        count = TaskContext.get().partitionId() << 33

        def rows(done: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal count
            out = []
            for sequence in done:
                offset = 0
                for p in sequence:
                    out.append((*p, count, offset))
                    offset += p[2]
                count += 1
            if out:
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
                names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in text_batches(batches, 2048, 8 << 20):
            done = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), enc.encode_many(batch.column(1), end_id), strict=True):
                done += packer.add(doc_id, raw)
            yield from rows(done)
        yield from rows(packer.finish())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def contract_rows(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contract_rows(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", end_id=0))
