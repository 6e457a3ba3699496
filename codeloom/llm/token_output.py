"""Operator 1: token ids in files of Simple-8b words, and the reader of those files.

Files: a Parquet table of segments, so that any store Spark writes to will do and a retried task commits once. A segment
is one binary value: the magic ``S8SEG1``, two zero bytes, little-endian unsigned counts (documents, blocks, words: 64 bits
each), then doc_id (int64), whether it is null (uint8, padded to 8 bytes), ids of each document (uint32, padded), words
before each block (uint32, padded), and the words. A block holds up to 1024 ids of one document. Segments of a shard are
numbered, and shards hold ascending ranges of doc_id.

Edge cases: a null text is the empty text and has the end id alone; null doc_ids come first; rows of equal doc_id come by
their ids' checksum, so that repeated rows are interchangeable; an empty table gives empty files and no rows; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import simple8b
from codeloom.llm.common import Scratch, n_partitions, text_batches
from codeloom.llm.tokens import encoder

MAGIC = b"S8SEG1\0\0"
SEGMENT_WORDS = 1 << 17  # a megabyte
CODED = "shard int, doc_id long, n_ids long, crc long, starts binary, words binary"
SEGMENT = "shard int, segment int, base long, n_docs long, n_ids long, payload binary"


def _pad(b: bytes) -> bytes:
    return b + bytes(-len(b) % 8)


def write_segment(doc_ids: list[int | None], n_ids: list[int], starts: list[np.ndarray], words: list[np.ndarray]) -> bytes:
    before = np.cumsum([0] + [len(w) for w in words])
    blocks = [s.astype(np.uint32) + np.uint32(b) for s, b in zip(starts, before[:-1].tolist(), strict=True)]
    blocks = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    return b"".join(
        [
            MAGIC,
            np.array([len(doc_ids), len(blocks), before[-1]], dtype="<u8").tobytes(),
            np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
            _pad(np.array([d is None for d in doc_ids], dtype=np.uint8).tobytes()),
            _pad(np.array(n_ids, dtype="<u4").tobytes()),
            _pad(blocks.astype("<u4").tobytes()),
            *(w.astype("<u8").tobytes() for w in words),
        ]
    )


def read_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and all the ids one after another."""
    if payload[:8] != MAGIC:
        raise ValueError("not a segment of Simple-8b words")
    docs, blocks, words = np.frombuffer(payload, dtype="<u8", count=3, offset=8).tolist()
    at = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
        at += -(-out.nbytes // 8) * 8
        return out

    ids, null, n_ids, starts, coded = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", blocks), take("<u8", words)
    n = n_ids.astype(np.int64)
    per = -(-n // simple8b.BLOCK)
    sizes = np.full(int(per.sum()), simple8b.BLOCK)
    full = n > 0
    sizes[np.cumsum(per)[full] - 1] = n[full] - simple8b.BLOCK * (per[full] - 1)
    return [None if z else d for d, z in zip(ids.tolist(), null.tolist(), strict=True)], n, simple8b.decode(coded, starts, sizes)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> None:
    """Encode ``text`` of every row and write the ids, with ``end_id`` after each document, by ascending doc_id.

    Bounds of the shards are quantiles of doc_id (one column is scanned). An id that takes several quantiles has as many
    shards, as do null ids by their share: ranges of the documents' checksums, which come after the id in the order. Rows are
    encoded where they are read, and what is shuffled to the shards are the coded words, about two bytes an id. A task
    holds one segment at a time.
    """
    spark = docs.sparkSession
    shards = shards or n_partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = [k / shards for k in range(1, shards)]
    asked = docs.select(F.percentile_approx("doc_id", cuts or [0.5], 10_000), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    quantiles, nulls, rows = asked[0] or [], asked[1], asked[2]
    bounds = sorted(set(quantiles)) if cuts else []
    # Shards in order; a group of ids has one or, where it is one hot id, several by checksum: null ids, if they are that
    # many; then for each bound the ids up to it, and by itself a bound that several quantiles share; what is above the last.
    split: list[int] = [nulls * shards // rows] if rows and nulls * shards >= rows else []
    below, of_bound = [], []
    for b in bounds:
        below.append(len(split))
        split.append(1)
        if (n := quantiles.count(b)) > 1:
            split.append(n - 1)
        of_bound.append(len(split) - 1)
    below.append(len(split))
    split.append(1)
    first = np.concatenate(([0], np.cumsum(split))).tolist()

    def shard_of(doc_id: int | None, crc: int) -> int:
        if doc_id is None:
            group = 0  # its own, or the one of the smallest ids
        else:
            at = bisect.bisect_left(bounds, doc_id)
            group = of_bound[at] if at < len(bounds) and bounds[at] == doc_id else below[at]
        return first[group] + (crc * split[group] >> 32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in text_batches(batches, 2048, 8 << 20):
            doc_ids = batch.column(0).to_pylist()
            raw = enc.encode_many(batch.column(1), end_id)
            crcs = [zlib.crc32(b) for b in raw]
            coded = simple8b.encode([np.frombuffer(b, dtype="<u4") for b in raw])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard_of(d, c) for d, c in zip(doc_ids, crcs, strict=True)], pa.int32()),
                    batch.column(0),
                    pa.array([len(b) // 4 for b in raw], pa.int64()),
                    pa.array(crcs, pa.int64()),
                    pa.array([s.astype("<u4").tobytes() for _, s in coded], pa.binary()),
                    pa.array([w.astype("<u8").tobytes() for w, _ in coded], pa.binary()),
                ],
                names=["shard", "doc_id", "n_ids", "crc", "starts", "words"],
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, base, held, size = None, 0, 0, [], 0

        def segment() -> pa.RecordBatch:
            nonlocal number, base, held, size
            n = [x[1] for x in held]
            payload = write_segment([x[0] for x in held], n, [x[2] for x in held], [x[3] for x in held])
            out = pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((shard, pa.int32()), (number, pa.int32()), (base, pa.int64()), (len(n), pa.int64()), (sum(n), pa.int64()), (payload, pa.binary()))],
                names=["shard", "segment", "base", "n_docs", "n_ids", "payload"],
            )
            number, base, held, size = number + 1, base + sum(n), [], 0
            return out

        for batch in batches:
            for s, d, n, _, starts, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (s != shard or size + len(words) // 8 > SEGMENT_WORDS):
                    yield segment()
                if s != shard:
                    shard, number, base = s, 0, 0
                held.append((d, n, np.frombuffer(starts, dtype="<u4"), np.frombuffer(words, dtype="<u8")))
                size += len(words) // 8
        if held:
            yield segment()

    coded = docs.mapInArrow(code, CODED).repartitionById(first[-1], F.col("shard"))
    coded.sortWithinPartitions("shard", "doc_id", "crc", "n_ids").mapInArrow(gather, SEGMENT).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: doc_id, start, n_tokens, and its ids as little-endian unsigned 32-bit integers.

    Where a shard starts follows from the sums of the shards before it: a row for each shard comes to the driver.
    """
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = {r.shard: r.n for r in segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    first, before = {}, 0
    for s in sorted(totals):
        first[s] = before
        before += totals[s]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, base, payload = (batch.column(c)[k].as_py() for c in range(3))
                doc_ids, n, ids = read_segment(payload)
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(n)
                starts = ends - n
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(starts + (first[shard] + base), pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return segments.select("shard", "base", "payload").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    path = f"{scratch.root}/files"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "word_bpe_49k.json", end_id=1)
    files = read_token_files(spark, path)
    return files.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
