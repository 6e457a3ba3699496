"""Operator 6: quality classifier, a byte-level convolutional network in numpy.

A filter reads ``WIDTH`` bytes at every second byte of the UTF-8 text and has a weight for each byte value at each place.
The document is covered by chunks of 512 bytes that overlap by 64; in each chunk every filter's rectified outputs are
max-pooled, a linear layer makes a logit of the pooled outputs, and the mean of all chunks' logits is the document's, whose
sigmoid is the score. Whole texts are scored, whatever their length, in pieces of bounded size.

Training is on the driver, on at most ``MAX_ROWS`` labelled rows and ``MAX_CHUNKS`` evenly spaced chunks of each: a
documented bound of the sample, about 12 MB, whatever the ids; of an id's repeated rows those of smallest hash count first. Rows with crc32(doc_id as text) mod 5 = 0 are held out. Only the text enters.

Edge cases: a null or empty text is scored like any other, as padding alone; a null doc_id is held out; null labels are not
used; if no labelled row, or only one class, can be learned from, every score is the share of label 1 among them (0.5 if
none); repeated rows and labels count as often as they occur, within the bound; an empty table gives no rows; other columns are not read by
``score`` and are passed on by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import text_batches

WIDTH, FILTERS, STRIDE, BLOCK, PER_CHUNK = 7, 16, 2, 64, 8
STEP = PER_CHUNK - 1  # blocks from one chunk to the next
MAX_ROWS, MAX_CHUNKS = 4000, 6
THRESHOLD = 0.3


@dataclass
class Model:
    table: np.ndarray  # [place, byte, filter]
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    constant: float | None = None


def _padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each padded with zeros to whole blocks and one block more, so no filter reads on into the next
    text; and the blocks of each, without that one."""
    raw = [(t or "").encode() for t in texts]
    blocks = np.array([-(-(len(b) + WIDTH - 1) // BLOCK) for b in raw], dtype=np.int64)
    return np.frombuffer(b"".join(b.ljust(int(n + 1) * BLOCK, b"\0") for b, n in zip(raw, blocks, strict=True)), dtype=np.uint8), blocks


def _block_max(model: Model, data: np.ndarray, piece: int = 4096) -> np.ndarray:
    """Each filter's largest output in each block; ``piece`` blocks at a time."""
    out = []
    for at in range(0, len(data), piece * BLOCK):
        own = data[at : at + piece * BLOCK + WIDTH - 1]
        own = np.append(own, np.zeros(WIDTH - 1, np.uint8)) if at + piece * BLOCK >= len(data) else own
        n = (len(own) - WIDTH + 1) // STRIDE
        y = model.table[0].take(own[: n * STRIDE : STRIDE], axis=0)
        for w in range(1, WIDTH):
            y += model.table[w].take(own[w : w + n * STRIDE : STRIDE], axis=0)
        out.append(y.reshape(-1, BLOCK // STRIDE, FILTERS).max(axis=1))
    return np.maximum(np.concatenate(out) + model.bias, 0)


def chunk_starts(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first block in that text) of each chunk."""
    n = np.maximum(1, -(-(blocks - 1) // STEP))
    text = np.repeat(np.arange(len(blocks)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * STEP


def scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None or not texts:
        return np.full(len(texts), model.constant or 0.0)
    data, blocks = _padded(texts)
    top = _block_max(model, data)
    text, start = chunk_starts(blocks)
    first = (np.cumsum(blocks + 1) - blocks - 1)[text]
    pooled = top[first + start]
    for k in range(1, PER_CHUNK):
        pooled = np.maximum(pooled, top[first + np.minimum(start + k, blocks[text] - 1)])
    logit = pooled.astype(np.float64) @ model.weight + model.offset
    mean = np.bincount(text, logit) / np.bincount(text)
    return 1 / (1 + np.exp(-np.clip(mean, -40, 40)))


def sample_chunks(text: str | None) -> bytes:
    """Up to ``MAX_CHUNKS`` chunks of a text, evenly spaced, each 512 bytes and the bytes its last filters reach."""
    data, blocks = _padded([text])
    _, start = chunk_starts(blocks)
    at = start[np.unique(np.linspace(0, len(start) - 1, MAX_CHUNKS).astype(int))]
    size = PER_CHUNK * BLOCK + WIDTH - 1
    return b"".join(data[a * BLOCK : a * BLOCK + size].tobytes().ljust(size, b"\0") for a in at.tolist())


def fit(samples: list[bytes], labels: np.ndarray, steps: int = 1500, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Learn the filters by gradient descent (Adam) on the cross entropy of the documents' mean logits."""
    labels = np.asarray(labels, dtype=np.float64)
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        return Model(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), 0.0, share)
    rng = np.random.default_rng(seed)
    size = PER_CHUNK * BLOCK + WIDTH - 1
    x = [np.frombuffer(s, dtype=np.uint8).reshape(-1, size) for s in samples]
    prior = labels.mean()
    p = {
        "table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "weight": rng.normal(0, 0.1, FILTERS),
        "offset": np.array([np.log(prior / (1 - prior))]),
    }
    epochs = max(1, steps * batch // len(x))
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    n_pos = PER_CHUNK * BLOCK // STRIDE
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            data = np.concatenate([x[i] for i in own])
            doc = np.repeat(np.arange(len(own)), [len(x[i]) for i in own])
            share = 1 / np.bincount(doc)[doc]
            y = p["table"][0].take(data[:, : n_pos * STRIDE : STRIDE], axis=0)
            for w in range(1, WIDTH):
                y += p["table"][w].take(data[:, w : w + n_pos * STRIDE : STRIDE], axis=0)
            best = y.argmax(axis=1)
            pooled = np.maximum(np.take_along_axis(y, best[:, None], axis=1)[:, 0] + p["bias"], 0)
            logit = np.bincount(doc, share * (pooled @ p["weight"] + p["offset"][0]))
            error = (1 / (1 + np.exp(-logit)) - labels[own]) / len(own)
            d_logit = error[doc] * share
            d_pool = d_logit[:, None] * p["weight"] * (pooled > 0)
            g = {"weight": pooled.T @ d_logit + 1e-4 * p["weight"], "offset": np.array([d_logit.sum()]), "bias": d_pool.sum(axis=0), "table": np.zeros_like(p["table"])}
            row, filt = np.arange(len(data))[:, None], np.arange(FILTERS)[None]
            for w in range(WIDTH):
                np.add.at(g["table"][w], (data[row, best * STRIDE + w], filt), d_pool)
            step += 1
            now = rate * (1 - epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = (p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(p[k].dtype)
    return Model(p["table"], p["bias"], p["weight"], float(p["offset"][0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled rows of smallest hash; their ids (at most ``max_rows``) are broadcast, so texts aren't shuffled.

    Each task hands on ``max_rows`` samples at most, so ids of many rows are no more than others.
    """
    of = labels.select(F.col("doc_id").cast("long").alias("sample_id"), F.col("quality").cast("double").alias("label"))
    of = of.where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("sample_id")))
    of = of.orderBy(F.xxhash64("sample_id"), "sample_id", "label").limit(max_rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([sample_chunks(t) for t in b.column(2).to_pylist()], pa.binary())], names=["id", "label", "chunks"])

    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    own = own.join(F.broadcast(of), F.col("id") == F.col("sample_id")).select("id", "label", "text")
    sampled = own.mapInArrow(cut, "id long, label double, chunks binary")
    rows = sampled.orderBy(F.xxhash64("id"), F.xxhash64("chunks"), "label").limit(max_rows).collect()
    rows.sort(key=lambda r: (r.id, r.label, bytes(r.chunks)))
    return fit([bytes(r.chunks) for r in rows], np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(model, b.column(1).to_pylist()))], names=["doc_id", "score"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is at least the threshold, with all columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, 256):
            yield b.filter(pa.array(scores(model, b.column(at).cast(pa.string()).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
