"""Operator 8: SimHash near-duplicates, compared by bit slices.

Fingerprint: A-Z are lowered, words are runs of other than ASCII white space, and each shingle of three words, repeats
included, is hashed by XXH64 (seed 42); a bit is 1 if over half the hashes have it. A text of one or two words is one
shingle; a text without words, or a null one, has the fingerprint zero, which links like any other.

Links: fingerprints that differ in at most ``radius`` (3) of 64 bits share one of ``radius + 1`` bit ranges, so distinct
fingerprints meet in a bucket for each range. A bucket of more than ``HOT`` fingerprints, as all are in a very large table, is
split by the same argument: of the bits outside its range, cut into ``radius + 1`` ranges, two linked fingerprints share one. What
is still larger is dealt in chunks, each pair of chunks to a task of its own (``deal``), so no task holds more than two
chunks of a bucket. In a bucket fingerprints are stored as vertical bit planes, 64 to a word; a
fingerprint is compared with 64 others by carry-save adders over the planes, and a block is abandoned once all its counts
exceed the radius. This finds every link. Equal fingerprints are one node, so copies cost nothing. A task hands on a star for each connected
group it sees and never all pairs; the stars are joined by ``connected_components``.

Edge cases: repeated rows and equal doc_ids are rows like others and have their text's fingerprint; a component's id is its
smallest doc_id that isn't null, or null if all are; an empty table gives no rows; other columns are not read by
``fingerprints`` and are passed on by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import Scratch, chunk_sides, connected_components, deal, free_prefix, group_ends, text_batches, union_labels, whole_groups

HOT = 1 << 14
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, size: int = 3, step: int = 1 << 16) -> int:
    """The unsigned fingerprint of a whole text; shingles are counted ``step`` at a time."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    begin, end = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, step):
        h = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin[at : at + step], end[at : at + step], strict=True)], dtype="<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _with_fp(df: DataFrame, text: int, keep_text: bool, fp: str) -> DataFrame:
    """``df`` and the fingerprint of its column number ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = np.array([fingerprint(t) for t in batch.column(text).to_pylist()], dtype=np.uint64)
            cols = [c for k, c in enumerate(batch.columns) if keep_text or k != text]
            names = [c for k, c in enumerate(batch.schema.names) if keep_text or k != text]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*names, fp])

    fields = [f for k, f in enumerate(df.schema.fields) if keep_text or k != text]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField(fp, T.LongType())]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_fp(df, 1, False, "fp")


def _sliced(fp: np.ndarray, group: np.ndarray, lo: np.ndarray, hi: np.ndarray, query: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, other) of rows of one group that differ in at most ``radius`` <= 3 bits."""
    n = len(fp)
    bits = np.zeros((-(-n // 64) * 64, 64), dtype=np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # [bit, block of 64 rows]
    spread = np.ascontiguousarray(bits.T[:, :n]).astype(np.uint64) * FULL  # [bit, query]
    found_a, found_b = [], []
    q = np.flatnonzero(query)
    first, last = lo[group[q]] // 64, (hi[group[q]] - 1) // 64
    blocks = last - first + 1
    bound = np.cumsum(blocks)
    at = 0
    while at < len(q):  # about a million blocks at a time
        to = max(at + 1, int(np.searchsorted(bound, (bound[at - 1] if at else 0) + (1 << 20), "right")))
        own, n_blocks = q[at:to], blocks[at:to]
        qs = np.repeat(own, n_blocks)
        block = np.repeat(first[at:to], n_blocks) + np.arange(len(qs)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        at = to
        low = np.clip(lo[group[qs]] - 64 * block, 0, 64).astype(np.uint64)
        high = np.clip(hi[group[qs]] - 64 * block, 0, 64).astype(np.uint64)
        upto = lambda k: np.where(k < 64, (np.uint64(1) << np.minimum(k, np.uint64(63))) - np.uint64(1), FULL)
        over = ~(upto(high) & ~upto(low))
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        for b in range(0, 64, 4):
            x = [planes[b + k][block] ^ spread[b + k][qs] for k in range(4)]
            u = ones ^ x[0]
            carry = (ones & x[0]) | (u & x[1])
            ones = u ^ x[1]
            u = ones ^ x[2]
            carry2 = (ones & x[2]) | (u & x[3])
            ones = u ^ x[3]
            u = twos ^ carry
            over |= (twos & carry) | (u & carry2)
            twos = u ^ carry2
            if b % 8 == 4:
                alive = over != FULL
                if np.count_nonzero(alive) < 0.7 * len(alive):
                    qs, block, over, ones, twos = qs[alive], block[alive], over[alive], ones[alive], twos[alive]
        near = ~(over | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.zeros_like(over)}[radius])
        some = np.flatnonzero(near)
        lanes = np.unpackbits(np.ascontiguousarray(near[some]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, lane = np.nonzero(lanes)
        a, b = qs[some][i], block[some][i] * 64 + lane
        found_a.append(a[a != b])
        found_b.append(b[a != b])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.zeros(0, np.int64),) * 2


def _range(fp: Column, a: int, b: int) -> Column:
    """Bits ``a`` to ``b`` of a long."""
    return F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1 if b - a < 64 else -1)


def _cuts(n: int, parts: int) -> list[tuple[int, int]]:
    edges = [n * k // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:], strict=False))


def near_links(fps: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """(u, v): stars that connect the distinct fingerprints ``fp`` as all links at the radius would."""
    ranges = _cuts(64, radius + 1)
    keys = [F.struct(F.lit(k).alias("part"), _range(F.col("fp"), a, b).alias("bits")) for k, (a, b) in enumerate(ranges)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.part", "k.bits", "fp")
    hot = scratch.save(rows.groupBy("part", "bits").count().where(F.col("count") > HOT), "hot")
    # Equal hashes of different buckets only make one larger group of two.
    if hot.isEmpty():
        rows = rows.select(F.xxhash64("part", "bits").alias("bucket"), "fp")
    else:
        subs = F.lit(None)
        for k, (a, b) in enumerate(ranges):
            turned = F.shiftrightunsigned("fp", b % 64).bitwiseOR(F.shiftleft("fp", (64 - b) % 64))  # the other bits come first
            other = F.array(*(F.xxhash64("part", "bits", F.lit(j), _range(turned, c, d)) for j, (c, d) in enumerate(_cuts(64 - b + a, radius + 1))))
            subs = F.when(F.col("part") == k, other).otherwise(subs)
        rows = rows.join(hot, ["part", "bits"], "left")
        rows = rows.select(F.explode(F.when(F.col("count").isNull(), F.array(F.xxhash64("part", "bits"))).otherwise(subs)).alias("bucket"), "fp")
    rows, by = deal(rows, "bucket", "fp", HOT, scratch, "hot-chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by, 1 << 15):
            fp = table.column("fp").to_numpy().view(np.uint64)
            hi = group_ends(*(table.column(k).to_numpy() for k in by))
            lo = np.concatenate(([0], hi[:-1]))
            group = np.repeat(np.arange(len(hi)), hi - lo)
            query = (hi - lo > 1)[group]
            if sides := chunk_sides(table):  # of two chunks, one asks
                query &= ~sides[1] | (sides[0] == table.column("a").to_numpy())
            a, b = _sliced(fp, group, lo, hi, query, radius)
            if len(a):
                label = union_labels(len(fp), a, b)
                linked = np.flatnonzero(label != np.arange(len(fp)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[linked].view(np.int64)), pa.array(fp[label[linked]].view(np.int64))], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def components(prints: DataFrame, scratch: Scratch, radius: int = 3) -> DataFrame:
    """(fp, component, component_id) for each distinct fingerprint of ``prints`` (doc_id, fp); component: its smallest fp."""
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = connected_components(near_links(nodes.select("fp"), scratch, radius), scratch)
    at = nodes.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = at.groupBy("component").agg(F.min("least").alias("component_id"))
    return at.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(fingerprints(docs), "prints")
    return prints.join(components(prints, scratch, radius), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: the one of the smallest doc_id, null last.

    Rows of equal doc_id are told apart by their fingerprints; of rows equal in both any one stays.
    """
    scratch = Scratch(docs.sparkSession, "simhash-one")
    names, p = docs.columns, free_prefix(docs.columns, "simhash")
    fp = p + "fp"
    tagged = scratch.save(_with_fp(docs, names.index("text"), True, fp), "tagged")
    prints = tagged.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    stay = prints.join(components(prints, scratch, radius), "fp").groupBy("component").agg(first).select("first.doc_id", "first.fp")
    stay = stay.select(F.col("doc_id").alias(p + "stay_id"), F.col("fp").alias(p + "stay_fp"))
    same = (F.col(fp) == F.col(p + "stay_fp")) & tagged["doc_id"].cast("long").eqNullSafe(F.col(p + "stay_id"))
    kept = tagged.join(stay, same, "left_semi")
    if not prints.groupBy("doc_id", "fp").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", fp])
    return kept.select(*names)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
