"""Operator 5: near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors are one class, so copies cost nothing. Rotations that balance binary codes are learned by iterative
quantisation on a bounded sample (``SAMPLE`` vectors, ``SAMPLE_BYTES`` at most); each gives as many bits as there are
dimensions. The code is cut into substrings of ``s`` bits, one Hamming table each, where ``s`` grows with the logarithm of
the number of classes, so a bucket has about ``BUCKET`` classes at any size. The number of tables is chosen so that two
vectors at the threshold itself miss each other in all of them once in 1,000 cases: vectors of the sample are turned by the
threshold's angle in random directions, and what share of the bits agrees is taken from the angles after centring and from
the learned rotations; closer pairs miss less. Where the mean is so long that this takes over ``MOST`` times the tables of
uncentred vectors, codes are random rotations of the vectors as they are.

Retrieval ships codes alone: in a table's bucket, classes within a Hamming radius of each other (``CODE_BITS`` bits; five
deviations beyond what the turned pairs of the sample show) are marked in the first table that they share, as far as those
bits tell. Only marked classes bring their original vectors to the bucket, where the cosine decides in double precision; a
pair counts in the first table that it shares, so counts need no list of pairs.

A bucket of more than ``CHUNK`` classes is dealt in chunks, each pair of chunks to a task of its own, so no bucket is
gathered in one place. A task hands on the number of links of each class and a star for each connected group; never all
pairs. The stars are joined by ``connected_components``.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors link
only with others of their length; each row is a vector, so rows of equal vec_id count
as several and share the smallest vec_id's component; an empty table gives no rows; only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import Scratch, chunk_sides, connected_components, deal, group_ends, union_labels, whole_groups

SAMPLE, SAMPLE_BYTES, BUCKET, CHUNK, MISS, PAIRS, MOST = 20_000, 64 << 20, 512, 4096, 1e-3, 4_000, 8
#: Bits of a code that are compared in a bucket, and the rows of it that are compared with all at a time.
CODE_BITS, BLOCK = 128, 256


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> np.ndarray:
    """A rotation after which the signs of centred ``x`` lose least (iterative quantisation from a random start)."""
    d = x.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
    for _ in range(rounds):
        code = np.where(x @ rotation >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(code.T @ x)
        rotation = (u @ v).T
    return rotation


def plan(n: int, differ: float | np.ndarray) -> tuple[int, int]:
    """(bits of a substring, tables) for ``n`` classes and the shares of bits that differ in pairs at the threshold."""
    s = int(np.clip(np.ceil(np.log2(max(n, 2) / BUCKET)), 4, 31))
    same = (1 - np.atleast_1d(differ)) ** s
    tables = int(np.ceil(np.log(MISS) / np.log(1 - same.max())))
    while tables < 10_000 and ((1 - same) ** tables).mean() > MISS:
        tables += 1
    return s, tables


@dataclass
class Coder:
    mean: np.ndarray
    rotations: list[np.ndarray]
    bits: int
    tables: int
    radius: int = CODE_BITS

    def code(self, unit: np.ndarray) -> np.ndarray:
        """Bits [row, bit] of unit vectors: those of all tables, and ``CODE_BITS`` at least."""
        x = unit - self.mean
        return np.concatenate([x @ r >= 0 for r in self.rotations], axis=1)[:, : max(self.bits * self.tables, CODE_BITS)]

    def keys(self, code: np.ndarray) -> np.ndarray:
        """[row, table]"""
        own = code[:, : self.bits * self.tables].reshape(len(code), self.tables, self.bits)
        return (own * (1 << np.arange(self.bits, dtype=np.int64))).sum(axis=2)

    def words(self, code: np.ndarray) -> np.ndarray:
        """The first ``CODE_BITS`` bits as unsigned 64-bit words [row, word]."""
        return np.packbits(code[:, :CODE_BITS], axis=1, bitorder="little").view(np.uint64)


def coding(x: np.ndarray, n: int, cosine: float, seed: int) -> Coder:
    """How to code ``n`` classes, from unit vectors ``x`` of a sample."""
    d = x.shape[1]
    mean = x.mean(axis=0) if len(x) > d else np.zeros(d)
    rng = np.random.default_rng(seed)
    own = x[rng.permutation(len(x))[:PAIRS]]
    aside = rng.normal(size=own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    turned = cosine * own + np.sqrt(1 - cosine**2) * aside
    a, b = own - mean, turned - mean
    length = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    angle = np.arccos(np.clip((a * b).sum(axis=1) / np.maximum(length, 1e-300), -1, 1)) / np.pi
    first = [learn_rotation(x - mean, seed + k) for k in range(2)]
    learned = np.mean([((a @ r >= 0) != (b @ r >= 0)).mean() for r in first])
    plain = plan(n, np.arccos(cosine) / np.pi)
    bits, tables = plan(n, np.minimum(angle * max(1, learned / max(angle.mean(), 1e-12)), 0.5))
    many = lambda bits, tables: -(-max(bits * tables, CODE_BITS) // d)
    if d > 1 and tables > MOST * plain[1]:
        coder = Coder(np.zeros(d), [learn_rotation(x, seed + k, rounds=0) for k in range(many(*plain))], *plain)
    else:
        coder = Coder(mean, [first[k] if k < 2 else learn_rotation(x - mean, seed + k) for k in range(many(bits, tables))], bits, tables)
    far = np.bitwise_count(coder.words(coder.code(own)) ^ coder.words(coder.code(turned))).sum(axis=1).astype(np.float64)
    coder.radius = int(min(CODE_BITS, np.ceil(max(far.max(initial=0), far.mean() + 5 * far.std() + 1)))) if len(far) else CODE_BITS
    return coder


def valid_unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classes(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(vec_id, name) of each row, name null where it links with nothing; and (id, cls, name, least, v, size) of each class.

    A class is named by 128 bits of hashes of its components, and numbered. ``cls`` puts its smallest vec_id before the
    name, as 8 bytes that sort as the number does, so the smallest class of a component tells the component's smallest vec_id.
    """
    element = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "double"
    v = F.transform("embedding", lambda e: (e.cast("double") + F.lit(0.0)).cast(kind))  # -0.0 becomes 0.0
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ok = F.col("v").isNotNull() & finite & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    name = F.unhex(F.concat(F.lpad(F.hex(F.xxhash64("v")), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(1), F.reverse("v"))), 16, "0")))
    rows = rows.select("vec_id", F.when(F.col("ok"), name).alias("name"), "v")
    distinct = rows.where("name is not null").groupBy("name").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"), F.any_value("v").alias("v"))
    order = F.unhex(F.lpad(F.hex(F.coalesce("least", F.lit(2**63 - 1)).bitwiseXOR(F.lit(-(2**63)))), 16, "0"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("id"), F.concat(order, "name").alias("cls"), "name", "least", "v", "size")
    return scratch.save(rows.select("vec_id", "name"), "rows"), scratch.save(distinct, "classes")


def _units(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return valid_unit(column.flatten().to_numpy().astype(np.float64).reshape(-1, d))


def _coded(distinct: DataFrame, coder: Coder, d: int) -> DataFrame:
    """(id, w0, w1, keys): the code of every class and its key in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                own = b.slice(at, 2048)
                code = coder.code(_units(own.column(1), d))
                words, keys = coder.words(code).view(np.int64), coder.keys(code).astype(np.int32)
                offsets = np.arange(len(keys) + 1, dtype=np.int32) * coder.tables
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array(words[:, 0]), pa.array(words[:, 1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))], names=["id", "w0", "w1", "keys"]
                )

    return distinct.select("id", "v").mapInArrow(run, "id long, w0 long, w1 long, keys array<int>")


def probe(w0: np.ndarray, w1: np.ndarray, t: int, coder: Coder, mixed_own: np.ndarray | None) -> np.ndarray:
    """Which rows of a bucket of table ``t`` have another one within the radius, and no earlier table in common with it
    that the carried bits tell of."""
    marked = np.zeros(len(w0), dtype=bool)
    masks = []
    for k in range(min(t, CODE_BITS // coder.bits)):
        m = ((1 << coder.bits) - 1) << (k * coder.bits)
        masks.append((np.uint64(m & (2**64 - 1)), np.uint64(m >> 64)))
    for lo in range(0, len(w0), BLOCK):
        hi = min(lo + BLOCK, len(w0))
        x0, x1 = w0[lo:hi, None] ^ w0[None], w1[lo:hi, None] ^ w1[None]
        near = np.bitwise_count(x0) + np.bitwise_count(x1) <= coder.radius
        near[np.arange(hi - lo), np.arange(lo, hi)] = False
        if mixed_own is not None:  # pairs within a chunk are another group's
            near &= mixed_own[lo:hi, None] != mixed_own[None]
        i, j = np.nonzero(near)
        y0, y1, new = x0[i, j], x1[i, j], np.ones(len(i), dtype=bool)
        for m0, m1 in masks:
            new &= ((y0 & m0) | (y1 & m1)) != 0
        marked[lo + i[new]] = True
        marked[j[new]] = True
    return marked


def links(distinct: DataFrame, d: int, n: int, scratch: Scratch, cosine: float, seed: int = 5) -> DataFrame:
    """(cls, root, n): for each class that links with another one, links to rows of others, and a class that it reaches."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    sample = distinct.select("cls", "v").orderBy(F.xxhash64("cls"), "cls").limit(most).select("v").toArrow()
    coder = coding(_units(sample.column(0), d), n, cosine, seed)
    coded = scratch.save(_coded(distinct, coder, d), f"codes-{d}")
    rows = coded.select("id", "w0", "w1", F.posexplode("keys").alias("t", "key"))
    rows = rows.select((F.col("t").cast("long") * (1 << coder.bits) + F.col("key")).alias("bucket"), "id", "w0", "w1")
    rows, by = deal(rows, "bucket", "id", CHUNK, scratch, f"hot-codes-{d}")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by, 1 << 16):
            bucket, ids = table.column("bucket").to_numpy(), table.column("id").to_numpy()
            w0, w1 = (table.column(k).to_numpy().view(np.uint64) for k in ("w0", "w1"))
            sides, out, begin = chunk_sides(table), [], 0
            for end in group_ends(*(table.column(k).to_numpy() for k in by)).tolist():
                if end - begin > 1:
                    own = sides[0][begin:end] if sides and sides[1][begin] else None
                    out.append(begin + np.flatnonzero(probe(w0[begin:end], w1[begin:end], int(bucket[begin]) >> coder.bits, coder, own)))
                begin = end
            at = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(ids[at])], names=["bucket", "id"])

    marks = scratch.save(rows.mapInArrow(mark, "bucket long, id long").distinct(), f"marks-{d}")
    vectors = marks.join(distinct.select("id", "cls", "size", "v"), "id").join(coded.select("id", "keys"), "id")
    rows, by2 = deal(vectors, "bucket", "id", CHUNK, scratch, f"hot-vectors-{d}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, by2, 8192):
            bucket, size = table.column("bucket").to_numpy(), table.column("size").to_numpy().astype(np.float64)
            unit = _units(table.column("v"), d)
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
            sides, count, label, begin = chunk_sides(table), np.zeros(len(unit)), np.arange(len(unit)), 0
            for end in group_ends(*(table.column(k).to_numpy() for k in by2)).tolist():
                m, t = end - begin, int(bucket[begin]) >> coder.bits
                own = sides[0][begin:end] if sides and sides[1][begin] else None
                x, k, part = unit[begin:end], keys[begin:end], np.arange(m)
                for lo in range(0, m if m > 1 else 0, BLOCK):
                    hi = min(lo + BLOCK, m)
                    hit = x[lo:hi] @ x.T >= cosine
                    hit[np.arange(hi - lo), np.arange(lo, hi)] = False
                    if own is not None:
                        hit &= own[lo:hi, None] != own[None]
                    if not hit.any():
                        continue
                    for earlier in range(t):
                        hit &= k[lo:hi, earlier, None] != k[None, :, earlier]
                    count[begin + lo : begin + hi] += hit @ size[begin:end]
                    i, j = np.nonzero(hit)
                    part = union_labels(m, np.concatenate([lo + i, np.arange(m)]), np.concatenate([j, part]))
                label[begin:end] = begin + part
                begin = end
            linked = np.flatnonzero(count)
            cls = table.column("cls").combine_chunks()
            yield pa.RecordBatch.from_arrays([cls.take(pa.array(linked)), cls.take(pa.array(label[linked])), pa.array(count[linked].astype(np.int64))], names=["cls", "root", "n"])

    return rows.mapInArrow(run, "cls binary, root binary, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows, distinct = classes(vectors, scratch)
    sizes = {r.d: r.n for r in distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for d, n in sizes.items():  # lengths in use: one, as a rule
        one = links(distinct.where(F.size("v") == d), d, n, scratch, cosine)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "cls binary, root binary, n long")
    found = scratch.save(found, "links")
    count = found.groupBy("cls").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v")), scratch).withColumnsRenamed({"node": "cls", "component": "comp"})
    named = distinct.join(comps, "cls", "left").join(count, "cls", "left")
    first = F.hex(F.substring("comp", 1, 8))
    least = (F.conv(first, 16, 10).cast("decimal(20,0)") - F.expr("cast(9223372036854775808 as decimal(20, 0))")).cast("long")
    component = F.when(F.col("comp").isNull(), F.col("least")).when(first != "F" * 16, least)
    named = named.select("name", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), component.alias("component_id"))
    out = rows.join(named, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
