"""Shared plumbing: scratch tables in the cluster's shared folder, Arrow batches, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.work import Work

#: Written tables that cut lineage and survive lost executors.
Scratch = Work


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``rows``, fewer where rows are large, so that Python holds little at a time."""
    for batch in batches:
        n = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)


def quiet_tokenizers() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def with_columns_of(docs: DataFrame, changed: dict) -> DataFrame:
    """``docs`` with some columns replaced by expressions, in the same order and with the same types."""
    kinds = dict(docs.dtypes)
    return docs.withColumns({c: e.cast(kinds[c]) for c, e in changed.items() if c in kinds})


def free_prefix(names: list[str], prefix: str) -> str:
    """``prefix``, made longer until no name begins with it, whatever the case."""
    while any(c.lower().startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def connected_components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """Component of each node that has an edge: (node, component), the component being its smallest node.

    Alternates large-star and small-star rounds, and emits at most one row per edge, so a component of any size converges
    in O(log^2) rounds without gathering it in one task. The star of a hot node is a group-wise minimum, aggregated before
    it is shuffled, and written before it is joined back: both sides of that join are plain shuffles, which Spark splits
    where they are skewed. Null ends and self links are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    e = scratch.save(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-0")
    step, last = 0, None
    while True:
        # Large star: every neighbour above a node goes to the smallest of the node and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-large-least")
        above = e.select(F.col("v").alias("u"), F.col("u").alias("v"))  # the neighbours above u, as u > v in every row
        large = scratch.save(above.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        # Small star: a node's smaller neighbours, and the node, go to the smallest of them.
        least = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small-least")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        nxt = scratch.save(nxt, f"cc-{step}")
        sums = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u"), F.count_distinct("u")).first()
        scratch.drop(f"cc-{step - 1}")
        e = nxt
        if sums[0] == sums[3] and sums == last or sums[0] == 0:
            break
        last = sums
    for name in ("cc-large-least", "cc-large", "cc-small-least"):
        scratch.drop(name)
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def deal(rows: DataFrame, key: str, of: str, size: int, scratch: Scratch, name: str) -> tuple[DataFrame, list[str]]:
    """``rows`` dealt out and sorted by ``key``, and the columns that tell groups apart.

    A key of more than ``size`` rows is cut into chunks of about that many by the hash of ``of``, and every pair of chunks
    is a group of its own: columns ``a`` <= ``b`` name the pair and ``own`` the row's chunk. Every two rows of a key meet in
    one group if their chunks differ and in one if they are the same; a group has about ``2 * size`` rows at most.
    """
    n = n_partitions(rows.sparkSession)
    hot = scratch.save(rows.groupBy(key).count().where(F.col("count") > size), name)
    if hot.isEmpty():
        return rows.repartition(n, key).sortWithinPartitions(key), [key]
    chunks = F.coalesce(F.ceil(F.col("count") / size), F.lit(1)).cast("int")
    rows = rows.join(hot, key, "left").withColumn("chunks", chunks).drop("count")
    rows = rows.withColumn("own", F.pmod(F.xxhash64(of, F.lit(17)), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("other", "chunks")
    by = [key, "a", "b"]
    return rows.repartition(n, *by).sortWithinPartitions(*by), by


def chunk_sides(table: pa.Table) -> tuple["np.ndarray", "np.ndarray"] | None:  # noqa: F821
    """(own, mixed) of rows that ``deal`` has cut into chunks: the row's chunk, and whether its group is of two chunks."""
    if "own" not in table.column_names:
        return None
    own, a, b = (table.column(k).to_numpy() for k in ("own", "a", "b"))
    return own, a != b


def group_ends(*keys) -> "np.ndarray":  # noqa: F821
    """Where each run of equal keys ends, in sorted columns."""
    import numpy as np

    n = len(keys[0])
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change) + 1, n) if n else np.zeros(0, np.int64)


def union_labels(n: int, a, b):
    """Smallest index that each of ``n`` nodes reaches over the links ``a[i] - b[i]``."""
    import numpy as np

    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            return label
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Rows sorted by ``keys`` as tables of whole groups, of about ``rows`` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        ends = group_ends(*(table.column(k).to_numpy() for k in keys))
        if len(ends) > 1:
            cut = int(ends[-2])
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            size -= cut
    if held:
        yield pa.Table.from_batches(held)
