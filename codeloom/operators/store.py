"""Store operators over tables: freshness, replacement by file, cascading deletion, identity proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(file, change) of files that were added, changed or removed: (file, content_hash) of either side."""
    both = stored.select("file", F.col("content_hash").alias("old")).join(current.select("file", F.col("content_hash").alias("new")), "file", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def replace_by_file(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """``old`` with all rows of ``files`` replaced by ``new``."""
    return old.join(files.select("file").distinct(), "file", "left_anti").unionByName(new)


def removed_ids(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Ids of nodes of ``files`` that are no longer there."""
    return old.join(files.select("file").distinct(), "file", "left_semi").select("id").join(new.select("id"), "id", "left_anti")


def delete_cascade(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, unresolved: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    """The tables without nodes of ``files``, edges at either end of those, and what hangs on them."""
    gone = files.select("file").distinct()
    kept = nodes.join(gone, "file", "left_anti")
    ids = kept.select("id")
    e = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    v = evidence.join(e.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    u = unresolved.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi")
    return {"node": kept, "edge": e, "evidence": v, "unresolved_reference": u}


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows that only one side has, with the side: empty if the two are equal as sets."""
    rows = a.select(*keys, F.lit(1).alias("side")).unionByName(b.select(*keys, F.lit(2).alias("side")))
    sides = rows.groupBy(*keys).agg(F.sum_distinct("side").alias("side"))
    return sides.where("side < 3")
