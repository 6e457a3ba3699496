"""Keeping an index fresh from a stream of file changes.

Changes arrive as JSON rows (path, op, ts) in a folder; Spark's file stream sees each new file once. A micro-batch is
collapsed to the distinct paths it names: the order of events isn't trusted, the files themselves tell the final state. Only
those files are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.plans.engine import Engine
from codeloom.sources.files import SKIPPED, read_files

CHANGE = "path string, op string, ts timestamp"
#: Paths of a batch that are looked at one by one.
MANY = 1000


def changes(spark: SparkSession, log: str) -> DataFrame:
    """The stream of changes to watched files: Java sources outside of build output."""
    raw = spark.readStream.schema(CHANGE).json(log)
    return raw.where(F.col("path").endswith(".java") & ~F.exists(F.split("path", "/"), lambda p: p.isin(SKIPPED)))


def sessions(stream: DataFrame, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """(path, begin, end, n): changes of a path that follow within ``gap``, as one; events later than ``late`` are left out."""
    s = stream.withWatermark("ts", late).groupBy("path", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("path", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def watch(engine: Engine, root: str, log: str, checkpoint: str, debounce: str = "2 seconds", done: Callable[[dict], None] | None = None, once: bool = False) -> StreamingQuery:
    """Sync the index for every micro-batch of changes; ``done`` gets each sync's result and the paths that ``changed`` and that
    were ``deleted``. A batch of over ``MANY`` paths is synced by listing the root. ``query.stop()`` ends it."""

    def batch(df: DataFrame, number: int) -> None:
        paths = [r.path for r in df.select("path").distinct().limit(MANY + 1).collect()]
        if not paths:
            return
        few = paths if len(paths) <= MANY else None
        result = engine.sync(root, few)
        if done:
            there = {r.file for r in read_files(engine.spark, root, paths).select("file").collect()} if few else set()
            done({"batch": number, "paths": len(paths), "changed": sorted(there), "deleted": sorted(set(few or []) - there), **result})

    out = changes(engine.spark, log).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=debounce)).start()
