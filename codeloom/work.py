"""Written intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None
_open: list[Work] = []


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (unset, as in tests) a temporary folder of this machine."""
    global _local_root
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="codeloom-")
    return f"file://{_local_root}"


class Work:
    """Tables of one job; they cut its plans into short ones and survive lost executors.

    Tables that a returned DataFrame still reads stay until the driver's Python ends, or until the ``work_ends`` that the job
    ran under does; ``drop`` removes one of them, or all, early.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            delete(self.spark, f"{self.root}/{name}".rstrip("/"))
        except Exception:  # the session may have ended; the folder is then the cluster's to clear
            pass


@contextlib.contextmanager
def work_ends() -> Iterator[None]:
    """Drop the tables of all jobs that were begun within, so that a process which answers many questions keeps none."""
    before = len(_open)
    try:
        yield
    finally:
        for work in _open[before:]:
            work.drop()
        del _open[before:]


@atexit.register
def _drop_all() -> None:
    for work in _open:
        work.drop()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
