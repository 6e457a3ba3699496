"""Source files of a repository as tables: discovery, content hashes, parsing, and change logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.schema import PARSED_FILE
from codeloom.work import file_system

#: Folders that hold no sources of their own.
SKIPPED = [".git", "target", "build", "out", "node_modules"]


def discover(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """(file, content, content_hash) of the files under ``root``, their names relative to it; build output is left out."""
    read = _binary(spark).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return _named(spark, read.load(root.rstrip("/")), root.rstrip("/"))


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """The same of some files, named relative to the root; those that aren't there, or aren't watched, are left out."""
    root = root.rstrip("/")
    found = []
    for name in sorted(set(names)):
        fs, p = file_system(spark, f"{root}/{name}")
        if watched(name) and fs.exists(p):
            found.append(f"{root}/{name}")
    if not found:
        return spark.createDataFrame([], "file string, content binary, content_hash string")
    return _named(spark, _binary(spark).load(found), root)


def watched(name: str) -> bool:
    return name.endswith(".java") and not set(name.split("/")) & set(SKIPPED)


def _binary(spark: SparkSession) -> DataFrameReader:
    """A file that vanishes between listing and reading is as if it had not been there."""
    return spark.read.format("binaryFile").option("ignoreMissingFiles", True)


def _named(spark: SparkSession, raw: DataFrame, root: str) -> DataFrame:
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = base.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(base).toUri().getPath()
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9+.-]+:(?://[^/]*)?(?=/)", ""), r"%20", " ")
    file = F.substring(path, len(base.rstrip("/")) + 2, 1 << 20)
    kept = raw.select(file.alias("file"), "content")
    return kept.where(~F.exists(F.split("file", "/"), lambda p: p.isin(SKIPPED))).withColumn("content_hash", F.sha2("content", 256))


def parse_files(files: DataFrame) -> DataFrame:
    """The parsed-file table of (file, content): symbols and raw references as nested columns."""
    schema = files.sparkSession.createDataFrame([], PARSED_FILE).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        from codeloom.sources.java import parse

        kind = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = (content or b"").decode("utf-8", errors="replace")
                p = parse(source)
                rows.append({"file": file, "content_hash": hashlib.sha256(content or b"").hexdigest(), "source": source, **vars(p)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return files.select("file", "content").mapInArrow(run, schema)


def parse_with_cache(files: DataFrame, cache: DataFrame) -> DataFrame:
    """The same, taking files whose content is known from ``cache``, a parsed-file table."""
    names = StructType.fromDDL(PARSED_FILE).names
    hit = files.select("file", "content_hash").join(cache.select(*names), ["file", "content_hash"])
    miss = files.join(cache.select("file", "content_hash"), ["file", "content_hash"], "left_anti")
    return hit.select(*names).unionByName(parse_files(miss))
