"""A property graph over a star schema: entities are symbols, their keys are references.

Order lines are the raw calls of orders to parts, each a piece of evidence; parts of one name are candidates of one
reference. The same view in SQL is ``GRAPH_SQL``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, kind, file, qualified_name, simple_name, owner_id)."""

    def of(name: str, key: str, symbol: str, file: Column, simple: Column, owner: Column) -> DataFrame:
        rows = table(spark, sf_dir, name)
        return rows.select(_id(name, key).alias("id"), F.lit(symbol).alias("kind"), file.alias("file"), simple.alias("simple_name"), owner.alias("owner_id"))

    none = F.lit(None).cast("string")
    each = [
        of("region", "r_regionkey", "interface", F.lit("region"), F.col("r_name"), none),
        of("nation", "n_nationkey", "class", F.concat(F.lit("region/"), F.col("n_regionkey")), F.col("n_name"), _id("region", "n_regionkey")),
        of("customer", "c_custkey", "class", F.concat(F.lit("segment/"), F.col("c_mktsegment")), F.col("c_name"), _id("nation", "c_nationkey")),
        of("supplier", "s_suppkey", "class", F.concat(F.lit("nation/"), F.col("s_nationkey")), F.col("s_name"), _id("nation", "s_nationkey")),
        of("part", "p_partkey", "method", F.concat(F.lit("brand/"), F.col("p_brand")), F.col("p_name"), none),
        of("orders", "o_orderkey", "method", F.concat(F.lit("month/"), F.date_format("o_orderdate", "yyyy-MM")), F.concat(F.lit("order"), F.col("o_orderkey")), _id("customer", "o_custkey")),
    ]
    out = reduce(DataFrame.unionByName, each)
    return out.select("id", "kind", "file", F.concat_ws("#", "file", "simple_name").alias("qualified_name"), "simple_name", "owner_id")


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw references of orders to parts, one an order line: (from_id, to_id, type, confidence, file, line, candidates)."""
    return table(spark, sf_dir, "lineitem").select(
        _id("orders", "l_orderkey").alias("from_id"),
        _id("part", "l_partkey").alias("to_id"),
        F.lit("CALLS").alias("type"),
        F.round(1 - 5 * F.col("l_discount"), 4).alias("confidence"),
        F.concat(F.lit("ship/"), F.date_format("l_shipdate", "yyyy-MM")).alias("file"),
        F.col("l_linenumber").alias("line"),
        # Returned lines are raw references that had two candidates.
        F.when(F.col("l_returnflag") == "R", F.array(_id("part", "l_partkey"), _id("supplier", "l_suppkey"))).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, type, confidence) of the keys between tables; parts reference the suppliers they are bought from."""

    def of(name: str, a: tuple[str, str], b: tuple[str, str], kind: str, confidence: float) -> DataFrame:
        return table(spark, sf_dir, name).select(_id(*a).alias("from_id"), _id(*b).alias("to_id"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"))

    each = [
        of("nation", ("nation", "n_nationkey"), ("region", "n_regionkey"), "IMPLEMENTS", 1.0),
        of("customer", ("customer", "c_custkey"), ("nation", "c_nationkey"), "EXTENDS", 1.0),
        of("supplier", ("supplier", "s_suppkey"), ("nation", "s_nationkey"), "EXTENDS", 1.0),
        of("orders", ("orders", "o_orderkey"), ("customer", "o_custkey"), "IMPORTS", 0.95),
        of("lineitem", ("part", "l_partkey"), ("supplier", "l_suppkey"), "REFERENCES", 0.7).distinct(),
    ]
    return reduce(DataFrame.unionByName, each)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id, type, confidence, ambiguous_candidates) of the whole graph."""
    calls = raw_calls(spark, sf_dir).groupBy("from_id", "to_id", "type").agg(F.max("confidence").alias("confidence"))
    return calls.unionByName(structure(spark, sf_dir)).withColumn("ambiguous_candidates", F.array().cast("array<string>"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, ids): parts of each name."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_name").alias("name")).agg(F.array_sort(F.collect_list(_id("part", "p_partkey"))).alias("ids"))


GRAPH_SQL = """
node AS (
  SELECT 'region:' || r_regionkey AS id, 'interface' AS kind, 'region' AS file, r_name AS simple_name, NULL AS owner_id FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'class', 'region/' || n_regionkey, n_name, 'region:' || n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'class', 'segment/' || c_mktsegment, c_name, 'nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'class', 'nation/' || s_nationkey, s_name, 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'method', 'brand/' || p_brand, p_name, NULL FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, 'method', 'month/' || strftime(o_orderdate, '%Y-%m'), 'order' || o_orderkey, 'customer:' || o_custkey FROM orders
), raw_call AS (
  SELECT 'orders:' || l_orderkey AS from_id, 'part:' || l_partkey AS to_id, 'CALLS' AS type, round(1 - 5 * l_discount, 4) AS confidence,
    'ship/' || strftime(l_shipdate, '%Y-%m') AS file, l_linenumber AS line,
    CASE WHEN l_returnflag = 'R' THEN ['part:' || l_partkey, 'supplier:' || l_suppkey] ELSE [] END AS candidates FROM lineitem
), edge AS (
  SELECT from_id, to_id, type, max(confidence) AS confidence FROM raw_call GROUP BY from_id, to_id, type
  UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IMPLEMENTS', 1.0 FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'EXTENDS', 1.0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'EXTENDS', 1.0 FROM supplier
  UNION ALL SELECT 'orders:' || o_orderkey, 'customer:' || o_custkey, 'IMPORTS', 0.95 FROM orders
  UNION ALL SELECT DISTINCT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'REFERENCES', 0.7 FROM lineitem
)"""
