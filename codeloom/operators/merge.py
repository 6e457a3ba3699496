"""Merging raw rows into keyed ones: edges, evidence, unresolved references, and compiler-derived edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import short_id
from codeloom.schema import TYPED


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge for each (from_id, to_id, type) of ``raw`` (.., confidence, file, line, candidates): of the most confident row,
    the first by file and line; candidates are united, and ``sites`` counts distinct places."""
    key = ["from_id", "to_id", "type"]
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates"))))  # sites of one name have one list
    site = F.count_distinct(F.struct("file", "line"))
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), "file", "line"))
    out = raw.groupBy(*key).agg(best.alias("best"), site.alias("sites"), flat.alias("ambiguous_candidates"))
    return out.select(short_id(*key).alias("id"), *key, (-F.col("best.minus")).alias("confidence"), F.col("best.file").alias("file"), F.col("best.line").alias("line"), "sites", "ambiguous_candidates")


def evidence(raw: DataFrame) -> DataFrame:
    """One row for each (edge, file, line); ambiguous where the raw rows have candidates."""
    rows = raw.select(short_id("from_id", "to_id", "type").alias("edge_id"), "file", "line", (F.size("candidates") > 0).alias("ambiguous"))
    rows = rows.groupBy("edge_id", "file", "line").agg(F.bool_or("ambiguous").alias("ambiguous"))
    status = F.when(F.col("ambiguous"), "ambiguous").otherwise("verified")
    return rows.select(short_id("edge_id", "file", F.col("line").cast("string")).alias("id"), "edge_id", "file", "line", status.alias("verification_status"))


def merge_unresolved(raw: DataFrame) -> DataFrame:
    """One row for each (from_id, type, target_name) of ``raw`` (.., candidates, reason, file, line): candidates united, the first
    site, the reason of the last one, and how many sites there are."""
    key = ["from_id", "type", "target_name"]
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_set("candidates"))))
    site = F.struct("file", "line")
    out = raw.groupBy(*key).agg(
        flat.alias("candidates"), F.min(site).alias("first"), F.max(F.struct("file", "line", "reason")).alias("last"), F.count_distinct(site).cast("int").alias("site_count")
    )
    return out.select(
        short_id(*key).alias("id"), *key, "candidates", F.col("last.reason").alias("reason"), F.col("first.file").alias("file"), F.col("first.line").alias("line"), "site_count"
    )


def merge_typed(base: DataFrame, typed: DataFrame) -> DataFrame:
    """``base`` edges (from_id, to_id, type, confidence, provenance) with those a compiler has found, ``typed`` (from_id, to_id,
    type without suffix).

    A typed pair takes over its base edge: its type gets the suffix, its confidence rises to the typed one at least, and its
    provenance names both; a pair without one is added; an edge that is typed already stays.
    """
    key = ["from_id", "to_id", "type"]
    found = typed.select(*key).distinct().withColumn("found", F.lit(True))
    done = base.where(F.col("type").endswith("_TYPED"))
    plain = base.where(~F.col("type").endswith("_TYPED"))
    again = done.select("from_id", "to_id", F.regexp_replace("type", "_TYPED$", "").alias("type"))
    joined = plain.join(found.join(again, key, "left_anti"), key, "full_outer")
    names = F.array_join(F.array_sort(F.array_distinct(F.concat(F.split("provenance", r"\+"), F.array(F.lit("scip_java"))))), "+")
    is_typed = F.col("found").isNotNull()
    merged = joined.select(
        "from_id",
        "to_id",
        F.when(is_typed, F.concat("type", F.lit("_TYPED"))).otherwise(F.col("type")).alias("type"),
        F.when(is_typed, F.greatest(F.lit(TYPED), F.col("confidence"))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(is_typed & F.col("provenance").isNull(), "scip_java").when(is_typed, names).otherwise(F.col("provenance")).alias("provenance"),
    )
    return merged.unionByName(done.select(*merged.columns))


def merge_provenance(a, b):
    """Names of two provenances, sorted and joined by plus signs."""
    return F.array_join(F.array_sort(F.array_union(F.split(a, r"\+"), F.split(b, r"\+"))), "+")
