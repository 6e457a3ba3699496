"""Measurement: counts, coverage, precision and recall, ranks, percentiles, signatures and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scores import gate_status, in_scope, is_resolved, ratio


def edge_counts(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """(total, resolved, ambiguous): candidates of unresolved references count as ambiguous edges, and in the total."""
    e = edges.agg(
        F.count("*").alias("edges"),
        F.sum(is_resolved(F.col("confidence"), F.col("ambiguous_candidates")).cast("long")).alias("resolved"),
        F.sum(F.size("ambiguous_candidates").cast("long")).alias("listed"),
    )
    u = unresolved.agg(F.sum(F.size("candidates").cast("long")).alias("open"))
    both = e.crossJoin(u)  # one row each
    ambiguous = F.coalesce("listed", F.lit(0)) + F.coalesce("open", F.lit(0))
    return both.select((F.col("edges") + F.coalesce("open", F.lit(0))).alias("total"), F.coalesce("resolved", F.lit(0)).alias("resolved"), ambiguous.alias("ambiguous"))


def cross_file_coverage(nodes: DataFrame, edges: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(covered, files, coverage): files that a resolved edge from another file reaches, of all that have nodes.

    With ``scope``, prefixes of files, both files must be in it.
    """
    of = nodes.where(in_scope(F.col("file"), scope or [])).select("id", "file")
    own = of.select("file").distinct()
    e = edges.where(is_resolved(F.col("confidence"), F.col("ambiguous_candidates"))).select("from_id", "to_id")
    a = of.select(F.col("id").alias("from_id"), F.col("file").alias("from_file"))
    b = of.select(F.col("id").alias("to_id"), F.col("file").alias("to_file"))
    reached = e.join(a, "from_id").join(b, "to_id").where("from_file <> to_file").select(F.col("to_file").alias("file")).distinct()
    covered = reached.agg(F.count("*").alias("covered"))
    files = own.agg(F.count("*").alias("files"))
    return covered.crossJoin(files).select("covered", "files", ratio(F.col("covered"), F.col("files")).alias("coverage"))


def percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, p50, p95): percentiles with interpolation, both ends included."""
    p = df.groupBy(group).agg(F.percentile(value, [0.5, 0.95]).alias("p"))
    return p.select(group, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


def ranks(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """(queries, recall, mrr) of ``results`` (query, id, rank) against any of ``expected`` (query, id) within the first ``k``."""
    hit = results.where(F.col("rank") <= k).join(expected, ["query", "id"]).groupBy("query").agg(F.min("rank").alias("rank"))
    each = expected.select("query").distinct().join(hit, "query", "left")
    return each.agg(
        F.count("*").alias("queries"), F.avg(F.col("rank").isNotNull().cast("double")).alias("recall"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr")
    )


def precision_recall(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(found, expected, shared, precision, recall) of distinct rows; null where nothing is to be divided by."""
    f, e = found.select(*keys).distinct(), expected.select(*keys).distinct()
    counts = f.agg(F.count("*").alias("found")).crossJoin(e.agg(F.count("*").alias("expected"))).crossJoin(f.join(e, keys, "left_semi").agg(F.count("*").alias("shared")))
    share = lambda d: F.try_divide(F.col("shared").cast("double"), F.col(d))
    return counts.select("found", "expected", "shared", share("found").alias("precision"), share("expected").alias("recall"))


#: What a graph's signature is made from: all but times, commits, provenance and evidence.
SIGNED = {
    "node": ["id", "kind", "qualified_name", "simple_name", "file", "span_start", "span_end", "signature", "is_entry_point", "entry_point_kind"],
    "edge": ["id", "from_id", "to_id", "type", "confidence", "ambiguous_candidates"],
    "unresolved_reference": ["id", "from_id", "type", "target_name", "candidates", "reason", "site_count"],
}


def _signed(df: DataFrame, name: str) -> DataFrame:
    """A hash of each row: its columns of ``SIGNED`` that there are, lists in order, nulls apart from empty texts."""

    def text(c: str) -> Column:
        kind = dict(df.dtypes)[c]
        own = F.array_join(F.array_sort(c), ",") if kind.startswith("array") else F.format_string("%.6f", c) if kind == "double" else F.col(c).cast("string")
        return F.coalesce(F.concat(F.lit("="), own), F.lit("-"))

    return df.select(F.sha2(F.concat_ws("|", F.lit(name), *(text(c) for c in SIGNED[name] if c in df.columns)), 256).alias("h"))


def graph_signature(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """One hash of the graph's content, whatever the order of its rows or how they are partitioned.

    Rows of all three tables are hashed one by one and the hashes' 32-bit parts are summed, so nothing is gathered or sorted.
    """
    rows = _signed(nodes, "node").unionByName(_signed(edges, "edge")).unionByName(_signed(unresolved, "unresolved_reference"))
    parts = [F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long")).alias(f"p{k}") for k in range(8)]
    sums = rows.agg(F.count("*").alias("rows"), *parts)
    return sums.select("rows", F.sha2(F.concat_ws("|", "rows", *(f"p{k}" for k in range(8))), 256).alias("signature"))


def gates(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """(key, op, target, value, gap, status) of each gate (key, op, target) for metrics (key, value)."""
    rows = targets.join(measured, "key", "left")
    return rows.select("key", "op", "target", "value", (F.col("value") - F.col("target")).alias("gap"), gate_status(F.col("op"), F.col("value"), F.col("target")).alias("status"))


def overall(gate_rows: DataFrame) -> DataFrame:
    """PASS if there are gates and all pass, else FAIL: what wasn't measured hasn't passed."""
    s = gate_rows.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "PASS").alias("ok"))
    return s.select(F.when((F.col("n") > 0) & (F.col("ok") == F.col("n")), "PASS").otherwise("FAIL").alias("status"))
