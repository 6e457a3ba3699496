"""Measuring an index: one record of metrics, ground truth, gates and a report."""

from __future__ import annotations

import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scores import in_scope, ratio
from codeloom.operators import metrics, search
from codeloom.plans.build import node_table
from codeloom.plans.engine import Engine
from codeloom.schema import RESOLVED
from codeloom.sources import config
from codeloom.sources.files import discover, parse_files
from codeloom.work import file_system


def fixed_queries(nodes: DataFrame, n: int = 20) -> list[str]:
    """The first ``n`` distinct names, in the order of the first node of each."""
    rows = nodes.where("simple_name <> ''").groupBy("simple_name").agg(F.min("id").alias("first")).orderBy("first").limit(n)
    return [r.simple_name for r in rows.collect()]


def query_samples(engine: Engine, queries: list[str], max_tokens: int = 4000) -> DataFrame:
    """(query, ms, tokens) of a search for each query; tokens are those of the hits' sources, at most the budget."""
    rows = []
    for q in queries:
        begin = time.perf_counter()
        hits = engine.search(q).select("id").collect()
        ms = (time.perf_counter() - begin) * 1000
        used = engine.explore(q, "locate", max_tokens)["stats"]["tokens_estimated"] if hits else 0
        rows.append((q, ms, min(used, max_tokens)))
    return engine.spark.createDataFrame(rows, "query string, ms double, tokens int")


def storage_bytes(engine: Engine) -> int:
    """Of the latest version's tables."""
    m, total = engine.store.manifest(), 0
    for table, parts in m["tables"].items():
        for part, folder in parts.items():
            fs, p = file_system(engine.spark, f"{engine.store.path}/data/{folder}/{table}/part={part}")
            total += int(fs.getContentSummary(p).getLength())
    return total


def record(engine: Engine, root: str, scope: list[str] | None = None, queries: int = 20) -> dict:
    """Build the index twice and measure it. A value that wasn't measured is None, never 0."""
    begin = time.perf_counter()
    engine.build(root)
    built = time.perf_counter() - begin
    first = engine.signature()
    begin = time.perf_counter()
    engine.sync(root)
    synced = time.perf_counter() - begin
    engine.build(root)
    t, scope = engine.store.tables(), scope or []
    nodes = t["node"].where(in_scope(F.col("file"), scope))
    own = nodes.select(F.col("id").alias("from_id"))
    edges, still = (t[k].join(own, "from_id", "left_semi") for k in ("edge", "unresolved_reference"))
    counts = metrics.edge_counts(edges, still).first()
    cover = metrics.cross_file_coverage(t["node"], t["edge"], scope).first()
    files = discover(engine.spark, root).where(in_scope(F.col("file"), scope)).count()
    bad = t["parsed_file"].where(F.col("has_error") & in_scope(F.col("file"), scope)).count()
    p = query_samples(engine, fixed_queries(nodes, queries)).agg(F.percentile("ms", [0.5, 0.95]).alias("ms"), F.percentile("tokens", [0.5, 0.95]).alias("tokens")).first()
    return {
        "index_seconds": built, "sync_seconds": synced, "files": files, "nodes": nodes.count(), "edges_total": counts.total, "edges_resolved": counts.resolved,
        "edges_ambiguous": counts.ambiguous, "ambiguous_edge_rate": counts.ambiguous / counts.total if counts.total else 0.0, "cross_file_dependent_coverage": cover.coverage,
        "parse_error_rate": bad / files if files else 0.0, "storage_bytes": storage_bytes(engine), "deterministic_rebuild": engine.signature() == first,
        "latency_p50_ms": p.ms and p.ms[0], "latency_p95_ms": p.ms and p.ms[1], "tokens_p50": p.tokens and p.tokens[0], "tokens_p95": p.tokens and p.tokens[1],
    }


def evaluate(engine: Engine, truth: dict[str, DataFrame]) -> DataFrame:
    """One row of node recall, edge precision and recall, ambiguity recall, top-k recall and MRR against expected tables.

    Edges count where both ends are expected nodes. An expected edge that can't be resolved is found as a candidate.
    """
    t = engine.store.tables()
    names = t["node"].select("id", "qualified_name")
    node = truth["nodes"].select("qualified_name").distinct()
    found_nodes = metrics.precision_recall(names, node, ["qualified_name"]).select(F.col("recall").alias("node_recall"))
    inside = names.join(node, "qualified_name", "left_semi")
    a = inside.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("from_name"))
    b = inside.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("to_name"))
    keys = ["from_name", "to_name", "type"]
    expected = truth["edges"]
    kinds = expected.select("type").distinct()
    found = t["edge"].where(F.col("confidence") >= RESOLVED).join(kinds, "type", "left_semi").join(a, "from_id").join(b, "to_id").select(*keys)
    edges = metrics.precision_recall(found, expected.where("resolvable"), keys).select(F.col("precision").alias("edge_precision"), F.col("recall").alias("edge_recall"))
    open_ = t["unresolved_reference"].select("from_id", "type", F.explode("candidates").alias("to_id")).join(a, "from_id").join(b, "to_id").select(*keys)
    open_ = metrics.precision_recall(open_, expected.where("not resolvable"), keys).select(F.col("recall").alias("ambiguity_recall"))
    rows, wanted, k = [], [], 1
    for q in truth["queries"].collect():
        k = max(k, q.k)
        hits = engine.search(q["query"], q.k).select("qualified_name", "score").orderBy(F.desc("score"), "qualified_name").collect()
        rows += [(q["query"], h.qualified_name, n + 1) for n, h in enumerate(hits)]
        wanted += [(q["query"], e) for e in q.expected]
    ranked = engine.spark.createDataFrame(rows, "query string, id string, rank int")
    asked = metrics.ranks(ranked, engine.spark.createDataFrame(wanted, "query string, id string"), k).select(F.col("recall").alias("topk_recall"), "mrr")
    return found_nodes.crossJoin(edges).crossJoin(open_).crossJoin(asked)  # one row each


def resolved_share(counts: DataFrame) -> DataFrame:
    return counts.withColumn("resolved_rate", ratio(F.col("resolved"), F.col("total")))


#: Names of a record's metrics.
METRICS = [
    "index_seconds", "sync_seconds", "files", "nodes", "edges_total", "edges_resolved", "edges_ambiguous", "ambiguous_edge_rate", "cross_file_dependent_coverage", "parse_error_rate",
    "storage_bytes", "deterministic_rebuild", "latency_p50_ms", "latency_p95_ms", "tokens_p50", "tokens_p95",
]


def measured_by(engine: Engine, adapter: str, root: str, scope: list[str] | None = None, truth: str | None = None) -> dict:
    """A record of ``self`` (this engine), ``grep`` (literal search) or ``external:<command>``, with its ``status``: what can't
    be run is SKIP with a ``reason``, never FAIL."""
    if adapter == "self":
        out = record(engine, root, scope)
        if truth:
            out["correctness"] = evaluate(engine, config.ground_truth(engine.spark, truth)).first().asDict()
        return out | {"adapter": adapter, "status": "OK"}
    if adapter == "grep":
        return grep_record(engine, root, scope) | {"adapter": adapter, "status": "OK"}
    if adapter.startswith("external:"):
        with tempfile.TemporaryDirectory() as folder:
            begin = time.perf_counter()
            found, reason = config.run_metrics(adapter.removeprefix("external:"), root, folder, METRICS)
        if found is not None:
            return {"index_seconds": time.perf_counter() - begin} | found | {"adapter": adapter, "status": "OK"}
        return {"adapter": adapter, "status": "SKIP", "reason": reason}
    return {"adapter": adapter, "status": "SKIP", "reason": "no such adapter here"}


def grep_record(engine: Engine, root: str, scope: list[str] | None = None, queries: int = 20, max_tokens: int = 4000) -> dict:
    """What literal search of the fixed queries costs; what it can't measure is None."""
    files = discover(engine.spark, root).where(in_scope(F.col("file"), scope or [])).select("file", F.decode("content", "utf-8").alias("text"))
    nodes = node_table(parse_files(discover(engine.spark, root)), engine.repo).where(in_scope(F.col("file"), scope or []))
    rows = []
    for q in fixed_queries(nodes, queries):
        begin = time.perf_counter()
        found = search.literal_matches(files, F.col("text"), q, "file").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first().n
        rows.append((q, (time.perf_counter() - begin) * 1000, min(int(found), max_tokens)))
    p = engine.spark.createDataFrame(rows, "query string, ms double, tokens int").agg(F.percentile("ms", [0.5, 0.95]).alias("ms"), F.percentile("tokens", [0.5, 0.95]).alias("tokens")).first()
    out = dict.fromkeys(METRICS) | {"files": files.count()}
    return out | {"latency_p50_ms": p.ms and p.ms[0], "latency_p95_ms": p.ms and p.ms[1], "tokens_p50": p.tokens and p.tokens[0], "tokens_p95": p.tokens and p.tokens[1]}


def report(values: dict, gate_rows: DataFrame | None = None) -> str:
    """A Markdown report of a record and its gates."""

    def shown(v) -> str:
        return "_not measured_" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)

    lines = ["# Measurement", "", "| Metric | Value |", "|-|-|", *(f"| {k} | {shown(values[k])} |" for k in sorted(values))]
    if gate_rows is not None:
        lines += ["", "## Gates", "", "| Gate | Wanted | Value | Status |", "|-|-|-|-|"]
        lines += [f"| {r.key} | {r.op} {r.target:g} | {shown(r.value)} | {r.status} |" for r in gate_rows.orderBy("key").collect()]
        lines += ["", f"Overall: {metrics.overall(gate_rows).first().status}"]
    return "\n".join(lines) + "\n"


def verify(engine: Engine, root: str) -> dict:
    """Checks of an index against its sources: it is there, a rebuild and a sync give the same graph, each edge has evidence and
    both its ends, and no reference with several candidates is an edge, too."""
    engine.build(root)
    first = engine.signature()
    engine.build(root)
    t = engine.tables()
    ids = t["node"].select("id")
    lost = t["edge"].join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti").unionByName(t["edge"].join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*t["edge"].columns))
    bare = t["edge"].join(t["evidence"].select(F.col("edge_id").alias("id")), "id", "left_anti")
    both = t["unresolved_reference"].where(F.size("candidates") < 2)
    checks = {
        "indexed": not t["node"].isEmpty(), "deterministic_rebuild": engine.signature() == first, "sync_changes_nothing": engine.sync(root)["path"] == "none",
        "edges_have_ends": lost.isEmpty(), "edges_have_evidence": bare.isEmpty(), "ambiguities_have_candidates": both.isEmpty(),
    }
    return {"passed": all(checks.values()), "checks": checks}
