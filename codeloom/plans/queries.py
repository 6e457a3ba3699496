"""Registered queries: every operator over whole tables, and the same in SQL."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions import names as N
from codeloom.functions.scores import argument_score, in_scope, token_estimate
from codeloom.operators import graph, merge, metrics, rank, resolve, search, store
from codeloom.plans import java_queries  # noqa: F401  registers its queries
from codeloom.plans.build import PROVENANCE
from codeloom.plans.engine import debug_tables, named_members
from codeloom.plans.registry import ORACLE_SQL, QUERIES, query
from codeloom.sources.tables import edges, nodes, part_names, raw_calls, structure, table
from codeloom.streaming.watch import sessions
from codeloom.work import Work

__all__ = ["ORACLE_SQL", "QUERIES"]


def _stored(spark: SparkSession, **tables: DataFrame) -> list[DataFrame]:
    """Tables that a query reads several times, written once, as an index would have them."""
    work = Work(spark, "query")
    return [work.save(df, name) for name, df in tables.items()]


def r6(c):
    return F.round(c, 6)


# Counts


@query("SELECT kind, count(*) AS n, count(DISTINCT file) AS files FROM node GROUP BY kind")
def node_stats(spark, sf):
    return nodes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query("SELECT type, count(*) AS n FROM edge GROUP BY type")
def edge_type_counts(spark, sf):
    return edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("""
, open AS (SELECT sum(n) AS n FROM (SELECT count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1))
SELECT (count(*) + (SELECT n FROM open))::BIGINT AS total, count(*) FILTER (confidence >= 0.5)::BIGINT AS resolved, (SELECT n FROM open)::BIGINT AS ambiguous FROM edge
""")
def resolved_edge_counts(spark, sf):
    unresolved = part_names(spark, sf).where(F.size("ids") > 1).select(F.col("ids").alias("candidates"))
    return metrics.edge_counts(edges(spark, sf), unresolved)


@query("""
SELECT count(*) AS n, count(DISTINCT file) AS files FROM node WHERE starts_with(file, 'brand/') OR starts_with(file, 'nation/')
""")
def scoped_node_counts(spark, sf):
    return nodes(spark, sf).where(in_scope(F.col("file"), ["brand/", "nation/"])).agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"))


@query("""
SELECT count(DISTINCT b.file) AS covered, (SELECT count(DISTINCT file) FROM node) AS files,
  round(count(DISTINCT b.file) / (SELECT count(DISTINCT file) FROM node), 6) AS coverage
FROM edge e JOIN node a ON e.from_id = a.id JOIN node b ON e.to_id = b.id WHERE a.file <> b.file AND e.confidence >= 0.5
""")
def cross_file_coverage(spark, sf):
    return metrics.cross_file_coverage(nodes(spark, sf), edges(spark, sf)).withColumn("coverage", r6("coverage"))


@query(
    """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type
""",
    False,
)
def latency_percentiles(spark, sf):
    return metrics.percentiles(table(spark, sf, "events"), "event_type", "value").select("event_type", r6("p50").alias("p50"), r6("p95").alias("p95"))


# Lookups


@query("SELECT id, kind, simple_name, file FROM node WHERE id = 'nation:3'")
def point_lookup(spark, sf):
    return nodes(spark, sf).where(F.col("id") == "nation:3").select("id", "kind", "simple_name", "file")


@query("SELECT e.from_id, e.to_id, e.type, e.confidence FROM edge e WHERE e.from_id = 'nation:3' AND e.to_id = (SELECT 'region:' || n_regionkey FROM nation WHERE n_nationkey = 3)")
def edge_between(spark, sf):
    to = table(spark, sf, "nation").where("n_nationkey = 3").select(F.concat(F.lit("region:"), "n_regionkey").alias("to_id"))
    return edges(spark, sf).where("from_id = 'nation:3'").join(to, "to_id", "left_semi").select("from_id", "to_id", "type", "confidence")


@query("""
, e AS (SELECT min(substr(sha256(from_id || '|' || to_id || '|' || type), 1, 16)) AS id FROM raw_call)
SELECT DISTINCT file, line FROM raw_call JOIN e ON substr(sha256(from_id || '|' || to_id || '|' || type), 1, 16) = e.id
""")
def evidence_for_edge(spark, sf):
    proof = Work(spark, "query").save(merge.evidence(raw_calls(spark, sf)), "evidence")
    one = proof.agg(F.min("edge_id").alias("edge_id"))
    return proof.join(F.broadcast(one), "edge_id", "left_semi").select("file", "line")


@query("SELECT id, row_number() OVER (ORDER BY id)::INTEGER AS place FROM node WHERE kind = 'class' AND simple_name LIKE 'NATION%'")
def entry_point_list(spark, sf):
    return rank.numbered(nodes(spark, sf).where("kind = 'class' and simple_name like 'NATION%'").select("id"), "place", "id")


# Joins over the graph


@query("SELECT e.from_id, e.to_id, e.type, e.confidence, n.kind, n.simple_name, n.file FROM edge e JOIN node n ON e.to_id = n.id WHERE e.confidence >= 0.7")
def neighbors_out(spark, sf):
    return graph.neighbours(edges(spark, sf), nodes(spark, sf), True, 0.7)


@query("SELECT e.from_id, e.to_id, e.type, e.confidence, n.kind, n.simple_name, n.file FROM edge e JOIN node n ON e.from_id = n.id WHERE e.confidence >= 0.5")
def neighbors_in(spark, sf):
    return graph.neighbours(edges(spark, sf), nodes(spark, sf), False, 0.5)


@query("""
SELECT a.qualified AS sub, b.qualified AS sup FROM edge e JOIN (SELECT id, file || '#' || simple_name AS qualified FROM node) a ON e.from_id = a.id
JOIN (SELECT id, file || '#' || simple_name AS qualified FROM node) b ON e.to_id = b.id WHERE e.type IN ('EXTENDS', 'IMPLEMENTS')
""")
def supertypes(spark, sf):
    return graph.supertype_names(edges(spark, sf), nodes(spark, sf))


_RADIUS = """
, e AS (SELECT * FROM edge WHERE confidence >= 0.5)
, d1 AS (SELECT r.id AS seed, e.from_id AS id, max(e.confidence) AS confidence FROM node r JOIN e ON e.to_id = r.id WHERE r.kind = 'interface' GROUP BY ALL)
, d2 AS (SELECT d.seed, e.from_id AS id, max(e.confidence) AS confidence FROM d1 d JOIN e ON e.to_id = d.id
  WHERE (d.seed, e.from_id) NOT IN (SELECT (seed, id) FROM d1) GROUP BY ALL)
, d3 AS (SELECT d.seed, e.from_id AS id, max(e.confidence) AS confidence FROM d2 d JOIN e ON e.to_id = d.id
  WHERE (d.seed, e.from_id) NOT IN (SELECT (seed, id) FROM d1 UNION ALL SELECT (seed, id) FROM d2) GROUP BY ALL)
, reached AS (SELECT *, 1 AS depth FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3)
, risky AS (SELECT *, CASE WHEN depth <= 1 AND confidence >= 0.8 THEN 'will_break' WHEN depth <= 2 AND confidence >= 0.5 THEN 'likely_affected'
  ELSE 'possible' END AS risk FROM reached)
"""


def _regions(spark, sf):
    return nodes(spark, sf).where(F.col("kind") == "interface").select(F.col("id").alias("seed"))


@query(_RADIUS + "SELECT seed, id, depth, confidence, risk FROM risky")
def blast_radius(spark, sf):
    (e,) = _stored(spark, edges=edges(spark, sf))
    return graph.blast_radius(e, _regions(spark, sf), 3).select("seed", "id", "depth", "confidence", "risk")


@query(_RADIUS + "SELECT seed, risk, count(*) AS n FROM risky GROUP BY seed, risk")
def blast_summary(spark, sf):
    (e,) = _stored(spark, edges=edges(spark, sf))
    return graph.blast_summary(graph.blast_radius(e, _regions(spark, sf), 3))


# From each order to a nation: over its customer if that is there, else over one of its parts and that part's supplier.
_PAIRS = "SELECT 'orders:' || o_orderkey AS start, 'nation:' || (o_orderkey % 25) AS target FROM orders"
_PATHS = f"""
, pair AS ({_PAIRS})
, near AS (SELECT p.start, p.target, a.to_id AS first, a.type AS first_type, a.confidence AS first_confidence FROM pair p JOIN edge a ON a.from_id = p.start AND a.type = 'IMPORTS'
  JOIN edge b ON b.from_id = a.to_id AND b.to_id = p.target)
, over AS (SELECT p.start, p.target, a.to_id AS part, a.confidence, min(b.to_id) AS supplier FROM pair p JOIN edge a ON a.from_id = p.start AND a.type = 'CALLS'
  JOIN edge b ON b.from_id = a.to_id AND b.type = 'REFERENCES' JOIN edge c ON c.from_id = b.to_id AND c.to_id = p.target WHERE p.start NOT IN (SELECT start FROM near) GROUP BY p.start, p.target, a.to_id, a.confidence)
, far_path AS (SELECT start, target, min(part) AS part, arg_min(supplier, part) AS supplier, arg_min(confidence, part) AS confidence FROM over GROUP BY start, target)
"""


def _order_pairs(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("orders:"), "o_orderkey").alias("from_id"), F.concat(F.lit("nation:"), F.col("o_orderkey") % 25).alias("to_id"))


@query(_PATHS + """
SELECT start AS from_id, target AS to_id, 2 AS hops, start || '>' || first || '>' || target AS path FROM near
UNION ALL SELECT start, target, 3, start || '>' || part || '>' || supplier || '>' || target FROM far_path
""")
def shortest_path(spark, sf):
    (e,) = _stored(spark, edges=edges(spark, sf))
    return graph.shortest_paths(e, _order_pairs(spark, sf), 4)


@query(_PATHS + """
, one AS (SELECT * FROM far_path WHERE start = 'orders:3' OR start = 'orders:5' OR start = 'orders:11'), two AS (SELECT * FROM near WHERE start = 'orders:3' OR start = 'orders:5' OR start = 'orders:11')
SELECT start AS from_id, 0 AS step, start AS id, 'seed' AS type, 1.0::DOUBLE AS confidence FROM (SELECT start FROM one UNION ALL SELECT start FROM two)
UNION ALL SELECT start, 1, part, 'CALLS', confidence FROM one UNION ALL SELECT start, 2, supplier, 'REFERENCES', 0.7 FROM one UNION ALL SELECT start, 3, target, 'EXTENDS', 1.0 FROM one
UNION ALL SELECT start, 1, first, first_type, first_confidence FROM two UNION ALL SELECT start, 2, target, 'EXTENDS', 1.0 FROM two
""")
def call_path_steps(spark, sf):
    (e,) = _stored(spark, edges=edges(spark, sf))
    pairs = _order_pairs(spark, sf).where("from_id in ('orders:3', 'orders:5', 'orders:11')")
    return graph.path_steps(e, pairs, 4).select("from_id", "step", "id", "type", "confidence")


# Types of the tables, and chains of 26 parts.
@query("""
, up AS (SELECT from_id AS sub, to_id AS sup FROM edge WHERE type IN ('EXTENDS', 'IMPLEMENTS')
  UNION ALL SELECT 'part:' || p_partkey, 'part:' || (p_partkey - 1) FROM part WHERE p_partkey % 26 > 0)
, walk AS (SELECT sub AS type, sub AS ancestor, 0 AS dist FROM up UNION SELECT sup, sup, 0 FROM up
  UNION SELECT w.type, up.sup, w.dist + 1 FROM walk w JOIN up ON w.ancestor = up.sub)
SELECT type, ancestor, min(dist) AS dist FROM walk GROUP BY type, ancestor
""")
def supertype_closure(spark, sf):
    e = structure(spark, sf).where(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select(F.col("from_id").alias("sub"), F.col("to_id").alias("sup"))
    of = lambda key: F.concat(F.lit("part:"), key)
    chain = table(spark, sf, "part").where("p_partkey % 26 > 0").select(of(F.col("p_partkey")).alias("sub"), of(F.col("p_partkey") - 1).alias("sup"))
    return graph.ancestors(e.unionByName(chain))


@query("""
, both_ways AS (SELECT from_id AS here, to_id AS next, confidence FROM edge WHERE confidence >= 0.5 UNION ALL SELECT to_id, from_id, confidence FROM edge WHERE confidence >= 0.5)
, s0 AS (SELECT id, 1.0::DOUBLE AS w FROM node WHERE kind = 'interface')
, s1 AS (SELECT next AS id, sum(w * confidence * 0.85) AS w FROM s0 JOIN both_ways ON id = here WHERE w * confidence * 0.85 >= 1e-4 GROUP BY next)
, s2 AS (SELECT next AS id, sum(w * confidence * 0.85) AS w FROM s1 JOIN both_ways ON id = here WHERE w * confidence * 0.85 >= 1e-4 GROUP BY next)
SELECT id, round(sum(w), 6) AS score FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id
""")
def personalized_pagerank(spark, sf):
    seeds = _regions(spark, sf).select(F.col("seed").alias("id"), F.lit(1.0).alias("weight"))
    (e,) = _stored(spark, edges=edges(spark, sf))
    return graph.personalised_pagerank(e, seeds, 2).select("id", r6("score").alias("score"))


@query("""
, call AS (SELECT from_id, to_id, confidence FROM edge)
, direct AS (SELECT n.id AS candidate, c.from_id AS caller, c.confidence, NULL AS via FROM node n JOIN call c ON c.to_id = n.id WHERE n.kind = 'class')
, sup AS (SELECT n.id AS candidate, m.id AS member, m.file || '#' || m.simple_name AS via FROM node n JOIN edge e ON e.from_id = n.owner_id AND e.type IN ('EXTENDS', 'IMPLEMENTS')
  JOIN node m ON m.owner_id = e.to_id AND m.simple_name = n.simple_name WHERE n.kind = 'class')
, everyone AS (SELECT * FROM direct UNION ALL SELECT s.candidate, c.from_id, c.confidence, s.via FROM sup s JOIN call c ON c.to_id = s.member)
, first AS (SELECT candidate, caller, arg_min(confidence, (CASE WHEN via IS NULL THEN 0 ELSE 1 END, -confidence)) AS confidence, bool_and(via IS NOT NULL) AS indirect FROM everyone GROUP BY ALL)
SELECT candidate, caller, confidence, indirect, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY confidence DESC, caller)::INTEGER AS r FROM first) WHERE r <= 5
""")
def candidate_callers(spark, sf):
    n = nodes(spark, sf)
    types = n.where(F.col("kind") == "class").select(F.col("id").alias("candidate"), "owner_id", "simple_name")
    out = resolve.callers_with_siblings(types, n, edges(spark, sf))
    return out.select("candidate", "caller", "confidence", F.col("via").isNotNull().alias("indirect"), "rank")


@query("""
, me AS (SELECT id FROM node WHERE simple_name = 'order3')
, named AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
SELECT m.id AS node, 'outgoing' AS direction, e.to_id AS other, e.type, e.confidence FROM me m JOIN edge e ON e.from_id = m.id
UNION ALL SELECT m.id, 'incoming', e.from_id, e.type, e.confidence FROM me m JOIN edge e ON e.to_id = m.id
UNION ALL SELECT DISTINCT m.id, 'ambiguous', p_name, 'CALLS', NULL FROM me m JOIN lineitem ON m.id = 'orders:' || l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_name IN (SELECT p_name FROM named)
""")
def debug_graph(spark, sf):
    n, e, u = _stored(spark, nodes=nodes(spark, sf), edges=edges(spark, sf).withColumn("provenance", F.lit(PROVENANCE)), still=merge.merge_unresolved(_named_calls(spark, sf)))
    _, ends, still = debug_tables({"node": n, "edge": e, "unresolved_reference": u}, "order3")
    still = still.select("node", F.lit("ambiguous").alias("direction"), F.col("target_name").alias("other"), "type", F.lit(None).cast("double").alias("confidence"))
    return ends.drop("provenance").unionByName(still)


# Merging


@query("""
SELECT substr(sha256(from_id || '|' || to_id || '|' || type), 1, 16) AS id, from_id, to_id, type, max(confidence) AS confidence,
  arg_min(file, (-confidence, file, line)) AS file, arg_min(line, (-confidence, file, line)) AS line, count(DISTINCT (file, line)) AS sites,
  array_to_string(list_sort(list_distinct(flatten(list(candidates)))), ' ') AS candidates FROM raw_call GROUP BY from_id, to_id, type
""")
def edge_merge(spark, sf):
    out = merge.merge_edges(raw_calls(spark, sf))
    return out.withColumn("candidates", F.array_join("ambiguous_candidates", " ")).drop("ambiguous_candidates")


@query("""
, e AS (SELECT substr(sha256(from_id || '|' || to_id || '|' || type), 1, 16) AS edge_id, file, line, bool_or(len(candidates) > 0) AS open FROM raw_call GROUP BY from_id, to_id, type, file, line)
SELECT substr(sha256(edge_id || '|' || file || '|' || line), 1, 16) AS id, edge_id, file, line, CASE WHEN open THEN 'ambiguous' ELSE 'verified' END AS verification_status FROM e
""")
def evidence_dedup(spark, sf):
    return merge.evidence(raw_calls(spark, sf))


def _named_calls(spark, sf):
    """Order lines as references to a part by its name alone; candidates are the part itself and one of the same brand's name."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", "p_brand", F.col("p_name").alias("name"))
    several = part.groupBy("name").count().where("count > 1").select("name")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(several, "name", "left_semi")
    return rows.select(
        F.concat(F.lit("orders:"), "l_orderkey").alias("from_id"), F.lit("CALLS").alias("type"), F.col("name").alias("target_name"),
        F.array(F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("brand:"), "p_brand")).alias("candidates"), F.concat(F.lit("ambiguous_"), "l_returnflag").alias("reason"),
        F.concat(F.lit("ship/"), F.date_format("l_shipdate", "yyyy-MM")).alias("file"), F.col("l_linenumber").alias("line"),
    )


_UNRESOLVED = """
, named AS (SELECT p_name FROM part GROUP BY p_name HAVING count(*) > 1)
, raw AS (SELECT 'orders:' || l_orderkey AS from_id, p.p_name AS target_name, 'ship/' || strftime(l_shipdate, '%Y-%m') AS file, l_linenumber AS line, 'ambiguous_' || l_returnflag AS reason,
  ['part:' || l_partkey, 'brand:' || p_brand] AS candidates FROM lineitem JOIN part p ON l_partkey = p_partkey WHERE p.p_name IN (SELECT p_name FROM named))
, unresolved AS (SELECT substr(sha256(from_id || '|CALLS|' || target_name), 1, 16) AS id, from_id, 'CALLS' AS type, target_name, list_sort(list_distinct(flatten(list(candidates)))) AS candidates,
  arg_max(reason, (file, line, reason)) AS reason, min(file) AS file, arg_min(line, (file, line)) AS line, count(DISTINCT (file, line))::INTEGER AS site_count FROM raw GROUP BY from_id, target_name)
"""


@query(_UNRESOLVED + "SELECT * REPLACE (array_to_string(candidates, ' ') AS candidates) FROM unresolved")
def unresolved_merge(spark, sf):
    return merge.merge_unresolved(_named_calls(spark, sf)).withColumn("candidates", F.array_join("candidates", " "))


@query("""
, base AS (SELECT * FROM edge WHERE type <> 'IMPORTS')
, typed AS (SELECT DISTINCT from_id, to_id, type FROM edge WHERE type = 'IMPORTS' OR confidence >= 0.9)
SELECT coalesce(b.from_id, t.from_id) AS from_id, coalesce(b.to_id, t.to_id) AS to_id,
  coalesce(b.type, t.type) || CASE WHEN t.type IS NULL THEN '' ELSE '_TYPED' END AS type,
  CASE WHEN t.type IS NULL THEN b.confidence ELSE greatest(0.95, coalesce(b.confidence, 0.95)) END AS confidence,
  CASE WHEN b.type IS NULL THEN 'scip_java' WHEN t.type IS NULL THEN 'java_parser' ELSE 'java_parser+scip_java' END AS provenance
FROM base b FULL OUTER JOIN typed t ON b.from_id = t.from_id AND b.to_id = t.to_id AND b.type = t.type
""")
def overlay_merge(spark, sf):
    e = edges(spark, sf).select("from_id", "to_id", "type", "confidence")
    base = e.where("type <> 'IMPORTS'").withColumn("provenance", F.lit(PROVENANCE))
    return merge.merge_typed(base, e.where("type = 'IMPORTS' or confidence >= 0.9"))


# Resolution


@query("""
, ref AS (SELECT DISTINCT l_orderkey AS o, p_name AS simple FROM lineitem JOIN part ON l_partkey = p_partkey)
, type AS (SELECT 'part:' || p_partkey AS id, p_brand AS package, p_name AS simple FROM part)
, package AS (SELECT l_orderkey AS o, arg_min(p_brand, l_partkey) AS package FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
, import AS (SELECT l_orderkey AS o, p_name AS simple, max(p_brand) AS package FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL)
, wild AS (SELECT DISTINCT l_orderkey AS o, p_brand AS package FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')
, inside AS (SELECT l_orderkey AS o, min(p_name) AS simple FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 97 = 0 GROUP BY l_orderkey)
, hit AS (
  SELECT r.o, r.simple, 1.0 AS tier, t.id FROM ref r JOIN import i ON r.o = i.o AND r.simple = i.simple JOIN type t ON t.package = i.package AND t.simple = r.simple
  UNION SELECT r.o, r.simple, 2.0, 'inner:' || r.o FROM ref r JOIN inside i ON i.o = r.o AND i.simple = r.simple
  UNION SELECT r.o, r.simple, 5.0, 'lang:' || r.simple FROM ref r WHERE length(r.simple) % 3 = 0
  UNION SELECT r.o, r.simple, 6.0, 'lang:' || r.simple FROM ref r WHERE length(r.simple) % 3 = 0
  UNION SELECT r.o, r.simple, 6.0, 'inner:' || i.o FROM ref r JOIN inside i ON i.simple = r.simple
  UNION SELECT r.o, r.simple, 3.0, t.id FROM ref r JOIN package p ON r.o = p.o JOIN type t ON t.package = p.package AND t.simple = r.simple
  UNION SELECT r.o, r.simple, 4.0, t.id FROM ref r JOIN wild w ON r.o = w.o JOIN type t ON t.package = w.package AND t.simple = r.simple
  UNION SELECT r.o, r.simple, 6.0, t.id FROM ref r JOIN type t ON t.simple = r.simple)
, best AS (SELECT o, simple, min(tier) AS tier FROM hit GROUP BY ALL)
SELECT h.o || '/' || h.simple AS ref, h.tier::DOUBLE AS tier, count(*)::INTEGER AS n, min(h.id) AS first FROM hit h JOIN best b ON h.o = b.o AND h.simple = b.simple AND h.tier = b.tier
GROUP BY h.o, h.simple, h.tier
""")
def type_resolution_tiers(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").cast("string").alias("file"), "l_partkey", "l_returnflag", "l_linestatus", "p_brand", F.col("p_name").alias("simple"))
    types = part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), F.col("p_name").alias("simple_name"))
    inside = rows.where("file % 97 = 0").groupBy("file").agg(F.min("simple").alias("simple_name"))  # types nested in an order's own
    inside = inside.select(F.concat(F.lit("inner:"), "file").alias("id"), F.concat_ws(".", F.lit("order"), "file", "simple_name").alias("qualified_name"), "simple_name")
    lang = part.where("length(p_name) % 3 = 0").select(F.concat(F.lit("lang:"), "p_name").alias("id"), F.concat(F.lit("java.lang."), "p_name").alias("qualified_name"), F.col("p_name").alias("simple_name")).distinct()
    types = types.unionByName(inside).unionByName(lang)
    package = rows.groupBy("file").agg(F.min_by("p_brand", "l_partkey").alias("package"))
    refs = rows.select("file", "simple").distinct().join(package, "file")
    refs = refs.select(F.concat_ws("/", "file", "simple").alias("ref"), "file", "package", F.concat_ws(".", F.lit("order"), "file").alias("owner"), "simple")
    imports = rows.where("l_returnflag = 'R'").groupBy("file", "simple").agg(F.max("p_brand").alias("b")).select("file", "simple", F.concat_ws(".", "b", "simple").alias("qualified_name"))
    wild = rows.where("l_linestatus = 'F'").select("file", F.col("p_brand").alias("package")).distinct()
    refs, types, imports, wild = _stored(spark, refs=refs, types=types, imports=imports, wild=wild)
    won = resolve.winning_names(refs, types, imports, wild, True).select("ref", "tier", F.explode("keys").alias("key"))
    groups = resolve.name_groups(types).select("key", "n", "first")  # names of one tier share no type
    return won.join(groups, "key").groupBy("ref", "tier").agg(F.sum("n").cast("int").alias("n"), F.min("first").alias("first"))


@query("""
, up AS (SELECT from_id AS sub, to_id AS sup FROM edge WHERE type IN ('EXTENDS', 'IMPLEMENTS'))
, method AS (
  SELECT 'customer:' || c_custkey || '#' || c_mktsegment AS id, 'customer:' || c_custkey AS owner, c_mktsegment AS name FROM customer WHERE c_acctbal > 5000
  UNION ALL SELECT DISTINCT 'nation:' || c_nationkey || '#' || c_mktsegment, 'nation:' || c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < -500
  UNION ALL SELECT DISTINCT 'region:' || n_regionkey || '#' || c_mktsegment, 'region:' || n_regionkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey)
, chain AS (SELECT 'customer:' || c_custkey AS start, 'customer:' || c_custkey AS at, 0 AS dist FROM customer UNION ALL SELECT c.start, up.sup, c.dist + 1 FROM chain c JOIN up ON up.sub = c.at)
, hit AS (SELECT 'orders:' || o_orderkey AS ref, c.dist, m.id FROM orders JOIN customer ON o_custkey = c_custkey JOIN chain c ON c.start = 'customer:' || c_custkey
  JOIN method m ON m.owner = c.at AND m.name = c_mktsegment)
SELECT ref, min(dist)::INTEGER AS dist, arg_min(id, dist) AS target FROM hit GROUP BY ref
""")
def owner_chain_lookup(spark, sf):
    c, n, o = (table(spark, sf, t) for t in ("customer", "nation", "orders"))
    of = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key))
    members = [
        c.where("c_acctbal > 5000").select(of("customer", "c_custkey").alias("owner"), F.col("c_mktsegment").alias("name")),
        c.where("c_acctbal < -500").select(of("nation", "c_nationkey").alias("owner"), F.col("c_mktsegment").alias("name")),
        c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(of("region", "n_regionkey").alias("owner"), F.col("c_mktsegment").alias("name")),
    ]
    methods = members[0].unionByName(members[1]).unionByName(members[2]).distinct().select(F.concat_ws("#", "owner", "name").alias("id"), "owner", "name", F.lit(0).alias("arity"))
    e = structure(spark, sf).where(F.col("type").isin("EXTENDS", "IMPLEMENTS"))
    closure = graph.ancestors(e.select(F.col("from_id").alias("sub"), F.col("to_id").alias("sup")))
    starts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        of("orders", "o_orderkey").alias("ref"), of("customer", "o_custkey").alias("owner"), F.col("c_mktsegment").alias("name"), F.lit(0).alias("arity"), F.lit(0).alias("least")
    )
    return resolve.owner_chain(starts, closure, methods).select("ref", "dist", F.col("candidates")[0].alias("target"))


@query(
    """
SELECT 'orders:' || o_orderkey AS ref, CASE WHEN n = 1 THEN 'edge' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN first END AS target,
  CASE WHEN n = 1 THEN 0.7::DOUBLE END AS confidence, CASE WHEN n > 1 THEN n ELSE 0 END::INTEGER AS n_candidates, CASE WHEN n > 1 THEN 'ambiguous_global_fallback' END AS reason
FROM (SELECT o_orderkey, count(DISTINCT p_partkey) AS n, min('part:' || p_partkey) AS first FROM orders JOIN part ON p_size = 1 + o_orderkey % 50 AND p_brand = 'Brand#' || (11 + o_custkey % 45) GROUP BY o_orderkey)
""",
    False,
)
def name_fallback_ambiguous(spark, sf):
    o, p = table(spark, sf, "orders"), table(spark, sf, "part")
    refs = o.select(F.concat(F.lit("orders:"), "o_orderkey").alias("ref"), F.concat(F.lit("Brand#"), 11 + F.col("o_custkey") % 45).alias("name"), (1 + F.col("o_orderkey") % 50).cast("int").alias("arity"))
    members = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("name"), F.col("p_size").alias("arity"))
    out = resolve.blind_outcome(resolve.global_members(refs, members))
    return out.select("ref", "status", "target", "confidence", F.size("candidates").alias("n_candidates"), "reason")


_HINT = "CASE {} % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'String' WHEN 3 THEN 'null' WHEN 4 THEN 'Integer' ELSE 'unknown' END"
_PARAM = "CASE {} % 6 WHEN 0 THEN 'int' WHEN 1 THEN 'long' WHEN 2 THEN 'String' WHEN 3 THEN 'Object' WHEN 4 THEN 'Number' ELSE 'Integer' END"
#: Supertypes by simple names, boxes among them.
_SUBTYPES = [("Integer", "Number"), ("Long", "Number"), ("Number", "Serializable")]
_SCORE = """CASE WHEN {h} = 'unknown' THEN 0 WHEN {h} = {p} THEN 3 WHEN {h} = 'null' THEN CASE WHEN {p} IN ('int', 'long') THEN NULL ELSE 0 END
  WHEN {h} = 'int' THEN CASE {p} WHEN 'long' THEN 2 WHEN 'Integer' THEN 2 WHEN 'Object' THEN 1 WHEN 'Number' THEN 1 END
  WHEN {h} = 'long' THEN CASE {p} WHEN 'Object' THEN 1 WHEN 'Number' THEN 1 END
  WHEN {p} = 'int' THEN CASE WHEN {h} = 'Integer' THEN 2 END WHEN {p} = 'long' THEN NULL WHEN {p} = 'Object' THEN 1 WHEN {h} = 'Integer' AND {p} = 'Number' THEN 1 ELSE 0 END"""


@query(
    f"""
WITH cand AS (
  SELECT DISTINCT o.o_orderkey, p.p_partkey, {_HINT.format("o.o_orderkey")} AS h1, {_HINT.format("o.o_custkey")} AS h2, {_PARAM.format("p.p_partkey")} AS p1, {_PARAM.format("p.p_size")} AS p2
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
), scored AS (
  SELECT *, {_SCORE.format(h="h1", p="p1")} + {_SCORE.format(h="h2", p="p2")} AS s FROM cand
), alive AS (
  SELECT o_orderkey, p_partkey, CASE WHEN a = 0 THEN 0 ELSE s END AS s, a FROM (SELECT *, count(s) OVER (PARTITION BY o_orderkey) AS a FROM scored) WHERE s IS NOT NULL OR a = 0
), ranked AS (
  SELECT *, max(s) OVER (PARTITION BY o_orderkey) AS best FROM alive
), judged AS (
  SELECT *, count(*) FILTER (s = best) OVER (PARTITION BY o_orderkey) AS ties, max(s) FILTER (s < best) OVER (PARTITION BY o_orderkey) AS next FROM ranked
), kept AS (
  SELECT * FROM judged WHERE NOT (a > 0 AND ties = 1 AND ((best > 0 AND (next IS NULL OR best - next >= 2)) OR best = 6 OR a = 1)) OR s = best
)
SELECT 'orders:' || o_orderkey AS ref, count(*)::INTEGER AS n, min('part:' || p_partkey) AS first, max(s)::INTEGER AS best FROM kept GROUP BY o_orderkey
""",
    False,
)
def overload_scoring(spark, sf):
    o, line, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    rows = o.join(line, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", "o_custkey", "p_partkey", "p_size").distinct()
    rows = rows.select(
        F.concat(F.lit("orders:"), "o_orderkey").alias("ref"),
        F.concat(F.lit("part:"), "p_partkey").alias("target"),
        F.array(F.expr(_HINT.format("o_orderkey")), F.expr(_HINT.format("o_custkey"))).alias("hints"),
        F.array(F.expr(_PARAM.format("p_partkey")), F.expr(_PARAM.format("p_size"))).alias("params"),
    )
    out = resolve.narrow_overloads(rows, spark.createDataFrame(_SUBTYPES, "sub string, sup string"))
    return out.select("ref", F.size("candidates").alias("n"), F.array_min("candidates").alias("first"), F.array_max("scores").alias("best"))


@query(
    "SELECT h, p, " + _SCORE.format(h="h", p="p") + " AS score FROM (SELECT DISTINCT " + _HINT.format("p_partkey") + " AS h, " + _PARAM.format("p_size") + " AS p FROM part)", False
)
def argument_scores(spark, sf):
    p = table(spark, sf, "part").select(F.expr(_HINT.format("p_partkey")).alias("h"), F.expr(_PARAM.format("p_size")).alias("p")).distinct()
    return p.select("h", "p", argument_score(F.col("h"), F.col("p"), F.col("h").isin("int", "long", "Integer") & (F.col("p") == "Number")).alias("score"))


@query(
    """
SELECT 'orders:' || o_orderkey AS from_id, 'nation:' || c_nationkey AS to_id, o_orderpriority AS file, (o_orderkey % 100)::INTEGER AS line
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
""",
    False,
)
def import_edges(spark, sf):
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).withColumn("file", F.concat_ws("/", "o_orderpriority", "o_orderkey"))
    static = F.col("o_orderstatus") == "F"
    name = F.when(static, F.concat(F.lit("world.N"), "c_nationkey", F.lit(".member"))).otherwise(F.concat(F.lit("world.N"), "c_nationkey"))
    imports = rows.select("file", name.alias("imported_name"), (F.col("o_orderstatus") == "P").alias("is_wildcard"), static.alias("is_static"), (F.col("o_orderkey") % 100).cast("int").alias("line"))
    types = n.select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.concat(F.lit("world.N"), "n_nationkey").alias("qualified_name"))
    top = rows.select("file", F.concat(F.lit("orders:"), "o_orderkey").alias("id"))
    out = resolve.import_edges(imports, types, top)
    return out.withColumn("file", F.substring_index("file", "/", 1))


@query(
    """
, scope AS (SELECT user_id, event_id AS scope, epoch_us(ts) AS b, epoch_us(ts) + (value * 3600000000)::BIGINT AS e FROM events WHERE event_type = 'signup')
, hit AS (SELECT p.event_id AS point, s.scope, s.e - s.b AS size, s.b FROM events p JOIN scope s ON p.user_id = s.user_id AND epoch_us(p.ts) BETWEEN s.b AND s.e WHERE p.event_type <> 'signup')
SELECT point, arg_min(scope, (size, b, scope)) AS scope FROM hit GROUP BY point
""".replace(", scope AS", "WITH scope AS", 1),
    False,
)
def innermost_scope(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "value")
    length = F.rint(F.col("value") * 3600000000).cast("long")
    scopes = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("scope"), F.col("at").alias("begin"), (F.col("at") + length).alias("end"))
    points = e.where("event_type <> 'signup'").select("user_id", F.col("event_id").alias("point"), "at")
    return resolve.innermost_scope(points, scopes, "user_id")


@query(
    """
WITH kinds(annotation, kind) AS (VALUES ('1-URGENT', 'HTTP_CONTROLLER'), ('2-HIGH', 'HTTP_ROUTE'), ('F', 'SCHEDULED'), ('O', 'MESSAGE_LISTENER'))
SELECT 'orders:' || o_orderkey AS id, coalesce(a.kind, b.kind) AS entry_point_kind FROM orders LEFT JOIN kinds a ON o_orderpriority = a.annotation LEFT JOIN kinds b ON o_orderstatus = b.annotation
WHERE coalesce(a.kind, b.kind) IS NOT NULL
""",
    False,
)
def entry_points(spark, sf):
    o = table(spark, sf, "orders").select(F.concat(F.lit("orders:"), "o_orderkey").alias("id"), F.array("o_orderpriority", "o_orderstatus").alias("annotations"))
    kinds = [("1-URGENT", "HTTP_CONTROLLER"), ("2-HIGH", "HTTP_ROUTE"), ("F", "SCHEDULED"), ("O", "MESSAGE_LISTENER")]
    return resolve.entry_points(o, spark.createDataFrame(kinds, "annotation string, kind string"))


# Retrieval

QUERY = "the or thin"
_BM25 = """
, doc AS (SELECT {key} AS id, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS terms FROM {table})
, cnt AS (SELECT id, len(terms) AS len, len(list_filter(terms, lambda t: starts_with(t, 'the'))) AS f0, len(list_filter(terms, lambda t: starts_with(t, 'or'))) AS f1,
  len(list_filter(terms, lambda t: starts_with(t, 'thin'))) AS f2 FROM doc)
, tot AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1, count(*) FILTER (f2 > 0) AS n2 FROM cnt)
, part_score AS (SELECT id, len, mean, UNNEST([f0, f1, f2]) AS f, n, UNNEST([n0, n1, n2]) AS df FROM cnt, tot)
, bm AS (SELECT id, sum(CASE WHEN f > 0 THEN CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0.0 END) AS bm25 FROM part_score GROUP BY id HAVING sum(f) > 0)
"""


@query("WITH x AS (SELECT 1)" + _BM25.format(key="doc_id", text="text", table="documents") + "SELECT id, round(bm25, 6) AS bm25 FROM bm", False)
def bm25_search(spark, sf):
    return search.bm25(table(spark, sf, "documents"), F.col("text"), QUERY, "doc_id").select("id", r6("bm25").alias("bm25"))


@query(
    """
WITH t AS (SELECT doc_id AS id, UNNEST(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM t GROUP BY term
""",
    False,
)
def term_statistics(spark, sf):
    p = search.postings(table(spark, sf, "documents"), F.col("text"), "doc_id")
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("WITH x AS (SELECT 1)" + _BM25.format(key="doc_id", text="text", table="documents") + "SELECT id, round(bm25, 6) AS bm25 FROM bm", False)
def postings_search(spark, sf):
    stored, totals = search.index(table(spark, sf, "documents"), F.col("text"), "doc_id")
    return search.bm25_of_postings(*_stored(spark, posting=stored, totals=totals), QUERY).select("id", r6("bm25").alias("bm25"))


@query("SELECT id, 1.0::DOUBLE AS bm25 FROM node WHERE simple_name = 'NATION_3' OR file || '#' || simple_name = 'NATION_3'")
def exact_hits(spark, sf):
    return search.exact_hits(nodes(spark, sf), "NATION_3")


@query("""
, text AS (SELECT id, kind, simple_name, file || '#' || simple_name AS qualified_name FROM node)
, doc AS (SELECT id, regexp_extract_all(lower(simple_name || ' ' || qualified_name), '[\\p{L}\\p{N}]+') AS terms FROM text)
, cnt AS (SELECT id, len(terms) AS len, len(list_filter(terms, lambda t: starts_with(t, 'nation'))) AS f0, len(list_filter(terms, lambda t: starts_with(t, 'region'))) AS f1 FROM doc)
, tot AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (f0 > 0) AS n0, count(*) FILTER (f1 > 0) AS n1 FROM cnt)
, part_score AS (SELECT id, len, mean, UNNEST([f0, f1]) AS f, n, UNNEST([n0, n1]) AS df FROM cnt, tot)
, bm AS (SELECT id, sum(CASE WHEN f > 0 THEN CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
  * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) ELSE 0.0 END) AS bm25 FROM part_score GROUP BY id HAVING sum(f) > 0)
, hits AS (SELECT id, bm25, bm25 / max(bm25) OVER () AS w FROM (SELECT * FROM bm ORDER BY bm25 DESC, id LIMIT 60))
, both_ways AS (SELECT from_id AS here, to_id AS next, confidence FROM edge WHERE confidence >= 0.5 UNION ALL SELECT to_id, from_id, confidence FROM edge WHERE confidence >= 0.5)
, s1 AS (SELECT next AS id, sum(w * confidence * 0.85) AS w FROM hits JOIN both_ways ON id = here WHERE w * confidence * 0.85 >= 1e-4 GROUP BY next)
, s2 AS (SELECT next AS id, sum(w * confidence * 0.85) AS w FROM s1 JOIN both_ways ON id = here WHERE w * confidence * 0.85 >= 1e-4 GROUP BY next)
, pr AS (SELECT id, sum(w) AS s FROM (SELECT id, w FROM hits UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) GROUP BY id)
, found AS (SELECT h.id, h.bm25, h.w, pr.s / max(pr.s) OVER () AS pagerank FROM hits h JOIN pr ON h.id = pr.id)
SELECT id, round(0.6 * w + 0.4 * pagerank, 6) AS score, round(bm25, 6) AS bm25, round(pagerank, 6) AS pagerank FROM found ORDER BY 0.6 * w + 0.4 * pagerank DESC, id LIMIT 20
""")
def search_hybrid(spark, sf):
    (e,) = _stored(spark, edges=edges(spark, sf))
    out = search.hybrid(nodes(spark, sf), e, "nation region", 20)
    return out.select("id", r6("score").alias("score"), r6("bm25").alias("bm25"), r6("pagerank").alias("pagerank"))


@query(
    """
WITH l AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT id, UNNEST(lines) AS text, generate_subscripts(lines, 1) AS line FROM l)
SELECT id, line::INTEGER AS line, greatest(1, length(text) // 4)::INTEGER AS tokens FROM e WHERE contains(text, 'thing')
""",
    False,
)
def grep_baseline(spark, sf):
    return search.literal_matches(table(spark, sf, "documents"), F.col("text"), "thing", "doc_id")


# Ranking


def _part_seeds(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        F.concat(F.lit("part:"), "p_partkey").alias("id"),
        F.when(F.col("p_size") % 7 == 0, "class").otherwise("method").alias("kind"),
        F.col("p_name").alias("simple_name"),
        F.concat(F.lit("pkg."), F.initcap(F.col("p_type")), F.when(F.col("p_size") % 3 == 0, "Test").otherwise(""), F.lit("#"), "p_name").alias("qualified_name"),
        (F.col("p_retailprice") / 1000).alias("score"),
    )


_SEEDS = """
WITH seed AS (SELECT 'part:' || p_partkey AS id, CASE WHEN p_size % 7 = 0 THEN 'class' ELSE 'method' END AS kind, p_name AS simple_name,
  'pkg.' || upper(p_type[1]) || lower(p_type[2:]) || CASE WHEN p_size % 3 = 0 THEN 'Test' ELSE '' END AS owner, p_retailprice / 1000 AS score FROM part)
"""


@query(
    _SEEDS
    + """
, w AS (SELECT id, owner, (CASE WHEN kind = 'class' THEN score * 1.5 ELSE score END) * CASE WHEN owner LIKE '%Test' THEN 0.5 ELSE 1 END AS weighted,
  (CASE WHEN list_contains(list_transform(regexp_extract_all(owner, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda t: lower(t)), 'pkg') THEN 1 ELSE 0 END)
  + (CASE WHEN list_contains(list_transform(regexp_extract_all(owner, '[A-Z]+[a-z]*|[a-z]+|[0-9]+'), lambda t: lower(t)), 'test') THEN 1 ELSE 0 END) AS coverage FROM seed)
, o AS (SELECT owner, dense_rank() OVER (ORDER BY max(coverage) DESC, max(weighted) DESC, count(*) DESC, owner) AS cluster FROM w GROUP BY owner)
SELECT w.id, w.coverage::INTEGER AS coverage, o.cluster::INTEGER AS cluster, row_number() OVER (ORDER BY o.cluster, w.weighted DESC, w.id)::INTEGER AS rank FROM w JOIN o ON w.owner = o.owner
""",
    False,
)
def cluster_rerank(spark, sf):
    return rank.clustered(_part_seeds(spark, sf), "pkg test").select("id", "coverage", "cluster", "rank")


@query(
    _SEEDS
    + """SELECT id, row_number() OVER (ORDER BY CASE WHEN kind = 'class' AND simple_name = (SELECT min(p_name) FROM part) THEN 0 ELSE 1 END, score DESC, id)::INTEGER AS rank FROM seed""",
    False,
)
def prioritize_seeds(spark, sf):
    name = table(spark, sf, "part").agg(F.min("p_name")).first()[0]
    return rank.prioritised(_part_seeds(spark, sf), name or "").select("id", "rank")


@query(
    _SEEDS
    + """
, q AS (SELECT simple_name AS name, owner || '#' || simple_name AS qualified_name, kind, score FROM seed)
, t AS (SELECT *, count(DISTINCT CASE WHEN kind = 'class' THEN qualified_name END) OVER (PARTITION BY name) AS types FROM q)
, a AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next FROM t WHERE types < 2 OR kind = 'class' WINDOW w AS (PARTITION BY name ORDER BY score DESC, qualified_name))
, g AS (SELECT name, count(DISTINCT qualified_name) AS names, any_value(types) AS types, coalesce(bool_or(place = 1 AND score > 1.5 * next), false) AS clear FROM a GROUP BY name)
SELECT name, names > 1 AND NOT (types = 1 OR clear) AS ambiguous, names FROM g
""",
    False,
)
def ambiguity_check(spark, sf):
    hits = _part_seeds(spark, sf).select(F.col("simple_name").alias("name"), "qualified_name", "kind", "score")
    return rank.is_ambiguous(hits).select("name", "ambiguous", "names")


@query(
    """
WITH t AS (SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens FROM conversations), u AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM t)
SELECT conv_id, turn, tokens::INTEGER AS tokens, used::BIGINT AS used FROM u WHERE used <= 200
""",
    False,
)
def token_budget(spark, sf):
    slices = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("at"), "text")
    return rank.packed(slices, 200, "conv_id").select("conv_id", F.col("at").alias("turn"), "tokens", "used")


# Lines of one turn each: what fits whole stays, the first that doesn't is cut to what is left, and that is the end.
@query(
    """
WITH t AS (SELECT conv_id, turn, replace(text, chr(10), ' ') AS line FROM conversations), c AS (SELECT *, greatest(1, length(line) // 4) AS tokens FROM t)
, u AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT conv_id, turn, tokens > 200 - before AS truncated, CASE WHEN tokens > 200 - before THEN substr(line, 1, ((200 - before) * 4)::INTEGER) ELSE line END AS source FROM u WHERE before < 200
""",
    False,
)
def slice_packing(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", "\n", " ").alias("source"))

    def pack(key, rows):
        own = [{"source": r.source, "span_start": 1, "span_end": 1, "turn": r.turn} for r in rows.sort_values("turn").itertuples()]
        out, _, _ = rank.pack_slices(own, 200)
        return pd.DataFrame([(key[0], s["turn"], s["truncated"], s["source"]) for s in out], columns=["conv_id", "turn", "truncated", "source"])

    return turns.groupBy("conv_id").applyInPandas(pack, "conv_id long, turn long, truncated boolean, source string")


@query(
    """
WITH q AS (SELECT 'part:' || p_partkey AS id, 'pkg.' || p_type AS owner, replace(p_name, ' ', '') AS member, p_size % 3 AS arity FROM part)
SELECT 'LARGE#redbolt' AS query, id FROM q WHERE owner = 'pkg.LARGE' AND member = 'redbolt'
UNION ALL SELECT 'redbolt(List)', id FROM q WHERE member = 'redbolt' AND arity = 1
UNION ALL SELECT 'pkg.SMALL#newring(java.util.List<B>, int)', id FROM q WHERE owner = 'pkg.SMALL' AND member = 'newring' AND arity = 2
UNION ALL SELECT 'SMALL.newring', id FROM q WHERE owner = 'pkg.SMALL' AND member = 'newring'
""",
    False,
)
def qualified_lookup(spark, sf):
    p = table(spark, sf, "part")
    args = F.array_join(F.expr("slice(array('List', 'int'), 1, cast(p_size % 3 as int))"), ",")
    qname = F.concat(F.lit("pkg."), "p_type", F.lit("#"), F.regexp_replace("p_name", " ", ""), F.lit("("), args, F.lit(")"))
    n = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), qname.alias("qualified_name"))
    asked = ["LARGE#redbolt", "redbolt(List)", "pkg.SMALL#newring(java.util.List<B>, int)", "SMALL.newring", "MEDIUM#nothing", "a bare question"]
    return reduce(DataFrame.unionByName, (named_members(n, q).select(F.lit(q).alias("query"), "id") for q in asked))


@query(
    """
SELECT 'part:' || p_partkey AS id, lower(p_type) AS owner, replace(p_name, ' ', '') AS member, p_size % 3 AS arity FROM part
""",
    False,
)
def qualified_names(spark, sf):
    p = table(spark, sf, "part")
    args = F.array_join(F.expr("slice(array(' java.util.List<A>', 'int[] '), 1, cast(p_size % 3 as int))"), ",")
    qname = F.concat(F.lower("p_type"), F.lit("#"), F.regexp_replace("p_name", " ", ""), F.lit("("), args, F.lit(")"))
    q = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), qname.alias("q"))
    return q.select("id", N.owner_of(F.col("q")).alias("owner"), N.member_name(F.col("q")).alias("member"), F.size(N.param_types(F.col("q"))).alias("arity"))


@query(
    """
SELECT 'part:' || p_partkey AS id, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'int' WHEN 2 THEN 'int,String' END AS types FROM part
""",
    False,
)
def descriptor_decode(spark, sf):
    p = table(spark, sf, "part")
    d = F.expr("CASE p_size % 4 WHEN 0 THEN '()V' WHEN 1 THEN '(I)V' WHEN 2 THEN '([I[[Ljava/lang/String;)Z' ELSE '(IX)V' END")
    return p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.array_join(N.descriptor_types(d), ",").alias("types"))


@query(
    """
SELECT p_partkey AS id, array_to_string(list_sort(list_distinct(string_split(lower('HTTP ' || p_type || ' ' || p_name), ' ') || [p_size::VARCHAR])), '|') AS words FROM part
""",
    False,
)
def identifier_words(spark, sf):
    p = table(spark, sf, "part")
    camel = F.regexp_replace(F.initcap(F.lower(F.concat_ws(" ", "p_type", "p_name"))), " ", "")
    name = F.concat(F.lit("HTTP"), camel, "p_size")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(N.word_parts(name)), "|").alias("words"))


# Measurement


def _ranked(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("query"), F.concat(F.lit("part:"), "p_partkey").alias("id"), "p_retailprice", "p_size")
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("p_retailprice"), "id"))
    return p.withColumn("rank", order)


@query(
    """
WITH r AS (SELECT p_brand AS query, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, 'part:' || p_partkey) AS rank FROM part)
, h AS (SELECT query, min(rank) FILTER (p_size % 10 = 0 AND rank <= 10) AS rank, count(*) FILTER (p_size % 10 = 0) AS expected FROM r GROUP BY query)
SELECT count(*) AS queries, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0.0)), 6) AS mrr FROM h WHERE expected > 0
""",
    False,
)
def topk_recall_mrr(spark, sf):
    ranked = _ranked(spark, sf)
    out = metrics.ranks(ranked.select("query", "id", "rank"), ranked.where("p_size % 10 = 0").select("query", "id"), 10)
    return out.select("queries", r6("recall").alias("recall"), r6("mrr").alias("mrr"))


@query("""
, found AS (SELECT DISTINCT from_id, to_id FROM edge WHERE type = 'CALLS' AND confidence >= 0.7), expected AS (SELECT DISTINCT 'orders:' || l_orderkey AS from_id, 'part:' || l_partkey AS to_id FROM lineitem WHERE l_quantity > 25)
, s AS (SELECT count(*) AS shared FROM found SEMI JOIN expected USING (from_id, to_id))
SELECT (SELECT count(*) FROM found) AS found, (SELECT count(*) FROM expected) AS expected, shared, round(shared / (SELECT count(*) FROM found), 6) AS precision,
  round(shared / (SELECT count(*) FROM expected), 6) AS recall FROM s
""")
def edge_precision_recall(spark, sf):
    found = edges(spark, sf).where("type = 'CALLS' and confidence >= 0.7")
    expected = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.concat(F.lit("orders:"), "l_orderkey").alias("from_id"), F.concat(F.lit("part:"), "l_partkey").alias("to_id"))
    out = metrics.precision_recall(found, expected, ["from_id", "to_id"])
    return out.withColumns({"precision": r6("precision"), "recall": r6("recall")})


@query(
    """
WITH g(key, op, target) AS (VALUES ('click', '>=', 10.0), ('purchase', '<=', 10.0), ('error', '<', 50.0), ('view', '>', 1000.0), ('absent', '==', 1.0))
, m AS (SELECT event_type AS key, round(avg(value), 6) AS value FROM events GROUP BY event_type)
SELECT g.key, op, target::DOUBLE AS target, value, round(value - target, 6) AS gap, CASE WHEN value IS NULL THEN 'SKIP' WHEN CASE op WHEN '>=' THEN value >= target WHEN '<=' THEN value <= target
  WHEN '<' THEN value < target WHEN '>' THEN value > target ELSE value = target END THEN 'PASS' ELSE 'FAIL' END AS status FROM g LEFT JOIN m ON g.key = m.key
""",
    False,
)
def release_gates(spark, sf):
    targets = spark.createDataFrame([("click", ">=", 10.0), ("purchase", "<=", 10.0), ("error", "<", 50.0), ("view", ">", 1000.0), ("absent", "==", 1.0)], "key string, op string, target double")
    measured = table(spark, sf, "events").groupBy(F.col("event_type").alias("key")).agg(r6(F.avg("value")).alias("value"))
    return metrics.gates(measured, targets).withColumn("gap", r6("gap"))


_SIGNATURE = _UNRESOLVED + """
, h AS (SELECT sha256(concat_ws('|', 'node', '=' || id, '=' || kind, '=' || file || '#' || simple_name, '=' || simple_name, '=' || file)) AS h FROM node
  UNION ALL SELECT sha256(concat_ws('|', 'edge', '=' || from_id, '=' || to_id, '=' || type, '=' || printf('%.6f', confidence), '=')) FROM edge
  UNION ALL SELECT sha256(concat_ws('|', 'unresolved_reference', '=' || id, '=' || from_id, '=' || type, '=' || target_name, '=' || array_to_string(candidates, ','), '=' || reason, '=' || site_count)) FROM unresolved)
, s AS (SELECT count(*) AS rows, """ + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT) AS p{k}" for k in range(8)) + """ FROM h)
SELECT rows, sha256(concat_ws('|', rows, p0, p1, p2, p3, p4, p5, p6, p7)) AS signature FROM s
"""


@query(_SIGNATURE)
def graph_signature(spark, sf):
    return metrics.graph_signature(nodes(spark, sf), edges(spark, sf), merge.merge_unresolved(_named_calls(spark, sf)))


# Freshness and storage


def _files(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.where("doc_id % 11 <> 0").select(F.col("doc_id").cast("string").alias("file"), F.sha2(F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("text")), 256).alias("content_hash"))
    return stored, d.where("doc_id % 13 <> 0").select(F.col("doc_id").cast("string").alias("file"), F.sha2("text", 256).alias("content_hash"))


@query(
    """
SELECT doc_id::VARCHAR AS file, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM documents
WHERE (doc_id % 11 = 0 AND doc_id % 13 <> 0) OR (doc_id % 13 = 0 AND doc_id % 11 <> 0) OR (doc_id % 7 = 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND text <> '')
""",
    False,
)
def freshness_diff(spark, sf):
    return store.stale_files(*_files(spark, sf))


@query("""
SELECT n.id, n.kind, n.file, CASE WHEN starts_with(n.file, 'segment/') THEN n.simple_name || '_v2' ELSE n.simple_name END AS simple_name FROM node n
WHERE NOT (starts_with(n.file, 'segment/') AND n.owner_id = 'nation:0')
""")
def snapshot_replace(spark, sf):
    old = nodes(spark, sf).select("id", "kind", "file", "simple_name", "owner_id")
    new = old.where("file like 'segment/%' and owner_id <> 'nation:0'").withColumn("simple_name", F.concat("simple_name", F.lit("_v2")))
    return store.replace_by_file(old, new, old.where("file like 'segment/%'").select("file")).drop("owner_id")


@query(_UNRESOLVED + """
, gone AS (SELECT id FROM node WHERE file IN ('nation/3', 'region/1', 'month/1995-01'))
, kept AS (SELECT DISTINCT from_id, to_id, file, line FROM raw_call WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone))
SELECT 'node' AS what, count(*) AS n FROM node WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'edge', count(*) FROM edge WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'evidence', count(*) FROM kept
UNION ALL SELECT 'unresolved_reference', count(*) FROM unresolved WHERE from_id NOT IN (SELECT id FROM gone)
""")
def delete_cascade(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf).withColumn("id", N.short_id("from_id", "to_id", "type"))
    files = spark.createDataFrame([("nation/3",), ("region/1",), ("month/1995-01",)], "file string")
    out = store.delete_cascade(n, e, merge.evidence(raw_calls(spark, sf)), merge.merge_unresolved(_named_calls(spark, sf)), files)
    count = lambda k: out[k].agg(F.lit(k).alias("what"), F.count("*").alias("n"))
    return reduce(DataFrame.unionByName, map(count, ("node", "edge", "evidence", "unresolved_reference")))


@query("""
SELECT id, kind, simple_name, 1::BIGINT AS side FROM node WHERE file = 'region/2' UNION ALL SELECT id, kind, simple_name || '!', 2 FROM node WHERE file = 'region/2'
""")
def identity_proof(spark, sf):
    old = nodes(spark, sf)
    new = old.withColumn("simple_name", F.when(F.col("file") == "region/2", F.concat("simple_name", F.lit("!"))).otherwise(F.col("simple_name")))
    return store.differing(old, new, ["id", "kind", "simple_name"])


@query(
    """
WITH d AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)
, s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
SELECT user_id::VARCHAR AS path, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) + 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
""",
    False,
)
def debounce_sessions(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return sessions(e, "1 hour").select("path", F.unix_micros("begin").alias("begin_us"), F.unix_micros("end").alias("end_us"), "n")


@query(
    """
SELECT doc_id, len(string_split(text, chr(10)))::INTEGER AS lines, greatest(1, length(text) // 4)::INTEGER AS tokens, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS slice FROM documents
""",
    False,
)
def source_slices(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.size(lines).alias("lines"), token_estimate(F.col("text")).alias("tokens"), F.array_join(F.slice(lines, 2, 2), "\n").alias("slice"))
