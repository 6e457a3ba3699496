"""The engine: index a repository, keep the index fresh, and answer questions about it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codeloom
from codeloom.functions.names import normal_signature, owner_of
from codeloom.operators import graph, merge, metrics, rank, resolve, search, store
from codeloom.plans import overlay
from codeloom.plans.build import PROVENANCE, build, node_table
from codeloom.plans.snapshot import SnapshotStore, part_of
from codeloom.schema import TYPE_KINDS
from codeloom.sources import config
from codeloom.sources.files import discover, parse_files, parse_with_cache, read_files
from codeloom.sources.scip import read_occurrences
from codeloom.work import Work, work_ends

NOT_INDEXED = {"error": "not_indexed", "hint": "run: python -m codeloom build <path>"}
BLIND_SPOTS = ["calls by reflection", "generated code", "runtime wiring and configuration"]
#: Hits of a search that an answer is made from, at most (a fixed value of the answers' format).
SEEDS = 30
_IDENTITY = ["file", "kind", "qualified_name", "simple_name", "signature"]
_BY_FILE = ["node", "parsed_file", "file_meta", "edge", "evidence", "unresolved_reference", "posting", "text_length"]


class Engine:
    """One repository's index at ``path``."""

    def __init__(self, spark: SparkSession, path: str, repo: str = "repo", entry_points: dict[str, str] | None = None, patterns: dict[str, str] | None = None):
        self.spark, self.store, self.repo = codeloom.attach(spark), SnapshotStore(spark, path), repo
        self.entry_points, self.patterns = entry_points, patterns

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        """Nothing stays open: each question reads one version of the written tables."""

    # Indexing

    def _nodes(self, parsed: DataFrame, root: str) -> DataFrame:
        """Nodes of parsed files; entry points are as given, or as the repository's own file has them."""
        annotations, patterns = config.entry_points(self.spark, root)
        return node_table(parsed, self.repo, config.git_head(self.spark, root), self.entry_points or annotations, self.patterns or patterns)

    def build(self, root: str) -> dict:
        """Index all files anew; files whose content is known aren't parsed again. Typed pairs are kept."""
        with work_ends():
            files, m = discover(self.spark, root), self.store.manifest()
            parsed = parse_files(files) if m is None else parse_with_cache(files, self.store.read("parsed_file", m))
            work = Work(self.spark, "index")
            parsed = work.save(parsed, "parsed")
            nodes = work.save(self._nodes(parsed, root), "nodes")
            tables = {k: work.save(v, k) for k, v in build(parsed, nodes).items()}
            self.store.write({"node": nodes, "parsed_file": parsed, **self._derived(parsed, nodes), **tables}, parsed.count(), {"root": root})
        return self.status()

    def _derived(self, parsed: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
        """File metadata and the text index of files and their nodes."""
        count = nodes.groupBy("file").agg(F.count("*").cast("int").alias("node_count"))
        meta = parsed.select("file", "content_hash").join(count, "file", "left")
        meta = meta.select("file", "content_hash", F.unix_timestamp().alias("indexed_at"), F.coalesce("node_count", F.lit(0)).alias("node_count"))
        terms = nodes.select("file", "id", search.search_terms(search.node_text(nodes)).alias("terms"))
        each = terms.select("file", "id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
        posting = each.groupBy("file", "id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        length = terms.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("total"))
        return {"file_meta": meta, "posting": posting, "text_length": length}

    def stale(self, root: str) -> DataFrame:
        return store.stale_files(self.store.read("file_meta"), discover(self.spark, root).select("file", "content_hash"))

    def sync(self, root: str, touched: list[str] | None = None) -> dict:
        """Bring the index up to date. ``touched`` names the only files that may have changed, relative to the root: then
        those are read and no others; else all are listed and hashed.

        Where files have only changed, and neither the identity of their symbols nor their supertypes has, only their own
        references are resolved again, and only the parts of the tables that hold them are written; else all are. Both give
        the graph that a full build would.
        """
        m = self.store.manifest()
        if m is None:
            return self.build(root) | {"path": "full"}
        with work_ends():
            path = self._fast(m, root, touched)
        if path == "full":
            self.build(root)
        return self.status() | {"path": path}

    def _fast(self, m: dict, root: str, touched: list[str] | None) -> str:
        """Which way was taken: ``none``, ``fast``, or ``full`` if that is needed."""
        old = self.store.tables(m)
        work = Work(self.spark, "sync")
        known = old["file_meta"]
        if touched is None:
            files = discover(self.spark, root)
        else:
            names = self.spark.createDataFrame([(f,) for f in touched], "file string").distinct()
            files, known = read_files(self.spark, root, touched), known.join(F.broadcast(names), "file", "left_semi")
        stale = work.save(store.stale_files(known, files.select("file", "content_hash")).withColumn("part", part_of("node", m["parts"])), "stale")
        changes = {(r.change, r.part) for r in stale.select("change", "part").distinct().collect()}
        if not changes:
            return "none"
        if {c for c, _ in changes} - {"changed"}:
            return "full"
        parts = sorted({p for _, p in changes})
        changed = stale.select("file")
        new_parsed = work.save(parse_files(files.join(F.broadcast(changed), "file", "left_semi")), "parsed")
        new_nodes = work.save(self._nodes(new_parsed, root), "nodes")
        here = {t: self.store.read(t, m, parts) for t in _BY_FILE}
        if not store.differing(here["node"].join(changed, "file", "left_semi"), new_nodes, _IDENTITY).isEmpty():
            return "full"
        parsed = store.replace_by_file(old["parsed_file"], new_parsed, changed)
        nodes = store.replace_by_file(old["node"], new_nodes, changed)
        part = build(parsed, nodes, changed, old["supertypes"])
        ids = new_nodes.select(F.col("id").alias("from_id"))
        above = lambda df: df.where(F.col("type").isin("EXTENDS", "IMPLEMENTS"))
        was = {t: here[t].join(ids, "from_id", "left_semi") for t in ("edge", "unresolved_reference")}
        if not all(store.differing(above(was[t]), above(part[t]), k).isEmpty() for t, k in (("edge", ["from_id", "to_id", "type"]), ("unresolved_reference", ["from_id", "type", "target_name"]))):
            return "full"
        new = {"node": new_nodes, "parsed_file": new_parsed, **self._derived(new_parsed, new_nodes)}
        tables = {t: store.replace_by_file(here[t], new[t].select(*here[t].columns), changed) for t in new}
        kept = {t: here[t].join(ids, "from_id", "left_anti") for t in was}
        for t in was:
            tables[t] = kept[t].unionByName(part[t].select(*here[t].columns))
        tables["evidence"] = here["evidence"].join(kept["edge"].select(F.col("id").alias("edge_id")), "edge_id", "left_semi").unionByName(part["evidence"])
        self.store.replace(tables, parts)
        return "fast"

    def overlay(self, index_files: str, dry_run: bool = False) -> dict:
        """Add the references that compiler indexes know to the graph's typed layer, which is merged over the parsed graph
        whenever that is read; the same files change nothing the second time. Returns the statistics."""
        m = self.store.manifest()
        if m is None:
            return NOT_INDEXED
        with work_ends():
            work, t = Work(self.spark, "overlay"), self.store.tables(m)
            occ = work.save(read_occurrences(self.spark.read.format("binaryFile").load(index_files).select("content")), "occurrences")
            found = overlay.typed_layer(occ, t["node"], work)
            pairs = work.save(t["typed_pair"].unionByName(found["pairs"].select(*t["typed_pair"].columns)).distinct(), "all-pairs")
            stats = overlay.statistics(found, merge.merge_typed(t["edge"], pairs))
            if not dry_run:
                self.store.replace({"typed_pair": pairs}, [])
        return stats

    # Questions

    def tables(self, m: dict | None = None) -> dict[str, DataFrame]:
        """All tables of one version, the typed layer merged into edges and evidence."""
        m = m or self.store.manifest()
        t = self.store.tables(m)
        if m["tables"].get("typed_pair"):
            t["edge"], t["evidence"] = overlay.merged_tables(t["edge"], t["evidence"], t["typed_pair"])
        return t

    def status(self, root: str | None = None) -> dict:
        """Counts, and with ``root`` whether the index is fresh and the files that are not."""
        m = self.store.manifest()
        if m is None:
            return NOT_INDEXED
        t = self.tables(m)
        each = [t["edge"].select("type"), t["node"].select(F.when(F.col("is_entry_point"), "=entry").otherwise("=node")), t["file_meta"].select(F.lit("=file")), t["unresolved_reference"].select(F.lit("=open"))]
        n = {r.type: r["count"] for r in reduce(DataFrame.union, each).groupBy("type").count().collect()}
        kinds = {k: v for k, v in n.items() if not k.startswith("=")}
        get = lambda k: n.get(k, 0)
        out = {"nodes": get("=node") + get("=entry"), "edges": sum(kinds.values()), "files": get("=file"), "edge_types": kinds, "unresolved": get("=open"), "entry_points": get("=entry")}
        return out if root is None else out | self.freshness(root)

    def freshness(self, root: str) -> dict:
        stale = [r.file for r in self.stale(root).orderBy("file").collect()]
        return {"fresh": not stale, "stale_files": stale}

    def signature(self) -> str:
        t = self.store.tables()
        return metrics.graph_signature(t["node"], t["edge"], t["unresolved_reference"]).first().signature

    def node(self, id: str) -> DataFrame:
        return self.store.read("node").where(F.col("id") == id)

    def edge_between(self, from_id: str, to_id: str) -> DataFrame:
        return self.tables()["edge"].where((F.col("from_id") == from_id) & (F.col("to_id") == to_id))

    def evidence_of(self, edge_id: str) -> DataFrame:
        return self.tables()["evidence"].where(F.col("edge_id") == edge_id)

    def entry_point_nodes(self) -> DataFrame:
        return self.store.read("node").where("is_entry_point").orderBy("id")

    def _hits(self, t: dict[str, DataFrame], query: str, k: int, depth: int, min_confidence: float) -> DataFrame:
        totals = t["text_length"].agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
        return search.hybrid(t["node"], t["edge"], query, k, depth, min_confidence, (t["posting"], totals))

    def search(self, query: str, k: int = 20, depth: int = 2, min_confidence: float = 0.5) -> DataFrame:
        t = self.tables()
        return self._hits(t, query, k, depth, min_confidence).join(t["node"], "id")

    def members(self, query: str) -> DataFrame:
        """Nodes that a qualified query names: ``Owner#member``, ``Owner.member`` or ``member(Types)``; constructors as ``<init>``."""
        return named_members(self.store.read("node"), query)

    def explore(self, query: str, task: str = "understand", max_tokens: int = 4000, depth: int = 2, min_confidence: float = 0.5, root: str | None = None) -> dict:
        """One answer: source slices around what the query finds, or the candidates where it is ambiguous.

        Tasks: ``understand`` and ``locate`` add direct neighbours; ``impact`` adds what reaches the first hit, by risk;
        ``debug`` finds a path between the two sides of ``a -> b``, and is ``understand`` where there are no two sides. With
        ``root`` the statistics tell whether the index is fresh.
        """
        m = self.store.manifest()
        if m is None:
            return NOT_INDEXED
        with work_ends():
            out = {"query": query, "task": task, "slices": [], "blast_radius": [], "blast_summary": {}, "call_path": [], "candidates": [], "blind_spots": BLIND_SPOTS}
            out["stats"] = {"nodes_visited": 0, "edges_traversed": 0, "skipped_slices": 0, "tokens_estimated": 0}
            if root is not None:
                out["stats"]["freshness"] = self.freshness(root)
            return self._explore(out, self.tables(m), query, task, max(1, max_tokens), max(0, min(4, depth)), min_confidence)

    def _explore(self, out: dict, t: dict[str, DataFrame], query: str, task: str, max_tokens: int, depth: int, min_confidence: float) -> dict:
        sides = [s.strip() for s in re.split(r"->|→|\s+to\s+", query) if s.strip()] if task == "debug" else []
        if len(sides) > 1:
            first, last = (self._found(t, s, depth, min_confidence)[0] for s in (sides[0], sides[-1]))
            if first and last:
                return self._path(out, t, first[0]["id"], last[0]["id"], max_tokens, depth, min_confidence)
        seeds, exact = self._found(t, query, depth, min_confidence)
        if task != "debug":
            same = seeds if exact else self._toss_up(query, seeds)
            if len(same) > 1:
                return out | {"candidates": self._panorama(t, same, depth, min_confidence)}
        if not seeds:
            return out
        if task == "impact":
            return self._impact(out, t, seeds[0]["id"], max_tokens, depth, min_confidence)
        return self._around(out, t, [s["id"] for s in seeds], max_tokens, min_confidence)

    def _found(self, t: dict[str, DataFrame], query: str, depth: int, min_confidence: float) -> tuple[list[dict], bool]:
        """What a query finds, in the order in which it is explored, and whether it was named exactly.

        All members that a qualified query names, else at most ``SEEDS`` hits of the search.
        """
        columns = ["id", "kind", "simple_name", "qualified_name"]
        exact = named_members(t["node"], query).select(*columns).orderBy("qualified_name", "id").collect()
        if exact:
            return [r.asDict() | {"score": 1.0} for r in exact], True
        hits = self._hits(t, query, SEEDS, depth, min_confidence).join(t["node"], "id").select(*columns, "score")
        hits = Work(self.spark, "found").save(hits, "hits")
        ranked = rank.clustered(hits, query) if len(query.split()) > 1 else rank.prioritised(hits, query.strip())
        return [r.asDict() for r in ranked.orderBy("rank").collect()], False

    def _toss_up(self, query: str, seeds: list[dict]) -> list[dict]:
        """The seeds that a bare name may mean, if none of them is the clear one."""
        same = [s for s in seeds if s["simple_name"] == query.strip()]
        if len(same) < 2 or re.search(r"[ ()#.]", query.strip()):
            return []
        hits = self.spark.createDataFrame([(query, s["qualified_name"], s["kind"], float(s["score"])) for s in same], "name string, qualified_name string, kind string, score double")
        if not rank.is_ambiguous(hits).first().ambiguous:
            return []
        types = [s for s in same if s["kind"] in TYPE_KINDS]
        return sorted(types or same, key=lambda s: (-s["score"], s["qualified_name"]))

    def _around(self, out: dict, t: dict[str, DataFrame], seeds: list[str], max_tokens: int, min_confidence: float) -> dict:
        """The seeds and then their direct neighbours: the most confident first, then the shortest."""
        ids = self.spark.createDataFrame([(s,) for s in seeds], "from_id string")
        edges = t["edge"].join(F.broadcast(ids), "from_id", "left_semi").where(F.col("confidence") >= min_confidence)
        edges = Work(self.spark, "around").save(edges.select("from_id", "to_id", "confidence"), "edges")
        best = edges.join(F.broadcast(ids.withColumnRenamed("from_id", "to_id")), "to_id", "left_anti").groupBy("to_id").agg(F.max("confidence").alias("confidence"))
        near = t["node"].join(best, F.col("id") == F.col("to_id")).select("id", "confidence", (F.col("span_end") - F.col("span_start")).alias("size"))
        more = [(r.id, r.confidence) for r in near.orderBy(F.desc("confidence"), "size", "id").collect()]
        return self._packed(out, t, [(s, 1.0) for s in seeds] + more, max_tokens, len(seeds) + len(more), edges.count())

    def _impact(self, out: dict, t: dict[str, DataFrame], seed: str, max_tokens: int, depth: int, min_confidence: float) -> dict:
        start, work = self.spark.createDataFrame([(seed,)], "seed string"), Work(self.spark, "impact")
        radius = work.save(graph.blast_radius(t["edge"], start, depth, min_confidence), "radius")
        rows = radius.join(t["node"].select("id", "qualified_name", "file"), "id").orderBy("depth", F.desc("confidence"), "id").collect()
        out["blast_radius"] = [{"node_id": r.id, "qualified_name": r.qualified_name, "file": r.file, "depth": r.depth, "edge_type": r.type, "confidence": r.confidence, "risk": r.risk, "via": r.via} for r in rows]
        for r in rows:
            out["blast_summary"][r.risk] = out["blast_summary"].get(r.risk, 0) + 1
        walked = radius.where(F.col("depth") < depth).select(F.col("id").alias("to_id")).unionByName(start.select(F.col("seed").alias("to_id")))
        walked = t["edge"].where(F.col("confidence") >= min_confidence).join(walked, "to_id", "left_semi").count() if depth else 0
        return self._packed(out, t, [(seed, 1.0)] + [(r.id, r.confidence) for r in rows], max_tokens, 1 + len(rows), walked)

    def _path(self, out: dict, t: dict[str, DataFrame], first: str, last: str, max_tokens: int, depth: int, min_confidence: float) -> dict:
        pair = self.spark.createDataFrame([(first, last)], "from_id string, to_id string")
        counts: dict[str, int] = {}
        steps = graph.path_steps(t["edge"], pair, max(depth, 4), min_confidence, counts)
        names = t["node"].select("id", "qualified_name", "file", "span_start")
        rows = steps.join(names, "id").select("step", "id", "qualified_name", "file", "span_start", "type", "confidence").orderBy("step").collect()
        out["call_path"] = [{"step": r.step, "node_id": r.id, "qualified_name": r.qualified_name, "file": r.file, "span_start": r.span_start, "edge_type": r.type, "confidence": r.confidence} for r in rows]
        return self._packed(out, t, [(r.id, r.confidence) for r in rows], max_tokens, counts["nodes"], counts["edges"])

    def _panorama(self, t: dict[str, DataFrame], found: list[dict], depth: int, min_confidence: float) -> list[dict]:
        """Each candidate with its first callers, and how much of each risk depends on it."""
        some = self.spark.createDataFrame([(s["id"], k, float(s["score"])) for k, s in enumerate(found)], "id string, at int, score double")
        owner = t["node"].where(F.col("kind").isin(TYPE_KINDS)).select(F.col("qualified_name").alias("owner"), F.col("id").alias("owner_id"))
        members = t["node"].withColumn("owner", owner_of(F.col("qualified_name"))).join(owner, "owner", "left")
        picked = members.join(some, "id", "left_semi").select(F.col("id").alias("candidate"), "owner_id", "simple_name")
        callers = resolve.callers_with_siblings(picked, members.select("id", "owner_id", "simple_name", "qualified_name"), t["edge"])
        by: dict = {}
        for r in callers.orderBy("candidate", "rank").collect():
            by.setdefault(r.candidate, []).append({"id": r.caller, "confidence": r.confidence, "via": r.via})
        risk: dict = {}
        for r in graph.blast_summary(graph.blast_radius(t["edge"], some.select(F.col("id").alias("seed")), depth, min_confidence)).collect():
            risk.setdefault(r.seed, {})[r.risk] = r.n
        rows = t["node"].join(some, "id").orderBy("at").collect()
        return [
            {"node_id": r.id, "qualified_name": r.qualified_name, "signature": r.signature, "file": r.file, "span_start": r.span_start, "span_end": r.span_end, "score": r.score, "callers": by.get(r.id, []), "blast_summary": risk.get(r.id, {})}
            for r in rows
        ]

    def _packed(self, out: dict, t: dict[str, DataFrame], wanted: list[tuple[str, float]], max_tokens: int, visited: int, walked: int) -> dict:
        """``out`` with the slices of ``wanted`` (id, confidence), in that order, that fit the budget."""
        order = dict(reversed(wanted))
        order = {i: order[i] for i, _ in wanted}
        stats = out["stats"] | {"nodes_visited": visited, "edges_traversed": walked}
        if not order:
            return out | {"stats": stats}
        some = self.spark.createDataFrame([(i, k, float(c)) for k, (i, c) in enumerate(order.items())], "id string, at int, confidence double")
        rows = t["node"].join(some, "id").join(t["parsed_file"].select("file", "source"), "file", "left")
        lines = F.slice(F.split("source", "\n"), F.col("span_start"), F.greatest(F.lit(0), F.col("span_end") - F.col("span_start") + 1))
        rows = rows.select(
            "at", F.col("id").alias("node_id"), "file", "span_start", "span_end", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("source"), "qualified_name", "confidence",
            F.lit(PROVENANCE).alias("provenance"), F.col("is_entry_point").alias("entry_point"), "entry_point_kind",
        )
        slices, used, skipped = rank.pack_slices([r.asDict() for r in rows.orderBy("at").collect()], max_tokens)
        return out | {"slices": [{k: v for k, v in s.items() if k != "at"} for s in slices], "stats": stats | {"tokens_estimated": used, "skipped_slices": skipped}}

    def debug_graph(self, symbol: str) -> dict:
        """A symbol's nodes, each with all edges at either end and its open references."""
        m = self.store.manifest()
        if m is None:
            return NOT_INDEXED
        nodes, edges, still = debug_tables(self.tables(m), symbol)
        out = {r.id: {"node": r.asDict(), "outgoing_edges": [], "incoming_edges": [], "ambiguous_candidates": []} for r in nodes.orderBy("id").collect()}
        for r in edges.orderBy("node", "direction", "other", "type").collect():
            out[r.node][f"{r.direction}_edges"].append({"id": r.other, "type": r.type, "confidence": r.confidence, "provenance": r.provenance})
        for r in still.orderBy("node", "type", "target_name").collect():
            out[r.node]["ambiguous_candidates"].append({"type": r.type, "target_name": r.target_name, "candidates": r.candidates, "reason": r.reason, "site_count": r.site_count})
        return {"symbol": symbol, "nodes": list(out.values())}


def debug_tables(t: dict[str, DataFrame], symbol: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes of a qualified or else simple name; (node, direction, other, type, confidence, provenance) of edges at either end;
    and their open references (node, type, target_name, ..)."""
    named = t["node"].where(F.col("qualified_name") == symbol)
    nodes = t["node"].where(F.col("simple_name") == symbol) if named.isEmpty() else named
    ids = nodes.select(F.col("id").alias("node"))
    columns = ["type", "confidence", "provenance"]
    out = t["edge"].join(ids, F.col("from_id") == F.col("node")).select("node", F.lit("outgoing").alias("direction"), F.col("to_id").alias("other"), *columns)
    back = t["edge"].join(ids, F.col("to_id") == F.col("node")).select("node", F.lit("incoming").alias("direction"), F.col("from_id").alias("other"), *columns)
    still = t["unresolved_reference"].join(ids, F.col("from_id") == F.col("node")).select("node", "type", "target_name", "candidates", "reason", "site_count")
    return nodes, out.unionByName(back), still


def named_members(nodes: DataFrame, query: str) -> DataFrame:
    """Those of ``nodes`` (qualified_name, ..) that a qualified query names; none if it isn't qualified."""
    nodes = nodes.withColumn("owner", owner_of(F.col("qualified_name"))).withColumn("member", F.substring_index("qualified_name", "#", -1))
    m = re.fullmatch(r"\s*(?:([\w$.]+)(?:#|\.(?=[\w$<>]+\s*\()))?([\w$<>]+)\s*(\(.*\))?\s*", query) or re.fullmatch(r"\s*([\w$.]+)\.([\w$]+)()\s*", query)
    if not m or not (m[1] or m[3]):
        return nodes.limit(0)
    name = F.substring_index("member", "(", 1)
    found = nodes.where(F.col("qualified_name").contains("#") & (name == m[2]))
    if m[1]:
        found = found.where((F.col("owner") == m[1]) | (F.substring_index("owner", ".", -1) == m[1]) | F.col("owner").endswith(f".{m[1]}"))
    if m[3]:
        found = found.where(normal_signature(F.col("member")) == normal_signature(F.lit(m[2] + m[3])))
    return found
