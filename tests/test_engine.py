"""Build, sync, exploration, overlay and streaming on a small repository."""

import io
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.__main__ import main
from codeloom.operators import metrics, rank
from codeloom.plans import measure, snapshot
from codeloom.plans.engine import Engine
from codeloom.plans.overlay import overlay
from codeloom.plans.snapshot import Conflict
from codeloom.serve import serve
from codeloom.sources import config
from codeloom.sources.files import discover
from codeloom.sources.scip import fields, four, occurrences, parse_symbol, read_occurrences
from codeloom.streaming.watch import watch

FILES = {
    "p/Shape.java": "package p;\npublic interface Shape {\n  double area(int scale);\n}\n",
    "p/Disc.java": "package p;\npublic class Disc implements Shape {\n  private Log log;\n  public double area(int scale) {\n    log.put(scale);\n    log.put(\"s\");\n    log.put(null);\n    return helper();\n  }\n  double helper() { return 1.0; }\n}\n",
    "p/Ring.java": "package p;\npublic class Ring extends Disc {\n  double twice() {\n    return helper() + super.area(2);\n  }\n}\n",
    "p/Log.java": "package p;\npublic class Log {\n  public void put(int n) {\n  }\n  public void put(String s) {\n  }\n  public void put(Object o) {\n  }\n}\n",
    "q/Main.java": "package q;\nimport p.Shape;\nimport p.Ring;\n@RestController\npublic class Main {\n  void run(Shape s) {\n    s.area(3);\n    new Ring().twice();\n    lonely();\n  }\n}\n",
    "q/Other.java": "package q;\npublic class Other {\n  static void lonely() {\n  }\n}\n",
    "target/Skip.java": "class Skip {}\n",
}


@pytest.fixture()
def source(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(tmp_path / "src")


def _short(i):
    return i.split(":")[-1]


def test_build_sync_and_explore(spark, source, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    assert e.explore("x")["error"] == "not_indexed"
    stats = e.build(source)
    assert stats["files"] == 6 and stats["entry_points"] == 1
    edges = {(r.type, _short(r.from_id), _short(r.to_id), r.confidence) for r in e.store.read("edge").collect()}
    assert {
        ("IMPLEMENTS", "p.Disc", "p.Shape", 1.0), ("EXTENDS", "p.Ring", "p.Disc", 1.0), ("IMPORTS", "q.Main", "p.Ring", 1.0),
        ("CALLS", "p.Disc#area(int)", "p.Log#put(int)", 0.95), ("CALLS", "p.Disc#area(int)", "p.Log#put(String)", 0.95), ("CALLS", "p.Disc#area(int)", "p.Disc#helper()", 0.95),
        ("CALLS", "p.Ring#twice()", "p.Disc#helper()", 0.95), ("CALLS", "p.Ring#twice()", "p.Disc#area(int)", 0.95), ("CALLS", "q.Main#run(Shape)", "p.Shape#area(int)", 0.95),
        ("CALLS", "q.Main#run(Shape)", "q.Other#lonely()", 0.7), ("REFERENCES", "p.Disc#log", "p.Log", 0.95),
    } <= edges
    (still,) = e.store.read("unresolved_reference").collect()
    assert still.target_name == "put" and [_short(c) for c in still.candidates] == ["p.Log#put(Object)", "p.Log#put(String)"] and still.reason == "ambiguous_owner_chain"
    assert e.store.read("evidence").count() >= len(edges)

    found = e.explore("area")
    by = {c["qualified_name"]: c for c in found["candidates"]}
    assert set(by) == {"p.Shape#area(int)", "p.Disc#area(int)"} and not found["slices"]
    assert any(c["via"] == "p.Shape#area(int)" for c in by["p.Disc#area(int)"]["callers"])
    one = e.explore("Disc#helper()")
    assert one["slices"][0]["source"].strip() == "double helper() { return 1.0; }"
    assert e.explore("Log#put(String)")["slices"][0]["qualified_name"] == "p.Log#put(String)"
    hurt = e.explore("Disc#helper()", "impact")
    assert {r["qualified_name"]: r["risk"] for r in hurt["blast_radius"]}["p.Ring#twice()"] == "will_break" and hurt["stats"]["nodes_visited"] == 1 + len(hurt["blast_radius"])
    path = e.explore("Ring#twice to Log#put(int)", "debug")
    assert [(s["step"], s["qualified_name"], s["edge_type"], s["confidence"]) for s in path["call_path"]] == [
        (0, "p.Ring#twice()", "seed", 1.0), (1, "p.Disc#area(int)", "CALLS", 0.95), (2, "p.Log#put(int)", "CALLS", 0.95),
    ]
    assert [s["qualified_name"] for s in path["slices"]] == [s["qualified_name"] for s in path["call_path"]] and path["stats"]["edges_traversed"] > 0
    assert e.explore("Shape -> Main", "debug")["call_path"] == []
    alone = e.explore("Disc#helper()", "debug")  # no two sides: as understand
    assert alone["call_path"] == [] and alone["slices"][0]["qualified_name"] == "p.Disc#helper()"
    every = e.explore("Log#put", "debug")  # all members of the name are seeds
    assert {s["qualified_name"] for s in every["slices"]} >= {"p.Log#put(int)", "p.Log#put(String)", "p.Log#put(Object)"} and not every["candidates"]
    (dumped,) = e.debug_graph("helper")["nodes"]
    assert {_short(x["id"]) for x in dumped["incoming_edges"]} == {"p.Disc#area(int)", "p.Ring#twice()"}
    assert e.debug_graph("area")["nodes"][0]["ambiguous_candidates"][0]["target_name"] == "put"
    around = e.explore("Disc")
    assert around["slices"][0]["qualified_name"] == "p.Disc" and around["slices"][0]["provenance"] == "java_parser" and around["stats"]["skipped_slices"] == 0
    main = next(n for n in e.entry_point_nodes().collect())
    assert (main.qualified_name, main.entry_point_kind) == ("q.Main", "HTTP_CONTROLLER") and e.node(main.id).first().qualified_name == "q.Main"
    (edge,) = e.edge_between("class:repo:p/Ring.java:p.Ring", "class:repo:p/Disc.java:p.Disc").collect()
    assert edge.type == "EXTENDS" and [(r.file, r.line) for r in e.evidence_of(edge.id).collect()] == [("p/Ring.java", 2)]
    assert e.status(source)["fresh"] is True and e.explore("Disc", root=source)["stats"]["freshness"] == {"fresh": True, "stale_files": []}

    before = e.signature()
    assert e.sync(source)["path"] == "none"
    (open(f"{source}/p/Disc.java", "a")).write("// a comment\n")
    assert [r.file for r in e.stale(source).collect()] == ["p/Disc.java"]
    assert e.status(source)["stale_files"] == ["p/Disc.java"]
    assert e.sync(source)["path"] == "fast" and e.signature() == before
    open(f"{source}/q/New.java", "w").write("package q;\nclass New extends p.Ring { }\n")
    os.remove(f"{source}/q/Other.java")
    assert e.sync(source)["path"] == "full"
    fresh = Engine(spark, f"{tmp_path}/fresh")
    fresh.build(source)
    assert fresh.signature() == e.signature() != before


def test_the_signature_sees_everything(spark):
    """Spans, signatures, confidences, candidates and open references are part of it; times and provenance are not."""
    node = spark.createDataFrame([("n", "class", "a.A", "A", "A.java", 1, 2, "class A", False, "", 5)], "id string, kind string, qualified_name string, simple_name string, file string, span_start int, span_end int, signature string, is_entry_point boolean, entry_point_kind string, indexed_at long")
    edge = spark.createDataFrame([("e", "n", "m", "CALLS", 0.7, ["x", "y"], "p")], "id string, from_id string, to_id string, type string, confidence double, ambiguous_candidates array<string>, provenance string")
    still = spark.createDataFrame([("u", "n", "CALLS", "f", ["x", "y"], "why", 2)], "id string, from_id string, type string, target_name string, candidates array<string>, reason string, site_count int")
    of = lambda *t: metrics.graph_signature(*t).first().signature
    first = of(node, edge, still)
    for k, c, v in [(0, "span_end", 3), (0, "signature", "x"), (0, "entry_point_kind", "X"), (1, "confidence", 0.95), (1, "ambiguous_candidates", F.array(F.lit("x"))), (2, "site_count", 3), (2, "reason", ""), (2, "candidates", F.array(F.lit("x")))]:
        t = [node, edge, still]
        t[k] = t[k].withColumn(c, v if hasattr(v, "cast") else F.lit(v))
        assert of(*t) != first
    assert of(node.withColumn("indexed_at", F.lit(9)), edge.withColumn("provenance", F.lit("q")).withColumn("ambiguous_candidates", F.array(F.lit("y"), F.lit("x"))), still) == first
    assert of(node, edge, still.limit(0)) != first


def test_incremental_steps_equal_full_builds(spark, source, tmp_path, monkeypatch):
    """Twelve seeded steps of edits, new signatures, new and deleted files: after each, by the named files alone, the graph is
    that of a full build; a part of the tables that no change touches isn't written."""
    import random

    monkeypatch.setattr(snapshot, "FILES_A_PART", 2)
    r, paths = random.Random(1), []
    e = Engine(spark, f"{tmp_path}/index")
    e.build(source)
    live = [f for f in FILES if not f.startswith("target/")]
    for step in range(12):
        kind, name = r.choice(["body", "body", "signature", "new", "delete"]), r.choice(live)
        before = e.store.manifest()
        if kind == "body":
            text = open(f"{source}/{name}").read()
            open(f"{source}/{name}", "w").write(text.replace("{\n", "{ // edit\n", 1) + f"// step {step}\n")
        elif kind == "signature":
            text = open(f"{source}/{name}").read()
            open(f"{source}/{name}", "w").write(text.rstrip()[:-1] + f"  void added{step}(int x) {{ lonely(); }}\n}}\n" if text.rstrip().endswith("}") else text + f"class More{step} {{}}\n")
        elif kind == "new":
            name = f"q/New{step}.java"
            live.append(name)
            open(f"{source}/{name}", "w").write(f"package q;\nclass New{step} extends p.Ring {{ void go(p.Log log) {{ log.put({step}); lonely(); }} }}\n")
        else:
            live.remove(name)
            os.remove(f"{source}/{name}")
        paths.append(e.sync(source, [name])["path"])
        if paths[-1] == "fast":
            old, now = before["tables"]["node"], e.store.manifest()["tables"]["node"]
            assert sum(old[p] != now[p] for p in now) == 1 and len(now) > 1
        if step == 11 or paths[-1] == "fast" and paths.count("fast") < 3:
            fresh = Engine(spark, f"{tmp_path}/fresh-{step}")
            fresh.build(source)
            assert fresh.signature() == e.signature()
    assert paths.count("fast") >= 2 and "full" in paths


def test_files_that_vanish(spark, source, tmp_path):
    """A file that is listed but gone when it is read is as if it had been deleted."""
    files = discover(spark, source)
    os.remove(f"{source}/q/Other.java")
    assert "q/Other.java" not in {r.file for r in files.collect()}
    e = Engine(spark, f"{tmp_path}/index")
    e.build(source)
    os.remove(f"{source}/p/Ring.java")
    assert e.sync(source, ["p/Ring.java", "q/Never.java"])["path"] == "full" and e.status()["files"] == 4


def test_writers_of_one_version(spark, source, tmp_path):
    """Of two writers of the same version the later one fails and changes nothing; a manifest that is not whole is passed over."""
    e = Engine(spark, f"{tmp_path}/index")
    e.build(source)
    first, m = e.signature(), e.store.manifest()
    open(f"{tmp_path}/index/manifest-{m['version'] + 1}", "w").write('{"version": 2')
    assert e.signature() == first and e.store.version() == m["version"]
    with pytest.raises(Conflict):
        e.build(source)
    assert main(["--index", f"{tmp_path}/index", "build", source]) == 1
    os.remove(f"{tmp_path}/index/manifest-{m['version'] + 1}")
    assert e.build(source)["files"] == 6 and e.signature() == first
    with Engine(spark, f"{tmp_path}/index") as again:
        assert again.status()["files"] == 6


def test_tools(spark, source, tmp_path):
    """Requests and responses of the tool server, and tools that are served only if asked for."""
    e = Engine(spark, f"{tmp_path}/index")
    lines = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "explore", "arguments": {"query": "Disc"}}},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "reindex"}},
        {"jsonrpc": "2.0", "id": 5, "method": "tools/call", "params": {"name": "status"}},
        {"jsonrpc": "2.0", "id": 6, "method": "tools/call", "params": {"name": "explore", "arguments": {"query": "Disc#helper()", "task": "impact"}}},
        {"jsonrpc": "2.0", "id": 7, "method": "tools/call", "params": {"name": "debug_graph", "arguments": {"symbol": "Disc"}}},
        {"jsonrpc": "2.0", "id": 8, "method": "tools/call", "params": {"name": "explore", "arguments": {"wrong": 1}}}, {"jsonrpc": "2.0", "id": 9, "method": "nothing"},
    ]
    out = io.StringIO()
    serve(e, ["status", "reindex"], source, io.StringIO("\n".join([*map(json.dumps, lines), "no json"])), out)
    got = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    body = lambda k: json.loads(got[k]["result"]["content"][0]["text"])
    assert [t["name"] for t in got[2]["result"]["tools"]] == ["explore", "status", "reindex"]
    assert body(3)["error"] == "not_indexed" and body(4)["files"] == 6 and body(5)["fresh"] is True and body(6)["blast_summary"]["will_break"] >= 1
    assert all("error" in got[k] for k in (7, 8, 9, None)) and set(got) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}


def test_command_line(spark, source, tmp_path, capsys):
    run = lambda *a: main(["--index", f"{tmp_path}/index", *a])
    assert run("version") == 0 and run("check", source) == 1 and run("build", source) == 0 and run("check", source) == 0 and run("status") == 0
    assert run("init", source) == 0 and run("init", source) == 0 and "already up to date" in capsys.readouterr().out
    notes = open(f"{source}/AGENTS.md").read()
    open(f"{source}/AGENTS.md", "w").write("Own words.\n" + notes.replace("Ask it", "Old text"))
    assert config.add_agent_notes(f"{source}/AGENTS.md") and open(f"{source}/AGENTS.md").read() == "Own words.\n" + notes
    assert run("explore", "Disc", "--task", "impact") == 0 and run("debug", "helper") == 0 and run("verify", source) == 0
    record, gates = f"{tmp_path}/record.json", tmp_path / "gates.yaml"
    assert run("benchmark", "run", source, "--output", record, "--adapter", "grep", "--scope", "p/") == 0 and json.load(open(record))["index_seconds"] is None
    gates.write_text("release_gates:\n  files: {op: '>=', value: 4}\n  node_recall: {op: '>=', value: 0.9}\n")
    assert run("benchmark", "compare", record, str(gates)) == 1  # what wasn't measured hasn't passed
    gates.write_text("release_gates:\n  files: {op: '==', value: 4}\n")
    assert run("benchmark", "compare", record, str(gates)) == 0 and run("benchmark", "report", record, f"{tmp_path}/report.md", "--gates", str(gates)) == 0
    assert "Overall: PASS" in open(f"{tmp_path}/report.md").read()
    assert run("benchmark", "run", source, "--output", record, "--adapter", "external:false") == 0 and json.load(open(record))["status"] == "SKIP"
    known, why = config.run_metrics("""python -c 'import json; print(json.dumps(dict(files=3, other=1, repo="{repo}")))'""", "x", "y", ["files"])
    assert known == {"files": 3} and not why


def test_slices_fit_the_budget():
    """Whole lines; no fragment of a long slice; a single long line is cut; an empty slice ends it."""
    big = {"source": "\n".join(f"  void method{k}() {{ call{k}(); }}" for k in range(40)), "span_start": 1, "span_end": 40, "at": 0}
    small = {"source": "int x;\nint y;", "span_start": 5, "span_end": 6, "at": 1}
    out, used, skipped = rank.pack_slices([big, small], 40)
    assert skipped == 1 and [s["span_start"] for s in out] == [5] and not out[0]["truncated"] and used == 3
    out, used, skipped = rank.pack_slices([big, small], 150)
    assert out[0]["truncated"] and out[0]["span_end"] == len(out[0]["source"].split("\n")) and used <= 150 and skipped == 0
    out, used, _ = rank.pack_slices([{"source": "x" * 1000, "span_start": 3, "span_end": 3}], 10)
    assert out[0]["source"] == "x" * 40 and out[0]["truncated"] and used == 10
    assert rank.pack_slices([{"source": "", "span_start": 1, "span_end": 0}, small], 10) == ([], 0, 0)


def test_discovery(spark, source):
    rows = discover(spark, source).collect()
    assert sorted(r.file for r in rows) == sorted(f for f in FILES if not f.startswith("target/"))


def test_watch(spark, source, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    e.build(source)
    log = tmp_path / "log"
    log.mkdir()
    open(f"{source}/q/Main.java", "a").write("// edited\n")
    rows = [{"path": p, "op": "change", "ts": datetime(2024, 1, 1).isoformat()} for p in ("q/Main.java", "q/Main.java", "notes.txt", "target/X.java")]
    (log / "1.json").write_text("\n".join(map(json.dumps, rows)))
    done = []
    watch(e, source, str(log), f"{tmp_path}/checkpoint", done=done.append, once=True).awaitTermination()
    assert len(done) == 1 and done[0]["paths"] == 1 and done[0]["path"] == "fast" and (done[0]["changed"], done[0]["deleted"]) == (["q/Main.java"], [])


def _varint(n):
    out = b""
    while True:
        out, n = out + bytes([n & 127 | (128 if n > 127 else 0)]), n >> 7
        if not n:
            return out


def _field(k, v):
    return _varint(k << 3) + _varint(v) if isinstance(v, int) else _varint(k << 3 | 2) + _varint(len(v)) + v


def _occurrence(symbol, at, roles=0, scope=None):
    packed = lambda r: b"".join(map(_varint, r))
    return _field(1, packed(at)) + _field(2, symbol.encode()) + (_field(3, roles) if roles else b"") + (_field(7, packed(scope)) if scope else b"")


def test_scip_decoding():
    raw = _field(1, b"meta") + _field(2, _field(1, b"A.java") + _field(2, _occurrence("s p a 1 A#", [1, 2, 5], 1, [1, 0, 9, 1])) + _field(2, _occurrence("s p a 1 A#f().", [3, 4, 3, 8])))
    rows = list(occurrences(raw))
    assert [(r["begin_line"], r["begin_col"], r["is_definition"]) for r in rows] == [(1, 2, True), (3, 4, False)] and rows[0]["scope_end"] == [9, 1]
    with pytest.raises(ValueError):
        list(fields(raw[:-3]))
    with pytest.raises(ValueError):
        four([1, 2])


def test_symbols():
    s = parse_symbol("semanticdb maven . . com/x/Outer#Inner#run(+1).")
    assert (s["owner"], s["member"], s["kind"], s["disambiguator"]) == ("com.x.Outer.Inner", "run", "method", "+1")
    assert parse_symbol("semanticdb maven . . com/x/A#`<init>`().")["member"] == "<init>"
    assert parse_symbol("semanticdb maven . . com/x/A#")["kind"] == "type"
    assert parse_symbol("local 3")["skip_reason"] == "local_symbol" and parse_symbol("nonsense")["skip_reason"] == "malformed_symbol"
    assert parse_symbol("semanticdb maven . . com/x/A#f().(p)")["skip_reason"] == "unsupported_descriptor"


def test_overlay(spark, source, tmp_path):
    e = Engine(spark, f"{tmp_path}/index")
    e.build(source)
    s = "semanticdb maven . . "
    items = [
        _occurrence(f"{s}p/Disc#", [1, 13, 17], 1, [1, 0, 10, 1]),
        _occurrence(f"{s}p/Shape#", [1, 29, 34]),
        _occurrence(f"{s}p/Disc#area().", [3, 16, 20], 1, [3, 2, 8, 3]),
        _occurrence(f"{s}p/Log#put(Ljava/lang/Object;).", [6, 8, 11]),
        _occurrence(f"{s}p/Log#put(I).", [4, 8, 11]),
        _occurrence("local 1", [4, 12, 13]),
    ]
    raw = _field(2, _field(1, b"p/Disc.java") + b"".join(_field(2, i) for i in items))
    occ = read_occurrences(spark.createDataFrame([(bytearray(raw),)], "content binary"))
    out, stats = overlay(occ, e.store.read("node"), e.store.read("edge"))
    typed = {(r.type, _short(r.from_id), _short(r.to_id), r.provenance) for r in out.where(F.col("type").endswith("_TYPED")).collect()}
    both = "java_parser+scip_java"
    assert typed == {("IMPLEMENTS_TYPED", "p.Disc", "p.Shape", both), ("CALLS_TYPED", "p.Disc#area(int)", "p.Log#put(int)", both), ("CALLS_TYPED", "p.Disc#area(int)", "p.Log#put(Object)", "scip_java")}
    assert (stats["typed_refs"], stats["mapped"], stats["merged"], stats["added"], stats["unmapped_symbols"]) == (4, 3, 2, 1, 1) and stats["skip_reasons"] == {"local_symbol": 1}
    again, same = overlay(occ, e.store.read("node"), out)
    assert again.count() == out.count() and same == stats
    # Stored: a layer of its own, whose edges have ids and carry evidence over, and which a rebuild keeps.
    (tmp_path / "scip").mkdir()
    (tmp_path / "scip" / "index.scip").write_bytes(raw)
    before, version = e.tables(), e.store.version()
    shape = before["edge"].where("type = 'IMPLEMENTS'").first()
    assert e.overlay(f"{tmp_path}/scip", dry_run=True) == stats and e.store.version() == version
    assert e.overlay(f"{tmp_path}/scip") == stats and e.overlay(f"{tmp_path}/scip") == stats
    for _ in range(2):
        t = e.tables()
        assert t["edge"].count() == before["edge"].count() + 1 and t["edge"].select("id").distinct().count() == t["edge"].count()
        moved = t["edge"].where("type = 'IMPLEMENTS_TYPED'").first()
        assert moved.id != shape.id and moved.confidence == 1.0 and t["edge"].where(F.col("id") == shape.id).isEmpty()
        assert {(r.file, r.line, r.parser_version) for r in t["evidence"].where(F.col("edge_id") == moved.id).collect()} == {("p/Disc.java", 2, "codeloom-java-1")}
        new = t["edge"].where("provenance = 'scip_java'").first()
        assert {(r.file, r.line, r.parser_version) for r in t["evidence"].where(F.col("edge_id") == new.id).collect()} == {("p/Disc.java", 7, "codeloom-scip-1")}
        assert t["evidence"].join(t["edge"].select(F.col("id").alias("edge_id")), "edge_id", "left_anti").isEmpty()
        e.build(source)


def test_measurement(spark, source, tmp_path):
    (tmp_path / "truth.yaml").write_text(
        "nodes:\n- {qualified_name: p.Disc, kind: class}\n- {qualified_name: p.Shape, kind: interface}\n- {qualified_name: p.Nowhere, kind: class}\n"
        "edges:\n- {from: p.Disc, to: p.Shape, type: IMPLEMENTS, resolvable: true}\nqueries:\n- {query: Disc, k: 5, expected_any_of: [p.Disc]}\n"
    )
    (tmp_path / "gates.yaml").write_text("release_gates:\n  parse_error_rate: {op: '<=', value: 0.0}\n  deterministic_rebuild: {op: '==', value: true}\n  absent: {op: '>', value: 1}\n")
    os.makedirs(f"{source}/.codeloom")
    open(f"{source}/.codeloom/entrypoints.yaml", "w").write("implements_patterns: {Shape: RPC_PROVIDER}\nannotations: [not, a, mapping]\n")
    e = Engine(spark, f"{tmp_path}/index")
    values = measure.record(e, source, queries=2)
    assert values["files"] == 6 and values["deterministic_rebuild"] and values["parse_error_rate"] == 0 and values["edges_ambiguous"] == 2
    assert {(r.simple_name, r.entry_point_kind) for r in e.store.read("node").where("is_entry_point").collect()} == {("Disc", "RPC_PROVIDER"), ("Main", "HTTP_CONTROLLER")}
    row = measure.evaluate(e, config.ground_truth(spark, f"{tmp_path}/truth.yaml")).first()
    assert row.node_recall == pytest.approx(2 / 3) and (row.edge_precision, row.edge_recall, row.ambiguity_recall, row.topk_recall) == (1, 1, None, 1)
    gates = metrics.gates(spark.createDataFrame(config.metrics_of(values), "key string, value double"), config.release_gates(spark, f"{tmp_path}/gates.yaml"))
    assert {r.key: r.status for r in gates.collect()} == {"parse_error_rate": "PASS", "deterministic_rebuild": "PASS", "absent": "SKIP"}
    assert metrics.overall(gates).first().status == "FAIL" and "_not measured_" in measure.report({**values, "x": None}, gates)
    assert metrics.overall(gates.where("key <> 'absent'")).first().status == "PASS" and metrics.overall(gates.limit(0)).first().status == "FAIL"
    assert config.run_metrics("false", "", "", [])[0] is None and config.metrics_of({"a": {"b": 1}}) == [("a.b", 1.0)]
    open(f"{source}/.codeloom/entrypoints.yaml", "w").write(": not yaml [")
    assert config.entry_points(spark, source)[1] == {} and config.git_head(spark, source) == ""
    os.makedirs(f"{source}/.git")
    open(f"{source}/.git/HEAD", "w").write("ref: refs/heads/work\n")
    open(f"{source}/.git/packed-refs", "w").write("# packed\n" + "1" * 40 + " refs/heads/other\n" + "2" * 40 + " refs/heads/work\n")
    assert config.git_head(spark, source) == "2" * 40
