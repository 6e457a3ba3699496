"""Command line: build, sync, status, explore, watch, serve, overlay, verify and measure an index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from codeloom import __version__
from codeloom.operators import metrics
from codeloom.plans import measure
from codeloom.plans.engine import Engine
from codeloom.plans.snapshot import Conflict
from codeloom.sources import config


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom", description=__doc__)
    p.add_argument("--index", default=".codeloom", help="folder of the index")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "sync", "check", "init", "verify"):
        sub.add_parser(name).add_argument("root")
    sub.add_parser("version")
    sub.add_parser("status").add_argument("root", nargs="?", help="tells whether the index is fresh")
    sub.add_parser("debug").add_argument("symbol")
    e = sub.add_parser("explore")
    e.add_argument("query")
    e.add_argument("--task", choices=["understand", "locate", "impact", "debug"], default="understand")
    e.add_argument("--max-tokens", type=int, default=4000)
    e.add_argument("--depth", type=int, default=2)
    e.add_argument("--min-confidence", type=float, default=0.5)
    e.add_argument("--root", help="tells whether the index is fresh")
    w = sub.add_parser("watch")
    w.add_argument("root")
    w.add_argument("log")
    w.add_argument("--checkpoint", required=True)
    w.add_argument("--debounce", default="2 seconds")
    s = sub.add_parser("serve", help="tools over lines of JSON-RPC on standard input and output")
    s.add_argument("--tools", default="explore", help="of explore, status, reindex and debug_graph")
    s.add_argument("--root")
    o = sub.add_parser("overlay")
    o.add_argument("files", help="compiler index files")
    o.add_argument("--dry-run", action="store_true")
    b = sub.add_parser("benchmark").add_subparsers(dest="step", required=True)
    r = b.add_parser("run")
    r.add_argument("root")
    r.add_argument("--output", required=True)
    r.add_argument("--adapter", default="self", help="self, grep or external:<command>")
    r.add_argument("--truth", help="YAML file of expected nodes, edges and queries")
    r.add_argument("--scope", action="append", help="prefix of files that count")
    c = b.add_parser("compare")
    c.add_argument("record")
    c.add_argument("gates", help="YAML file of release gates")
    t = b.add_parser("report")
    t.add_argument("record")
    t.add_argument("output")
    t.add_argument("--gates")
    return p


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "version":
        print(__version__)
        return 0
    if a.command == "init":
        print("changed" if config.add_agent_notes(f"{a.root}/AGENTS.md") else "already up to date")
        return 0
    spark = SparkSession.builder.appName("codeloom").getOrCreate()
    try:
        return _run(a, spark, Engine(spark, a.index))
    except Conflict as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, spark: SparkSession, engine: Engine) -> int:
    if a.command == "benchmark":
        return _benchmark(a, spark, engine)
    if a.command == "serve":
        from codeloom.serve import serve

        serve(engine, a.tools.split(","), a.root, sys.stdin, sys.stdout)
        return 0
    if a.command == "watch":
        from codeloom.streaming.watch import watch

        if engine.store.version() is None:
            print(json.dumps(engine.build(a.root)))
        watch(engine, a.root, a.log, a.checkpoint, a.debounce, lambda r: print(json.dumps(r))).awaitTermination()
        return 0
    if a.command == "check":
        out = {"error": "not_indexed"} if engine.store.version() is None else engine.freshness(a.root)
    elif a.command == "status":
        out = engine.status(a.root)
    elif a.command == "debug":
        out = engine.debug_graph(a.symbol)
    elif a.command == "overlay":
        out = engine.overlay(a.files, a.dry_run)
    elif a.command == "verify":
        out = measure.verify(engine, a.root)
    elif a.command == "explore":
        out = engine.explore(a.query, a.task, a.max_tokens, a.depth, a.min_confidence, a.root)
    else:
        out = getattr(engine, a.command)(a.root)
    print(json.dumps(out, indent=2, default=str))
    return int("error" in out or bool(out.get("stale_files")) and a.command == "check" or out.get("passed") is False)


def _benchmark(a: argparse.Namespace, spark: SparkSession, engine: Engine) -> int:
    if a.step == "run":
        values = measure.measured_by(engine, a.adapter, a.root, a.scope, a.truth)
        with open(a.output, "w") as f:
            f.write(json.dumps(values, indent=2, sort_keys=True) + "\n")
        print(f"{values['status']} {a.output}")
        return 0
    gates = metrics.gates(config.metrics_json(spark, a.record), config.release_gates(spark, a.gates)) if a.gates else None
    if a.step == "report":
        with open(a.record) as f, open(a.output, "w") as out:
            out.write(measure.report(json.load(f), gates))
        return 0
    for r in gates.orderBy("key").collect():
        print(f"{r.status} {r.key}: {r.value} {r.op} {r.target}")
    status = metrics.overall(gates).first().status
    print(status)
    return int(status == "FAIL")


if __name__ == "__main__":
    sys.exit(main())
