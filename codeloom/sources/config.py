"""Small configuration and measurement files, read on the driver."""

from __future__ import annotations

import json
import re
import shlex
import subprocess

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.build import ENTRY_POINTS
from codeloom.work import file_system

ENTRY_POINT_FILE = ".codeloom/entrypoints.yaml"


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a file in any store that Spark reads, or None."""
    fs, p = file_system(spark, path)
    try:
        stream = fs.open(p)
    except Exception:  # missing or unreadable: the caller has a default
        return None
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", errors="replace")
    finally:
        stream.close()


def read_yaml(spark: SparkSession, path: str) -> dict:
    """The mapping in a YAML file; an empty one where there is none that can be read."""
    import yaml

    try:
        found = yaml.safe_load(read_text(spark, path) or "")
    except yaml.YAMLError:
        return {}
    return found if isinstance(found, dict) else {}


def entry_points(spark: SparkSession, root: str) -> tuple[dict[str, str], dict[str, str]]:
    """Annotations, and suffixes of supertypes, that make entry points, with their kinds.

    ``annotations``, ``implements_patterns`` and ``extends_patterns`` of the file add to the built-in ones, or, with
    ``mode: replace``, take their place. A file that is missing or malformed changes nothing.
    """
    raw = read_yaml(spark, f"{root.rstrip('/')}/{ENTRY_POINT_FILE}")

    def section(key: str) -> dict[str, str]:
        found = raw.get(key)
        return {k: str(v) for k, v in found.items() if isinstance(k, str) and v} if isinstance(found, dict) else {}

    base = {} if raw.get("mode") == "replace" else ENTRY_POINTS
    return {**base, **section("annotations")}, {**section("implements_patterns"), **section("extends_patterns")}


def ground_truth(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Expected ``nodes`` (qualified_name, kind), ``edges`` (from_name, to_name, type, resolvable) and ``queries`` (query, task, k, expected)."""
    raw = read_yaml(spark, path)
    rows = lambda key: [r for r in raw.get(key) or [] if isinstance(r, dict)]
    return {
        "nodes": spark.createDataFrame([(r["qualified_name"], r.get("kind")) for r in rows("nodes")], "qualified_name string, kind string"),
        "edges": spark.createDataFrame([(r["from"], r["to"], r["type"], bool(r.get("resolvable", True))) for r in rows("edges")], "from_name string, to_name string, type string, resolvable boolean"),
        "queries": spark.createDataFrame([(r["query"], r.get("task", "locate"), int(r.get("k", 10)), list(r.get("expected_any_of", []))) for r in rows("queries")], "query string, task string, k int, expected array<string>"),
    }


def release_gates(spark: SparkSession, path: str) -> DataFrame:
    """(key, op, target): the gates of ``release_gates`` in a YAML file, or of the whole file. True and false are 1 and 0."""
    raw = read_yaml(spark, path)
    found = raw.get("release_gates", raw)
    rows = [(k, str(v["op"]), float(v["value"])) for k, v in found.items() if isinstance(v, dict) and "op" in v]
    return spark.createDataFrame(rows, "key string, op string, target double")


def metrics_of(record: dict) -> list[tuple[str, float | None]]:
    """(key, value) of a record of metrics: nested keys are joined by dots, and what is no number is not measured."""
    out = []
    for k, v in record.items():
        if isinstance(v, dict):
            out += [(f"{k}.{j}", x) for j, x in metrics_of(v)]
        else:
            out.append((k, float(v) if isinstance(v, (int, float, bool)) else None))
    return out


def metrics_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(metrics_of(json.loads(read_text(spark, path) or "{}")), "key string, value double")


def run_metrics(template: str, repo: str, workdir: str, known: list[str], timeout: float = 300) -> tuple[dict | None, str]:
    """Metrics that a command prints as a JSON object on its last line, or None and why there are none, which is no failure.

    ``{repo}`` and ``{workdir}`` of the template are filled in, without a shell; keys other than ``known`` are left out.
    """
    try:
        command = [part.format(repo=repo, workdir=workdir) for part in shlex.split(template)]
        done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=True)
        record = json.loads(done.stdout.strip().splitlines()[-1])
    except (OSError, subprocess.SubprocessError, ValueError, IndexError, KeyError) as e:
        return None, str(e)
    if not isinstance(record, dict):
        return None, "no JSON object"
    return {k: v for k, v in record.items() if k in known}, ""


def git_head(spark: SparkSession, root: str) -> str:
    """The commit that is checked out, or an empty string; a branch's is in a file of its own or among the packed ones."""
    head = (read_text(spark, f"{root}/.git/HEAD") or "").strip()
    if head.startswith("ref: "):
        name = head[5:]
        head = (read_text(spark, f"{root}/.git/{name}") or "").strip()
        for line in (read_text(spark, f"{root}/.git/packed-refs") or "").splitlines() if not head else ():
            head = line.split(" ", 1)[0] if line.endswith(f" {name}") else head
    return head if re.fullmatch(r"[0-9a-f]{40,64}", head) else ""


_BEGIN, _END = "<!-- codeloom:begin -->", "<!-- codeloom:end -->"
AGENT_NOTES = f"""{_BEGIN}
## Code graph

This repository has a code graph. Ask it before searching by hand: `python -m codeloom explore "<name or question>"`, with
`--task impact` for what depends on a symbol and `--task debug "a -> b"` for how one reaches another. Several candidates mean
that the name is ambiguous: pick one and ask with its qualified name. "No callers found" is no proof of dead code.
{_END}"""


def add_agent_notes(path: str) -> bool:
    """Put the notes for agents into a Markdown file, in place of those that are there or at its end; whether it changed."""
    try:
        with open(path, encoding="utf-8") as f:
            old = f.read()
    except FileNotFoundError:
        old = ""
    if _BEGIN in old and _END in old:
        new = old[: old.index(_BEGIN)] + AGENT_NOTES + old[old.index(_END) + len(_END) :]
    else:
        new = (old.rstrip("\n") + "\n\n" if old else "") + AGENT_NOTES + "\n"
    if new != old:
        with open(path, "w", encoding="utf-8") as f:
            f.write(new)
    return new != old
