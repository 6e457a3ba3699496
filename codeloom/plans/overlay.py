"""Overlay of compiler-derived references: occurrences to typed pairs, merged into the graph's edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import descriptor_types, owner_of, param_types, short_id
from codeloom.operators.merge import merge_typed
from codeloom.operators.resolve import innermost_scope
from codeloom.plans.build import PROVENANCE
from codeloom.sources.scip import parse_symbols
from codeloom.work import Work

PARSER = "codeloom-scip-1"


def typed_references(occ: DataFrame) -> DataFrame:
    """(document, n, caller, target, line, on_header) of references inside a definition: the smallest that holds their begin.

    References outside of any definition are left out.
    """
    place = lambda line, col: F.shiftleft(line.cast("long"), 24) + col
    defined = occ.where("is_definition")
    scopes = defined.select("document", F.col("symbol").alias("scope"), place(F.col("scope_begin")[0], F.col("scope_begin")[1]).alias("begin"), place(F.col("scope_end")[0], F.col("scope_end")[1]).alias("end"))
    headers = defined.where(F.rtrim("symbol").endswith("#")).select("document", F.col("begin_line").alias("line")).distinct().withColumn("on_header", F.lit(True))
    refs = occ.where(~F.col("is_definition") & (F.col("symbol") != ""))
    points = refs.select("document", F.struct("document", "n").alias("point"), place(F.col("begin_line"), F.col("begin_col")).alias("at"))
    inside = innermost_scope(points, scopes, "document").select("point.document", "point.n", F.col("scope").alias("caller"))
    best = inside.join(refs.select("document", "n", F.col("symbol").alias("target"), F.col("begin_line").alias("line")), ["document", "n"]).join(headers, ["document", "line"], "left")
    return best.select("document", "n", "caller", "target", (F.col("line") + 1).alias("line"), F.coalesce("on_header", F.lit(False)).alias("on_header"))


def map_symbols(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """(symbol, id, kind, skip_reason): the one node that each symbol names, or why there is none.

    Overloads are told apart by the types of the symbol's descriptor; without one only a sole member is taken.
    """
    parsed = parse_symbols(symbols).withColumnRenamed("kind", "of")
    n = nodes.select("id", "kind", F.col("qualified_name").alias("q"), "simple_name", owner_of(F.col("qualified_name")).alias("owner_name"), param_types(F.col("qualified_name")).alias("params"))
    named = parsed.where("skip_reason is null")
    qname = F.when(F.col("of") == "type", F.col("owner")).otherwise(F.concat_ws("#", "owner", "member"))
    exact = named.where("of in ('type', 'term')").withColumn("q", qname).join(n, "q").select("symbol", "id", "kind")
    created = F.col("member") == "<init>"
    methods = named.where("of = 'method'").select("symbol", "owner", F.when(created, F.substring_index("owner", ".", -1)).otherwise(F.col("member")).alias("name"), F.when(created, "constructor").otherwise("method").alias("wanted"), "disambiguator")
    found = methods.join(n, (F.col("owner") == F.col("owner_name")) & (F.col("name") == F.col("simple_name")) & (F.col("wanted") == F.col("kind")))
    types = descriptor_types(F.concat(F.lit("("), F.regexp_replace(F.col("disambiguator"), r"^\+\d+$", ""), F.lit(")V")))
    fits = F.coalesce(F.col("params") == types, F.lit(False))
    found = found.withColumn("fits", fits)
    sums = found.groupBy("symbol").agg(F.count("*").alias("several"), F.sum(F.col("fits").cast("int")).alias("fitting"))
    found = found.join(sums, "symbol")
    sole = found.where("several = 1 or (fitting = 1 and fits)").select("symbol", "id", "kind")
    hits = exact.unionByName(sole).groupBy("symbol").agg(F.count("*").alias("hits"), F.min("id").alias("id"), F.min("kind").alias("kind"))
    out = parsed.join(hits, "symbol", "left").join(sums, "symbol", "left")
    one = F.col("hits") == 1
    reason = F.when(F.col("skip_reason").isNotNull(), F.col("skip_reason")).when(one, None).when(F.col("of") == "type", "owner_not_found").when(F.col("several") > 1, "ambiguous_overload_unaligned").otherwise("member_not_found")
    return out.select("symbol", F.when(one, F.col("id")).alias("id"), F.when(one, F.col("kind")).alias("kind"), reason.alias("skip_reason"))


def typed_pairs(refs: DataFrame, mapped: DataFrame) -> DataFrame:
    """(from_id, to_id, type, file, line) of references whose both ends are nodes.

    A type mentioned on the line where another one is defined is its supertype; else methods are called and the rest is used.
    """
    ok = mapped.where("id is not null")
    a = ok.select(F.col("symbol").alias("caller"), F.col("id").alias("from_id"), F.col("kind").alias("from_kind"))
    b = ok.select(F.col("symbol").alias("target"), F.col("id").alias("to_id"), F.col("kind").alias("to_kind"))
    rows = refs.join(a, "caller").join(b, "target")
    head = F.col("on_header") & F.col("from_kind").isin("class", "interface", "enum")
    kind = F.when(head & (F.col("to_kind") == "class"), "EXTENDS").when(head & (F.col("to_kind") == "interface"), "IMPLEMENTS").when(F.col("to_kind").isin("method", "constructor"), "CALLS").otherwise("REFERENCES")
    return rows.select("from_id", "to_id", kind.alias("type"), F.col("document").alias("file"), "line")


def typed_layer(occ: DataFrame, nodes: DataFrame, work: Work) -> dict[str, DataFrame]:
    """What compiler occurrences add: ``refs``, their ``mapped`` symbols, and ``pairs`` (from_id, to_id, type, file, line)."""
    refs = work.save(typed_references(occ), "refs")
    symbols = refs.select(F.col("caller").alias("symbol")).union(refs.select(F.col("target").alias("symbol"))).distinct()
    mapped = work.save(map_symbols(symbols, nodes), "mapped")
    return {"refs": refs, "mapped": mapped, "pairs": work.save(typed_pairs(refs, mapped), "pairs")}


def merged_tables(edges: DataFrame, evidence: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edge and evidence tables with the typed layer merged in.

    A typed edge has an id of its own; the evidence of the edge that it takes over goes with it, and the pairs' places are
    evidence, too.
    """
    merged = merge_typed(edges, pairs).withColumn("id", short_id("from_id", "to_id", "type"))
    rest = edges.select("from_id", "to_id", F.col("type").alias("base"), "observed_at", "source_hash", "ambiguous_candidates")
    out = merged.withColumn("base", F.regexp_replace("type", "_TYPED$", "")).join(rest, ["from_id", "to_id", "base"], "left")
    none = F.array().cast("array<string>")
    out = out.select(
        "id", "from_id", "to_id", "type", "provenance", "confidence", F.coalesce("observed_at", F.lit(0)).alias("observed_at"), F.coalesce("source_hash", F.lit("")).alias("source_hash"),
        F.coalesce("ambiguous_candidates", none).alias("ambiguous_candidates"),
    )
    old = edges.select(F.col("id").alias("edge_id"), short_id("from_id", "to_id", F.concat("type", F.lit("_TYPED"))).alias("typed_id"))
    typed = pairs.select(short_id("from_id", "to_id", F.concat("type", F.lit("_TYPED"))).alias("typed_id")).distinct()
    moved = old.join(typed, "typed_id", "left_semi")
    kept = evidence.join(moved, "edge_id", "left").withColumn("edge_id", F.coalesce("typed_id", "edge_id")).drop("typed_id")
    new = pairs.select(short_id("from_id", "to_id", F.concat("type", F.lit("_TYPED"))).alias("edge_id"), "file", "line", F.lit(PARSER).alias("parser_version"), F.lit(0).cast("long").alias("freshness_ts"), F.lit("verified").alias("verification_status"))
    both = kept.select(*new.columns).unionByName(new)
    both = both.groupBy("edge_id", "file", "line").agg(F.min(F.struct((F.col("parser_version") == PARSER).alias("late"), "parser_version", "freshness_ts", "verification_status")).alias("first"))
    both = both.select("edge_id", "file", "line", "first.parser_version", "first.freshness_ts", "first.verification_status")
    return out, both.withColumn("id", short_id("edge_id", "file", F.col("line").cast("string"))).select(*evidence.columns)


def statistics(found: dict[str, DataFrame], merged: DataFrame) -> dict:
    """typed_refs, mapped, unmapped_symbols and skip_reasons of a typed layer; merged and added of all typed edges there are."""
    typed = merged.where(F.col("type").endswith("_TYPED"))
    sums = typed.agg(F.count_if(F.col("provenance").contains(PROVENANCE)).alias("merged"), F.count_if(~F.col("provenance").contains(PROVENANCE)).alias("added")).first()
    return {
        "typed_refs": found["refs"].count(), "mapped": found["pairs"].count(), "merged": sums.merged, "added": sums.added,
        "unmapped_symbols": found["mapped"].where("id is null").count(), "skip_reasons": {r.reason: r.n for r in skip_reasons(found["refs"], found["mapped"]).collect()},
    }


def skip_reasons(refs: DataFrame, mapped: DataFrame) -> DataFrame:
    """(reason, n): how many ends of references were looked up in vain, by why. A reference whose caller isn't mapped does not
    look its target up."""
    by = mapped.select("symbol", "id", F.col("skip_reason").alias("reason"))
    first = refs.join(by.withColumnsRenamed({"symbol": "caller", "id": "from_id"}), "caller")
    second = first.where("from_id is not null").drop("reason").join(by.withColumnsRenamed({"symbol": "target", "id": "to_id"}), "target")
    rows = first.where("from_id is null").select("reason").unionByName(second.where("to_id is null").select("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def overlay(occ: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, dict]:
    """The merged edges (from_id, to_id, type, confidence, provenance), and the statistics."""
    found = typed_layer(occ, nodes, Work(occ.sparkSession, "overlay"))
    out = merge_typed(edges, found["pairs"])
    return out, statistics(found, out)
