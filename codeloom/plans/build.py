"""From parsed files to the graph: nodes, edges, evidence and unresolved references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import member_name, node_id, owner_of, param_types, return_type, short_id
from codeloom.operators import resolve
from codeloom.operators.graph import ancestors, supertype_names
from codeloom.operators.merge import evidence, merge_edges, merge_unresolved
from codeloom.schema import BLIND_UNIQUE, DECLARED, STRUCTURAL, TYPE_KINDS
from codeloom.work import Work

PROVENANCE, PARSER = "java_parser", "codeloom-java-1"
#: Annotations of entry points and their kinds.
ENTRY_POINTS = {
    "RestController": "HTTP_CONTROLLER",
    "Controller": "HTTP_CONTROLLER",
    "RequestMapping": "HTTP_ROUTE",
    "GetMapping": "HTTP_ROUTE",
    "PostMapping": "HTTP_ROUTE",
    "PutMapping": "HTTP_ROUTE",
    "DeleteMapping": "HTTP_ROUTE",
    "PatchMapping": "HTTP_ROUTE",
    "Scheduled": "SCHEDULED",
    "KafkaListener": "MESSAGE_LISTENER",
    "JmsListener": "MESSAGE_LISTENER",
    "RabbitListener": "MESSAGE_LISTENER",
}


def node_table(parsed: DataFrame, repo: str, commit: str = "", annotations: dict[str, str] | None = None, suffixes: dict[str, str] | None = None) -> DataFrame:
    """The nodes of parsed files. ``annotations`` and ``suffixes`` (of supertypes' names) tell entry points' kinds."""
    known_kinds = ENTRY_POINTS if annotations is None else annotations
    table = F.create_map(*(F.lit(x) for kv in (known_kinds or {"": ""}).items() for x in kv))
    each = parsed.select("file", "type_refs", F.explode("nodes").alias("n")).select("file", "type_refs", "n.*")
    known = F.filter(F.transform("annotations", lambda a: table[a]), lambda k: k.isNotNull())
    kind = F.get(known, F.lit(0))
    for suffix, of in (suffixes or {}).items():
        kind = F.coalesce(kind, F.when(F.col("kind").isin(TYPE_KINDS) & _has_super(suffix), of))
    return each.select(
        node_id(F.col("kind"), F.lit(repo), F.col("file"), F.col("qualified_name")).alias("id"), "kind", F.lit("java").alias("language"), F.lit(repo).alias("repo"), "file", "span_start", "span_end", "qualified_name", "simple_name", "signature",
        F.lit(commit).alias("commit_hash"), F.unix_timestamp().alias("indexed_at"), kind.isNotNull().alias("is_entry_point"), F.coalesce(kind, F.lit("")).alias("entry_point_kind"),
    ).dropDuplicates(["id"])


def _has_super(suffix: str) -> Column:
    return F.exists("type_refs", lambda r: (r["subtype"] == F.col("qualified_name")) & r["supertype"].endswith(suffix))


class Symbols:
    """Nodes by what references look them up with."""

    def __init__(self, nodes: DataFrame):
        self.types = nodes.where(F.col("kind").isin(TYPE_KINDS)).select("id", "qualified_name", "simple_name", "file")
        members = nodes.where(F.col("kind").isin("method", "constructor"))
        self.members = members.select(
            "id", "kind", owner_of(F.col("qualified_name")).alias("owner"), member_name(F.col("qualified_name")).alias("name"), F.size(param_types(F.col("qualified_name"))).alias("arity"),
            param_types(F.col("qualified_name")).alias("params"), return_type(F.col("signature")).alias("returns"), "signature",
        )
        self.methods = self.members.where("kind = 'method'")
        self.names = nodes.select(F.col("qualified_name").alias("caller"), F.col("id").alias("from_id"), "file")


def _edges(resolved: DataFrame, refs: DataFrame, types: Column, confidence: Column) -> DataFrame:
    one = resolved.where(F.size("candidates") == 1).join(refs, "ref")
    return one.select(
        "from_id", F.col("candidates")[0].alias("to_id"), types.alias("type"), confidence.alias("confidence"), "file", "line", F.array().cast("array<string>").alias("candidates")
    )


def _open(resolved: DataFrame, refs: DataFrame, types: Column, reason: Column, target: Column) -> DataFrame:
    many = resolved.where(F.size("candidates") > 1).join(refs, "ref")
    return many.select("from_id", types.alias("type"), target.alias("target_name"), "candidates", reason.alias("reason"), "file", "line")


def build(parsed: DataFrame, nodes: DataFrame, only: DataFrame | None = None, supers: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables edge, evidence and unresolved_reference, and ``supertypes`` (sub, sup) by qualified name.

    ``only`` (file) limits the files whose references are resolved; then ``supers`` gives the known supertypes. References are
    numbered by a hash of what they are and where, so a plan can be run again with the same numbers. Each step is written
    before the next one reads it.
    """
    work = Work(parsed.sparkSession, "build")
    s = Symbols(nodes)
    own = parsed if only is None else parsed.join(only.select("file").distinct(), "file", "left_semi")
    named = F.filter("imports", lambda i: ~i["is_wildcard"] & ~i["is_static"])
    known = s.types.select(F.col("qualified_name").alias("known")).distinct()
    imports = parsed.select("file", F.explode(named).alias("i")).select("file", F.substring_index("i.imported_name", ".", -1).alias("simple"), F.col("i.imported_name").alias("qualified_name"), F.col("i.line").alias("line"))
    imports = imports.join(known, F.col("qualified_name") == F.col("known"), "left_semi").groupBy("file", "simple").agg(F.max_by("qualified_name", "line").alias("qualified_name"))
    imports = work.save(imports, "imports")
    wild = parsed.select("file", F.explode(F.filter("imports", lambda i: i["is_wildcard"] & ~i["is_static"])).alias("i")).select("file", F.col("i.imported_name").alias("package"))
    at = F.col("package")

    # Supertypes come first: the other references climb them.
    refs = own.select("file", "package", F.posexplode("type_refs").alias("n", "r")).select("file", at.alias("package"), "n", "r.*")
    refs = refs.select(short_id(F.lit("type"), "file", F.col("n").cast("string")).alias("ref"), "file", "package", F.col("subtype").alias("owner"), F.col("supertype").alias("simple"), "edge_type", "line")
    refs = refs.join(s.names.withColumnRenamed("caller", "owner"), ["owner", "file"])
    refs = work.save(refs, "type-refs")
    found = work.save(resolve.resolve_types(refs, s.types, imports, wild, True).select("ref", "candidates"), "supertypes")
    type_edges = _edges(found, refs, F.col("edge_type"), F.lit(STRUCTURAL))
    raw, undecided = [type_edges], [_open(found, refs, F.col("edge_type"), F.lit("ambiguous_supertype"), F.col("simple"))]
    if supers is None:
        supers = supertype_names(type_edges, s.types).distinct()
    supers = work.save(supers, "pairs")
    closure = work.save(ancestors(supers), "closure")

    # Calls.
    calls = own.select("file", "package", F.posexplode("calls").alias("n", "c")).select("file", "package", "n", "c.*")
    calls = calls.select(
        short_id(F.lit("call"), "file", F.col("n").cast("string")).alias("ref"), "file", "package", "caller", "owner", "name", F.col("argument_count").alias("arity"),
        F.col("receiver_hint").alias("simple"), "receiver_kind", "line", "argument_hints",
    ).join(s.names, ["caller", "file"])
    calls = work.save(calls, "calls")
    typed = calls.where(F.col("receiver_kind").isin("type", "variable") & F.col("simple").isNotNull())
    owners = resolve.resolve_types(typed, s.types, imports, wild, False).select("ref", F.explode("candidates").alias("x"))
    owners = owners.join(s.types.select(F.col("id").alias("x"), F.col("qualified_name").alias("start")), "x").select("ref", "start").distinct()
    owners = work.save(owners, "owners")
    several = owners.groupBy("ref").agg((F.count("*") > 1).alias("several"))
    created = typed.where("name = '<init>'").join(owners, "ref").join(s.members.where("kind = 'constructor'").select(F.col("id").alias("target"), F.col("owner").alias("start"), F.col("arity")), ["start", "arity"])
    created = created.groupBy("ref").agg(F.array_sort(F.collect_set("target")).alias("candidates"))
    start = lambda df, owner, least: df.select("ref", owner.alias("owner"), "name", "arity", F.lit(least).alias("least"))
    starts = [
        start(typed.where("name <> '<init>'").join(owners, "ref"), F.col("start"), 0),
        start(calls.where("receiver_kind in ('this', 'unqualified') and name <> '<init>'"), F.col("owner"), 0),
        start(calls.where("receiver_kind = 'super'"), F.col("owner"), 1),
    ]
    chain = work.save(resolve.owner_chain(reduce(DataFrame.unionByName, starts), closure, s.methods).select("ref", "candidates"), "chain")
    static = own.select("file", F.explode(F.filter("imports", lambda i: i["is_static"])).alias("i")).select(
        "file", F.when(F.col("i.is_wildcard"), F.col("i.imported_name")).otherwise(F.regexp_replace("i.imported_name", r"\.[^.]*$", "")).alias("holder"),
        F.when(~F.col("i.is_wildcard"), F.substring_index("i.imported_name", ".", -1)).alias("member"),
    )
    bare = calls.where("receiver_kind = 'unqualified'").join(chain, "ref", "left_anti")
    reach = bare.join(static, "file").where("member is null or member = name").select("ref", F.col("holder").alias("owner"), "name", "arity", F.when(F.col("member").isNotNull(), 1).otherwise(2).alias("tier"))
    held = reach.join(s.methods.select(F.col("id").alias("target"), "owner", "name", "arity"), ["owner", "name", "arity"])
    held = work.save(resolve.first_tier(held.select("ref", "tier", "target")).select("ref", "candidates"), "static")
    blind = resolve.global_members(bare.join(held, "ref", "left_anti"), s.methods).withColumn("blind", F.lit(True))
    sure = created.unionByName(chain).unionByName(held).withColumn("blind", F.lit(False))
    found = work.save(sure.unionByName(blind), "found")
    found = _narrowed(found, calls, s, closure, imports, wild, work)
    found = work.save(found.join(several, "ref", "left"), "decided")
    score = F.when(F.col("blind"), BLIND_UNIQUE).otherwise(DECLARED)
    reason = F.when(F.col("blind"), "ambiguous_global_fallback").when(F.coalesce("several", F.lit(False)), "ambiguous_type").otherwise("ambiguous_owner_chain")
    raw.append(_edges(found, calls, F.lit("CALLS"), score))
    undecided.append(_open(found, calls, F.lit("CALLS"), reason, F.col("name")))

    # Imports and uses of types.
    every = own.select("file", F.explode("imports").alias("i")).select("file", "i.*")
    top = own.select("file", F.explode("top_level_types").alias("caller")).join(s.names, ["file", "caller"]).select("file", F.col("from_id").alias("id"))
    raw.append(
        resolve.import_edges(every, s.types.select("id", "qualified_name"), top).select(
            "from_id", "to_id", F.lit("IMPORTS").alias("type"), F.lit(STRUCTURAL).alias("confidence"), "file", "line", F.array().cast("array<string>").alias("candidates")
        )
    )
    uses = own.select("file", "package", F.posexplode("type_uses").alias("n", "u")).select("file", "package", "n", "u.*")
    uses = uses.select(short_id(F.lit("use"), "file", F.col("n").cast("string")).alias("ref"), "file", "package", "caller", "owner", F.col("type_name").alias("simple"), "line").join(s.names, ["caller", "file"])
    uses = work.save(uses, "uses")
    found = work.save(resolve.resolve_types(uses, s.types, imports, wild, False).select("ref", "candidates"), "used")
    raw.append(_edges(found, uses, F.lit("REFERENCES"), F.lit(DECLARED)).where("from_id <> to_id"))
    undecided.append(_open(found, uses, F.lit("REFERENCES"), F.lit("ambiguous_type_use"), F.col("simple")))

    rows = work.save(reduce(DataFrame.unionByName, raw), "raw")
    hashes = parsed.select("file", F.substring("content_hash", 1, 64).alias("source_hash"))
    edge = merge_edges(rows).join(hashes, "file", "left").select(
        "id", "from_id", "to_id", "type", F.lit(PROVENANCE).alias("provenance"), "confidence", F.unix_timestamp().alias("observed_at"), "source_hash", "ambiguous_candidates"
    )
    proof = evidence(rows).select("id", "edge_id", "file", "line", F.lit(PARSER).alias("parser_version"), F.unix_timestamp().alias("freshness_ts"), "verification_status")
    still = merge_unresolved(reduce(DataFrame.unionByName, undecided)).withColumn("observed_at", F.unix_timestamp())
    return {"edge": edge, "evidence": proof, "unresolved_reference": still, "supertypes": supers}


def _narrowed(found: DataFrame, calls: DataFrame, s: Symbols, closure: DataFrame, imports: DataFrame, wild: DataFrame, work: Work) -> DataFrame:
    """``found`` (ref, candidates, blind) with references of several candidates narrowed by their arguments."""
    many = found.where(F.size("candidates") > 1)
    hints = calls.select("ref", "file", "package", "owner", "argument_hints")
    each = many.join(hints, "ref").select("ref", "file", "package", "owner", F.posexplode("argument_hints").alias("at", "hint"))
    nested = each.where(F.col("hint").startswith("@call:")).withColumn("p", F.split("hint", ":"))
    nested = nested.select("ref", "at", "file", "package", "owner", F.col("p")[1].alias("simple"), F.col("p")[2].alias("name"), F.col("p")[3].cast("int").alias("arity"))
    nested = nested.withColumn("call", F.concat_ws("@", "ref", "at"))
    outer = nested.where("simple <> 'this'").withColumnsRenamed({"ref": "outer_ref", "call": "ref"})
    of = resolve.resolve_types(outer, s.types, imports, wild, False).select(F.col("ref").alias("call"), F.explode("candidates").alias("x"))
    of = of.join(s.types.select(F.col("id").alias("x"), F.col("qualified_name").alias("start")), "x").select("call", "start")
    starts = nested.where("simple <> 'this'").join(of, "call").select(F.col("call").alias("ref"), F.col("start").alias("owner"), "name", "arity", F.lit(0).alias("least"))
    starts = starts.unionByName(nested.where("simple = 'this'").select(F.col("call").alias("ref"), "owner", "name", "arity", F.lit(0).alias("least")))
    targets = resolve.owner_chain(starts, closure, s.methods).select(F.col("ref").alias("call"), F.explode("candidates").alias("id"))
    returned = targets.join(s.methods.select("id", "returns"), "id").where("returns is not null and returns <> 'void'")
    returned = returned.groupBy("call").agg(F.when(F.count_distinct("returns") == 1, F.min("returns")).alias("returned"))
    returned = work.save(returned, "returned")
    known = each.withColumn("call", F.concat_ws("@", "ref", "at")).join(returned, "call", "left")
    known = known.select("ref", "at", F.when(F.col("hint").startswith("@call:"), F.coalesce("returned", F.lit("unknown"))).otherwise(F.col("hint")).alias("hint"))
    known = work.save(known, "hints")
    known = known.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hint"))), lambda x: x["hint"]).alias("hints"))
    rows = many.select("ref", F.explode("candidates").alias("target")).join(known, "ref", "left")
    rows = rows.join(s.members.select(F.col("id").alias("target"), "params"), "target", "left").select("ref", "target", F.coalesce("hints", F.array().cast("array<string>")).alias("hints"), "params")
    simple = s.types.select("qualified_name", "simple_name")
    pairs = closure.join(simple.select(F.col("qualified_name").alias("type"), F.col("simple_name").alias("sub")), "type")
    pairs = pairs.join(simple.select(F.col("qualified_name").alias("ancestor"), F.col("simple_name").alias("sup")), "ancestor").select("sub", "sup")
    narrowed = resolve.narrow_overloads(rows, pairs).select("ref", F.col("candidates").alias("narrowed"))
    out = found.join(narrowed, "ref", "left")
    return out.select("ref", F.coalesce("narrowed", "candidates").alias("candidates"), "blind")
