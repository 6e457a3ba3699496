"""Resolution of raw references to nodes: joins in order of priority that never guess between candidates.

The first tier with any hit wins and all its hits stay; more than one is an ambiguity, which is recorded and is no edge.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.names import enclosing_types
from codeloom.functions.scores import BOXES, EXACT, MARGIN, argument_score
from codeloom.schema import BLIND_UNIQUE, DECLARED


def first_tier(hits: DataFrame, ref: str = "ref", tier: str = "tier", target: str = "target") -> DataFrame:
    """(ref, tier, candidates) of the least tier that each reference has a hit in."""
    grouped = hits.groupBy(ref, tier).agg(F.array_sort(F.collect_set(target)).alias("candidates"))
    return grouped.groupBy(ref).agg(F.min_by(F.struct(tier, "candidates"), tier).alias("best")).select(ref, f"best.{tier}", "best.candidates")


def winning_names(refs: DataFrame, types: DataFrame, imports: DataFrame, wildcards: DataFrame, global_fallback: bool) -> DataFrame:
    """(ref, tier, keys): the names under which a reference's first tier with any hit finds types; see ``resolve_types``.

    Only names are compared here: how many types a name has doesn't multiply any row.
    """
    known = _keyed(types).select("key").distinct()
    dotted = lambda prefix: F.concat(prefix, F.when(prefix == "", "").otherwise("."), F.col("simple"))
    look = lambda tier, key: F.struct(F.lit(tier).alias("tier"), key.alias("key"))
    nested = F.transform(enclosing_types(F.col("owner")), lambda o, depth: F.struct((2 + depth / 1000).alias("tier"), F.concat(o, F.lit("."), "simple").alias("key")))
    plain = [look(3.0, dotted(F.col("package"))), look(5.0, F.concat(F.lit("java.lang."), "simple"))]
    if global_fallback:
        plain.append(look(6.0, F.concat(F.lit("*."), "simple")))
    wanted = [
        refs.select("ref", F.explode(F.concat(nested, F.array(*plain))).alias("look")).select("ref", "look.tier", "look.key"),
        refs.join(imports, ["file", "simple"]).select("ref", F.lit(1.0).alias("tier"), F.col("qualified_name").alias("key")),
        refs.join(wildcards.select("file", F.col("package").alias("wild")), "file").select("ref", F.lit(4.0).alias("tier"), dotted(F.col("wild")).alias("key")),
    ]
    hits = reduce(DataFrame.unionByName, wanted).join(known, "key", "left_semi")
    return first_tier(hits, target="key").withColumnRenamed("candidates", "keys")


def _keyed(types: DataFrame) -> DataFrame:
    return types.select(F.explode(F.array("qualified_name", F.concat(F.lit("*."), "simple_name"))).alias("key"), "id")


def name_groups(types: DataFrame) -> DataFrame:
    """(key, candidates, n, first) of each qualified name, and of each simple name after ``*.``."""
    return _keyed(types).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("candidates")).withColumns({"n": F.size("candidates"), "first": F.col("candidates")[0]})


def resolve_types(refs: DataFrame, types: DataFrame, imports: DataFrame, wildcards: DataFrame, global_fallback: bool) -> DataFrame:
    """(ref, tier, candidates) of type names.

    ``refs`` (ref, file, package, owner, simple), ``types`` (id, qualified_name, simple_name), ``imports`` (file, simple,
    qualified_name), ``wildcards`` (file, package). Tiers: 1 explicit import; 2 type nested in an enclosing one, innermost
    first; 3 same package; 4 all wildcard imports; 5 java.lang; 6, with ``global_fallback``, any type of that simple name.
    """
    won = winning_names(refs, types, imports, wildcards, global_fallback).select("ref", "tier", F.explode("keys").alias("key"))
    each = won.join(name_groups(types), "key").groupBy("ref", "tier").agg(F.flatten(F.collect_list("candidates")).alias("candidates"))
    return each.select("ref", "tier", F.array_sort(F.array_distinct("candidates")).alias("candidates"))


def owner_chain(starts: DataFrame, closure: DataFrame, methods: DataFrame) -> DataFrame:
    """(ref, dist, candidates): members found at the least distance up from any of a reference's owners.

    ``starts`` (ref, owner, name, arity, least), where distances below ``least`` don't count; ``closure`` (type, ancestor,
    dist); ``methods`` (id, owner, name, arity). An owner without supertypes or subtypes is its own ancestor.
    """
    own = starts.select("ref", "name", "arity", "least", "owner", F.col("owner").alias("at"), F.lit(0).alias("dist"))
    up = starts.join(closure.where("dist > 0"), F.col("owner") == F.col("type")).select("ref", "name", "arity", "least", "owner", F.col("ancestor").alias("at"), "dist")
    hits = own.unionByName(up).where(F.col("dist") >= F.col("least"))
    found = methods.select(F.col("id").alias("target"), F.col("owner").alias("at"), "name", "arity")
    return first_tier(hits.join(found, ["at", "name", "arity"]).select("ref", "dist", "target"), tier="dist")


def global_members(refs: DataFrame, methods: DataFrame) -> DataFrame:
    """(ref, candidates): all members of a name and arity, whoever owns them."""
    found = methods.groupBy("name", "arity").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    return refs.select("ref", "name", "arity").join(found, ["name", "arity"]).select("ref", "candidates")


def narrow_overloads(candidates: DataFrame, subtypes: DataFrame) -> DataFrame:
    """(ref, candidates, scores) of references with several candidates, by their arguments.

    ``candidates`` (ref, target, hints, params); ``subtypes`` (sub, sup) pairs of simple names. A candidate that an argument
    can't fit goes; one whose count of parameters differs, or isn't known, scores 0. A sole survivor wins; so does a unique
    best that fits every argument exactly, or that scores over 0 and beats the next by 2. Else the survivors stay, or, if
    none does, all. The rest of a reference's rows are never lost: each is listed with its score.
    """
    comparable = F.col("params").isNotNull() & (F.size("params") == F.size("hints"))
    pairs = F.arrays_zip(F.col("hints").alias("hint"), F.col("params").alias("param"))
    rows = candidates.withColumns({"fits": F.coalesce(comparable, F.lit(False)), "row": F.monotonically_increasing_id()})
    keyed = rows.select("ref", "target", "hints", "fits", F.when(F.col("fits"), pairs).alias("pairs"))
    args = keyed.where("fits").select("ref", "target", F.explode("pairs").alias("p")).select("ref", "target", F.col("p.hint").alias("hint"), F.col("p.param").alias("param"))
    boxes = F.create_map(*(F.lit(x) for kv in BOXES.items() for x in kv))
    args = args.withColumn("sub", F.coalesce(boxes[F.col("hint")], F.col("hint")))
    known = subtypes.select("sub", F.col("sup").alias("param")).distinct().withColumn("is_sub", F.lit(True))
    args = args.join(known, ["sub", "param"], "left").withColumn("score", argument_score(F.col("hint"), F.col("param"), F.coalesce("is_sub", F.lit(False))))
    sums = args.groupBy("ref", "target").agg(F.sum("score").alias("score"), F.bool_or(F.col("score").isNull()).alias("out"))
    scored = keyed.select("ref", "target", "hints").join(sums, ["ref", "target"], "left")
    scored = scored.select("ref", "target", F.size("hints").alias("arity"), F.coalesce("score", F.lit(0)).cast("int").alias("score"), F.coalesce("out", F.lit(False)).alias("out"))
    per_ref = Window.partitionBy("ref")
    scored = scored.withColumn("left", F.sum((~F.col("out")).cast("int")).over(per_ref))
    scored = scored.where(~F.col("out") | (F.col("left") == 0)).withColumn("score", F.when(F.col("left") == 0, 0).otherwise(F.col("score")))
    scored = scored.withColumn("best", F.max("score").over(per_ref)).withColumn("top", F.col("score") == F.col("best"))
    scored = scored.withColumns({"ties": F.sum(F.col("top").cast("int")).over(per_ref), "next": F.max(F.when(~F.col("top"), F.col("score"))).over(per_ref)})
    clear = (F.col("best") > 0) & (F.col("next").isNull() | (F.col("best") - F.col("next") >= MARGIN))
    exact = (F.col("arity") > 0) & (F.col("best") == EXACT * F.col("arity"))
    won = (F.col("left") > 0) & (F.col("ties") == 1) & (clear | exact | (F.col("left") == 1))
    kept = scored.where(~won | F.col("top"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "target")))
    kept = kept.groupBy("ref").agg(listed.alias("rows"))
    return kept.select("ref", F.col("rows.target").alias("candidates"), F.transform("rows", lambda r: -r["minus"]).alias("scores"))


def outcome(found: DataFrame, reason: str, confidence: float = DECLARED) -> DataFrame:
    """(ref, status, target, confidence, candidates, reason): an edge where there is one candidate, else an ambiguity."""
    one = F.size("candidates") == 1
    return found.select(
        "ref",
        F.when(one, "edge").otherwise("unresolved").alias("status"),
        F.when(one, F.col("candidates")[0]).alias("target"),
        F.when(one, F.lit(confidence)).alias("confidence"),
        F.when(one, F.array().cast("array<string>")).otherwise(F.col("candidates")).alias("candidates"),
        F.when(~one, F.lit(reason)).alias("reason"),
    )


def blind_outcome(found: DataFrame) -> DataFrame:
    return outcome(found, "ambiguous_global_fallback", BLIND_UNIQUE)


def import_edges(imports: DataFrame, types: DataFrame, top_level: DataFrame) -> DataFrame:
    """(from_id, to_id, file, line): every top-level type of a file imports each type that the file imports by name.

    ``imports`` (file, imported_name, is_wildcard, is_static, line): a static import is of the member's owner, or with a
    wildcard of the name itself; other wildcards import no type. ``types`` (id, qualified_name), ``top_level`` (file, id).
    """
    owner = F.when(F.col("is_static") & ~F.col("is_wildcard"), F.regexp_replace("imported_name", r"\.[^.]*$", "")).otherwise(F.col("imported_name"))
    named = imports.where(F.col("is_static") | ~F.col("is_wildcard")).select("file", "line", owner.alias("qualified_name"))
    target = types.groupBy("qualified_name").agg(F.min("id").alias("to_id"))
    return named.join(target, "qualified_name").join(top_level.select("file", F.col("id").alias("from_id")), "file").select("from_id", "to_id", "file", "line")


def innermost_scope(points: DataFrame, scopes: DataFrame, key: str) -> DataFrame:
    """(point, scope): of the scopes of the same ``key`` that hold a point, ends included, the smallest, then the first.

    ``points`` (key, point, at), ``scopes`` (key, scope, begin, end), whole numbers. A scope of up to 2^k lies in two of the
    stretches of 2^k that the numbers are cut into, at most; a point looks into one stretch of each size that occurs (64 at
    most). So a point meets the scopes that hold it and those of their size beside it, and not all of its key, and a hot key is
    dealt to many tasks.
    """
    size = F.greatest(F.lit(1), F.col("end") - F.col("begin"))
    levels = F.length(F.regexp_replace(F.bin(size - 1), "^0$", ""))  # bits of size - 1: the least k with size <= 2^k
    scopes = scopes.where(F.col("end") >= F.col("begin")).withColumn("level", levels)
    sizes = [r.level for r in scopes.select("level").distinct().collect()]
    stretch = lambda at, level: F.call_function("shiftright", at, level)
    each = scopes.select(key, "scope", "begin", "end", "level", F.explode(F.sequence(stretch(F.col("begin"), F.col("level")), stretch(F.col("end"), F.col("level")))).alias("stretch"))
    looks = F.array(*(F.lit(k) for k in sizes)) if sizes else F.array().cast("array<int>")
    asked = points.select(key, "point", "at", F.explode(looks).alias("level")).withColumn("stretch", stretch(F.col("at"), F.col("level")))
    inside = asked.join(each, [key, "level", "stretch"]).where((F.col("at") >= F.col("begin")) & (F.col("at") <= F.col("end")))
    best = F.min(F.struct((F.col("end") - F.col("begin")).alias("size"), "begin", "scope")).alias("best")
    return inside.groupBy("point").agg(best).select("point", F.col("best.scope").alias("scope"))


def entry_points(annotated: DataFrame, table: DataFrame) -> DataFrame:
    """(id, entry_point_kind) of nodes ``annotated`` (id, annotations): of the first annotation that ``table`` (annotation, kind) has."""
    each = annotated.select("id", F.posexplode("annotations").alias("at", "annotation"))
    return each.join(F.broadcast(table), "annotation").groupBy("id").agg(F.min_by("kind", "at").alias("entry_point_kind"))  # a configuration file


def callers_with_siblings(candidates: DataFrame, nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(candidate, caller, confidence, via, rank): who calls a member, or the member of that name in a direct supertype of its
    owner; the ``top`` most confident of each.

    ``candidates`` (candidate, owner_id, simple_name); ``nodes`` (id, owner_id, simple_name, qualified_name).
    """
    direct = candidates.select("candidate", F.col("candidate").alias("member"), F.lit(None).cast("string").alias("via"))
    supers = edges.where(F.col("type").isin("EXTENDS", "IMPLEMENTS")).select(F.col("from_id").alias("owner_id"), F.col("to_id").alias("super_id"))
    members = nodes.select(F.col("owner_id").alias("super_id"), "simple_name", F.col("id").alias("member"), F.col("qualified_name").alias("via"))
    sibling = candidates.join(supers, "owner_id").join(members, ["super_id", "simple_name"]).select("candidate", "member", "via")
    calls = edges.select(F.col("to_id").alias("member"), F.col("from_id").alias("caller"), "confidence")
    rows = direct.unionByName(sibling).join(calls, "member")
    first = F.min(F.struct(F.col("via").isNotNull().alias("indirect"), (-F.col("confidence")).alias("minus"), "via")).alias("first")
    rows = rows.groupBy("candidate", "caller").agg(first).select("candidate", "caller", (-F.col("first.minus")).alias("confidence"), F.col("first.via").alias("via"))
    order = Window.partitionBy("candidate").orderBy(F.desc("confidence"), "caller")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
