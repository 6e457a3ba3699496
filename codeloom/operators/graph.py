"""Graph operators: neighbours, blast radius, paths, closures and bounded personalised PageRank.

Every walk is a number of joins between a frontier and the edge table; nothing is collected. Each frontier is written, so a
step reads tables and never computes the steps before it again, and Spark knows its size: a small one is broadcast and the
edges are only scanned; else both are shuffled on the join key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.scores import risk_level
from codeloom.work import Work


def neighbours(edges: DataFrame, nodes: DataFrame, outgoing: bool = True, min_confidence: float = 0.0) -> DataFrame:
    """Each edge of at least ``min_confidence`` with the node at its far end."""
    far = "to_id" if outgoing else "from_id"
    kept = edges.where(F.col("confidence") >= min_confidence).select("from_id", "to_id", "type", "confidence")
    return kept.join(nodes.select(F.col("id").alias(far), "kind", "simple_name", "file"), far)


def _one_edge(rows: DataFrame, *keys: str) -> DataFrame:
    """The edge a walk reports for each reached node: most confident, then type, then the far id."""
    best = F.min(F.struct((-F.col("confidence")).alias("minus"), "type", "via")).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, (-F.col("best.minus")).alias("confidence"), F.col("best.type").alias("type"), F.col("best.via").alias("via"))


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int, min_confidence: float = 0.5) -> DataFrame:
    """(seed, id, depth, confidence, type, via, risk): what reaches a seed over up to ``depth`` edges, first visit only.

    ``seeds`` has the column ``seed``; all seeds are walked at once. Stops where nothing new is reached.
    """
    work = Work(edges.sparkSession, "radius")
    edges = edges.where(F.col("confidence") >= min_confidence).select("from_id", "to_id", "type", "confidence")
    start = work.save(seeds.select("seed").distinct(), "seeds").select("seed", F.col("seed").alias("id"))
    visited, frontier, found = start, start, []
    for hop in range(1, depth + 1):
        step = frontier.join(edges, F.col("id") == F.col("to_id")).select("seed", F.col("from_id").alias("id"), "type", "confidence", F.col("to_id").alias("via"))
        step = _one_edge(step.join(visited, ["seed", "id"], "left_anti"), "seed", "id").withColumn("depth", F.lit(hop))
        step = work.save(step, str(hop))
        found.append(step)
        if hop < depth and step.isEmpty():
            break
        frontier = step.select("seed", "id")
        visited = visited.unionByName(frontier)
    out = reduce(DataFrame.unionByName, found) if found else start.limit(0).selectExpr("seed", "id", "1D confidence", "'' type", "'' via", "0 depth")
    return out.withColumn("risk", risk_level(F.col("depth"), F.col("confidence")))


def blast_summary(radius: DataFrame) -> DataFrame:
    return radius.groupBy("seed", "risk").agg(F.count("*").alias("n"))


def path_steps(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, min_confidence: float = 0.0, counts: dict[str, int] | None = None) -> DataFrame:
    """(from_id, to_id, step, id, type, confidence): a shortest path along edges for each of ``pairs``; pairs without one are
    absent. ``type`` and ``confidence`` are of the edge into the step's node, ``seed`` and 1 at the start.

    Levels go forward from all starts and backward from all ends, by turns, until they meet, so no level is deeper than half
    the path, and only from those whose pairs aren't all joined. Levels hold one edge for each node they reach: the most
    confident, then the type, then the id of the node it comes from. A path of n hops goes over the node of smallest id of
    those that are n // 2 hops from its start. A start that is its own end has a path of no hops. ``counts`` takes how many
    ``nodes`` the levels have, and ``edges`` at them.
    """
    spark, work = edges.sparkSession, Work(edges.sparkSession, "paths")
    edges = edges.where(F.col("confidence") >= min_confidence).select("from_id", "to_id", "type", "confidence")
    left = work.save(pairs.select("from_id", "to_id").distinct(), "pairs")
    ahead = {"root": "from_id", "here": "from_id", "next": "to_id", "levels": [], "name": "forward"}
    back = {"root": "to_id", "here": "to_id", "next": "from_id", "levels": [], "name": "backward"}
    for side in (ahead, back):
        first = left.select(F.col(side["root"]).alias("root")).distinct().select("root", F.col("root").alias("id"), F.lit("seed").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("via"))
        side["levels"].append(work.save(first, f"{side['name']}-0"))
        side["visited"] = side["levels"][0].select("root", "id")

    def grow(side: dict) -> None:
        still = left.select(F.col(side["root"]).alias("root")).distinct()
        at = side["levels"][-1].select("root", "id").join(still, "root", "left_semi")
        step = at.join(edges, F.col("id") == F.col(side["here"])).select("root", F.col(side["next"]).alias("id"), "type", "confidence", F.col(side["here"]).alias("via"))
        step = _one_edge(step.join(side["visited"], ["root", "id"], "left_anti"), "root", "id")
        side["levels"].append(work.save(step, f"{side['name']}-{len(side['levels'])}"))
        side["visited"] = side["visited"].unionByName(side["levels"][-1].select("root", "id"))

    met: list[tuple[int, DataFrame]] = []
    for hops in range(max_hops + 1):
        if hops:
            grow(back if hops % 2 else ahead)
        one = ahead["levels"][-1].select(F.col("root").alias("from_id"), "id").join(left, "from_id")
        both = one.join(back["levels"][-1].select(F.col("root").alias("to_id"), "id"), ["to_id", "id"])
        found = work.save(both.groupBy("from_id", "to_id").agg(F.min("id").alias("id")), f"met-{hops}")
        if found.isEmpty():
            if hops and (back if hops % 2 else ahead)["levels"][-1].isEmpty():
                break
            continue
        met.append((hops, found))
        left = work.save(left.join(found.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti"), f"left-{hops}")
        if left.isEmpty():
            break
    if counts is not None:
        counts["nodes"] = sum(side["visited"].count() for side in (ahead, back))
        counts["edges"] = sum(level.join(edges, F.col("id") == F.col(side["here"])).count() for side in (ahead, back) for level in (x.select("root", "id") for x in side["levels"][:-1]))

    out = [spark.createDataFrame([], "from_id string, to_id string, step int, id string, type string, confidence double")]
    edge = lambda level, root: level.select(F.col("root").alias(root), "id", "type", "confidence", "via")
    for hops, found in met:
        middle = hops // 2
        at = found
        for step in range(middle, -1, -1):  # from the middle to the start: each node's edge leads into it
            at = work.save(at.join(edge(ahead["levels"][step], "from_id"), ["from_id", "id"]), f"to-start-{hops}-{step}")
            out.append(at.select("from_id", "to_id", F.lit(step).alias("step"), "id", "type", "confidence"))
            at = at.select("from_id", "to_id", F.col("via").alias("id"))
        at = found
        for step in range(middle, hops):  # and to the end: each node's edge leads on
            at = work.save(at.join(edge(back["levels"][hops - step], "to_id"), ["to_id", "id"]), f"to-end-{hops}-{step}")
            at = at.select("from_id", "to_id", F.col("via").alias("id"), "type", "confidence")
            out.append(at.select("from_id", "to_id", F.lit(step + 1).alias("step"), "id", "type", "confidence"))
            at = at.select("from_id", "to_id", "id")
    return reduce(DataFrame.unionByName, out)


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = 4, min_confidence: float = 0.0) -> DataFrame:
    """(from_id, to_id, hops, path): the paths of ``path_steps``, their ids joined by ``>``."""
    steps = path_steps(edges, pairs, max_hops, min_confidence).groupBy("from_id", "to_id")
    found = steps.agg(F.max("step").alias("hops"), F.array_sort(F.collect_list(F.struct("step", "id"))).alias("ids"))  # max_hops + 1 at most
    return found.select("from_id", "to_id", "hops", F.array_join(F.col("ids.id"), ">").alias("path"))


def supertype_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sub, sup): qualified names at both ends of EXTENDS and IMPLEMENTS edges, typed ones included."""
    e = edges.where(F.regexp_replace("type", "_TYPED$", "").isin("EXTENDS", "IMPLEMENTS")).select("from_id", "to_id")
    a = nodes.select(F.col("id").alias("from_id"), F.col("qualified_name").alias("sub"))
    b = nodes.select(F.col("id").alias("to_id"), F.col("qualified_name").alias("sup"))
    return e.join(a, "from_id").join(b, "to_id").select("sub", "sup")


def ancestors(supertypes: DataFrame) -> DataFrame:
    """(type, ancestor, dist) of ``supertypes`` (sub, sup): each type itself at 0, and each supertype at its least distance.

    Goes on until a level is empty, however long the chains are; the least distance decides in a cycle. Each level is written,
    so the next one's plan is short.
    """
    work = Work(supertypes.sparkSession, "ancestors")
    pairs = work.save(supertypes.select("sub", "sup").distinct(), "pairs")
    types = pairs.select(F.col("sub").alias("type")).unionByName(pairs.select(F.col("sup").alias("type"))).distinct()
    level = types.select("type", F.col("type").alias("ancestor"))
    out, dist = level.withColumn("dist", F.lit(0)), 0
    while True:
        dist += 1
        step = level.join(pairs, F.col("ancestor") == F.col("sub")).select("type", F.col("sup").alias("ancestor")).distinct()
        level = work.save(step.join(out.select("type", "ancestor"), ["type", "ancestor"], "left_anti"), str(dist))
        if level.isEmpty():
            return out
        out = out.unionByName(level.withColumn("dist", F.lit(dist)))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, hops: int = 2, damping: float = 0.85, least: float = 1e-4, min_confidence: float = 0.5) -> DataFrame:
    """(id, score): weights of ``seeds`` (id, weight) spread over edges in both directions for ``hops`` rounds.

    Each edge passes on its confidence's share of the weight, damped; shares under ``least`` are dropped edge by edge. Weight
    may flow back, and nothing is normalised.
    """
    work = Work(edges.sparkSession, "rank")
    edges = edges.where(F.col("confidence") >= min_confidence)
    both = edges.select(F.col("from_id").alias("at"), F.col("to_id").alias("next"), "confidence")
    both = both.unionByName(edges.select(F.col("to_id").alias("at"), F.col("from_id").alias("next"), "confidence"))
    frontier = work.save(seeds.groupBy("id").agg(F.sum("weight").alias("weight")), "0")
    parts = [frontier]
    for hop in range(1, hops + 1):
        share = F.col("weight") * F.col("confidence") * damping
        step = frontier.join(both, F.col("id") == F.col("at")).select(F.col("next").alias("id"), share.alias("weight")).where(F.col("weight") >= least)
        frontier = work.save(step.groupBy("id").agg(F.sum("weight").alias("weight")), str(hop))
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("weight").alias("score"))
