"""Ranking of search hits, ambiguity, and packing of slices into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.names import owner_of, word_parts
from codeloom.functions.scores import cluster_weight, token_estimate
from codeloom.schema import TYPE_KINDS
from codeloom.work import Work


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with each row's place from 1 in an order without ties, as a column ``name``.

    Rows are sorted in ranges of the order, by a task each, and written; a row's place is that in its range and the number of
    rows in the ranges before it. Those numbers, one for each task, are all that comes to the driver.
    """
    spark, work = df.sparkSession, Work(df.sparkSession, "numbered")
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())
    rows = work.save(rows, "rows")
    own, at = F.shiftright(F.col(name), 33), F.col(name).bitwiseAND((1 << 33) - 1)
    before, total = {}, 0
    for r in sorted(rows.groupBy(own.cast("int").alias("p")).count().collect()):
        before[r.p], total = total, total + r["count"]
    if not before:
        return rows.withColumn(name, F.col(name).cast("int"))
    offsets = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return rows.withColumn(name, (offsets[own.cast("int")] + at + 1).cast("int"))


def prioritised(seeds: DataFrame, name: str) -> DataFrame:
    """``seeds`` (id, kind, simple_name, score) with their ``rank``: types of exactly that name first, then by score."""
    exact = F.col("kind").isin(TYPE_KINDS) & (F.col("simple_name") == name)
    return numbered(seeds, "rank", F.when(exact, 0).otherwise(1), F.desc("score"), "id")


def clustered(seeds: DataFrame, query: str) -> DataFrame:
    """``seeds`` (id, kind, qualified_name, score) with ``coverage``, ``cluster`` and ``rank``.

    Owners that cover more of the query's words in their own names come first, then by their best weighted member, then by
    how many members they have; members go by weighted score.
    """
    words = [w.lower() for w in query.split()]
    seeds = seeds.withColumn("owner", owner_of(F.col("qualified_name"))).withColumn("weighted", cluster_weight(F.col("score"), F.col("kind"), F.col("owner")))
    parts = word_parts(F.col("owner"))
    seeds = seeds.withColumn("coverage", sum((F.array_contains(parts, w).cast("int") for w in words), F.lit(0)))
    owners = seeds.groupBy("owner").agg(F.max("coverage").alias("c"), F.max("weighted").alias("best"), F.count("*").alias("members"))
    owners = numbered(owners, "cluster", F.desc("c"), F.desc("best"), F.desc("members"), "owner").select("owner", "cluster")
    return numbered(seeds.join(owners, "owner"), "rank", "cluster", F.desc("weighted"), "id")


def is_ambiguous(hits: DataFrame) -> DataFrame:
    """(name, ambiguous, names, winner) of search hits (name, qualified_name, kind, score) for a bare name.

    A sole type wins over members of its name. Else hits of different qualified names, types only where there are several,
    are ambiguous unless the best scores over one and a half times the next.
    """
    types = F.count_distinct(F.when(F.col("kind").isin(TYPE_KINDS), F.col("qualified_name"))).alias("types")
    hits = hits.join(hits.groupBy("name").agg(types), "name").where((F.col("types") < 2) | F.col("kind").isin(TYPE_KINDS))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "qualified_name")
    hits = hits.withColumns({"next": F.lead("score").over(order), "at": F.row_number().over(order), "type": F.col("kind").isin(TYPE_KINDS).cast("int")})
    out = hits.groupBy("name").agg(
        F.count_distinct("qualified_name").alias("names"),
        F.max("types").alias("types"),
        F.bool_or((F.col("at") == 1) & (F.col("score") > 1.5 * F.col("next"))).alias("clear"),
        F.min_by("qualified_name", F.struct(-F.col("type"), -F.col("score"), "qualified_name")).alias("first"),
    )
    clear = (F.col("types") == 1) | F.coalesce("clear", F.lit(False))
    ambiguous = (F.col("names") > 1) & ~clear
    return out.select("name", ambiguous.alias("ambiguous"), "names", F.when(~ambiguous, F.col("first")).alias("winner"))


def packed(slices: DataFrame, budget: int, group: str) -> DataFrame:
    """``slices`` (group, at, text) that fit whole into a budget of estimated tokens, in order, with the tokens used so far."""
    order = Window.partitionBy(group).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slices.withColumn("tokens", token_estimate(F.col("text")))
    return rows.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget)


def pack_slices(slices: list[dict], budget: int) -> tuple[list[dict], int, int]:
    """The slices of one answer, cut to a token budget; the tokens used; and how many slices were passed over.

    Whole lines stay while they fit; where not even the first does, as much of it as four characters a token allow. A slice
    of over 10 lines of which under a fifth would stay is passed over. Packing ends with the budget, or at an empty slice.
    """
    out, used, skipped = [], 0, 0
    for s in slices:
        left = budget - used
        if left <= 0 or not s["source"]:
            break
        lines, keep, length, cost = s["source"].split("\n"), 0, 0, 0
        for line in lines:
            length += len(line) + (1 if keep else 0)
            now = max(1, length // 4)
            if now > left:
                break
            keep, cost = keep + 1, now
        kept = lines[:keep]
        if not keep:
            kept, cost = [lines[0][: left * 4]], left
        if len(lines) > 10 and len(kept) < 0.2 * len(lines):
            skipped += 1
            continue
        used += cost
        whole = len(kept) == len(lines) and kept[-1] == lines[-1]
        out.append({**s, "source": "\n".join(kept), "truncated": not whole, "span_end": s["span_end"] if whole else s["span_start"] + len(kept) - 1})
    return out, used, skipped
