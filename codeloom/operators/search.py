"""Full-text retrieval: stored postings, BM25 over term prefixes, exact hits, and the blend with PageRank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import search_terms
from codeloom.functions.scores import blended
from codeloom.operators.graph import personalised_pagerank
from codeloom.work import Work

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: The largest character: a prefix and it bound the terms that begin with the prefix.
LAST = "\U0010ffff"


def query_terms(query: str) -> list[str]:
    """Distinct lower-case terms of a query, in its order."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def node_text(nodes: DataFrame) -> Column:
    """What of a node is searched."""
    return F.concat_ws(" ", "simple_name", "qualified_name", *(["signature"] if "signature" in nodes.columns else []))


def postings(docs: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(id, term, tf, length): how often each document has each term."""
    terms = docs.select(F.col(key).alias("id"), search_terms(F.coalesce(text, F.lit(""))).alias("terms"))
    each = terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    return each.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))


def index(docs: DataFrame, text: Column, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The postings, sorted by term in ranges of it, and one row (n, mean) of documents and their mean length.

    In files sorted by term a reader of a few prefixes skips all row groups but those that may hold them.
    """
    rows = postings(docs, text, key).select("term", "id", F.col("tf").cast("int").alias("tf"), "length")
    length = docs.select(F.size(search_terms(F.coalesce(text, F.lit("")))).alias("length"))
    return rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), length.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def _scored(counted: DataFrame, totals: DataFrame, prefixes: list[str]) -> DataFrame:
    """(id, bm25) of ``counted`` (id, length, f0, f1, ..), a written table; ``totals`` is one row (n, mean)."""
    hit = counted.where(F.greatest(*(F.col(f"f{k}") for k in range(len(prefixes))), F.lit(0)) > 0)
    having = hit.agg(*(F.count_if(F.col(f"f{k}") > 0).alias(f"n{k}") for k in range(len(prefixes))))
    score = F.lit(0.0)
    for k in range(len(prefixes)):
        f, df = F.col(f"f{k}"), F.col(f"n{k}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf > 0, idf).otherwise(LEAST_IDF)
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0)
    one = totals.crossJoin(having)  # one row each
    return hit.crossJoin(F.broadcast(one)).select("id", score.alias("bm25"))


def bm25(docs: DataFrame, text: Column, query: str, key: str = "id") -> DataFrame:
    """(id, bm25) of the documents that have a term that begins with one of the query's; for texts without stored postings.

    Each prefix counts as one phrase: its frequency in a document is that of all terms that begin with it. The text is read
    once, and what is written of it are counts of the few prefixes: a row a document.
    """
    prefixes = query_terms(query)
    if not prefixes:
        return docs.select(F.col(key).alias("id"), F.lit(0.0).alias("bm25")).limit(0)
    terms = docs.select(F.col(key).alias("id"), search_terms(F.coalesce(text, F.lit(""))).alias("terms"))
    having = lambda p: F.size(F.filter("terms", lambda t: t.startswith(p)))
    counts = [having(p).alias(f"f{k}") for k, p in enumerate(prefixes)]
    counted = Work(docs.sparkSession, "bm25").save(terms.select("id", F.size("terms").alias("length"), *counts), "counted")
    return _scored(counted, counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean")), prefixes)


def bm25_of_postings(stored: DataFrame, totals: DataFrame, query: str) -> DataFrame:
    """The same from stored postings (term, id, tf, length) and their totals: only the prefixes' ranges of terms are read."""
    prefixes = query_terms(query)
    if not prefixes:
        return stored.select("id", F.lit(0.0).alias("bm25")).limit(0)
    begins = [(F.col("term") >= p) & (F.col("term") < p + LAST) for p in prefixes]
    some = begins[0]
    for b in begins[1:]:
        some = some | b
    counts = [F.sum(F.when(b, F.col("tf")).otherwise(0)).cast("int").alias(f"f{k}") for k, b in enumerate(begins)]
    counted = Work(stored.sparkSession, "bm25").save(stored.where(some).groupBy("id", "length").agg(*counts), "counted")
    return _scored(counted, totals, prefixes)


def exact_hits(nodes: DataFrame, query: str) -> DataFrame:
    """(id, bm25): nodes named by the whole query, scored 1."""
    q = query.strip()
    return nodes.where((F.col("qualified_name") == q) | (F.col("simple_name") == q)).select("id", F.lit(1.0).alias("bm25"))


def hybrid(
    nodes: DataFrame, edges: DataFrame, query: str, k: int = 20, depth: int = 2, min_confidence: float = 0.5, stored: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """(id, score, bm25, pagerank): the ``k`` best text hits, three fifths text score and two fifths PageRank.

    Text hits are the best max(50, 3k) by BM25 and all exact ones, the larger score of both; the hits seed the PageRank with
    their share of the largest, and it ranks hits only. Both scores are shares of their maximum. ``stored`` are the nodes'
    postings and totals; without them the nodes' texts are read.
    """
    work = Work(nodes.sparkSession, "hybrid")
    text = bm25_of_postings(*stored, query) if stored else bm25(nodes, node_text(nodes), query)
    text = text.orderBy(F.desc("bm25"), "id").limit(max(50, 3 * k))
    hits = work.save(text.unionByName(exact_hits(nodes, query)).groupBy("id").agg(F.max("bm25").alias("bm25")), "hits")
    top = hits.agg(F.max("bm25").alias("top"))
    seeds = hits.crossJoin(F.broadcast(top)).select("id", "bm25", (F.col("bm25") / F.coalesce(F.nullif("top", F.lit(0.0)), F.lit(1.0))).alias("weight"))
    rank = personalised_pagerank(edges, seeds.select("id", "weight"), depth, min_confidence=min_confidence)
    found = work.save(seeds.join(rank, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0))), "found")
    most = found.agg(F.max("score").alias("most"))
    share = F.col("score") / F.coalesce(F.nullif("most", F.lit(0.0)), F.lit(1.0))
    out = found.crossJoin(F.broadcast(most)).select("id", blended(F.col("weight"), share).alias("score"), "bm25", share.alias("pagerank"))
    return out.orderBy(F.desc("score"), "id").limit(k)


def literal_matches(docs: DataFrame, text: Column, needle: str, key: str = "id") -> DataFrame:
    """(id, line, tokens): lines that hold the needle as it stands, numbered from 1, with their token estimate."""
    lines = docs.select(F.col(key).alias("id"), F.posexplode(F.split(text, "\n")).alias("at", "text"))
    hit = lines.where(F.col("text").contains(needle))
    return hit.select("id", (F.col("at") + 1).alias("line"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("int").alias("tokens"))
