"""Recall of operators 5 and 9 against brute force over whole tables: python tests/llm/measure_recall.py FOLDER..."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", ".."))
from codeloom.llm.common import union_labels  # noqa: E402


def links_recall(x: np.ndarray, found: np.ndarray, cosine: float = 0.95) -> tuple[int, float, np.ndarray]:
    """(links, share of them in the counts ``found``, smallest row that each row reaches); no row has more than there are."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs, n = [], np.zeros(len(u), dtype=np.int64)
    for at in range(0, len(u), 1000):
        hit = u[at : at + 1000] @ u.T >= cosine
        hit[np.arange(len(hit)), at + np.arange(len(hit))] = False
        n[at : at + 1000] = hit.sum(axis=1)
        pairs.append(np.argwhere(hit) + [at, 0])
    assert (found <= n).all()
    return int(n.sum()), float(found.sum() / max(n.sum(), 1)), union_labels(len(u), *np.concatenate(pairs).T)


def neighbours_recall(x: np.ndarray, found: dict[int, list[int]], k: int = 20) -> float:
    """Share of the ``k`` best inner products of each query row that are among those found."""
    hit = total = 0
    queries = sorted(found)
    for at in range(0, len(queries), 500):
        own = queries[at : at + 500]
        s = x[own] @ x.T
        s[np.arange(len(own)), own] = -np.inf
        best = min(k, len(x) - 1)
        least = np.partition(s, -best, axis=1)[:, -best]
        for row, low, q in zip(s, least, own, strict=True):
            hit += min(best, sum(row[v] >= low - 1e-9 for v in found[q]))
            total += best
    return hit / max(total, 1)


def main() -> None:
    from pyspark.sql import SparkSession

    from codeloom.llm.embedding_dedup import op5_embedding_dedup
    from codeloom.llm.neighbours import op9_neighbours

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "12").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
        x, at = np.array([r.embedding for r in rows], dtype=np.float64), {r.vec_id: k for k, r in enumerate(rows)}
        links, recall, label = links_recall(x, np.array([r.n_links for r in op5_embedding_dedup(spark, folder).orderBy("vec_id").collect()]))
        print(f"{folder}: op5 found {recall:.5f} of {links} links", flush=True)
        found: dict[int, list[int]] = {}
        for r in op9_neighbours(spark, folder).collect():
            found.setdefault(at[r.query_id], []).append(at[r.vec_id])
        print(f"{folder}: op9 found {neighbours_recall(x, found):.4f} of the neighbours of {len(found)} queries", flush=True)


if __name__ == "__main__":
    main()
