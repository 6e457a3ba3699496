"""Operator 9: nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` vectors, ``SAMPLE_BYTES`` at most) the graph of each vector's nearest neighbours is cut into
balanced parts: splits along principal directions give equal parts, and rounds of moves to the part that most neighbours
are in lower the cut while no part exceeds its capacity. A small network learns, from a vector, the shares of its
neighbours' parts, and its outputs are shifted until its first choices keep to the capacity too. Every row of the table is
indexed under its most probable part; a query is routed to its most probable parts, and all rows there are ranked by the
inner product of the original vectors in double precision. Of several numbers of parts the one is taken with which a query
costs least (rows read, and copies of it); the number of parts probed is the least whose recall, measured against brute force on an eighth of
the sample that neither the graph nor the network has seen, reaches ``TARGET``.

Parts grow in number with the table: a part of over ``LEAF`` rows is cut again in the same way, from a sample of its own
rows, by a task for each such part, for up to ``LEVELS`` levels (as long as all routers of a level have ``ROUTER_BYTES`` at
most, which is checked, as they are broadcast). At the defaults that is some 250,000 parts of 65,536 rows.

What is left of large parts, such as copies of one vector, is dealt in chunks of ``CHUNK_BYTES`` by hash, so no part is
gathered in one task; queries stream past a chunk, and a query is copied to a part once for each chunk. A query's best of
each chunk are merged, at most ``k`` of each. Equal vectors have equal scores: candidates near the last place are ranked
again by sums in one fixed order, and ties go to the smaller vec_id.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows of null vec_id;
vectors of other lengths are searched among their own; a table of fewer than ``2 * ROWS_A_PART`` vectors is one part; rows of
equal vec_id are candidates one by one, but never for a query of that vec_id; query rows of equal vec_id and vector are one
query, those of other vectors have a list each; fewer than ``k`` candidates give all of them; an empty table gives no rows;
only vec_id and embedding are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import Scratch, group_ends, n_partitions, whole_groups

SAMPLE, SAMPLE_BYTES, GRAPH_K, ROWS_A_PART, TARGET, HIDDEN, SLACK = 8192, 64 << 20, 16, 64, 0.95, 32, 1.25
LEAF, LEVELS, ROUTER_BYTES, CHUNK_BYTES = 1 << 16, 3, 64 << 20, 16 << 20
#: Rows whose reading costs as much as one more copy of a query.
PROBE_ROWS = 100
#: Numbers of parts that are tried; a part's number is its parent's times ``FAN`` and its own.
PARTS, FAN = [2, 4, 5, 6, 8, 12, 16, 32, 64], 64


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the ``k`` largest inner products of each row, itself left out."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out.append(np.argpartition(-s, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, n: int, rounds: int = 12, slack: float = SLACK) -> np.ndarray:
    """A part in 0 .. n - 1 of each row: splits into equal parts, then moves that lower the cut within the capacity."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, n)]
    while todo:
        own, first, k = todo.pop()
        if k == 1:
            part[own] = first
            continue
        c = x[own] - x[own].mean(axis=0)
        order = own[np.argsort(c @ np.linalg.eigh(c.T @ c)[1][:, -1], kind="stable")]
        cut = len(own) * (k // 2) // k
        todo += [(order[:cut], first, k // 2), (order[cut:], first + k // 2, k - k // 2)]
    capacity, size = int(np.ceil(slack * len(x) / n)), np.bincount(part, minlength=n)
    for _ in range(rounds):
        votes = np.zeros((len(x), n), dtype=np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph].ravel()), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < capacity:
                size[part[i]] -= 1
                size[best[i]] += 1
                part[i] = best[i]
    return part


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def probed(self, x: np.ndarray) -> np.ndarray:
        """[row, choice]: the parts to probe, most probable first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, : self.probes]


def learn_router(x: np.ndarray, share: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.02, seed: int = 3) -> Router:
    """A network of one hidden layer, by gradient descent (Adam) on the cross entropy with the neighbours' shares."""
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt((x**2).sum(axis=1).mean())
    p = [rng.normal(0, scale, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, share.shape[1])), np.zeros(share.shape[1])]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, steps + 1):
        own = rng.integers(0, len(x), batch)
        h = np.tanh(x[own] @ p[0] + p[1])
        z = h @ p[2] + p[3]
        q = np.exp(z - z.max(axis=1, keepdims=True))
        dz = (q / q.sum(axis=1, keepdims=True) - share[own]) / batch
        dh = dz @ p[2].T * (1 - h**2)
        for k, g in enumerate((x[own].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            p[k] -= rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Router(*p)


def balance(router: Router, x: np.ndarray, slack: float = SLACK, rounds: int = 200) -> None:
    """Lower the logits of the parts that are the first choice of too many of the sample's rows, until none is."""
    n = len(router.b2)
    z = router.logits(x)
    shift, rate = np.zeros(n), 0.2 * z.std()
    for k in range(rounds):
        over = np.log((np.bincount((z + shift).argmax(axis=1), minlength=n) + 1) / (slack * len(x) / n))
        if over.max() <= 0:
            break
        shift -= rate * (1 - k / rounds) * np.maximum(over, 0)
    router.b2 = router.b2 + shift


def learn(x: np.ndarray, n: int, k: int) -> Router:
    """The router for ``n`` rows from a sample of them.

    Of several numbers of parts the one is taken with which held-out queries reach the target at the least cost: the rows
    that are read for a query, and ``PROBE_ROWS`` for each part that it is copied to.
    """
    d = x.shape[1]
    best, cost = Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), np.inf
    order = np.random.default_rng(0).permutation(len(x))
    test, x = x[order[: len(x) // 8]][:1024], x[order[len(x) // 8 :]]
    near = min(GRAPH_K, len(x) // 8)
    parts = [p for p in PARTS if p * ROWS_A_PART <= n and 4 * p * near <= len(x) and p <= FAN]
    if not parts or not near or not len(test):
        return best
    k = min(k, len(x))
    graph = neighbour_graph(x, near)
    true = np.argpartition(-(test @ x.T), k - 1, axis=1)[:, :k]
    for p in parts:
        part = balanced_parts(x, graph, p)
        share = np.zeros((len(x), p))
        np.add.at(share, (np.repeat(np.arange(len(x)), near), part[graph].ravel()), 1 / (near + 1))
        share[np.arange(len(x)), part] += 1 / (near + 1)
        own = learn_router(x, share)
        balance(own, x)
        at = own.logits(x).argmax(axis=1)
        order = np.argsort(-own.logits(test), axis=1, kind="stable")
        need = np.sort(np.take_along_axis(np.argsort(order, axis=1), at[true], axis=1).ravel())
        own.probes = int(need[int(np.ceil(TARGET * len(need))) - 1]) + 1
        share = np.bincount(at, minlength=p)[order[:, : own.probes]].sum() / (len(test) * len(x))
        rows = share * n + own.probes * PROBE_ROWS
        if rows < cost:
            best, cost = own, rows
    return best


def best_of(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, scores) of its ``k`` nearest rows, nearest first, ties to smaller ids."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None]] = -np.inf
    last = np.partition(s, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(q), -np.inf)
    slack = 1e-9 * np.sqrt((q**2).sum(axis=1) * (x**2).sum(axis=1).max())
    for row, low, one, tol in zip(s, last, q, slack, strict=True):
        at = np.flatnonzero((row >= low - tol) & (row > -np.inf))
        score = (x[at] * one).sum(axis=1)
        order = np.lexsort((ids[at], -score))[:k]
        yield ids[at][order], score[order]


def _valid(v: str) -> Column:
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda e: e != 0), F.lit(False)) & F.col("vec_id").isNotNull()


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each query, all rows being indexed."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    element = vectors.schema["embedding"].dataType
    kind = "float" if isinstance(element, T.ArrayType) and isinstance(element.elementType, T.FloatType) else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(_valid("v"))
    found = None
    for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect():  # lengths in use: one, as a rule
        one = _search(rows.where(F.size("v") == r.d), r.d, r.n, k, scratch, "<f4" if kind == "float" else "<f8")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found.groupBy("query_id", "q").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    best = best.select("query_id", F.posexplode("best").alias("at", "b"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))


_ROUTED = "vec_id long, v binary, part long, probed array<long>"


def _vectors(column: pa.Array | pa.ChunkedArray, d: int, kind: str) -> np.ndarray:
    """Rows of binary vectors in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, d).astype(np.float64)


def _refined(routed: DataFrame, routers: dict[int, Router], d: int, kind: str) -> DataFrame:
    """Rows and queries of the parts that have a router, moved on to its parts; others to the only part of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                x, part = _vectors(b.column(1), d, kind), b.column(2).to_numpy()
                new = part * FAN
                for p in set(part.tolist()) & routers.keys():
                    own = np.flatnonzero(part == p)
                    new[own] += routers[p].logits(x[own]).argmax(axis=1)
                asked = b.column(3).to_pylist()
                row = np.repeat(np.arange(len(asked)), [len(a or ()) for a in asked])
                old = np.array([p for a in asked for p in a or ()], dtype=np.int64)
                rows, parts = [], []
                for p in set(old.tolist()):
                    own = row[old == p]
                    to = routers[p].probed(x[own]) if p in routers else np.zeros((len(own), 1), dtype=np.int64)
                    rows.append(np.repeat(own, to.shape[1]))
                    parts.append((to + p * FAN).ravel())
                more: list[list | None] = [None if a is None else [] for a in asked]
                for r, p in zip(np.concatenate(rows or [row]).tolist(), np.concatenate(parts or [old]).tolist(), strict=True):
                    more[r].append(p)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new), pa.array(more, pa.list_(pa.int64()))], names=["vec_id", "v", "part", "probed"])

    return routed.mapInArrow(run, _ROUTED)


def _routers(routed: DataFrame, large: DataFrame, d: int, k: int, kind: str, level: int) -> DataFrame:
    """(part, router) of the parts ``large`` (part, count), each from a sample of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part"], SAMPLE):
            begin = 0
            for end in group_ends(table.column("part").to_numpy()).tolist():
                own = table.slice(begin, end - begin)
                router = learn(_vectors(own.column("v"), d, kind)[:SAMPLE], own.column("count")[0].as_py(), k)
                yield pa.RecordBatch.from_arrays([own.column("part").slice(0, 1).combine_chunks(), pa.array([pickle.dumps(router)])], names=["part", "router"])
                begin = end

    some = routed.select("part", "v").join(F.broadcast(large), "part").where(F.rand(level) < SAMPLE / F.col("count"))
    return some.repartition(n_partitions(routed.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, "part long, router binary")


def _search(rows: DataFrame, d: int, n: int, k: int, scratch: Scratch, kind: str) -> DataFrame:
    spark = rows.sparkSession
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * d)))
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").toArrow()
    top = learn(sample.column(0).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, d), n, k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                flat = b.column(1).flatten().to_numpy()
                x = flat.astype(np.float64).reshape(-1, d)
                raw, size = flat.astype(kind).tobytes(), np.dtype(kind).itemsize * d
                raw = pa.array([raw[a : a + size] for a in range(0, len(raw), size)], pa.binary())
                probed = [o if q else None for o, q in zip(top.probed(x).tolist(), b.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), raw, pa.array(top.logits(x).argmax(axis=1)), pa.array(probed, pa.list_(pa.int64()))], names=["vec_id", "v", "part", "probed"])

    routed = scratch.save(rows.mapInArrow(route, _ROUTED), f"routed-{d}-0")
    counts = scratch.save(routed.groupBy("part").count(), f"counts-{d}-0")
    for level in range(1, LEVELS):
        large = counts.where(F.col("count") > LEAF)
        if large.isEmpty():
            break
        learned = scratch.save(_routers(routed, large, d, k, kind, level), f"routers-{d}-{level}")
        if learned.agg(F.sum(F.octet_length("router"))).first()[0] > ROUTER_BYTES:
            break
        routers = {r.part: pickle.loads(bytes(r.router)) for r in learned.collect()}
        routed = scratch.save(_refined(routed, routers, d, kind), f"routed-{d}-{level}")
        scratch.drop(f"routed-{d}-{level - 1}")
        counts = scratch.save(routed.groupBy("part").count(), f"counts-{d}-{level}")

    rows_a_chunk = max(64, CHUNK_BYTES // (8 * d))
    chunks = F.broadcast(counts.select("part", F.ceil(F.col("count") / rows_a_chunk).cast("int").alias("chunks")))  # a row for each part
    index = routed.select("vec_id", "v", "part").join(chunks, "part")
    index = index.select("vec_id", "v", "part", F.pmod(F.xxhash64("vec_id", F.lit(9)), "chunks").cast("int").alias("chunk"), F.lit(False).alias("query"), F.lit(0).cast("long").alias("q"))
    asked = routed.where("probed is not null").select("vec_id", "v", "probed").dropDuplicates(["vec_id", "v"])
    asked = asked.select("vec_id", "v", F.explode("probed").alias("part")).join(chunks, "part")
    asked = asked.select("vec_id", "v", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("query"), F.xxhash64("v").alias("q"))
    both = index.unionByName(asked).repartition(n_partitions(spark), "part", "chunk").sortWithinPartitions("part", "chunk", "query")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held_ids, held = None, [], []
        struct = pa.list_(pa.struct([("minus", pa.float64()), ("vec_id", pa.int64())]))
        for b in batches:
            ids, part, chunk, query, q = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 2, 3, 4, 5))
            v = _vectors(b.column(1), d, kind)
            begin = 0
            for end in group_ends(part, chunk, query).tolist():
                if at != (part[begin], chunk[begin]):
                    at, held_ids, held = (part[begin], chunk[begin]), [], []
                if not query[begin]:
                    held_ids.append(ids[begin:end])
                    held.append(v[begin:end])
                elif held:
                    held_ids, held = [np.concatenate(held_ids)], [np.concatenate(held)]
                    for lo in range(begin, end, 256):
                        hi = min(end, lo + 256)
                        best = [[{"minus": -x, "vec_id": i} for i, x in zip(i.tolist(), s.tolist(), strict=True)] for i, s in best_of(v[lo:hi], ids[lo:hi], held[0], held_ids[0], k)]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.array(q[lo:hi]), pa.array(best, struct)], names=["query_id", "q", "best"])
                begin = end

    return both.mapInArrow(rank, "query_id long, q long, best array<struct<minus: double, vec_id: long>>")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
