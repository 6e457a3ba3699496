import measure_recall
import numpy as np
from pyspark.sql import functions as F

from codeloom.llm import embedding_dedup, neighbours
from codeloom.llm.common import union_labels

SCHEMA = "vec_id long, embedding array<float>, label int, cls string, size int"


def _frame(spark, x, extra=()):
    rows = [(i, None if v is None else [None if e is None else float(e) for e in v], 1, "c", None) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)


def _clusters(seed=0, n=600, d=24):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[100:400] = x[100] + 0.04 * r.normal(size=(300, d))  # a large group of near copies
    x[400:420] = x[400] * np.linspace(1, 3, 20)[:, None]
    x[420:500] = x[420]  # exact copies
    return x.astype(np.float32).astype(np.float64)


def test_links_equal_brute_force(spark, monkeypatch):
    x = _clusters()
    monkeypatch.setattr(embedding_dedup, "CHUNK", 64)
    rows = embedding_dedup.near_duplicates(_frame(spark, x)).orderBy("vec_id").collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert sum(r.n_links for r in rows) >= 0.995 * hit.sum()
    assert all(r.n_links <= n for r, n in zip(rows, hit.sum(axis=1), strict=True))
    label = union_labels(len(x), *np.nonzero(hit))
    assert [r.component_id for r in rows] == label.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)


def test_tables_suffice_for_a_long_mean():
    r = np.random.default_rng(7)
    for length in (0.0, 0.8, 0.9, 0.99):
        x = r.normal(size=(6000, 32))
        x = embedding_dedup.valid_unit(x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(1 - length**2) + length * np.eye(32)[0])
        coder = embedding_dedup.coding(x[:3000], 20_000, 0.95, 5)
        own, aside = x[3000:], r.normal(size=(3000, 32))
        aside = embedding_dedup.valid_unit(aside - (aside * own).sum(axis=1, keepdims=True) * own)
        code = [coder.code(v) for v in (own, 0.95 * own + np.sqrt(1 - 0.95**2) * aside)]
        assert (coder.keys(code[0]) == coder.keys(code[1])).any(axis=1).mean() >= 0.995
        assert (np.bitwise_count(coder.words(code[0]) ^ coder.words(code[1])).sum(axis=1) <= coder.radius).mean() >= 0.999


def test_recall_of_links_on_a_whole_table(spark, sf):
    """The whole table and near copies of every tenth vector, at the threshold and above it, against brute force."""
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()], dtype=np.float64)
    r = np.random.default_rng(3)
    copies = []
    for v in x[::10]:
        for cosine in r.uniform(0.93, 1, 4):
            aside = r.normal(size=len(v))
            aside -= aside @ v / (v @ v) * v
            copies.append(cosine * v + np.sqrt(1 - cosine**2) * np.linalg.norm(v) * aside / np.linalg.norm(aside))
    x = np.concatenate([x, copies]).astype(np.float32).astype(np.float64)
    rows = embedding_dedup.near_duplicates(_frame(spark, x)).orderBy("vec_id").collect()
    links, recall, label = measure_recall.links_recall(x, np.array([r.n_links for r in rows]))
    assert links > 100 and recall >= 0.995
    assert np.mean([r.component_id == k for r, k in zip(rows, label.tolist(), strict=True)]) >= 0.995


def test_repeated_query_rows(spark):
    x = np.random.default_rng(8).normal(size=(60, 8))
    one = neighbours.search(_frame(spark, x), F.col("vec_id") == 0).orderBy("rank").collect()
    again = [(0, [float(e) for e in x[0]], 1, "c", None)] * 2
    many = neighbours.search(_frame(spark, x, again), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [tuple(r) for r in many] == [tuple(r) for r in one] and len({r.vec_id for r in many}) == 20
    other = neighbours.search(_frame(spark, x, [*again, (0, [float(-e) for e in x[0]], 1, "c", None)]), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in other) == sorted([*range(1, 21)] * 2) and {tuple(r) for r in one} <= {tuple(r) for r in other}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [0, 0, 0], [nan, 1, 2], [inf, 1, 2], [None, 1, 2], [], [1, 2, 3], [2, 4, 6], [1, 2, 3, 4], [1, 2, 3], [-0.0, 0, 1], [0.0, 0, 1]]
    df = _frame(spark, odd, [(9, [1.0, 2.0, 3.0], 1, "c", 0), (None, [1.0, 2.0, 3.0], None, None, None)])
    rows = embedding_dedup.near_duplicates(df).collect()
    assert len(rows) == 14
    by = {r.vec_id: r for r in rows}
    assert all(by[k].n_links == 0 and by[k].component_id == k for k in (0, 1, 2, 3, 4, 5, 8))
    assert by[6].n_links == 4 and {by[k].component_id for k in (6, 7, 9, None)} == {6}
    assert by[10].n_links == 1 and by[11].component_id == 10
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    found = neighbours.search(df, F.col("vec_id").isin(0, 6, 8), k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(6, 1, 7), (6, 2, 9), (6, 3, 9)]
    assert neighbours.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall_and_ties(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CHUNK_BYTES", 100 * 8 * 16)
    r = np.random.default_rng(1)
    x = np.concatenate([c + r.normal(size=(600, 16)) for c in 6 * r.normal(size=(5, 16))])
    x[50:90] = x[50]
    x = x.astype(np.float32).astype(np.float64)
    found = neighbours.search(_frame(spark, x), F.col("vec_id") % 20 == 0, k=10).collect()
    by = {}
    for f in found:
        by.setdefault(f.query_id, {})[f.rank] = (f.vec_id, f.score)
    hit = 0
    for q, got in by.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[:10]
        hit += len({v for v, _ in got.values()} & set(want.tolist()))
        assert sorted(got) == list(range(1, 11)) and all(abs(s[v] - c) < 1e-9 for v, c in got.values())
        ordered = [got[k] for k in sorted(got)]
        assert ordered == sorted(ordered, key=lambda p: (-p[1], p[0]))
    assert len(by) == 150 and hit >= 0.93 * 1500


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(1500, 8))
    part = neighbours.balanced_parts(x, neighbours.neighbour_graph(x, 8), 6)
    assert np.bincount(part, minlength=6).max() <= np.ceil(neighbours.SLACK * 1500 / 6)


def test_parts_of_parts(spark, monkeypatch):
    """Parts that are too large are cut again, twice, and recall holds; few of the rows are read."""
    for name, value in (("LEAF", 300), ("SAMPLE", 1500), ("PARTS", [2, 4, 8])):
        monkeypatch.setattr(neighbours, name, value)
    r = np.random.default_rng(4)
    x = np.concatenate([c + 0.3 * r.normal(size=(200, 12)) for c in 4 * r.normal(size=(30, 12))])
    x[100:1200] = x[100]  # a part that cannot be cut
    x = x.astype(np.float32).astype(np.float64)
    found = {}
    for f in neighbours.search(_frame(spark, x), F.col("vec_id") % 20 == 0, k=10).collect():
        found.setdefault(f.query_id, []).append(f.vec_id)
    assert len(found) == 300 and all(len(set(v)) == 10 for v in found.values())
    assert measure_recall.neighbours_recall(x, found, 10) >= 0.9


def test_router_at_every_size():
    """From 128 vectors on there are parts, and the recall that is aimed at holds for queries that were held out."""
    r = np.random.default_rng(6)
    assert len(neighbours.learn(r.normal(size=(127, 8)), 127, 20).b2) == 1
    for n in (150, 600, 4000):
        x = np.concatenate([c + 0.5 * r.normal(size=(n // 10, 8)) for c in 4 * r.normal(size=(10, 8))])
        fresh = x[r.permutation(len(x))[:200]] + 0.1 * r.normal(size=(min(200, len(x)), 8))
        router = neighbours.learn(x, n, 20)
        assert len(router.b2) > 1
        true = np.argpartition(-(fresh @ x.T), 19, axis=1)[:, :20]
        at = router.logits(x).argmax(axis=1)
        assert np.mean([np.isin(at[t], p).mean() for t, p in zip(true, router.probed(fresh), strict=True)]) >= 0.9


def test_op5_and_op9(spark, sf):
    """Both queries over the whole table against brute force."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x, at = np.array([r.embedding for r in e], dtype=np.float64), {r.vec_id: k for k, r in enumerate(e)}
    rows = neighbours.op9_neighbours(spark, sf).collect()
    assert len(rows) == 20 * sum(r.vec_id % 20 == 0 for r in e) and len({(r.query_id, r["rank"]) for r in rows}) == len(rows)
    assert all(abs(x[at[r.query_id]] @ x[at[r.vec_id]] - r.score) < 1e-9 and r.query_id != r.vec_id for r in rows)
    found, last = {}, {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(at[r.query_id], []).append(at[r.vec_id])
        now = (-r.score, r.vec_id)
        assert last.get(r.query_id, (-np.inf, 0)) < now
        last[r.query_id] = now
    assert measure_recall.neighbours_recall(x, found) >= 0.9
    got = embedding_dedup.op5_embedding_dedup(spark, sf).orderBy("vec_id").collect()
    links, recall, label = measure_recall.links_recall(x, np.array([r.n_links for r in got]))
    assert len(got) == len(e) and recall >= 0.99 * (links > 0)
    assert np.mean([r.component_id == e[k].vec_id and r.kept == (r.vec_id == r.component_id) for r, k in zip(got, label.tolist(), strict=True)]) >= 0.99
