"""Quality classifier, line dedup, SimHash and the pipeline."""

import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import line_dedup, near_dedup, quality, secrets, simhash
from codeloom.llm.common import Scratch, connected_components, union_labels

# Quality


def _labelled(n, seed=0):
    r = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        words = ["".join(r.choice(list("abcdeinorst"), r.integers(2, 8))) for _ in range(r.integers(5, 200))]
        good = r.random() < 0.8
        texts.append(" ".join(words) + "." if good else " ".join(w + "$$$" for w in words))
        labels.append(float(good))
    return texts, np.array(labels)


def test_classifier_learns():
    texts, labels = _labelled(300)
    model = quality.fit([quality.sample_chunks(t) for t in texts], labels, steps=300)
    fresh, truth = _labelled(200, 1)
    assert ((quality.scores(model, fresh) >= 0.3) == truth).mean() > 0.97
    one = quality.scores(model, ["x", None, "", fresh[0] * 50])
    assert np.all((one >= 0) & (one <= 1)) and one[1] == one[2]
    assert np.allclose(quality.scores(model, fresh[:7]), [quality.scores(model, [t])[0] for t in fresh[:7]])


def test_scores_cover_whole_texts():
    texts, labels = _labelled(200)
    model = quality.fit([quality.sample_chunks(t) for t in texts], labels, steps=200)
    text = "plain words of a text " * 400
    assert quality.scores(model, [text + " bad$$$" * 3000])[0] < quality.scores(model, [text])[0]
    data, _ = quality._padded([text])
    assert np.allclose(quality._block_max(model, data, piece=3), quality._block_max(model, data))


def _plain_score(model, text):
    """Every filter at every second byte of chunks of 512 bytes that overlap by 64: their maxima, a logit of each, its mean."""
    text = text.encode()
    n = -(-(len(text) + quality.WIDTH - 1) // 64)
    raw = np.frombuffer(text.ljust(n * 64 + quality.WIDTH, b"\0"), np.uint8)
    at = np.arange(0, n * 64, 2)
    outputs = np.maximum(sum(model.table[w][raw[at + w]] for w in range(quality.WIDTH)) + model.bias, 0)
    logits = [outputs[first * 32 : min(first + 8, n) * 32].max(axis=0) @ model.weight + model.offset for first in range(0, max(1, n - 1), 7)]
    return 1 / (1 + np.exp(-np.mean(logits)))


def test_convolution_equals_definition():
    r = np.random.default_rng(3)
    shape = (quality.WIDTH, 256, quality.FILTERS)
    model = quality.Model(r.normal(size=shape).astype(np.float32), r.normal(size=quality.FILTERS).astype(np.float32), r.normal(size=quality.FILTERS), 0.1)
    for text in ("some text of a few hundred bytes " * 40, "", "x"):
        assert quality.scores(model, [text])[0] == pytest.approx(_plain_score(model, text), rel=1e-4)


def test_classifier_on_odd_tables(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, None), (None, 1, 0), (7, None, 0), (999, 0, 0), (5, 2, 0)], none.schema)
    for labels in (none, one):
        model = quality.train(odd_docs, labels)
        assert quality.score(odd_docs, model).count() == odd_docs.count()
        kept = quality.keep_good(odd_docs, model)
        assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert quality.train(no_docs, one).constant == 0.5
    assert quality.score(no_docs, model).count() == 0 and quality.keep_good(no_docs, model).count() == 0


def test_op6(spark, sf):
    sf = sf.replace("0.001", "0.01")  # more labelled rows to hold out
    rows = quality.op6_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels and r.held_out]
    assert len(held) > 50 and np.mean([(s >= 0.3) == (q == 1) for s, q in held]) > 0.95
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # held-out rows rank right


def test_scores_of_the_whole_table_equal_the_definition(spark, sf):
    """The query's scores against a plain convolution, chunk by chunk, of the same model."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.op6_quality(spark, sf).collect()}
    for d in docs.collect():
        assert got[d.doc_id] == pytest.approx(_plain_score(model, d.text or ""), rel=1e-3)


def test_hot_ids_keep_the_bound(spark):
    """An id that holds nearly all rows brings no more of them to the driver than the bound."""
    docs = spark.createDataFrame([(1 if k < 900 else k, f"text {k} of some length") for k in range(1000)], "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (950, 0, 0), (951, 0, 0), (952, 0, 0)], "doc_id long, quality int, toxic int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda samples, y: seen.append((len(samples), len(y))) or fit(samples, y, steps=2)
        quality.train(docs, labels, max_rows=50)
    finally:
        quality.fit = fit
    assert seen == [(50, 50)]


# Lines


def _drop(spark, rows, **kw):
    out = line_dedup.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string"), **kw)
    return {r.doc_id: r.text for r in out.collect()}


def test_lines(spark):
    mark = "This site is owned by nobody at all."
    rows = [(k, f"{'abcdefg'[k]} alone\n{mark}\nJob {k}7 done at 10:{k}0 by host-{k}\nend {'tuvwxyz'[k]}") for k in range(5)]
    got = _drop(spark, rows)
    assert got[0] == rows[0][1]
    assert all(got[k] == f"{'abcdefg'[k]} alone\nend {'tuvwxyz'[k]}" for k in range(1, 5))
    assert _drop(spark, rows[:2]) == dict(rows[:2])  # two documents are no recurrence of short lines
    long = " ".join(f"w{'abcdefghijklmnopqrstuvwxyz'[k]}" for k in range(25))
    assert _drop(spark, [(1, f"a\n{long}"), (2, f"{long}\nb")]) == {1: f"a\n{long}", 2: "b"}


def test_variable_fields_without_digits(spark):
    names = ["anna", "bert", "carl", "dora", "emil"]
    rows = [(k, f"Connection from host {n} closed by remote peer now") for k, n in enumerate(names)]
    assert _drop(spark, rows) == {0: rows[0][1], 1: "", 2: "", 3: "", 4: ""}
    prose = [(k, t) for k, t in enumerate(["The end of days came over us slowly", "The end of roads was where we met", "The end of songs leaves a room quiet", "The end of rain and wind brought sun"])]
    assert _drop(spark, prose) == dict(prose)


def test_lines_without_constant_words_recur_by_exact_text_only(spark):
    def one(k):
        return f"{k}1 {k}2 {k}3\n2024-01-0{k}\n| {k}4 | {k}5 |\nx{k}=y{k}\n我们在202{k}年看到了{'甲乙丙丁戊'[k]}的文章\nTotal " + " ".join(str(100 * k + j) for j in range(24))

    rows = [(k, one(k)) for k in range(5)]
    assert _drop(spark, rows) == dict(rows)
    assert _drop(spark, [(k, f"only {'abcd'[k]}\n12 34 56") for k in range(4)]) == {0: "only a\n12 34 56", 1: "only b", 2: "only c", 3: "only d"}
    mixed = [(k, f"{k}1 {k}2 {k}3 {a} {k}4 {k}5 {b} {c} {k}6") for k, (a, b, c) in enumerate([("red", "sea", "sun"), ("old", "oak", "sky"), ("new", "inn", "bay"), ("big", "hut", "dew")])]
    assert _drop(spark, mixed) == dict(mixed)


def test_lines_of_odd_tables(spark, odd_docs, no_docs, rows_of):
    out = line_dedup.drop_recurring(odd_docs)
    assert out.columns == odd_docs.columns and out.dtypes == odd_docs.dtypes
    assert rows_of(out, "doc_id", "text") == rows_of(odd_docs, "doc_id", "text")  # two documents share a short line
    more = odd_docs.unionByName(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    gone = line_dedup.drop_recurring(more).where("doc_id is null and n_chars = 0")
    assert gone.count() == 1 and line_dedup.drop_recurring(more).where("doc_id = 5 and text = ''").count() == 2
    assert line_dedup.drop_recurring(no_docs).count() == 0


def test_names_like_those_of_the_operators(spark, rows_of):
    """Columns named as the operators name theirs are passed on."""
    mark = " ".join("abcdefghijklmnopqrstuvwxyz")
    schema = "doc_id long, text string, gone_raw string, GONE_ID long, gone long, stay_fp long, stay_id long, simhashfp int, near string, leaf int, first int"
    rows = [(k, f"own {'abcd'[k]}\n{mark}", "r", 1, 2, 3, 4, 5, "n", 6, 7) for k in range(4)] + [(None, mark, *[None] * 9)]
    docs = spark.createDataFrame(rows, schema)
    for run, left in ((line_dedup.drop_recurring, 5), (simhash.keep_one, 5), (near_dedup.keep_one, 1)):
        out = run(docs)
        assert out.dtypes == docs.dtypes and out.count() <= left
    out = line_dedup.drop_recurring(docs)
    assert rows_of(out.where("doc_id > 0"), "doc_id", "text", "gone_raw", "GONE_ID") == [(k, f"own {'abcd'[k]}", "r", 1) for k in (1, 2, 3)]
    assert out.where("doc_id is null").first().text == "" and out.where("doc_id = 0").first().text == rows[0][1]


def test_sql_and_operator_on_lines_of_numbers_and_nulls(spark, tmp_path):
    """Null ids, lines of numbers, unspaced scripts and long tokens: the SQL and the operator agree."""
    r = np.random.default_rng(12)
    bits = ["total", "of", "7", "x9", "看到202年", "a" * 50 + "1", "-", "12.5", "sum", "end", "line", "up", "3"]
    texts = ["\n".join(" ".join(r.choice(bits, r.integers(1, 9))) for _ in range(r.integers(1, 6))) for _ in range(400)]
    rows = [(None if k % 40 == 0 else k // 2, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.sql(line_dedup.OP7_SQL).fetchall()
    got = [tuple(x) for x in line_dedup.op7_line_dedup(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(x[3] for x in got) > 50


def test_op7_equals_sql(spark, sf):
    got = line_dedup.op7_line_dedup(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    want = con.sql(line_dedup.OP7_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.n_dropped.sum() > 0
    for c in want.columns:
        assert (got[c] == want[c]).all()


def test_no_python_on_the_main_path(spark, sf):
    plan = line_dedup.op7_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


# SimHash


def _print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = [w for w in re.split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "A", "É B", "a b c", "The QUICK\tbrown\x0bfox\x0cjumps é中😀 over " * 9, "x\x1cy z\xa0w a a a a"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == _print(text) == simhash.fingerprint(text, step=2)


def test_sliced_comparison_finds_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 40)
    r = np.random.default_rng(4)
    fps = set(r.integers(0, 2**63, 300).tolist())
    for base in list(fps)[:40]:  # neighbours at 1 to 6 bits, and one large group in a bucket
        for _ in range(4):
            fps.add(base ^ sum(1 << int(b) for b in r.choice(63, r.integers(1, 7), replace=False)))
    for _ in range(200):
        fps.add(7 ^ sum(1 << int(b) for b in r.choice(range(16, 63), 3, replace=False)))
    fps = np.array(sorted(fps), dtype=np.int64)
    for radius in (0, 1, 2, 3):
        df = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(4)
        scratch = Scratch(spark, "t")
        got = {x.node: x.component for x in connected_components(simhash.near_links(df, scratch, radius), scratch).collect()}
        near = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= radius
        want = fps[union_labels(len(fps), *np.nonzero(near))]
        assert [got.get(int(f), int(f)) for f in fps] == want.tolist()


def test_a_large_bucket_is_split_in_bounded_memory(spark):
    """300,000 fingerprints that share a range of bits: linked pairs are found, and no group holds more than two chunks."""
    r = np.random.default_rng(9)
    fps = np.unique((r.integers(0, 2**48, 300_000) << 16) | 77)
    linked = fps[::1000]
    fps = np.unique(np.concatenate([fps, linked ^ (0b111 << 20), linked ^ (1 << 63 - 1) ^ (1 << 30)]))
    df = spark.createDataFrame(pa.table({"fp": fps})).repartition(8)
    import resource

    scratch = Scratch(spark, "t")
    got = {x.node: x.component for x in connected_components(simhash.near_links(df, scratch), scratch).collect()}
    assert all(got[int(a)] == got[int(a ^ (0b111 << 20))] == got[int(a ^ (1 << 63 - 1) ^ (1 << 30))] for a in linked)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 1 << 20  # KB of any one worker


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000), (7000, 7001)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()}
    assert all(got[k] == 0 for k in range(61)) and all(got[k] == 1000 for k in range(1000, 1300)) and got[7001] == 7000 and 5000 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


def test_simhash_on_odd_tables(odd_docs, no_docs, rows_of):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.component_id, []).append(r)
    assert len(by[1]) == 3 and len(by[2]) == 4 and all(r.fp == 0 for r in by[2])
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 7, 8, 9, 10]))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0
    repeated = odd_docs.where("doc_id = 5")
    assert simhash.keep_one(repeated).count() == 1


def test_op8(spark, sf):
    got = simhash.op8_simhash(spark, sf).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = np.array([simhash.fingerprint(d.text) for d in docs], dtype=np.uint64)
    label = union_labels(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3))
    assert [r.component_id for r in got] == [docs[k].doc_id for k in label]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps.tolist()]


# Near-dedup of the pipeline


def _jaccard_components(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    return union_labels(len(texts), *np.array(near).reshape(-1, 2).T.astype(int))


def test_near_copies_beyond_three_bits_go(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HOT", 16)
    r = np.random.default_rng(5)
    vocabulary = np.array(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(3000)])
    texts = []
    for _ in range(60):
        words = r.choice(vocabulary, 200)
        texts.append(" ".join(words))
        for edits in r.integers(0, 7, 3):  # six edits: similarity about 0.74
            copy = words.copy()
            copy[r.integers(0, 200, edits)] = "changed"
            texts.append(" ".join(copy))
    base = r.choice(vocabulary, 200)
    for k in range(60):  # a large group of near copies
        copy = base.copy()
        copy[r.integers(0, 200, 2)] = f"x{k}"
        texts.append(" ".join(copy))
    label = _jaccard_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()}
    assert kept == set(label.tolist())
    fps = [simhash.fingerprint(t, 5) for t in texts]
    assert any((fps[k] ^ fps[label[k]]).bit_count() > 3 for k in range(len(texts)))


@pytest.mark.parametrize("chunk", [None, 16])
def test_large_buckets_lose_no_component(spark, monkeypatch, chunk):
    """Families of 40 texts about as similar as the least that counts: a forest of a bucket's nearest SimHashes misses links."""
    if chunk:
        monkeypatch.setattr(near_dedup, "HOT", chunk)
        monkeypatch.setattr(near_dedup, "TOKENS", 2000)
    r = np.random.default_rng(0)
    vocabulary = np.array(["".join(r.choice(list("abcdefghij"), 6)) for _ in range(3000)])
    texts = []
    for _ in range(12):
        base = r.choice(vocabulary, 120)
        for _ in range(40):
            copy = base.copy()
            copy[r.integers(0, 120, r.integers(1, 4))] = f"x{len(texts)}"
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in near_dedup.keep_one(docs).collect()} == set(_jaccard_components(texts).tolist())


def test_far_simhashes_of_similar_sets(spark):
    """Five shingles and four of them: similarity 0.8, SimHashes 26 bits apart."""
    words = [f"w2179x{k}" for k in range(9)]
    texts = [" ".join(words), " ".join(words[:8])]
    a, b = (near_dedup.sketch(near_dedup.shingle_set(t))[1] for t in texts)
    assert ((a ^ b) & (2**64 - 1)).bit_count() == 26
    assert [x.doc_id for x in near_dedup.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()] == [0]


def test_linked_labels_of_two_chunks():
    r = np.random.default_rng(3)
    sets = [r.choice(400, r.integers(1, 30), replace=False) for _ in range(60)]
    sets += [np.unique(np.append(s[r.random(len(s)) > 0.1], s[0])) for s in sets] + [np.array([7])]
    left, label = np.arange(60), np.arange(len(sets)) * 10 - 50
    right, ends = np.arange(60, len(sets)), np.cumsum([0, *map(len, sets)])
    near = [(a, b) for a in left for b in right if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    got = near_dedup.linked_labels(label, np.concatenate(sets) - 200, ends, left, right, 0.8)
    assert 10 < len(got) <= len(near) < 60
    component = lambda pairs: union_labels(len(sets), *np.array(pairs).T.astype(int)).tolist()
    assert component([((a + 50) // 10, (b + 50) // 10) for a, b in got]) == component(near)


def test_near_dedup_on_odd_tables(odd_docs, no_docs):
    kept = near_dedup.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns and kept.dtypes == odd_docs.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, None, 7, 8, 9, 10]))
    assert near_dedup.keep_one(no_docs).count() == 0 and near_dedup.keep_one(odd_docs.where("doc_id = 5")).count() == 1


# Pipeline


def test_pipeline(spark, sf):
    """Each stage, on what its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, columns = Scratch(spark, "t"), docs.columns
    rows = lambda df: {r.doc_id: r.asDict() for r in df.collect()}
    stages, before = dict(corpus_pipeline.STAGES), rows(docs)
    assert list(stages) == ["quality classifier", "line dedup", "simhash near-dedup", "secret scans", "packing"]

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    docs = scratch.save(stages["quality classifier"](spark, docs, sf), "0")
    after = rows(docs)
    assert after == {i: r for i, r in before.items() if _plain_score(model, r["text"] or "") >= 0.3} and 0 < len(after) < len(before)

    con, docs = duckdb.connect(), scratch.save(stages["line dedup"](spark, docs, sf), "1")
    documents = pa.Table.from_pylist(list(after.values()))  # noqa: F841
    want = {i: t for i, t, *_ in con.sql(line_dedup.OP7_SQL).fetchall()}
    before, after = after, rows(docs)
    assert {i: r["text"] for i, r in after.items()} == want and all(r["n_chars"] == len(r["text"]) for r in after.values())
    assert all({**r, "text": 0, "n_chars": 0} == {**before[i], "text": 0, "n_chars": 0} for i, r in after.items()) and any(after[i]["text"] != r["text"] for i, r in before.items())

    docs = scratch.save(stages["simhash near-dedup"](spark, docs, sf), "2")
    ids = sorted(after)
    label = _jaccard_components([after[i]["text"] for i in ids])
    before, after = after, rows(docs)
    assert after == {ids[k]: before[ids[k]] for k in set(label.tolist())} and len(after) < len(before)

    docs = scratch.save(stages["secret scans"](spark, docs, sf), "3")
    before, after = after, rows(docs)
    scanner = secrets.Scanner()
    for i, r in before.items():
        text = secrets.redact_text(r["text"], scanner.spans(r["text"]))
        assert after[i] == {**r, "text": text, "n_chars": len(text) if text != r["text"] else r["n_chars"]}
    assert before != after and docs.columns == columns

    packed = stages["packing"](spark, docs, sf).collect()
    plain, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for i, r in after.items():
        want[i] = np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
    seen = dict.fromkeys(want, 0)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        own = want[r.doc_id]
        assert (r.start, 4 * r.doc_tokens, r.ids_crc32) == (seen[r.doc_id], len(own), zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]))
        seen[r.doc_id] += r.length
    assert all(4 * n == len(want[i]) for i, n in seen.items())
    assert corpus_pipeline.run(spark, sf).count() == len(packed)


def test_stages_on_odd_tables(spark, sf, odd_docs, no_docs):
    """Nulls, repeated rows and clashing names through all stages: which rows each keeps, and that others' columns stay."""
    for start in (odd_docs, no_docs):
        docs, scratch = start, Scratch(spark, "t")
        ids, others = [], []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = scratch.save(stage(spark, docs, sf), str(k))
            ids.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.dtypes == start.dtypes
                others.append({tuple(r) for r in docs.drop("text", "n_chars", "doc_id").collect()})
        assert docs.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        every = sorted(str(r.doc_id) for r in start.collect())
        assert set(ids[0]) <= set(every) and ids[1] == ids[0] and set(ids[2]) <= set(ids[1]) and ids[3] == ids[2] and set(ids[4]) == set(ids[3])
        assert all(o <= {tuple(r) for r in start.drop("text", "n_chars", "doc_id").collect()} for o in others) and bool(ids[4]) == (start is odd_docs)
