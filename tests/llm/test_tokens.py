import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from codeloom.llm import packing, simple8b, token_output
from codeloom.llm.tokens import WordEncoder


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    plain, own = Tokenizer.from_file(public_tokenizers.path(name)), WordEncoder(name, limit=50)
    r = random.Random(1)
    alphabet = list("ab Z'st\n\t\r  .,1!\x0b\x85\xa0　é́İΣß中😀ſ") + ["the", "'s ", "  ", "<|endoftext|>", "\x01", ".,", "  "]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 14))) for _ in range(3000)] + ["", None, "word " * 500]
    want = [np.array(plain.encode(t or "", add_special_tokens=False).ids + [7], dtype="<u4").tobytes() for t in texts]
    assert own.encode_many(pa.array(texts, pa.string()), 7) == want
    assert own.encode_many(pa.array([], pa.string()), 7) == []


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for _ in range(30):
        parts = []
        for _ in range(r.integers(0, 7)):
            a = r.integers(0, 2**63, int(r.choice([0, 1, 1023, 1024, 1025, 2500])), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a >>= r.integers(0, 64, len(a), dtype=np.uint64) if r.random() < 0.5 else np.uint64(r.integers(0, 63))
            a[r.random(len(a)) < 0.4] = 0
            parts.append(a)
        for a, (words, starts) in zip(parts, simple8b.encode(parts), strict=True):
            assert (simple8b.decode(words, starts, simple8b.block_sizes(len(a))) == a).all()


def test_segment_round_trip():
    docs = [np.arange(n, dtype="<u4") % 50_000 for n in (0, 1, 1024, 5000)]
    coded = simple8b.encode(docs)
    raw = token_output.write_segment([4, None, 0, -3], [len(d) for d in docs], [s for _, s in coded], [w for w, _ in coded])
    ids, n, flat = token_output.read_segment(raw)
    assert ids == [4, None, 0, -3] and n.tolist() == [0, 1, 1024, 5000] and (flat == np.concatenate(docs)).all()
    with pytest.raises(ValueError):
        token_output.read_segment(b"x" * 64)


def _ids(name, text, end):
    return np.array(Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_token_files(spark, odd_docs, tmp_path):
    token_output.write_token_files(odd_docs, f"file://{tmp_path}/f", "word_bpe_49k.json", 1, shards=3)
    rows = token_output.read_token_files(spark, f"file://{tmp_path}/f").orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in odd_docs.collect()], key=lambda d: (d is not None, d))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    want = sorted(_ids("word_bpe_49k.json", r.text, 1).tobytes() for r in odd_docs.collect())
    assert sorted(bytes(r.ids) for r in rows) == want


def test_token_files_of_nothing(spark, no_docs, tmp_path):
    token_output.write_token_files(no_docs, f"file://{tmp_path}/f", "word_bpe_49k.json", 1)
    assert token_output.read_token_files(spark, f"file://{tmp_path}/f").count() == 0


def test_a_hot_id_is_split(spark, tmp_path):
    """An id that holds half of the rows, and null ids: several shards each, ranges of their checksums, in the same order."""
    rows = [(7 if k % 2 else None if k % 4 == 0 else k, f"text number {k % 300} of many") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = f"file://{tmp_path}/f"
    token_output.write_token_files(docs, path, "word_bpe_49k.json", 1, shards=8)
    shards = {}
    for s in spark.read.parquet(path).orderBy("shard", "segment").collect():
        ids, n, flat = token_output.read_segment(bytes(s.payload))
        ends = np.cumsum(n)
        shards.setdefault(s.shard, []).extend((d is not None, d or 0, zlib.crc32(flat[e - k : e].astype("<u4").tobytes())) for d, k, e in zip(ids, n.tolist(), ends.tolist(), strict=True))
    assert max(map(len, shards.values())) < 400
    order = [x for s in sorted(shards) for x in shards[s]]
    assert order == sorted(order) and len(order) == 1200
    assert token_output.read_token_files(spark, path).count() == 1200


def test_op1(spark, sf):
    """The whole table against the library."""
    rows = token_output.op1_token_output(spark, sf).orderBy("doc_id").collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r, d, e in zip(rows, docs, plain.encode_batch([d.text or "" for d in docs], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += r.n_tokens


def _pack(lengths, capacity=1024):
    packer = packing.Packer(capacity)
    done = [s for k, n in enumerate(lengths) for s in packer.add(k, bytes(4 * n))]
    return done, packer


def test_classes():
    """A bin of class k has k whole rests and what fills its room; all sequences but the last are full."""
    r = np.random.default_rng(0)
    lengths = r.integers(1, 3000, 4000).tolist()
    done, packer = _pack(lengths)
    assert all(sum(p[2] for p in s) == 1024 for s in done)
    for s in done:
        whole = [p for p in s if p[1] + p[2] == p[4]]  # pieces that end a document: rests
        k = 1024 // s[0][2]
        if k < packing.CLASSES and len(s) > 1:
            assert len(whole) >= k and all(1024 // p[2] == k for p in s[:k])
    tail = packer.finish()
    assert len(packer.open()) < packing.CLASSES**2 / 2 + 2 and all(sum(p[2] for p in s) == 1024 for s in tail[:-1])
    got = {}
    for s in done + tail:
        for p in s:
            got.setdefault(p[0], []).append(p[1:3])
    for k, n in enumerate(lengths):
        at = 0
        for start, length in sorted(got[k]):
            assert start == at
            at += length
        assert at == n


def test_few_pieces_lie_outside_their_class(sf):
    """Of 1,000 documents over four tasks, under a twentieth of the pieces are in bins that were not filled."""
    texts = pq.read_table(f"{sf.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    lengths = [len(b) // 4 for b in WordEncoder("byte_bpe_50k.json").encode_many(texts, 0)]
    pieces = tail = 0
    for k in range(4):
        done, packer = _pack(lengths[k::4])
        tail += sum(map(len, packer.finish()))
        pieces += sum(map(len, done))
    assert tail < 0.05 * (pieces + tail) and pieces + tail < sum(1 + n // 1024 for n in lengths) * 2


def _check_packing(rows, docs, name="byte_bpe_50k.json", ids="ids"):
    """Every sequence is gapless and within the capacity, and the documents put together from their pieces, rows of an id in
    any order, are all documents with the library's ids. Returns the sequences."""
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    want = Counter()
    for (i, _), e in zip(docs, plain.encode_batch([t or "" for _, t in docs], add_special_tokens=False), strict=True):
        want[i, np.array([*e.ids, 0], dtype="<u4").tobytes()] += 1
    texts = {}
    for (i, raw), n in want.items():
        texts.setdefault((i, len(raw) // 4), []).extend([raw] * n)
    sequences, starts = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        own = [t for t in texts[r.doc_id, r.doc_tokens] if zlib.crc32(t[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        assert own
        starts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.start + r.length))
    for key, own in texts.items():  # each id of each of them once
        cover = np.zeros(key[1] + 1, dtype=int)
        for a, b in starts[key]:
            cover[a] += 1
            cover[b] -= 1
        assert (np.cumsum(cover)[:-1] == len(own)).all()
    assert sum(r.length for r in rows) == sum(k[1] * len(v) for k, v in texts.items())
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return sequences


def test_packing(odd_docs):
    """Nulls, repeated rows and equal ids included."""
    rows = packing.contract_rows(packing.pack(odd_docs, "byte_bpe_50k.json", 0)).collect()
    _check_packing(rows, [(r.doc_id, r.text) for r in odd_docs.collect()])


def test_packing_of_nothing(no_docs):
    assert packing.pack(no_docs, "byte_bpe_50k.json", 0).count() == 0


def test_op4(spark, sf):
    """The whole table against the library, and how little is padded."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = packing.op4_packing(spark, sf).collect()
    s = _check_packing(rows, [(r.doc_id, r.text) for r in docs])
    sizes = [sum(n for _, n in x) for x in s.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding / sum(sizes) < 0.01
    assert list(rows[0].asDict()) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
