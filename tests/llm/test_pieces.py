import functools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codeloom.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary(PATH)


def _best(v, text):
    """Largest total score over all cuts of a short marked text, without the trie."""
    by = {p: v.scores[k] for k, (p, _, t) in enumerate(v.pieces) if t in (pieces.NORMAL, pieces.USER)}
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            p = text[begin:end]
            s = by.get(p, v.unknown_score if end - begin == 1 else None)
            if s is not None and best[begin] + s > best[end]:
                best[end] = best[begin] + s
    return best[-1]


def _score(v, ids):
    total, width, size = 0.0, 0, 0
    for k in ids:
        if k not in v.of_byte:
            total += v.scores[k]
            continue
        if not width:
            b = v.of_byte[k]
            size = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        width += 1
        if width == size:
            total, width = total + v.unknown_score, 0
    return total


def test_trie(vocabulary):
    by = {p.encode(): k for k, (p, _, t) in enumerate(vocabulary.pieces) if t in (pieces.NORMAL, pieces.USER)}
    for word in ("▁international", "▁the", "中文", "▁▁▁▁"):
        raw = word.encode()
        want = [(n, by[raw[:n]]) for n in range(1, len(raw) + 1) if raw[:n] in by]
        assert vocabulary.trie.prefixes(raw, 0) == want


def test_best_sequence_and_round_trip(vocabulary):
    r = random.Random(2)
    alphabet = list("abe Zt\n  .1é中😀ꙮ\0") + ["the ", " of", "ing", "   "]
    for _ in range(400):
        text = "".join(r.choices(alphabet, k=r.randint(1, 9)))
        ids = np.frombuffer(vocabulary.encode(text), "<u4").tolist()
        assert vocabulary.decode(vocabulary.encode(text)) == text
        assert _score(vocabulary, ids) == pytest.approx(_best(vocabulary, "▁" + text.replace(" ", "▁")))


def test_long_words_are_bounded(vocabulary):
    """Megabytes without a space: settled bit by bit, with the ids that the whole word has."""
    import tracemalloc

    r = random.Random(5)
    word = "".join(r.choices(["the", "ing", "中", "é", "q", "0", "zx"], k=3000))
    want = vocabulary.viterbi("▁" + word)
    assert _score(vocabulary, want) == pytest.approx(_best_windowed(vocabulary, "▁" + word))
    tracemalloc.start()
    ids = np.frombuffer(vocabulary.encode(word * 100), "<u4")
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert vocabulary.decode(ids.tobytes()) == word * 100
    assert vocabulary.decode(vocabulary.encode("a" * 300_000)) == "a" * 300_000


@functools.cache
def _known_scores():
    v = pieces.vocabulary(PATH)
    return {p: v.scores[k] for k, (p, _, t) in enumerate(v.pieces) if t in (pieces.NORMAL, pieces.USER)}


def _best_windowed(v, text):
    """As ``_best``, in a window of the longest piece."""
    by = _known_scores()
    longest = max(map(len, by))
    best = [0.0] + [-np.inf] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(max(0, end - longest), end):
            s = by.get(text[begin:end], v.unknown_score if end - begin == 1 else None)
            if s is not None and best[begin] + s > best[end]:
                best[end] = best[begin] + s
    return best[-1]


def test_bytes_that_are_no_text(vocabulary):
    assert vocabulary.decode(np.array([vocabulary.byte[0xFF], vocabulary.byte[0xE4]], "<u4").tobytes()) == "��"


def test_odd_documents(odd_docs, no_docs, rows_of):
    got = pieces.decode(pieces.encode(odd_docs, PATH), PATH)
    assert rows_of(got, "doc_id", "text") == rows_of(odd_docs, "doc_id", F.coalesce("text", F.lit("")))
    assert pieces.encode(no_docs, PATH).count() == 0


def test_op2_is_the_best_sequence(spark, sf):
    """The query's ids of the whole table: a plain search over all cuts of each distinct word, the words one after another."""
    v, memo = pieces.vocabulary(PATH), {}
    got = {r.doc_id: r for r in pieces.op2_sentencepiece(spark, sf).collect()}
    encoded = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4") for r in pieces.encode(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = encoded[d.doc_id]
        assert (got[d.doc_id].n_pieces, got[d.doc_id].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        want = 0.0
        for word in re.findall("▁*[^▁\n]+|▁+|\n", "▁" + d.text.replace(" ", "▁")) if d.text else ():
            if word not in memo:
                memo[word] = _best_windowed(v, word)
            want += memo[word]
        assert _score(v, ids.tolist()) == pytest.approx(want)


def test_op2(spark, sf):
    got = pieces.op2_sentencepiece(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("decoded_sha256"), F.length("text").cast("long").alias("n_chars"))
    assert got.select(docs.columns).exceptAll(docs).isEmpty() and got.count() == docs.count()
