"""Operator 3: secrets found by a keyword automaton, anchored patterns and embedded checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over a text; a kind's pattern is then tried only
where one of its keywords begins. Hexadecimal runs have no keyword: any run of 16 holds four places in a row that are
multiples of 4, so only where every fourth code point shows four hexadecimal digits in a row is the run itself measured.

Kinds, in this order (the first three are fixed values of the task):

- ``assign``: a password-like name, ``=`` or ``:``, and a value of 12 or more characters;
- ``access``: ``AKIA`` and more capitals and digits, 18 or more in all;
- ``hex``: 16 or more hexadecimal digits in lower case;
- ``github``: a prefix such as ``ghp_``, 30 letters and digits, and their CRC-32 in 6 digits of base 62;
- ``npm``: ``npm_`` and the same;
- ``jwt``: three base64url parts, the first of which decodes to a JSON object that names an algorithm; the first ``eyJ`` of a
  run of base64url characters is where such a header can begin, so each run is decoded once.

The last three count only if what they embed is valid; they add spans and remove none. Spans of one kind don't overlap and
are the leftmost ones; spans are in code points, the end exclusive. Keywords are met one by one, and each character is read a
bounded number of times whatever the text, so time is linear and what is held beside the text are its spans.

Edge cases: a null text is the empty text and has no spans; rows are scanned one by one, so repeated rows, ties and null
doc_ids need no care; an empty table gives no rows; other columns than doc_id and text are not read by ``scan`` and are
passed on by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import text_batches

KINDS = ["assign", "access", "hex", "github", "npm", "jwt"]
#: Keywords in lower case of the kind that is found in either case, and of the others as they stand.
NAMES = ["password", "passwd", "secret", "token", "apikey", "api_key"]
MARKS = {"access": ["AKIA"], "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], "npm": ["npm_"], "jwt": ["eyJ"]}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "jwt": re.compile(r"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.([0-9A-Za-z_-]+)"),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[0-9A-Za-z_-]*")
_FOUR = re.compile(r"[0-9a-f]{4,}")
_LEFT = re.compile(r"[0-9a-f]*")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def base62(n: int, digits: int = 6) -> str:
    out = ""
    for _ in range(digits):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= 12
    if kind == "access":
        return len(m[0]) >= 18
    if kind == "jwt":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (ValueError, RecursionError):  # no base64, no UTF-8, no JSON, or nested too deeply for any header
            return False
        return isinstance(head, dict) and isinstance(head.get("alg"), str)
    return base62(zlib.crc32(m[1].encode())) == m[2]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.names, self.marks = ahocorasick.Automaton(), ahocorasick.Automaton()
        for w in NAMES:
            self.names.add_word(w, (len(w), "assign"))
        for kind, words in MARKS.items():
            for w in words:
                self.marks.add_word(w, (len(w), kind))
        self.names.make_automaton()
        self.marks.make_automaton()

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed."""
        if not text:
            return []
        lower = text.lower()
        if len(lower) != len(text):  # some capitals become two characters: keep the places
            lower = text.translate(_ASCII_LOWER)
        out, after = [], dict.fromkeys(KINDS, 0)
        # No keyword of a kind lies within another one, so they come by their starts as well as by their ends.
        for automaton, of in ((self.names, lower), (self.marks, text)):
            for last, (n, kind) in automaton.iter(of):
                start = last - n + 1
                if start < after[kind]:
                    continue
                m = PATTERNS[kind].match(text, start)
                if m:
                    ok = _valid(kind, m)
                    if ok or kind in ("assign", "access"):  # a base match that fails still takes its place
                        after[kind] = m.end()
                    if ok:
                        out.append((kind, start, m.end()))
                        continue
                if kind == "jwt":
                    after[kind] = _TOKEN.match(text, start).end()
        end = 0
        for m in _FOUR.finditer(text[::4]):
            at = max(4 * m.start(), end)
            while at < 4 * m.end():  # several runs may seem one
                start = at
                while start > end and text[start - 1] in "0123456789abcdef":
                    start -= 1
                end = _LEFT.match(text, start).end()
                if end - start >= 16:
                    out.append(("hex", start, end))
                at = end + -end % 4 if end > at else at + 4
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every span of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in text_batches(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in s.spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or several that overlap, replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets replaced in ``text``, and ``n_chars``, where there is one, counted anew in the rows that changed.

    Rows and other columns stay as they are; a null text stays null.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in text_batches(batches):
            texts = batch.column(at).to_pylist()
            found = [s.spans(t) for t in texts]
            columns = list(batch.columns)
            if any(found):
                new = pa.array([redact_text(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
                changed = pa.array([bool(f) for f in found])
                columns[at] = new.cast(columns[at].type)
                if "n_chars" in names and pa.types.is_integer(columns[names.index("n_chars")].type):
                    k = names.index("n_chars")
                    columns[k] = pc.if_else(changed, pc.utf8_length(new).cast(columns[k].type), columns[k])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        for batch in batches:
            rows = []
            for doc_id, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of = [s["kind"] for s in spans]
                text = [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans]
                base = ",".join(t for t, k in zip(text, of, strict=True) if k in KINDS[:3])
                rows.append((doc_id, *(of.count(k) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), ",".join(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.mapInArrow(digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
