import base64
import hashlib
import random
import re
import string
import time
import zlib

from codeloom.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def _plain(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_equal_plain_search():
    r = random.Random(0)
    bits = ["password", "PassWord", "token", "api_key", "apikey", "secret", "=", ": ", "'", '"', " ", "AKIA", "ABCD1234", "deadbeef", "0123", "abcd", "zz", "İ", "K", "ſ", "\n", "=abcdef0123456789", "é中"]
    s = secrets.Scanner()
    for _ in range(20_000):
        text = "".join(r.choices(bits, k=r.randint(0, 16)))
        assert [x for x in s.spans(text) if x[0] in secrets.KINDS[:3]] == _plain(text)


def test_checksums():
    s, body = secrets.Scanner(), "0123456789zyxwvughijkABCDEFGHI"
    good = body + secrets.base62(zlib.crc32(body.encode()))
    bad = body + ("000000" if good[-6:] != "000000" else "000001")
    assert ("github", 2, 42) in s.spans(f"é ghp_{good} .") and not s.spans(f"é ghp_{bad} .")
    assert [x[0] for x in s.spans(f"npm_{good}")] == ["npm"]
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert s.spans(f"x {head}.{head}.abc-_ y")[0][0] == "jwt" and not s.spans(f"eyJhIj.{head}.abc")


def test_hostile_texts_take_linear_time():
    s = secrets.Scanner()
    deep = base64.urlsafe_b64encode(b'{"alg":' + b"[" * 100_000).decode().rstrip("=")
    begin = time.monotonic()
    assert s.spans(f"{deep}.eyJh.b") == []
    for bit in ("eyJ", "eyJ.", "eyJeyJ.eyJx.", "AKIA", "ghp_", "npm_0", "password ", "secretoken=", "token: 'x", "abcd ", "0123456789abcde-"):
        s.spans(bit * (2_000_000 // len(bit)))
    s.spans("eyJ" * 3_500_000)
    s.spans("password" + " " * 10_000_000)
    assert time.monotonic() - begin < 60
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert s.spans("eyJx.eyJx." + f"{head}.{head}.abc")[0][:2] == ("jwt", 10)


def test_checksum_kinds_on_a_table(spark):
    """Valid and invalid tokens among other words: found as a search at every place finds them."""
    r, rows = random.Random(3), []
    chars = string.ascii_letters + string.digits
    for k in range(300):
        body = "".join(r.choices(chars, k=30))
        sums = secrets.base62(zlib.crc32(body.encode())) if r.random() < 0.5 else "".join(r.choices(chars, k=6))
        words = [r.choice(["ghp_", "ghs_", "npm_", "gh_", "AKIA"]) + body + sums, "a plain word", "é"]
        head = base64.urlsafe_b64encode(r.choice([b'{"alg":"none"}', b'{"typ":"JWT"}', b'{"alg":7}'])).decode().rstrip("=")
        words.append(f"{head}.{r.choice(['eyJhIjoxfQ', 'abc'])}.{body}")
        r.shuffle(words)
        rows.append((k, " ".join(words)))
    found = {x.doc_id: [(s.kind, s.start, s.end) for s in x.spans if s.kind not in secrets.KINDS[:3]] for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, text in rows:
        want = []
        for m in re.finditer(r"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])", text):
            if secrets.base62(zlib.crc32(m[2].encode())) == m[3]:
                want.append(("npm" if m[1] == "npm" else "github", m.start(), m.end()))
        for m in re.finditer(r"(?<![0-9A-Za-z_-])(eyJ[0-9A-Za-z_-]+)\.eyJ[0-9A-Za-z_-]+\.[0-9A-Za-z_-]+", text):
            if base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)) == b'{"alg":"none"}':
                want.append(("jwt", m.start(), m.end()))
        assert found[k] == sorted(want, key=lambda s: s[1])
    assert sum(map(len, found.values())) > 100


def test_odd_documents(odd_docs, no_docs, rows_of):
    rows = secrets.scan(odd_docs).collect()
    assert len(rows) == odd_docs.count() and sum(len(r.spans) for r in rows) == 3
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    (hit,) = out.where("doc_id = 10").collect()
    assert hit.text == "<assign>' and <access> and <hex>" and hit.n_chars == len(hit.text)
    assert rows_of(out.where("doc_id <> 10"), *out.columns) == rows_of(odd_docs.where("doc_id <> 10"), *out.columns)
    assert secrets.scan(no_docs).count() == 0 and secrets.redact(no_docs).count() == 0


def test_op3(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op3_secrets(spark, sf).collect():
        want = _plain(docs[r.doc_id])
        kinds = [k for k, _, _ in want]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
