"""Secret scan against plain regular expressions over whole texts."""

import random
import re
from hashlib import sha256

from tessera.llm import queries, secret_scan
from tests.conftest import SF_SMALL
from tests.llm.oddities import empty, frame

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
               lambda m: len(m[2]) >= 12, re.I | re.A),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, 0),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16, 0),
}


def brute(text):
    found = [(m.start(), m.end(), k) for k, (p, ok, flags) in BASE.items() for m in re.finditer(p, text, flags) if ok(m)]
    return sorted(found, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_random_texts():
    rnd = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "AKIA", "akia", "A1B2",
            "0123", "deadbeef", "DEAD", "é", "\n", "x", "ZZZZ99", "/+-", "ſecret", "toKen", "aAbB", "ghp_"]
    for _ in range(6000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))
        assert [s for s in secret_scan.scan(t) if s[2] in BASE] == brute(t), repr(t)


def test_checksum_kinds():
    body = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good, bad = body + secret_scan.crc62(body), body + "AAAAAA"
    for prefix, kind in (("ghp_", "github"), ("npm_", "npm")):
        text = f"key {prefix}{good}, {prefix}{bad} x{prefix}{good}"
        assert [s for s in secret_scan.scan(text) if s[2] == kind] == [(4, 44, kind)]
        assert "[SECRET]" in secret_scan.redact(text, secret_scan.scan(text))
    assert secret_scan.redact("a password=0123456789abcdef0 b", secret_scan.scan("a password=0123456789abcdef0 b")) == "a [SECRET] b"


def test_op8_equals_brute_force(spark):
    got = {r.doc_id: r for r in queries.op8_secret_scan(spark, SF_SMALL).collect()}
    n = 0
    for d in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        spans, r = brute(d.text or ""), got.pop(d.doc_id)
        n += len(spans)
        kinds = [k for *_, k in spans]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, BASE))
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert not got and n > 0


def test_odd_rows(spark):
    out = secret_scan.find_secrets(frame(spark).withColumnRenamed("lang", "secrets")).collect()
    assert len(out) == frame(spark).count()
    for r in out:
        assert [(s.start, s.end, s.kind) for s in r.secrets] == brute(r.text or "")
    assert secret_scan.find_secrets(empty(spark)).collect() == []
