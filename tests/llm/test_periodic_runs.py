"""Periodic runs against a search over all periods; the query on whole texts."""

import hashlib
import random
import re
import zlib

import pyarrow as pa

from tessera.llm import periodic_runs as R
from tessera.llm.queries import looped_documents, op13_periodic_runs
from tests.conftest import SF_SMALL
from tests.llm.oddities import empty, frame, rows


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w):
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            b = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - b >= max(24, 3 * q):
                out.setdefault((b, i + q), q)
    return sorted((b, e - b, q) for (b, e), q in out.items())


def collapsed(w, runs):
    gone = {i for b, length, q in runs for i in range(b + q, b + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_texts(n):
    rnd = random.Random(8)
    for _ in range(n):
        k, w = rnd.choice((1, 2, 3, 40)), []
        for _ in range(rnd.randrange(6)):
            base = [f"É{rnd.randrange(k)}" for _ in range(rnd.randrange(1, rnd.choice((3, 12, 40))))]
            w += base * rnd.randrange(1, rnd.choice((3, 6, 30)))
            if rnd.random() < 0.5:
                w += base[:rnd.randrange(len(base) + 1)]
        yield "".join(x + rnd.choice((" ", " ", "\n", " \t\x0b")) for x in w)


def check(texts):
    runs, kept = R.runs_of(pa.array(texts, pa.string()))
    for text, found, rest in zip(texts, runs.to_pylist(), kept.to_pylist()):
        want = brute(split(text))
        assert [(r["start"], r["length"], r["period"]) for r in found] == want
        assert rest == collapsed(split(text), want)
    return sum(map(len, runs.to_pylist()))


def test_random_texts():
    assert check([*random_texts(600), None, "", " \n "]) > 300


def test_chunks_and_thresholds(monkeypatch):
    monkeypatch.setattr(R, "CHUNK", 7)
    monkeypatch.setattr(R, "LEAST_LENGTH", 24)
    edges = ["a " * 23, "a " * 24, "a b " * 12, "a b " * 11 + "a", ("x " * 7 + "y ") * 3, ("x " * 8 + "y ") * 3, "a b c " * 8 + "a b d " * 8,
             " ".join(map(str, range(9))) + " " + " ".join(map(str, range(9)))]
    check(edges + [*random_texts(60)])


def test_very_long_texts():
    rnd = random.Random(2)
    once = " ".join(str(rnd.randrange(300)) for _ in range(30_000))
    runs, kept = R.runs_of(pa.array(["p q r " * 60_000 + "s", once, f"{once} {once} {once}", once]))
    assert [[tuple(r.values()) for r in x] for x in runs.to_pylist()] == [[(0, 180_000, 3)], [], [(0, 90_000, 30_000)], []]
    assert kept.to_pylist() == ["p q r s", once, once, once]


def test_rows_pass_through(spark):
    data = rows() + [(5, "a b " * 20, None, None, None)]
    docs = frame(spark, data).withColumnRenamed("source", "runs")
    found = R.find_runs(docs)
    assert found.columns == ["doc_id", "text", "lang", "n_chars", "runs", "collapsed_text"]
    got = sorted((repr(r.text), repr([tuple(x) for x in r.runs]), r.collapsed_text) for r in found.collect())
    assert got == sorted((repr(t), repr(brute(split(t))), collapsed(split(t), brute(split(t)))) for _, t, *_ in data)
    assert R.find_runs(empty(spark)).collect() == []


def looped(doc_id, text):
    w = split(text)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    return w


def test_looped_documents(spark):
    data = [(i, " ".join(f"w{j}" for j in range(i % 23)) if i % 29 else None, None, None, None) for i in range(600)] + [(None, "a b c", None, None, None)]
    got = {r.doc_id: split(r.text) for r in looped_documents(frame(spark, data)).collect()}
    assert got == {i: looped(i, t) for i, t, *_ in data}


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    want = []
    for d in docs:
        w = looped(d.doc_id, d.text)
        if len(w) > 900:
            continue                    # the search over all periods is quadratic
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), collapsed(w, runs))]
        want.append((d.doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], *sha))
    held = {w[0] for w in want}
    got = op13_periodic_runs(spark, SF_SMALL).collect()
    assert len(got) == len(docs) and len(want) > 150 and sum(w[1] for w in want) > 5
    assert sorted(tuple(r) for r in got if r.doc_id in held) == sorted(want)
