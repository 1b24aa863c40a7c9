"""Phrase collocations against counters; routing and the sort on their own."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import phrases as P
from tessera.llm.words import split_words
from tests.llm.oddities import empty, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in data:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for k in (1, 2, 3):
                f[g].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(100 * count[q] >= 50 * a for q in count if len(q) == 3 and p in (q[:2], q[1:]) and count[q] >= least):
                continue
            cut = min((10**6 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            found.append((cut[0], a, " ".join(p), count[p[:cut[1]]], count[p[cut[1]:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(g, i + 1, p, a, l, r, n[g], s) for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("grp", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(n=400):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "ÉTÉ", "A b", "x\x00y", "🙂", "of", "the"]
    data = []
    for i in range(n):
        words = [rnd.choice(vocab[:rnd.choice((5, 15, len(vocab)))]) for _ in range(rnd.randrange(60))]
        text = "".join(w + rnd.choice((" ", " ", "  ", "\t", ", ", "! ", ".\n", "\r\n", " \x0b")) for w in words)
        data.append((i, text + ("in spite OF the hot passage" if i % 3 == 0 else ""), rnd.choice(("en", "en", "de", None)), "s", 1))
    return data


def test_random_and_odd_texts(spark):
    data = corpus() + rows()
    docs = frame(spark, data).withColumnRenamed("source", "grp")
    assert result(P.collocations(docs)) == brute(data)


def test_heavy_prefixes_are_split_and_added_up(spark, monkeypatch):
    """Slices of a few texts, so that one suffix has many rows; a low share."""
    data = corpus(900)
    docs = frame(spark, data).repartition(40).selectExpr("coalesce(lang, 'und') AS grp", "text")
    heavy = []
    for _ in range(P.DEPTH):
        counted = P.prefix_rows(docs, heavy)
        heavy.append(P.filter_bits(counted.groupBy("h").sum("n_rows").where("`sum(n_rows)` > 30").select("h")))
        assert heavy[-1].any()
    sent = P.routed(docs, 7, heavy)
    assert {r.route for r in sent.select("route").distinct().collect()} == {1, 2, 3, 4}
    got = P.shard_phrases(sent, 10).groupBy("grp", *P.WORDS, "depth").sum("n").where("`sum(n)` >= 10").collect()
    plain = P.shard_phrases(P.routed(docs, 1, []), 10).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, plain)))
    assert len(plain) > 50


def test_runs_cut_anywhere(monkeypatch):
    import pyarrow as pa
    texts = pa.array(["a b c a b. a b c", None, "c a b c"] * 5)
    whole = next(P.suffixes_of("g", texts))

    def named(parts):
        out = Counter()
        for s in parts:
            words = s.words.to_pylist()
            for *codes, n in zip(*s.codes, s.n.tolist()):
                out[tuple(words[c] for c in codes if c >= 0)] += n
        return out
    for run in (1, 2, 3, 7):
        monkeypatch.setattr(P, "RUN", run)
        assert named(P.suffixes_of("g", texts)) == named([whole])


def test_sort_equals_counting():
    rng = np.random.default_rng(5)
    keys = [rng.integers(0, 2, 3000), *[rng.integers(-1, 6, 3000) for _ in range(3)]]
    keys[1] = np.abs(keys[1])
    weight = rng.integers(1, 4, 3000)
    for least in (1, 10, 60):
        found = P.multikey_sort(keys, weight, np.ones(3000, dtype=np.int32), least)
        for depth in (1, 2, 3):
            want = Counter()
            for *k, w in zip(*[x.tolist() for x in keys[:depth + 1]], weight.tolist()):
                if -1 not in k:
                    want[tuple(k)] += w
            at, n = found[depth - 1] if depth <= len(found) else ([], [])
            got = {tuple(int(k[p]) for k in keys[:depth + 1]): int(c) for p, c in zip(at, n)}
            # words after an ended suffix are never asked for by the operator
            assert {k: c for k, c in want.items() if c >= least and all(x >= 0 for x in k)} == {k: c for k, c in got.items() if -1 not in k}


@pytest.mark.parametrize("texts", [[], [None], ["", " \t "], ["a"], ["é\x85 b\nc", None, "", "b"]])
def test_split_words(texts):
    import pyarrow as pa
    found = split_words(pa.array(texts, pa.string()))
    want = [(i, w) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert list(zip(found.text.tolist(), found.words.to_pylist())) == want
    part = split_words(pa.array(["skip"] + texts, pa.string()).slice(1))
    assert part.words.to_pylist() == [w for _, w in want]


def test_exact_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    a, l, r = 10**12 + 39, 10**13 + 37, 10**14 + 31
    got = spark.range(1).select(P.exact_score(*[F.lit(x).cast("long") for x in (a, l, r)]).alias("s")).first().s
    assert got == 10**6 * a * a // (l * r)


def test_empty_tables(spark):
    assert P.collocations(empty(spark)).collect() == []
    assert P.collocations(frame(spark, [(1, None, None, None, None)])).collect() == []
