"""Near-duplicate documents against brute force over all pairs."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import minhash, queries
from tests.conftest import SF_SMALL
from tests.llm.oddities import empty, frame, rows


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def brute(data, percent):
    """(id, n_shingles, component_id, kept) by union-find over all pairs."""
    sets = [shingles(t) for _, t, *_ in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    pairs = {(a, b) for v in held.values() for n, a in enumerate(v) for b in v[:n]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
            root[find(a)] = find(b)
    low = {}
    for i, (doc, *_) in enumerate(data):
        r = find(i)
        low[r] = min((x for x in (low.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[i]), low[find(i)], doc == low[find(i)]) for i, (doc, *_) in enumerate(data)), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def near_copies(rnd, base, n, edits):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus():
    rnd = random.Random(11)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for g in range(25):
        base = [f"b{g}x{rnd.randrange(400)}" for _ in range(rnd.choice([8, 60, 200, 700]))]
        texts += near_copies(rnd, base, rnd.choice([1, 2, 3, 6]), 4)
    texts += near_copies(rnd, [f"hot{rnd.randrange(300)}" for _ in range(220)], 120, 7)      # a dense group, some beyond the limit
    texts += [" ".join(passage + [f"own{rnd.randrange(10**6)}" for _ in range(rnd.randrange(40))]) for _ in range(80)]
    chain = [f"c{i}" for i in range(300)]
    for i in range(12):                                                                      # a chain: only neighbours are linked
        texts.append(" ".join(chain[10 * i:10 * i + 150]))
    texts += [texts[0]] * 40
    rnd.shuffle(texts)
    return [(1000 + i, t, None, None, None) for i, t in enumerate(texts)]


def test_random_corpus(spark):
    data = corpus() + rows()
    docs = frame(spark, data).withColumn("node", F.lit("clash")).withColumn("component_id", F.lit("clash"))
    for percent in (85, 80):
        assert result(minhash.near_dups(docs, percent=percent)) == brute(data, percent)


def test_blocks_find_what_pivots_miss(spark, monkeypatch):
    """Blocks alone, of a few members, give the same components."""
    monkeypatch.setattr(minhash, "PIVOTS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    data = corpus()
    assert result(minhash.near_dups(frame(spark, data))) == brute(data, 85)


def test_pairs_just_below_the_limit_are_not_confirmed_one_by_one(spark, monkeypatch):
    """Two of these copies share some 81 percent unless their edits overlap."""
    rnd, staged = random.Random(5), {"pairs": 0, "links": 0}
    base, texts = [f"d{i}" for i in range(200)], []
    for k in range(120):
        words = base[:]
        for at in rnd.sample(range(200), 2):
            words[at] = f"e{k}x{at}"
        texts.append(" ".join(words))
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]

    def counting(df, name, slim=False, stage=minhash.stage):
        out = stage(df, name, slim)
        if name in staged:
            staged[name] += out.count()
        return out
    monkeypatch.setattr(minhash, "stage", counting)
    assert result(minhash.near_dups(frame(spark, data))) == brute(data, 85)
    assert 0 < staged["pairs"] <= staged["links"] + 120, staged


def test_odd_sketch_lets_every_pair_at_the_limit_pass():
    rng = np.random.default_rng(3)
    for size in (1, 7, 150, 600, 5000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for percent in (85, 80):
            shared = -(-percent * 2 * size // (100 + percent))          # the least that links two sets of this size
            if shared <= size:
                a, b = pool[:size], np.concatenate([pool[:shared], pool[size:2 * size - shared]])
                assert 100 * shared >= percent * (2 * size - shared)
                tables = [np.frombuffer(minhash.sketch(x), dtype=np.uint8)[None, :].copy() for x in (a, b)]
                for t in tables:
                    t[:, :minhash.SKETCH] = 0                           # the odd bits alone
                assert minhash.sharp_enough(*tables, np.array([2 * size]), percent).all()


def test_op2_equals_brute_force(spark):
    data = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert result(queries.op2_minhash(spark, SF_SMALL)) == brute(data, 85)


def test_near_dedup_keeps_one_of_each_group(spark):
    data = corpus()
    left = minhash.near_dedup(frame(spark, data))
    assert left.columns == frame(spark, []).columns
    assert sorted(r.doc_id for r in left.collect()) == [i for i, _, _, kept in sorted(brute(data, 85)) if kept]


def test_empty_table(spark):
    assert minhash.near_dups(empty(spark)).collect() == []


def test_match_threshold():
    rng = np.random.default_rng(0)
    assert (rng.binomial(minhash.COORDS, 0.85, 10**6) < minhash.match_threshold(85)).mean() < 1e-4
