"""Line de-duplication against a dictionary; the perfect hash on its own."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.line_dedup import dedup_lines
from tessera.llm.perfect_hash import PerfectHash
from tests.llm.oddities import empty, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def brute(data, min_chars=20, min_docs=3):
    held = defaultdict(list)
    for i, t, *_ in data:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t, *_ in data:
        lines = (t or "").split("\n")
        kept = []
        for x in lines:
            k = key_of(x)
            last = max((y for y in held[k] if y is not None), default=None)
            if len(k) < min_chars or len(held[k]) < min_docs or i == last:
                kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in df.collect()), key=repr)


def test_perfect_hash():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, (2, 20_000), dtype=np.int64).view(np.uint64)
    built = PerfectHash.build(a, b)
    again = PerfectHash.load(*built.dump())
    assert sorted(again.index(a, b).tolist()) == list(range(20_000))
    assert PerfectHash.build(a[:0], b[:0]).index(a[:3], b[:3]).tolist() == [-1, -1, -1]


def test_hot_and_odd_lines(spark):
    rnd = random.Random(5)
    pool = [f"  Line number {i} of the POOL é\t" for i in range(30)] + ["short", "", "é" * 19, "É" * 20, "x" * 20, "\x85" + "y" * 20]
    hot = "The line that every third document holds"
    data = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(6))) + (f"\n{hot}" if i % 3 == 0 else ""), None, None, None)
            for i in range(900)]
    data += rows() + [(None, hot, None, None, None), (897, hot.upper(), None, None, None), (897, hot, None, None, None)]
    docs = frame(spark, data).withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(1))
    assert result(dedup_lines(docs)) == brute(data)


def test_null_ids_only_and_empty_table(spark):
    data = [(None, "a line of twenty characters and more", None, None, None)] * 4
    assert result(dedup_lines(frame(spark, data))) == brute(data)
    assert dedup_lines(empty(spark)).collect() == []
