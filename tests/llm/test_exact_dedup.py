"""Exact de-duplication against a dictionary."""

import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup
from tests.llm.oddities import empty, frame, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data):
    groups = defaultdict(list)
    for i, t, *_ in data:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for i, t, *_ in data:
        g = groups[(t or "").translate(LOWER)]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, sha256((t or "").translate(LOWER).encode()).hexdigest(), keep, len(g), i == keep))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.text_sha256, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_odd_rows(spark):
    docs = frame(spark).withColumn("kept", F.lit("clash"))
    assert result(exact_dedup.exact_dedup(docs)) == brute(rows())


def test_hot_group_and_same_prefix(spark):
    data = [(i, "x" * 400 if i % 3 == 0 else f"{'p' * 200}{i % 40:02d}", None, None, None) for i in range(600)]
    assert result(exact_dedup.exact_dedup(frame(spark, data))) == brute(data)


def test_empty_table(spark):
    assert exact_dedup.exact_dedup(empty(spark)).collect() == []


def test_no_text_is_shuffled(spark, monkeypatch):
    """Broadcast joins off: neither the staged steps nor the result send texts."""
    plans = []

    def explained(df):
        qe = df._jdf.queryExecution()
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plans.append(qe.explainString(mode))
    real = exact_dedup.stage
    monkeypatch.setattr(exact_dedup, "stage", lambda df, *a, **k: (explained(df), real(df, *a, **k))[1])
    monkeypatch.setattr(common, "FILTER_BITS", 64)              # everything passes the bitmap
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        data = rows() + [(i, f"{'p' * 200}{i % 40:02d}", None, None, None) for i in range(100)]
        found = exact_dedup.exact_dedup(frame(spark, data))
        explained(found)
        assert result(found) == brute(data)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    sent = [m for p in plans for m in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]", p)]
    assert len(sent) >= 4 and not any("text#" in s for s in sent)


def test_main_path_is_native(spark):
    plan = exact_dedup.exact_dedup(frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
