"""Upserts, unify / dedup and the persistence laws."""

from pyspark.sql import functions as F

from tessera.operators.upsert import conditional_update, conform, reflect, update_matched, upsert
from tessera.plans import persistence as P
from tessera.plans.ledger import dedup_evidences, stage, unify_evidences
from tessera.schemas import EVIDENCE_SCHEMA

EV = "validation_id string, table_pk string, failed_value string"


def test_upserts(spark):
    t = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 3)], "k string, s string, n int")
    s = spark.createDataFrame([("2", "B", None), ("4", "d", 4)], "k string, s string, n int")
    new, changes = reflect(t, s, ["k"])
    assert {r.k: r.action for r in changes.collect()} == {"1": "DELETE", "2": "UPDATE", "3": "DELETE", "4": "INSERT"}
    assert sorted(new.collect()) == sorted(s.collect())
    upd = {r.k: (r.s, r.n) for r in update_matched(t, s, ["k"]).collect()}
    assert upd == {"1": ("a", 1), "2": ("B", None), "3": ("c", 3)}
    ups = {r.k: (r.s, r.n) for r in upsert(t, s, ["k"], ["n"]).collect()}
    assert ups == {"1": ("a", 1), "2": ("b", None), "3": ("c", 3), "4": (None, 4)}
    cu = {r.k: r.n for r in conditional_update(t, "k <> '2'", {"n": 0}).collect()}
    assert cu == {"1": 0, "2": 2, "3": 0}
    assert conform(t, EVIDENCE_SCHEMA).columns == [f.name for f in EVIDENCE_SCHEMA.fields]


def test_unify_is_idempotent_and_dedups(spark):
    raw = spark.createDataFrame([("V", "1", "x"), ("V", "1", "x"), ("V", "2", None)], EV)
    s1 = stage(raw, "e1", "2024-01-01")
    s2 = stage(raw.limit(1), "e2", "2024-01-02")
    empty = spark.createDataFrame([], s1.schema)
    first = unify_evidences([s1, s2], empty)
    assert first.count() == 3                      # e1: 2 unique keys, e2: 1
    again = unify_evidences([s1, s2], first)
    assert again.count() == 0                      # rerun adds nothing
    assert dedup_evidences(s1).count() == 2
    ids = {r.evidence_id for r in s1.collect()}
    assert len(ids) == 2                           # deterministic ids: duplicates share one


def test_persistence_laws(spark):
    prev = stage(spark.createDataFrame(
        [("A", "1", "x"), ("A", "2", None), ("A", "3", "y"), ("B", "1", "z")], EV), "p", "2024-01-01")
    cur = stage(spark.createDataFrame(
        [("A", "1", "x"), ("A", "2", None), ("A", "3", "w"), ("B", "9", "q")], EV), "c", "2024-01-02")
    summary = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
               for r in P.persistence_summary(cur, prev).collect()}
    assert summary == {"A": (1, 2, 1), "B": (1, 0, 1)}
    # new + persistent = current failures; resolved + persistent = previous failures
    for v, (n, p, r) in summary.items():
        assert n + p == cur.filter(F.col("validation_id") == v).count()
        assert r + p == prev.filter(F.col("validation_id") == v).count()
    flags = {(r.validation_id, r.table_pk): r.is_new_failure for r in P.flag_evidences(cur, prev, "c", "2024-01-02").collect()}
    assert flags == {("A", "1"): False, ("A", "2"): False, ("A", "3"): True, ("B", "9"): True}
    assert P.new_failures(cur, prev).count() == 2
    assert P.resolved_failures(cur, prev).count() == 2
    assert P.persistent_failures(cur, prev).count() == 2
    first = {r.validation_id: r.new_failures for r in P.first_run_counts(cur).collect()}
    assert first == {"A": 3, "B": 1}


def test_previous_and_latest_execution(spark):
    ex = spark.createDataFrame([
        ("e1", "T1", "2024-01-01 00:00:00", "SUCCESS"), ("e2", "T1", "2024-01-02 00:00:00", "FAILED"),
        ("e3", "T2", "2024-01-03 00:00:00", "FAILED"), ("e4", "T1", "2024-01-04 00:00:00", "ERROR"),
    ], "execution_id string, table_id string, execution_timestamp string, status string") \
        .withColumn("execution_timestamp", F.col("execution_timestamp").cast("timestamp"))
    prev = {r.execution_id: r.prev_execution_id for r in P.previous_execution(ex).collect()}
    assert prev == {"e1": None, "e2": "e1", "e3": None}   # per table; ERROR runs excluded
    latest = {r.table_id: r.execution_id for r in P.latest_execution(ex).collect()}
    assert latest == {"T1": "e2", "T2": "e3"}


def test_previous_execution_hot_table_matches_plain_window(spark):
    """One table holding most executions: the lag by month equals a plain
    per-table window, whether exchanges are reused or not."""
    from pyspark.sql import Window
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    ex = orders.select(F.col("o_orderkey").cast("string").alias("execution_id"),
                       F.when(F.col("o_orderstatus") == "F", F.lit("HOT"))
                        .otherwise(F.col("o_custkey").cast("string")).alias("table_id"),
                       F.col("o_orderdate").alias("execution_timestamp"),
                       F.lit("SUCCESS").alias("status"))
    w = Window.partitionBy("table_id").orderBy("execution_timestamp", "execution_id")
    want = {(r.execution_id, r.prev_execution_id) for r in
            ex.select("execution_id", F.lag("execution_id").over(w).alias("prev_execution_id")).collect()}
    for reuse in ("true", "false"):
        spark.conf.set("spark.sql.exchange.reuse", reuse)
        try:
            got = {(r.execution_id, r.prev_execution_id) for r in P.previous_execution(ex).collect()}
        finally:
            spark.conf.unset("spark.sql.exchange.reuse")
        assert got == want, reuse
