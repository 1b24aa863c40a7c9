"""The history job against the runs' own figures and against a replay in plain
Python; partitions without a change; late evidence; jobs cut short."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera import suite_jobs
from tessera.plans import history as H
from tessera.plans.ledger import unify_job
from tessera.sources.catalog import TableResolver, path_exists
from tessera.sources.ledger_store import EVIDENCES, EXECUTIONS, RESULTS, TABLES, VALIDATIONS, Store
from tests import fixtures as fx
from tests.conftest import SF_SMALL
from tests.test_runner_fixtures import _setup

COUNTERS = ["new_failures", "persistent_failures", "resolved_failures"]


def _files(store, name):
    return {f.split(store.base, 1)[1] for f in store.read(name).inputFiles()}


def _figures(store):
    flags = sorted(map(repr, store.read(EVIDENCES).select("execution_id", "validation_id", "table_pk", "failed_value", "is_new_failure").collect()))
    return flags, sorted(map(repr, store.read(RESULTS).select("execution_id", "validation_id", *COUNTERS).collect()))


def test_job_agrees_with_runs_and_touches_only_what_differs(spark, scratch_dir):
    store, resolver, runner = _setup(spark, scratch_dir)
    for step, name in enumerate(("run1", "run2", "run4")):
        resolver.register("clientes", fx.run_frame(spark, name))
        runner.run("clientes", validation_id="VAL_AGE" if step == 1 else None, now=datetime(2024, 7, 1 + step))
    want, files = _figures(store), (_files(store, EVIDENCES), _files(store, RESULTS))
    assert H.persistence_job(spark, store) == {EVIDENCES: [], RESULTS: []}
    assert (_files(store, EVIDENCES), _files(store, RESULTS)) == files
    # spoil one day, then one counter of another
    spoiled = store.read_day(EVIDENCES, "2024-07-03").withColumn("is_new_failure", F.lit(True)).collect()
    store.rewrite_days(EVIDENCES, spark.createDataFrame(spoiled, store.schema(EVIDENCES)))
    spoiled = store.read_day(RESULTS, "2024-07-02").withColumn("resolved_failures", F.lit(7).cast("long")).collect()
    store.rewrite_days(RESULTS, spark.createDataFrame(spoiled, store.schema(RESULTS)))
    assert _figures(store) != want
    files = (_files(store, EVIDENCES), _files(store, RESULTS))
    assert H.persistence_job(spark, store) == {EVIDENCES: ["2024-07-03"], RESULTS: ["2024-07-02"]}
    assert _figures(store) == want
    for before, name, day in ((files[0], EVIDENCES, "2024-07-03"), (files[1], RESULTS, "2024-07-02")):
        after = _files(store, name)
        assert {f for f in before if day not in f} == {f for f in after if day not in f}
        assert not {f for f in before if day in f} & after


def test_job_cut_short_is_taken_up(spark, scratch_dir, monkeypatch):
    store, resolver, runner = _setup(spark, scratch_dir)
    for step, name in enumerate(("run1", "run2")):
        resolver.register("clientes", fx.run_frame(spark, name))
        runner.run("clientes", now=datetime(2024, 7, 1 + step))
    want = _figures(store)
    spoiled = store.read(EVIDENCES).withColumn("is_new_failure", F.lit(None).cast("boolean")).collect()
    store.rewrite_days(EVIDENCES, spark.createDataFrame(spoiled, store.schema(EVIDENCES)))

    def lost(*_):
        raise OSError("lost")
    monkeypatch.setattr(store, "rewrite_days", lost)
    try:
        H.persistence_job(spark, store)
    except OSError:
        pass
    monkeypatch.undo()
    # the partitions vanish as they would between the two moves of an overwrite
    fs, at = store._fs(store.base)
    fs.delete(at(f"{store.path(EVIDENCES)}/execution_date=2024-07-02"), True)
    H.persistence_job(spark, store)
    assert _figures(store) == want


def test_random_history_against_a_replay(spark):
    rnd = random.Random(11)
    runs = [(f"e{rnd.randrange(10**6):06d}", datetime(2024, 1, 1) + timedelta(days=i // 2, hours=i % 2), rnd.choice(["SUCCESS", "FAILED", "FAILED", "ERROR"]))
            for i in range(30)]
    verdicts, found = [], []
    for execution, _, _ in runs:
        for v in ("A", "B", "C"):
            if rnd.random() < 0.8:
                verdicts.append((execution, v, rnd.choice(["PASSED", "FAILED", "FAILED", "ERROR"])))
            for _ in range(rnd.randrange(25)):
                found.append((execution, v, rnd.choice(["1", "2", None]), rnd.choice(["x", "y", "z", None])))
    executions = spark.createDataFrame([(e, "T", t, t.date(), s) for e, t, s in runs],
                                       "execution_id string, table_id string, execution_timestamp timestamp, execution_date date, status string")
    results = spark.createDataFrame(verdicts, "execution_id string, validation_id string, status string")
    evidences = spark.createDataFrame(found, "execution_id string, validation_id string, table_pk string, failed_value string")
    validations = spark.createDataFrame([(v, "T") for v in "ABC"], "validation_id string, table_id string")
    sequence = H.verdict_sequence(executions, results, validations)
    islands = H.failure_islands(evidences, sequence)
    got = {(r.validation_id, r.execution_id): tuple(r[c] for c in COUNTERS) for r in H.history_counts(islands, sequence).collect()}
    flags = {(r.validation_id, r.execution_id, r.table_pk, r.failed_value): (r.is_new_failure, r.verdicts_open) for r in H.failure_flags(islands).collect()}
    want, want_flags = {}, {}
    held = defaultdict(set)
    for e, v, *key in found:
        held[e, v].add(tuple(key))
    for v in "ABC":
        before, age = set(), {}
        for e, _, status in sorted(runs, key=lambda r: (r[1], r[0])):
            if status == "ERROR" or not any(x == e and y == v and s != "ERROR" for x, y, s in verdicts):
                continue
            now = held[e, v]
            want[v, e] = (len(now - before), len(now & before), len(before - now))
            age = {k: age.get(k, 0) + 1 for k in now}
            want_flags |= {(v, e, *k): (k not in before, n) for k, n in age.items()}
            before = now
    assert got == want and flags == want_flags and len(want) > 20


def test_late_evidence_is_unified_then_flagged(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    days = [f"2024-01-0{i}" for i in range(1, 5)]
    runs = spark.createDataFrame([(f"e{i}", d) for i, d in enumerate(days)], "execution_id string, d string").withColumn("execution_date", F.col("d").cast("date"))
    store.append(EXECUTIONS, runs.selectExpr("*", "'T' AS table_id", "CAST(execution_date AS TIMESTAMP) AS execution_timestamp", "'FAILED' AS status"))
    store.append(RESULTS, runs.selectExpr("*", "'V' AS validation_id", "'FAILED' AS status"))
    store.replace(VALIDATIONS, spark.createDataFrame([("V", "T")], "validation_id string, table_id string"))
    staged = runs.selectExpr("execution_id", "execution_date", "'V' AS validation_id", "'k' AS table_pk", "'x' AS failed_value", "uuid() AS evidence_id")
    folder = f"{scratch_dir}/staged"
    staged.where("d <> '2024-01-02'" if "d" in staged.columns else "execution_id <> 'e1'").write.parquet(f"{folder}/stg.parquet")
    names = spark.createDataFrame([("T", "t", "stg")], "table_id string, table_name string, staging_evidences_table string")
    store.replace(TABLES, names)
    # a partition of another day is neither listed nor read: it holds no parquet
    other = f"{store.path(EVIDENCES)}/execution_date=2023-01-01"
    spark.range(1).selectExpr("'no parquet' AS value").write.text(other)
    assert unify_job(spark, store, TableResolver(spark, folder)) == {"tables": 1, "appended": 3}
    assert not path_exists(spark, f"{folder}/stg.parquet")
    fs, at = store._fs(store.base)
    fs.delete(at(other), True)
    H.persistence_job(spark, store)

    def new():
        return {r.execution_id: r.is_new_failure for r in store.read(EVIDENCES).collect()}
    assert new() == {"e0": True, "e2": True, "e3": False}
    staged.write.mode("overwrite").parquet(f"{folder}/stg.parquet")
    assert unify_job(spark, store, TableResolver(spark, folder)) == {"tables": 1, "appended": 1}
    H.persistence_job(spark, store)
    assert new() == {"e0": True, "e1": False, "e2": False, "e3": False}
    assert [r.resolved_failures for r in store.read(RESULTS).orderBy("execution_id").collect()] == [0, 0, 0, 0]


def test_evidence_of_the_history_query_is_not_one_tasks_work(spark):
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")          # a table of this size would be merged into one task
    try:
        files = suite_jobs._history_store(spark, SF_SMALL).read(EVIDENCES).inputFiles()
    finally:
        spark.conf.set(merge, before)
    assert len({f.rsplit("/", 1)[1].split("-")[1] for f in files}) > 1         # part-<task>-...
