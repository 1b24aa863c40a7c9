"""Appends of overlapping, killed and repeated runs; the event log; one scan for
many bases; aggregate rules in the common aggregate; concurrent dataset rules."""

import os
import re
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import RuleContext
from tessera.plans.persistence import execution_states
from tessera.plans.run import Runner
from tessera.plans.validate import Validation, evidence, prepare, results, row_counts, settle_aggregates
from tessera.schemas import EVIDENCE_SCHEMA
from tessera.sources.ledger_store import EVENTS, EVIDENCES, EXECUTIONS, RESULTS, RULES, Store, leaf_name
from tests import fixtures as fx
from tests.conftest import SF_SMALL
from tests.test_runner_fixtures import _setup


def _rows(spark, execution, n, day="2024-01-01"):
    return spark.range(n).selectExpr("CAST(id AS STRING) AS evidence_id", f"'{execution}' AS execution_id", "'V' AS validation_id", "'x' AS failed_value",
                                     "CAST(id AS STRING) AS table_pk", "TRUE AS is_new_failure", f"DATE '{day}' AS execution_date")


def test_two_appends_at_once(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    threads = [threading.Thread(target=store.append, args=(EVIDENCES, _rows(spark, f"e{i}", 300).repartition(6), leaf_name(f"e{i}", "T"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = {r.execution_id: r["count"] for r in store.read(EVIDENCES).groupBy("execution_id").count().collect()}
    assert got == {f"e{i}": 300 for i in range(4)}


def test_killed_and_repeated_append(spark, scratch_dir):
    """What a killed writer leaves is not read; a repeated append replaces its leaf."""
    store = Store(spark, f"{scratch_dir}/ledger")
    leaf = leaf_name("e1", "T=1/ä")
    assert leaf != leaf_name("e1", "T=1/ö") and "=" not in leaf and "/" not in leaf
    killed = f"{store.path(EVIDENCES)}/_{leaf}-dead/execution_date=2024-01-01"
    _rows(spark, "e1", 50).drop("execution_date").write.parquet(killed)
    assert store.read(EVIDENCES).count() == 0
    for n in (20, 10):
        store.append(EVIDENCES, _rows(spark, "e1", n), leaf, "2024-01-01")
        assert store.read(EVIDENCES).count() == store.read_day(EVIDENCES, "2024-01-01").count() == n
    store.append(EVIDENCES, _rows(spark, "e2", 5, "2024-01-02"))
    store.append(EVIDENCES, _rows(spark, "e1", 0), leaf, "2024-01-01")           # nothing failed this time
    assert [r.execution_id for r in store.read(EVIDENCES).collect()] == ["e2"] * 5
    # files of the layout without leaves are read beside those with
    _rows(spark, "e0", 3).write.mode("append").partitionBy("execution_date").parquet(store.path(EVIDENCES))
    assert store.read(EVIDENCES).count() == 8
    assert store.read(EVIDENCES).columns == EVIDENCE_SCHEMA.names


def test_config_survives_a_replace_cut_short(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    one, two = (spark.createDataFrame([(f"R{i}", "is_not_null")], "rule_id string, technical_rule_name string") for i in (1, 2))
    store.replace(RULES, one)
    store.replace(RULES, two)
    assert [r.rule_id for r in store.read(RULES).collect()] == ["R2"]
    os.rename(store.path(RULES), store._new(RULES))           # ended between the two moves
    assert [r.rule_id for r in store.read(RULES).collect()] == ["R2"]


def test_run_killed_between_tables(spark, scratch_dir, monkeypatch):
    class Killed(BaseException):
        pass
    store, resolver, runner = _setup(spark, scratch_dir)
    resolver.register("clientes", fx.run_frame(spark, "run1"))
    real = runner.run_table

    def run_table(name, *args):
        if name == "second":
            raise Killed
        return real(name, *args)
    monkeypatch.setattr(runner, "run_table", run_table)
    with pytest.raises(Killed):
        runner.run("clientes, second", now=datetime(2024, 10, 5))
    events = store.read(EVENTS)
    assert sorted((r.table_id, r.event) for r in events.collect()) == [("T1", "END"), ("T1", "START"), ("second", "START")]
    assert {r.table_id: r.state for r in execution_states(events).collect()} == {"T1": "FAILED", "second": "RUNNING"}
    later = execution_states(events, datetime(2100, 1, 1))
    assert {r.table_id: r.state for r in later.collect()} == {"T1": "FAILED", "second": "LOST"}
    assert [e.table_id for e in store.read(EXECUTIONS).collect()] == ["T1"]


def test_states_of_repeated_and_unordered_events(spark):
    t = [datetime(2024, 1, 1, h) for h in range(6)]
    rows = [("a", "T", "END", t[2], "FAILED"), ("a", "T", "START", t[1], None), ("a", "T", "START", t[1], None),
            ("b", "T", "START", t[1], None), ("b", "T", "END", t[2], "ERROR"), ("b", "T", "START", t[3], None), ("b", "T", "END", t[4], "SUCCESS"),
            ("c", "T", "START", t[1], None), ("c", "T", "END", t[1], "SUCCESS"), ("d", "T", "START", t[0], None), ("e", "T", "END", t[3], "SKIPPED")]
    events = spark.createDataFrame(rows, "execution_id string, table_id string, event string, event_timestamp timestamp, status string")
    got = {r.execution_id: (r.state, None if r.seconds is None else float(r.seconds)) for r in execution_states(events, t[5], 4).collect()}
    assert got == {"a": ("FAILED", 3600.0), "b": ("SUCCESS", 3600.0), "c": ("SUCCESS", 0.0),
                   "d": ("LOST", None), "e": ("SKIPPED", None)}        # c: an END as early as its START; e: no START


def test_one_ledger_scan_for_many_bases(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    runner = Runner(spark, store)
    n = 20
    for i in range(n):
        day = f"2024-01-{i + 1:02d}"
        store.append(EVIDENCES, _rows(spark, f"e{i}", 5, day).withColumn("validation_id", F.lit(f"V{i}")))
    days = spark.range(n).selectExpr("'e' || id AS execution_id", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS execution_date", "'V' || id AS validation_id")
    store.append(EXECUTIONS, days.selectExpr("*", "'T' AS table_id", "CAST(execution_date AS TIMESTAMP) AS execution_timestamp", "'FAILED' AS status"))
    store.append(RESULTS, days.selectExpr("*", "'FAILED' AS status"))
    previous = runner._previous("T", [f"V{i}" for i in range(n)], datetime(2024, 3, 1))
    plan = previous._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "PartitionFilters: [isnotnull(execution_date" in plan or "PartitionFilters: [execution_date" in plan
    assert previous.count() == 5 * n


AGGREGATES = [
    Validation("A1", "is_aggr_not_greater_than", {"column": "o_totalprice", "aggr_type": "avg", "limit": 1e12}),
    Validation("A2", "is_aggr_not_less_than", {"aggr_type": "count", "limit": 1.0}),
    Validation("A3", "is_aggr_equal", {"column": "o_orderkey", "aggr_type": "max", "limit": 0.0}, perimeter="o_orderstatus = 'P'"),
    Validation("A4", "is_aggr_not_equal", {"column": "o_orderstatus", "aggr_type": "min", "limit": "'F'"}),
    Validation("A5", "is_aggr_not_equal", {"column": "o_orderkey", "aggr_type": "sum", "limit": 1.0}, perimeter="o_orderkey < 0"),
    Validation("A6", "is_aggr_not_less_than", {"column": "o_orderkey", "aggr_type": "stddev", "limit": "o_orderkey"}),
]


def test_aggregates_share_one_scan(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    prepared = prepare(df, AGGREGATES, "o_orderkey", RuleContext(spark))
    assert [p.kind for p in prepared] == ["aggregate"] * 5 + ["dataset"]        # a limit that is a column stays a plan of its own
    counts = row_counts(df, prepared)
    settled = settle_aggregates(prepared, counts)
    assert [p.kind for p in settled][:5] == ["aggregate", "aggregate", "row", "row", "aggregate"]
    passing = [p for p in prepared if p.validation.validation_id in ("A1", "A2", "A5")]
    lazy = evidence(df, passing, "o_orderkey")
    assert lazy.count() == 0
    one = results(df, passing)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1
    broken = evidence(df, prepared[:5], "o_orderkey")
    broken.collect()
    plan = broken._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
    assert len(set(re.findall(r"Subquery subquery#(\d+)", plan))) == 1         # all aggregates: one scan, used by every rule
    assert len(re.findall(r"Reused\w* Subquery subquery|ReusedSubquery", plan)) > 4
    got = {r.validation_id: r["count"] for r in broken.groupBy("validation_id").count().collect()}
    assert got == {"A3": df.where("o_orderstatus = 'P'").count(), "A4": df.count()}
    status = {r.validation_id: (r.status, r.failed_records_count) for r in results(df, prepared[:5]).collect()}
    assert status == {"A1": ("PASSED", 0), "A2": ("PASSED", 0), "A3": ("FAILED", got["A3"]), "A4": ("FAILED", got["A4"]), "A5": ("PASSED", 0)}


def test_run_with_aggregates_and_concurrent_rules(spark, scratch_dir):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    sets = [Validation(f"S{i}", "is_unique", {"columns": ["o_custkey"]}, perimeter=f"o_orderkey % 7 <> {i}") for i in range(6)]
    boom = Validation("BOOM", "sql_query", {"query": "SELECT raise_error('lost') AS o_orderkey", "merge_columns": ["o_orderkey"]})
    raising = Validation("SUM", "is_aggr_equal", {"column": "CAST(o_clerk AS INT)", "aggr_type": "sum", "limit": 0.0})
    store = Store(spark, f"{scratch_dir}/ledger")
    out = Runner(spark, store, parallel_rules=3).run_frame(df, "T", [*AGGREGATES, *sets, boom, raising], "o_orderkey", "e-1", datetime(2024, 5, 1))
    got = {r["validation_id"]: (r["status"], r["failed_records_count"], r["new_failures"]) for r in out.results}
    assert got["BOOM"][0] == got["SUM"][0] == "ERROR" and got["A1"] == ("PASSED", 0, 0)
    assert got["A4"] == ("FAILED", df.count(), df.count())
    for i in range(6):
        kept = df.where(f"o_orderkey % 7 <> {i}")
        n = kept.join(kept.groupBy("o_custkey").count().where("count > 1"), "o_custkey", "left_semi").count()
        assert got[f"S{i}"] == ("FAILED", n, n)
    assert store.read(EVIDENCES).groupBy("validation_id").count().count() == sum(v[1] > 0 for v in got.values())
