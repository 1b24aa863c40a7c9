"""End to end on the five fixture tables: sync config, run three
consecutive executions, check evidence goldens and persistence counts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessera.plans.config import sync_config
from tessera.plans.run import Runner
from tessera.plans.validate import Validation
from tessera.sources.catalog import TableResolver
from tessera.sources.ledger_store import EVIDENCES, EXECUTIONS, RESULTS, Store
from tests import fixtures as fx

# expected failing (customer_id, value) per validation and run (FIXTURES.md)
EXPECTED = {
    "run1": {
        "VAL_DNI": {("103", "40112233B"), ("104", None), ("106", "7100045W")},
        "VAL_DNI_NN": {("104", None)},
        "VAL_EMAIL_NE": {("105", ""), ("106", None)},
        "VAL_EMAIL_RX": {("104", "gael.mail.test"), ("105", "")},
        "VAL_AGE": {("104", "17"), ("106", "101")},
        "VAL_COUNTRY": {("105", "PT")},
        "VAL_DNI_UQ": {("107", "71000450W"), ("108", "71000450W")},
    },
    "run2": {
        "VAL_DNI": {("103", "40112233C"), ("106", "7100045W"), ("109", None)},
        "VAL_DNI_NN": {("109", None)},
        "VAL_EMAIL_RX": {("105", "ona@@mail.test")},
        "VAL_AGE": {("104", "17")},
        "VAL_COUNTRY": {("105", "PT")},
    },
    "run3": {
        "VAL_DNI": {("202", "Q1234567Z"), ("204", "8181818XM")},
        "VAL_EMAIL_NE": {("203", "")},
        "VAL_EMAIL_RX": {("203", "")},
        "VAL_AGE": {("204", "12")},
    },
    "run4": {
        "VAL_DNI": {("103", "40112233C"), ("109", None)},
        "VAL_DNI_NN": {("109", None)},
        "VAL_COUNTRY": {("105", "PT")},
        "VAL_DNI_UQ": {("106", "71000450W"), ("107", "71000450W")},
    },
    "run5": {
        "VAL_DNI": {("202", "Q1234567Z"), ("204", "8181818XM"), ("205", None)},
        "VAL_DNI_NN": {("205", None)},
        "VAL_EMAIL_RX": {("205", "roc@mail")},
        "VAL_AGE": {("204", "12")},
        "VAL_COUNTRY": {("205", "FR")},
    },
}

# (new, persistent, resolved) per validation for each transition
PERSISTENCE = {
    ("run1", "run2"): {"VAL_DNI": (2, 1, 2), "VAL_DNI_NN": (1, 0, 1), "VAL_EMAIL_NE": (0, 0, 2),
                       "VAL_EMAIL_RX": (1, 0, 2), "VAL_AGE": (0, 1, 1), "VAL_COUNTRY": (0, 1, 0),
                       "VAL_DNI_UQ": (0, 0, 2)},
    ("run2", "run4"): {"VAL_DNI": (0, 2, 1), "VAL_DNI_NN": (0, 1, 0), "VAL_EMAIL_RX": (0, 0, 1),
                       "VAL_AGE": (0, 0, 1), "VAL_COUNTRY": (0, 1, 0), "VAL_DNI_UQ": (2, 0, 0)},
    ("run3", "run5"): {"VAL_DNI": (1, 2, 0), "VAL_DNI_NN": (1, 0, 0), "VAL_EMAIL_NE": (0, 0, 1),
                       "VAL_EMAIL_RX": (1, 0, 1), "VAL_AGE": (0, 1, 0), "VAL_COUNTRY": (1, 0, 0)},
}


def _setup(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    sync_config(store, fx.tables_sheet(spark), fx.rules_sheet(spark), fx.validations_sheet(spark))
    resolver = TableResolver(spark)
    return store, resolver, Runner(spark, store, resolver)


def _evidence(store, execution_id):
    rows = (store.read(EVIDENCES).filter(F.col("execution_id") == execution_id)
            .select("validation_id", "table_pk", "failed_value", "is_new_failure").collect())
    out = {}
    for r in rows:
        out.setdefault(r.validation_id, set()).add((r.table_pk, r.failed_value))
    return out, rows


@pytest.mark.parametrize("sequence", [("run1", "run2", "run4"), ("run3", "run5")])
def test_consecutive_runs(spark, scratch_dir, sequence):
    store, resolver, runner = _setup(spark, scratch_dir)
    previous = None
    for step, name in enumerate(sequence):
        resolver.register("clientes", fx.run_frame(spark, name))
        report = runner.run("clientes", now=datetime(2024, 7, 1 + step, 12, 0, 0))
        got, rows = _evidence(store, report.execution_id)
        assert got == EXPECTED[name], name
        results = {r.validation_id: r for r in
                   store.read(RESULTS).filter(F.col("execution_id") == report.execution_id).collect()}
        assert len(results) == len(fx.VALIDATIONS_SHEET)
        for vid, fails in EXPECTED[name].items():
            assert results[vid].status == "FAILED"
            assert results[vid].failed_records_count == len(fails)
            assert results[vid].perimeter == len(fx.RUNS[name])
        assert results["VAL_DATE"].status == "PASSED"
        if previous is None:
            assert all(r.is_new_failure for r in rows)
            for vid, fails in EXPECTED[name].items():
                assert (results[vid].new_failures, results[vid].persistent_failures,
                        results[vid].resolved_failures) == (len(fails), 0, 0)
        else:
            expected = PERSISTENCE[(previous, name)]
            for vid, r in results.items():
                triple = (r.new_failures, r.persistent_failures, r.resolved_failures)
                assert triple == expected.get(vid, (0, 0, 0)), (previous, name, vid)
            # flags agree with counts
            for vid, (new, persistent, _) in expected.items():
                flags = [r.is_new_failure for r in rows if r.validation_id == vid]
                assert sum(flags) == new and len(flags) - sum(flags) == persistent
        previous = name
    ex = store.read(EXECUTIONS).collect()
    assert len(ex) == len(sequence)
    assert {e.status for e in ex} == {"FAILED"}


def test_persistent_null_value(spark, scratch_dir):
    """Same pk with a NULL value in both runs is persistent (NULL-safe key)."""
    store, resolver, runner = _setup(spark, scratch_dir)
    resolver.register("clientes", fx.run_frame(spark, "run5"))
    runner.run("clientes", now=datetime(2024, 8, 1))
    report = runner.run("clientes", now=datetime(2024, 8, 2))
    r = {x.validation_id: x for x in store.read(RESULTS)
         .filter(F.col("execution_id") == report.execution_id).collect()}
    assert (r["VAL_DNI_NN"].new_failures, r["VAL_DNI_NN"].persistent_failures) == (0, 1)
    assert (r["VAL_DNI"].new_failures, r["VAL_DNI"].persistent_failures) == (0, 3)


def test_unknown_table_skipped_and_bad_rule_error(spark, scratch_dir):
    store, resolver, runner = _setup(spark, scratch_dir)
    report = runner.run("no_such_table")
    assert report.status == "SKIPPED"
    vals = [Validation("BAD", "no_such_rule", {"column": "age"}), Validation("BUILTIN", "isnull", {"columns": ["age"]}, implementation="CUSTOM"),
            Validation("OK", "is_not_null", {"column": "age"})]
    out = runner.run_frame(fx.run_frame(spark, "run1"), "T8", vals, "customer_id", "e-bad", datetime(2024, 9, 1))
    assert {r["validation_id"]: r["status"] for r in out.results} == {"BAD": "ERROR", "BUILTIN": "ERROR", "OK": "PASSED"}


def test_raising_perimeter_isolated(spark, scratch_dir):
    """A perimeter that raises at run time ends its own validation only."""
    runner = Runner(spark, Store(spark, f"{scratch_dir}/ledger"))
    boom = "CAST(name AS INT) > 0"
    vals = [Validation("ROW", "is_not_null", {"column": "age"}, perimeter=boom),
            Validation("SET", "is_unique", {"columns": ["dni"]}, perimeter=boom),
            Validation("OK", "is_in_range", {"column": "age", "min_limit": 18.0, "max_limit": 100.0})]
    out = runner.run_frame(fx.run_frame(spark, "run1"), "T7", vals, "customer_id", "e-per", datetime(2024, 9, 1))
    got = {r["validation_id"]: (r["status"], r["perimeter"], r["failed_records_count"]) for r in out.results}
    assert got == {"ROW": ("ERROR", 0, 0), "SET": ("ERROR", 0, 0), "OK": ("FAILED", 8, 2)}


def test_filtered_run_is_no_base_for_other_validations(spark, scratch_dir):
    store, resolver, runner = _setup(spark, scratch_dir)
    resolver.register("clientes", fx.run_frame(spark, "run1"))
    runner.run("clientes", now=datetime(2024, 10, 1))
    runner.run("clientes", validation_id="VAL_AGE", now=datetime(2024, 10, 2))
    resolver.register("clientes", fx.run_frame(spark, "run2"))
    report = runner.run("clientes", now=datetime(2024, 10, 3))
    got = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
           for r in store.read(RESULTS).filter(F.col("execution_id") == report.execution_id).collect()}
    assert {k: v for k, v in got.items() if v != (0, 0, 0)} == PERSISTENCE[("run1", "run2")]


def test_one_failing_table_does_not_end_the_run(spark, scratch_dir, monkeypatch):
    store, resolver, runner = _setup(spark, scratch_dir)
    resolver.register("clientes", fx.run_frame(spark, "run1"))
    real = runner.run_table

    def run_table(name, *args):
        if name == "broken":
            raise RuntimeError("lost")
        return real(name, *args)
    monkeypatch.setattr(runner, "run_table", run_table)
    report = runner.run("broken, clientes", now=datetime(2024, 10, 5))
    assert [t.status for t in report.tables] == ["ERROR", "FAILED"]
    assert sorted(r.status for r in store.read(EXECUTIONS).collect()) == ["ERROR", "FAILED"]


def test_runtime_error_isolated(spark, scratch_dir):
    """A rule that raises at run time (ANSI cast) is marked ERROR; the others
    sharing its scan still produce their results."""
    store = Store(spark, f"{scratch_dir}/ledger")
    runner = Runner(spark, store)
    df = fx.run_frame(spark, "run1")
    vals = [Validation("OK", "is_in_range", {"column": "age", "min_limit": 18.0, "max_limit": 100.0}),
            Validation("BOOM", "sql_expression", {"expression": "CAST(name AS INT) > 0"})]
    out = runner.run_frame(df, "T9", vals, "customer_id", "exec-iso", datetime(2024, 9, 1))
    status = {r["validation_id"]: r["status"] for r in out.results}
    assert status == {"OK": "FAILED", "BOOM": "ERROR"}
    assert {r["validation_id"]: r["failed_records_count"] for r in out.results}["OK"] == 2


def test_rerun_after_evidence_append_keeps_counts(spark, scratch_dir):
    """A run interrupted after its evidence append (results not written) is
    re-run: no evidence is appended twice and the counts are recovered."""
    store = Store(spark, f"{scratch_dir}/ledger")
    runner = Runner(spark, store)            # the staging folder goes with the first driver
    vals = [Validation("AGE", "is_in_range", {"column": "age", "min_limit": 18.0, "max_limit": 100.0})]
    first = runner.run_frame(fx.run_frame(spark, "run1"), "T5", vals, "customer_id", "e-1", datetime(2024, 11, 1))
    runner.log_executions("e-1", datetime(2024, 11, 1), [first])
    second = runner.run_frame(fx.run_frame(spark, "run2"), "T5", vals, "customer_id", "e-2", datetime(2024, 11, 2))
    # simulate the crash: drop e-2's result rows by re-running with a fresh results table
    store2 = Store(spark, f"{scratch_dir}/ledger")
    results_path = store2.path(RESULTS)
    kept = store2.read(RESULTS).filter(F.col("execution_id") != "e-2").collect()
    spark.createDataFrame(kept, store2.read(RESULTS).schema).write.mode("overwrite") \
        .partitionBy("execution_date").parquet(results_path)
    before = store.read(EVIDENCES).count()
    again = runner.run_frame(fx.run_frame(spark, "run2"), "T5", vals, "customer_id", "e-2", datetime(2024, 11, 2))
    assert store.read(EVIDENCES).count() == before
    assert again.results[0]["new_failures"] == second.results[0]["new_failures"]
    assert again.results[0]["persistent_failures"] == second.results[0]["persistent_failures"] == 1


def test_persistence_from_ledger_matches_run(spark, scratch_dir):
    store, resolver, runner = _setup(spark, scratch_dir)
    for step, name in enumerate(("run1", "run2")):
        resolver.register("clientes", fx.run_frame(spark, name))
        report = runner.run("clientes", now=datetime(2024, 12, 1 + step))
    recorded = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
                for r in store.read(RESULTS).filter(F.col("execution_id") == report.execution_id).collect()
                if (r.new_failures, r.persistent_failures, r.resolved_failures) != (0, 0, 0)}
    audited = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
               for r in runner.persistence_from_ledger("T1").collect()}
    assert audited == recorded == PERSISTENCE[("run1", "run2")]


def test_persistence_from_ledger_around_a_filtered_run(spark, scratch_dir):
    """Skipped validations neither resolve nor turn up as new one run later."""
    store, resolver, runner = _setup(spark, scratch_dir)

    def audit():
        return {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
                for r in runner.persistence_from_ledger("T1").collect()}
    assert audit() == {}
    resolver.register("clientes", fx.run_frame(spark, "run1"))
    runner.run("clientes", now=datetime(2024, 10, 1))
    report = runner.run("clientes", validation_id="VAL_AGE", now=datetime(2024, 10, 2))
    recorded = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
                for r in store.read(RESULTS).filter(F.col("execution_id") == report.execution_id).collect()}
    assert audit() == recorded and set(recorded) == {"VAL_AGE"}
    resolver.register("clientes", fx.run_frame(spark, "run2"))
    runner.run("clientes", now=datetime(2024, 10, 3))
    assert audit() == PERSISTENCE[("run1", "run2")]
