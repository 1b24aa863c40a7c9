"""Skewed keys against brute force, summary evidence, staging cleanup and
multi-table runs."""

import os
from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import RuleContext
from tessera.operators.dataset_rules import DATASET_RULES
from tessera.plans import persistence as P
from tessera.plans.config import sync_config
from tessera.plans.ledger import stage
from tessera.plans.run import Runner
from tessera.plans.validate import Validation, evidence, prepare
from tessera.session import checkpoint_dir
from tessera.sources.catalog import TableResolver
from tessera.sources.ledger_store import EXECUTIONS, Store
from tests import fixtures as fx
from tests.conftest import SF_SMALL


def _hot_lineitem(spark):
    """lineitem with one order key holding every 'R' row (about a third)."""
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    return li.withColumn("l_orderkey", F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.col("l_orderkey")))


def test_unique_and_fk_with_hot_key_match_brute_force(spark):
    li = _hot_lineitem(spark)
    pdf = li.select("l_orderkey", "l_linenumber", "l_partkey").toPandas()
    ctx = RuleContext(spark, TableResolver(spark, SF_SMALL))
    sizes = pdf.groupby(["l_orderkey", "l_linenumber"]).size()
    expected_dups = int(sizes[sizes > 1].sum())
    got = DATASET_RULES["is_unique"](li, {"columns": ["l_orderkey", "l_linenumber"]}, ctx).count()
    assert got == expected_dups
    orders = set(spark.read.parquet(f"{SF_SMALL}/orders.parquet").toPandas()["o_orderkey"])
    expected_orphans = int((~pdf["l_orderkey"].isin(orders)).sum())
    got = DATASET_RULES["foreign_key"](li, {"columns": ["l_orderkey"], "ref_columns": ["o_orderkey"],
                                            "ref_table": "orders"}, ctx).count()
    assert got == expected_orphans


def test_wide_key_uniqueness_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    pdf = docs.select("doc_id", "text").toPandas()
    counts = pdf["text"].value_counts()
    expected = set(pdf[pdf["text"].isin(counts[counts > 1].index)]["doc_id"])
    got = {r.doc_id for r in DATASET_RULES["is_unique"](docs, {"columns": ["text"]}, RuleContext(spark)).collect()}
    assert got == expected


def test_persistence_with_hot_values(spark):
    """Many evidence rows sharing one failed value and a NULL pk part."""
    li = _hot_lineitem(spark)
    vals = [Validation("HOT", "is_in_list", {"column": "l_returnflag", "allowed": ["A", "N"]})]
    ev = evidence(li, prepare(li, vals, "l_orderkey, l_linenumber", RuleContext(spark)), "l_orderkey, l_linenumber")
    cur = stage(ev, "c", "2024-01-02")
    prev = stage(ev.filter(F.col("table_pk") != "0|1"), "p", "2024-01-01")
    keys = ev.select("table_pk", "failed_value").distinct().count()
    s = P.persistence_summary(cur, prev).collect()[0]
    assert s.new_failures + s.persistent_failures == keys
    assert s.new_failures == ev.filter(F.col("table_pk") == "0|1").select("table_pk").distinct().count()
    assert s.resolved_failures == 0


def test_summary_evidence_mode(spark):
    df = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    ctx = RuleContext(spark, aggregate_evidence="summary")
    vals = [Validation("AGG", "is_aggr_not_equal", {"column": "c_mktsegment", "aggr_type": "count_distinct",
                                                    "limit": 5.0}),
            Validation("SCH", "has_valid_schema", {"expected_schema": "c_custkey INT, zz STRING"})]
    rows = {r.validation_id: r for r in evidence(df, prepare(df, vals, "c_custkey", ctx), "c_custkey").collect()}
    assert rows["AGG"].table_pk is None and rows["AGG"].failed_value == "5"
    assert "missing column zz" in rows["SCH"].failed_value and "c_custkey" in rows["SCH"].failed_value


def test_staging_removed_after_run_and_multi_table_status(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/ledger")
    tables = spark.createDataFrame([
        {**fx.TABLES_SHEET[0]},
        {**fx.TABLES_SHEET[0], "table_id": "T2", "table_name": "clientes_b", "table_name_tech": "clientes_b"},
    ])
    sync_config(store, tables, fx.rules_sheet(spark), fx.validations_sheet(spark))
    resolver = TableResolver(spark, frames={"clientes": fx.run_frame(spark, "run4"),
                                            "clientes_b": fx.run_frame(spark, "run1")})
    runner = Runner(spark, store, resolver)
    report = runner.run("all", now=datetime(2024, 10, 1))
    # T2 has no validations configured: SUCCESS without running anything
    assert {o.table_name: o.status for o in report.tables} == {"clientes": "FAILED", "clientes_b": "SUCCESS"}
    assert report.status == "FAILED"
    ex = store.read(EXECUTIONS).collect()
    assert {e.table_id for e in ex} == {"T1", "T2"} and len({e.execution_id for e in ex}) == 1
    staging = os.path.join(checkpoint_dir(spark), "tessera-staging", report.execution_id)
    assert not any(os.path.exists(os.path.join(staging, t)) for t in ("T1", "T2"))
    assert set(runner.step_seconds) == {"T1"}


def test_hot_key_of_is_unique_is_spread(spark):
    """One key with most rows and no broadcast of the keys: no task of the
    final join holds more than a quarter of the result."""
    from tessera.operators.dataset_rules import is_unique
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn(
        "k", F.expr("IF(l_linenumber <= 5, 0, l_orderkey * 10 + l_linenumber)"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled",
                                          "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "32")):
        spark.conf.set(k, v)
    try:
        out = is_unique(df, {"columns": ["k"]}, RuleContext(spark))
        parts = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(parts) == df.filter("l_linenumber <= 5").count() + df.filter("l_linenumber > 5").groupBy("k").count().filter(
        "count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    assert max(parts) < 0.25 * sum(parts)


def test_uri_paths_resolve(spark):
    from tessera.sources.catalog import TableResolver
    resolver = TableResolver(spark, "file:///root/testdata/sf0.001")
    assert resolver.exists("orders") and not resolver.exists("no_such_table")
    assert resolver("region").count() == 5


def test_unify_job_appends_once_and_drops(spark, scratch_dir):
    from tessera.plans.ledger import unify_job
    from tessera.schemas import TABLES_SCHEMA
    from tessera.sources.catalog import TableResolver
    from tessera.sources.ledger_store import EVIDENCES, TABLES, Store
    store = Store(spark, f"{scratch_dir}/ledger")
    row = dict.fromkeys([f.name for f in TABLES_SCHEMA.fields], "x")
    store.append(TABLES, spark.createDataFrame([row | {"table_id": "T1", "staging_evidences_table": "stg_one"},
                                                row | {"table_id": "T2", "staging_evidences_table": "stg_absent"}], TABLES_SCHEMA))
    staged = spark.createDataFrame([("r1", "e1", "V", "a", "1"), ("r2", "e1", "V", "a", "1"), ("r3", "e1", "V", None, "2")],
                                   "evidence_id string, execution_id string, validation_id string, failed_value string, table_pk string")
    staged = staged.withColumn("execution_date", F.lit("2024-01-01").cast("date"))
    staged.write.mode("overwrite").saveAsTable("stg_one")
    assert unify_job(spark, store, TableResolver(spark)) == {"tables": 1, "appended": 2}
    assert not spark.catalog.tableExists("stg_one")
    again = TableResolver(spark, frames={"stg_one": staged})
    assert unify_job(spark, store, again) == {"tables": 1, "appended": 0}
    assert store.read(EVIDENCES).select("evidence_id").distinct().count() == 2


def _without_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("-1", "false", "32")):
        spark.conf.set(k, v)
    return old


def _shuffled_rows(spark, df) -> int:
    """Rows written to exchanges by ``df``'s final plan (its SQL metrics)."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "ResultQueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_foreign_key_does_not_shuffle_the_checked_rows(spark):
    """A reference beyond broadcast: orphans are told by the sketch, hits by
    their distinct keys; half of the rows share one orphan key."""
    from tessera.operators.dataset_rules import foreign_key
    from tessera.sources.catalog import TableResolver
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").withColumn(
        "k", F.expr("CASE WHEN l_linenumber <= 3 THEN -1 WHEN l_linenumber = 7 THEN NULL ELSE l_orderkey % 2000 END"))
    params = {"columns": ["k"], "ref_columns": ["o_orderkey"], "ref_table": "orders"}
    ctx = RuleContext(spark, TableResolver(spark, frames={"orders": orders}))
    want = lines.join(orders.select("o_orderkey"), F.expr("k = o_orderkey"), "left_anti").where("k IS NOT NULL").count()
    checked = lines.where("k IS NOT NULL").count()
    assert foreign_key(lines, params, ctx).count() == want > 0
    old = _without_broadcast(spark)
    try:
        out = foreign_key(lines, params, ctx)
        assert out.columns == lines.columns and out.count() == want
        assert _shuffled_rows(spark, foreign_key(lines, params, ctx)) < 0.75 * checked
        from tessera.operators import sketch
        bits, sketch.FILTER_BITS = sketch.FILTER_BITS, 64       # a sketch that tells nothing
        try:
            parts = foreign_key(lines, params, ctx)
            assert sorted(map(repr, parts.collect())) == sorted(map(repr, out.collect()))
        finally:
            sketch.FILTER_BITS = bits
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_salts_do_not_depend_on_row_order(spark):
    """The semi join of hot keys gives the same rows however they are dealt."""
    from tessera.operators.dataset_rules import is_unique
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").withColumn("k", F.expr("concat('key ', l_linenumber % 3)"))
    old = _without_broadcast(spark)
    try:
        for n in (1, 7, 40):
            out = is_unique(df.repartition(n), {"columns": ["k"]}, RuleContext(spark))
            assert "monotonically_increasing_id" not in out._jdf.queryExecution().optimizedPlan().toString()
            assert out.count() == df.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
