"""Registered queries for whole jobs and for the cases that lose results
easily: keys with separators and NULLs, hot keys, query rows without a
perimeter row, foreign evidence ids, runs with raising or skipped validations,
histories written back, late evidence, event logs with lost runs.
``SQL`` has the DuckDB statement of each, written on its own."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.uniqueness import UniqueRule, is_unique_many as _unique_many
from tessera.plans.config import shape_validations, sync_config
from tessera.plans.history import persistence_job
from tessera.plans.ledger import unify_job as _unify_job
from tessera.plans.persistence import execution_states as _execution_states
from tessera.plans.run import Runner
from tessera.session import scratch_path
from tessera.sources.catalog import TableResolver
from tessera.sources.ledger_store import EVIDENCES, EXECUTIONS, RESULTS, TABLES as TABLES_CONFIG, VALIDATIONS as VALIDATIONS_CONFIG, Store
from tessera.suite import _ctx, _custom_rules, _dedup, _failing, _pk_value, _staged_lineitem, _t, _validations_sheet
from tessera.suite_sql import NAMES_26, REQUIRED, _comma_list, _pk, _pv, _sha

# ---- keys -----------------------------------------------------------------
ODD_PARTS = "CASE s_suppkey % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN 'a' WHEN 2 THEN 'c\\\\N' ELSE NULL END AS k1"
ODD_REST = "CASE s_suppkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN 'b|c' WHEN 2 THEN '\\\\' ELSE s_name END AS k2"


def pk_text_composite(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "supplier").selectExpr("*", ODD_PARTS, ODD_REST)
    return _pk_value(_failing(df, "is_not_less_than", {"column": "s_acctbal", "limit": 5000.0}, "k1, k2, s_nationkey", _ctx(spark, sf)))


def dedup_foreign_ids(spark: SparkSession, sf: str) -> DataFrame:
    staged = _staged_lineitem(spark, sf).withColumn("evidence_id", F.sha2(F.monotonically_increasing_id().cast("string"), 256))
    return _dedup(staged).select("evidence_id", "execution_id", "validation_id", "table_pk", "failed_value")


# ---- rules ----------------------------------------------------------------
def is_in_list_decimal(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "orders").withColumn("d", F.expr("CAST(12345678901234000 + o_orderkey + 0.89 AS DECIMAL(20,2))"))
    allowed = [f"{12345678901234000 + i}.89" for i in range(1, 400)]
    return _pk_value(_failing(df, "is_in_list", {"column": "d", "allowed": allowed}, "o_orderkey", _ctx(spark, sf)))


def is_unique_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem").withColumn("k", F.expr("IF(l_linenumber <= 4, 0, l_orderkey * 10 + l_linenumber)"))
    return _pk_value(_failing(df, "is_unique", {"columns": ["k"]}, "l_orderkey, l_linenumber", _ctx(spark, sf)))


UNIQUE_RULES = {"U1": (["l_partkey", "l_suppkey"], None), "U2": (["l_extendedprice"], "l_returnflag <> 'N'"),
                "U3": (["l_shipdate", "l_quantity", "l_partkey"], None), "U4": (["l_orderkey", "l_linenumber"], None), "U5": (["k"], None)}
_HOT_KEY = "IF(l_linenumber <= 4, 0, l_orderkey * 10 + l_linenumber)"


def is_unique_many(spark: SparkSession, sf: str) -> DataFrame:
    """Five uniqueness rules in one plan: composite and date keys, a perimeter,
    a rule that passes, a key of most rows."""
    df = _t(spark, sf, "lineitem").withColumn("k", F.expr(_HOT_KEY))
    rules = [UniqueRule(v, columns, F.col(columns[0]).cast("string"), None if where is None else F.expr(where))
             for v, (columns, where) in UNIQUE_RULES.items()]
    return _unique_many(df, rules, "l_orderkey, l_linenumber")


def foreign_key_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "lineitem").withColumn("k", F.expr("IF(l_linenumber <= 4, -1, l_orderkey)"))
    return _pk_value(_failing(df, "foreign_key", {"columns": ["k"], "ref_columns": ["o_orderkey"], "ref_table": "orders"},
                              "l_orderkey, l_linenumber", _ctx(spark, sf)))


def sql_query_null_key(spark: SparkSession, sf: str) -> DataFrame:
    df = _t(spark, sf, "customer").withColumn("nk", F.expr("nullif(c_nationkey, 7)"))
    df.createOrReplaceTempView("tessera_null_keys")
    query = "SELECT nk FROM tessera_null_keys WHERE nk IS NULL OR nk = 3 UNION ALL SELECT 99"
    return _pk_value(_failing(df, "sql_query", {"query": query, "merge_columns": ["nk"]}, "c_custkey", _ctx(spark, sf)))


# ---- jobs -----------------------------------------------------------------
TABLES = [{"table_id": "T1", "table_name": "customers", "table_name_tech": "customers", "domain": "crm",
           "primary_key": "c_custkey", "staging_evidences_table": ""}]
RULES = [("R1", "is_not_less_than", "ROW"), ("R2", "is_in_list", "ROW"), ("R3", "is_not_null", "ROW"), ("R4", "is_unique", "DATASET")]
# id, rule, columns, min, list, perimeter
VALIDATIONS = [("C1", "R1", "c_acctbal", "0", "", ""), ("C2", "R2", "c_mktsegment", "", "MACHINERY, FURNITURE, HOUSEHOLD", ""),
               ("C3", "R3", "c_name", "", "", "CAST(c_name AS INT) > 0"), ("C4", "R4", "c_name", "", "", "c_nationkey < 20")]
LATER = """CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 500 ELSE c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 5 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS c_mktsegment"""


def _sheets(spark: SparkSession) -> dict[str, DataFrame]:
    names = {r: n for r, n, _ in RULES}
    blank = {c: "" for c in ("param_value", "param_max", "param_expression", "param_data_type", "param_query", "param_merge_columns", "tags")}
    return {
        "tables": spark.createDataFrame(TABLES),
        "rules": spark.createDataFrame([dict(
            rule_id=r, technical_rule_name=n, functional_name=n, description="", rule_level=level, dimension_dq="validity",
            implementation_type="BUILT-IN", requires_literal_conversion="", tags="", type_rule="", owner="dq", updated_by="suite")
            for r, n, level in RULES]),
        "validations": spark.createDataFrame([blank | dict(
            validation_id=v, rule_id=r, table_id="T1", perimeter_definition=p, is_active="true", severity="high",
            technical_name=names[r], rule_type="BUILT-IN", param_columns=c, param_min=low, param_set=allowed, owner="dq",
            updated_by="suite", table_domain="crm") for v, r, c, low, allowed, p in VALIDATIONS])}


def _three_runs(spark: SparkSession, sf: str) -> tuple[Store, str]:
    """Sync, then a full run, a run of C1 alone, and a full run on changed
    customers; the store and the id of the last execution."""
    store = Store(spark, scratch_path(spark, f"suite-jobs-{uuid.uuid4().hex}"))
    sync_config(store, **_sheets(spark))
    first = _t(spark, sf, "customer")
    resolver = TableResolver(spark, frames={"customers": first})
    runner = Runner(spark, store, resolver, _custom_rules(spark))
    runner.run("customers", now=datetime(2024, 1, 1))
    runner.run("customers", validation_id="C1", now=datetime(2024, 1, 2))
    resolver.register("customers", first.selectExpr("c_custkey", "c_name", "c_nationkey", *LATER.split(",\n")))
    return store, runner.run("all", now=datetime(2024, 1, 3)).execution_id


def run_evidence(spark: SparkSession, sf: str) -> DataFrame:
    store, last = _three_runs(spark, sf)
    return store.read(EVIDENCES).filter(F.col("execution_id") == last).select("validation_id", "table_pk", "failed_value", "is_new_failure")


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    store, last = _three_runs(spark, sf)
    return store.read(RESULTS).filter(F.col("execution_id") == last).select(
        "validation_id", "rule_id", "status", "perimeter", "failed_records_count", "new_failures", "persistent_failures", "resolved_failures")


def run_executions(spark: SparkSession, sf: str) -> DataFrame:
    store, _ = _three_runs(spark, sf)
    return store.read(EXECUTIONS).select("table_id", F.col("execution_date").cast("string").alias("day"), "status",
                                         F.col("validations_executed").cast("int").alias("executed"),
                                         F.col("validations_failed").cast("int").alias("failed"),
                                         F.col("validations_errors").cast("int").alias("errors"))


# ---- definitions ----------------------------------------------------------
DATA_TYPE = "CASE p_partkey % 4 WHEN 0 THEN 'Number' WHEN 1 THEN ' date ' WHEN 2 THEN 'timestamp' ELSE 'text' END"
AGGREGATE = "CASE p_partkey % 3 WHEN 0 THEN 'avg' WHEN 1 THEN ' MAX ' ELSE 'median' END"
MERGE = "CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'a, b' ELSE 'a' END"


def definition_errors(spark: SparkSession, sf: str) -> DataFrame:
    """The parse outcome of every validation of a sheet with wrong numbers,
    dates, aggregates, lists and limits."""
    odd = _t(spark, sf, "part").selectExpr("concat('V', p_partkey) AS validation_id", f"{DATA_TYPE} AS param_data_type",
                                           f"{AGGREGATE} AS param_expression", f"{MERGE} AS param_merge_columns")
    sheet = _validations_sheet(spark, sf).drop("param_data_type", "param_expression", "param_merge_columns").join(odd, "validation_id")
    return shape_validations(sheet).select("validation_id", "definition_error")


# ---- history --------------------------------------------------------------
# a ledger of one execution per quarter, in which some validations ended in an
# error, one execution failed as a whole, and no flag or counter is filled yet
QUARTER = "date_trunc('quarter', l_shipdate)"
UNFINISHED = "DATE '1995-04-01'"
NO_VERDICT = "validation_id = 'V_R' AND month(execution_date) = 7"


def _history_store(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, scratch_path(spark, f"suite-history-{uuid.uuid4().hex}"))
    lines = _t(spark, sf, "lineitem").selectExpr(
        f"CAST({QUARTER} AS DATE) AS execution_date", "'V_' || l_returnflag AS validation_id", "CAST(l_suppkey AS STRING) AS table_pk",
        "CAST(l_linenumber AS STRING) AS failed_value", "l_quantity").withColumn("execution_id", F.col("execution_date").cast("string"))
    runs = lines.select("execution_id", "execution_date").distinct()
    store.append(EXECUTIONS, runs.selectExpr(
        "*", "'T1' AS table_id", "CAST(execution_date AS TIMESTAMP) AS execution_timestamp",
        f"IF(execution_date = {UNFINISHED}, 'ERROR', 'FAILED') AS status").coalesce(1))
    verdicts = lines.select("execution_id", "execution_date", "validation_id").distinct()
    store.append(RESULTS, verdicts.selectExpr(
        "*", "execution_id || validation_id AS validation_trace_id", "'R' AS rule_id", f"IF({NO_VERDICT}, 'ERROR', 'FAILED') AS status").coalesce(1))
    found = lines.where("l_quantity > 45").drop("l_quantity").distinct()
    # by days, large ones split: a file or a few of each, and no task of all rows
    store.append(EVIDENCES, found.selectExpr("*", "uuid() AS evidence_id").hint("rebalance", "execution_date"))
    store.replace(VALIDATIONS_CONFIG, verdicts.select("validation_id").distinct().selectExpr("*", "'T1' AS table_id", "'R' AS rule_id", "'{}' AS validation_definition"))
    return store


def persistence_history(spark: SparkSession, sf: str) -> DataFrame:
    """The flags of all evidence after the write-back job."""
    store = _history_store(spark, sf)
    persistence_job(spark, store)
    return store.read(EVIDENCES).select("execution_id", "validation_id", "table_pk", "failed_value", "is_new_failure")


def persistence_history_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counters of all verdicts after the write-back job."""
    store = _history_store(spark, sf)
    persistence_job(spark, store)
    return store.read(RESULTS).select("execution_id", "validation_id", "status", "new_failures", "persistent_failures", "resolved_failures")


def unify_job(spark: SparkSession, sf: str) -> DataFrame:
    """Two staged tables, one of an execution that the ledger holds already."""
    folder = scratch_path(spark, f"suite-unify-{uuid.uuid4().hex}")
    store, resolver = Store(spark, f"{folder}/store"), TableResolver(spark, f"{folder}/staged")
    staged = _t(spark, sf, "lineitem").where("l_quantity > 30").selectExpr(
        "uuid() AS evidence_id", "'exec-' || l_returnflag AS execution_id", "'V_QTY' AS validation_id", "CAST(l_orderkey AS STRING) AS table_pk",
        "CAST(l_linenumber AS STRING) AS failed_value", "CASE l_returnflag WHEN 'A' THEN DATE '2024-01-01' WHEN 'N' THEN DATE '2024-01-02' END AS execution_date")
    held, fresh = "execution_id = 'exec-A'", "execution_id <> 'exec-A'"
    store.append(EVIDENCES, staged.where(held).dropDuplicates(["table_pk", "failed_value"]).withColumn("is_new_failure", F.lit(True)))
    staged.where(held).write.parquet(f"{folder}/staged/stg_a.parquet")
    staged.where(fresh).unionByName(staged.where(fresh)).write.parquet(f"{folder}/staged/stg_b.parquet")
    names = spark.createDataFrame([(f"T{i}", f"t{i}", f"t{i}", "k", n) for i, n in enumerate(("stg_a", "stg_b", "stg_absent"))],
                                  "table_id string, table_name string, table_name_tech string, primary_key string, staging_evidences_table string")
    store.replace(TABLES_CONFIG, names)
    _unify_job(spark, store, resolver)
    return store.read(EVIDENCES).groupBy("execution_id", "validation_id", "table_pk", "failed_value").agg(
        F.count(F.lit(1)).alias("rows_held"), F.count("is_new_failure").alias("flagged"))


# orders as executions: all start, some end, some start again a day later
STARTED = "CAST(o_orderdate AS TIMESTAMP)"
SECONDS = "o_orderkey % 5000"
ENDED, AGAIN = "o_orderstatus <> 'P'", "o_orderkey % 7 = 0"
STATE_CLOCK = datetime(1998, 8, 3)


def execution_states(spark: SparkSession, sf: str) -> DataFrame:
    orders = _t(spark, sf, "orders")
    ids = "CAST(o_orderkey AS STRING) AS execution_id", "CAST(o_custkey AS STRING) AS table_id"
    end = f"{STARTED} + make_dt_interval(0, 0, 0, {SECONDS})"
    events = (orders.selectExpr(*ids, "'START' AS event", f"{STARTED} AS event_timestamp", "CAST(NULL AS STRING) AS status")
              .unionByName(orders.where(ENDED).selectExpr(*ids, "'END' AS event", f"{end} AS event_timestamp",
                                                          "IF(o_orderstatus = 'F', 'FAILED', 'SUCCESS') AS status"))
              .unionByName(orders.where(AGAIN).selectExpr(*ids, "'START' AS event", f"{STARTED} + INTERVAL 1 DAY AS event_timestamp",
                                                          "CAST(NULL AS STRING) AS status")))
    return _execution_states(events, STATE_CLOCK, lost_after_hours=24 * 1000).select(
        "execution_id", "table_id", F.col("started_at").cast("date").cast("string").alias("started"), F.col("seconds").cast("double").alias("seconds"), "state")


QUERIES = {f.__name__: f for f in (definition_errors, is_unique_many, persistence_history, persistence_history_counts, unify_job, execution_states, pk_text_composite, dedup_foreign_ids, is_in_list_decimal, is_unique_hot, foreign_key_hot,
                                   sql_query_null_key, run_evidence, run_results, run_executions)}

_ODD = f"(SELECT *, {ODD_PARTS}, {ODD_REST} FROM supplier)".replace("\\\\", "\\")
_LI = _pk("l_orderkey", "l_linenumber")
_HOT = "(SELECT *, CASE WHEN l_linenumber <= 4 THEN 0 ELSE l_orderkey * 10 + l_linenumber END AS k FROM lineitem)"
_LOST = "(SELECT *, CASE WHEN l_linenumber <= 4 THEN -1 ELSE l_orderkey END AS k FROM lineitem)"
_DECIMAL = "(SELECT *, CAST(12345678901234000 + o_orderkey + CAST(0.89 AS DECIMAL(3,2)) AS DECIMAL(20,2)) AS d FROM orders)"


def _verdicts(source: str) -> str:
    return f"""SELECT 'C1' AS validation_id, CAST(c_custkey AS VARCHAR) AS table_pk, CAST(c_acctbal AS VARCHAR) AS failed_value
        FROM {source} WHERE c_acctbal < 0
        UNION ALL SELECT 'C2', CAST(c_custkey AS VARCHAR), c_mktsegment FROM {source}
        WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'HOUSEHOLD')
        UNION ALL SELECT 'C4', CAST(c_custkey AS VARCHAR), c_name FROM {source} WHERE c_nationkey < 20 AND c_name IN
        (SELECT c_name FROM {source} WHERE c_nationkey < 20 GROUP BY c_name HAVING count(*) > 1)"""


_RUNS = f"""WITH later AS (SELECT c_custkey, c_name, c_nationkey, {LATER} FROM customer),
    old AS ({_verdicts('customer')}), cur AS ({_verdicts('later')}),
    flagged AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM old o WHERE o.validation_id = c.validation_id AND o.table_pk = c.table_pk
                AND o.failed_value = c.failed_value) AS is_new_failure FROM cur c),
    gone AS (SELECT * FROM old EXCEPT SELECT * FROM cur)"""

def _definition_errors() -> str:
    quote = "chr(39)"

    def wrong(param: str, text: str) -> str:
        return f"""CASE WHEN {text} <> '' AND CASE kind WHEN 'number' THEN TRY_CAST({text} AS DOUBLE) IS NULL WHEN 'date' THEN TRY_CAST({text} AS DATE) IS NULL
                   WHEN 'timestamp' THEN TRY_CAST({text} AS TIMESTAMP) IS NULL ELSE false END
                   THEN '{param} ' || {quote} || {text} || {quote} || ' is not a ' || kind END"""

    val, vmin, vmax = "val <> ''", "vmin <> ''", "vmax <> ''"
    filled = {"column": "len(col_list) > 0", "columns": "len(col_list) > 0", "allowed": "len(set_list) > 0", "regex": val, "value": val, "limit": val,
              "min_limit|max_limit": f"({vmin} OR {vmax})", "expression": "true", "query": "true", "merge_columns": "len(merge_list) > 0",
              "ref_table": val, "expected_schema": "cols <> ''"}
    limits = {"is_not_less_than": vmin, "is_not_greater_than": vmax}
    missing = [f"CASE WHEN tn = '{rule}' AND NOT {limits[rule] if g == 'limit' and rule in limits else filled[g]} THEN 'missing {g}' END"
               for rule, groups in REQUIRED.items() for g in groups]
    checks = [("'is_in_range', 'is_not_in_range'", [wrong("min_limit", "vmin"), wrong("max_limit", "vmax"),
               "CASE WHEN TRY_CAST(vmin AS DOUBLE) > TRY_CAST(vmax AS DOUBLE) THEN 'min_limit above max_limit' END"]),
              ("'is_not_less_than'", [wrong("limit", "vmin")]), ("'is_not_greater_than'", [wrong("limit", "vmax")]),
              ("'is_equal_to', 'is_not_equal_to'", [wrong("value", "val")]),
              ("'is_aggr_not_greater_than', 'is_aggr_not_less_than', 'is_aggr_equal', 'is_aggr_not_equal'",
               [f"CASE WHEN agg = 'median' THEN 'unknown aggr_type ' || {quote} || agg || {quote} END", wrong("limit", "val")]),
              ("'is_in_list', 'is_not_null_and_is_in_list'",
               [f"nullif(array_to_string(list_filter(list_transform(set_list, lambda x: {wrong('allowed', 'x')}), lambda e: e IS NOT NULL), '; '), '')"]),
              ("'foreign_key', 'compare_datasets'",
               ["CASE WHEN len(merge_list) > 0 AND len(merge_list) <> len(col_list) THEN 'columns and ref_columns differ in length' END"])]
    parsed = [f"CASE WHEN tn IN ({names}) THEN {c} END" for names, cs in checks for c in cs]
    return f"""WITH s AS (SELECT 'V' || CAST(p_partkey AS VARCHAR) AS validation_id, ({NAMES_26})[CAST((p_size - 1) % 26 + 1 AS INTEGER)] AS tn,
            CASE WHEN p_type = 'PROMO' THEN 'CUSTOM' WHEN p_type = 'SMALL' AND p_size > 40 THEN 'other' ELSE 'BUILT-IN' END AS rt,
            CASE WHEN p_type = 'STANDARD' THEN ' p_name, p_brand ,, ' WHEN p_type = 'ECONOMY' THEN '' ELSE 'p_name' END AS cols,
            CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand ELSE CAST(p_retailprice AS VARCHAR) END AS val,
            CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) WHEN p_size > 10 THEN 'abc' ELSE '' END AS vmin,
            CASE WHEN p_size < 30 THEN CAST(p_size * 10 AS VARCHAR) ELSE '' END AS vmax,
            {_comma_list("(replace(p_name, ' ', ', ') || ', , ')")} AS set_list, {_comma_list(MERGE)} AS merge_list,
            lower(trim({DATA_TYPE})) AS kind, lower(trim({AGGREGATE})) AS agg FROM part),
        l AS (SELECT *, {_comma_list('cols')} AS col_list FROM s)
        SELECT validation_id, nullif(CASE rt WHEN 'BUILT-IN' THEN concat_ws('; ', {', '.join(missing + parsed)})
               WHEN 'CUSTOM' THEN CASE WHEN len(col_list) = 0 THEN 'missing columns' ELSE '' END ELSE '' END, '') AS definition_error FROM l"""


_HISTORY = f"""WITH li AS (SELECT CAST({QUARTER} AS DATE) AS execution_date, 'V_' || l_returnflag AS validation_id,
            CAST(l_suppkey AS VARCHAR) AS table_pk, CAST(l_linenumber AS VARCHAR) AS failed_value, l_quantity FROM lineitem),
        ev AS (SELECT DISTINCT CAST(execution_date AS VARCHAR) AS execution_id, validation_id, table_pk, failed_value FROM li WHERE l_quantity > 45),
        q AS (SELECT DISTINCT CAST(execution_date AS VARCHAR) AS execution_id, execution_date, validation_id, {NO_VERDICT} AS broken FROM li),
        v AS (SELECT execution_id, validation_id, lag(execution_id) OVER (PARTITION BY validation_id ORDER BY execution_id) AS before
              FROM q WHERE NOT broken AND execution_date <> {UNFINISHED})"""

SQL = {
    "pk_text_composite": _pv(_pk("k1", "k2", "s_nationkey"), "CAST(s_acctbal AS VARCHAR)", _ODD, "s_acctbal < 5000"),
    "dedup_foreign_ids": f"""WITH s AS (SELECT 'exec-' || l_linestatus AS execution_id, 'V_LSTAT' AS validation_id,
            {_LI} AS table_pk, l_linestatus AS failed_value FROM lineitem WHERE l_linestatus <> 'O')
        SELECT DISTINCT {_sha('execution_id', 'validation_id', 'table_pk', 'failed_value')} AS evidence_id,
               execution_id, validation_id, table_pk, failed_value FROM s""",
    "is_in_list_decimal": _pv(_pk("o_orderkey"), "CAST(d AS VARCHAR)", _DECIMAL,
                              "d NOT IN (SELECT CAST((12345678901234000 + i) || '.89' AS DECIMAL(20,2)) FROM range(1, 400) r(i))"),
    "is_unique_hot": _pv(_LI, "CAST(k AS VARCHAR)", _HOT, f"k IN (SELECT k FROM {_HOT} GROUP BY k HAVING count(*) > 1)"),
    "definition_errors": _definition_errors(),
    "is_unique_many": " UNION ALL ".join(
        f"""SELECT '{v}' AS validation_id, {_LI} AS table_pk, CAST({columns[0]} AS VARCHAR) AS failed_value
            FROM (SELECT *, count(*) OVER (PARTITION BY {', '.join(columns)}) AS met FROM {_HOT} WHERE {where or 'TRUE'}) WHERE met > 1"""
        for v, (columns, where) in UNIQUE_RULES.items()),
    "foreign_key_hot": _pv(_LI, "CAST(k AS VARCHAR)", _LOST, "k NOT IN (SELECT o_orderkey FROM orders)"),
    "sql_query_null_key": """SELECT CAST(c_custkey AS VARCHAR) AS table_pk, CAST(c_custkey AS VARCHAR) AS failed_value
        FROM customer WHERE c_nationkey IN (3, 7) UNION ALL SELECT NULL, NULL""",
    "run_evidence": f"{_RUNS} SELECT validation_id, table_pk, failed_value, is_new_failure FROM flagged",
    "run_results": f"""{_RUNS}, v AS (SELECT * FROM (VALUES ('C1', 'R1'), ('C2', 'R2'), ('C3', 'R3'), ('C4', 'R4')) t(validation_id, rule_id)),
        n AS (SELECT v.*, (SELECT count(*) FROM flagged f WHERE f.validation_id = v.validation_id) AS bad,
              (SELECT count(*) FROM flagged f WHERE f.validation_id = v.validation_id AND f.is_new_failure) AS fresh,
              (SELECT count(*) FROM gone g WHERE g.validation_id = v.validation_id) AS gone FROM v)
        SELECT validation_id, rule_id, CASE WHEN validation_id = 'C3' THEN 'ERROR' WHEN bad > 0 THEN 'FAILED' ELSE 'PASSED' END AS status,
               CASE validation_id WHEN 'C3' THEN 0 WHEN 'C4' THEN (SELECT count(*) FROM customer WHERE c_nationkey < 20)
                    ELSE (SELECT count(*) FROM customer) END AS perimeter,
               bad AS failed_records_count, fresh AS new_failures, bad - fresh AS persistent_failures, gone AS resolved_failures FROM n""",
    "run_executions": f"""{_RUNS}, b AS (SELECT (SELECT count(DISTINCT validation_id) FROM old) AS n_old,
            (SELECT count(DISTINCT validation_id) FROM cur) AS n_cur, (SELECT count(*) FROM old WHERE validation_id = 'C1') AS n_c1)
        SELECT 'T1' AS table_id, '2024-01-01' AS day, 'FAILED' AS status, 4 AS executed, CAST(n_old AS INTEGER) AS failed, 1 AS errors FROM b
        UNION ALL SELECT 'T1', '2024-01-02', CASE WHEN n_c1 > 0 THEN 'FAILED' ELSE 'SUCCESS' END, 1, CAST(n_c1 > 0 AS INTEGER), 0 FROM b
        UNION ALL SELECT 'T1', '2024-01-03', 'FAILED', 4, CAST(n_cur AS INTEGER), 1 FROM b""",
    "persistence_history": f"""{_HISTORY}
        SELECT ev.execution_id, ev.validation_id, table_pk, failed_value,
               CASE WHEN v.execution_id IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM ev o WHERE o.validation_id = ev.validation_id
                    AND o.execution_id = v.before AND o.table_pk = ev.table_pk AND o.failed_value = ev.failed_value) END AS is_new_failure
        FROM ev LEFT JOIN v ON v.execution_id = ev.execution_id AND v.validation_id = ev.validation_id""",
    "persistence_history_counts": f"""{_HISTORY},
        here AS (SELECT v.execution_id, v.validation_id, count(*) AS n, count(o.table_pk) AS n_old
                 FROM v JOIN ev ON ev.execution_id = v.execution_id AND ev.validation_id = v.validation_id
                 LEFT JOIN ev o ON o.validation_id = v.validation_id AND o.execution_id = v.before AND o.table_pk = ev.table_pk
                      AND o.failed_value = ev.failed_value GROUP BY ALL),
        old AS (SELECT execution_id, validation_id, count(*) AS n FROM ev GROUP BY ALL)
        SELECT q.execution_id, q.validation_id, CASE WHEN q.broken THEN 'ERROR' ELSE 'FAILED' END AS status,
               CASE WHEN v.execution_id IS NOT NULL THEN coalesce(here.n - here.n_old, 0) END AS new_failures,
               CASE WHEN v.execution_id IS NOT NULL THEN coalesce(here.n_old, 0) END AS persistent_failures,
               CASE WHEN v.execution_id IS NOT NULL THEN coalesce(old.n, 0) - coalesce(here.n_old, 0) END AS resolved_failures
        FROM q LEFT JOIN v USING (execution_id, validation_id) LEFT JOIN here USING (execution_id, validation_id)
        LEFT JOIN old ON old.validation_id = v.validation_id AND old.execution_id = v.before""",
    "unify_job": """SELECT DISTINCT 'exec-' || l_returnflag AS execution_id, 'V_QTY' AS validation_id, CAST(l_orderkey AS VARCHAR) AS table_pk,
            CAST(l_linenumber AS VARCHAR) AS failed_value, CAST(1 AS BIGINT) AS rows_held, CAST(CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS BIGINT) AS flagged
        FROM lineitem WHERE l_quantity > 30""",
    "execution_states": f"""SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, CAST(o_custkey AS VARCHAR) AS table_id,
            CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS started,
            CASE WHEN {ENDED} AND NOT ({AGAIN}) THEN CAST({SECONDS} AS DOUBLE) END AS seconds,
            CASE WHEN {ENDED} AND NOT ({AGAIN}) THEN CASE o_orderstatus WHEN 'F' THEN 'FAILED' ELSE 'SUCCESS' END
                 WHEN CAST(o_orderdate AS TIMESTAMP) + CASE WHEN {AGAIN} THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
                      < TIMESTAMP '1998-08-03' - INTERVAL 1000 DAY THEN 'LOST' ELSE 'RUNNING' END AS state
        FROM orders""",
}
