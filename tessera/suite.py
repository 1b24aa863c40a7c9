"""Registered queries: every operator of the engine applied to the shared
test tables (or data Spark derives from them), whole tables throughout.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
column names match the DuckDB statement of the same key in ``suite_sql``.
Derived inputs (blanked names, corrupted ids, changed snapshots, config
sheets built from table rows) are computed by Spark from the tables, so the
work of every query grows with the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import evidence_id
from tessera.functions.lists import split_tags
from tessera.functions.national_id import CONTROL_LETTERS
from tessera.operators import RuleContext
from tessera.operators.custom import default_custom_rules
from tessera.operators.upsert import conditional_update as _conditional_update
from tessera.operators.upsert import reflect, update_matched, upsert
from tessera.plans import persistence as P
from tessera.plans.config import (
    active_validations,
    build_definition as _build_definition,
    definition_problems,
    shape_validations,
    validation_plan as _validation_plan,
)
from tessera.plans.ledger import dedup_evidences as _dedup, stage, unify_evidences as _unify
from tessera.plans.run import table_totals
from tessera.plans.validate import Validation, evidence, prepare, results, row_evidence
from tessera.sources.catalog import TableResolver

# The 25 built-in rule names, in inventory order.
RULE_NAMES = [
    "is_not_null", "is_not_empty", "is_not_null_and_not_empty", "is_not_in_future",
    "is_in_list", "is_not_null_and_is_in_list", "regex_match", "is_equal_to",
    "is_not_equal_to", "is_valid_date", "is_valid_timestamp", "is_in_range",
    "is_not_in_range", "is_not_less_than", "is_not_greater_than", "sql_expression",
    "is_unique", "sql_query", "is_aggr_not_greater_than", "is_aggr_not_less_than",
    "is_aggr_equal", "is_aggr_not_equal", "foreign_key", "has_valid_schema",
    "compare_datasets",
]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _ctx(spark, sf, frames=None, literal=(), as_of=None) -> RuleContext:
    return RuleContext(spark, TableResolver(spark, sf, frames or {}), frozenset(literal), as_of)


def _failing(df: DataFrame, rule: str, params: dict, pk: str, ctx: RuleContext,
             perimeter: str | None = None, implementation: str = "BUILT-IN",
             vid: str = "V") -> DataFrame:
    """Evidence (validation_id, table_pk, failed_value) of one validation;
    raises when the validation does not analyse."""
    custom = _custom_rules(ctx.spark) if implementation == "CUSTOM" else None
    v = Validation(vid, rule, params, perimeter=perimeter, implementation=implementation)
    prepared = prepare(df, [v], pk, ctx, custom)
    if prepared[0].kind == "error":
        raise ValueError(prepared[0].error)
    return evidence(df, prepared, pk)


_CUSTOM: dict = {}


def _custom_rules(spark: SparkSession):
    """Default custom-rule registry, registered once per session."""
    key = id(spark)
    if key not in _CUSTOM or not spark.catalog.functionExists("is_valid_nif_es"):
        _CUSTOM[key] = default_custom_rules(spark)
    return _CUSTOM[key]


def _pk_value(df: DataFrame) -> DataFrame:
    return df.select("table_pk", "failed_value")


# ---------------------------------------------------------------- M0 -----
EVENT_RULES = [
    Validation("E1", "is_in_range", {"column": "value", "min_limit": 1.0, "max_limit": 300.0}),
    Validation("E2", "is_in_list", {"column": "event_type", "allowed": ["view", "click", "purchase"]}),
    Validation("E3", "regex_match", {"column": "props", "regex": r'^\{"k": [0-9]{1,2}\}$'}),
]


def row_rules_single_pass(spark, sf):
    """Three row rules over events in one scan."""
    df = _t(spark, sf, "events")
    prepared = prepare(df, EVENT_RULES, "event_id", _ctx(spark, sf))
    return row_evidence(df, prepared, "event_id")


# ---------------------------------------------------------------- M1 -----
def _docs_labels(spark, sf):
    return _t(spark, sf, "documents").select("doc_id").join(
        _t(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")


def _part_blanked(spark, sf):
    p = _t(spark, sf, "part")
    return p.withColumn("p_name_d", F.when(F.col("p_size") <= 3, F.lit(""))
                        .when(F.col("p_size") <= 6, F.lit(None).cast("string"))
                        .otherwise(F.col("p_name")))


def is_not_null(spark, sf):
    return _pk_value(_failing(_docs_labels(spark, sf), "is_not_null", {"column": "quality"}, "doc_id", _ctx(spark, sf)))


def is_not_empty(spark, sf):
    return _pk_value(_failing(_part_blanked(spark, sf), "is_not_empty", {"column": "p_name_d"}, "p_partkey",
                              _ctx(spark, sf)))


def is_not_null_and_not_empty(spark, sf):
    return _pk_value(_failing(_part_blanked(spark, sf), "is_not_null_and_not_empty", {"column": "p_name_d"},
                              "p_partkey", _ctx(spark, sf)))


def is_not_in_future(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "orders"), "is_not_in_future", {"column": "o_orderdate"},
                              "o_orderkey", _ctx(spark, sf, as_of="2001-01-01 00:00:00")))


def is_in_list(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "orders"), "is_in_list",
                              {"column": "o_orderstatus", "allowed": ["F", "O"]}, "o_orderkey", _ctx(spark, sf)))


def is_not_null_and_is_in_list(spark, sf):
    return _pk_value(_failing(_docs_labels(spark, sf), "is_not_null_and_is_in_list",
                              {"column": "toxic", "allowed": ["0"]}, "doc_id", _ctx(spark, sf)))


def regex_match(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "part"), "regex_match",
                              {"column": "p_brand", "regex": r"^Brand#[0-9]$"}, "p_partkey", _ctx(spark, sf)))


def is_equal_to(spark, sf):
    ctx = _ctx(spark, sf, literal={"is_equal_to"})
    return _pk_value(_failing(_t(spark, sf, "customer"), "is_equal_to",
                              {"column": "c_mktsegment", "value": "BUILDING"}, "c_custkey", ctx))


def is_not_equal_to(spark, sf):
    ctx = _ctx(spark, sf, literal={"is_not_equal_to"})
    return _pk_value(_failing(_t(spark, sf, "events"), "is_not_equal_to",
                              {"column": "event_type", "value": "error"}, "event_id", ctx))


def _orders_date_text(spark, sf):
    o = _t(spark, sf, "orders")
    txt = (F.when(F.col("o_orderpriority") == "1-URGENT",
                  F.concat(F.year("o_orderdate").cast("string"), F.lit("-02-31")))
           .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return o.withColumn("o_orderdate_txt", txt)


def is_valid_date(spark, sf):
    return _pk_value(_failing(_orders_date_text(spark, sf), "is_valid_date", {"column": "o_orderdate_txt"},
                              "o_orderkey", _ctx(spark, sf)))


def _events_ts_text(spark, sf):
    e = _t(spark, sf, "events")
    txt = (F.when(F.col("event_type") == "click",
                  F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" 25:"), F.date_format("ts", "mm:ss")))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))
    return e.withColumn("ts_txt", txt)


def is_valid_timestamp(spark, sf):
    return _pk_value(_failing(_events_ts_text(spark, sf), "is_valid_timestamp",
                              {"column": "ts_txt", "timestamp_format": "yyyy-MM-dd HH:mm:ss"},
                              "event_id", _ctx(spark, sf)))


def is_in_range(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "events"), "is_in_range",
                              {"column": "value", "min_limit": 1.0, "max_limit": 300.0}, "event_id", _ctx(spark, sf)))


def is_not_in_range(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "part"), "is_not_in_range",
                              {"column": "p_size", "min_limit": 10.0, "max_limit": 20.0}, "p_partkey", _ctx(spark, sf)))


def is_not_less_than(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "customer"), "is_not_less_than",
                              {"column": "c_acctbal", "limit": 0.0}, "c_custkey", _ctx(spark, sf)))


def is_not_greater_than(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "orders"), "is_not_greater_than",
                              {"column": "o_totalprice", "limit": 450000.0}, "o_orderkey", _ctx(spark, sf)))


def _lineitem_orders(spark, sf):
    return _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def sql_expression(spark, sf):
    return _pk_value(_failing(_lineitem_orders(spark, sf), "sql_expression",
                              {"expression": "l_shipdate >= o_orderdate"}, "l_orderkey, l_linenumber",
                              _ctx(spark, sf)))


# ---------------------------------------------------------------- M2 -----
def is_unique(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "documents"), "is_unique", {"columns": ["text"]}, "doc_id",
                              _ctx(spark, sf)))


def is_unique_composite(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "lineitem"), "is_unique", {"columns": ["l_orderkey", "l_linenumber"]},
                              "l_orderkey, l_linenumber", _ctx(spark, sf)))


def sql_query(spark, sf):
    _t(spark, sf, "orders").createOrReplaceTempView("orders")
    params = {"query": "SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
              "merge_columns": ["c_custkey"]}
    return _pk_value(_failing(_t(spark, sf, "customer"), "sql_query", params, "c_custkey", _ctx(spark, sf)))


def is_aggr_not_greater_than(spark, sf):
    params = {"column": "o_totalprice", "aggr_type": "max", "limit": 450000.0}
    return _pk_value(_failing(_t(spark, sf, "orders"), "is_aggr_not_greater_than", params, "o_orderkey",
                              _ctx(spark, sf), perimeter="o_orderstatus = 'F'"))


def is_aggr_not_less_than(spark, sf):
    params = {"column": "event_id", "aggr_type": "count", "limit": 100000000.0}
    return _pk_value(_failing(_t(spark, sf, "events"), "is_aggr_not_less_than", params, "event_id",
                              _ctx(spark, sf), perimeter="event_type = 'purchase'"))


def is_aggr_equal(spark, sf):
    params = {"column": "c_acctbal", "aggr_type": "avg", "limit": 4500.0}
    return _pk_value(_failing(_t(spark, sf, "customer"), "is_aggr_equal", params, "c_custkey", _ctx(spark, sf)))


def is_aggr_not_equal(spark, sf):
    params = {"column": "c_mktsegment", "aggr_type": "count_distinct", "limit": 5.0}
    return _pk_value(_failing(_t(spark, sf, "customer"), "is_aggr_not_equal", params, "c_custkey", _ctx(spark, sf)))


def is_aggr_passing(spark, sf):
    """An aggregate rule that holds: no evidence."""
    params = {"column": "l_linenumber", "aggr_type": "min", "limit": 1.0}
    return _pk_value(_failing(_t(spark, sf, "lineitem"), "is_aggr_equal", params, "l_orderkey, l_linenumber",
                              _ctx(spark, sf)))


def foreign_key(spark, sf):
    ref = _t(spark, sf, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    ctx = _ctx(spark, sf, frames={"customer_not_building": ref})
    params = {"columns": ["o_custkey"], "ref_columns": ["c_custkey"], "ref_table": "customer_not_building",
              "row_filter": "o_orderstatus <> 'P'"}
    return _pk_value(_failing(_t(spark, sf, "orders"), "foreign_key", params, "o_orderkey", ctx))


def foreign_key_labels(spark, sf):
    params = {"columns": ["doc_id"], "ref_columns": ["doc_id"], "ref_table": "labels"}
    return _pk_value(_failing(_t(spark, sf, "documents"), "foreign_key", params, "doc_id", _ctx(spark, sf)))


def has_valid_schema(spark, sf):
    params = {"expected_schema": "event_id BIGINT, ts TIMESTAMP_NTZ, value INT"}
    return _pk_value(_failing(_t(spark, sf, "events"), "has_valid_schema", params, "event_id", _ctx(spark, sf)))


def has_valid_schema_passing(spark, sf):
    params = {"expected_schema": "event_id BIGINT, ts TIMESTAMP_NTZ, value DOUBLE"}
    return _pk_value(_failing(_t(spark, sf, "events"), "has_valid_schema", params, "event_id", _ctx(spark, sf)))


def _customer_snapshot(spark, sf):
    c = _t(spark, sf, "customer")
    return (c.filter(F.col("c_nationkey") != 0)
            .withColumn("c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") + 2000)
                        .otherwise(F.col("c_acctbal"))))


def compare_datasets(spark, sf):
    ctx = _ctx(spark, sf, frames={"customer_snapshot": _customer_snapshot(spark, sf)})
    params = {"columns": ["c_custkey"], "ref_columns": ["c_custkey"], "ref_table": "customer_snapshot"}
    return _pk_value(_failing(_t(spark, sf, "customer"), "compare_datasets", params, "c_custkey", ctx))


# ---------------------------------------------------------------- M3 -----
def _customer_ids(spark, sf):
    c = _t(spark, sf, "customer")
    n = (F.col("c_custkey") * 7919 + 12345) % 100000000
    digits = F.lpad(n.cast("string"), 8, "0")
    letters = F.lit(CONTROL_LETTERS)
    good = F.substring(letters, (n % 23 + 1).cast("int"), 1)
    bad = F.substring(letters, ((n + 1) % 23 + 1).cast("int"), 1)
    tail7 = F.substring(digits, 2, 7)
    nie_letter = F.substring(letters, (tail7.cast("int") % 23 + 1).cast("int"), 1)
    seg, nat = F.col("c_mktsegment"), F.col("c_nationkey")
    dni = (F.when(nat == 24, F.lit(None).cast("string"))
           .when((seg == "BUILDING") & (nat < 8), F.concat(digits, bad))
           .when((seg == "MACHINERY") & (nat < 5), F.concat(tail7, good))
           .when((seg == "FURNITURE") & (nat < 6), F.concat(F.lit("X"), tail7, nie_letter))
           .when((seg == "AUTOMOBILE") & (nat < 4),
                 F.concat(F.substring(digits, 1, 1), F.lit("B"), F.substring(digits, 3, 6), good))
           .when((seg == "HOUSEHOLD") & (nat < 5), F.concat(digits, F.lower(good)))
           .when((seg == "HOUSEHOLD") & (nat < 8),
                 F.concat(F.substring(digits, 1, 4), F.lit("Y"), F.substring(digits, 6, 3), good))
           .otherwise(F.concat(digits, good)))
    return c.withColumn("dni", dni)


def national_id_strict(spark, sf):
    return _pk_value(_failing(_customer_ids(spark, sf), "custom_validate_dni", {"columns": ["dni"]}, "c_custkey",
                              _ctx(spark, sf), implementation="CUSTOM"))


def national_id_sql(spark, sf):
    return _pk_value(_failing(_customer_ids(spark, sf), "is_valid_nif_es", {"columns": ["dni"]}, "c_custkey",
                              _ctx(spark, sf), implementation="CUSTOM"))


def custom_sql_fn(spark, sf):
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION balance_fits_segment(seg STRING, bal DOUBLE)
                 RETURNS BOOLEAN RETURN CASE WHEN seg = 'BUILDING' THEN bal < 9000 ELSE bal > -500 END""")
    return _pk_value(_failing(_t(spark, sf, "customer"), "balance_fits_segment",
                              {"columns": ["c_mktsegment", "c_acctbal"]}, "c_custkey", _ctx(spark, sf),
                              implementation="CUSTOM"))


def perimeter_filter(spark, sf):
    return _pk_value(_failing(_t(spark, sf, "orders"), "is_in_range",
                              {"column": "o_totalprice", "min_limit": 5000.0, "max_limit": 400000.0},
                              "o_orderkey", _ctx(spark, sf), perimeter="o_orderpriority = '1-URGENT'"))


# ---------------------------------------------------------------- M4 -----
def _validations_sheet(spark, sf):
    """A validations sheet (all strings) built from the part table."""
    p = _t(spark, sf, "part")
    size = F.col("p_size")
    names = F.array(*[F.lit(n) for n in RULE_NAMES + ["no_such_rule"]])
    s = lambda c: c.cast("string")
    return p.select(
        F.concat(F.lit("V"), s(F.col("p_partkey"))).alias("validation_id"),
        F.concat(F.lit("R"), s(size - 1)).alias("rule_id"),
        F.concat(F.lit("T_"), F.col("p_type")).alias("table_id"),
        F.when(size > 45, F.lit("p_size > 3")).otherwise(F.lit("")).alias("perimeter_definition"),
        F.when(size > 10, F.lit("true")).when(size > 5, F.lit("false")).otherwise(F.lit("")).alias("is_active"),
        F.when(size > 30, F.lit("critical")).otherwise(F.lit("warning")).alias("severity"),
        F.element_at(names, ((size - 1) % 26 + 1).cast("int")).alias("technical_name"),
        F.when(F.col("p_type") == "PROMO", F.lit("CUSTOM"))
         .when((F.col("p_type") == "SMALL") & (size > 40), F.lit("other"))
         .otherwise(F.lit("BUILT-IN")).alias("rule_type"),
        F.when(F.col("p_type") == "STANDARD", F.lit(" p_name, p_brand ,, "))
         .when(F.col("p_type") == "ECONOMY", F.lit("")).otherwise(F.lit("p_name")).alias("param_columns"),
        F.when(size % 3 == 0, F.lit("")).when(size % 3 == 1, F.col("p_brand"))
         .otherwise(s(F.col("p_retailprice"))).alias("param_value"),
        F.when(size > 25, s(size)).when(size > 10, F.lit("abc")).otherwise(F.lit("")).alias("param_min"),
        F.when(size < 30, s(size * 10)).otherwise(F.lit("")).alias("param_max"),
        F.concat(F.regexp_replace(F.col("p_name"), " ", ", "), F.lit(", , ")).alias("param_set"),
        F.concat(F.lit("p_size > "), s(size)).alias("param_expression"),
        F.lit("").alias("param_data_type"),
        F.concat(F.lit("SELECT p_partkey FROM part WHERE p_size = "), s(size)).alias("param_query"),
        F.when(size % 2 == 0, F.lit("p_partkey")).otherwise(F.lit("")).alias("param_merge_columns"),
        F.lit("dq").alias("owner"),
        F.concat(F.col("p_type"), F.lit(",  "), F.col("p_brand"), F.lit(",,")).alias("tags"),
        F.lit("suite").alias("updated_by"),
        F.lit("catalog").alias("table_domain"),
    )


def build_definition(spark, sf):
    sh = _validations_sheet(spark, sf)
    return sh.select("validation_id", _build_definition(
        "technical_name", "rule_type", "param_columns", "param_value", "param_min", "param_max", "param_set",
        "param_expression", "param_data_type", "param_query", "param_merge_columns").alias("validation_definition"))


def split_tags_query(spark, sf):
    p = _t(spark, sf, "part")
    raw = F.concat(F.col("p_type"), F.lit(",  "), F.col("p_brand"), F.lit(",,"), F.col("p_name"), F.lit(", "))
    tags = split_tags(raw)
    return p.select("p_partkey", F.array_join(tags, "|").alias("tags"), F.size(tags).alias("n_tags"))


def _tables_config(spark, sf, source: bool):
    s = _t(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    domain = F.col("s_nationkey").cast("string")
    base = lambda df, k, d: df.select(
        k.alias("table_id"), F.col("s_name").alias("table_name"), F.col("s_name").alias("table_name_tech"),
        d.alias("domain"), F.lit("s_suppkey").alias("primary_key"),
        F.concat(F.lit("stg_"), F.col("s_name")).alias("staging_evidences_table"))
    if not source:
        return base(s, key, domain)
    kept = base(s.filter(F.col("s_nationkey") != 0), key,
                F.when(F.col("s_acctbal") < 0, F.lit("negative")).otherwise(domain))
    added = base(s.filter(F.col("s_nationkey") == 1), (F.col("s_suppkey") + 1000000).cast("string"), domain)
    return kept.unionByName(added)


def sync_reflect(spark, sf):
    _, changes = reflect(_tables_config(spark, sf, False), _tables_config(spark, sf, True), ["table_id"])
    return changes


def _shaped_validations(spark, sf):
    return shape_validations(_validations_sheet(spark, sf))


def select_active_validations(spark, sf):
    return (active_validations(_shaped_validations(spark, sf), "T_STANDARD", severity="critical")
            .select("validation_id", "rule_id", "severity"))


def _rules_library(spark, sf):
    n = _t(spark, sf, "nation")
    names = F.array(*[F.lit(x) for x in RULE_NAMES])
    name = F.element_at(names, (F.col("n_nationkey") + 1).cast("int"))
    return n.select(F.concat(F.lit("R"), F.col("n_nationkey").cast("string")).alias("rule_id"),
                    name.alias("technical_rule_name"),
                    F.when(F.col("n_nationkey") < 16, F.lit("ROW")).otherwise(F.lit("DATASET")).alias("rule_level"),
                    F.lit("BUILT-IN").alias("implementation_type"),
                    (F.col("n_nationkey") % 7 == 0).alias("requires_literal_conversion"))


def validation_plan(spark, sf):
    return (_validation_plan(_shaped_validations(spark, sf), _rules_library(spark, sf))
            .select("validation_id", "rule_id", "technical_rule_name", "rule_level"))


def config_problems(spark, sf):
    plan = _validation_plan(_shaped_validations(spark, sf), _rules_library(spark, sf))
    return definition_problems(plan)


def merge_update(spark, sf):
    o = _t(spark, sf, "orders")
    target = o.select(F.col("o_orderkey").cast("string").alias("execution_id"),
                      F.col("o_custkey").cast("string").alias("table_id"),
                      F.lit("START").alias("status"),
                      F.lit(None).cast("int").alias("validations_executed"),
                      F.lit(None).cast("int").alias("validations_failed"))
    updates = (_t(spark, sf, "lineitem").filter(F.col("l_returnflag") == "R")
               .groupBy(F.col("l_orderkey").cast("string").alias("execution_id"))
               .agg(F.count(F.lit(1)).cast("int").alias("validations_executed"),
                    F.count_if(F.col("l_linestatus") == "F").cast("int").alias("validations_failed"))
               .withColumn("status", F.lit("FAILED")))
    return update_matched(target, updates, ["execution_id"],
                          ["status", "validations_executed", "validations_failed"])


def merge_upsert(spark, sf):
    c = _t(spark, sf, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    target = c.select(F.col("c_custkey").cast("string").alias("validation_id"),
                      F.lit("FAILED").alias("status"),
                      F.col("c_nationkey").cast("long").alias("new_failures"),
                      F.lit(0).cast("long").alias("persistent_failures"),
                      F.lit(0).cast("long").alias("resolved_failures"))
    source = (_t(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
              .groupBy(F.col("o_custkey").cast("string").alias("validation_id"))
              .agg(F.count(F.lit(1)).cast("long").alias("new_failures"),
                   F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("long").alias("persistent_failures"),
                   F.lit(0).cast("long").alias("resolved_failures")))
    return upsert(target, source, ["validation_id"],
                  ["new_failures", "persistent_failures", "resolved_failures"])


def conditional_update(spark, sf):
    li = _t(spark, sf, "lineitem")
    ev = li.select(F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
                   .alias("table_pk"),
                   F.year("l_shipdate").cast("string").alias("execution_id"),
                   (F.col("l_returnflag") == "R").alias("is_new_failure"))
    return _conditional_update(ev, F.col("execution_id") == "1998", {"is_new_failure": False})


# ---------------------------------------------------------------- M5 -----
def evidence_projection(spark, sf):
    ev = _failing(_t(spark, sf, "orders"), "is_not_greater_than", {"column": "o_totalprice", "limit": 450000.0},
                  "o_orderkey", _ctx(spark, sf), vid="V_PRICE")
    return stage(ev, "exec-0001", "2024-01-01")


LINEITEM_VALIDATIONS = [
    Validation("L1", "is_in_range", {"column": "l_discount", "min_limit": 0.0, "max_limit": 0.08}),
    Validation("L2", "is_in_list", {"column": "l_returnflag", "allowed": ["A", "N"]}, perimeter="l_linestatus = 'F'"),
    Validation("L3", "sql_expression", {"expression": "l_tax <= 0.07"}),
    Validation("L4", "is_unique", {"columns": ["l_orderkey", "l_linenumber"]}),
    Validation("L5", "foreign_key", {"columns": ["l_partkey"], "ref_columns": ["p_partkey"], "ref_table": "part"}),
    Validation("L6", "regex_match", {"column": "no_such_column", "regex": "x"}),
    Validation("L7", "is_not_null", {"column": "l_quantity"}, perimeter="no_such_column > 1"),
    Validation("L8", "is_aggr_not_greater_than", {"column": "l_quantity", "aggr_type": "avg", "limit": 20.0},
               perimeter="l_returnflag = 'R'"),
]


def validation_results(spark, sf):
    df = _t(spark, sf, "lineitem")
    prepared = prepare(df, LINEITEM_VALIDATIONS, "l_orderkey, l_linenumber", _ctx(spark, sf))
    return results(df, prepared).select("validation_id", "status", "perimeter", "failed_records_count")


SUMMARY_TABLES = {
    "orders": ("o_orderkey", [
        Validation("O1", "is_in_list", {"column": "o_orderstatus", "allowed": ["F", "O", "P"]}),
        Validation("O2", "is_not_greater_than", {"column": "o_totalprice", "limit": 450000.0}),
        Validation("O3", "is_unique", {"columns": ["o_orderkey"]}),
    ]),
    "customer": ("c_custkey", [
        Validation("C1", "is_not_less_than", {"column": "c_acctbal", "limit": 0.0}),
        Validation("C2", "regex_match", {"column": "c_name", "regex": "^Customer#[0-9]{9}$"}),
        Validation("C3", "is_not_null", {"column": "missing_column"}),
    ]),
    "part": ("p_partkey", [
        Validation("P1", "is_in_range", {"column": "p_size", "min_limit": 1.0, "max_limit": 50.0}),
        Validation("P2", "regex_match", {"column": "p_brand", "regex": r"^Brand#[0-9]$"}),
    ]),
}


def execution_summary(spark, sf):
    """Run totals per table, as the engine makes them, from the validations of
    three tables."""
    rows = []
    for table, (pk, vals) in SUMMARY_TABLES.items():
        df = _t(spark, sf, table)
        res = results(df, prepare(df, vals, pk, _ctx(spark, sf)))
        rows.append((table, *table_totals([r.status for r in res.select("status").collect()])))       # a row per validation
    return spark.createDataFrame(rows, "table_id string, status string, validations_executed long, validations_failed long, validations_errors long")


# ---------------------------------------------------------------- M6 -----
CUSTOMER_RULES = [
    Validation("C_BAL", "is_not_greater_than", {"column": "c_acctbal", "limit": 8000.0}),
    Validation("C_NEG", "is_not_less_than", {"column": "c_acctbal", "limit": 0.0}),
    Validation("C_SEG", "is_in_list", {"column": "c_mktsegment",
                                       "allowed": ["MACHINERY", "FURNITURE", "HOUSEHOLD", "AUTOMOBILE"]}),
    Validation("C_BAND", "is_not_null", {"column": "bal_band"}),
]


def _customer_evidence(spark, sf, current: bool) -> DataFrame:
    c = _t(spark, sf, "customer")
    if current:
        c = _customer_snapshot(spark, sf)
    c = c.withColumn("bal_band", F.when(F.col("c_acctbal") > 9000, F.lit(None).cast("string")).otherwise(F.lit("ok")))
    prepared = prepare(c, CUSTOMER_RULES, "c_custkey", _ctx(spark, sf))
    ev = evidence(c, prepared, "c_custkey")
    return stage(ev, "exec-cur" if current else "exec-prev", "2024-02-02" if current else "2024-02-01")


def new_failures(spark, sf):
    return P.new_failures(_customer_evidence(spark, sf, True), _customer_evidence(spark, sf, False))


def resolved_failures(spark, sf):
    return P.resolved_failures(_customer_evidence(spark, sf, True), _customer_evidence(spark, sf, False))


def persistent_failures(spark, sf):
    return P.persistent_failures(_customer_evidence(spark, sf, True), _customer_evidence(spark, sf, False))


def persistence_summary(spark, sf):
    return P.persistence_summary(_customer_evidence(spark, sf, True), _customer_evidence(spark, sf, False))


def evidence_flags(spark, sf):
    flagged = P.flag_evidences(_customer_evidence(spark, sf, True), _customer_evidence(spark, sf, False),
                               "exec-cur", "2024-02-02")
    return flagged.select("evidence_id", "validation_id", "table_pk", "failed_value", "is_new_failure")


def first_run_counts(spark, sf):
    return P.first_run_counts(_customer_evidence(spark, sf, True))


def _staged_with_exec(ev: DataFrame, exec_col: Column) -> DataFrame:
    ex = exec_col
    return ev.select(evidence_id(ex, F.col("validation_id"), F.col("table_pk"), F.col("failed_value"))
                     .alias("evidence_id"), ex.alias("execution_id"), "validation_id", "failed_value", "table_pk")


def _staged_orders(spark, sf):
    ev = _failing(_t(spark, sf, "orders"), "is_in_list",
                  {"column": "o_orderpriority", "allowed": ["1-URGENT", "2-HIGH"]}, "o_orderkey",
                  _ctx(spark, sf), vid="V_PRIO")
    return _staged_with_exec(ev, F.concat(F.lit("exec-"), F.substring(F.col("failed_value"), 1, 1)))


def _staged_lineitem(spark, sf):
    ev = _failing(_t(spark, sf, "lineitem"), "is_in_list", {"column": "l_linestatus", "allowed": ["O"]},
                  "l_orderkey, l_linenumber", _ctx(spark, sf), vid="V_LSTAT")
    return _staged_with_exec(ev, F.concat(F.lit("exec-"), F.col("failed_value")))


def unify_evidences(spark, sf):
    orders = _staged_orders(spark, sf)
    ledger = orders.filter(F.col("execution_id") == "exec-3")
    unified = _unify([orders, _staged_lineitem(spark, sf)], ledger)
    return unified.select("execution_id", "validation_id", "table_pk", "failed_value")


def dedup_evidences(spark, sf):
    return _dedup(_staged_lineitem(spark, sf)).select("evidence_id", "execution_id", "validation_id",
                                                      "table_pk", "failed_value")


def _executions(spark, sf):
    o = _t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("execution_id"),
                    F.col("o_custkey").cast("string").alias("table_id"),
                    F.col("o_orderdate").alias("execution_timestamp"),
                    F.when(F.col("o_orderstatus") == "F", F.lit("SUCCESS"))
                     .when(F.col("o_orderstatus") == "O", F.lit("FAILED"))
                     .otherwise(F.lit("ERROR")).alias("status"))


def previous_execution(spark, sf):
    return P.previous_execution(_executions(spark, sf)).select("table_id", "execution_id", "prev_execution_id")


def latest_execution(spark, sf):
    return P.latest_execution(_executions(spark, sf))


QUERIES = {
    "row_rules_single_pass": row_rules_single_pass,
    "is_not_null": is_not_null,
    "is_not_empty": is_not_empty,
    "is_not_null_and_not_empty": is_not_null_and_not_empty,
    "is_not_in_future": is_not_in_future,
    "is_in_list": is_in_list,
    "is_not_null_and_is_in_list": is_not_null_and_is_in_list,
    "regex_match": regex_match,
    "is_equal_to": is_equal_to,
    "is_not_equal_to": is_not_equal_to,
    "is_valid_date": is_valid_date,
    "is_valid_timestamp": is_valid_timestamp,
    "is_in_range": is_in_range,
    "is_not_in_range": is_not_in_range,
    "is_not_less_than": is_not_less_than,
    "is_not_greater_than": is_not_greater_than,
    "sql_expression": sql_expression,
    "is_unique": is_unique,
    "is_unique_composite": is_unique_composite,
    "sql_query": sql_query,
    "is_aggr_not_greater_than": is_aggr_not_greater_than,
    "is_aggr_not_less_than": is_aggr_not_less_than,
    "is_aggr_equal": is_aggr_equal,
    "is_aggr_not_equal": is_aggr_not_equal,
    "is_aggr_passing": is_aggr_passing,
    "foreign_key": foreign_key,
    "foreign_key_labels": foreign_key_labels,
    "has_valid_schema": has_valid_schema,
    "has_valid_schema_passing": has_valid_schema_passing,
    "compare_datasets": compare_datasets,
    "national_id_strict": national_id_strict,
    "national_id_sql": national_id_sql,
    "custom_sql_fn": custom_sql_fn,
    "perimeter_filter": perimeter_filter,
    "build_definition": build_definition,
    "split_tags": split_tags_query,
    "sync_reflect": sync_reflect,
    "select_active_validations": select_active_validations,
    "validation_plan": validation_plan,
    "config_problems": config_problems,
    "merge_update": merge_update,
    "merge_upsert": merge_upsert,
    "conditional_update": conditional_update,
    "evidence_projection": evidence_projection,
    "validation_results": validation_results,
    "execution_summary": execution_summary,
    "new_failures": new_failures,
    "resolved_failures": resolved_failures,
    "persistent_failures": persistent_failures,
    "persistence_summary": persistence_summary,
    "evidence_flags": evidence_flags,
    "first_run_counts": first_run_counts,
    "unify_evidences": unify_evidences,
    "dedup_evidences": dedup_evidences,
    "previous_execution": previous_execution,
    "latest_execution": latest_execution,
}
