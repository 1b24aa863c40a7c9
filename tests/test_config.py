"""Config sheets: shaping, the parameter JSON builder, sync and its edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.plans.config import (
    DuplicateKeyError,
    active_validations,
    shape_validations,
    sync_config,
    validation_plan,
)
from tessera.sources.ledger_store import RULES, TABLES, VALIDATIONS, Store
from tessera.sources.sheets import MissingColumnsError, as_sheet, load_sheet
from tests import fixtures as fx

BLANK = dict(validation_id="", rule_id="R", table_id="T", perimeter_definition="", is_active="true",
             severity="", technical_name="", rule_type="BUILT-IN", param_columns="", param_value="",
             param_min="", param_max="", param_set="", param_expression="", param_data_type="",
             param_query="", param_merge_columns="", owner="", tags="", updated_by="", table_domain="")


def _defs(spark, rows):
    df = shape_validations(spark.createDataFrame([{**BLANK, **r} for r in rows]))
    return {r.validation_id: json.loads(r.validation_definition) for r in df.collect()}


def test_definition_builder(spark):
    d = _defs(spark, [
        dict(validation_id="a", technical_name="is_not_null", param_columns=" x , y"),
        dict(validation_id="b", technical_name="is_in_list", param_columns=" c ", param_set=" 1, ,2 ,"),
        dict(validation_id="c", technical_name="is_in_range", param_columns="n", param_min="5", param_max="abc"),
        dict(validation_id="d", technical_name="is_in_range", param_columns="n", param_max="7.5"),
        dict(validation_id="e", technical_name="regex_match", param_columns="e", param_value=r"^\d+$"),
        dict(validation_id="f", technical_name="sql_query", param_query="SELECT 1 AS k", param_merge_columns="k, j"),
        dict(validation_id="g", technical_name="is_aggr_equal", param_columns="n", param_expression="sum",
             param_value="10"),
        dict(validation_id="h", technical_name="foreign_key", param_columns="a,b", param_merge_columns="x,y",
             param_value="ref", param_expression="a > 0"),
        dict(validation_id="i", technical_name="has_valid_schema", param_columns="a INT, b STRING"),
        dict(validation_id="j", technical_name="unknown_rule"),
        dict(validation_id="k", technical_name="my_fn", rule_type="CUSTOM", param_columns="a, b"),
        dict(validation_id="l", technical_name="is_not_null", rule_type="OTHER"),
        dict(validation_id="", technical_name="is_not_null"),
    ])
    assert d["a"] == {"column": "x"}
    assert d["b"] == {"column": "c", "allowed": ["1", "2"]}
    assert d["c"] == {"column": "n", "min_limit": 5.0, "max_limit": "abc"}
    assert d["d"] == {"column": "n", "max_limit": 7.5}
    assert d["e"] == {"column": "e", "regex": r"^\d+$"}
    assert d["f"] == {"query": "SELECT 1 AS k", "merge_columns": ["k", "j"]}
    assert d["g"] == {"column": "n", "aggr_type": "sum", "limit": 10.0}
    assert d["h"] == {"columns": ["a", "b"], "ref_columns": ["x", "y"], "ref_table": "ref", "row_filter": "a > 0"}
    assert d["i"] == {"expected_schema": "a INT, b STRING"}
    assert d["j"] == {} and d["l"] == {}
    assert d["k"] == {"columns": ["a", "b"]}
    assert "" not in d                                        # blank id dropped


def test_original_headers_accepted(spark):
    row = {"Id_validación": "v1", "Id_regla": "R", "Id_tabla": "T", "Definición_perimetro": "",
           "Validación_activa": "TRUE", "Severidad": "high", "Nombre_técnico": "is_not_null",
           "Tipo_regla": "BUILT-IN", "Param_columnas": "c", "Param_valor": "", "Param_valor_min": "",
           "Param_valor_max": "", "Param_conjunto": "", "Param_expresion": "", "Param_tipo_dato": "",
           "Param_query_SQL": "", "Param_merge_columnas": "", "Owner": "", "Etiquetas": "a, b",
           "Actualizado_por": "", "Dominio_tabla": ""}
    out = shape_validations(spark.createDataFrame([row])).collect()[0]
    assert out.validation_definition == '{"column":"c"}' and out.is_active is True and out.tags == ["a", "b"]


def test_missing_column_raises(spark):
    with pytest.raises(MissingColumnsError):
        shape_validations(spark.createDataFrame([{"validation_id": "x"}]))


def test_sync_reflect_and_edge_cases(spark, scratch_dir):
    store = Store(spark, f"{scratch_dir}/cfg")
    report = sync_config(store, fx.tables_sheet(spark), fx.rules_sheet(spark), fx.validations_sheet(spark))
    assert {r.action for r in report["validations"]} == {"INSERT"}
    assert store.read(VALIDATIONS).count() == len(fx.VALIDATIONS_SHEET)
    # second sync: one validation removed, one changed
    sheet = fx.validations_sheet(spark).filter(F.col("validation_id") != "VAL_DATE") \
        .withColumn("severity", F.when(F.col("validation_id") == "VAL_AGE", F.lit("low")).otherwise(F.col("severity")))
    report = sync_config(store, validations=sheet)
    actions = {r.validation_id: r.action for r in report["validations"]}
    assert actions == {"VAL_DATE": "DELETE", "VAL_AGE": "UPDATE"}      # unchanged rows keep their time
    assert store.read(VALIDATIONS).count() == len(fx.VALIDATIONS_SHEET) - 1
    # a sheet with only blank ids syncs nothing (and deletes nothing)
    blank = fx.validations_sheet(spark).withColumn("validation_id", F.lit(""))
    assert "validations" not in sync_config(store, validations=blank)
    assert store.read(VALIDATIONS).count() == len(fx.VALIDATIONS_SHEET) - 1
    # duplicate ids are rejected
    dup = fx.validations_sheet(spark).unionByName(fx.validations_sheet(spark))
    with pytest.raises(DuplicateKeyError):
        sync_config(store, validations=dup)
    # active filter and plan
    act = active_validations(store.read(VALIDATIONS), "T1", severity="critical")
    assert act.count() == len(fx.VALIDATIONS_SHEET) - 2
    plan = validation_plan(act, store.read(RULES)).collect()
    assert all(r.technical_rule_name for r in plan)
    assert store.read(TABLES).count() == 1


def test_csv_sheet_roundtrip(spark, scratch_dir):
    path = f"{scratch_dir}/tables.csv"
    fx.tables_sheet(spark).coalesce(1).write.option("header", True).csv(path)
    sheet = load_sheet(spark, path)
    assert sheet.columns and all(t == "string" for _, t in sheet.dtypes)
    assert as_sheet(sheet).filter(F.col("table_id") == "T1").count() == 1


def test_json_sheet_and_parquet_resolver(spark, scratch_dir):
    from tessera.sources.catalog import TableResolver
    path = f"{scratch_dir}/rules.json"
    fx.rules_sheet(spark).write.json(path)
    sheet = load_sheet(spark, path, fmt="json")
    assert all(t == "string" for _, t in sheet.dtypes)
    store = Store(spark, f"{scratch_dir}/cfg2")
    report = sync_config(store, rules=sheet)
    assert {r.action for r in report["rules"]} == {"INSERT"}
    lib = {r.rule_id: r for r in store.read(RULES).collect()}
    assert lib["R01"].tags == ["crm", "customers"] and lib["R01"].requires_literal_conversion is None
    resolver = TableResolver(spark, "/root/testdata/sf0.001")
    assert resolver.exists("orders") and not resolver.exists("no_such_table")
    assert resolver("orders").count() > 0
