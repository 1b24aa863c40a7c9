"""Rule semantics: NULL matrix per row rule, dataset rules on small frames,
and the single pass equal to one filter per rule."""

from pyspark.sql import functions as F

from tessera.operators import RuleContext
from tessera.operators.custom import default_custom_rules
from tessera.operators.dataset_rules import DATASET_RULES, schema_mismatches
from tessera.operators.row_rules import ROW_RULES, failing
from tessera.plans.validate import Validation, evidence, prepare, results, row_evidence
from tessera.sources.catalog import TableResolver
from tests.conftest import SF_SMALL

ROWS = [
    (1, "a", 5, "2024-01-31", "x@y.com"),
    (2, "", 50, "2024-02-31", "bad"),
    (3, None, None, None, None),
    (4, "b", 150, "2024-03-01", ""),
]
SCHEMA = "id int, s string, n int, d string, e string"


def _fails(spark, rule, params, ctx=None):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ctx = ctx or RuleContext(spark)
    return sorted(r.id for r in failing(df, rule, params, ctx).collect())


def test_null_matrix(spark):
    assert _fails(spark, "is_not_null", {"column": "s"}) == [3]
    assert _fails(spark, "is_not_empty", {"column": "s"}) == [2]
    assert _fails(spark, "is_not_null_and_not_empty", {"column": "s"}) == [2, 3]
    assert _fails(spark, "is_in_list", {"column": "s", "allowed": ["a", "b"]}) == [2]
    assert _fails(spark, "is_not_null_and_is_in_list", {"column": "s", "allowed": ["a", "b"]}) == [2, 3]
    assert _fails(spark, "is_in_list", {"column": "n", "allowed": ["5", "50", "x"]}) == [4]
    assert _fails(spark, "regex_match", {"column": "e", "regex": "@"}) == [2, 4]
    assert _fails(spark, "is_in_range", {"column": "n", "min_limit": 10.0, "max_limit": 100.0}) == [1, 4]
    assert _fails(spark, "is_in_range", {"column": "n", "min_limit": 10.0}) == [1]
    assert _fails(spark, "is_not_in_range", {"column": "n", "min_limit": 10.0, "max_limit": 100.0}) == [2]
    assert _fails(spark, "is_not_less_than", {"column": "n", "limit": 6.0}) == [1]
    assert _fails(spark, "is_not_greater_than", {"column": "n", "limit": 100.0}) == [4]
    assert _fails(spark, "is_valid_date", {"column": "d"}) == [2]
    assert _fails(spark, "is_valid_date", {"column": "d", "date_format": "yyyy-MM-dd"}) == [2]
    assert _fails(spark, "is_valid_timestamp", {"column": "d", "timestamp_format": "yyyy-MM-dd"}) == [2]
    assert _fails(spark, "sql_expression", {"expression": "n < 100"}) == [4]


def test_literal_conversion(spark):
    # without literal conversion a string value is an expression (a column here)
    assert _fails(spark, "is_equal_to", {"column": "s", "value": "e"}) == [1, 2, 4]
    lit_ctx = RuleContext(spark, literal_rules=frozenset({"is_equal_to", "is_not_equal_to"}))
    assert _fails(spark, "is_equal_to", {"column": "s", "value": "a"}, lit_ctx) == [2, 4]
    assert _fails(spark, "is_not_equal_to", {"column": "s", "value": "a"}, lit_ctx) == [1]


def test_not_in_future(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2999-01-01"), (3, None)], "id int, d string") \
        .withColumn("d", F.col("d").cast("timestamp_ntz"))
    ctx = RuleContext(spark)
    assert [r.id for r in failing(df, "is_not_in_future", {"column": "d"}, ctx).collect()] == [2]
    ctx = RuleContext(spark, as_of="2010-01-01 00:00:00")
    assert sorted(r.id for r in failing(df, "is_not_in_future", {"column": "d"}, ctx).collect()) == [1, 2]


def test_dataset_rules(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "id int, k string")
    ref = spark.createDataFrame([("a",), ("c",)], "k string")
    ctx = RuleContext(spark, TableResolver(spark, frames={"ref": ref}))
    ids = lambda out: sorted(r.id for r in out.collect())
    assert ids(DATASET_RULES["is_unique"](df, {"columns": ["k"]}, ctx)) == [1, 2]
    assert ids(DATASET_RULES["foreign_key"](df, {"columns": ["k"], "ref_table": "ref"}, ctx)) == [3]
    assert ids(DATASET_RULES["foreign_key"](df, {"columns": ["k"], "ref_table": "ref", "row_filter": "id > 2"},
                                            ctx)) == [3]
    assert ids(DATASET_RULES["is_aggr_not_greater_than"](df, {"column": "id", "aggr_type": "max", "limit": 4.0},
                                                         ctx)) == [1, 2, 3, 4, 5]
    assert ids(DATASET_RULES["is_aggr_equal"](df, {"column": "k", "aggr_type": "count", "limit": 3.0}, ctx)) == []
    assert ids(DATASET_RULES["is_aggr_not_equal"](df, {"column": "k", "aggr_type": "count_distinct",
                                                       "limit": 2.0}, ctx)) == [1, 2, 3, 4, 5]
    assert ids(DATASET_RULES["has_valid_schema"](df, {"expected_schema": "id INT"}, ctx)) == []
    assert ids(DATASET_RULES["has_valid_schema"](df, {"expected_schema": "id BIGINT"}, ctx)) == [1, 2, 3, 4, 5]
    assert schema_mismatches(df, "id BIGINT, zz STRING") == ["id: expected bigint, found int", "missing column zz"]
    snap = spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "id int, k string")
    ctx2 = RuleContext(spark, TableResolver(spark, frames={"snap": snap}))
    assert ids(DATASET_RULES["compare_datasets"](df, {"columns": ["id"], "ref_table": "snap"}, ctx2)) == [2, 3, 5]
    df.createOrReplaceTempView("t_ids")
    q = {"query": "SELECT k FROM t_ids GROUP BY k HAVING count(*) > 1", "merge_columns": ["k"]}
    assert ids(DATASET_RULES["sql_query"](df, q, ctx)) == [1, 2, 4, 5]      # the query returns the NULL key too


def test_national_id_variants(spark):
    from tests import fixtures as fx
    df = fx.run_frame(spark, "run3").unionByName(fx.run_frame(spark, "run5"))
    ctx = RuleContext(spark)
    custom = default_custom_rules(spark)
    strict = Validation("S", "custom_validate_dni", {"columns": ["dni"]}, implementation="CUSTOM")
    lenient = Validation("L", "is_valid_nif_es", {"columns": ["dni"]}, implementation="CUSTOM")
    ev = evidence(df, prepare(df, [strict, lenient], "customer_id", ctx, custom), "customer_id")
    got = {(r.validation_id, r.table_pk) for r in ev.collect()}
    # a non-numeric digit part (202) fails strictly but passes the SQL variant
    assert {pk for v, pk in got if v == "S"} == {"202", "204", "205"}
    assert {pk for v, pk in got if v == "L"} == {"204", "205"}


def test_single_pass_equals_per_rule_filters(spark):
    li = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet")
    vals = [
        Validation("A", "is_in_range", {"column": "l_discount", "min_limit": 0.0, "max_limit": 0.05}),
        Validation("B", "is_in_list", {"column": "l_returnflag", "allowed": ["A"]}, perimeter="l_linenumber < 3"),
        Validation("C", "sql_expression", {"expression": "l_tax < 0.04"}),
        Validation("D", "regex_match", {"column": "l_linestatus", "regex": "^F$"}),
    ]
    ctx = RuleContext(spark)
    pk = "l_orderkey, l_linenumber"
    together = prepare(li, vals, pk, ctx)
    one = {r.validation_id: r.n for r in row_evidence(li, together, pk).groupBy("validation_id")
           .agg(F.count(F.lit(1)).alias("n")).collect()}
    for v in vals:
        p = prepare(li, [v], pk, ctx)[0]
        alone = li.filter(p.perimeter & F.coalesce(p.fail, F.lit(False))).count()
        assert one.get(v.validation_id, 0) == alone, v.validation_id
    res = {r.validation_id: r for r in results(li, together).collect()}
    for vid, n in one.items():
        assert res[vid].failed_records_count == n
    assert res["B"].perimeter == li.filter("l_linenumber < 3").count()


def test_errors_are_isolated(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    vals = [Validation("OK", "is_not_null", {"column": "s"}),
            Validation("BAD_COL", "is_not_null", {"column": "nope"}),
            Validation("BAD_PERIM", "is_not_null", {"column": "s"}, perimeter="nope > 1"),
            Validation("BAD_RULE", "no_such_rule", {"column": "s"}),
            Validation("BAD_CUSTOM", "unregistered_fn", {"columns": ["s"]}, implementation="CUSTOM")]
    res = {r.validation_id: r for r in results(df, prepare(df, vals, "id", RuleContext(spark))).collect()}
    assert res["OK"].status == "FAILED" and res["OK"].failed_records_count == 1
    for vid in ("BAD_COL", "BAD_PERIM", "BAD_RULE", "BAD_CUSTOM"):
        assert res[vid].status == "ERROR"
    assert res["BAD_PERIM"].perimeter == 0 and res["BAD_COL"].perimeter == 4


def test_every_builtin_registered():
    assert len(ROW_RULES) == 16 and len(DATASET_RULES) == 9
