"""NULL matrix over every row rule, and property-based checks of the
persistence classification against plain set arithmetic."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import RuleContext
from tessera.operators.row_rules import ROW_RULES, failing
from tessera.plans import persistence as P
from tessera.plans.ledger import stage

# a NULL fails only where the rule's name says so
NULL_FAILS = {"is_not_null", "is_not_null_and_not_empty", "is_not_null_and_is_in_list"}
PARAMS = {
    "is_in_list": {"allowed": ["a"]}, "is_not_null_and_is_in_list": {"allowed": ["a"]},
    "regex_match": {"regex": "^a$"}, "is_equal_to": {"value": 1}, "is_not_equal_to": {"value": 1},
    "is_in_range": {"min_limit": 0.0, "max_limit": 1.0}, "is_not_in_range": {"min_limit": 0.0, "max_limit": 1.0},
    "is_not_less_than": {"limit": 0.0}, "is_not_greater_than": {"limit": 0.0},
}


def test_null_matrix_all_row_rules(spark):
    df = spark.createDataFrame([(1, None, None, None)], "id int, s string, n double, t timestamp_ntz")
    ctx = RuleContext(spark, as_of="2020-01-01 00:00:00")
    for rule in ROW_RULES:
        if rule == "sql_expression":
            params = {"expression": "n > 0"}
        else:
            column = {"is_not_in_future": "t", "is_in_range": "n", "is_not_in_range": "n",
                      "is_not_less_than": "n", "is_not_greater_than": "n", "is_equal_to": "n",
                      "is_not_equal_to": "n"}.get(rule, "s")
            params = {"column": column, **PARAMS.get(rule, {})}
        fails = failing(df, rule, params, ctx).count() == 1
        assert fails == (rule in NULL_FAILS), rule


keys = st.tuples(st.sampled_from(["A", "B"]), st.one_of(st.none(), st.sampled_from(["1", "2", "3"])),
                 st.one_of(st.none(), st.sampled_from(["x", "y"])))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(cur=st.lists(keys, max_size=8), prev=st.lists(keys, max_size=8))
def test_classification_equals_set_arithmetic(spark, cur, prev):
    schema = "validation_id string, table_pk string, failed_value string"
    c = stage(spark.createDataFrame(cur, schema), "c", "2024-01-02")
    p = stage(spark.createDataFrame(prev, schema), "p", "2024-01-01")
    got = {(r.validation_id, r.table_pk, r.failed_value): r.state for r in P.classify(c, p).collect()}
    cs, ps = set(cur), set(prev)
    want = {k: P.NEW for k in cs - ps} | {k: P.RESOLVED for k in ps - cs} | {k: P.PERSISTENT for k in cs & ps}
    assert got == want
    flags = P.flag_evidences(c, p, "c", "2024-01-02")
    assert flags.count() == len(cs)
    assert flags.filter(F.col("is_new_failure")).count() == len(cs - ps)
