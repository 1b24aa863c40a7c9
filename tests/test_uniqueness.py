"""Several uniqueness rules in one plan against the rule on its own."""

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import RuleContext, sketch, uniqueness
from tessera.operators.dataset_rules import is_unique
from tessera.operators.uniqueness import UniqueRule, combinable, is_unique_many
from tessera.plans.run import Runner
from tessera.plans.validate import Validation
from tessera.sources.ledger_store import EVIDENCES, Store

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.LongType()), ("i", T.IntegerType()), ("s", T.StringType()), ("d", T.DoubleType()), ("t", T.TimestampType()), ("b", T.BinaryType()),
    ("m", T.DecimalType(10, 2)), ("y", T.DateType()), ("n", T.ArrayType(T.IntegerType())))])


def table(spark):
    nan = float("nan")
    rows = []
    for k in range(200):
        rows.append((k, k % 60 if k % 5 else None, ["a", "b\"c", "b", "\\", "", None][k % 6], [0.0, -0.0, nan, 1.5, float(k)][k % 5],
                     datetime(2024, 1, 1, k % 7), bytes([k % 3, 255]), Decimal(k % 11) / 4, date(2024, 1, 1 + k % 13), [k % 2]))
    return spark.createDataFrame(rows, SCHEMA)


RULES = [(["i"], None), (["s"], None), (["d"], "id < 150"), (["t", "i"], None), (["b", "m"], "id % 3 = 0"), (["y", "s", "m"], None), (["id"], None), (["i", "s", "d", "t"], None)]


def pairs(df, rules):
    return [UniqueRule(f"V{k}", c, F.col(c[0]).cast("string"), None if p is None else F.expr(p)) for k, (c, p) in enumerate(rules)]


def alone(spark, df, rules):
    out = []
    for k, (columns, where) in enumerate(rules):
        scoped = df if where is None else df.where(where)
        out += [(f"V{k}", str(r.id)) for r in is_unique(scoped, {"columns": columns}, RuleContext(spark)).select("id").collect()]
    return sorted(out)


def test_same_as_each_rule_alone(spark):
    df = table(spark)
    got = is_unique_many(df, pairs(df, RULES), "id").collect()
    assert sorted((r.validation_id, r.table_pk) for r in got) == alone(spark, df, RULES)
    assert not any(r.validation_id == "V6" for r in got)


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    """With a bitmap of one word nearly all rows are candidates."""
    monkeypatch.setattr(sketch, "FILTER_BITS", 64)
    df = table(spark)
    got = is_unique_many(df, pairs(df, RULES[:4]), "id").collect()
    assert sorted((r.validation_id, r.table_pk) for r in got) == alone(spark, df, RULES[:4])


def test_one_scan_counts_all_rules(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rules = [(["l_partkey"], None), (["l_suppkey", "l_shipdate"], None), (["l_extendedprice"], None), (["l_orderkey"], None)]
    plan = is_unique_many(df, pairs(df, rules), "l_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    counting = [line for line in plan.split("\n") if "Aggregate [_rule" in line and "_h" in line]
    assert counting and all("count(1)" in line or "_h" in line for line in counting)
    # however many rules: the scans of the counting, of the candidates and of their counts
    one = is_unique_many(df, pairs(df, rules[:1]), "l_orderkey")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == one.count("Relation [")


def test_counts_are_shuffled_once(spark):
    """Bitmap, heaviest keys and join read the same counts; the rows are read once more."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = is_unique_many(df, pairs(df, [(["l_partkey"], None), (["l_suppkey", "l_shipdate"], None)]), "l_orderkey")
    out.collect()
    done = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert done.count("Scan parquet") == 2 and "ReusedExchange" in done


def test_composite_keys_with_odd_texts(spark):
    parts = ["", "1", ":", "1:", "1:1", "1:1:1", "2:1:", "\"", "\",\"", "é", "é:1:"]
    rows = [(n, a, b) for n, (a, b) in enumerate((a, b) for a in parts for b in parts)]
    df = spark.createDataFrame([*rows, (9001, "1:", "é"), (9002, "1:", "é")], "id long, a string, b string")
    got = is_unique_many(df, pairs(df, [(["a", "b"], None)]), "id").collect()
    assert sorted(r.table_pk for r in got) == sorted(["9001", "9002", *[str(n) for n, a, b in rows if (a, b) == ("1:", "é")]])


def shuffled_bytes(plan):
    """Bytes written by the shuffles of an executed plan."""
    kind, below = plan.getClass().getSimpleName(), [plan.children().apply(k) for k in range(plan.children().size())]
    if kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_bytes(p) for p in below)


def test_few_bytes_of_a_key_are_shuffled(spark):
    df = spark.range(300_000).selectExpr("id", "concat('customer number ', id) s", "id * 7 m")
    out = is_unique_many(df, pairs(df, [(["id"], None), (["s"], None), (["m", "s"], None)]), "id")
    assert out.collect() == []
    assert shuffled_bytes(out._jdf.queryExecution().executedPlan()) < 6 * 3 * 300_000


def test_every_hash_the_same(spark, monkeypatch):
    """All rows are candidates of one hot hash: whole keys decide, over all salts."""
    monkeypatch.setattr(uniqueness, "key_value", lambda c, kind: F.lit(1))
    df = table(spark)
    got = is_unique_many(df, pairs(df, RULES), "id").collect()
    assert sorted((r.validation_id, r.table_pk) for r in got) == alone(spark, df, RULES)


def test_alone_in_its_salt(spark):
    rows = [("three parts", 0, 1), ("three parts", 1, 2), ("three parts", 2, 3), ("two and one", 0, 4), ("two and one", 0, 5), ("two and one", 3, 6),
            ("once", 1, 7), ("pair", None, 8), ("pair", None, 9), ("single", None, 10), ("same rows", 2, 11), ("same rows", 2, 11), (None, 0, 12)]
    found = uniqueness.told_apart(spark.createDataFrame(rows, "k string, salt int, n int"), ["k"], "salt")
    assert sorted(r.n for r in found.collect()) == [1, 2, 3, 4, 5, 6, 8, 9, 11, 11]


def test_columns_named_like_the_operators_own(spark):
    names = ["_rule", "_h", "_block", "_words", "_key", "_salt", "_hot", "table_pk", "failed_value", "_n"]
    df = spark.range(40).selectExpr(*[f"id % {k + 2} AS `{n}`" for k, n in enumerate(names)], "id")
    got = is_unique_many(df, pairs(df, [([n], "id < 12") for n in names]), "id").collect()
    want = [(f"V{k}", str(i)) for k in range(len(names)) for i in range(12) if sum(j % (k + 2) == i % (k + 2) for j in range(12)) > 1]
    assert sorted((r.validation_id, r.table_pk) for r in got) == sorted(want)


def test_run_takes_them_together(spark, scratch_dir):
    df = table(spark)
    vals = [Validation(f"V{k}", "is_unique", {"columns": c}, perimeter=p) for k, (c, p) in enumerate([*RULES, (["n"], None)])]
    assert combinable(df, ["i", "s"]) and not combinable(df, ["n"]) and not combinable(df, [])
    store = Store(spark, f"{scratch_dir}/ledger")
    out = Runner(spark, store).run_frame(df, "T", vals, "id", "e-1", datetime(2024, 5, 1))
    want = alone(spark, df, RULES) + [("V8", str(k)) for k in range(200)]
    got = {r["validation_id"]: r["failed_records_count"] for r in out.results}
    assert got == {f"V{k}": sum(v == f"V{k}" for v, _ in want) for k in range(9)}
    assert sorted((r.validation_id, r.table_pk) for r in store.read(EVIDENCES).collect()) == sorted(want)
    boom = [*vals[:3], Validation("BOOM", "is_unique", {"columns": ["i"]}, perimeter="CAST(s AS INT) > 0")]
    out = Runner(spark, store).run_frame(df, "T", boom, "id", "e-2", datetime(2024, 5, 2))
    assert {r["validation_id"]: r["status"] for r in out.results} == {"V0": "FAILED", "V1": "FAILED", "V2": "FAILED", "BOOM": "ERROR"}
