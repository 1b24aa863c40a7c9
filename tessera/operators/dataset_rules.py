"""Dataset-level built-in rules.

Each builder takes ``(df, params, ctx)`` -- ``df`` already restricted to the
validation's perimeter -- and returns the failing rows of ``df`` (same
columns). They are lazy DataFrames; nothing is collected.

Scale notes:
* joins are semi/anti joins so no row is multiplied; a side that is not an
  aggregate is left a plain exchange, which the adaptive skew join can split;
* where a side is an aggregate, the heaviest keys are salted (is_unique);
* a reference too large to broadcast is met through a bounded sketch of its keys
  and the distinct keys that pass it, so checked rows are not shuffled;
* NULL keys are dropped before shuffling (they can never fail a key rule and
  would otherwise form one hot group);
* whether a pre-aggregated side is broadcast is left to AQE, which decides
  from the measured size at run time;
* aggregate rules are expressions of one common aggregate (``broken_aggregate``)
  or, where they cannot be, use a scalar subquery (computed once, then a
  literal), so there is no cross join and no single-task window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    IntegralType,
    LongType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from tessera.functions.lists import parse_comma_list
from tessera.operators.context import RuleContext, operand
from tessera.operators.sketch import marked_if_met


def _list(params: dict, key: str) -> list[str]:
    value = params.get(key)
    if value is None:
        return []
    if isinstance(value, str):
        return parse_comma_list(value)
    return [str(v) for v in value]


def _and(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _row_filter(df: DataFrame, params: dict) -> DataFrame:
    rf = params.get("row_filter")
    return df.filter(F.expr(rf)) if rf else df


def _wide(df: DataFrame, keys: list[str]) -> bool:
    """Keys worth hashing before the shuffle (strings, binaries, nested)."""
    narrow = (NumericType, DateType, TimestampType, TimestampNTZType, BooleanType)
    return any(not isinstance(df.schema[k].dataType, narrow) for k in keys)


# the keys spread over several tasks; no other key holds more than this share
HEAVY_KEYS = 1000


def _spread_semi(rows: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join of ``rows`` with ``counted`` (keys, _n), whose rows are one
    per key. The HEAVY_KEYS most frequent keys are repeated per salt and their
    rows dealt over the salts, so a key of a large share of the rows is not one
    task's work. They are known by a 64-bit hash -- a fixed bound in bytes,
    broadcast -- and chosen by count and hash; a row's salt follows from its own
    values. Both are the same however often and in which order rows are read."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(*[F.col(k) for k in keys])
    heavy = (counted.select(key.alias("_heavy"), "_n").orderBy(F.desc("_n"), "_heavy").limit(HEAVY_KEYS)
             .groupBy("_heavy").agg(F.lit(salts).alias("_salts")))
    values = [F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    own = F.pmod(F.xxhash64(*values), F.coalesce("_salts", F.lit(1))).cast("int")

    def salted(df: DataFrame, salt: Column) -> DataFrame:
        return (df.withColumn("_heavy", key).join(F.broadcast(heavy), "_heavy", "left").withColumn("_salt", salt).drop("_salts", "_heavy"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    return salted(rows, own).join(salted(counted.select(*keys), every), [*keys, "_salt"], "left_semi").drop("_salt")


def key_columns(params: dict) -> list[str]:
    """The columns that must be unique together."""
    keys = _list(params, "columns")
    if not keys:
        raise ValueError("is_unique needs 'columns'")
    return keys


def is_unique(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
    """Rows whose key occurs more than once; a key with a NULL part passes.

    Narrow keys: count per key (partial aggregation), semi-join the
    repeated keys back. Wide keys (e.g. whole texts): first count per 64-bit
    hash of the key, so only 8 bytes per row cross the shuffle; the exact
    comparison then runs on the rows whose hash repeats (true duplicates
    plus rare collisions) -- the result is exact either way.
    """
    keys = key_columns(params)
    non_null = df.filter(_and([F.col(k).isNotNull() for k in keys]))
    if _wide(df, keys):
        h = F.xxhash64(*[F.col(k) for k in keys])
        repeated = non_null.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        candidates = _spread_semi(non_null.withColumn("_h", h), repeated, ["_h"]).drop("_h")
    else:
        candidates = non_null
    duplicated = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return _spread_semi(candidates, duplicated, keys)


def sql_query(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
    """Every row the user query returns is a failure. The perimeter rows that
    match one on ``merge_columns`` (NULLs equal) are the failing rows; a query
    row without a perimeter row is reported itself, its merge columns set and
    the other columns NULL, so no returned row is lost. With ``ctx.stage`` the
    query runs once and its keys are written; both sides below read them."""
    query = params.get("query")
    merge = _list(params, "merge_columns")
    if not query:
        raise ValueError("sql_query needs a 'query'")
    if not merge:
        raise ValueError("sql_query needs non-empty 'merge_columns'")
    # as a subquery, a statement other than a query is a parse error; not
    # made distinct, for a semi join needs none and a plain exchange on both
    # sides lets the skew join split a hot key
    found = ctx.spark.sql(f"SELECT * FROM ({query}) AS user_query").select(*[F.col(m).alias(f"_q{i}") for i, m in enumerate(merge)])
    if ctx.stage is not None:
        found = ctx.stage(found)
    failing = df.join(found, _and([F.col(m).eqNullSafe(found[f"_q{i}"]) for i, m in enumerate(merge)]), "left_semi")
    held = df.select(*[F.col(m).alias(f"_d{i}") for i, m in enumerate(merge)])
    unmatched = found.join(held, _and([F.col(f"_q{i}").eqNullSafe(F.col(f"_d{i}")) for i in range(len(merge))]), "left_anti").distinct()
    at = {m.lower(): i for i, m in enumerate(merge)}
    alone = unmatched.select(*[(F.col(f"_q{at[f.name.lower()]}") if f.name.lower() in at else F.lit(None))
                               .cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return failing.unionByName(alone)


AGGREGATES = {
    "count": lambda c: F.count(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "mean": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "approx_count_distinct": lambda c: F.approx_count_distinct(c),
    "stddev": lambda c: F.stddev(c),
}

_AGG_COMPARE = {
    "is_aggr_not_greater_than": lambda a, lim: a > lim,
    "is_aggr_not_less_than": lambda a, lim: a < lim,
    "is_aggr_equal": lambda a, lim: a != lim,
    "is_aggr_not_equal": lambda a, lim: a == lim,
}


def _aggregate_expr(params: dict, perimeter: Column | None = None) -> Column:
    """The rule's aggregate, of the rows inside ``perimeter`` if one is given:
    all aggregates skip NULLs, so rows outside count as NULL."""
    column = params.get("column")
    aggr = str(params.get("aggr_type") or "count").strip().lower()
    if aggr not in AGGREGATES:
        raise ValueError(f"unknown aggr_type '{aggr}'")
    target = F.lit(1) if column in (None, "", "*") else F.col(column)
    return AGGREGATES[aggr](target if perimeter is None else F.when(perimeter, target)).alias("aggregate")


def broken_aggregate(name: str, params: dict, ctx: RuleContext, perimeter: Column | None) -> Column | None:
    """Whether an aggregate rule is broken, to be computed in an aggregate with
    others; None for other rules and for exact distinct counts."""
    if name not in _AGG_COMPARE or "limit" not in params or str(params.get("aggr_type")).strip().lower() == "count_distinct":
        return None
    limit = operand(params["limit"], literal=name in ctx.literal_rules)
    return F.coalesce(_AGG_COMPARE[name](_aggregate_expr(params, perimeter), limit), F.lit(False))


def aggregate_value(df: DataFrame, params: dict) -> Column:
    """The rule's aggregate over ``df`` as a scalar-subquery Column."""
    return df.agg(_aggregate_expr(params)).scalar()


def _aggregate_rule(name: str):
    compare = _AGG_COMPARE[name]

    def rule(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
        if "limit" not in params:
            raise ValueError(f"{name} needs a 'limit'")
        limit = operand(params["limit"], literal=name in ctx.literal_rules)
        if ctx.aggregate_evidence == "summary":
            # one evidence row carrying the aggregate instead of every row
            one = df.agg(_aggregate_expr(params))
            return one.filter(F.coalesce(compare(F.col("aggregate"), limit), F.lit(False)))
        broken = F.coalesce(compare(aggregate_value(df, params), limit), F.lit(False))
        return df.filter(broken)

    rule.__name__ = name
    return rule


is_aggr_not_greater_than = _aggregate_rule("is_aggr_not_greater_than")
is_aggr_not_less_than = _aggregate_rule("is_aggr_not_less_than")
is_aggr_equal = _aggregate_rule("is_aggr_equal")
is_aggr_not_equal = _aggregate_rule("is_aggr_not_equal")


def _reference(params: dict, ctx: RuleContext, rule: str) -> tuple[list[str], list[str], DataFrame]:
    cols = _list(params, "columns")
    ref_cols = _list(params, "ref_columns") or cols
    ref_table = params.get("ref_table")
    if not cols or not ref_table:
        raise ValueError(f"{rule} needs 'columns' and 'ref_table'")
    if len(cols) != len(ref_cols):
        raise ValueError(f"{rule}: 'columns' and 'ref_columns' differ in length")
    return cols, ref_cols, ctx.table(ref_table)


def foreign_key(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
    """Rows whose key is absent from the reference table; NULL keys pass.

    A reference small enough to broadcast takes a plain anti join. Of a larger
    one, a bounded bitmap of the key hashes is broadcast: a row that misses it is
    an orphan, known without a shuffle. Of the other rows only the distinct
    keys (combined before the shuffle, so no key is hot) meet the reference
    exactly; rows of keys found missing there, few as long as the bitmap is
    selective, are told by a bitmap of those keys and confirmed by a semi join.
    """
    cols, ref_cols, ref = _reference(params, ctx, "foreign_key")
    checked = _row_filter(df, params).filter(_and([F.col(c).isNotNull() for c in cols]))
    ref_keys = ref.select(*[F.col(r).alias(f"_ref{i}") for i, r in enumerate(ref_cols)])

    def absent(rows: DataFrame) -> DataFrame:
        cond = _and([F.col(c) == ref_keys[f"_ref{i}"] for i, c in enumerate(cols)])
        return rows.join(ref_keys, on=cond, how="left_anti")
    kinds = [_hashed_as(checked.schema[c].dataType, ref_keys.schema[f"_ref{i}"].dataType) for i, c in enumerate(cols)]
    if None in kinds or _broadcastable(ref_keys):
        # no distinct: an anti join only tests existence, and with a plain
        # exchange on both sides the skew join can split a hot key
        return absent(checked)
    key = F.xxhash64(*[F.col(c).cast(t) for c, t in zip(cols, kinds)])
    sketch = ref_keys.select(F.xxhash64(*[F.col(r).cast(t) for r, t in zip(ref_keys.columns, kinds)]))
    marked = marked_if_met(checked, key, sketch, "_met")
    orphans, rest = marked.filter(~F.col("_met")).drop("_met"), marked.filter("_met").drop("_met")
    missing = absent(rest.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")))
    lost = marked_if_met(rest, key, missing.select(key), "_met").filter("_met").drop("_met")
    return orphans.unionByName(_spread_semi(lost, missing, cols))


def _hashed_as(a: DataType, b: DataType) -> DataType | None:
    """A type in which equal values of both types have equal hashes."""
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return LongType()
    exact = (StringType(), DateType(), TimestampType(), TimestampNTZType(), BooleanType())
    return a if a == b and (a in exact or isinstance(a, DecimalType)) else None


def _broadcastable(df: DataFrame) -> bool:
    """Whether the planner would broadcast ``df`` by its size (no job runs)."""
    threshold = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= threshold


def has_valid_schema(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
    """All rows fail when an expected column is missing or typed otherwise;
    extra columns are allowed. Decided from metadata only (no scan). In
    'summary' evidence mode a failure is one row describing the mismatches."""
    expected = params.get("expected_schema")
    if not expected:
        raise ValueError("has_valid_schema needs 'expected_schema'")
    problems = schema_mismatches(df, expected)
    if ctx.aggregate_evidence == "summary":
        text = "; ".join(problems)
        return df.sparkSession.range(1).select(F.lit(text).alias("aggregate")).filter(F.lit(bool(problems)))
    return df.filter(F.lit(bool(problems)))


def schema_mismatches(df: DataFrame, expected) -> list[str]:
    wanted = expected if isinstance(expected, StructType) else StructType.fromDDL(expected)
    actual = {f.name.lower(): f.dataType for f in df.schema.fields}
    out = []
    for f in wanted.fields:
        got = actual.get(f.name.lower())
        if got is None:
            out.append(f"missing column {f.name}")
        elif got != f.dataType:
            out.append(f"{f.name}: expected {f.dataType.simpleString()}, found {got.simpleString()}")
    return out


def compare_datasets(df: DataFrame, params: dict, ctx: RuleContext) -> DataFrame:
    """Rows with no row in the reference that has equal keys and equal
    (NULL-safe) values in every other column the two share."""
    cols, ref_cols, ref = _reference(params, ctx, "compare_datasets")
    checked = _row_filter(df, params)
    key_set = {c.lower() for c in cols} | {c.lower() for c in ref_cols}
    ref_names = {c.lower(): c for c in ref.columns}
    shared = [c for c in checked.columns if c.lower() in ref_names and c.lower() not in key_set]
    sel = ([F.col(r).alias(f"_k{i}") for i, r in enumerate(ref_cols)]
           + [F.col(ref_names[c.lower()]).alias(f"_v{i}") for i, c in enumerate(shared)])
    # no distinct: an anti join only tests existence, and a distinct over
    # all columns would add a shuffle on a partitioning the join cannot reuse
    ref_rows = ref.select(*sel)
    cond = _and([F.col(c) == ref_rows[f"_k{i}"] for i, c in enumerate(cols)]
                + [F.col(c).eqNullSafe(ref_rows[f"_v{i}"]) for i, c in enumerate(shared)])
    return checked.join(ref_rows, on=cond, how="left_anti")


DATASET_RULES = {
    "is_unique": is_unique,
    "sql_query": sql_query,
    "is_aggr_not_greater_than": is_aggr_not_greater_than,
    "is_aggr_not_less_than": is_aggr_not_less_than,
    "is_aggr_equal": is_aggr_equal,
    "is_aggr_not_equal": is_aggr_not_equal,
    "foreign_key": foreign_key,
    "has_valid_schema": has_valid_schema,
    "compare_datasets": compare_datasets,
}
