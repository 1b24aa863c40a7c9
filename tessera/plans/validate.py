"""Evaluate the validations of one table as DataFrame plans.

Row-level validations (built-in row rules, column and SQL-function custom
rules) are folded into ONE scan of the source:

    filter(any rule fails inside its perimeter)
      -> select(pk, inline(array_compact(array(when(fails_i, struct(i, value_i)), ...))))
      -> select(ids[i], pk, value)

so V row rules cost one pass instead of V passes, and their counts come from
one aggregate with map-side partial aggregation (one row per task crosses
the shuffle). Aggregate rules are part of that same aggregate: each is an
aggregate filtered by its perimeter, compared with its limit; a broken one joins
the row scan as a rule that every row of its perimeter fails. The other
dataset-level validations are separate plans, each restricted
to its perimeter, projected to the same evidence shape and unioned.

Everything here is lazy; analysis errors of single validations are caught
per validation (status ERROR) without running a job.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tessera.functions.keys import as_text, pk_text
from tessera.operators.context import RuleContext
from tessera.operators.custom import CustomRules
from tessera.operators.dataset_rules import DATASET_RULES, broken_aggregate
from tessera.operators.row_rules import ROW_RULES

EVIDENCE_COLUMNS = ["validation_id", "table_pk", "failed_value"]
RAW_EVIDENCE_SCHEMA = StructType([
    StructField("validation_id", StringType()),
    StructField("table_pk", StringType()),
    StructField("failed_value", StringType()),
])


@dataclass
class Validation:
    """One rule applied to one table with its parameters."""
    validation_id: str
    rule_name: str
    params: dict = field(default_factory=dict)
    rule_id: str = ""
    implementation: str = "BUILT-IN"        # BUILT-IN | CUSTOM
    perimeter: str | None = None            # SQL predicate restricting the rows

    @classmethod
    def from_config(cls, row) -> "Validation":
        """From a row of validations joined with the rule library."""
        d = row.asDict() if hasattr(row, "asDict") else dict(row)
        raw = d.get("validation_definition") or "{}"
        try:
            params = json.loads(raw)
        except (TypeError, ValueError):
            params = {"error": f"unreadable definition: {raw!r}"}
        if d.get("definition_error"):
            params = {"error": d["definition_error"]}
        return cls(
            validation_id=d["validation_id"],
            rule_name=d.get("technical_rule_name") or "",
            params=params,
            rule_id=d.get("rule_id") or "",
            implementation=(d.get("implementation_type") or d.get("rule_type") or "BUILT-IN").upper(),
            perimeter=(d.get("perimeter_definition") or None),
        )


@dataclass
class Prepared:
    validation: Validation
    kind: str                               # row | aggregate | dataset | error
    perimeter: Column | None = None         # TRUE inside the perimeter
    fail: Column | None = None              # row kinds: TRUE = failing row
    value: Column | None = None             # row kinds: failed value text
    failing: DataFrame | None = None        # dataset kinds: failing rows, projected
    broken: Column | None = None            # aggregate kinds: the rule is broken, over the whole table
    error: str | None = None
    # columns to add before evaluation (SQL functions are not allowed inside
    # a Generate, so their verdict is computed in a projection below it)
    helpers: dict = field(default_factory=dict)


def with_helpers(df: DataFrame, prepared: list[Prepared]) -> DataFrame:
    helpers = {}
    for p in prepared:
        if p.kind == "row":
            helpers.update(p.helpers)
    return df.withColumns(helpers) if helpers else df


def failed_field(params: dict, primary_key: str) -> str | None:
    """The column whose value is recorded: 'column', else the first of
    'columns', else None (= the primary key)."""
    if params.get("column"):
        return params["column"]
    cols = params.get("columns") or []
    if isinstance(cols, str):
        cols = [c.strip() for c in cols.split(",") if c.strip()]
    return cols[0] if cols else None


def value_column(params: dict, primary_key: str) -> Column:
    name = failed_field(params, primary_key)
    return pk_text(primary_key) if name is None else as_text(F.col(name))


def _project(failing: DataFrame, validation_id: str, params: dict, primary_key: str,
             summary: bool = False) -> DataFrame:
    if summary:
        return failing.select(F.lit(validation_id).alias("validation_id"),
                              F.lit(None).cast("string").alias("table_pk"),
                              as_text(F.col("aggregate")).alias("failed_value"))
    return failing.select(F.lit(validation_id).alias("validation_id"),
                          pk_text(primary_key).alias("table_pk"),
                          value_column(params, primary_key).alias("failed_value"))


def _level(v: Validation, custom: CustomRules | None, ctx: RuleContext) -> str:
    if v.implementation == "CUSTOM":
        kind = custom.kind(ctx.spark, v.rule_name) if custom else None
        if kind is None:
            raise KeyError(f"custom rule '{v.rule_name}' is not registered")
        return "dataset" if kind == "frame" else "row"
    if v.implementation != "BUILT-IN":
        raise ValueError(f"unknown implementation type '{v.implementation}'")
    if v.rule_name in ROW_RULES:
        return "row"
    if v.rule_name in DATASET_RULES:
        return "dataset"
    raise KeyError(f"unknown built-in rule '{v.rule_name}'")


def prepare(df: DataFrame, validations: list[Validation], primary_key: str,
            ctx: RuleContext, custom: CustomRules | None = None) -> list[Prepared]:
    """Analyse every validation against ``df`` (no job runs)."""
    out = []
    for v in validations:
        perimeter = None
        try:
            if "error" in v.params:
                raise ValueError(v.params["error"])
            perimeter = F.expr(v.perimeter) if v.perimeter else F.lit(True)
        except Exception as exc:                            # noqa: BLE001 - reported per validation
            out.append(Prepared(v, "error", error=f"perimeter: {exc}"))
            continue
        try:
            kind = _level(v, custom, ctx)
            params = dict(v.params)
            if kind == "row":
                helpers = {}
                if v.implementation == "CUSTOM":
                    columns = list(params.get("columns") or [])
                    if custom.kind(ctx.spark, v.rule_name) == "sql":
                        name = f"_tessera_sql_{len(out)}"
                        helpers[name] = custom.ok_expression(ctx.spark, v.rule_name, columns)
                        fail = ~F.col(name)
                    else:
                        fail = custom.failing_condition(ctx.spark, v.rule_name, columns)
                else:
                    fail = ROW_RULES[v.rule_name](df, params, ctx)
                value = value_column(params, primary_key)
                # one analysis for perimeter, rule and value together
                (df.withColumns(helpers) if helpers else df).select(perimeter, fail, value).schema
                out.append(Prepared(v, "row", perimeter=perimeter, fail=fail, value=value, helpers=helpers))
            else:
                broken = fused_aggregate(df, v, perimeter, ctx)
                if broken is not None:
                    value = value_column(params, primary_key)
                    df.select(value).schema
                    out.append(Prepared(v, "aggregate", perimeter=perimeter, value=value, broken=broken))
                    continue
                scoped = df.filter(perimeter) if v.perimeter else df      # analyses the perimeter
                if v.implementation == "CUSTOM":
                    failing = custom.failing_frame(v.rule_name, scoped, list(params.get("columns") or []))
                else:
                    failing = DATASET_RULES[v.rule_name](scoped, params, ctx)
                summary = ctx.aggregate_evidence == "summary" and (
                    v.rule_name.startswith("is_aggr_") or v.rule_name == "has_valid_schema")
                projected = _project(failing, v.validation_id, params, primary_key, summary)
                projected.schema                             # analysis
                out.append(Prepared(v, "dataset", perimeter=perimeter, failing=projected))
        except Exception as exc:                            # noqa: BLE001
            # attribute the failure: an invalid perimeter counts 0 rows
            if _analyses(df, perimeter):
                out.append(Prepared(v, "error", perimeter=perimeter, error=str(exc)))
            else:
                out.append(Prepared(v, "error", error=f"perimeter: {exc}"))
    return out


def fused_aggregate(df: DataFrame, v: Validation, perimeter: Column, ctx: RuleContext) -> Column | None:
    """Whether an aggregate rule is broken, as one expression over all of
    ``df``; None where that is not the rule's meaning: other rules, evidence in
    summary form, a limit that is a column, an exact distinct count (it would
    multiply the rows of the common aggregate)."""
    if v.implementation == "CUSTOM" or ctx.aggregate_evidence == "summary":
        return None
    broken = broken_aggregate(v.rule_name, v.params, ctx, perimeter if v.perimeter else None)
    try:
        if broken is not None:
            df.agg(broken).schema
        return broken
    except Exception:                                       # noqa: BLE001 - the plain plan tells what is wrong
        return None


def resolve_aggregates(df: DataFrame, prepared: list[Prepared]) -> list[Prepared]:
    """Aggregate kinds as row kinds of a lazy plan: all of them are computed by
    one scalar subquery, and every row of the perimeter of a broken one fails."""
    at = [i for i, p in enumerate(prepared) if p.kind == "aggregate"]
    if not at:
        return prepared
    flags = df.agg(F.struct(*[prepared[i].broken.alias(f"b{i}") for i in at]).alias("broken")).scalar()
    return [replace(p, kind="row", fail=flags[f"b{i}"]) if p.kind == "aggregate" else p for i, p in enumerate(prepared)]


def settle_aggregates(prepared: list[Prepared], counts: dict) -> list[Prepared]:
    """Aggregate kinds after the count aggregate has run: passing ones have no
    evidence and are left as they are, broken ones become row kinds."""
    return [replace(p, kind="row", fail=F.lit(True)) if p.kind == "aggregate" and counts.get(f"b{i}") else p for i, p in enumerate(prepared)]


def _analyses(df: DataFrame, c: Column) -> bool:
    try:
        df.select(c).schema
        return True
    except Exception:                                       # noqa: BLE001
        return False


def _fails_inside(p: Prepared) -> Column:
    return p.perimeter & F.coalesce(p.fail, F.lit(False))


def row_evidence(df: DataFrame, prepared: list[Prepared], primary_key: str) -> DataFrame:
    """Evidence of all row-level and aggregate validations in one scan of
    ``df`` (and one more for the aggregates that are not settled yet)."""
    prepared = resolve_aggregates(df, prepared)
    rows = [p for p in prepared if p.kind == "row"]
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], RAW_EVIDENCE_SCHEMA)
    df = with_helpers(df, prepared)
    pk = pk_text(primary_key).alias("table_pk")
    if len(rows) == 1:
        p = rows[0]
        return df.filter(_fails_inside(p)).select(
            F.lit(p.validation.validation_id).alias("validation_id"), pk, p.value.alias("failed_value"))
    any_fail = reduce(lambda a, b: a | b, [_fails_inside(p) for p in rows])
    # the generator carries a small int per failing rule (cheaper to build
    # per row than the id string); ids are looked up afterwards in a
    # codegen'd projection
    hits = F.array_compact(F.array(*[
        F.when(_fails_inside(p), F.struct(F.lit(i).alias("_rule"), p.value.alias("failed_value")))
        for i, p in enumerate(rows)]))
    ids = F.array(*[F.lit(p.validation.validation_id) for p in rows])
    return (df.filter(any_fail)
            .select(pk, F.inline(hits))
            .select(F.element_at(ids, F.col("_rule") + 1).alias("validation_id"), "table_pk", "failed_value"))


def dataset_evidence(prepared: list[Prepared]) -> list[DataFrame]:
    return [p.failing for p in prepared if p.kind == "dataset"]


def evidence(df: DataFrame, prepared: list[Prepared], primary_key: str) -> DataFrame:
    """(validation_id, table_pk, failed_value) for every failing record."""
    frames = dataset_evidence(prepared)
    if any(p.kind in ("row", "aggregate") for p in prepared) or not frames:
        frames = [row_evidence(df, prepared, primary_key)] + frames
    return reduce(lambda a, b: a.unionByName(b), frames)


def count_columns(prepared: list[Prepared]) -> list[Column]:
    """Aggregate expressions for perimeter and row-rule failure counts and
    for broken aggregate rules, named p<i> / f<i> / b<i> by position in
    ``prepared``. Validations without a
    perimeter share the one row count ``_rows`` (see ``perimeter_name``)."""
    cols = [F.count(F.lit(1)).alias("_rows")]
    for i, p in enumerate(prepared):
        if p.perimeter is not None and p.validation.perimeter:
            cols.append(F.count_if(p.perimeter).alias(f"p{i}"))
        if p.kind == "row":
            cols.append(F.count_if(_fails_inside(p)).alias(f"f{i}"))
        elif p.kind == "aggregate":
            cols.append(p.broken.alias(f"b{i}"))
    return cols


def perimeter_name(i: int, p: Prepared) -> str | None:
    """Column of ``count_columns`` holding the perimeter count of ``p``."""
    if p.perimeter is None:
        return None
    return f"p{i}" if p.validation.perimeter else "_rows"


def row_counts(df: DataFrame, prepared: list[Prepared]) -> dict:
    """Run the count aggregate: {p<i>: perimeter, f<i>: failures, b<i>: broken}
    (one job, one row back to the driver)."""
    cols = count_columns(prepared)
    if not cols:
        return {}
    return with_helpers(df, prepared).agg(*cols).first().asDict()


def results(df: DataFrame, prepared: list[Prepared]) -> DataFrame:
    """One row per validation: status, perimeter and failed counts.

    Perimeters, row-rule failures and aggregate rules come from ONE aggregate
    over ``df``; each other dataset rule adds a count over its (small) failing frame. The pieces
    are unioned and summed per validation -- no join.
    """
    spark = df.sparkSession
    schema = "validation_id string, perimeter long, failed long"
    counts = count_columns(prepared)
    pieces = []
    if counts:
        one = with_helpers(df, prepared).agg(*counts)
        structs = []
        for i, p in enumerate(prepared):
            if p.perimeter is None:
                continue
            failed = F.lit(None).cast(LongType())
            if p.kind == "row":
                failed = F.col(f"f{i}")
            elif p.kind == "aggregate":
                failed = F.when(F.col(f"b{i}"), F.col(perimeter_name(i, p))).otherwise(F.lit(0))
            structs.append(F.struct(F.lit(p.validation.validation_id).alias("validation_id"),
                                    F.col(perimeter_name(i, p)).cast(LongType()).alias("perimeter"),
                                    failed.cast(LongType()).alias("failed")))
        pieces.append(one.select(F.inline(F.array(*structs))))
    for p in prepared:
        if p.kind == "dataset":
            pieces.append(p.failing.agg(F.count(F.lit(1)).cast(LongType()).alias("failed"))
                          .select(F.lit(p.validation.validation_id).alias("validation_id"),
                                  F.lit(None).cast(LongType()).alias("perimeter"), "failed"))
    if not pieces:
        pieces.append(spark.createDataFrame([], schema))
    counted = (reduce(lambda a, b: a.unionByName(b), pieces)
               .groupBy("validation_id")
               .agg(F.sum("perimeter").alias("perimeter"), F.sum("failed").alias("failed")))
    meta = spark.createDataFrame(
        [(p.validation.validation_id, p.validation.rule_id, p.kind == "error") for p in prepared],
        "validation_id string, rule_id string, is_error boolean")
    return (meta.join(counted, "validation_id", "left")
            .select("validation_id", "rule_id",
                    F.when(F.col("is_error"), F.lit("ERROR"))
                     .when(F.coalesce(F.col("failed"), F.lit(0)) > 0, F.lit("FAILED"))
                     .otherwise(F.lit("PASSED")).alias("status"),
                    F.coalesce(F.col("perimeter"), F.lit(0)).cast(LongType()).alias("perimeter"),
                    F.when(F.col("is_error"), F.lit(0))
                     .otherwise(F.coalesce(F.col("failed"), F.lit(0))).cast(LongType())
                     .alias("failed_records_count")))


def validate(df: DataFrame, validations: list[Validation], primary_key: str,
             ctx: RuleContext, custom: CustomRules | None = None) -> tuple[DataFrame, DataFrame]:
    """Lazy (results, evidence) of one table."""
    prepared = prepare(df, validations, primary_key, ctx, custom)
    return results(df, prepared), evidence(df, prepared, primary_key)
