"""Table mutations expressed as DataFrame plans.

Plain Spark tables have no MERGE/UPDATE, so each mutation returns the new
table contents (to be written once, e.g. overwrite of a config table or an
append to the ledger) instead of editing rows in place. All are joins on the
merge keys -- no driver loops; AQE decides broadcast vs. shuffle from the
measured sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MATCHED = "_tessera_matched"
_PRESENT = "_tessera_present"


def _and(conds):
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


class RepeatedKeyError(ValueError):
    pass


def require_unique(source: DataFrame, keys: list[str]) -> None:
    """A MERGE refuses a source that matches a row twice; so do the updates
    here (one aggregate, stops at the first repeated key)."""
    if not source.groupBy(*keys).count().filter("count > 1").limit(1).isEmpty():
        raise RepeatedKeyError(f"the source repeats keys in {keys}")


def reflect(target: DataFrame, source: DataFrame, keys: list[str],
            audit: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Make ``target`` an exact copy of ``source`` by key: update matched
    rows, insert new ones, delete rows the source no longer has.

    Returns ``(new_contents, changes)``; ``changes`` has the keys plus
    ``action`` in INSERT / UPDATE / DELETE / UNCHANGED, from one full outer
    join. ``audit`` columns (time of the last change) take no part in the
    comparison, and an unchanged row keeps its old ones.
    """
    cols = [c for c in source.columns if c not in keys]
    compared = [c for c in cols if c not in audit]
    t = target.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_t_{c}") for c in cols],
                      F.lit(True).alias("_t_present"))
    s = source.select(*[F.col(k) for k in keys], *[F.col(c).alias(f"_s_{c}") for c in cols],
                      F.lit(True).alias("_s_present"))
    joined = t.join(s, on=keys, how="full_outer")
    unchanged = _and([_same(F.col(f"_t_{c}"), F.col(f"_s_{c}")) for c in compared])
    action = (F.when(F.col("_t_present").isNull(), F.lit("INSERT"))
              .when(F.col("_s_present").isNull(), F.lit("DELETE"))
              .when(unchanged, F.lit("UNCHANGED"))
              .otherwise(F.lit("UPDATE")))
    changes = joined.select(*keys, action.alias("action"))
    if not audit:
        return source, changes
    contents = joined.filter("_s_present").withColumn("_action", action).select(*[
        F.col(c) if c in keys else (F.when(F.col("_action") == "UNCHANGED", F.col(f"_t_{c}")).otherwise(F.col(f"_s_{c}")) if c in audit
                                    else F.col(f"_s_{c}")).alias(c) for c in source.columns])
    return contents, changes


def update_matched(target: DataFrame, updates: DataFrame, keys: list[str],
                   set_columns: list[str] | None = None) -> DataFrame:
    """MERGE ... WHEN MATCHED UPDATE SET: matched rows take the update's
    values (even NULL) for ``set_columns``; other rows are unchanged.
    ``updates`` must be unique on ``keys``."""
    require_unique(updates, keys)
    set_columns = set_columns or [c for c in updates.columns if c not in keys]
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in set_columns],
                       F.lit(True).alias(_MATCHED))
    joined = target.join(u, on=keys, how="left")
    out = []
    for c in target.columns:
        if c in set_columns:
            out.append(F.when(F.col(_MATCHED), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def upsert(target: DataFrame, source: DataFrame, keys: list[str],
           set_columns: list[str] | None = None) -> DataFrame:
    """MERGE ... WHEN MATCHED UPDATE SET ... WHEN NOT MATCHED INSERT:
    one full outer join on ``keys``. Target columns absent from the source
    are kept on update and NULL on insert."""
    require_unique(source, keys)
    set_columns = set_columns or [c for c in source.columns if c not in keys]
    s = source.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in set_columns],
                      F.lit(True).alias(_MATCHED))
    t = target.select(*target.columns, F.lit(True).alias(_PRESENT))
    joined = t.join(s, on=keys, how="full_outer")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in set_columns:
            out.append(F.when(F.col(_MATCHED), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def conditional_update(df: DataFrame, condition: Column | str, assignments: dict) -> DataFrame:
    """UPDATE t SET c = v WHERE cond, as a projection."""
    cond = F.expr(condition) if isinstance(condition, str) else condition
    new = {}
    for c, v in assignments.items():
        value = v if isinstance(v, Column) else F.lit(v)
        new[c] = F.when(F.coalesce(cond, F.lit(False)), value).otherwise(F.col(c)).cast(df.schema[c].dataType)
    return df.withColumns(new)


def conform(df: DataFrame, schema) -> DataFrame:
    """Project ``df`` to a fixed schema: columns by name, cast to the target
    type; a missing column becomes a typed NULL (additive evolution)."""
    have = {c.lower(): c for c in df.columns}
    cols = []
    for f in schema.fields:
        src = have.get(f.name.lower())
        cols.append((F.col(src) if src else F.lit(None)).cast(f.dataType).alias(f.name))
    return df.select(*cols)
