"""New / persistent / resolved failures between two executions.

The comparison key is (validation_id, table_pk, failed_value), NULL-safe.
Instead of two anti joins and an inner join, the two evidence sets are
tagged (current = 1, previous = 2), unioned and grouped by the key with a
bitwise OR of the tags: 1 = new, 2 = resolved, 3 = persistent. That is one
aggregate -- partial aggregation runs before the single shuffle, GROUP BY
treats NULLs as equal keys, and after de-duplication a key has at most one
row per side, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.schemas import EVIDENCE_KEY

NEW, RESOLVED, PERSISTENT = 1, 2, 3
FINISHED = ("SUCCESS", "FAILED")


def finished_executions(executions: DataFrame) -> DataFrame:
    return executions.filter(F.col("status").isin(*FINISHED))


def previous_execution(executions: DataFrame) -> DataFrame:
    """Each finished execution of a table with the preceding one of the
    same table (NULL for the first), ordered by (timestamp, id).

    The lag is taken inside (table, month), so a table with a long history is
    not one task's work; the first execution of a month takes the last one of
    the table's preceding month that has any. Groups follow from the data
    alone, so the result does not depend on how rows are dealt out.
    """
    order = ["execution_timestamp", "execution_id"]
    runs = (finished_executions(executions).select("table_id", "execution_id", "execution_timestamp")
            .withColumn("_month", F.date_trunc("month", "execution_timestamp")))
    inside = Window.partitionBy("table_id", "_month").orderBy(*order)
    months = Window.partitionBy("table_id").orderBy("_month")        # a row per month
    carried = (runs.groupBy("table_id", "_month").agg(F.max(F.struct(*order)).alias("_last"))
               .select("table_id", "_month", F.lag("_last.execution_id").over(months).alias("_carried")))
    local = runs.withColumn("_lag", F.lag("execution_id").over(inside))
    joined = local.join(carried, (local.table_id.eqNullSafe(carried.table_id)) & local._month.eqNullSafe(carried._month), "left")
    return joined.select(local.table_id, "execution_id", "execution_timestamp", F.coalesce("_lag", "_carried").alias("prev_execution_id"))


def latest_execution(executions: DataFrame) -> DataFrame:
    """The latest finished execution per table (ties broken by id)."""
    order = F.struct("execution_timestamp", "execution_id")
    return (finished_executions(executions)
            .groupBy("table_id")
            .agg(F.max_by("execution_id", order).alias("execution_id"),
                 F.max("execution_timestamp").alias("execution_timestamp")))


def execution_states(events: DataFrame, now=None, lost_after_hours: float = 24.0) -> DataFrame:
    """The state of every (execution, table) in a log of START and END events:
    the status of its last END; without one RUNNING, or LOST when its last START
    lies more than ``lost_after_hours`` before ``now`` (default: the clock).
    Columns: started_at, ended_at, seconds (NULL while open) and state. An event
    may be logged repeatedly or out of order; a START after the last END opens
    the table again (a rerun). Ends of equal time: the greatest status counts."""
    now = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    at = F.col("event_timestamp")
    last = F.max_by(F.struct("event", "status"), F.struct(at, F.col("event") == "END", "status"))      # an END follows its START
    open_ = F.col("last.event") == "START"
    lost = F.col("last_start") < now - F.make_dt_interval(hours=F.lit(lost_after_hours).cast("int"))
    return (events.groupBy("execution_id", "table_id")
            .agg(last.alias("last"), F.min(F.when(F.col("event") == "START", at)).alias("started_at"),
                 F.max(F.when(F.col("event") == "START", at)).alias("last_start"), F.max(F.when(F.col("event") == "END", at)).alias("last_end"))
            .select("execution_id", "table_id", "started_at", F.when(~open_, F.col("last_end")).alias("ended_at"),
                    F.when(~open_, F.round((F.col("last_end").cast("double") - F.col("last_start").cast("double")), 2).cast("decimal(10,2)")).alias("seconds"),
                    F.when(~open_, F.col("last.status")).when(lost, F.lit("LOST")).otherwise(F.lit("RUNNING")).alias("state")))


def _tagged(current: DataFrame, previous: DataFrame) -> DataFrame:
    cur = current.select(*EVIDENCE_KEY, F.lit(1).alias("_tag"))
    prev = previous.select(*EVIDENCE_KEY, F.lit(2).alias("_tag"))
    return cur.unionByName(prev)


def classify(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Every key of either side with its state: 1 new, 2 resolved,
    3 persistent. Only fixed-width buffers (an int), so it stays a hash
    aggregate; duplicates within a side collapse here too."""
    return (_tagged(current, previous)
            .groupBy(*EVIDENCE_KEY)
            .agg(F.bit_or("_tag").alias("state")))


def counts_by_validation(classified: DataFrame) -> DataFrame:
    """Per validation: new, persistent and resolved failure counts (never
    NULL). Resolved failures belong to the current execution."""
    return (classified.groupBy("validation_id")
            .agg(F.count_if(F.col("state") == NEW).cast("long").alias("new_failures"),
                 F.count_if(F.col("state") == PERSISTENT).cast("long").alias("persistent_failures"),
                 F.count_if(F.col("state") == RESOLVED).cast("long").alias("resolved_failures")))


def persistence_summary(current: DataFrame, previous: DataFrame) -> DataFrame:
    return counts_by_validation(classify(current, previous))


def new_failures(current: DataFrame, previous: DataFrame) -> DataFrame:
    return classify(current, previous).filter(F.col("state") == NEW).select(*EVIDENCE_KEY)


def resolved_failures(current: DataFrame, previous: DataFrame) -> DataFrame:
    return classify(current, previous).filter(F.col("state") == RESOLVED).select(*EVIDENCE_KEY)


def persistent_failures(current: DataFrame, previous: DataFrame) -> DataFrame:
    return classify(current, previous).filter(F.col("state") == PERSISTENT).select(*EVIDENCE_KEY)


def flag_classified(classified: DataFrame, execution_id: str, execution_date) -> DataFrame:
    """Evidence rows of the current execution (new and persistent keys)
    with ids, execution columns and ``is_new_failure`` -- a projection, no
    shuffle."""
    from tessera.plans.ledger import stage_columns
    return (classified.filter(F.col("state") != RESOLVED)
            .select(*stage_columns(execution_id, execution_date),
                    (F.col("state") == NEW).alias("is_new_failure")))


def flag_evidences(current: DataFrame, previous: DataFrame, execution_id: str, execution_date) -> DataFrame:
    """Current evidence of one execution, de-duplicated and flagged new /
    persistent against the previous one, in a single aggregate."""
    return flag_classified(classify(current, previous), execution_id, execution_date)


def first_run_counts(current: DataFrame) -> DataFrame:
    """No previous execution: every failure is new."""
    return (current.groupBy("execution_id", "validation_id")
            .agg(F.count(F.lit(1)).cast("long").alias("new_failures"))
            .withColumn("persistent_failures", F.lit(0).cast("long"))
            .withColumn("resolved_failures", F.lit(0).cast("long")))
