"""New / persistent / resolved failures over the whole history of a ledger.

The verdicts of a validation, in order of their executions, are numbered. A
failure (validation, key, value) is present at some of these numbers; stretches
of consecutive numbers are its islands. At the first number of an island the
failure is new, at the others persistent, and at the number after the last one,
if there is such a verdict, resolved. One window over the evidence decides all
executions at once, however many there are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.plans.persistence import NEW, PERSISTENT, RESOLVED, finished_executions
from tessera.schemas import EVIDENCE_KEY
from tessera.session import scratch_path
from tessera.sources.catalog import path_exists

VERDICTS = ("PASSED", "FAILED")


def verdict_sequence(executions: DataFrame, results: DataFrame, validations: DataFrame) -> DataFrame:
    """Rows (validation_id, execution_id, execution_date, seq, last_seq): the
    verdicts of each validation by finished executions of its table, numbered
    from 1 by (timestamp, execution id). ``validations`` has validation_id and
    table_id."""
    runs = (finished_executions(executions).groupBy("execution_id", "table_id")
            .agg(F.max("execution_timestamp").alias("execution_timestamp"), F.max("execution_date").alias("execution_date")))
    verdicts = results.filter(F.col("status").isin(*VERDICTS)).select("validation_id", "execution_id").distinct()
    placed = (verdicts.join(validations.select("validation_id", "table_id").distinct(), "validation_id")
              .join(runs, ["execution_id", "table_id"]))
    every = Window.partitionBy("validation_id")                 # a row per execution
    return placed.select("validation_id", "execution_id", "execution_date",
                         F.row_number().over(every.orderBy("execution_timestamp", "execution_id")).alias("seq"),
                         F.count(F.lit(1)).over(every).cast("int").alias("last_seq"))


def failure_islands(evidences: DataFrame, sequence: DataFrame) -> DataFrame:
    """The distinct failures of each verdict (validation_id, table_pk,
    failed_value, execution_id, execution_date, seq, last_seq) with since, the
    number at which their island begins, and ends, whether it ends there.
    Evidence of an execution that gave no verdict counts for nothing."""
    found = evidences.select("execution_id", *EVIDENCE_KEY).distinct()
    seen = found.join(sequence, ["validation_id", "execution_id"])
    ordered = Window.partitionBy(*EVIDENCE_KEY).orderBy("seq")  # NULLs are equal here
    new = F.coalesce(F.lag("seq").over(ordered) < F.col("seq") - 1, F.lit(True))
    marked = seen.select("*", F.when(new, F.col("seq")).alias("begins"), F.lead("seq").over(ordered).alias("following"))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.select(*EVIDENCE_KEY, "execution_id", "execution_date", "seq", "last_seq",
                         F.max("begins").over(so_far).alias("since"),
                         F.coalesce(F.col("following") > F.col("seq") + 1, F.lit(True)).alias("ends"))


def failure_flags(islands: DataFrame) -> DataFrame:
    """Per failure and execution: is_new_failure, and for how many verdicts in a
    row it has been open (verdicts_open)."""
    return islands.select("execution_id", *EVIDENCE_KEY, "execution_date", (F.col("since") == F.col("seq")).alias("is_new_failure"),
                          (F.col("seq") - F.col("since") + 1).alias("verdicts_open"))


def history_counts(islands: DataFrame, sequence: DataFrame) -> DataFrame:
    """New, persistent and resolved failures of every verdict, 0 where there are
    none: (validation_id, execution_id, execution_date, three counts)."""
    own = F.struct(F.col("seq").alias("at"), F.when(F.col("since") == F.col("seq"), NEW).otherwise(PERSISTENT).alias("state"))
    gone = F.when(F.col("ends") & (F.col("seq") < F.col("last_seq")), F.struct((F.col("seq") + 1).alias("at"), F.lit(RESOLVED).alias("state")))
    states = islands.select("validation_id", F.inline(F.array_compact(F.array(own, gone))))
    names = {"new_failures": NEW, "persistent_failures": PERSISTENT, "resolved_failures": RESOLVED}
    counted = states.groupBy("validation_id", "at").agg(*[F.count_if(F.col("state") == v).alias(n) for n, v in names.items()])
    return (sequence.join(counted.withColumnRenamed("at", "seq"), ["validation_id", "seq"], "left")
            .select("validation_id", "execution_id", "execution_date", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]))


def _prepare_days(store, name: str, changed: DataFrame, fixed, unfinished: str) -> list[str]:
    """Write the new contents of the days of ``changed`` (execution_date, one
    row per changed ledger row) to the folder ``unfinished``; ``fixed`` maps the
    old rows of those days to the new ones."""
    days = sorted(str(r.execution_date) for r in changed.select("execution_date").distinct().collect())     # a row per touched day
    if days:
        fixed(store.read_days(name, days)).write.mode("overwrite").parquet(unfinished)
    return days


def _take_up(spark: SparkSession, store, name: str, unfinished: str) -> None:
    """Replace the partitions that the folder ``unfinished`` has the complete
    new contents of, and remove it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(unfinished)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if path_exists(spark, f"{unfinished}/_SUCCESS"):
        store.rewrite_days(name, spark.read.schema(store.schema(name)).parquet(unfinished))
    fs.delete(path, True)


def persistence_job(spark: SparkSession, store) -> dict[str, list[str]]:
    """Recompute flags and counters of all executions in the ledger and write
    back what differs: only ``execution_date`` partitions with a changed row are
    replaced, the files of the others stay. Returns the days rewritten per
    table. The new rows of both tables are complete in the shared folder before
    a partition is touched; what a job that ends in between has left there is
    taken up by the next one.

    Needed after evidence was unified late or out of order, after executions
    were removed, or for a ledger filled by other means; a run itself records
    the same figures. Not to be run while a run writes to the same days."""
    from tessera.sources.ledger_store import EVIDENCES, EXECUTIONS, RESULTS, VALIDATIONS
    key = hashlib.sha256(store.base.encode()).hexdigest()[:16]
    unfinished = {n: scratch_path(spark, f"tessera-persistence-{key}", n) for n in (EVIDENCES, RESULTS)}
    for name, path in unfinished.items():
        _take_up(spark, store, name, path)
    sequence = verdict_sequence(store.read(EXECUTIONS), store.read(RESULTS), store.read(VALIDATIONS))
    islands = failure_islands(store.read(EVIDENCES), sequence)
    keys = ["execution_id", *EVIDENCE_KEY]
    flags = failure_flags(islands).select(*[F.col(c).alias(f"f_{c}") for c in keys], F.col("is_new_failure").alias("f_new"))
    counts = history_counts(islands, sequence)
    counters = [c for c in counts.columns if c.endswith("_failures")]
    counts = counts.select(F.col("execution_id").alias("f_execution_id"), F.col("validation_id").alias("f_validation_id"),
                           *[F.col(c).alias(f"f_{c}") for c in counters])

    def same(names: list[str]):
        cond = F.lit(True)
        for c in names:
            cond = cond & F.col(c).eqNullSafe(F.col(f"f_{c}"))
        return cond

    def flagged(rows: DataFrame) -> DataFrame:
        met = rows.join(flags, same(keys), "left")
        return met.withColumn("is_new_failure", F.coalesce("f_new", "is_new_failure")).select(*rows.columns)

    def counted(rows: DataFrame) -> DataFrame:
        met = rows.join(counts, same(["execution_id", "validation_id"]), "left")
        return met.withColumns({c: F.coalesce(f"f_{c}", c) for c in counters}).select(*rows.columns)

    wrong_flags = store.read(EVIDENCES).join(flags, same(keys)).filter(~F.col("is_new_failure").eqNullSafe(F.col("f_new")))
    wrong_counts = store.read(RESULTS).join(counts, same(["execution_id", "validation_id"])).filter(~same(counters))
    days = {EVIDENCES: _prepare_days(store, EVIDENCES, wrong_flags, flagged, unfinished[EVIDENCES]),
            RESULTS: _prepare_days(store, RESULTS, wrong_counts, counted, unfinished[RESULTS])}
    for name, path in unfinished.items():
        _take_up(spark, store, name, path)
    return days
