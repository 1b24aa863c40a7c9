"""Evidence ledger: unify staged evidences, drop duplicates, attach ids."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import evidence_id

DEDUP_KEY = ["execution_id", "validation_id", "table_pk", "failed_value"]


def stage_columns(execution_id: str, execution_date: date | str) -> list:
    """Staged-evidence columns from raw (validation_id, table_pk,
    failed_value) columns: execution columns plus a deterministic id."""
    ex = F.lit(execution_id)
    return [evidence_id(ex, F.col("validation_id"), F.col("table_pk"), F.col("failed_value")).alias("evidence_id"),
            ex.alias("execution_id"), F.col("validation_id"), F.col("failed_value"), F.col("table_pk"),
            F.lit(execution_date).cast("date").alias("execution_date")]


def stage(evidence: DataFrame, execution_id: str, execution_date: date | str) -> DataFrame:
    """Raw evidence (validation_id, table_pk, failed_value) -> staged
    evidence rows with execution columns and a deterministic id."""
    return evidence.select(*stage_columns(execution_id, execution_date))


def dedup_evidences(evidences: DataFrame) -> DataFrame:
    """One row per (execution, validation, pk, value); the evidence id is
    recomputed from the key, so rows staged elsewhere under random ids collapse
    too. The other columns take their smallest value of the key. An aggregate:
    a hot key is combined map-side before the shuffle."""
    rest = [c for c in evidences.columns if c not in (*DEDUP_KEY, "evidence_id")]
    kept = evidences.groupBy(*DEDUP_KEY).agg(*[F.min(c).alias(c) for c in rest]) if rest else evidences.select(*DEDUP_KEY).distinct()
    if "evidence_id" in evidences.columns:
        kept = kept.withColumn("evidence_id", evidence_id(*DEDUP_KEY))
    return kept.select(*evidences.columns)


def unify_evidences(staged: list[DataFrame], ledger_evidences: DataFrame) -> DataFrame:
    """Staged evidences of executions not yet in the ledger, unioned by
    column name (missing columns NULL) and de-duplicated.

    An execution already present in the ledger is skipped whole, so running
    the unify twice adds nothing the second time. Pass the ledger pruned to
    the relevant date partitions where possible.
    """
    if not staged:
        raise ValueError("nothing staged")
    everything = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), staged)
    # one id per staged run: the ids go to the driver, so the evidence rows --
    # which all share few ids -- are filtered where they are, not shuffled on
    # that key
    ids = [r.execution_id for r in everything.select("execution_id").distinct().collect() if r.execution_id is not None]
    done = [r.execution_id for r in ledger_evidences.select("execution_id").filter(F.col("execution_id").isin(ids))
            .distinct().collect()]
    fresh = everything.filter(~F.coalesce(F.col("execution_id").isin(done), F.lit(False))) if done else everything
    return dedup_evidences(fresh)


def unify_job(spark: SparkSession, store, resolver) -> dict[str, int]:
    """Read the staging table of every configured table (absent ones are
    skipped), append what the ledger does not hold, then drop the staging
    tables, those of the catalog and those of the folder. Returns the number of
    rows appended per run and the tables read.

    Only the ledger's partitions of the staged dates are listed and read, and
    the appended rows are counted by the write itself."""
    from tessera.sources.ledger_store import EVIDENCES, TABLES
    names = sorted({r.staging_evidences_table for r in store.read(TABLES).select("staging_evidences_table").collect()
                    if r.staging_evidences_table})                   # config-sized
    present = [n for n in names if resolver.exists(n)]
    if not present:
        return {"tables": 0, "appended": 0}
    staged = [resolver(n) for n in present]
    dates = reduce(lambda a, b: a.unionByName(b), [s.select(F.col("execution_date").cast("string").alias("d")) for s in staged])
    days = [r.d or "__HIVE_DEFAULT_PARTITION__" for r in dates.distinct().collect()]      # a row per staged day
    written = Observation()
    fresh = unify_evidences(staged, store.read_days(EVIDENCES, days))
    store.append(EVIDENCES, fresh.observe(written, F.count(F.lit(1)).alias("n")))
    for n in present:                                                # only after the append
        resolver.drop(n)
    return {"tables": len(present), "appended": written.get["n"]}
