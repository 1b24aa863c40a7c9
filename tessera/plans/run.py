"""Run the validations of one or many tables and record them in the ledger.

Per table and execution:

1. ONE aggregate scan returns every perimeter and row-rule failure count as a
   single row (partial aggregation per task, codegen'd -- measured cheaper
   than collecting the same counts through an ``Observation``). It is also
   the first plan to evaluate every rule, so a rule raising at run time
   (ANSI) is isolated here before anything is written.
   Aggregate rules are part of it; a broken one goes on as a row rule.
2. Each other dataset-level rule writes its failing rows once to the execution's
   staging folder under the shared checkpoint directory, several rules at a
   time; their counts come from the writes.
3. ONE aggregate classifies the evidence -- the row-rule evidence plan (scan
   -> filter -> generate, never staged), the staged dataset evidence and the
   previous execution's evidence of the same table -- into new / persistent /
   resolved, de-duplicating in the same pass; the result is written once.
4. Counts per validation are read from it and the new and persistent rows
   are appended to the ledger with their flag; results and the execution row
   follow. The ledger is append-only; nothing is updated afterwards, and the
   staging folder is removed only after every append succeeded. Every append is
   a leaf of its own, so runs may overlap; a START event before and an END event
   after each table tell runs that died.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import Future
from functools import reduce
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark import InheritableThread
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.functions.lists import parse_comma_list
from tessera.operators.context import RuleContext
from tessera.operators.custom import CustomRules, default_custom_rules
from tessera.operators.dataset_rules import key_columns
from tessera.operators.uniqueness import UniqueRule, combinable, is_unique_many
from tessera.plans.config import active_validations, validation_plan
from tessera.plans.persistence import classify, counts_by_validation, finished_executions, flag_classified
from tessera.plans.validate import (
    Prepared,
    Validation,
    _fails_inside,
    perimeter_name,
    prepare,
    row_counts,
    row_evidence,
    settle_aggregates,
    value_column,
    with_helpers,
)
from tessera.schemas import EVENTS_SCHEMA, EVIDENCE_KEY, EVIDENCE_SCHEMA, EXECUTIONS_SCHEMA, RESULTS_SCHEMA
from tessera.session import scratch_path
from tessera.sources.catalog import TableResolver, path_exists
from tessera.sources.ledger_store import EVENTS, EVIDENCES, EXECUTIONS, RESULTS, RULES, TABLES, VALIDATIONS, Store, leaf_name

UNIQUE = "dataset_unique"       # staged evidence of all uniqueness rules
STATUS_RANK = {"SKIPPED": 0, "SUCCESS": 1, "FAILED": 2, "ERROR": 3}


def _delete(spark: SparkSession, path: str) -> None:
    """Remove this execution's staging folder (Hadoop FS, recursive)."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hpath):
        fs.delete(hpath, True)


class _Clock:
    def __init__(self):
        self.t = time.perf_counter()
        self.laps: dict[str, float] = {}

    def lap(self, name: str) -> None:
        now = time.perf_counter()
        self.laps[name] = round(now - self.t, 3)
        self.t = now


@dataclass
class TableOutcome:
    table_name: str
    table_id: str | None
    status: str
    executed: int = 0
    failed: int = 0
    errors: int = 0
    results: list[dict] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None


def table_totals(statuses: list[str]) -> tuple[str, int, int, int]:
    """Status of a table, and how many validations were executed, failed and
    ended in an error."""
    failed, errors = statuses.count("FAILED"), statuses.count("ERROR")
    return "SUCCESS" if failed + errors == 0 else "FAILED", len(statuses), failed, errors


@dataclass
class RunReport:
    execution_id: str
    status: str
    tables: list[TableOutcome]


class Runner:
    def __init__(self, spark: SparkSession, store: Store, resolver: TableResolver | None = None,
                 custom: CustomRules | None = None, as_of=None, aggregate_evidence: str = "rows",
                 keep_staging: bool = False, parallel_rules: int = 4):
        self.spark = spark
        self.store = store
        self.resolver = resolver or TableResolver(spark)
        self.custom = custom or default_custom_rules(spark)
        self.as_of = as_of
        self.aggregate_evidence = aggregate_evidence
        self.step_seconds: dict[str, dict[str, float]] = {}   # per table: seconds per step
        self.keep_staging = keep_staging
        self.parallel_rules = max(parallel_rules, 1)          # dataset rules of a table under way at once

    # -- public -----------------------------------------------------------
    def run(self, tables: str | None = None, severity: str | None = None,
            validation_id: str | None = None, now: datetime | None = None) -> RunReport:
        """Validate the named tables (comma list; blank or 'all' = every
        configured table) as one execution."""
        config = self.store.read(TABLES).collect()            # config-sized
        wanted = (tables or "").strip()
        names = ([r.table_name for r in config] if not wanted or wanted.lower() == "all"
                 else parse_comma_list(wanted))
        started = now or datetime.now(timezone.utc).replace(tzinfo=None)
        execution_id = str(uuid.uuid4())
        outcomes = []
        for name in names:
            t0 = time.time()
            cfg = next((r for r in config if r.table_name == name), None)
            table_id = cfg.table_id if cfg else name
            self.log_event(execution_id, table_id, "START", started)
            try:
                out = self.run_table(name, config, execution_id, started, severity, validation_id)
            except Exception as exc:                        # noqa: BLE001 - one table must not end the others
                out = TableOutcome(name, cfg.table_id if cfg else None, "ERROR", error=str(exc))
            out.seconds = round(time.time() - t0, 2)
            outcomes.append(out)
            # a row per table as soon as it ends: a run that dies later leaves a
            # trace, and the tables done are a base for the next run
            self.log_executions(execution_id, started, [out])
            self.log_event(execution_id, table_id, "END", started, out.status)
        status = max((o.status for o in outcomes), key=STATUS_RANK.get, default="SKIPPED")
        return RunReport(execution_id, status, outcomes)

    # -- one table --------------------------------------------------------
    def run_table(self, name, config, execution_id, started, severity=None, validation_id=None) -> TableOutcome:
        cfg = next((r for r in config if r.table_name == name), None)
        if cfg is None:
            return TableOutcome(name, None, "SKIPPED")
        vals = active_validations(self.store.read(VALIDATIONS), cfg.table_id, severity, validation_id)
        rows = validation_plan(vals, self.store.read(RULES)).collect()   # config-sized
        if not rows:
            return TableOutcome(name, cfg.table_id, "SUCCESS")
        try:
            df = self.resolver(cfg.table_name_tech)
            df.schema
        except Exception:                                   # noqa: BLE001 - unreadable table
            return TableOutcome(name, cfg.table_id, "ERROR")
        literal = frozenset(r.technical_rule_name for r in rows if r.requires_literal_conversion)
        validations = [Validation.from_config(r) for r in rows]
        out = self.run_frame(df, cfg.table_id, validations, cfg.primary_key, execution_id, started, literal)
        out.table_name = name
        return out

    def run_frame(self, df: DataFrame, table_id: str, validations: list[Validation], primary_key: str,
                  execution_id: str, started: datetime, literal_rules=frozenset()) -> TableOutcome:
        """Validate one DataFrame as table ``table_id`` within an execution:
        stage evidence, classify it against the previous execution of the
        table, append evidence and results to the ledger."""
        day = started.date()
        if self._recorded(RESULTS, execution_id, day, [v.validation_id for v in validations]):
            return TableOutcome(table_id, table_id, "SKIPPED")   # replay of a recorded execution
        staging = scratch_path(self.spark, "tessera-staging", execution_id, table_id)

        def stage(frame: DataFrame) -> DataFrame:
            path = f"{staging}/read_{uuid.uuid4().hex}"
            frame.write.parquet(path)
            return self.spark.read.schema(frame.schema).parquet(path)
        # one clock for the count job and the evidence job
        ctx = RuleContext(self.spark, self.resolver, frozenset(literal_rules), self.as_of or started, self.aggregate_evidence, stage)
        prepared = prepare(df, validations, primary_key, ctx, self.custom)

        clock = _Clock()
        perimeters, failures, prepared = self._count_rows(df, prepared)
        clock.lap("row_counts")
        failures.update(self._stage_datasets(df, prepared, primary_key, staging))
        clock.lap("dataset_rules")
        # row evidence is not staged: its plan (scan -> generate) feeds the
        # classification aggregate directly, so it crosses one shuffle and no
        # per-scan-task files are written
        rows = [p for p in prepared if p.kind == "row"]
        row_ev = row_evidence(df, rows, primary_key) if rows else None
        counts = self._classify_and_append(table_id, [p.validation.validation_id for p in prepared],
                                           execution_id, started, staging, row_ev)
        clock.lap("classify_append")
        results = []
        for p in prepared:
            vid = p.validation.validation_id
            if p.kind == "error":
                status, failed = "ERROR", 0
            else:
                failed = int(failures.get(vid, 0))
                status = "FAILED" if failed > 0 else "PASSED"
            new, persistent, resolved = counts.get(vid, (0, 0, 0))
            results.append(dict(
                validation_trace_id=f"{execution_id}:{vid}", execution_id=execution_id, validation_id=vid,
                rule_id=p.validation.rule_id, status=status, perimeter=int(perimeters.get(vid, 0)),
                failed_records_count=failed, persistent_failures=persistent, new_failures=new,
                resolved_failures=resolved, execution_date=day))
        self.store.append(RESULTS, self.spark.createDataFrame(results, RESULTS_SCHEMA).coalesce(1), leaf_name(execution_id, table_id), day)
        clock.lap("results")
        if not self.keep_staging:
            _delete(self.spark, staging)       # only after every append succeeded
        self.step_seconds[table_id] = clock.laps
        totals = table_totals([r["status"] for r in results])
        return TableOutcome(table_id, table_id, *totals, results)

    def _recorded(self, name: str, execution_id: str, day, validation_ids: list[str]) -> bool:
        """Has this execution already been written for these validations?
        (partition-pruned existence probe)"""
        ledger = self.store.read_day(name, day)
        hit = ledger.filter((F.col("execution_id") == execution_id)
                            & F.col("validation_id").isin(validation_ids)).limit(1).count()
        return hit > 0

    def _count_rows(self, df: DataFrame, prepared: list[Prepared]):
        """All perimeter and row-rule failure counts in one aggregate. It is
        also the first plan to evaluate every rule on every row, so a rule
        that raises at run time (ANSI) is found here, isolated and marked
        ERROR before any output is written."""
        while True:
            try:
                got = row_counts(df, prepared)
                break
            except Exception:                               # noqa: BLE001 - run-time error in a rule
                culprits = self._isolate(df, prepared)
                if not culprits:
                    raise
                prepared = [Prepared(p.validation, "error", perimeter=culprits[i], error="run-time error")
                            if i in culprits else p for i, p in enumerate(prepared)]
        perimeters, failures = {}, {}
        for i, p in enumerate(prepared):
            vid = p.validation.validation_id
            name = perimeter_name(i, p)
            if name in got:
                perimeters[vid] = got[name]
            if f"f{i}" in got:
                failures[vid] = got[f"f{i}"]
            elif got.get(f"b{i}"):
                failures[vid] = got[name]
        return perimeters, failures, settle_aggregates(prepared, got)

    def _isolate(self, df: DataFrame, prepared: list[Prepared]) -> dict:
        """Re-run each perimeter and each row rule alone to find the ones that
        raise (ANSI). Returns {position: perimeter to go on counting}, None
        where the perimeter itself raises."""
        def raises(frame: DataFrame, condition) -> bool:
            try:
                frame.agg(F.count_if(condition)).collect()
                return False
            except Exception:                               # noqa: BLE001
                return True
        bad = {}
        for i, p in enumerate(prepared):
            if p.perimeter is not None and p.validation.perimeter and raises(df, p.perimeter):
                bad[i] = None
            elif p.kind == "row" and raises(with_helpers(df, [p]), _fails_inside(p)):
                bad[i] = p.perimeter
            elif p.kind == "aggregate" and raises(df.agg(p.broken.alias("broken")), F.col("broken")):
                bad[i] = p.perimeter
        return bad

    def _stage_datasets(self, df: DataFrame, prepared: list[Prepared], primary_key: str, staging: str) -> dict:
        """Each dataset rule: write its evidence; the write counts the rows.
        Several uniqueness rules are one plan.

        ``parallel_rules`` rules are under way at once, each in a thread with a
        scheduler pool of its own (shares are equal where the deployment sets
        ``spark.scheduler.mode`` to FAIR); one that fails is marked ERROR."""
        failures = self._stage_unique(df, prepared, primary_key, staging)
        waiting = [(i, p) for i, p in enumerate(prepared) if p.kind == "dataset" and p.validation.validation_id not in failures]
        done: dict[int, Future] = {i: Future() for i, _ in waiting}
        context = self.spark.sparkContext

        def work() -> None:
            while True:
                try:
                    i, p = waiting.pop(0)                   # atomic
                except IndexError:
                    return
                context.setLocalProperty("spark.scheduler.pool", f"tessera-rule-{i}")
                try:
                    counted = Observation()
                    p.failing.observe(counted, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{staging}/dataset_{i}")
                    done[i].set_result(counted.get["n"])
                except Exception as exc:                    # noqa: BLE001 - reported per validation
                    done[i].set_exception(exc)
        threads = [InheritableThread(target=work) for _ in range(min(self.parallel_rules, len(waiting)))]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        for i, result in done.items():
            p = prepared[i]
            if result.exception() is None:
                failures[p.validation.validation_id] = result.result()
            else:
                _delete(self.spark, f"{staging}/dataset_{i}")
                prepared[i] = Prepared(p.validation, "error", perimeter=p.perimeter, error=str(result.exception()))
        return failures

    def _stage_unique(self, df: DataFrame, prepared: list[Prepared], primary_key: str, staging: str) -> dict:
        """Evidence and counts of the uniqueness rules, if there are several;
        none of them where they cannot be taken together or one raises, which is
        then found rule by rule."""
        rules = []
        for p in prepared:
            v = p.validation
            if p.kind == "dataset" and v.implementation == "BUILT-IN" and v.rule_name == "is_unique":
                columns = key_columns(v.params)
                if combinable(df, columns):
                    rules.append(UniqueRule(v.validation_id, columns, value_column(v.params, primary_key), p.perimeter if v.perimeter else None))
        if len(rules) < 2 or len({r.validation_id for r in rules}) < len(rules):
            return {}
        counted, path = Observation(), f"{staging}/{UNIQUE}"
        try:
            found = is_unique_many(df, rules, primary_key)
            counts = [F.count_if(F.col("validation_id") == r.validation_id).alias(f"n{i}") for i, r in enumerate(rules)]
            found.observe(counted, *counts).write.mode("overwrite").parquet(path)
        except Exception:                                   # noqa: BLE001 - run-time error in a rule
            _delete(self.spark, path)
            return {}
        return {r.validation_id: counted.get[f"n{i}"] for i, r in enumerate(rules)}

    def _previous(self, table_id: str, validation_ids: list[str], started: datetime) -> DataFrame:
        """Evidence to compare with: per validation, that of the latest earlier
        execution of the table that gave it a verdict. A run of some of the
        validations, or one in which a validation ended in an error, is no
        base for the validations it says nothing about."""
        runs = (finished_executions(self.store.read(EXECUTIONS))
                .filter((F.col("table_id") == table_id) & (F.col("execution_timestamp") < F.lit(started)))
                .select("execution_id", "execution_date", "execution_timestamp"))
        verdicts = (self.store.read(RESULTS).filter(F.col("validation_id").isin(validation_ids) & F.col("status").isin("PASSED", "FAILED"))
                    .select("execution_id", "validation_id"))
        last = F.max(F.struct("execution_timestamp", "execution_id", "execution_date"))
        base = verdicts.join(runs, "execution_id").groupBy("validation_id").agg(last.alias("run")).collect()    # config-sized
        if not base:
            return self.spark.createDataFrame([], EVIDENCE_SCHEMA)
        # one scan, however many bases: only their days are listed and read, and
        # the rows meet the (validation, execution) pairs
        days, runs = ({getattr(r.run, c) for r in base} for c in ("execution_date", "execution_id"))
        pairs = self.spark.createDataFrame([(r.validation_id, r.run.execution_id) for r in base], "validation_id string, execution_id string")
        held = self.store.read_days(EVIDENCES, days).filter(F.col("execution_date").isin(*days) & F.col("execution_id").isin(*runs))
        return held.join(pairs, ["validation_id", "execution_id"], "left_semi").select(*EVIDENCE_SCHEMA.names)

    def _classify_and_append(self, table_id: str, validation_ids: list[str], execution_id: str,
                             started: datetime, staging: str, row_ev: DataFrame | None = None) -> dict:
        """Flag staged evidence against the previous execution of the same
        table, append it to the ledger, return {vid: (new, persistent, resolved)}."""
        if self._recorded(EVIDENCES, execution_id, started.date(), validation_ids):
            # rerun after the evidence append: nothing is appended again, and the
            # counts are recomputed from the ledger, for the staging folder may
            # have gone with the driver that died
            held = (self.store.read_day(EVIDENCES, started.date())
                    .filter((F.col("execution_id") == execution_id) & F.col("validation_id").isin(validation_ids)))
            rows = counts_by_validation(classify(held, self._previous(table_id, validation_ids, started))).collect()
            return {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures) for r in rows}
        parts = [f"{staging}/{UNIQUE}", *[f"{staging}/dataset_{i}" for i in range(len(validation_ids))]]
        parts = [p for p in parts if self.store_exists(p)]
        frames = ([row_ev] if row_ev is not None else []) + ([self.spark.read.parquet(*parts)] if parts else [])
        if not frames:
            frames = [self.spark.createDataFrame([], EVIDENCE_SCHEMA)]      # earlier failures may still be resolved
        # no separate de-duplication: the classification below groups by the
        # evidence key, and ids are deterministic, so duplicates collapse there
        current = reduce(lambda a, b: a.unionByName(b), [f.select(*EVIDENCE_KEY) for f in frames])
        previous = self._previous(table_id, validation_ids, started)
        # one aggregate: de-duplicates the current evidence and classifies it
        classified = classify(current, previous)
        # materialise once: counts and the ledger append both read it
        classified.write.mode("overwrite").parquet(f"{staging}/classified")
        staged = self.spark.read.parquet(f"{staging}/classified")
        rows = counts_by_validation(staged).collect()        # one row per validation
        flagged = flag_classified(staged, execution_id, started.date())
        self.store.append(EVIDENCES, flagged, leaf_name(execution_id, table_id), started.date())
        return {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures) for r in rows}

    def persistence_from_ledger(self, table_id: str) -> DataFrame:
        """New / persistent / resolved per validation for the latest finished
        execution of ``table_id``, recomputed from the ledger alone (the
        separate persistence job of the original flow; useful for audits and
        backfills). Only validations that execution gave a verdict count, each
        against the base the run itself takes (``_previous``)."""
        ex = (finished_executions(self.store.read(EXECUTIONS)).filter(F.col("table_id") == table_id)
              .orderBy(F.col("execution_timestamp").desc(), F.col("execution_id").desc())
              .select("execution_id", "execution_date", "execution_timestamp").first())
        empty = self.spark.createDataFrame([], EVIDENCE_SCHEMA)
        if ex is None:
            return counts_by_validation(classify(empty, empty))
        of_table = self.store.read(VALIDATIONS).filter(F.col("table_id") == table_id).select("validation_id")
        vids = [r.validation_id for r in self.store.read(RESULTS)
                .filter((F.col("execution_id") == ex.execution_id) & F.col("status").isin("PASSED", "FAILED"))
                .join(of_table, "validation_id", "left_semi").select("validation_id").distinct().collect()]  # config-sized
        current = (self.store.read_day(EVIDENCES, ex.execution_date)
                   .filter((F.col("execution_id") == ex.execution_id) & F.col("validation_id").isin(vids)))
        return counts_by_validation(classify(current, self._previous(table_id, vids, ex.execution_timestamp)))

    def store_exists(self, path: str) -> bool:
        return path_exists(self.spark, path)

    def log_executions(self, execution_id: str, started: datetime, outcomes: list[TableOutcome]) -> None:
        from decimal import Decimal
        rows = [dict(execution_id=execution_id, table_id=o.table_id or o.table_name,
                     execution_timestamp=started, execution_date=started.date(), status=o.status,
                     duration_seconds=Decimal(str(o.seconds)), validations_executed=o.executed,
                     validations_failed=o.failed, validations_errors=o.errors) for o in outcomes]
        if rows:
            self.store.append(EXECUTIONS, self.spark.createDataFrame(rows, EXECUTIONS_SCHEMA).coalesce(1),
                              leaf_name(execution_id, *(r["table_id"] for r in rows)), started.date())

    def log_event(self, execution_id: str, table_id: str, event: str, started: datetime, status: str | None = None) -> None:
        """One START or END event; ``execution_states`` makes states of them.
        A repeated event replaces the earlier one of the same kind."""
        row = (execution_id, table_id, event, datetime.now(timezone.utc), status, started.date())
        self.store.append(EVENTS, self.spark.createDataFrame([row], EVENTS_SCHEMA).coalesce(1), leaf_name(execution_id, table_id, event), started.date())
