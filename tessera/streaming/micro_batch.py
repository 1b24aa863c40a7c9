"""Validate a stream: every micro-batch is one execution of a table.

The rules are the batch rules unchanged -- ``foreachBatch`` hands each
micro-batch to the same runner, so evidence, results and the new /
persistent / resolved classification against the previous batch all come
from the batch plans.

Replays are harmless: the execution id is derived from the stream name and
the batch id, and the batch's start time is recorded in the shared
checkpoint folder before any output is written, so a batch re-run after a
failure maps to the same execution (same id, same date partition) and the
runner's existence probe skips what was already appended.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.run import Runner
from tessera.plans.validate import Validation
from tessera.session import scratch_path


class StreamValidator:
    def __init__(self, runner: Runner, table_id: str, validations: list[Validation], primary_key: str,
                 stream_name: str | None = None, literal_rules=frozenset()):
        self.runner = runner
        self.spark = runner.spark
        self.table_id = table_id
        self.validations = validations
        self.primary_key = primary_key
        self.stream_name = stream_name or f"stream-{table_id}"
        self.literal_rules = frozenset(literal_rules)
        self.state_dir = scratch_path(self.spark, "tessera-streams", self.stream_name)

    def _batch_start(self, batch_id: int) -> datetime:
        """Start time of a batch, fixed at its first attempt."""
        path = f"{self.state_dir}/batches/{batch_id}"
        from tessera.sources.catalog import path_exists
        if path_exists(self.spark, path):
            return self.spark.read.schema("started timestamp_ntz").json(path).first()["started"]
        started = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(started,)], "started timestamp_ntz").coalesce(1) \
            .write.mode("overwrite").json(path)
        return started

    def process(self, batch: DataFrame, batch_id: int) -> None:
        started = self._batch_start(batch_id)
        execution_id = f"{self.stream_name}-{batch_id:010d}"
        outcome = self.runner.run_frame(batch, self.table_id, self.validations, self.primary_key,
                                        execution_id, started, self.literal_rules)
        if outcome.status != "SKIPPED":
            self.runner.log_executions(execution_id, started, [outcome])

    def start(self, stream: DataFrame, trigger: dict | None = None,
              checkpoint_location: str | None = None) -> StreamingQuery:
        writer = (stream.writeStream.foreachBatch(self.process)
                  .option("checkpointLocation", checkpoint_location or f"{self.state_dir}/checkpoint"))
        if trigger:
            writer = writer.trigger(**trigger)
        return writer.start()
