"""A stream of two micro-batches (run1 then run2) validated batch by batch:
the second batch is classified against the first."""

from pyspark.sql import functions as F

from tessera.plans.run import Runner
from tessera.plans.validate import Validation
from tessera.sources.ledger_store import EVIDENCES, EXECUTIONS, RESULTS, Store
from tessera.streaming import StreamValidator
from tests import fixtures as fx


def test_stream_batches_are_executions(spark, scratch_dir):
    src = f"{scratch_dir}/incoming"
    fx.run_frame(spark, "run1").coalesce(1).write.parquet(f"{src}/a")
    fx.run_frame(spark, "run2").coalesce(1).write.parquet(f"{src}/b")
    store = Store(spark, f"{scratch_dir}/ledger")
    runner = Runner(spark, store)
    vals = [Validation("VAL_DNI", "custom_validate_dni", {"columns": ["dni"]}, implementation="CUSTOM"),
            Validation("VAL_AGE", "is_in_range", {"column": "age", "min_limit": 18.0, "max_limit": 100.0})]
    sv = StreamValidator(runner, "T1", vals, "customer_id", stream_name=f"clientes-{abs(hash(scratch_dir))}")
    stream = (spark.readStream.schema(fx.SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(src))
    q = sv.start(stream, trigger={"availableNow": True}, checkpoint_location=f"{scratch_dir}/ckpt")
    q.awaitTermination(300)
    ex = store.read(EXECUTIONS).orderBy("execution_id").collect()
    assert len(ex) == 2
    second = ex[1].execution_id
    res = {r.validation_id: (r.new_failures, r.persistent_failures, r.resolved_failures)
           for r in store.read(RESULTS).filter(F.col("execution_id") == second).collect()}
    assert res == {"VAL_DNI": (2, 1, 2), "VAL_AGE": (0, 1, 1)}
    # replaying a recorded batch adds nothing
    before = store.read(EVIDENCES).count()
    sv.process(fx.run_frame(spark, "run2"), 1)
    assert store.read(EVIDENCES).count() == before
    assert store.read(EXECUTIONS).count() == 2
