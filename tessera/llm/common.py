"""Shared helpers: staged tables, result columns, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str, slim: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lineage
    is cut and the files outlive any executor. ``slim`` tables (keys, counts,
    links) go to at most two files per core, not one per shuffle partition."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    (df.coalesce(2 * spark.sparkContext.defaultParallelism) if slim else df).write.parquet(path)
    # a written table may hold NULL in every column, whatever the plan said
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return spark.read.schema(schema).parquet(path)


def drop_staged(*frames: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the fast path for pure ASCII texts;
    other texts go through ``translate``, which touches the 26 letters only."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, UPPER, UPPER.lower()))


SLICE_BYTES = 2_000_000


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, in consecutive runs of about
    ``limit`` bytes: what a worker holds as Python objects stays bounded."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // limit)) + 1
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
        if stop > start:
            yield [t or "" for t in texts.slice(start, stop - start).to_pylist()]


def _give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # a C library without it
        pass


def frees_memory(run: Callable) -> Callable:
    """``run``, a function over the batches of a task, that gives freed memory
    back to the system when the task ends. Workers are reused: without it each
    keeps the peak of all stages it served."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _give_back()
    return wrapped


def with_results(df: DataFrame, result: Column, names: list[str]) -> DataFrame:
    """``df`` plus the fields ``names`` of the struct ``result``; a result
    column replaces an input column of the same name."""
    tmp = f"r_{uuid.uuid4().hex}"
    taken = {n.lower() for n in names}
    keep = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.withColumn(tmp, result).select(*keep, *[F.col(tmp)[n].alias(n) for n in names])


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], limit: int, name: str, spread: Column) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, numbered from 1 in
    ``name`` (long). Groups are first dealt out by the hash ``spread``, and only
    the first rows of each part meet: a group of any share of the rows costs one
    task ``limit`` rows per shuffle partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, place = f"p_{uuid.uuid4().hex}", F.row_number()
    few = rows.withColumn(part, F.pmod(spread, F.lit(parts)))
    few = few.withColumn(name, place.over(Window.partitionBy(*group, part).orderBy(*order))).where(F.col(name) <= limit).drop(part)
    return few.withColumn(name, place.over(Window.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(name) <= limit)


FILTER_BITS = 2**23


def filter_words(keys: DataFrame, word: str, bit: str) -> DataFrame:
    """The bitmap of FILTER_BITS that has the values of the one column of
    ``keys`` (a long hash) set: at most 131,072 rows of 64 bits."""
    place = F.pmod(F.col(f"`{keys.columns[0]}`"), F.lit(FILTER_BITS))
    return (keys.select(F.shiftright(place, 6).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias(bit))
            .groupBy(word).agg(F.bit_or(bit).alias(bit)))


def filter_bits(keys: DataFrame) -> np.ndarray:
    """The same bitmap as an array of 1 MB, for ``in_filter``."""
    bits = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for r in filter_words(keys, "w", "b").collect():
        bits[r.w] = np.uint64(r.b % 2**64)
    return bits


def in_filter(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash may be among the keys; False is certain."""
    place = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def marked_if_met(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` plus the boolean ``name``: False only where ``key`` (a long
    hash) is not among the values of the one column of ``keys``. A bitmap of
    FILTER_BITS, at most 131,072 words of 64 bits, is broadcast; wide rows that
    cannot match are thus known before any shuffle. More keys make it less
    selective, never wrong."""
    word, bit = f"w_{uuid.uuid4().hex}", f"b_{uuid.uuid4().hex}"

    place = F.pmod(key, F.lit(FILTER_BITS))
    held = F.call_function("shiftright", F.col(bit), F.col(f"{bit}_of")).bitwiseAND(F.lit(1).cast("long")) == 1
    return (rows.withColumn(f"{word}_of", F.shiftright(place, 6)).withColumn(f"{bit}_of", (place % 64).cast("int"))
            .join(F.broadcast(filter_words(keys, word, bit)), F.col(f"{word}_of") == F.col(word), "left")
            .withColumn(name, F.coalesce(held, F.lit(False)))
            .drop(word, bit, f"{word}_of", f"{bit}_of"))


def class_keys(rows: DataFrame) -> DataFrame:
    """``rows`` (node, check, ...) without check, node made different for rows
    whose ``check`` differs. Together they are a hash of 128 bits, of which
    components use the 64 of node: a node met with several checks keeps the
    smallest, and the rows of the others get a new one."""
    clash = stage(rows.where("node IS NOT NULL").groupBy(F.col("node").alias("c_node"))
                  .agg(F.min("check").alias("least"), F.max("check").alias("most")).where("least <> most").select("c_node", "least"), "clashes", slim=True)
    if clash.isEmpty():                     # as good as always
        drop_staged(clash)
        return rows.drop("check")
    other = F.when(F.col("check") != F.col("least"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(clash, F.col("node") == F.col("c_node"), "left").withColumn(
        "node", F.when(F.col("least").isNull(), F.col("node")).otherwise(other)).drop("check", "c_node", "least")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Components of the undirected ``edges`` (a long, b long) as rows
    (node, component), component = the smallest node reachable. Nodes without
    an edge to another node are absent.

    Contraction: each round every node hooks to its smallest neighbour (or
    stays, being smaller than all), pointers are doubled until they reach a
    root, and the edges are relabelled by the roots; edges inside a tree
    vanish. At least every second node with an edge hooks, so rounds are
    logarithmic. Neighbour minima are partial aggregates, and every joined
    table is read from the checkpoint folder, so a node with very many edges
    is split by the adaptive skew join.
    """
    spark = edges.sparkSession
    live = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", slim=True)
    labels = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select(F.explode(F.array(
            F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
            F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        up = stage(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "hooks", slim=True)
        while True:
            far = up.select(F.col("node").alias("mid"), F.col("root").alias("far"))
            jumped = stage(up.join(far, F.col("root") == F.col("mid"), "left")
                           .select("node", F.coalesce("far", "root").alias("root"),
                                   (F.coalesce("far", "root") != F.col("root")).alias("moved")), "jumps", slim=True)
            moved = not jumped.where("moved").isEmpty()
            drop_staged(up)
            up = jumped.drop("moved")
            if not moved:
                break
        ra = up.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        rest = (live.join(ra, "a").join(rb, "b").where("ra <> rb")
                .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        new_live = stage(rest, "edges", slim=True)
        if labels is None:
            new_labels = up.select("node", F.col("root").alias("component"))
        else:
            nxt = up.select(F.col("node").alias("component"), "root")
            new_labels = stage(labels.join(nxt, "component", "left")
                               .select("node", F.coalesce("root", "component").alias("component")), "labels", slim=True)
            drop_staged(labels, up)
        drop_staged(live)
        live, labels = new_live, new_labels
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        return spark.createDataFrame([], "node long, component long")
    return labels


def label_rows(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``rows`` (id, node, ...) plus component_id, the smallest id in the
    node's component, and kept (id = component_id). A null node is alone. A
    null id is larger than any other. ``labels`` as by connected_components."""
    if labels is None:
        rows = rows.withColumn("component", F.col("node"))
    else:
        rows = rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stage(rows, "rows", slim=True)
    lows = stage(rows.where("component IS NOT NULL").groupBy("component")
                 .agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("members")).where("members > 1")
                 .select(F.col("component").alias("l_component"), "low"), "lows", slim=True)
    low = F.when(F.col("l_component").isNull(), F.col("id")).otherwise(F.col("low"))
    return (rows.join(lows, F.col("component") == F.col("l_component"), "left")
            .withColumn("component_id", low).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
            .drop("l_component", "low", "component"))
