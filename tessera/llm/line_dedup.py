"""Line de-duplication over documents with a sharded minimal perfect hash.

1. Every document gives the distinct 128-bit hashes of its long lines.
2. One aggregate (map-side combined) counts the documents of each hash and
   finds the largest id holding it. Hashes of one document need no entry.
3. Hashes are dealt to shards. A shard builds a minimal perfect hash that
   indexes three arrays: 64-bit fingerprint, document count, largest id.
4. The documents' hashes probe the arrays of their shard; a shard that gets
   many probes (a line of a third of all documents) serves them in several
   copies. Only hashes to drop come back, and only those meet the texts again.

The texts never meet each other's lines, and no line text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import drop_staged, frees_memory, stage, text_slices, with_results
from tessera.llm.perfect_hash import PerfectHash

SPACE = b" \t\n\x0b\x0c\r"
SHARD_ENTRIES = 250_000


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z in lower case; None below ``min_chars`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """Rows (id, t, h1, h2): the distinct line hashes of every document; t is
    a hash of the whole text."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], slim.schema["t"],
                           T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in text_slices(batch.column("text")):
                sizes, hashes = [], []
                for text in texts:
                    keys = dict.fromkeys(k for k in (line_key(x, min_chars) for x in text.encode().split(b"\n")) if k is not None)
                    sizes.append(len(keys))
                    hashes += map(_hash, keys)
                at = pa.array(start + np.repeat(np.arange(len(sizes)), sizes))
                h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("t").take(at), pa.array(h[:, 0]), pa.array(h[:, 1])],
                    names=["id", "t", "h1", "h2"])
                start += len(texts)
    return slim.mapInArrow(run, schema)


def build_shards(entries: DataFrame, n_shards: int) -> DataFrame:
    """One row per shard: its perfect hash and the arrays it indexes."""
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()),
        T.StructField("fingerprints", T.BinaryType()), T.StructField("counts", T.BinaryType()),
        T.StructField("last", T.ArrayType(entries.schema["last_id"].dataType))])

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        table = PerfectHash.build(h1, h2)
        order = np.argsort(table.index(h1, h2))
        sizes, bits = table.dump()
        last = rows.column("last_id").combine_chunks().take(pa.array(order))
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()), "sizes": [sizes], "bits": [bits],
            "fingerprints": [h2[order].astype("<u8").tobytes()],
            "counts": [rows.column("n_docs").to_numpy()[order].astype("<i8").tobytes()],
            "last": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), last)},
            schema=pa.schema([("shard", pa.int64()), ("sizes", pa.binary()), ("bits", pa.binary()), ("fingerprints", pa.binary()),
                              ("counts", pa.binary()), ("last", pa.list_(last.type))]))
    return entries.withColumn("shard", F.pmod("h1", F.lit(n_shards))).groupBy("shard").applyInArrow(build, schema)


def probe(hashes: DataFrame, shards: DataFrame, n_shards: int, copies: DataFrame, min_docs: int) -> DataFrame:
    """The rows of ``hashes`` whose line must go: held by at least ``min_docs``
    documents, the row's document not being the largest id."""
    schema = T.StructType(hashes.schema.fields)
    names = hashes.columns
    # ``copies`` has one row per shard: at most a few times the number of tasks
    sent = (hashes.withColumn("shard", F.pmod("h1", F.lit(n_shards))).join(F.broadcast(copies), "shard")
            .withColumn("copy", F.pmod(F.xxhash64("t", "id", "h2"), F.col("n_copies"))).drop("n_copies"))
    served = (shards.join(F.broadcast(copies), "shard")
              .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1))).drop("n_copies"))

    def run(rows: pa.Table, arrays: pa.Table) -> pa.Table:
        rows = rows.select([*names])
        if not len(arrays) or not len(rows):
            return rows.slice(0, 0)
        a = {c: arrays.column(c)[0].as_py() for c in ("sizes", "bits", "fingerprints", "counts")}
        table = PerfectHash.load(a["sizes"], a["bits"])
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        at = table.index(h1, h2)
        found = at >= 0
        at = np.where(found, at, 0)
        found &= np.frombuffer(a["fingerprints"], dtype="<u8")[at] == h2
        found &= np.frombuffer(a["counts"], dtype="<i8")[at] >= min_docs
        rows, at = rows.filter(pa.array(found)), at[found]
        last = arrays.column("last").combine_chunks().slice(0, 1).flatten().take(pa.array(at))
        ids = rows.column("id").combine_chunks()
        same = pc.fill_null(pc.equal(ids, last), pa.scalar(False))
        same = pc.or_(same, pc.and_(pc.is_null(ids), pc.is_null(last)))
        return rows.filter(pc.invert(same))
    return sent.groupBy("shard", "copy").cogroup(served.groupBy("shard", "copy")).applyInArrow(run, schema)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20,
                min_docs: int = 3) -> DataFrame:
    """``docs`` plus kept_text, n_lines and n_dropped.

    Lines end at \\n; a null or empty text is one empty line. A line's key is
    the line stripped of ASCII white space, A-Z in lower case. Keys of at least
    ``min_chars`` code points held by at least ``min_docs`` documents lose all
    their lines except in the largest id. Every row is a document: rows that
    repeat an id count separately, and all rows with the largest id keep the
    line. A null id is smaller than any other; a line held by null ids only
    stays. The results replace columns of those names; an empty table gives an
    empty result. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    hashes = stage(line_hashes(docs, id_col, text_col, min_chars), "lines")
    entries = stage(hashes.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("last_id"))
                    .where("n_docs > 1"), "line-counts", slim=True)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_shards = max(2 * tasks, -(-entries.count() // SHARD_ENTRIES))
    shards = stage(build_shards(entries, n_shards), "line-shards")
    # a shard serves its probes in as many copies as keep each near the mean
    share = max(2 * hashes.count() // n_shards, 1000)
    copies = stage(hashes.groupBy(F.pmod("h1", F.lit(n_shards)).alias("shard")).count()
                   .select("shard", F.ceil(F.col("count") / share).cast("long").alias("n_copies")), "line-copies", slim=True)
    gone = stage(probe(hashes, shards, n_shards, copies, min_docs).groupBy("id", "t")
                 .agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
                 .select(F.col("id").alias("g_id"), F.col("t").alias("g_t"),
                         F.col("gone.h1").alias("g_h1"), F.col("gone.h2").alias("g_h2")), "line-drops", slim=True)
    drop_staged(hashes, entries, shards, copies)

    @F.arrow_udf("struct<kept_text:string,n_lines:bigint,n_dropped:bigint>")
    @frees_memory
    def apply(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, h1, h2 in batches:
            at = 0
            for texts in text_slices(text):
                kept, total, dropped = [], [], []
                for t, a, b in zip(texts, h1.slice(at), h2.slice(at)):
                    lines = t.encode().split(b"\n")
                    total.append(len(lines))
                    if a.is_valid:
                        raw = np.stack((a.values.to_numpy(), b.values.to_numpy()), axis=1).astype("<i8").tobytes()
                        out = {raw[i:i + 16] for i in range(0, len(raw), 16)}
                        lines = [x for x in lines if (k := line_key(x, min_chars)) is None or _hash(k) not in out]
                    dropped.append(total[-1] - len(lines))
                    kept.append(b"\n".join(lines))
                at += len(texts)
                yield pa.StructArray.from_arrays([pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()),
                                                  pa.array(dropped, pa.int64())], names=["kept_text", "n_lines", "n_dropped"])

    same = F.col(f"`{id_col}`").eqNullSafe(F.col("g_id")) & (F.xxhash64(text_col) == F.col("g_t"))
    joined = docs.join(gone, same, "left")
    out = with_results(joined, apply(F.col(text_col), "g_h1", "g_h2"), ["kept_text", "n_lines", "n_dropped"])
    return out.drop("g_id", "g_t", "g_h1", "g_h2")
