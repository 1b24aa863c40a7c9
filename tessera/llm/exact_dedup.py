"""Exact de-duplication by progressive refinement.

1. Group by length: a length that occurs once cannot have a copy.
2. Of the surviving lengths, group by length and the hash of a prefix.
3. Of the surviving (length, prefix) groups, read the full content and group by
   its SHA-256.

No text is ever shuffled: counts per key cross the first two shuffles (partial
aggregation), and (length, prefix, full hash) of rows that may survive the
others. Those rows are known where they are by a bitmap of the surviving keys,
whose size is bounded; what it lets through in error is taken out by a join of
the slim rows, whose hot keys the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, drop_staged, marked_if_met, stage

PREFIX_CHARS = 128


def normalised(text: Column) -> Column:
    """A-Z in lower case; null counts as empty."""
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest(text: Column) -> Column:
    """Hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def copy_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text that occurs at least twice: text_sha256, keep_id (the
    largest id holding it; null if all are null), group_size."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).alias("len"))
    lengths = stage(rows.groupBy("len").count().where("count > 1").select("len"), "lengths", slim=True)
    prefix = F.xxhash64(normalised(F.substring("text", 1, PREFIX_CHARS)))
    shared = marked_if_met(rows, F.col("len").cast("long"), lengths.select(F.col("len").cast("long")), "met").where("met").drop("met")
    keyed = shared.select("len", prefix.alias("prefix"))
    prefixes = stage(keyed.groupBy("len", "prefix").count().where("count > 1").select("len", "prefix"), "prefixes", slim=True)
    start = F.xxhash64("len", "prefix")
    alike = marked_if_met(rows.withColumn("prefix", prefix), start, prefixes.select(start), "met").where("met")
    full = (alike.select("id", "len", "prefix", digest(F.col("text")).alias("text_sha256"))
            .join(prefixes, ["len", "prefix"], "left_semi"))
    copies = stage(full.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
                   .where("group_size > 1"), "copies", slim=True)
    drop_staged(lengths, prefixes)
    return copies


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the text column, plus text_sha256, keep_id, group_size
    and kept; of equal texts the row with the largest id stays.

    Texts are equal when identical after lower-casing A-Z; a null text is an
    empty one. Null ids are smaller than any other; in a group of null ids only
    keep_id is null and all rows stay, and rows that repeat the largest id of
    their group all stay, for they cannot be told apart. The four results
    replace columns of those names; an empty table gives an empty result.
    """
    groups = copy_groups(docs, id_col, text_col)
    names = ["text_sha256", "keep_id", "group_size", "kept"]
    rest = [c for c in docs.columns if c.lower() not in [*names, text_col.lower()] or c == id_col]
    hashed = docs.select(*[F.col(f"`{c}`") for c in rest], digest(F.col(text_col)).alias("text_sha256"))
    found = groups.select(F.col("text_sha256").alias("g_sha"), F.col("keep_id").alias("g_keep"),
                          F.col("group_size").alias("g_size"))
    own = F.col(f"`{id_col}`")
    keep = F.when(F.col("g_sha").isNull(), own).otherwise(F.col("g_keep"))
    return (hashed.join(found, F.col("text_sha256") == F.col("g_sha"), "left")
            .select(*[F.col(f"`{c}`") for c in rest], "text_sha256", keep.alias("keep_id"),
                    F.coalesce("g_size", F.lit(1)).cast("long").alias("group_size"),
                    keep.eqNullSafe(own).alias("kept")))
