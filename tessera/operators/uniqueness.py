"""Several uniqueness rules of one table at once.

1. One scan gives a 64-bit hash of each row's key under every rule it is subject
   to. Tasks send 32 bits of each hash, packed by the bits before them
   (``repeats``): 4 bytes a key cross the shuffle, and a key of many rows once
   or twice a piece. Hashes met twice make a bitmap of bounded size.
2. A second scan keeps the (row, rule) pairs whose hash is in the bitmap -- where
   few keys repeat, the others go no further. Only then are the texts made that
   the evidence needs; pairs with the same whole key meet in one shuffle.

The rows of a hot key are dealt over several tasks; one that is alone in its
task meets one row of each other (``told_apart``).

A rule on its own scans and shuffles the table for itself, so V rules cost V
times as much.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from tessera.functions.keys import pk_text
from tessera.operators.repeats import OFTEN_SCHEMA, PACKED_SCHEMA, bucket_bits, in_bitmap, packed, repeats


@dataclass
class UniqueRule:
    """``columns`` must be unique among the rows of ``perimeter`` (None: all);
    ``value`` is what the evidence records."""

    validation_id: str
    columns: list[str]
    value: Column
    perimeter: Column | None = None


def key_part(c: Column, kind: DataType) -> Column | None:
    """A text that is equal for equal values only; None for types without one."""
    if isinstance(kind, (FloatType, DoubleType)):
        return (c + F.lit(0.0)).cast("string")              # -0.0 equals 0.0
    if isinstance(kind, TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, BinaryType):
        return F.hex(c)
    plain = (IntegralType, DecimalType, BooleanType, DateType, TimestampNTZType)
    return c.cast("string") if isinstance(kind, plain) or kind == StringType() else None


def key_text(parts: list[Column]) -> Column:
    """One text for several that are not null, each behind its length: equal
    only if all parts are."""
    return parts[0] if len(parts) == 1 else F.concat(*[x for p in parts for x in (F.char_length(p).cast("string"), F.lit(":"), p)])


def combinable(df: DataFrame, columns: list[str]) -> bool:
    """Whether the keys can be told apart as text."""
    return bool(columns) and all(key_part(F.lit(None), df.select(F.col(c)).schema[0].dataType) is not None for c in columns)


# the keys whose rows are dealt over several tasks
HOT_KEYS = 1000


def key_value(c: Column, kind: DataType) -> Column:
    """What is hashed of a key's part: the same for equal values."""
    return c + F.lit(0.0) if isinstance(kind, (FloatType, DoubleType)) else c


def told_apart(rows: DataFrame, keys: list[str], salt: str) -> DataFrame:
    """The ``rows`` whose ``keys`` are those of another row too. Rows with a
    ``salt`` are dealt out by it. Of those the only one with its key and salt is
    told by the rows of other salts, of which one each is enough. Both halves
    read one shuffle: they use the same columns, and filter by counts only."""
    near, names = Window.partitionBy(*keys, salt), rows.columns
    met = rows.withColumn("_met", F.count(F.lit(1)).over(near))
    # one sort: row_number needs an order, and the counts take the same
    order = near.orderBy(*keys)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = rows.select("*", F.count(F.lit(1)).over(whole).alias("_met"), F.count(salt).over(whole).alias("_salted"),
                        F.row_number().over(order).alias("_place")).filter((F.col("_salted") > 0) & (F.col("_place") == 1))
    alone = first.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter((F.col("_met") == 1) & (F.col("_parts") > 1))
    return met.filter(F.col("_met") > 1).select(*names).unionByName(alone.select(*names))


def is_unique_many(df: DataFrame, rules: list[UniqueRule], primary_key: str | list[str]) -> DataFrame:
    """Evidence (validation_id, table_pk, failed_value) of all ``rules``: rows
    whose key occurs more than once inside the rule's perimeter; a key with a
    NULL part passes. Keys must be ``combinable``."""
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = bucket_bits(salts)
    kinds = {c: df.select(F.col(c)).schema[0].dataType for r in rules for c in r.columns}
    subject, hashes = [], []
    for i, rule in enumerate(rules):
        held = [F.col(c).isNotNull() for c in rule.columns] + ([rule.perimeter] if rule.perimeter is not None else [])
        subject.append(reduce(lambda a, b: a & b, held))
        hashes.append(F.xxhash64(F.lit(i), *[key_value(F.col(c), kinds[c]) for c in rule.columns]))
    counted = (df.select(*[F.when(s, h).alias(f"h{i}") for i, (s, h) in enumerate(zip(subject, hashes))])
               .mapInArrow(packed(bits), PACKED_SCHEMA).groupBy("_bucket").applyInArrow(repeats(bits), OFTEN_SCHEMA))
    hot = (counted.filter(F.col("_h").isNotNull()).groupBy("_rule", "_h").agg(F.sum("_n").alias("_n"))
           .orderBy(F.desc("_n"), "_h", "_rule").limit(HOT_KEYS))

    rule, h, hot_rule, hot_h = (f"{n}_{uuid.uuid4().hex}" for n in ("rule", "h", "hot_rule", "hot_h"))      # beside the table's own columns
    pairs = df.select("*", F.inline(F.array(*[F.when(s, F.struct(F.lit(i).alias(rule), x.alias(h))) for i, (s, x) in enumerate(zip(subject, hashes))])))
    pairs = in_bitmap(pairs.filter(F.col(h).isNotNull()), F.col(h), counted)
    hot = hot.select(F.col("_rule").alias(hot_rule), F.col("_h").alias(hot_h))
    pairs = pairs.join(F.broadcast(hot), (F.col(rule) == F.col(hot_rule)) & (F.col(h) == F.col(hot_h)), "left")

    def by_rule(of: list[Column]) -> Column:
        return reduce(lambda c, i: c.when(F.col(rule) == i, of[i]), range(1, len(of)), F.when(F.col(rule) == 0, of[0]))
    candidates = pairs.select(
        by_rule([key_text([key_part(F.col(c), kinds[c]) for c in r.columns]) for r in rules]).alias("_key"), F.col(rule).alias("_rule"), F.col(hot_h).alias("_hot"),
        pk_text(primary_key).alias("table_pk"), by_rule([r.value for r in rules]).alias("failed_value"))
    own = F.pmod(F.xxhash64("table_pk", "failed_value"), F.lit(salts)).cast("int")
    candidates = candidates.withColumn("_salt", F.when(F.col("_hot").isNotNull(), own)).drop("_hot")
    ids = F.array(*[F.lit(r.validation_id) for r in rules])
    return told_apart(candidates, ["_key", "_rule"], "_salt").select(
        F.element_at(ids, F.col("_rule") + 1).alias("validation_id"), "table_pk", "failed_value")
