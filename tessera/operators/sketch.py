"""A membership sketch of bounded size.

A bitmap of FILTER_BITS over 64-bit hashes, as at most 131,072 rows of 64 bits,
is small enough to broadcast whatever the keys are. A hash whose bit is not set
is certainly not among the keys; more keys make it less selective, never wrong.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 2**23


def filter_words(keys: DataFrame, word: str, bit: str) -> DataFrame:
    """The bitmap of the values of the one column of ``keys`` (a long hash) as
    rows (word, bit). A null key sets no bit."""
    place = F.pmod(F.col(f"`{keys.columns[0]}`"), F.lit(FILTER_BITS))
    # never null, so a join on it adds no filter to the plan of ``keys``, which may be in use elsewhere
    return (keys.select(F.coalesce(F.shiftright(place, 6), F.lit(0)).alias(word), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias(bit))
            .groupBy(word).agg(F.bit_or(bit).alias(bit)))


def marked_if_met(rows: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` plus the boolean ``name``: False only where ``key`` (a long
    hash) is not among the values of the one column of ``keys``. Wide rows that
    cannot match are thus known before any shuffle."""
    word, bit = f"w_{uuid.uuid4().hex}", f"b_{uuid.uuid4().hex}"
    place = F.pmod(key, F.lit(FILTER_BITS))
    held = F.call_function("shiftright", F.col(bit), F.col(f"{bit}_of")).bitwiseAND(F.lit(1).cast("long")) == 1
    return (rows.withColumn(f"{word}_of", F.shiftright(place, 6)).withColumn(f"{bit}_of", (place % 64).cast("int"))
            .join(F.broadcast(filter_words(keys, word, bit)), F.col(f"{word}_of") == F.col(word), "left")
            .withColumn(name, F.coalesce(held, F.lit(False)))
            .drop(word, bit, f"{word}_of", f"{bit}_of"))
