"""A corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of ``documents``. Stages change
texts in place: ``text`` and ``n_chars`` are those of the cleaned text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, minhash, packing, secret_scan, toxicity
from tessera.llm.common import drop_staged, stage, table

SIMILARITY = 80         # percent of shingles shared by near duplicates


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """``columns`` of ``docs``, the text replaced by the column ``text``."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; labels of held-out rows are not used."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out())
    scored = toxicity.score_documents(docs, toxicity.fit(docs, labels))
    return scored.where("predicted = 0").select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of three or more documents stay in one of them."""
    return _with_text(line_dedup.dedup_lines(docs), docs.columns, "kept_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.near_dedup(docs, percent=SIMILARITY)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return _with_text(secret_scan.find_secrets(docs), docs.columns, "redacted_text")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

# A learned score and a linear program are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        drop_staged(*read)              # no later stage reads it
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
