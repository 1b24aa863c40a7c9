"""Language of a text by a string kernel.

The kernel of two texts is the blended spectrum of presences: how many letter
n-grams of 1 to 4 letters both hold, over the root of the product of how many
each holds. N-grams lie within words; a blank before and after a word counts as
a letter of it. A bounded, balanced sample of labelled rows is learnt from: some of
its texts are the landmarks of a Nyström approximation, and kernel ridge
regressions, one language against the rest, are solved in their span.

Scoring is a chain of matrix products over batches of texts: presences times the
landmarks' presences are kernels, and kernels times the weights are margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, first_per_group, frees_memory, stage, with_results
from tessera.llm.words import array_slices

# The bounds of the fit: labelled rows of a language, chosen by hash, and rows of
# all languages together (beyond SAMPLE_ROWS / SAMPLE_PER_LANGUAGE languages,
# those of the first rows by hash are learnt).
SAMPLE_PER_LANGUAGE = 600
SAMPLE_ROWS = 12_000
# The size of the model: landmarks of a language and of all, and the n-grams the
# kernel counts, those of most sampled texts.
LANDMARKS_PER_LANGUAGE = 64
LANDMARKS = 512
GRAMS = 6000
SIZES = (1, 2, 3, 4)
RIDGE = 1e-3
BATCH = 256             # texts scored by one product
PIECE = 400_000         # characters taken apart at once
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """By code point: the letter in lower case, 0 for all that is no letter.
    Letters outside the basic plane count as one and the same letter, 1."""
    out = np.zeros(0x110000, dtype=np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            out[c] = low if low < 0x10000 else 1
    return out


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in runs of about PIECE characters, as (numbers, parts); a longer
    text is cut at white space. No word is cut but one longer than PIECE, which
    is a run of its own."""
    numbers, parts, held = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not text:
            stop = len(text)
            if stop - at > PIECE:
                space = re.compile(r"\s").search(text, at + PIECE)
                stop = space.end() if space else stop
            numbers.append(i)
            parts.append(text[at:stop])
            held, at = held + stop - at, stop
            if held >= PIECE:
                yield numbers, parts
                numbers, parts, held = [], [], 0
            if not text:
                break
    if parts:
        yield numbers, parts


def letter_sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts with one 0 before, between and after them, and the
    number of each letter's text (a 0 goes with the word before it)."""
    joined = "\n".join(texts) + "\n"
    x = letters()[np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")]
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
    keep = x > 0
    keep[1:] |= keep[:-1] & ~keep[1:]
    return np.concatenate((np.zeros(1, dtype=np.uint64), x[keep])), np.concatenate((np.zeros(1, dtype=np.int64), text[keep]))


def grams_at(x: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place from n - 1 on, 16 bits a letter."""
    out = x[:len(x) - n + 1].copy()
    for k in range(1, n):
        out = out << np.uint64(16) | x[k:len(x) - n + 1 + k]
    return out


def inside_word(grams: np.ndarray, n: int) -> np.ndarray:
    """N-grams of one word: some letter, and no blank but at the ends."""
    good = grams > 0 if n < 3 else np.ones(len(grams), dtype=bool)
    for k in range(1, n - 1):
        good &= (grams >> np.uint64(16 * k)) & np.uint64(0xFFFF) > 0
    return good


class Presence:
    """Which n-grams of a fixed list (n, gram), sorted, the texts hold."""

    def __init__(self, grams: list[tuple[int, int]]):
        self.size = len(grams)
        self.known = {n: np.array([g for m, g in grams if m == n], dtype=np.uint64) for n in SIZES}
        self.first = {n: sum(m < n for m, _ in grams) for n in SIZES}

    def batches(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Presence matrix and whether there is any letter, BATCH texts at a time."""
        for start in range(0, len(texts), BATCH):
            batch = [t or "" for t in texts.slice(start, BATCH).to_pylist()]
            held, some = np.zeros((len(batch), self.size), dtype=np.float32), np.zeros(len(batch), dtype=bool)
            for numbers, parts in pieces(batch):
                x, part = letter_sequence(parts)
                text = np.array(numbers)[part]
                some[text[x > 0]] = True
                for n in SIZES:
                    known = self.known[n]
                    if len(known) and len(x) >= n:
                        grams = grams_at(x, n)
                        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                        hit = np.flatnonzero(known[at] == grams)
                        held[text[hit + n - 1], self.first[n] + at[hit]] = 1
            yield held, some


def norms(held: np.ndarray) -> np.ndarray:
    """The root of the number of n-grams of each row."""
    return np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))


def normed(held: np.ndarray) -> np.ndarray:
    """Rows divided by their norms: products are kernels."""
    return held / norms(held)


@dataclass
class Model:
    """Languages, n-grams, the landmarks' presences (n-grams x landmarks), the
    weights of the margins (landmarks x languages) and their constants."""

    languages: list[str]
    grams: list[tuple[int, int]]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, held: np.ndarray) -> np.ndarray:
        return (held @ self.landmarks / norms(held)) @ self.weights + self.bias


def labelled_sample(docs: DataFrame, label_col: str, text_col: str) -> DataFrame:
    """Rows (label, text, place): at most SAMPLE_PER_LANGUAGE texts of a label,
    numbered from 1, and SAMPLE_ROWS in all. Equal texts count once."""
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.xxhash64("text"), F.sha2(F.encode("text", "UTF-8"), 256)]
    keys = (rows.select("label", order[0].alias("h"), order[1].alias("sha")).distinct())
    few = first_per_group(keys, ["label"], [F.asc("h"), F.asc("sha")], SAMPLE_PER_LANGUAGE, "place", F.col("h"))
    few = few.orderBy("place", "h", "label", "sha").limit(SAMPLE_ROWS)
    # at most SAMPLE_ROWS keys
    met = rows.withColumn("h", order[0]).join(F.broadcast(few.select(F.col("label").alias("k_label"), F.col("h").alias("k_h"), "sha", "place")),
                                              (F.col("label") == F.col("k_label")) & (F.col("h") == F.col("k_h")))
    return met.where(order[1] == F.col("sha")).dropDuplicates(["label", "sha"]).select("label", "text", "place", "sha")


def frequent_grams(sample: DataFrame) -> list[tuple[int, int]]:
    """The GRAMS n-grams (n, gram) that most sampled texts hold, at least two."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in array_slices(batch.column("text")):
                found: dict[int, list[np.ndarray]] = {n: [] for n in SIZES}
                for text in texts.to_pylist():
                    runs = [letter_sequence(parts)[0] for _, parts in pieces([text])]
                    for n in SIZES:
                        grams = np.unique(np.concatenate([np.unique(grams_at(x, n)) for x in runs if len(x) >= n] or [np.zeros(0, dtype=np.uint64)]))
                        found[n].append(grams[inside_word(grams, n)])
                for n, lists in found.items():
                    grams, count = np.unique(np.concatenate([*lists, np.zeros(0, dtype=np.uint64)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), n, dtype=np.int32)), pa.array(grams.view(np.int64)), pa.array(count)],
                                                     names=["size", "gram", "n"])
    counted = sample.select("text").mapInArrow(run, "size int, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    return sorted((r.size, r.gram % 2**64) for r in counted.orderBy(F.desc("n"), "size", "gram").limit(GRAMS).collect())


def landmark_rows(sample: DataFrame, grams: list[tuple[int, int]]) -> np.ndarray:
    """The presences (n-grams x landmarks) of the first texts of each language."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(grams)
        for batch in batches:
            for start, texts in array_slices(batch.column("text")):
                x = [np.flatnonzero(row).astype(np.int32) for held, _ in presence.batches(texts) for row in held]
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("label", "place", "sha")), pa.array(x, pa.list_(pa.int32()))],
                                                 names=["label", "place", "sha", "x"])
    few = sample.where(F.col("place") <= LANDMARKS_PER_LANGUAGE).mapInArrow(run, "label string, place long, sha string, x array<int>")
    rows = few.where("size(x) > 0").orderBy("place", "label", "sha").limit(LANDMARKS).collect()
    held = np.zeros((len(rows), len(grams)), dtype=np.float32)
    for i, r in enumerate(rows):
        held[i, r.x] = 1
    return normed(held).T


def kernel_rows(sample: DataFrame, grams: list[tuple[int, int]], landmarks: np.ndarray) -> list:
    """(label, k): the kernels of each sampled text with the landmarks."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        presence = Presence(grams)
        for batch in batches:
            for start, texts in array_slices(batch.column("text")):
                k = [row for held, _ in presence.batches(texts) for row in normed(held) @ landmarks]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(start, len(texts)), pa.array(k, pa.list_(pa.float32()))], names=["label", "k"])
    return sorted(sample.mapInArrow(run, "label string, k array<float>").collect(), key=lambda r: (r.label, r.k))


def solve(rows: list, grams: list[tuple[int, int]], landmarks: np.ndarray) -> Model:
    """Ridge regressions, one language against the rest, in the features
    k(x, landmarks) K^-1/2 whose products approximate the kernel. The constant is
    not punished."""
    languages = sorted({r.label for r in rows})
    value, vector = np.linalg.eigh((landmarks.T @ landmarks).astype(np.float64))
    good = value > 1e-6 * max(value.max(initial=0), 1)
    root = vector[:, good] / np.sqrt(value[good])
    x = np.array([r.k for r in rows], dtype=np.float64).reshape(len(rows), -1) @ root
    y = np.array([[1.0 if r.label == language else -1.0 for language in languages] for r in rows])
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    x = x - mean_x
    w = np.linalg.solve(x.T @ x + RIDGE * len(rows) * np.eye(x.shape[1]), x.T @ (y - mean_y))
    return Model(languages, grams, landmarks, (root @ w).astype(np.float32), mean_y - mean_x @ w)


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model | None:
    """Learn from the texts of ``docs`` with a label; None if there are none.
    Only texts and labels are read."""
    sample = stage(labelled_sample(docs, label_col, text_col), "labelled", slim=True)
    grams = frequent_grams(sample)
    landmarks = landmark_rows(sample, grams)
    rows = kernel_rows(sample, grams, landmarks)
    drop_staged(sample)
    return solve(rows, grams, landmarks) if rows else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` plus lang_pred (a learnt language; UNKNOWN for a text that is null
    or has no letter, and without a model) and score (0 to 1, the largest margin
    m as (m + 1) / 2; 0 with UNKNOWN).

    Letters are those of Unicode; the whole text counts. Equal margins: the first
    language by name. Rows are independent: null or repeated ids, ties and extra
    columns pass through; the results replace columns of those names; an empty
    table gives an empty result.
    """
    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @frees_memory
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        presence = Presence(model.grams) if model else None
        names = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
        for batch in batches:
            for _, texts in array_slices(batch):
                best, score = np.full(len(texts), -1), np.zeros(len(texts))
                at = 0
                for held, letters in presence.batches(texts) if presence else ():
                    margins = model.margins(held)
                    best[at:at + len(held)] = np.where(letters, margins.argmax(axis=1), -1)
                    score[at:at + len(held)] = np.where(letters, np.clip((margins.max(axis=1) + 1) / 2, 0, 1), 0)
                    at += len(held)
                yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang_pred", "score"])
    return with_results(docs, run(F.col(text_col)), ["lang_pred", "score"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
