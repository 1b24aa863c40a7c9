"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings. A bounded sample of
labelled rows gives, by distributed counts, the features that tell the classes
apart; a logistic regression over them is fitted on the driver. Its loss has a
counterfactual term: in labelled sentences identity terms are swapped for
others of their group (where a sentence has none, one is set in a word's
place), and the squared change of the score is penalised, so that the neutral
mention of a group does not move a score.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, frees_memory, stage, text_slices, with_results

SAMPLE_PER_CLASS = 3000     # labelled rows used of each class, chosen by hash: the bound of the fit
MAX_FEATURES = 4096         # the size of the model, not of the fit: the most telling features
MIN_ROWS = 4                # sampled rows that hold a feature
MIN_CHI2 = 20.0             # far beyond chance even for a million candidate features
PREFIXES = (4, 5, 6)
FAIRNESS = 20.0             # weight of the counterfactual term
RIDGE = 1e-4
STEPS = 400
WORD = re.compile(r"\w+")
CACHE_WORDS = 300_000

# Identity terms, a group to a line, swapped within the group.
IDENTITY = """
women men girls boys
woman man girl boy
muslims christians jews hindus buddhists atheists catholics
muslim christian jewish hindu buddhist atheist catholic
black white asian latino african european
gay straight lesbian bisexual transgender heterosexual
immigrants refugees foreigners migrants natives
deaf blind disabled autistic
frauen männer mädchen jungen
muslime christen juden hindus buddhisten
schwarze weiße asiaten
ausländer flüchtlinge einwanderer einheimische
femmes hommes filles garçons
musulmans chrétiens juifs hindous bouddhistes
noirs blancs asiatiques
étrangers réfugiés immigrés
mujeres hombres chicas chicos
musulmanes cristianos judíos hindúes budistas
negros blancos asiáticos
extranjeros refugiados inmigrantes
"""
GROUPS = [line.split() for line in IDENTITY.strip().split("\n")]
GROUP_OF = {term: group for group in GROUPS for term in group}


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features_of(word: str) -> list[int]:
    """The word itself and its beginnings, as signed 64-bit hashes."""
    names = ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]
    return [xxhash.xxh3_64_intdigest(n) - 2**63 for n in names]


def features(words: set[str]) -> set[int]:
    return {f for w in words for f in features_of(w)}


@dataclass
class Model:
    """Weights of feature hashes; at most MAX_FEATURES and the identity terms."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, text: str, cache: dict[str, tuple[int, ...]] | None = None) -> float:
        cache = {} if cache is None else cache
        hits: set[int] = set()
        for w in words_of(text):
            known = cache.get(w)
            if known is None:
                known = cache[w] = tuple(f for f in features_of(w) if f in self.weights)
            if known:
                hits.update(known)
        z = self.bias + sum(self.weights[f] for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def counterfactual(text: str, seed: int) -> tuple[set[str], set[str]]:
    """The words of a sentence and of its swapped twin."""
    rnd = random.Random(seed)
    words = WORD.findall(text.lower())
    twin = [rnd.choice([x for x in GROUP_OF[w] if x != w]) if w in GROUP_OF else w for w in words]
    if twin == words and words:
        at = rnd.randrange(len(words))
        group = rnd.choice(GROUPS)
        words[at], twin[at] = rnd.sample(group, 2)
    return set(words), set(twin)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """Rows (label, text): at most SAMPLE_PER_CLASS labelled documents of each
    class. A document labelled more than once counts by its highest label; of
    rows that repeat an id the smallest text counts."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("l_id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label"))
    order = F.xxhash64(F.col("l_id").cast("string"))
    picked = None
    for c in (0, 1):
        part = ids.where(F.col("label") == c).orderBy(order, "l_id").limit(SAMPLE_PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    # two times SAMPLE_PER_CLASS ids: a bound that does not grow
    return (docs.select(F.col(id_col).alias("l_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(picked), "l_id").groupBy("l_id", "label").agg(F.min("text").alias("text")).select("label", "text"))


def telling_features(sample: DataFrame) -> list[int]:
    """Features whose presence differs most between the classes."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_pylist()
            at = 0
            for texts in text_slices(batch.column("text")):
                counts: dict[int, list[int]] = {}
                for text, y in zip(texts, label[at:]):
                    for f in features(words_of(text)):
                        counts.setdefault(f, [0, 0])[y] += 1
                at += len(texts)
                yield pa.RecordBatch.from_pydict({"f": list(counts), "n0": [c[0] for c in counts.values()],
                                                  "n1": [c[1] for c in counts.values()]},
                                                 schema=pa.schema([("f", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())]))
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    all0, all1 = max(size.get(0, 0), 1), max(size.get(1, 0), 1)
    n0, n1, total = F.col("n0"), F.col("n1"), all0 + all1
    held = n0 + n1
    gap = n1 * (all0 - n0) - n0 * (all1 - n1)
    chi2 = gap * gap * F.lit(float(total)) / (F.lit(float(all0) * all1) * held * F.greatest(total - held, F.lit(1)))
    return [r.f for r in sample.mapInArrow(run, "f long, n0 long, n1 long").groupBy("f")
            .agg(F.sum("n0").cast("double").alias("n0"), F.sum("n1").cast("double").alias("n1")).where(held >= MIN_ROWS)
            .select("f", chi2.alias("chi2")).where(F.col("chi2") >= MIN_CHI2).orderBy(F.desc("chi2"), "f").limit(MAX_FEATURES).collect()]


def sparse_rows(sample: DataFrame, known: dict[int, int]) -> list:
    """Per sampled document: label, its feature columns, and the columns that
    differ between a sentence and its swapped twin (only in the one / the other)."""
    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, at = batch.column("label").to_pylist(), 0
            for texts in text_slices(batch.column("text")):
                rows = []
                for text, y in zip(texts, label[at:]):
                    def columns(words: set[str]) -> set[int]:
                        return {known[f] for f in features(words) if f in known}
                    a, b = counterfactual(text, xxhash.xxh32_intdigest(text))
                    one, two = columns(a - b), columns(b - a)
                    rest = columns(a & b)
                    rows.append({"y": y, "x": sorted(columns(words_of(text))), "one": sorted(one - two - rest), "two": sorted(two - one - rest)})
                at += len(texts)
                kind = pa.list_(pa.int32())
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("y", pa.int32()), ("x", kind), ("one", kind), ("two", kind)]))
    return sample.mapInArrow(run, "y int, x array<int>, one array<int>, two array<int>").collect()


def _matrix(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the ones of a sparse matrix."""
    return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
            np.array([c for x in lists for c in x], dtype=np.int64))


def descend(rows: list, n_features: int, fairness: float = FAIRNESS) -> tuple[float, np.ndarray]:
    """Adaptive gradient descent on the class-balanced logistic loss, a ridge
    and the counterfactual term; rows as by ``sparse_rows``."""
    rows = sorted(rows, key=lambda r: (r.y, r.x, r.one, r.two))       # the same result for any row order
    y = np.array([r.y for r in rows], dtype=np.float64)
    xr, xc = _matrix([r.x for r in rows])
    ar, ac = _matrix([r.one for r in rows])
    br, bc = _matrix([r.two for r in rows])
    n = len(rows)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(xr, w[xc], n)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * balance
        change = (np.bincount(ar, w[ac], n) - np.bincount(br, w[bc], n)) / n
        grad = (np.bincount(xc, err[xr], n_features) + RIDGE * w
                + 2 * fairness * (np.bincount(ac, change[ar], n_features) - np.bincount(bc, change[br], n_features)))
        grad = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return bias, w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        fairness: float = FAIRNESS) -> Model:
    """Learn from ``labels`` joined to ``docs`` by id. Only the texts are
    inputs. With no labelled rows, or none of one class, the model knows
    nothing or the one class: its scores are the same for every text."""
    sample = stage(labelled_sample(docs, labels, id_col, text_col, label_col), "labelled", slim=True)
    found = telling_features(sample)
    terms = sorted({f for w in GROUP_OF for f in features_of(w)} - set(found))
    known = {f: i for i, f in enumerate([*found, *terms])}
    rows = sparse_rows(sample, known)
    drop_staged(sample)
    if not rows:
        return Model()
    bias, w = descend(rows, len(known), fairness)
    return Model(bias, {f: float(w[i]) for f, i in known.items() if abs(w[i]) > 1e-6})


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 if score >= threshold).

    The whole text counts, a null text as empty. Rows are independent: null or
    repeated ids, ties and extra columns pass through; the results replace
    columns of those names; an empty table gives an empty result.
    """
    @F.arrow_udf("struct<score:double,predicted:int>")
    @frees_memory
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for texts in text_slices(batch):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                scores = np.array([model.score(t, cache) for t in texts], dtype=np.float64)
                yield pa.StructArray.from_arrays([pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                                                 names=["score", "predicted"])
    return with_results(docs, run(F.col(text_col)), ["score", "predicted"])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))
