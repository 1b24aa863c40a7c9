"""Language identification: held-out accuracy, the kernel and the ridge against
plain formulas, odd rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.oddities import empty, frame, rows


def grams(text):
    """(n, letters as numbers of 16 bits) of a text, letter by letter."""
    out = set()
    for w in "".join(c.lower()[0] if c.isalpha() else " " for c in text).split():
        codes = [0, *(ord(c) if ord(c) < 65536 else 1 for c in w), 0]
        for n in L.SIZES:
            for i in range(len(codes) - n + 1):
                out.add((n, sum(c << 16 * (n - 1 - k) for k, c in enumerate(codes[i:i + n]))))
    return {(n, g) for n, g in out if g}


@pytest.fixture(scope="module")
def learnt(spark):
    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "text", "lang")
    return docs, L.fit(docs.where(~L.held_out()))


def test_held_out_accuracy(spark, learnt):
    docs, model = learnt
    found = L.identify(docs, model).where(L.held_out()).select("lang", "lang_pred", "score").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 200 and right >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_margins_equal_the_plain_kernel(learnt):
    """Batched products against a kernel computed pair by pair."""
    docs, model = learnt
    known = set(model.grams)
    landmarks = [{model.grams[i] for i in np.flatnonzero(c)} for c in model.landmarks.T]
    texts = [r.text for r in docs.where("doc_id < 30").collect()] + ["Grüße, ÉTÉ 12", "x", "", None, "𝔄b 𐐀 İx 12 ½ ǅ"]
    got = np.concatenate([model.margins(held) for held, _ in L.Presence(model.grams).batches(pa.array(texts))])
    for text, margins in zip(texts, got):
        own = grams(text or "") & known
        k = np.array([len(own & z) / np.sqrt(max(len(own), 1) * max(len(z), 1)) for z in landmarks])
        assert np.allclose(k @ model.weights + model.bias, margins, atol=1e-3)


def test_presence_of_every_gram():
    texts = ["Ab c", "𝔄b 𐐀x İx", None, "12", "c-c ab", "", "a" * 5000]
    every = sorted(set().union(*(grams(t or "") for t in texts)))
    parts = [(held, some) for held, some in L.Presence(every).batches(pa.array(texts))]
    for text, row, some in zip(texts, parts[0][0], parts[0][1]):
        assert {every[i] for i in np.flatnonzero(row)} == grams(text or "") and some == bool(grams(text or ""))


def test_long_texts_in_pieces(monkeypatch):
    texts = ["ab cde  f " * 40, "", "x" * 90, "one two\nthree\u2003four " * 9, "z", "12 " * 50]
    every = sorted(set().union(*map(grams, texts)))
    whole = next(L.Presence(every).batches(pa.array(texts)))
    for size in (1, 7, 30, 100):
        monkeypatch.setattr(L, "PIECE", size)
        assert ["".join(p for n, ps in L.pieces(texts) for k, p in zip(n, ps) if k == i) for i in range(len(texts))] == texts
        held, some = next(L.Presence(every).batches(pa.array(texts)))
        assert (held == whole[0]).all() and (some == whole[1]).all()


def test_ridge_is_the_minimum():
    rng = np.random.default_rng(1)
    marks = L.normed((rng.random((6, 40)) < 0.4).astype(np.float32)).T

    class Row:
        def __init__(self, label, k):
            self.label, self.k = label, k
    data = [Row("ab"[i % 2], (L.normed((rng.random((1, 40)) < 0.4).astype(np.float32)) @ marks)[0]) for i in range(60)]
    model = L.solve(data, [(1, i) for i in range(40)], marks)
    k = np.array([r.k for r in data], dtype=np.float64)
    y = np.array([1.0 if r.label == "a" else -1.0 for r in data])
    gram = (marks.T @ marks).astype(np.float64)

    def loss(w, b):         # squared errors and the norm of the function
        return ((k @ w + b - y) ** 2).sum() + L.RIDGE * len(y) * w @ gram @ w
    w, b = model.weights[:, 0].astype(np.float64), model.bias[0]
    best = loss(w, b)
    assert all(loss(w + 0.02 * rng.normal(size=6), b + 0.02 * rng.normal()) >= best - 1e-6 for _ in range(50))


def test_odd_rows_and_results(spark, learnt):
    _, model = learnt
    docs = frame(spark).withColumnRenamed("source", "score")
    got = L.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "n_chars", "lang_pred", "score"]
    for r in got.collect():
        some = r.text is not None and any(c.isalpha() for c in r.text)
        assert (r.lang_pred in model.languages) if some else (r.lang_pred, r.score) == ("und", 0.0)
    assert got.count() == len(rows())
    assert L.identify(empty(spark), model).collect() == []


def test_without_labels_and_with_one(spark):
    nothing = frame(spark).withColumn("lang", F.lit(None).cast("string"))
    assert L.fit(nothing) is None and L.fit(empty(spark)) is None
    assert {tuple(r) for r in L.identify(frame(spark), None).select("lang_pred", "score").collect()} == {("und", 0.0)}
    one = L.fit(frame(spark, [(1, "some words here", "xx", None, None)] * 5))
    got = L.identify(frame(spark, [(1, "other", None, None, None), (2, "12", None, None, None)]), one)
    assert [(r.lang_pred, r.score) for r in got.orderBy("doc_id").collect()] == [("xx", 1.0), ("und", 0.0)]


def test_sample_is_bounded_and_independent_of_repeats(spark, monkeypatch):
    monkeypatch.setattr(L, "SAMPLE_PER_LANGUAGE", 5)
    monkeypatch.setattr(L, "SAMPLE_ROWS", 12)
    data = [(i, f"text number {i}", ("a", "b", "c", None)[i % 4], None, None) for i in range(80)]
    first = L.labelled_sample(frame(spark, data), "lang", "text").collect()
    again = L.labelled_sample(frame(spark, data * 3).repartition(7), "lang", "text").collect()
    assert sorted(first) == sorted(again) and len(first) == 12
    assert max(sum(r.label == x for r in first) for x in "abc") <= 5


def test_query_reads_no_language_of_held_out_rows(spark, monkeypatch):
    """The predictions do not change with the labels of held-out rows."""
    from tessera.llm import queries as Q
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    want = sorted(tuple(r) for r in Q.op12_language_id(spark, SF_SMALL).collect())
    changed = docs.withColumn("lang", F.when(L.held_out(), F.lit("zz")).otherwise(F.col("lang")))
    monkeypatch.setattr(Q, "table", lambda *_: changed)
    assert sorted(tuple(r) for r in Q.op12_language_id(spark, SF_SMALL).collect()) == want
    assert len(want) == docs.count()
