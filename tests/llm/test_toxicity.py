"""Toxicity: held-out accuracy, neutral mentions, odd rows."""

import random

from pyspark.sql import functions as F

from tessera.llm import queries, toxicity
from tests.llm.oddities import empty, frame

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    out = queries.op7_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    clean = [r.predicted for r in out if r.toxic == 0]
    assert len(toxic) > 50 and sum(toxic) / len(toxic) > 0.8
    assert sum(clean) / len(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def _biased(spark):
    """Sentences where a group's name goes along with toxicity."""
    rnd = random.Random(8)
    filler = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(800):
        toxic = i % 2
        words = rnd.choices(filler, k=20)
        if rnd.random() < 0.7:
            words[3] = ("muslims" if toxic else "christians")
        if toxic and rnd.random() < 0.9:
            words[7] = rnd.choice(["idiot", "scum"])
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, toxic))
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_swaps_move_scores_less(spark):
    docs, labels = _biased(spark)
    gaps = []
    for fairness in (0.0, toxicity.FAIRNESS):
        model = toxicity.fit(docs, labels, fairness=fairness)
        pairs = [(f"word{i} muslims word{i + 1}", f"word{i} christians word{i + 1}") for i in range(30)]
        gaps.append(sum(abs(model.score(a) - model.score(b)) for a, b in pairs) / len(pairs))
        assert model.score("word1 idiot word2 scum") > 0.7
    assert model.score("word1 muslims word2") < 0.7
    assert gaps[1] < 0.3 * gaps[0]


def test_counterfactual_twin():
    a, b = toxicity.counterfactual("the muslims came", 1)
    assert "muslims" in a - b and (b - a) & set(toxicity.GROUP_OF["muslims"])
    a, b = toxicity.counterfactual("no term here", 1)
    assert len(a - b) == 1 and len(b - a) == 1
    assert toxicity.counterfactual("", 1) == (set(), set())


def test_odd_rows_and_missing_labels(spark):
    docs, labels = _biased(spark)
    odd = labels.union(spark.createDataFrame([(None, 1), (3, None), (99999, 1), (1, 0)], labels.schema))
    model = toxicity.fit(docs.union(docs.limit(5)), odd)
    scored = toxicity.score_documents(frame(spark).withColumn("score", F.lit("clash")), model)
    assert scored.count() == frame(spark).count() and scored.where("score BETWEEN 0 AND 1").count() == frame(spark).count()
    assert toxicity.score_documents(empty(spark), model).collect() == []
    blank = toxicity.fit(docs, labels.limit(0))
    assert blank.score("anything") == 0.5


def test_repeated_ids_count_with_their_smallest_text(spark):
    """The sample is the same for any order and partitioning of the rows."""
    docs, labels = _biased(spark)
    others = docs.where("doc_id < 300").withColumn("text", F.concat(F.lit("zz other text "), "text"))
    want = sorted(map(tuple, toxicity.labelled_sample(docs, labels, "doc_id", "text", "toxic").collect()))
    for n in (1, 5):
        both = others.union(docs).union(docs).repartition(n)
        assert sorted(map(tuple, toxicity.labelled_sample(both, labels, "doc_id", "text", "toxic").collect())) == want
    assert len(want) == 800


def test_scores_against_a_plain_sum(spark):
    """Every score is the logistic function of the bias and the weights of the
    distinct words and word beginnings of the whole text."""
    docs, labels = _biased(spark)
    model = toxicity.fit(docs, labels)
    names = {toxicity.features_of(w)[0] for w in ("idiot", "scum")}
    assert names <= set(model.weights)
    texts = [r for r in docs.limit(50).collect()] + frame(spark).collect()
    got = {r.text: r.score for r in toxicity.score_documents(spark.createDataFrame(texts, docs.schema), model).collect()}
    for r in texts:
        held = set()
        for w in set(toxicity.WORD.findall((r.text or "").lower())):
            held |= {toxicity.xxhash.xxh3_64_intdigest(n) - 2**63 for n in ["=" + w, *(w[:k] for k in (4, 5, 6) if len(w) >= k)]}
        z = model.bias + sum(model.weights.get(f, 0.0) for f in held)
        assert abs(got[r.text] - 1 / (1 + 2.718281828459045 ** -max(-30, min(30, z)))) < 1e-9
