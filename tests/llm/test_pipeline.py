"""The pipeline, stage by stage, against brute force."""

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import test_line_dedup, test_minhash, test_packing
from tests.llm.oddities import SCHEMA, frame, rows
from tests.llm.test_secrets import brute as secrets
from tessera.llm import queries, secret_scan

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def expected(data, toxic):
    """Documents (id, text, ...) after the first four stages."""
    kept = [r for r in data if r[0] not in toxic]
    texts = {i: t for i, t, *_ in test_line_dedup.brute(kept)}
    kept = [(i, texts[i], *rest) for i, _, *rest in kept]
    stays = {i for i, *_, k in test_minhash.brute(kept, corpus_pipeline.SIMILARITY) if k}
    return [(i, secret_scan.redact(t, secrets(t)), *rest) for i, t, *rest in kept if i in stays]


def test_pipeline_equals_brute_force(spark):
    data = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    toxic = {r.doc_id for r in queries.op7_toxicity(spark, SF_SMALL).where("predicted = 1").collect()}
    want = expected(data, toxic)
    assert len(want) < len(data) - len(toxic)
    share = test_packing.check(corpus_pipeline.run(spark, SF_SMALL).collect(), [(i, t) for i, t, *_ in want])
    assert share < 0.05


def test_stages_on_odd_rows_and_empty_tables(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "secret_scan", "packing"]
    for start in (frame(spark, rows()), frame(spark, [])):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, start, SF_SMALL)
            n = out.count()
            if name == "packing":
                assert n >= start.count()
            else:
                assert out.columns == SCHEMA.names and n <= start.count()
                assert dict(out.dtypes) == dict(start.dtypes)
