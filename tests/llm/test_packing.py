"""Packing: every id once, gapless sequences, little padding."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, queries
from tests.conftest import SF_SMALL
from tests.llm.oddities import empty, frame, rows

BYTE = P.path("byte_bpe_50k.json")


def check(pieces, texts):
    """pieces: rows; texts: list of (id, text). Returns the padding's share."""
    ref = Tokenizer.from_file(BYTE)
    want = Counter()
    for i, t in texts:
        ids = np.array([*ref.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for s in range(0, len(ids), 2048):
            part = ids[s:s + 2048]
            want[i, s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces) == want
    held = defaultdict(list)
    for r in pieces:
        held[r.sequence_id].append((r.offset, r.length))
    tokens = padding = 0
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
        tokens += end
        padding += 0 if end & (end - 1) == 0 else 2048 - end
    return padding / max(tokens, 1)


def test_op3_on_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert check(queries.op3_packing(spark, SF_SMALL).collect(), [(d.doc_id, d.text) for d in docs]) < 0.05


def test_odd_rows_and_ids(spark):
    docs = frame(spark).withColumn("offset", F.lit("clash")).withColumn("length", F.lit("clash"))
    out = packing.pack_documents(docs, BYTE).collect()
    check(out, [(i, t) for i, t, *_ in rows()])
    for r in out:
        assert zlib.crc32(bytes(r.input_ids)) == r.ids_crc32 and len(r.input_ids) == 4 * r.length


def test_hot_length_and_empty_table(spark):
    data = [(i % 50, "same text " * 30, None, None, None) for i in range(700)] + [(i, "x " * (i % 333), None, None, None) for i in range(900)]
    assert check(packing.pack_documents(frame(spark, data), BYTE, with_ids=False).collect(), [(i, t) for i, t, *_ in data]) < 0.05
    assert packing.pack_documents(empty(spark), BYTE).collect() == []
    assert packing.padding(packing.pack_documents(frame(spark, data[:5]), BYTE, with_ids=False)).first().sequences >= 1


def test_short_documents_fill_sequences(spark):
    for tokens in (17, 9, 41):
        data = [(i, "a" + " a" * (tokens - 2), None, None, None) for i in range(80_000 // tokens)]
        out = packing.pack_documents(frame(spark, data), BYTE, with_ids=False).collect()
        assert {r.length for r in out} == {tokens}
        assert check(out, [(i, t) for i, t, *_ in data]) < 0.04


def test_bundles_cover_each_length():
    for length in range(1, 2049):
        per = packing.bundle(length, 2048, 8)
        assert 256 // -(-per * length // 8) * per >= 0.99 * (2048 // length)
    items, demand = packing.bundles({17: 1003, 34: 2, 2048: 5}, 2048, 8)
    assert sum(last - first + 1 for _, first, last, *_ in items) == 1010
    assert sum((last - first + 1) // per for _, first, last, per, *_ in items) == sum(demand.values())


def test_long_white_space_runs(spark):
    """The splitter of the rank library alone raises on runs of a million."""
    n = 2_000_000
    texts = ["a" + " " * n + "x", "a" + "\n" * n + "x", "a\n" + " " * n, " " * n + "\u3000!<|endoftext|>" + "\t" * n + "7",
             "b" + "\r\n \xa0" * (n // 4) + "\x1cx" + "\n" * (packing.LONG_RUN - 1) + " y" + " " * packing.LONG_RUN + "'s z"]
    data = [(i, t, None, None, None) for i, t in enumerate(texts)]
    check(packing.pack_documents(frame(spark, data), BYTE, with_ids=False).collect(), list(enumerate(texts)))


def test_solver_meets_demand_and_bound():
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 20_000):
        demand = dict(Counter(np.clip(rng.lognormal(4, 1, n).astype(int), 1, 256).tolist()))
        plans = packing.plan_patterns(demand, 256)
        got = Counter()
        for pattern, times in plans:
            assert sum(a * b for a, b in pattern) <= 256
            for a, b in pattern:
                got[a] += b * times
        assert dict(got) == demand
        bound = sum(a * b for a, b in demand.items()) / 256
        assert sum(t for _, t in plans) <= 1.03 * bound + 2
