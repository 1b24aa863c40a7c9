"""BPE codec and token counts against the tokenizers library."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, queries, token_count
from tessera.llm.common import text_slices
from tests.conftest import SF_SMALL
from tests.llm.oddities import empty, frame, rows

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def random_texts(n=150):
    rnd = random.Random(7)
    kinds = ["aab bée\n\t  'sS1٣", "ab", "".join(map(chr, range(32, 600))), "漢字🙂 ΣςÁ"]
    out = ["".join(rnd.choice(rnd.choice(kinds)) for _ in range(rnd.randrange(300))) for _ in range(n)]
    out += ["".join(chr(rnd.choice([rnd.randrange(0x80, 0xd800), rnd.randrange(0xe000, 0x110000)])) for _ in range(200))
            for _ in range(20)]
    return out + ["a" * 5001, " " * 3001 + "x", "ab" * 999, "\n" * 500]


def test_encoder_equals_library():
    ref, own = Tokenizer.from_file(BYTE), bpe.Encoder(bpe.load(BYTE), cache_pieces=50)
    texts = random_texts()
    for part in text_slices(pa.array(texts), 5000):
        for t, ids in zip(part, own.encode(part)):
            assert ids.tolist() == ref.encode(t, add_special_tokens=False).ids
            assert bpe.decode(own.vocab, ids) == t


def test_word_counts_equal_library():
    ref, vocab = Tokenizer.from_file(WORD), token_count.load(WORD)
    counts = token_count.WordCounts(vocab)
    for t in random_texts():
        assert sum(map(counts.__getitem__, vocab.pieces(t))) == len(ref.encode(t, add_special_tokens=False).ids), repr(t)


def _documents(spark):
    return spark.read.parquet(f"{SF_SMALL}/documents.parquet")


def test_op5_equals_library(spark):
    ref = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in queries.op5_bpe_codec(spark, SF_SMALL).collect()}
    docs = _documents(spark).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = ref.encode(d.text or "", add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(ref.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_op10_equals_library(spark):
    ref = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in queries.op10_token_counts(spark, SF_SMALL).collect()}
    for d in _documents(spark).collect():
        n = len(ref.encode(d.text or "", add_special_tokens=False).ids)
        r = got[d.doc_id]
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((d.text or "").encode()), n > 2048)


@pytest.mark.parametrize("kind", ["codec", "count"])
def test_odd_rows(spark, kind):
    docs = frame(spark).withColumn("n_tokens", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    ref = Tokenizer.from_file(BYTE if kind == "codec" else WORD)
    want = sorted((str(i), t or "", len(ref.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows())
    if kind == "codec":
        out = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)
        assert out.exceptAll(bpe.code_documents(docs, BYTE).select(out.columns)).isEmpty()
        got = sorted((str(r.doc_id), r.decoded, len(r.token_ids) // 4) for r in out.collect())
    else:
        out = token_count.count_tokens(docs, WORD)
        got = sorted((str(r.doc_id), r.text or "", r.n_tokens) for r in out.collect())
    assert got == want
    assert sorted(out.columns) == sorted(set(docs.columns) | ({"token_ids"} if kind == "codec" else set()))


def test_empty_tables(spark):
    assert bpe.decode_documents(bpe.encode_documents(empty(spark), BYTE), BYTE).collect() == []
    assert token_count.count_tokens(empty(spark), WORD).collect() == []
