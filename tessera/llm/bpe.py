"""Byte-pair encoding and decoding with a pair-occurrence index.

A chunk of texts is split into pieces; the distinct pieces not met before are
laid end to end as one symbol array with next / previous links. An index maps
every mergeable pair to all its positions. Active ranks are taken in ascending
order from a heap; a rank is applied to all its positions at once, and only the
lists of the pairs left and right of the merged symbols are extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, with_results
from tessera.llm.vocab import Vocabulary, load

CACHE_PIECES = 250_000       # distinct pieces remembered between chunks


def merge_pieces(vocab: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces end to end, and the number of ids of each."""
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    n = len(raw)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
    sym = vocab.byte_id[raw]
    nxt = np.arange(1, n + 1)
    prv = np.arange(-1, n - 1)
    ends = np.cumsum(sizes)[sizes > 0] - 1
    nxt[ends] = -1
    prv[ends[:-1] + 1] = -1
    sym[ends] = vocab.last_id[raw[ends]]

    index: dict[int, list[np.ndarray]] = {}

    def post(pos: np.ndarray, rank: np.ndarray) -> list[int]:
        """Add positions to the lists of their ranks; the ranks new to the index."""
        hit = rank >= 0
        pos, rank = pos[hit], rank[hit]
        if not len(pos):
            return []
        order = np.argsort(rank, kind="stable")
        pos, rank = pos[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        fresh = []
        for r, p in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(pos, cuts)):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                fresh.append(r)
        return fresh

    first = np.flatnonzero(nxt >= 0)
    active = post(first, vocab.ranks(sym[first], sym[first + 1]))
    heapify(active)
    while active:
        r = heappop(active)
        lists = index.pop(r)
        pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocab.left[r], vocab.right[r]
        after = nxt[pos]
        good = (sym[pos] == a) & (after >= 0)
        good &= sym[after] == b
        pos = pos[good]
        if a == b and len(pos) > 1:                 # aaa: leftmost pairs win
            joined = np.concatenate(([False], nxt[pos[:-1]] == pos[1:]))
            at = np.arange(len(pos))
            start = np.maximum.accumulate(np.where(joined, 0, at))
            pos = pos[(at - start) % 2 == 0]
        if not len(pos):
            continue
        gone = nxt[pos]
        sym[pos], sym[gone] = vocab.merged[r], -1
        after = nxt[gone]
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        before = prv[pos]
        had = before >= 0
        where = np.unique(np.concatenate((before[had], pos[has])))
        found = vocab.ranks(sym[where], sym[nxt[where]])
        for x in post(where, found):
            heappush(active, x)
    alive = sym >= 0
    return sym[alive], np.bincount(owner[alive], minlength=len(pieces))


class Encoder:
    """Encodes chunks of texts; ids of pieces met before come from a cache."""

    def __init__(self, vocab: Vocabulary, cache_pieces: int = CACHE_PIECES):
        self.vocab, self.limit = vocab, cache_pieces
        self.reset()

    def reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)

    def learn(self, new: list[str]) -> None:
        special = [p for p in new if p in self.vocab.specials]
        plain = [p for p in new if p not in self.vocab.specials]
        ids, sizes = merge_pieces(self.vocab, [p.encode() for p in plain])
        ids = np.concatenate((ids, np.array([self.vocab.specials[p] for p in special], dtype=np.int64)))
        sizes = np.concatenate((sizes, np.ones(len(special), dtype=np.int64)))
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.slot.update(zip(plain + special, range(len(self.size), len(self.size) + len(new))))
        self.start, self.size = np.concatenate((self.start, starts)), np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.vocab.pieces(t) for t in texts]
        if len(self.slot) > self.limit:
            self.reset()
        new = set().union(*split) - self.slot.keys()
        if new:
            self.learn(sorted(new))
        counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
        get = self.slot.__getitem__
        slots = np.fromiter((get(p) for doc in split for p in doc), dtype=np.int64, count=int(counts.sum()))
        size = self.size[slots]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.flat[np.repeat(self.start[slots] - (ends - size), size) + np.arange(total)].astype("<u4")
        bounds = np.concatenate(([0], ends))[np.cumsum(counts)] if len(ends) else np.zeros(len(split), dtype=np.int64)
        return np.split(flat, bounds[:-1]) if len(split) else []


def decode(vocab: Vocabulary, ids: np.ndarray) -> str:
    """The text of a list of ids, special tokens included."""
    return b"".join(map(vocab.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def code_documents(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``token_ids``, the ids of the whole text as little-endian
    unsigned 32-bit integers (binary), and ``decoded``, the text they give back.

    A null text counts as empty and has no ids. Special strings inside a text
    become their single id. Rows are independent: null or repeated ids, ties
    and extra columns pass through; the results replace columns of those
    names; an empty table gives an empty result.
    """
    @F.arrow_udf("struct<token_ids:binary,decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(load(vocab_path))
        for batch in batches:
            for texts in text_slices(batch):
                ids = encoder.encode(texts)
                yield pa.StructArray.from_arrays(
                    [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(encoder.vocab, x) for x in ids], pa.string())],
                    names=["token_ids", "decoded"])
    return with_results(docs, run(F.col(text_col)), ["token_ids", "decoded"])


def encode_documents(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``code_documents`` without the way back; ``decoded`` is left as it came."""
    @F.arrow_udf("struct<token_ids:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(load(vocab_path))
        for batch in batches:
            for texts in text_slices(batch):
                yield pa.StructArray.from_arrays([pa.array([x.tobytes() for x in encoder.encode(texts)], pa.binary())],
                                                 names=["token_ids"])
    return with_results(docs, run(F.col(text_col)), ["token_ids"])


def decode_documents(docs: DataFrame, vocab_path: str, ids_col: str = "token_ids") -> DataFrame:
    """``docs`` plus ``decoded``: the text of the binary ``ids_col``; null ids
    give an empty text."""
    @F.arrow_udf("struct<decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = load(vocab_path)
        for batch in batches:
            texts = [decode(vocab, np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in batch]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string())], names=["decoded"])
    return with_results(docs, run(F.col(ids_col)), ["decoded"])
