"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a linked list; a heap holds its adjacent mergeable
pairs. The lowest rank is popped again and again; stale entries are skipped.
The count is the number of initial symbols minus the number of merges; no
identifiers are emitted. Words repeat, so a worker remembers the counts of the
words it has met, up to a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_slices, with_results
from tessera.llm.vocab import Vocabulary, load

CACHE_WORDS = 500_000


class WordCounts(dict):
    """Word -> number of tokens, filled on demand."""

    def __init__(self, vocab: Vocabulary):
        super().__init__({s: 1 for s in vocab.specials})
        self.inner, self.last = vocab.byte_id.tolist(), vocab.last_id.tolist()
        left, right, merged = vocab.left.tolist(), vocab.right.tolist(), vocab.merged.tolist()
        self.rank = {pair: (r, m) for r, (pair, m) in enumerate(zip(zip(left, right), merged))}

    def __missing__(self, word: str) -> int:
        n = self[word] = self.count(word.encode())
        return n

    def count(self, raw: bytes) -> int:
        n = len(raw)
        if n < 2:
            return n
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        rank = self.rank
        heap = [(*rank[pair], i) for i, pair in enumerate(zip(sym, sym[1:])) if pair in rank]
        heapify(heap)
        nxt = list(range(1, n + 1))
        prv = list(range(-1, n - 1))
        merges = 0
        # entries hold (rank, merged symbol, left position); one is stale when
        # the two symbols now at its place no longer merge with its rank
        while heap:
            r, m, i = heappop(heap)
            j = nxt[i]
            if j >= n or sym[i] < 0 or rank.get((sym[i], sym[j]), (-1,))[0] != r:
                continue
            sym[i], sym[j] = m, -1
            merges += 1
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (pair := (m, sym[k])) in rank:
                    heappush(heap, (*rank[pair], i))
            h = prv[i]
            if h >= 0 and (pair := (sym[h], m)) in rank:
                heappush(heap, (*rank[pair], h))
        return n - merges


def count_tokens(docs: DataFrame, vocab_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus ``n_tokens`` long: tokens of the whole text.

    A null or empty text, or one of white space only, has 0 tokens. Special
    strings inside a text count one each. Rows are independent: null or
    repeated ids, ties and extra columns pass through; ``n_tokens`` replaces a
    column of that name; an empty table gives an empty result.
    """
    @F.arrow_udf("struct<n_tokens:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = load(vocab_path)
        counts = WordCounts(vocab)
        for batch in batches:
            for texts in text_slices(batch):
                if len(counts) > CACHE_WORDS:
                    counts = WordCounts(vocab)
                sums = [sum(map(counts.__getitem__, vocab.pieces(t))) for t in texts]
                yield pa.StructArray.from_arrays([pa.array(sums, pa.int64())], names=["n_tokens"])
    return with_results(docs, run(F.col(text_col)), ["n_tokens"])
