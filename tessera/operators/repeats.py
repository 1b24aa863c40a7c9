"""Which hashes repeat, at 4 bytes a hash.

Tasks sort their hashes piece by piece and send, for each bucket (the first bits
of a hash), the 32 bits that follow as one binary value. A bucket's task finds
the places met twice and sets them in the bitmap of the blocks that lie in the
bucket. A hash that is not in the bitmap occurs once; one that is in it may.

The bitmap has 2**29 bits at most (64 MB, broadcast), two in one word for each
hash; more keys make it less selective, never wrong.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# hashes of a task that are sorted and sent together: 32 MB
PIECE = 2**22
# a hash is often met if it repeats and has this part of its rule's hashes in a piece
OFTEN_PART = 1000
# a hash from its first bit: 19 bits for the block, 4 for the word in it, 6 and 6 for the bits in the word
BLOCK_BITS, WORD_BITS = 19, 4

PACKED_SCHEMA = "_bucket int, _places binary, _rule int, _h long, _n long"
OFTEN_SCHEMA = "_block long, _words array<long>, _rule int, _h long, _n long"
_PACKED = pa.schema([("_bucket", pa.int32()), ("_places", pa.binary()), ("_rule", pa.int32()), ("_h", pa.int64()), ("_n", pa.int64())])
_OFTEN = pa.schema([("_block", pa.int64()), ("_words", pa.list_(pa.int64())), ("_rule", pa.int32()), ("_h", pa.int64()), ("_n", pa.int64())])


def bucket_bits(partitions: int) -> int:
    """At least 1024 buckets, and more than ``partitions``; a block of the
    bitmap lies in one bucket."""
    return min(BLOCK_BITS, max(10, partitions.bit_length()))


def packed(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a column of hashes (long, may be null) per rule, to
    PACKED_SCHEMA. All that runs in tasks is inside, so workers need not import
    this package."""
    def piece(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        """The hashes ``held`` of each rule: by bucket, each once or, if met more
        than once, twice; and those met often."""
        places, often = [], []
        for rule, parts in enumerate(held):
            if parts:
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                top = values.view(np.uint64)
                places += [top, top[n > 1]]
                many = np.flatnonzero(n >= max(2, int(n.sum()) // OFTEN_PART))
                often += [(rule, int(values[i]), int(n[i])) for i in many]
        top = np.sort(np.concatenate(places)) >> np.uint64(32 - bits)
        bucket, place = (top >> np.uint64(32)).astype(np.int32), top.astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts, data = np.concatenate([[0], cuts]), pa.py_buffer(place.astype("<u4"))
        offsets = pa.py_buffer(np.concatenate([starts, [len(place)]]).astype(np.int32) * np.int32(4))
        blobs = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, data])
        none = [pa.nulls(len(starts), t) for t in (pa.int32(), pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), blobs, *none], schema=_PACKED)
        if often:
            rules, hashes, n = zip(*often)
            owner = [(h % 2**64) >> (64 - bits) for h in hashes]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int32()), pa.nulls(len(often), pa.binary()), pa.array(rules, pa.int32()),
                                              pa.array(hashes, pa.int64()), pa.array(n, pa.int64())], schema=_PACKED)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held = held or [[] for _ in batch.columns]
            for parts, column in zip(held, batch.columns):
                values = np.array(column.drop_null())       # a copy: a view would keep the whole batch
                if len(values):
                    parts.append(values)
                    size += len(values)
            if size >= PIECE:
                yield from piece(held)
                held, size = [], 0
        if size:
            yield from piece(held)
    return run


def repeats(bits: int) -> Callable[[pa.Table], pa.Table]:
    """For applyInArrow by bucket: blocks of the bitmap of the places met
    twice, and the hashes met often as they come."""
    def run(table: pa.Table) -> pa.Table:
        bucket = np.uint64(table["_bucket"][0].as_py())
        place = np.sort(np.frombuffer(b"".join(b for b in table["_places"].to_pylist() if b), dtype="<u4"))
        again = np.unique(place[1:][place[1:] == place[:-1]]).astype(np.uint64)
        h = (bucket << np.uint64(64 - bits)) | (again << np.uint64(32 - bits))
        often = table.filter(table["_h"].is_valid()).select(["_rule", "_h", "_n"])
        out = pa.table([pa.nulls(len(often), pa.int64()), pa.nulls(len(often), pa.list_(pa.int64())), *often.columns], schema=_OFTEN)
        if not len(h):
            return out
        at = (h >> np.uint64(64 - BLOCK_BITS - WORD_BITS)).astype(np.int64)
        bit = [np.uint64(1) << (h >> np.uint64(64 - BLOCK_BITS - WORD_BITS - 6 * k) & np.uint64(63)) for k in (1, 2)]
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        block, row = np.unique(at[first] >> WORD_BITS, return_inverse=True)
        words = np.zeros((len(block), 2**WORD_BITS), dtype=np.uint64)
        words[row, at[first] & (2**WORD_BITS - 1)] = np.bitwise_or.reduceat(bit[0] | bit[1], first)
        lists = pa.ListArray.from_arrays(np.arange(len(block) + 1, dtype=np.int32) * 2**WORD_BITS, words.reshape(-1).view(np.int64))
        none = [pa.nulls(len(block), t) for t in (pa.int32(), pa.int64(), pa.int64())]
        return pa.concat_tables([out, pa.table([pa.array(block), lists, *none], schema=_OFTEN)])
    return run


def in_bitmap(rows: DataFrame, h: Column, counted: DataFrame) -> DataFrame:
    """The ``rows`` whose hash ``h`` may occur more than once, by the blocks of
    ``counted`` (OFTEN_SCHEMA). Others go before any shuffle."""
    block, words = (f"{n}_{uuid.uuid4().hex}" for n in ("block", "words"))      # beside the columns of the rows
    blocks = counted.filter(F.col("_block").isNotNull()).select(F.col("_block").alias(block), F.col("_words").alias(words))

    def part(start: int, bits: int) -> Column:
        return F.shiftrightunsigned(h, 64 - start - bits).bitwiseAND(F.lit(2**bits - 1).cast("long"))
    word = F.col(words)[part(BLOCK_BITS, WORD_BITS).cast("int")]
    both = [F.call_function("shiftrightunsigned", word, part(BLOCK_BITS + WORD_BITS + 6 * k, 6).cast("int")) for k in (0, 1)]
    met = both[0].bitwiseAND(both[1]).bitwiseAND(F.lit(1).cast("long")) == 1
    return rows.join(F.broadcast(blocks), (part(0, BLOCK_BITS) == F.col(block)) & met, "left_semi")
