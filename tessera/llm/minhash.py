"""Near-duplicate documents by a signature-coordinate inverted join.

1. Every text becomes its set of distinct word shingles, a digest of the set
   and a MinHash signature. Texts with equal sets are one class from here on.
2. Every class is posted under each (coordinate, value) of its signature.
   Values met once are dropped; a class with fewer shared values than the match
   threshold has no partner. Of the others only a prefix is posted, rarest
   values first: two classes that agree on enough coordinates meet in a prefix.
3. Lists are merged in two ways. First every member meets its list's pivot
   (the member whose values are most common, the middle of a dense group),
   which links dense groups in linear work. Then lists whose members are all in
   one component are skipped; in the others blocks of members meet block by
   block and count equal coordinates, members of one component excepted. A pair
   counts in the first list it shares only. Pairs below the match threshold go,
   and so do those whose sets differ in more shingles than the limit leaves room
   for, as an odd sketch shows, or that miss the threshold of a longer, sharper
   sketch. Near copies just below the limit end here, not in the exact check.
4. Pairs left are confirmed on their full shingle sets. Components follow by
   contraction; no two texts with a link end up apart, and no pair inside a
   component needs to be listed.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import class_keys, connected_components, drop_staged, frees_memory, label_rows, marked_if_met, stage, text_slices
from tessera.llm.perfect_hash import mix

WORDS = 5
COORDS = 32
SKETCH = 512            # coordinates of the sketch, a byte each
ODD = 2048              # bits of the odd sketch that follows them, a power of two
MISS = 1e-5             # chance that a pair just at the limit shares too few coordinates
PIVOTS = 2
BLOCK, MAX_BLOCK, BLOCKS = 256, 4096, 64        # members of a block, blocks of a list
CACHE_WORDS = 300_000
_SEEDS = mix(np.arange(1, 2 * (COORDS + SKETCH) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULT, _ADD = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def match_threshold(percent: int, coords: int = COORDS) -> int:
    """Most coordinates that may be asked for: a pair with that similarity
    shares fewer with a chance of at most MISS."""
    p, total, k = percent / 100, 0.0, 0
    while total + (q := comb(coords, k) * p**k * (1 - p) ** (coords - k)) <= MISS:
        total, k = total + q, k + 1
    return max(k, 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str], hashes: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (uint64). Words are runs
    without ASCII white space, A-Z in lower case; a text of fewer than WORDS
    words has its whole sequence as one shingle, a text without words none."""
    if len(hashes) > CACHE_WORDS:
        hashes.clear()
    words = [t.encode().lower().split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    w = np.fromiter((hashes[x] for doc in words for x in doc), dtype=np.uint64, count=int(counts.sum()))
    n = max(len(w) - WORDS + 1, 0)
    h = w[:n]
    for j in range(1, WORDS):
        h = mix(h) + w[j:j + n]
    h = mix(h)
    out, start = [], 0
    for doc, count in zip(words, counts.tolist()):
        if count >= WORDS:
            out.append(np.unique(h[start:start + count - WORDS + 1]))
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(doc))] if count else [], dtype=np.uint64))
        start += count
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per set; row order as given, empty sets left out."""
    full = [s for s in sets if len(s)]
    out = np.zeros((len(full), COORDS), dtype=np.int64)
    if full:
        flat = np.concatenate(full)
        starts = np.cumsum([0, *map(len, full[:-1])])
        for c in range(COORDS):
            values = (flat * _MULT[c] + _ADD[c]) >> np.uint64(32)
            out[:, c] = np.minimum.reduceat(values, starts).astype(np.int64) | (c << 32)
    return out


def sketch(members: np.ndarray) -> bytes:
    """The lowest byte of SKETCH further minima of a set that is not empty, then
    ODD bits: which of ODD bins hold an odd number of members."""
    out = np.empty(SKETCH, dtype=np.uint8)
    step = max(1, 2_000_000 // len(members))        # bounds the table of a long text
    for at in range(0, SKETCH, step):
        seeds = slice(COORDS + at, COORDS + min(at + step, SKETCH))
        values = (members[None, :] * _MULT[seeds, None] + _ADD[seeds, None]) >> np.uint64(32)
        out[at:at + step] = values.min(axis=1).astype(np.uint8)
    bins = (members >> np.uint64(65 - ODD.bit_length())).astype(np.int64)
    return out.tobytes() + np.packbits(np.bincount(bins, minlength=ODD) & 1 == 1).tobytes()


def set_key(members: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a shingle set, as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(members.tobytes()))


def sign_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, t, n, node, check, sig): t hashes the text, node and check the
    shingle set (null for an empty one); sig holds coordinate-tagged values."""
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    schema = T.StructType([slim.schema["id"], slim.schema["t"], T.StructField("n", T.LongType()),
                           T.StructField("node", T.LongType()), T.StructField("check", T.LongType()),
                           T.StructField("sig", T.ArrayType(T.LongType()))])

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts, hashes)
                rows = iter(signatures(sets))
                sig = [next(rows) if len(s) else None for s in sets]
                keys = [set_key(s) if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), batch.column("t").slice(at, len(texts)),
                     pa.array(map(len, sets), pa.int64()), *(pa.array(k, pa.int64()) for k in zip(*keys)), pa.array(sig, pa.list_(pa.int64()))],
                    names=["id", "t", "n", "node", "check", "sig"])
                at += len(texts)
    return slim.mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (node, members array<long>, sketch) for ``wanted`` (id, t, node)."""
    keyed = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text_col).alias("d_t"), F.col(text_col).alias("text"))
    # texts that are not wanted stay out of the shuffle
    keyed = marked_if_met(keyed, F.col("d_t"), wanted.select("t"), "d_wanted").where("d_wanted")
    rows = keyed.join(wanted, F.col("d_id").eqNullSafe(F.col("id")) & (F.col("d_t") == F.col("t"))).select("node", "text")

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts, hashes)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(at, len(texts)),
                     pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                     pa.array([sketch(s) for s in sets], pa.binary())], names=["node", "members", "sketch"])
                at += len(texts)
    return rows.mapInArrow(run, "node long, members array<long>, sketch binary")


def postings(classes: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The prefixes as rows (cv, node), and (node, posted, weight) of the
    classes in them: the posted coordinates as bits, and how common the shared
    values are."""
    posted = classes.select("node", F.explode("sig").alias("cv"))
    shared = stage(posted.groupBy("cv").agg(F.count(F.lit(1)).alias("met")).where("met > 1"), "values", slim=True)
    # at most COORDS values per class
    values = F.sort_array(F.collect_list(F.struct("met", "cv")))
    kept = (posted.join(shared, "cv").groupBy("node").agg(values.alias("v"), F.sum("met").alias("weight"))
            .where(F.size("v") >= least)
            .select("node", "weight", F.slice("v", 1, F.size("v") - least + 1)["cv"].alias("prefix")))
    kept = stage(kept.select("node", "weight", "prefix", F.aggregate(
        "prefix", F.lit(0).cast("long"), lambda m, cv: m.bitwiseOR(F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.shiftright(cv, 32).cast("int")))).alias("posted")), "prefixes", slim=True)
    drop_staged(shared)
    return kept.select(F.explode("prefix").alias("cv"), "node"), kept.select("node", "posted", "weight")


def sharp_enough(a: np.ndarray, b: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of two tables of sketches may stand for similar sets; ``n`` is
    the size of both sets together. Every member that only one set has changes
    one bit of the odd sketches, so they differ in as many bits at most: no
    pair at the limit fails here. The others must agree often enough."""
    odd = [np.ascontiguousarray(x[:, SKETCH:]).view(np.uint64) for x in (a, b)]
    good = np.bitwise_count(odd[0] ^ odd[1]).sum(axis=1, dtype=np.int64) * (100 + percent) <= n * (100 - percent)
    at = np.flatnonzero(good)
    good[at] = (a[at, :SKETCH] == b[at, :SKETCH]).sum(axis=1) >= match_threshold(percent, SKETCH)
    return good


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH + ODD // 8)


def pivot_pairs(lists: DataFrame, facts: DataFrame, rank: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b), a < b, and a table they are read from: members with the pivot of their list -- the one of
    most common values, then one by hash -- if they are in two components and
    their sketches agree."""
    weighed = lists.join(facts.select("node", "weight"), "node")
    key = F.struct("weight", "node") if rank == 0 else F.struct(F.xxhash64("node", F.lit(rank)).alias("h"), "node")
    pivots = stage(weighed.groupBy("cv").agg(F.max(key).alias("p")).select("cv", F.col("p.node").alias("b")), "pivots", slim=True)
    pairs = (lists.select("cv", F.col("node").alias("a")).join(pivots, "cv").where("a <> b")
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sides = [facts.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("sketch").alias(f"{s}_sketch"),
                          F.col("component").alias(f"{s}_c")) for s in "ab"]
    small, large = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    near = (pairs.join(sides[0], "a").join(sides[1], "b").where(F.col("a_c") != F.col("b_c")).where(small * 100 >= large * percent)
            .select("a", "b", (F.col("a_n") + F.col("b_n")).alias("n"), "a_sketch", "b_sketch"))

    @frees_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = sharp_enough(_sketches(batch.column("a_sketch")), _sketches(batch.column("b_sketch")), batch.column("n").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))
    return near.mapInArrow(run, "a long, b long"), pivots


def block_pairs(lists: DataFrame, facts: DataFrame, least: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b), a < b, and a table they are read from: all pairs of a list's members that are in two
    components and share enough coordinates, each pair in the list of the
    first coordinate under which both are posted alike. Lists are cut into
    blocks; each pair of blocks is one small group, so no list meets in one
    task."""
    named = lists.join(facts.select("node", "component"), "node")
    block = F.greatest(F.lit(BLOCK), F.least(F.lit(MAX_BLOCK), F.col("size") / BLOCKS))
    sizes = stage(named.groupBy("cv").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"),
                                          F.max("component").alias("high")).where("low <> high")
                  .select("cv", F.ceil(F.col("size") / block).cast("long").alias("blocks")), "open-lists", slim=True)
    # a block meets itself and every other block once: (low, high) with low <= high
    sent = (lists.join(sizes, "cv").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("cv", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node")
            .join(facts.select("node", "n", "component", "posted", "sig", "sketch"), "node"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        col = {c: rows.column(c).to_numpy() for c in ("cv", "low", "high", "own", "node", "n", "component", "posted")}
        sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDS)
        sharp = _sketches(rows.column("sketch").combine_chunks())
        left = np.flatnonzero(col["own"] == col["low"])
        right = np.flatnonzero(col["own"] == col["high"])
        here = int(col["cv"][0] >> 32)
        same = np.zeros((len(left), len(right)), dtype=np.int8)
        before = np.zeros(same.shape, dtype=bool)
        for c in range(COORDS):
            equal = sig[left, c][:, None] == sig[right, c][None, :]
            same += equal
            if c < here:
                posted = (col["posted"] >> c) & 1 == 1
                before |= equal & posted[left][:, None] & posted[right][None, :]
        i, j = np.nonzero((same >= least) & ~before)
        i, j = left[i], right[j]
        if col["low"][0] == col["high"][0]:
            i, j = i[col["node"][i] < col["node"][j]], j[col["node"][i] < col["node"][j]]
        small, large = np.minimum(col["n"][i], col["n"][j]), np.maximum(col["n"][i], col["n"][j])
        good = (col["component"][i] != col["component"][j]) & (small * 100 >= large * percent)
        i, j, both = i[good], j[good], (small + large)[good]
        good = np.concatenate([np.zeros(0, dtype=bool)] + [
            sharp_enough(sharp[i[k:k + 4096]], sharp[j[k:k + 4096]], both[k:k + 4096], percent) for k in range(0, len(i), 4096)])
        a, b = col["node"][i[good]], col["node"][j[good]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return sent.groupBy("cv", "low", "high").applyInArrow(run, "a long, b long"), sizes


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sides = [sets.select(F.col("node").alias(s), F.col("members").alias(f"{s}_set")) for s in "ab"]
    inter = F.size(F.array_intersect("a_set", "b_set"))
    return (pairs.join(sides[0], "a").join(sides[1], "b")
            .where(inter * 100 >= (F.size("a_set") + F.size("b_set") - inter) * percent).select("a", "b"))


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """Rows (id, text_hash, n_shingles, component_id, kept), one per row of
    ``docs``; the id keeps its name.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest id reachable, and the rows with
    that id stay. Texts without words (null, empty, white space) are linked
    with nothing. Equal texts are linked. A null id is larger than any other:
    a component of null ids only has a null component_id and its rows stay.
    Rows that repeat an id are documents of their own; those that share the
    component's smallest id all stay. An empty table gives an empty result.
    """
    least = match_threshold(percent)
    hashed = stage(sign_documents(docs, id_col, text_col), "signed")
    signed = class_keys(hashed)
    classes = stage(signed.where("node IS NOT NULL").select("node", "n", "sig").dropDuplicates(["node"]), "classes", slim=True)
    lists, weights = postings(classes, least)
    wanted = (signed.join(weights.select("node"), "node").groupBy("node").agg(F.min(F.struct("id", "t")).alias("r"))
              .select("node", F.col("r.id").alias("id"), F.col("r.t").alias("t")))
    wanted = stage(wanted, "wanted", slim=True)
    sets = stage(full_sets(docs, wanted, id_col, text_col).dropDuplicates(["node"]), "sets")
    known = stage(weights.join(classes, "node").join(sets.select("node", "sketch"), "node"), "facts", slim=True)
    drop_staged(classes, wanted)

    links, labels, written = None, None, []
    for rank in [*range(PIVOTS), None]:
        if labels is None:
            facts = known.withColumn("component", F.col("node"))
        else:
            facts = known.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        pairs, inner = pivot_pairs(lists, facts, rank, percent) if rank is not None else block_pairs(lists, facts, least, percent)
        pairs = stage(pairs, "pairs", slim=True)
        new = stage(confirmed(pairs, sets, percent), "links", slim=True)
        drop_staged(pairs, inner)
        written.append(new)
        if new.isEmpty():
            continue
        links = new if links is None else links.union(new)
        labels = connected_components(links)

    out = label_rows(signed.select("id", "t", "n", "node"), labels)
    drop_staged(hashed, lists, sets, known, *written)
    return out.select(F.col("id").alias(id_col), F.col("t").alias("text_hash"), F.col("n").alias("n_shingles"), "component_id", "kept")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay, columns as they came."""
    found = near_dups(docs, id_col, text_col, percent)
    gone = stage(found.where("NOT kept").select(F.col(id_col).alias("g_id"), F.col("text_hash").alias("g_t")), "gone", slim=True)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("g_id")) & (F.xxhash64(text_col) == F.col("g_t"))
    name = f"gone_{uuid.uuid4().hex}"
    marked = marked_if_met(docs, F.xxhash64(text_col), gone.select("g_t"), name)
    # texts that surely stay are not shuffled
    return marked.where(~F.col(name)).drop(name).unionByName(marked.where(name).drop(name).join(gone, same, "left_anti"))
