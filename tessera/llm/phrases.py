"""Phrase collocations by a multikey three-way quicksort of suffix pointers.

1. Every word occurrence is a suffix of its piece, cut at the maximum depth.
   Tasks count equal suffixes of each few megabytes first, so that a passage
   that repeats crosses the shuffle with a count.
2. Suffixes are routed by their leading word. A word that leads too many rows
   is routed by its leading two words, then three; rows of one hot suffix are
   dealt out. Passes over the texts count the rows of prefixes for that, a word
   deeper each time and only inside heavy ones. A prefix shorter than its rows'
   route is counted in several shards, whose sums are added; any other prefix is
   whole in one shard.
3. A shard sorts its pointers word by word: partitions are split three ways at a
   random pivot, the equal partition is a phrase, its size is the phrase's
   count, and it goes one word deeper. A partition below the least count holds
   no frequent phrase and is abandoned.
4. Frequent phrases meet the counts of their parts; scores are exact decimals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, filter_bits, first_per_group, in_filter, stage
from tessera.llm.words import array_slices, split_words

DEPTH = 3
SPACE, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
RUN = 2**20             # suffixes counted at once: three word numbers fit in 63 bits
BITS = 21
SHARD_ROWS = 400_000
WORDS = [f"w{i + 1}" for i in range(DEPTH)]


@dataclass
class Suffixes:
    """The distinct suffixes of a run of texts of one group: word numbers by
    depth (-1: the piece has ended), how often each occurs, and the hashes of
    their prefixes by depth. Suffixes are sorted, so equal prefixes adjoin."""

    group: str
    words: pa.Array
    codes: list[np.ndarray]
    n: np.ndarray
    prefix: list[np.ndarray]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes (unsigned 64-bit, wrapping)."""
    x = (a ^ (b + np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(6)) + (a >> np.uint64(2)))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def suffixes_of(group: str, texts: pa.Array) -> Iterator[Suffixes]:
    found = split_words(texts, SPACE, BREAKS, lower=True)
    for start in range(0, len(found.piece), RUN):
        codes, words = found.codes(start, min(start + RUN + DEPTH - 1, len(found.piece)))
        piece = found.piece[start:start + len(codes)]
        size = min(RUN, len(found.piece) - start)
        key = codes[:size].copy()
        for d in range(1, DEPTH):
            nxt = np.zeros(size, dtype=np.int64)            # 0: the piece has ended
            held = min(size, max(len(codes) - d, 0))
            nxt[:held] = np.where(piece[d:d + held] == piece[:held], codes[d:d + held] + 1, 0)
            key = key << BITS | nxt
        key, n = np.unique(key, return_counts=True)
        split = [key >> BITS * (DEPTH - 1), *[((key >> BITS * (DEPTH - 1 - d)) & (2**BITS - 1)) - 1 for d in range(1, DEPTH)]]
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()] + [1], dtype=np.uint64)
        prefix = [mixed(np.full(len(key), xxhash.xxh3_64_intdigest(group), dtype=np.uint64), hashes[split[0]])]
        for code in split[1:]:
            prefix.append(mixed(prefix[-1], hashes[code]))
        yield Suffixes(group, words, split, n.astype(np.int64), prefix)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Suffixes]:
    for batch in batches:
        groups = batch.column("grp").dictionary_encode()
        at = groups.indices.to_numpy()
        for i, group in enumerate(groups.dictionary.to_pylist()):
            for _, texts in array_slices(batch.column("text").filter(pa.array(at == i))):
                yield from suffixes_of(group, texts)


def routes(s: Suffixes, heavy: list[np.ndarray]) -> np.ndarray:
    """How many leading words name the shard of each suffix: one more than the
    depths at which its prefix is heavy (DEPTH + 1: its rows are dealt out)."""
    route, inside = np.ones(len(s.n), dtype=np.int32), np.ones(len(s.n), dtype=bool)
    for prefix, bits in zip(s.prefix, heavy):
        inside &= in_filter(prefix, bits)
        route += inside
    return route


def prefix_rows(docs: DataFrame, heavy: list[np.ndarray]) -> DataFrame:
    """Rows (grp, h, n_rows, n_words): in one run, the suffixes of each prefix one
    word deeper than ``heavy`` goes, and the occurrences behind them; only
    prefixes inside heavy ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _runs(batches):
            deep = routes(s, heavy) > len(heavy)
            h, n = s.prefix[len(heavy)][deep], s.n[deep]
            if len(h):
                first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.group] * len(first), pa.string()), pa.array(h[first].view(np.int64)),
                     pa.array(np.diff(np.append(first, len(h)))), pa.array(np.add.reduceat(n, first))], names=["grp", "h", "n_rows", "n_words"])
    return docs.mapInArrow(run, "grp string, h long, n_rows long, n_words long")


def routed(docs: DataFrame, n_shards: int, heavy: list[np.ndarray]) -> DataFrame:
    """Rows (shard, route, grp, w1, tails): the suffixes that begin with w1, one a
    line in tails: the words that follow and the number of occurrences."""
    schema = pa.schema([("shard", pa.int64()), ("route", pa.int32()), ("grp", pa.string()), ("w1", pa.string()), ("tails", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _runs(batches):
            route = routes(s, heavy)
            part = np.full(len(s.n), xxhash.xxh3_64_intdigest(s.n.tobytes() + s.prefix[-1].tobytes()), dtype=np.uint64)
            named = np.choose(route - 1, [*s.prefix, mixed(s.prefix[-1], part)])
            shard = (named % np.uint64(n_shards)).astype(np.int64)
            order = np.lexsort((route, shard, s.codes[0]))
            shard, route, first = shard[order], route[order], s.codes[0][order]
            new = np.concatenate(([True], (shard[1:] != shard[:-1]) | (route[1:] != route[:-1]) | (first[1:] != first[:-1])))
            at = np.flatnonzero(new)
            tail = [s.words.take(pa.array(c[order], mask=c[order] < 0)) for c in s.codes[1:]]
            lines = pc.binary_join_element_wise(*tail, pa.array(s.n[order]).cast(s.words.type), pa.scalar(" ", s.words.type), null_handling="skip")
            tails = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), lines), "\n")
            yield pa.RecordBatch.from_arrays([pa.array(shard[at]), pa.array(route[at]), pa.array([s.group] * len(at), pa.string()),
                                              s.words.take(pa.array(first[at])), tails], schema=schema)
    return docs.mapInArrow(run, "shard long, route int, grp string, w1 string, tails string")


def multikey_sort(keys: list[np.ndarray], weight: np.ndarray, route: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per depth d = 1.. the equal partitions of the first d keys as (one
    pointer each, sum of weights). keys[0] is the group, -1 the end of a suffix.

    All partitions of a depth are split at once: an array of pointers, partition
    after partition, and an array of their sizes. A partition is abandoned when
    it weighs less than ``least`` and no row of it is routed deeper.
    """
    rng = np.random.default_rng(0)

    def worth(pointers: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The partitions not abandoned, and their weights."""
        if not len(sizes):
            return pointers, sizes, np.zeros(0, dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        total = np.add.reduceat(weight[pointers], starts)
        keep = (total >= least) | (np.maximum.reduceat(route[pointers], starts) > depth)
        return pointers[np.repeat(keep, sizes)], sizes[keep], total[keep]

    pointers = np.arange(len(weight))
    sizes = np.array([len(weight)] if len(weight) else [], dtype=np.int64)
    out = []
    for depth, key in enumerate(keys):
        live = key[pointers] >= 0
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[live], minlength=len(sizes))
        pointers, sizes = pointers[live], sizes[sizes > 0]
        equal_p, equal_n, equal_w = [], [], []
        while len(sizes):
            starts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            here = key[pointers]
            pivot = here[starts + (rng.random(len(sizes)) * sizes).astype(np.int64)][owner]
            low, high = here < pivot, here > pivot
            same = ~(low | high)
            done = worth(pointers[same], np.bincount(owner[same], minlength=len(sizes)), depth)
            for held, new in zip((equal_p, equal_n, equal_w), done):
                held.append(new)
            halves = [(pointers[side], np.bincount(owner[side], minlength=len(sizes))) for side in (low, high)]
            sizes = np.concatenate([n for _, n in halves])
            pointers, sizes, _ = worth(np.concatenate([p for p, _ in halves]), sizes[sizes > 0], depth)
        if not equal_n:
            break
        pointers, sizes, total = (np.concatenate(x) for x in (equal_p, equal_n, equal_w))
        if depth:
            out.append((pointers[np.cumsum(sizes) - sizes], total))
    return out


def shard_phrases(rows: DataFrame, least: int) -> DataFrame:
    """Rows (grp, w1, w2, w3, depth, n) of the phrases found in the shards."""
    schema = pa.schema([("grp", pa.string()), *[(w, pa.string()) for w in WORDS], ("depth", pa.int32()), ("n", pa.int64())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        found = split_words(rows.column("tails").combine_chunks(), b" ", b"\n")
        ends = np.append(np.flatnonzero(np.diff(found.piece)), len(found.piece) - 1)        # the last word of each line
        size = np.diff(ends, prepend=-1)
        owner = found.text[ends]
        leading = rows.column("w1").combine_chunks()
        words = pa.concat_arrays([leading, found.words]).dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        tail = codes[len(leading):]
        columns = [codes[:len(leading)][owner]]
        columns += [np.where(size > d, tail[np.minimum(ends - size + d, len(tail) - 1)], -1) for d in range(1, DEPTH)]
        group = rows.column("grp").combine_chunks().dictionary_encode()
        grp = group.indices.to_numpy().astype(np.int64)[owner]
        n = found.words.take(pa.array(ends)).cast(pa.int64()).to_numpy()
        tables = [schema.empty_table()]
        for d, (at, total) in enumerate(multikey_sort([grp, *columns], n, rows.column("route").to_numpy()[owner], least)):
            held = [words.dictionary.take(pa.array(c[at])) for c in columns[:d + 1]]
            tables.append(pa.table([group.dictionary.take(pa.array(grp[at])), *held, *[pa.nulls(len(at), pa.string())] * (DEPTH - 1 - d),
                                    pa.array(np.full(len(at), d + 1, dtype=np.int32)), pa.array(total)], schema=schema))
        return pa.concat_tables(tables).combine_chunks()
    return rows.groupBy("shard").applyInArrow(run, f"grp string, {', '.join(w + ' string' for w in WORDS)}, depth int, n long")


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows (grp, w1, w2, w3, depth, phrase, f) of all phrases of 1 to DEPTH
    words that occur at least ``least`` times in the texts of ``docs`` (grp,
    text); and rows (t_grp, total), the words of each group."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy: list[np.ndarray] = []
    for depth in range(DEPTH):
        counted = stage(prefix_rows(docs, heavy), "prefixes")
        if not depth:
            totals = stage(counted.groupBy("grp").agg(F.sum("n_words").alias("total")).select(F.col("grp").alias("t_grp"), "total"), "totals", slim=True)
            size = counted.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]
            n_shards = max(2 * tasks, -(-size // SHARD_ROWS))
            share = max(size // (4 * n_shards), 1000)
        over = counted.groupBy("h").agg(F.sum("n_rows").alias("n_rows")).where(F.col("n_rows") > share).select("h")
        heavy.append(filter_bits(over))
        drop_staged(counted)
        if not heavy[-1].any():
            break
    shards = shard_phrases(routed(docs, n_shards, heavy), least)
    phrases = (shards.groupBy("grp", *WORDS, "depth").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
               .withColumn("phrase", F.concat_ws(" ", *WORDS)))
    return stage(phrases, "phrases", slim=True), totals


def exact_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)) in decimals of 38 digits."""
    a, l, r = (x.cast("decimal(19,0)") for x in (a, l, r))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), l * r)


def collocations(docs: DataFrame, group_col: str = "lang", text_col: str = "text", least: int = 10, covered_percent: int = 50,
                 top: int = 2000, no_group: str = "und") -> DataFrame:
    """Rows (grp, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to
    3 words of each group.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces,
    and those at blanks and tabs into words. n counts the words of the group.
    Candidates occur at least ``least`` times (a). A cut after the first k words
    scores floor(1000000 * a * a / (l * r)), l and r being the occurrences of
    the two parts; the lowest score counts, ties to the smallest k. A candidate
    that lies inside a longer one with at least ``covered_percent`` of its
    occurrences is left out. Order: score, a (both descending), phrase in UTF-8
    byte order. A null group is ``no_group``, a null text empty; repeated rows
    count each, ids play no part, other columns are not carried, and a table
    without candidates gives no rows. Texts of any length are read whole.
    """
    slim = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(no_group)).alias("grp"), F.col(text_col).alias("text"))
    phrases, totals = frequent_phrases(slim, least)

    def words(i: int, j: int) -> Column:
        return F.concat_ws(" ", *WORDS[i:j])

    def part(k: int, left: bool, text: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(left).alias("left"), text.alias("part"))

    cuts = {d: [part(k, left, words(0, k) if left else words(k, d)) for k in range(1, d) for left in (True, False)] for d in range(2, DEPTH + 1)}
    parts = (phrases.where("depth > 1")
             .select("grp", "phrase", "depth", F.col("f").alias("a"),
                     F.explode(F.when(F.col("depth") == 2, F.array(*cuts[2])).otherwise(F.array(*cuts[3]))).alias("p"))
             .select("grp", "phrase", "depth", "a", "p.*"))
    known = phrases.select(F.col("grp").alias("k_grp"), F.col("phrase").alias("k_phrase"), F.col("f"))
    met = stage(parts.join(known, (F.col("grp") == F.col("k_grp")) & (F.col("part") == F.col("k_phrase")))
                .select("grp", "phrase", "depth", "a", "k", "left", "part", "f"), "parts")

    def count(k: int, left: bool) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("f"))).alias(f"{'l' if left else 'r'}{k}")

    scored = met.groupBy("grp", "phrase", "depth", "a").agg(*[count(k, left) for k in (1, 2) for left in (True, False)])
    one, two = exact_score(F.col("a"), F.col("l1"), F.col("r1")), exact_score(F.col("a"), F.col("l2"), F.col("r2"))
    scored = scored.withColumn("s1", one).withColumn("s2", two).withColumn("second", F.coalesce(F.col("s2") < F.col("s1"), F.lit(False)))
    scored = scored.select("grp", "phrase", "a", *[F.when(F.col("second"), F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(n)
                                                   for c, n in (("l", "l"), ("r", "r"), ("s", "score"))])
    # the parts of two words of a phrase of three, with the counts of both
    inside = met.where((F.col("depth") == 3) & (F.when(F.col("left"), F.col("k")).otherwise(3 - F.col("k")) == 2)
                       & (100 * F.col("a") >= covered_percent * F.col("f")))
    covered = inside.select(F.col("grp").alias("c_grp"), F.col("part").alias("c_phrase")).distinct()
    left = scored.join(covered, (F.col("grp") == F.col("c_grp")) & (F.col("phrase") == F.col("c_phrase")), "left_anti")
    ranked = first_per_group(left, ["grp"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank", F.xxhash64("phrase"))
    return ranked.join(totals, F.col("grp") == F.col("t_grp")).select(
        "grp", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
