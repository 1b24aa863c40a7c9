"""Sequence packing by cutting-stock column generation.

Documents are cut into full pieces and one remainder. A histogram of piece
lengths is all that reaches the driver. Items are single pieces or, where that
takes fewer sequences, bundles of one length, large enough that rounding up to
a class of CLASS_WIDTH tokens costs little. A linear program over patterns --
sets of classes that fit a sequence -- is solved by column generation: a
knapsack dynamic programme prices new patterns.
Rounded-down pattern counts are dealt to items by their rank in their class;
what rounding leaves over is packed first-fit, largest class first.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, frees_memory, stage, text_slices
from tessera.llm.vocab import WORD_OR_SPACE, load

CAPACITY = 2048
CLASS_WIDTH = 8
SLACK = 0.01        # share of an item, or of a sequence of such items, that rounding may cost
END_ID = 1
MAX_ROUNDS = 20_000
EPS = 1e-9
GAP = 1e-3          # stop at so much above the lower bound
# The faster library's splitter gives up on a white-space run of about a
# million characters; runs of this many are split off before. The class is
# Unicode's White_Space, without the separators 1C-1F that ``re`` adds to \s.
LONG_RUN = 100_000
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_RUN = re.compile(f"(?<!{SPACE}){SPACE}{{{LONG_RUN},}}")


@lru_cache(maxsize=2)
def fast_encoder(vocab_path: str) -> tuple[tiktoken.Encoding, dict[str, int], object]:
    """The vocabulary file's tokens as ranks of the faster library; special
    strings are split off and mapped here."""
    vocab = load(vocab_path)
    ranks = {b: i for i, b in enumerate(vocab.token_bytes) if i not in vocab.specials.values()}
    return tiktoken.Encoding("file", pat_str=WORD_OR_SPACE, mergeable_ranks=ranks, special_tokens={}), vocab.specials, vocab.special_split


def plain_ids(encoding: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text without special strings. Of a long white-space run all
    but its last character are one piece, by the split pattern's own rule; at
    the end of the text the whole run is."""
    if len(text) < LONG_RUN:
        return encoding.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for run in SPACE_RUN.finditer(text):
        stop = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at:run.start()])
        ids += encoding._encode_single_piece(text[run.start():stop])
        at = stop
    return ids + encoding.encode_ordinary(text[at:])


def token_ids(vocab_path: str, text: str) -> np.ndarray:
    """Ids of the whole text as uint32, special strings as their single id."""
    encoding, specials, split = fast_encoder(vocab_path)
    if "<|" not in text:
        return np.array(plain_ids(encoding, text), dtype="<u4")
    ids: list[int] = []
    for part in split.split(text):
        ids += [specials[part]] if part in specials else plain_ids(encoding, part)
    return np.array(ids, dtype="<u4")


def cut_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens and, if
    ``with_ids``, input_ids (little-endian unsigned 32-bit, binary). A
    document's ids end with END_ID, so every row gives at least one piece; a
    null text is an empty one."""
    fields = "start:bigint,length:bigint,ids_crc32:bigint" + (",input_ids:binary" if with_ids else "")
    kinds = [pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    piece = pa.struct(list(zip(["start", "length", "ids_crc32", "input_ids"], kinds)))

    @F.arrow_udf(f"struct<doc_tokens:bigint,pieces:array<struct<{fields}>>>")
    @frees_memory
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts in text_slices(batch):
                totals, pieces = [], []
                for text in texts:
                    ids = np.append(token_ids(vocab_path, text), np.uint32(END_ID)).astype("<u4")
                    totals.append(len(ids))
                    out = []
                    for start in range(0, len(ids), capacity):
                        raw = ids[start:start + capacity].tobytes()
                        out.append({"start": start, "length": len(raw) // 4, "ids_crc32": zlib.crc32(raw)}
                                   | ({"input_ids": raw} if with_ids else {}))
                    pieces.append(out)
                yield pa.StructArray.from_arrays([pa.array(totals, pa.int64()), pa.array(pieces, pa.list_(piece))],
                                                 names=["doc_tokens", "pieces"])
    cut = docs.select(F.col(id_col).alias(id_col), run(F.col(text_col)).alias("cut"))
    return cut.select(id_col, F.col("cut.doc_tokens").alias("doc_tokens"), F.explode("cut.pieces").alias("p")).select(
        id_col, "p.*", "doc_tokens")


def bundle(length: int, capacity: int, width: int) -> int:
    """How many pieces of ``length`` go together: the fewest for which neither
    their class nor a sequence filled with such items loses more than SLACK."""
    fit = capacity // length
    for n in range(1, fit):
        size = -(-n * length // width)
        if size * width <= (1 + SLACK) * n * length and capacity // width // size * n >= (1 - SLACK) * fit:
            return n
    return fit


def bundles(counts: dict[int, int], capacity: int, width: int, together: bool = True) -> tuple[list[tuple[int, int, int, int, int, int]], dict[int, int]]:
    """Rows (length, first_rank, last_rank, per_item, class, first_item): which
    ranks of a length go to which items of a class; and the items per class."""
    out: list[tuple[int, int, int, int, int, int]] = []
    demand: dict[int, int] = defaultdict(int)
    for length, n in sorted(counts.items()):
        per = bundle(length, capacity, width) if together else 1
        for first, stop, k in ((0, n - n % per, per), (n - n % per, n, 1)):
            if stop > first:
                size = -(-k * length // width)
                out.append((length, first, stop - 1, k, size, demand[size]))
                demand[size] += (stop - first) // k
    return out, dict(demand)


Pattern = tuple[tuple[int, int], ...]       # (class, how often), largest class first


def price(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value that fits ``room``: an unbounded knapsack
    by dynamic programming; sizes ascend."""
    best = np.zeros(room + 1)
    pick = np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(sizes, c, side="right")
        if k:
            gain = best[c - sizes[:k]] + values[:k]
            at = int(np.argmax(gain))
            if gain[at] > best[c] + EPS:
                best[c], pick[c] = gain[at], at
    pattern, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[room], pattern


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """A product in this thread: thread pools of linear algebra libraries may
    not survive the start of the JVM beside them."""
    return np.einsum("ij,j->i", matrix, vector)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination, largest pivots first."""
    m = len(matrix)
    work = np.hstack((matrix, np.eye(m)))
    for j in range(m):
        at = j + int(np.argmax(np.abs(work[j:, j])))
        work[[j, at]] = work[[at, j]]
        work[j] /= work[j, j]
        rest = work[:, j].copy()
        rest[j] = 0
        work -= np.multiply.outer(rest, work[j])
    return work[:, m:]


def solve(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in a cheapest fractional cutting
    that meets the demand: the revised simplex method, columns priced on need.

    The demand is raised by small distinct amounts, so that no step has length
    zero and the method cannot run in circles. Every stop is a feasible
    cutting; the last price bounds how far it is from the cheapest."""
    m = len(sizes)
    demand = demand * (1 + 1e-6 * np.random.default_rng(0).random(m)) + 1e-3 * np.random.default_rng(1).random(m)
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / (room // sizes))
    amount = times(inverse, demand)
    bound = float((demand * sizes).sum() / room)            # no cutting fills more than the room
    pool = np.zeros((0, m))
    for step in range(MAX_ROUNDS):
        if amount.sum() <= bound * (1 + GAP):
            break
        duals = inverse.sum(axis=0)
        worth = times(pool, duals)
        if len(pool) and worth.max() > 1 + 5 * GAP:         # a pattern priced before pays again
            column = pool[int(np.argmax(worth))]
        else:
            value, column = price(duals, sizes, room)
            bound = max(bound, amount.sum() / max(value, 1.0))      # duals scaled to be feasible
            if value <= 1 + EPS:
                break
            pool = np.vstack((pool, column))
        direction = times(inverse, column)
        rising = direction > EPS
        ratio = np.full(m, np.inf)
        ratio[rising] = amount[rising] / direction[rising]
        out = int(np.argmin(ratio))
        amount = np.maximum(amount - ratio[out] * direction, 0)
        amount[out] = ratio[out]
        basis[:, out] = column
        pivot = inverse[out] / direction[out]
        inverse -= np.multiply.outer(direction, pivot)
        inverse[out] = pivot
        if step % 200 == 199:                   # keep rounding errors down
            inverse = inverted(basis)
            amount = np.maximum(times(inverse, demand), 0)
    return [(basis[:, j], amount[j]) for j in range(m)]


def plan_patterns(demand: dict[int, int], room: int) -> list[tuple[Pattern, int]]:
    """Whole pattern counts that use up the demand (class -> items) exactly."""
    sizes = np.array(sorted(demand), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([demand[s] for s in sizes.tolist()], dtype=np.int64)
    plans: Counter[Pattern] = Counter()
    for column, amount in solve(sizes, left.astype(float), room):
        use = column.astype(np.int64)
        held = use > 0
        n = min([int(amount + 1e-6), *(left[held] // use[held]).tolist()])
        if n > 0:
            plans[tuple((int(sizes[i]), int(use[i])) for i in np.flatnonzero(use)[::-1])] += n
            left -= use * n
    # the rest: fewer sequences than classes, so this list is short
    open_bins: list[tuple[int, Counter]] = []
    for size, n in zip(sizes[::-1].tolist(), left[::-1].tolist()):
        for _ in range(n):
            for b, (free, held) in enumerate(open_bins):
                if free >= size:
                    held[size] += 1
                    open_bins[b] = (free - size, held)
                    break
            else:
                open_bins.append((room - size, Counter({size: 1})))
    for _, held in open_bins:
        plans[tuple(sorted(held.items(), reverse=True))] += 1
    return sorted(plans.items(), key=lambda p: (p[0], p[1]), reverse=True)


def plan_pieces(counts: dict[int, int], capacity: int, width: int) -> tuple[list[tuple[int, int, int, int, int, int]], list[tuple[Pattern, int]]]:
    """Items and patterns of the better plan: short pieces need bundles, while
    single pieces fill the gaps of mixed lengths better."""
    tries = []
    for together in (True, False):
        items, demand = bundles(counts, capacity, width, together)
        plans = plan_patterns(demand, capacity // width)
        tries.append((sum(n for _, n in plans), items, plans))
    _, items, plans = min(tries, key=lambda t: t[0])
    return items, plans


def slots(plans: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (class, first_rank, last_rank, first_sequence, per_sequence, slot):
    which ranks of a class go to which sequences, and where in them."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, times in plans:
        slot = 0
        for size, per in pattern:
            out.append((size, used[size], used[size] + per * times - 1, sequence, per, slot))
            used[size] += per * times
            slot += per
        sequence += times
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, width: int = CLASS_WIDTH) -> DataFrame:
    """``pieces`` (id, start, length 1..capacity, any other columns) plus
    sequence_id and offset: the pieces of a sequence lie gapless from 0 and
    hold ``capacity`` tokens at most.

    Rows may repeat, have null ids or ties; each row is placed once. An empty
    table gives an empty result. Columns named sequence_id or offset are
    replaced.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    rows = pieces.select(*keep, F.col("length").cast("int").alias("p_length"))
    # at most `capacity` rows reach the driver
    counts = {r.p_length: r["count"] for r in rows.groupBy("p_length").count().collect()}
    dealt_items, plans = plan_pieces(counts, capacity, width)
    # ranks without a window over a whole length: lengths are split into
    # buckets of near `share` rows, ranked inside, shifted by the rows before
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(64, sum(counts.values()) // (4 * tasks))
    n_buckets = spark.createDataFrame([(k, -(-n // share)) for k, n in counts.items()], "p_length int, p_buckets long")
    dealt = stage(rows.join(F.broadcast(n_buckets), "p_length").withColumn("p_row", F.monotonically_increasing_id())
                  .withColumn("p_bucket", F.pmod(F.xxhash64("p_row"), "p_buckets")).drop("p_buckets"), "pieces")
    shift = (dealt.groupBy("p_length", "p_bucket").count()
             .withColumn("p_shift", F.sum("count").over(Window.partitionBy("p_length").orderBy("p_bucket")) - F.col("count"))
             .drop("count"))
    local = F.row_number().over(Window.partitionBy("p_length", "p_bucket").orderBy(id_col, "start", "p_row"))
    ranked = (dealt.withColumn("p_rank", local - 1).join(shift, ["p_length", "p_bucket"])
              .withColumn("p_rank", F.col("p_rank") + F.col("p_shift")).drop("p_shift", "p_bucket"))
    # two rows a length
    items = spark.createDataFrame(dealt_items, "i_length int, i_first long, i_last long, i_per long, i_class int, i_item long")
    inside = F.col("p_rank") - F.col("i_first")
    bundled = (ranked.join(F.broadcast(items), (F.col("p_length") == F.col("i_length"))
                           & F.col("p_rank").between(F.col("i_first"), F.col("i_last")))
               .withColumn("p_item", F.col("i_item") + F.floor(inside / F.col("i_per")))
               .withColumn("p_place", inside % F.col("i_per")))
    # patterns x classes rows: bounded by capacity and width, not by the data
    places = spark.createDataFrame(slots(plans), "s_class int, s_first long, s_last long, s_sequence long, s_per long, s_slot long")
    within = F.col("p_item") - F.col("s_first")
    placed = (bundled.join(F.broadcast(places), (F.col("i_class") == F.col("s_class"))
                           & F.col("p_item").between(F.col("s_first"), F.col("s_last")))
              .withColumn("sequence_id", F.col("s_sequence") + F.floor(within / F.col("s_per")))
              .withColumn("p_slot", F.col("s_slot") + within % F.col("s_per")))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("p_slot", "p_place")) - F.col("length")
    return placed.withColumn("offset", before).select(*keep, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Cut and pack: one row per piece with its ids, place and checksum."""
    cuts = stage(cut_documents(docs, vocab_path, id_col, text_col, capacity, with_ids), "cuts")
    packed = pack(cuts, id_col, capacity)
    drop_staged(cuts)
    return packed


def padding(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens, padding. A sequence is padded to
    ``capacity`` unless its length is a power of two."""
    used = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    whole = F.bit_count("used") == 1
    return used.agg(F.count(F.lit(1)).alias("sequences"), F.sum("used").alias("tokens"),
                    F.sum(F.when(whole, 0).otherwise(capacity - F.col("used"))).alias("padding"))
