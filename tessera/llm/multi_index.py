"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are halved; each half has its own codebook, fitted on a bounded
sample. The two nearest codewords of a vector name its cell in the product
grid. Every vector is also a query: a multi-sequence traversal visits cells in
ascending order of the summed distances of their codewords and stops at a
cutoff. The cutoff is set so that, for pairs right at the cosine limit, the
partner's cell is visited with the target recall; closer pairs are found more
surely. Members of visited cells are verified by their cosine.

Vectors of each length have a grid of their own; those of a length with at most
one block of distinct vectors are compared directly.

Cells are cut into blocks, and so are the queries that visit them: a dense
cell is many small matrix products. Such a block returns the number of links
of each query and edges that span its linked vectors, never all pairs. Visits
are not mutual: where a member does not visit its query's cell, the block
counts the link for the member too, so that both ends count each found link.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import class_keys, connected_components, drop_staged, label_rows, stage

SAMPLE = 8192           # vectors the codebooks and the cutoff are fitted on
MAX_CODES = 256         # codewords of a half: 32 sampled vectors each at least
CELL_MEMBERS = 64       # vectors of a cell aimed at, as long as codes suffice
TARGET_RECALL = 0.995
BLOCK = 256
ROUNDS = 10


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square under- or overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codewords; in this thread, for the driver
    fits with it beside a JVM. Summed column by column: a distance has the same
    bits whatever other rows and codewords it is computed with."""
    out = np.zeros((len(x), len(codes)))
    for start in range(0, len(x), BLOCK):
        part = out[start:start + BLOCK]
        for a, b in zip(x[start:start + BLOCK].T, codes.T):
            part += np.square(np.subtract.outer(a, b))
    return out


def codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    codes = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = distances(x, codes).argmin(axis=1)
        count = np.bincount(near, minlength=k)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        codes = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], codes)
    return codes


class Grid:
    """Two codebooks, the columns where halves meet, and the cutoff."""

    def __init__(self, sample: np.ndarray, n_vectors: int, cosine: float):
        rng = np.random.default_rng(0)
        x = unit(sample)
        self.cut = max(x.shape[1] // 2, 1)
        k = int(min(MAX_CODES, len(x), max(1, np.ceil(np.sqrt(n_vectors / CELL_MEMBERS)))))
        self.codes = [codebook(h, k, rng) for h in self.halves(x)]
        self.k = k
        # partners at the limit: a step of the right length in a random direction
        step = rng.normal(size=x.shape)
        step -= (step * x).sum(axis=1, keepdims=True) * x
        length = np.sqrt((step * step).sum(axis=1, keepdims=True))
        partner = cosine * x + np.sqrt(1 - cosine**2) * step / np.maximum(length, 1e-12)
        gaps = self.gaps(x)
        at = [distances(h, c).argmin(axis=1) for h, c in zip(self.halves(partner), self.codes)]
        rows = np.arange(len(x))
        self.cutoff = float(np.quantile(gaps[0][rows, at[0]] + gaps[1][rows, at[1]], TARGET_RECALL)) + 1e-9

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, :self.cut], x[:, self.cut:]]

    def gaps(self, x: np.ndarray) -> list[np.ndarray]:
        """How much farther than the nearest codeword each codeword is."""
        d = [distances(h, c) for h, c in zip(self.halves(x), self.codes)]
        return [a - a.min(axis=1, keepdims=True) for a in d]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.gaps(x)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def visited(self, x: np.ndarray, home: int, cells: np.ndarray) -> np.ndarray:
        """Whether the traversal of each row, all of the cell ``home``, meets
        each of ``cells``: the same sums against the same cutoff."""
        gaps = [distances(h, codes[other]) - distances(h, codes[[own]]) for h, codes, own, other
                in zip(self.halves(x), self.codes, divmod(home, self.k), divmod(cells, self.k))]
        return gaps[0] + gaps[1] <= self.cutoff

    def visits(self, x: np.ndarray) -> list[list[int]]:
        """Cells of each query, nearest first, up to the cutoff."""
        out = []
        gaps = self.gaps(x)
        orders = [g.argsort(axis=1) for g in gaps]
        for q in range(len(x)):
            (a, ia), (b, ib) = ((gaps[h][q][o[q]].tolist(), o[q].tolist()) for h, o in enumerate(orders))
            heap, met, found = [(0.0, 0, 0)], {(0, 0)}, []
            while heap:
                gap, i, j = heappop(heap)
                if gap > self.cutoff:
                    break
                found.append(ia[i] * self.k + ib[j])
                for s, t in ((i + 1, j), (i, j + 1)):
                    if s < len(a) and t < len(b) and (s, t) not in met:
                        met.add((s, t))
                        heappush(heap, (a[s] + b[t], s, t))
            out.append(found)
        return out


def span(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a 0/1 matrix (-1: no link)."""
    n, m = links.shape
    far = n + m
    rows, cols = np.where(links.any(axis=1), np.arange(n), far), np.full(m, far)
    while True:
        new_cols = np.minimum(cols, np.where(links, rows[:, None], far).min(axis=0)) if n else cols
        new_rows = np.minimum(rows, np.where(links, new_cols[None, :], far).min(axis=1)) if m else rows
        if (new_cols == cols).all() and (new_rows == rows).all():
            return np.where(rows == far, -1, rows), np.where(cols == far, -1, cols)
        rows, cols = new_rows, new_cols


def vector_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec, node, check, width): node and check hash a usable vector's
    values, else null."""
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = T.StructType([slim.schema["id"], T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("node", T.LongType()),
                           T.StructField("check", T.LongType()), T.StructField("width", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs = [], []
            for v in batch.column("vec"):
                x = np.array(v.as_py() if v.is_valid else [], dtype=np.float64) + 0.0      # None is nan; -0.0 is 0.0
                good = len(x) > 0 and np.isfinite(x).all() and x.any()
                keys.append((*struct.unpack("<qq", xxhash.xxh3_128_digest(x.tobytes())), len(x)) if good else (None, None, None))
                vecs.append(x if good else None)
            node, check, width = zip(*keys) if keys else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(vecs, pa.list_(pa.float64())), pa.array(node, pa.int64()), pa.array(check, pa.int64()),
                 pa.array(width, pa.int32())], names=["id", "vec", "node", "check", "width"])
    return slim.mapInArrow(run, schema)


def fit(classes: DataFrame, n_vectors: int, cosine: float) -> Grid:
    """On at most SAMPLE vectors, chosen by hash; that is all the driver gets."""
    rows = classes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vec").collect()
    return Grid(np.array([r.vec for r in rows], dtype=np.float64), n_vectors, cosine)


def search(classes: DataFrame, grids: dict[int, Grid], cosine: float) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (a, b, links): links of vector a in one block, or an edge (a, b);
    and the tables they are read from. Vectors of a length without a grid are
    all in one cell of one block."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column("width").to_numpy(zero_copy_only=False)
            for w in np.unique(width).tolist():
                part = batch.filter(pa.array(width == w))
                if w in grids:
                    x = unit(as_matrix(part.column("vec"), w))
                    cells, visits = grids[w].cells(x), grids[w].visits(x)
                else:
                    cells, visits = np.zeros(len(part), dtype=np.int64), [[0]] * len(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("width"), pa.array(cells, pa.int64()), pa.array(visits, pa.list_(pa.int64()))],
                    names=["node", "width", "cell", "visits"])
    placed = stage(classes.select("node", "vec", "width").mapInArrow(place, "node long, width int, cell long, visits array<long>"), "cells")
    visits = placed.select("node", "width", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    gridded = F.col("width").isin(list(grids))
    # at most MAX_CODES ** 2 rows each and grid
    members = placed.where(gridded).groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("m_blocks"))
    queries = visits.where(gridded).groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("q_blocks"))
    sizes = stage(members.join(queries, ["width", "cell"]), "blocks", slim=True)

    def in_blocks(rows: DataFrame) -> DataFrame:
        one = F.lit(1).cast("long")
        met = rows.join(F.broadcast(sizes), ["width", "cell"], "left").where(~gridded | F.col("m_blocks").isNotNull())
        return met.withColumn("m_blocks", F.coalesce("m_blocks", one)).withColumn("q_blocks", F.coalesce("q_blocks", one))
    whole = classes.select("node", "vec", "weight")
    spread = F.xxhash64("node")

    def one_to(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    asked = (in_blocks(visits).withColumn("q", F.pmod(spread, "q_blocks")).withColumn("m", one_to("m_blocks")))
    held = (in_blocks(placed.select("node", "width", "cell")).withColumn("m", F.pmod(spread, "m_blocks")).withColumn("q", one_to("q_blocks")))
    sent = (asked.select("node", "home", "width", "cell", "m", "q", F.lit(True).alias("query"))
            .unionByName(held.select("node", F.col("cell").alias("home"), "width", "cell", "m", "q", F.lit(False).alias("query"))).join(whole, "node"))

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        width = rows.column("width")[0].as_py()
        node, weight = rows.column("node").to_numpy(), rows.column("weight").to_numpy()
        x = unit(as_matrix(rows.column("vec").combine_chunks(), width))
        query, home = rows.column("query").to_numpy(), rows.column("home").to_numpy()
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        near = x[q] @ x[m].T
        i, j = np.nonzero(np.abs(near - cosine) < 1e-12)
        if len(i):
            near[i, j] = sum(v[q[i]] * v[m[j]] for v in x.T)        # the same bits both ways
        links = near >= cosine
        links &= node[q][:, None] != node[m][None, :]
        count = links @ weight[m]
        # links that the member's own traversal does not meet
        cell = rows.column("cell")[0].as_py()
        lone = links & (home[q] != cell)[:, None]
        i, j = np.flatnonzero(lone.any(axis=1)), np.flatnonzero(lone.any(axis=0))
        back = np.zeros(len(m), dtype=count.dtype)
        if len(i):
            cells, at = np.unique(home[q[i]], return_inverse=True)
            met = grids[width].visited(x[m[j]], cell, cells)[:, at]
            back[j] = (lone[np.ix_(i, j)].T & ~met) @ weight[q[i]]
        count = np.concatenate((count, back))
        counted = np.concatenate((node[q], node[m]))
        some = count > 0
        row_label, col_label = span(links)
        # each linked vector hangs on the query that names its component
        ends = np.concatenate((node[q][row_label >= 0], node[m][col_label >= 0]))
        roots = np.concatenate((node[q][row_label[row_label >= 0]], node[q][col_label[col_label >= 0]]))
        real = ends != roots
        n_edges = int(real.sum())
        return pa.table({
            "a": np.concatenate((counted[some], ends[real])),
            "b": pa.array(np.concatenate((np.zeros(int(some.sum()), dtype=np.int64), roots[real])),
                          mask=np.concatenate((np.ones(int(some.sum()), dtype=bool), np.zeros(n_edges, dtype=bool)))),
            "links": np.concatenate((count[some], np.zeros(n_edges, dtype=count.dtype))).astype(np.int64)})
    return sent.groupBy("width", "cell", "m", "q").applyInArrow(verify, "a long, b long, links long"), [placed, sizes]


def near_dup_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one per row of ``vectors``; the
    id keeps its name, other columns are not carried.

    Two vectors are linked when their cosine, in double precision, is at least
    ``cosine``. Vectors that are null, empty or zero, or hold null or
    non-finite values, link with nothing; vectors of different lengths are not
    linked. Equal vectors are linked. Lengths with more than BLOCK distinct
    vectors, each of which is fitted on the driver in turn, should be few.
    n_links counts the other rows linked directly. component_id is the smallest
    id reachable; rows with that id stay. A null id is larger than any other;
    a component of null ids only has a null component_id and all its rows stay.
    Rows that repeat an id are vectors of their own. An empty table gives an
    empty result.
    """
    hashed = stage(vector_rows(vectors, id_col, vec_col), "vectors")
    rows = class_keys(hashed)
    classes = stage(rows.where("node IS NOT NULL").groupBy("node", "width").agg(F.first("vec").alias("vec"), F.count(F.lit(1)).alias("weight")), "classes")
    lengths = classes.groupBy("width").count().where(F.col("count") > BLOCK).orderBy("width").collect()
    grids = {r.width: fit(classes.where(F.col("width") == r.width), r["count"], cosine) for r in lengths}
    links, inner = search(classes, grids, cosine)
    found = stage(links, "found", slim=True)
    drop_staged(*inner)
    edges = found.where("b IS NOT NULL").select("a", "b").distinct()
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    facts = stage(classes.select("node", "weight").join(counts, F.col("node") == F.col("a"), "left")
                  .select(F.col("node").alias("f_node"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")),
                  "facts", slim=True)
    labelled = label_rows(rows.select("id", "node"), connected_components(edges))
    drop_staged(hashed, classes, found)
    return labelled.join(facts, F.col("node") == F.col("f_node"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", "kept")
