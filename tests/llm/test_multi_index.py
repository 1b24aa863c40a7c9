"""Near-duplicate vectors against brute force."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import multi_index, queries
from tessera.llm.common import class_keys

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType())])


def brute(data, cosine=0.95):
    """{row number: (linked row numbers)} and components by smallest id."""
    good = [v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float)) for _, v in data]
    links = np.zeros((len(data), len(data)), dtype=bool)
    for width in {len(v) for (_, v), g in zip(data, good) if g}:
        at = np.array([i for i, ((_, v), g) in enumerate(zip(data, good)) if g and len(v) == width])
        x = np.array([data[i][1] for i in at], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        links[np.ix_(at, at)] = x @ x.T >= cosine - 1e-12
    np.fill_diagonal(links, False)
    root = list(range(len(data)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in zip(*np.nonzero(links)):
        root[find(a)] = find(b)
    low = {}
    for i, (vec, _) in enumerate(data):
        low[find(i)] = min((v for v in (low.get(find(i)), vec) if v is not None), default=None)
    return sorted(((vec, int(links[i].sum()), low[find(i)], vec == low[find(i)]) for i, (vec, _) in enumerate(data)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def vectors():
    rng = np.random.default_rng(4)
    out = [rng.normal(size=8) for _ in range(300)]
    for base in out[:20]:
        out += [base + rng.normal(size=8) * 0.01 for _ in range(3)] + [base * 2, base]
    dense = rng.normal(size=8)
    out += [dense + rng.normal(size=8) * 0.05 for _ in range(400)]
    data = [(i, [float(np.float32(z)) for z in v]) for i, v in enumerate(out)]
    same = [1.0] + [0.0] * 7
    data += [(None, same), (9000, same), (9000, same), (9001, [-0.0, *same[1:]]), (9002, None), (9003, []), (9004, [0.0] * 8),
             (9005, [float("nan")] * 8), (9006, [None] + same[1:]), (9007, [float("inf")] + same[1:]), (9008, [1.0, 2.0]), (9009, [1.0, 2.0]),
             (9010, [2.0, 4.0]), (9011, [1.0, 2.0, 0.0]), (9012, [1.0]), (9013, [3.0]), (9014, [-3.0]),
             (None, [0.0] * 7 + [1.0])]
    return data


def frame(spark, data):
    return spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)


def test_all_links_and_odd_vectors(spark):
    data = vectors()
    got = result(multi_index.near_dup_vectors(frame(spark, data).withColumn("n_links", F.lit("clash"))))
    want = brute(data)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, real = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))           # no link below the limit
    assert found >= 0.98 * real
    assert np.mean([g[2:] == w[2:] for g, w in zip(got, want)]) >= 0.98


def test_small_blocks_and_whole_grid(spark, monkeypatch):
    """With every cell visited nothing is missed, however cells are cut."""
    monkeypatch.setattr(multi_index, "BLOCK", 16)
    monkeypatch.setattr(multi_index, "TARGET_RECALL", 1.0)
    fit = multi_index.fit

    def all_cells(*args):
        grid = fit(*args)
        grid.cutoff = 1e9
        return grid
    monkeypatch.setattr(multi_index, "fit", all_cells)
    data = vectors()
    assert result(multi_index.near_dup_vectors(frame(spark, data))) == brute(data)


def test_both_ends_count_a_found_link(spark, monkeypatch):
    """Lone pairs at the limit over many codes, one end repeated in every
    second pair: found or not, both ends say the same."""
    monkeypatch.setattr(multi_index, "CELL_MEMBERS", 4)
    monkeypatch.setattr(multi_index, "TARGET_RECALL", 0.8)
    rng = np.random.default_rng(6)
    data = []
    for i in range(600):
        a, step = rng.normal(size=(2, 32))
        a /= np.linalg.norm(a)
        step -= (step @ a) * a
        b = 0.951 * a + np.sqrt(1 - 0.951**2) * step / np.linalg.norm(step)
        data += [(2 * i, a.tolist())] * (1 + i % 2) + [(2 * i + 1, b.tolist())]
    got = {r.vec_id: r for r in multi_index.near_dup_vectors(frame(spark, data)).collect()}
    found = [got[2 * i + 1].component_id == 2 * i for i in range(600)]
    assert 0.5 < np.mean(found) < 1
    for i, linked in enumerate(found):
        assert (got[2 * i].n_links, got[2 * i + 1].n_links) == (i % 2 + linked, (1 + i % 2) * linked)


def test_several_lengths_with_grids(spark):
    """Two lengths of many vectors, thousands of lengths of one pair each."""
    rng = np.random.default_rng(9)
    data = []
    for width in (6, 24):
        base = rng.normal(size=(500, width))
        for v in (*base, *(base[:200] * 3), *(base[:100] + rng.normal(size=(100, width)) * 1e-3)):
            data.append((len(data), v.tolist()))
    for width in range(40, 90):
        v = rng.normal(size=width)
        data += [(len(data), v.tolist()), (len(data) + 1, (2 * v).tolist())]
    got, want = result(multi_index.near_dup_vectors(frame(spark, data))), brute(data)
    assert [g[0] for g in got] == [w[0] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    short = {i for i, v in data if len(v) >= 40}
    assert [g for g in got if g[0] in short] == [w for w in want if w[0] in short]


def test_class_keys_part_equal_hashes(spark):
    rows = [(1, 5, 7), (2, 5, 7), (3, 5, 8), (4, 5, 9), (5, 5, 9), (6, 6, 7), (7, None, None)]
    got = {r.id: r.node for r in class_keys(spark.createDataFrame(rows, "id int, node long, check long")).collect()}
    assert got[1] == got[2] == 5 and got[4] == got[5] and got[6] == 6 and got[7] is None
    assert len({got[1], got[3], got[4]}) == 3
    same = class_keys(spark.createDataFrame(rows[:2], "id int, node long, check long")).collect()
    assert [r.node for r in same] == [5, 5]


def test_empty_and_unusable_tables(spark):
    assert multi_index.near_dup_vectors(frame(spark, [])).collect() == []
    data = [(1, None), (2, [0.0] * 8)]
    assert result(multi_index.near_dup_vectors(frame(spark, data))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_op4_recall_on_near_copies(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.vec_id: r.n_links for r in queries.op4_multi_index(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {r.vec_id: int(n) - 1 for r, n in zip(rows, np.einsum("ij,kj->ik", x, x).__ge__(0.95).sum(axis=1))}
    assert got.keys() == want.keys() and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.95 * sum(want.values())
