import math

import numpy as np

from folioscope.llm import neighbours

SCHEMA = "chunk_ord int, embedding array<float>"


def brute(data, k):
    ids = np.array([i for i, _ in data])
    x = np.array([v for _, v in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    similar = np.round(x @ x.T, 9)
    np.fill_diagonal(similar, -9)
    return {int(i): [int(j) for j in sorted(ids, key=lambda j, r=row: (-r[np.flatnonzero(ids == j)[0]], j)) if j != i][:k] for i, row in zip(ids, similar, strict=True)}


def found(df, **options):
    out = {}
    for r in sorted(neighbours.nearest(df, **options).collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append(r.neighbour)
    return out


def test_recall_over_several_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    data = [(i, (centres[i % 8] + 0.4 * rng.normal(size=16)).tolist()) for i in range(900)]
    got = found(spark.createDataFrame(data, SCHEMA), dimensions=16, cell_vectors=150, most_vectors=300)
    want = brute(data, 5)
    assert set(got) == set(want) and all(len(v) == 5 and i not in v for i, v in got.items())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) > 0.9


def test_recall_over_many_cells_and_passes(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    data = [(i, (centres[i % 20 if i % 3 else 0] + 0.5 * rng.normal(size=16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(data, SCHEMA)
    units = neighbours.cells_of(df.select("chunk_ord", "embedding").selectExpr("cast(chunk_ord as long) as id", "embedding as vector").mapInPandas(neighbours._unit, "id long, unit binary"), 16, 400, 200)
    sizes = [r["count"] for r in units.groupBy("cell").count().collect()]
    assert len(sizes) >= 64 and max(sizes) <= 400
    got = found(df, dimensions=16, cell_vectors=200, most_vectors=400)
    x = np.array([v for _, v in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.argsort(-(x @ x.T), axis=1)[:, 1:6].tolist()
    assert sum(len(set(got[i]) & set(w)) for i, w in enumerate(want)) / (5 * len(want)) >= 0.9


def test_passes_do_not_multiply_the_cells_of_a_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MOST_CENTRES", 8)  # so that several passes are needed
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    units = df.mapInPandas(neighbours._unit, "id long, unit binary").localCheckpoint()
    cells = neighbours.cells_of(units, 16, 400, 200).groupBy("id").count().collect()
    assert len(cells) == 4000 and max(r["count"] for r in cells) <= neighbours.MOST_CELLS


def test_unusable_repeated_and_few_vectors(spark):
    data = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, None), (7, []), (8, [1.0]), (9, [1.0, None]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as id", "'x' as unit")
    assert found(df, dimensions=2) == {1: [2], 2: [1]}
    assert neighbours.nearest(df.where("chunk_ord > 90"), dimensions=2).count() == 0


def test_copies_are_each_others_neighbours_in_order(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8).tolist()
    data = [(i, same) for i in range(200)] + [(i, rng.normal(size=8).tolist()) for i in range(200, 260)]
    got = found(spark.createDataFrame(data, SCHEMA), dimensions=8)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[150] == [0, 1, 2, 3, 4]
    want = brute(data, 5)
    assert sum(got[i] == want[i] for i in range(200, 260)) >= 54


def test_pairs(spark):
    df = spark.createDataFrame([(1, 1, 2, 0.95), (2, 1, 1, 0.95), (1, 2, 3, 0.5)], "id long, rank int, neighbour long, similarity double")
    assert [tuple(r) for r in neighbours.similar_pairs(df).collect()] == [(1, 2)]


def test_pruning_keeps_diverse_edges():
    angles = np.array([0.0, 0.1, 0.11, -0.3])
    vectors = np.stack([np.cos(angles), np.sin(angles)], 1).astype(np.float32)
    edges = neighbours.robust_prune(vectors, np.array([0], np.int32), np.array([[1, 2, 3, 1, -1]], np.int32), 3, 1.2)
    assert edges.tolist() == [[1, 3, -1]]  # 2 is covered by 1
