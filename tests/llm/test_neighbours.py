import numpy as np
import pytest

from goldseam.llm import neighbours, queries
from tests.llm.tables import rows

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, matrix, nearest=10):
    """The nearest (vec_id, score) of every query."""
    found = {}
    for at, i in enumerate(ids):
        if i % 100 == 0:
            score = neighbours.distances(matrix, matrix[at])
            order = sorted((s, v) for s, v in zip(score, ids, strict=True) if v != i)
            found[i] = [(v, s) for s, v in order[:nearest]]
    return found


def lists(df):
    found = {}
    for r in sorted(rows(df), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def test_transform_is_orthogonal():
    turned = neighbours.rotated(np.eye(64), 3)
    assert np.allclose(turned @ turned.T, np.eye(64))
    chosen = neighbours.axes(np.eye(5), 0, 4)
    assert chosen.shape == (5, 4) and chosen.max() < 16


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_against_brute_force(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    given = rows(table)
    matrix = np.array([r["embedding"] for r in given], np.float64)
    truth = brute([r["vec_id"] for r in given], matrix)
    found = lists(queries.registered()["op6_nearest_neighbours"](spark, sf_dir))
    assert found.keys() == truth.keys()
    hits = [len({v for v, _ in found[q]} & {v for v, _ in truth[q]}) for q in truth]
    assert sum(hits) / (10 * len(truth)) >= 0.9
    for q in truth:
        exact = dict(truth[q])
        assert all(score == exact[v] for v, score in found[q] if v in exact)
        assert found[q] == sorted(found[q], key=lambda x: (x[1], x[0])) and len(found[q]) == 10


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    given = [
        (0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1),
        (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [], 1), (None, [1.0, 0.0], 1),
        (8, [1.0, 0.0, 0.0], 1), (100, None, 1), (9, [1e30, 1.0], 1), (200, [1.0, 2.0, 3.0, 4.0], 1),
    ]
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 AS bucket", "2 AS vector")
    found = lists(neighbours.nearest_neighbours(df))
    assert [v for v, _ in found[0]] == [1, 9] and set(found) == {0}


def test_ties_repeated_rows_and_copies(spark):
    given = [(i, [1.0, 2.0, 3.0], 0) for i in range(300)] + [(0, [1.0, 2.0, 3.0], 0)] * 3
    found = lists(neighbours.nearest_neighbours(spark.createDataFrame(given, SCHEMA)))
    assert [v for v, _ in found[0]] == list(range(1, 11))
    assert [v for v, _ in found[100]] == list(range(10))
    assert all(score == 0 for q in found.values() for _, score in q)


def test_very_large_vectors_are_candidates_too(spark):
    given = [(100, [1.0, 0.0]), (1, [1e200, 1e200]), (2, [-1e200, 0.0]), (3, [1.7e308, -1.7e308]), (4, [3.0, 0.0])]
    table = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    (found,) = lists(neighbours.nearest_neighbours(table)).values()
    assert [v for v, _ in found] == [4, 2, 1, 3]
    scores = [s for _, s in found]
    assert scores[:2] == [2.0, 1e200] and scores[2] == pytest.approx(2**0.5 * 1e200) and scores[3] == np.inf


def test_blocks_of_a_hot_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    draw = np.random.default_rng(1)
    matrix = (draw.normal(size=(1000, 8)) * 0.05 + 1).astype(np.float32)
    given = [(i, x.tolist(), 0) for i, x in enumerate(matrix)]
    found = lists(neighbours.nearest_neighbours(spark.createDataFrame(given, SCHEMA)))
    truth = brute(range(1000), matrix.astype(np.float64))
    hits = [len({v for v, _ in found[q]} & {v for v, _ in truth[q]}) for q in truth]
    assert sum(hits) / (10 * len(truth)) >= 0.9


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest_neighbours(df).collect() == []
