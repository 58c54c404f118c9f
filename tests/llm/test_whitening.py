"""Whitening against numpy on all rows, exact sums, hot vectors and edge rows."""

import math
import random

import numpy as np
import pytest

from strandline.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x long, n long, row string"


def made(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, 3, "x") for i, v in enumerate(vectors)], SCHEMA)


def brute(x):
    """(n, deviation, whitened up to signs, explained) of a fit list."""
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    k = min(8, int((e > 1e-12 * e[0]).sum()))
    return n, [sum(int(g) ** 2 for g in n * r.astype(object) - total.astype(object)) for r in x], centred @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def fixed(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors])


def agree(got, x):
    n, deviation, z, explained = brute(x)
    k = z.shape[1]
    got = got.sort_values(["vec_id", "component"])
    assert got.component.tolist() == list(range(1, k + 1)) * n and (got.n == n).all()
    assert got.deviation.tolist() == [d for d in deviation for _ in range(k)]
    w = got.whitened.to_numpy().reshape(n, k)
    assert np.abs(w - z * np.sign((w * z).sum(axis=0))).max() < 1e-7
    assert np.allclose(got.explained.to_numpy().reshape(n, k), explained, rtol=1e-6) and got.identity_error.max() < 1e-6
    assert got.identity_error.nunique() == 1 and np.abs(w.T @ w / n - np.eye(k)).max() < 1e-6


def test_rows_equal_numpy(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(300, 12)) * np.arange(1, 13)).tolist()
    agree(whitening.whitened_components(made(spark, vectors).repartition(7)).toPandas(), fixed(vectors))


def test_copies_count_and_a_hot_vector_is_spread(spark):
    rng = np.random.default_rng(2)
    some = (rng.normal(size=(40, 10)) * np.arange(1, 11)).tolist()
    pick = random.Random(3)
    vectors = [some[0]] * 900 + [pick.choice(some) for _ in range(400)] + (rng.normal(size=(500, 10)) * np.arange(1, 11)).tolist()
    got = whitening.whitened_components(made(spark, vectors))
    agree(got.toPandas(), fixed(vectors))
    once = whitening.whiten(made(spark, vectors), "embedding", weights="one")
    distinct = np.unique(fixed(vectors), axis=0)
    agree_n, first = len(distinct), once.select("n", "identity_error").first()
    assert (once.count(), first["n"]) == (len(vectors), agree_n) and first["identity_error"] < 1e-6
    with pytest.raises(ValueError):
        whitening.whiten(made(spark, vectors), "embedding", weights="none")


def test_deviation_is_exact_or_null(spark):
    vectors = [[2.0**29, 1.0], [-(2.0**29), 2.0], [0.5, 3.0]]
    got = whitening.whitened_components(made(spark, vectors)).toPandas()
    want = brute(fixed(vectors))[1]
    assert [None if math.isnan(d) else int(d) for d in got.sort_values("vec_id").drop_duplicates("vec_id").deviation] == [d if d < 2**63 else None for d in want]
    small = [[2.0**19, 1.0], [-(2.0**19), 2.0], [0.5, 3.0]]
    got = whitening.whitened_components(made(spark, small)).toPandas().sort_values(["vec_id", "component"])
    assert got.drop_duplicates("vec_id").deviation.tolist() == brute(fixed(small))[1]


def test_edges(spark):
    good = [[1.0, 2.0, 4.0], [2.0, 1.0, 0.0], [0.0, 5.0, 1.0], [0.0, 5.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0]]
    got = whitening.whitened_components(made(spark, good + bad)).toPandas()
    agree(got, fixed(good))
    assert set(got.vec_id) == {0, 1, 2, 3}
    assert whitening.whitened_components(made(spark, [[1.0, 2.0]] * 3)).count() == 0
    same = whitening.whiten(made(spark, [[1.0, 2.0]] * 3), "embedding")
    assert same.count() == 3 and same.first()["whitened"] == [] and same.first()["identity_error"] == 0.0
    assert whitening.whitened_components(made(spark, [])).count() == 0 and whitening.whitened_components(made(spark, bad[:2])).count() == 0
    nulls = spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 5.0]), (1, [7.0, 7.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened_components(nulls).filter("vec_id is null").count() == 4


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    agree(queries.op11_whitening(spark, sf).toPandas(), fixed(rows.embedding))
