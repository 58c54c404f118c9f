"""Datum shift against published points; posterior of a line against numpy; slopes of long series."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.reproject import to_lonlat, to_wgs84
from strandline.operators import series as S
from strandline.operators import slopes


def test_published_points_lie_within_five_metres(spark):
    # The worked example of the grid's guide, on its own datum and on WGS84.
    df = spark.createDataFrame([(651409.903, 313177.270)], "x double, y double")
    own = df.select(*to_lonlat(F.col("x"), F.col("y"))).first()
    assert abs(own[1] - (52 + 39 / 60 + 27.2531 / 3600)) < 1e-7 and abs(own[0] - (1 + 43 / 60 + 4.5177 / 3600)) < 1e-7
    lon, lat = df.select(*to_wgs84(F.col("x"), F.col("y"))).first()
    north = (lat - (52 + 39 / 60 + 28.8282 / 3600)) * 111_250
    east = (lon - (1 + 42 / 60 + 57.8663 / 3600)) * 111_320 * math.cos(math.radians(lat))
    assert math.hypot(north, east) < 5


def obs(spark, series):
    rows = [(k, datetime.date(1970, 1, 1) + datetime.timedelta(days=int(d)), float(v), 1.0) for k, own in series.items() for d, v in own]
    return spark.createDataFrame(rows, "s string, obs_date date, value double, error double")


def test_student_points(spark):
    # 97.5 % points of Student's law.
    for freedom, want in ((5, 2.570582), (10, 2.228139), (30, 2.042272), (1000, 1.962339)):
        assert abs(spark.range(1).select(S.student_point(S.Z95_EXACT, F.lit(float(freedom)))).first()[0] - want) < 3e-4


def test_posterior_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    series = {k: [(d, 0.3 * d / 365.25 + rng.normal(0, 2)) for d in sorted(rng.choice(12_000, n, replace=False))] for k, n in (("a", 40), ("b", 3), ("c", 1))}
    got = {r["s"]: r for r in S.bayes_linear(obs(spark, series), ["s"]).collect()}
    for k, own in series.items():
        x, y = np.array([d / 365.25 - 25 for d, _ in own]), np.array([v for _, v in own])
        m = np.stack([x, np.ones(len(x))], axis=1)
        precision = m.T @ m + np.eye(2) / 100
        mean = np.linalg.solve(precision, m.T @ y)
        shape, scale = 2 + len(x) / 2, 1 + (y @ y - mean @ precision @ mean) / 2
        r = got[k]
        assert np.allclose([r["slope"], r["level"], r["noise"]], [*mean, math.sqrt(scale / (shape - 1))], rtol=1e-6)
        assert np.isclose((r["slope_low"] + r["slope_high"]) / 2, mean[0], rtol=1e-6, atol=1e-9)
        draws = mean[0] + rng.standard_t(2 * shape, 400_000) * math.sqrt(scale / shape * np.linalg.inv(precision)[0, 0])
        assert abs(np.mean((draws > r["slope_low"]) & (draws < r["slope_high"])) - 0.95) < 0.003


@pytest.mark.parametrize("kind", ["noise", "ties", "flat", "two dates"])
def test_ranked_slopes_equal_a_sort(kind):
    rng = np.random.default_rng(5)
    n = 700
    x = np.sort(rng.choice(9_000, n, replace=False)).astype(float) if kind != "two dates" else np.repeat([1.0, 9.0], n // 2)
    y = {"noise": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "flat": np.zeros(n), "two dates": rng.integers(0, 9, n).astype(float)}[kind]
    whole = np.sort([(y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n) if x[j] > x[i]])
    ranks = [0, 1, len(whole) // 3, len(whole) // 2, len(whole) // 2 + 1, len(whole) - 1]
    assert slopes.slopes_at(x, y, ranks) == whole[ranks].tolist()
    # The same where nothing but a few thousand slopes is ever held, and brackets are drawn from few pairs.
    assert slopes.slopes_at(x, y, ranks, pairs=5_000, drawn=2_000) == whole[ranks].tolist()
    assert slopes.median_slope(x, y) == slopes.median_slope(x, y, 5_000)


def test_rates_of_one_pass_equal_each_method(spark):
    rng = np.random.default_rng(8)
    series = {k: [(d, rng.integers(0, 40)) for d in sorted(rng.choice(9_000, n, replace=False))] for k, n in (("a", 30), ("b", 3), ("c", 2), ("d", 1))}
    df = obs(spark, series).withColumn("error", F.when((F.col("s") == "b") & (F.col("value") > 20), None).otherwise(F.col("error") + F.col("value") % 3))
    got = {(r["s"], r["method"]): r for r in S.all_rates(df, ["s"]).collect()}
    for name in S.METHODS:
        own = {r["s"]: r for r in S.rates(df, ["s"], name).collect()}
        assert {s for s, m in got if m == name} == set(own)
        for s, r in own.items():
            for column in ("rate", "rate_se", "residual_se"):
                a, b = got[s, name][column], r[column]
                assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-8, atol=1e-9))
