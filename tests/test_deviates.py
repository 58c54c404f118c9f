"""The law of the counter-based deviates and of the Monte Carlo made of them."""

import math

import duckdb
import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions import deviates
from strandline.operators import project


def drawn(spark, keys, samples, width=3):
    rows = spark.createDataFrame(keys, "seed long, part int").withColumn("key", deviates.key_words(F.col("seed"), F.col("part"))).withColumn("n", deviates.normals(F.col("key"), samples, width))
    return {(r["seed"], r["part"]): np.array(r["n"]) for r in rows.collect()}


def test_moments_and_correlations_of_a_million_draws(spark):
    found = drawn(spark, [(s, p) for s in range(1000, 1111) for p in (2, 4, 8)], 1001)
    n = np.concatenate(list(found.values()))
    assert n.shape == (333 * 1001, 3)
    x, m = n.ravel(), n.size
    assert abs(x.mean()) < 4 / math.sqrt(m) and abs(x.var() - 1) < 4 * math.sqrt(2 / m)
    assert abs((x**3).mean()) < 4 * math.sqrt(15 / m) and abs((x**4).mean() - 3) < 4 * math.sqrt(96 / m)
    for p, z in ((0.025, -1.959964), (0.16, -0.994458), (0.5, 0.0), (0.84, 0.994458), (0.975, 1.959964)):
        assert abs((x < z).mean() - p) < 4 * math.sqrt(p * (1 - p) / m)
    # Streams of one sample, neighbouring samples, neighbouring seeds and scenarios of one seed are independent.
    bound = 4 / math.sqrt(len(n))
    for a, b in ((n[:, 0], n[:, 1]), (n[:, 0], n[:, 2]), (n[:, 1], n[:, 2]), (n[:-1, 0], n[1:, 0]), (n[:-1, 2], n[1:, 1])):
        assert abs(np.corrcoef(a, b)[0, 1]) < bound and abs(np.corrcoef(a**2, b**2)[0, 1]) < bound
    one = np.stack([found[s, 2][:, 0] for s in range(1000, 1111)])
    assert abs(np.corrcoef(one[:-1].ravel(), one[1:].ravel())[0, 1]) < 4 / math.sqrt(110 * 1001)
    other = np.stack([found[s, 4][:, 0] for s in range(1000, 1111)])
    assert abs(np.corrcoef(one.ravel(), other.ravel())[0, 1]) < 4 / math.sqrt(111 * 1001)
    assert len({tuple(v[0]) for v in found.values()}) == len(found)


def test_uniforms_fill_their_range_evenly(spark):
    rows = spark.range(200).withColumn("key", deviates.key_words(F.col("id"), F.lit(1))).select(deviates.uniforms(F.col("key"), 0, 1, 1000).alias("u")).collect()
    u = np.concatenate([r["u"] for r in rows])
    counts = np.histogram(u, 100, (0, 1))[0]
    chi = ((counts - 2000) ** 2 / 2000).sum()
    assert 0 < u.min() and u.max() < 1 and chi < 99 + 5 * math.sqrt(2 * 99)


def test_duckdb_draws_the_same(spark):
    keys = [(0, 0), (7, 8), (2**40 + 5, 4), (-3, 2), (None, None)]
    got = drawn(spark, keys, 5)
    c = duckdb.connect()
    c.sql("CREATE TABLE k (seed BIGINT, part INT)")
    c.executemany("INSERT INTO k VALUES (?, ?)", keys)
    pair = lambda i, f: f"sqrt(-2 * ln({deviates.duck_uniform(f's * 4 + {i}')})) * {f}(2 * pi() * {deviates.duck_uniform(f's * 4 + {i + 1}')})"
    for seed, part, s, *n in c.sql(f"SELECT seed, part, s, {pair(0, 'cos')}, {pair(0, 'sin')}, {pair(2, 'cos')} FROM {deviates.duck_keys('k', 'seed', 'part')}, range(5) r(s)").fetchall():
        assert np.allclose(got[seed, part][s], n, rtol=0, atol=1e-12)


STATE = "series_id long, latest_date date, latest_distance double, rate double, rate_se double, residual_se double, hist_rslr double, hinterland double, shoreface double, depth double, defence double, rock double, cell long"


def state(spark, **other):
    import datetime

    one = {"series_id": 5, "latest_date": datetime.date(2020, 1, 1), "latest_distance": 100.0, "rate": 0.4, "rate_se": 0.1, "residual_se": 2.0, "hist_rslr": 2.0, "hinterland": 0.05, "shoreface": 0.04, "depth": 10.0, "defence": None, "rock": None, "cell": 1}
    return spark.createDataFrame([tuple((one | other).values())], STATE)


def levels(spark, cells=(1,)):
    rows = [(c, s, p, f"{y}-01-01", c * s * (y - 2000) / 1000 * (1 + (p - 50) / 200)) for c in cells for s in (2, 8) for p in (5, 50, 95) for y in (2030, 2050, 2100)]
    return spark.createDataFrame(rows, "cell long, scenario int, percentile int, day string, level double").select("cell", "scenario", "percentile", F.to_date("day").alias("proj_date"), "level")


def test_without_spread_samples_are_the_projection(spark):
    rsl = levels(spark).drop("cell")
    flat = rsl.withColumn("level", F.first(F.when(F.col("percentile") == 50, F.col("level")), True).over(Window.partitionBy("scenario", "proj_date")))
    got = {(r["scenario"], r["proj_date"]): r["q"] for r in project.monte_carlo(state(spark, rate_se=0.0, residual_se=0.0), flat, ["series_id"]).collect()}
    want = project.bruun(state(spark), flat, ["series_id"]).filter("percentile = 50").collect()
    assert len(got) == len(want) == 6
    for r in want:
        assert np.allclose(got[r["scenario"], r["proj_date"]], r["distance"], rtol=0, atol=1e-9)


def test_quantiles_follow_the_closed_form(spark):
    s = state(spark)
    many = spark.range(400).withColumn("series_id", F.col("id")).drop("id").crossJoin(s.drop("series_id")).select(s.columns)
    rsl = levels(spark).drop("cell")
    found = project.monte_carlo(many, rsl, ["series_id"], 250).filter("scenario = 8").groupBy("proj_date").agg(*(F.avg(F.col("q")[i]).alias(f"q{i}") for i in range(5))).collect()
    # Without limits a position is linear in three normal deviates.
    at = {(r["percentile"], r["proj_date"]): r for r in project.bruun(s, rsl, ["series_id"]).filter("scenario = 8").collect()}
    for r in found:
        middle, high = at[50, r["proj_date"]], at[95, r["proj_date"]]
        years = (r["proj_date"] - middle["latest_date"]).days / project.YEAR
        spread = math.sqrt((0.1 * years) ** 2 + 4 + ((high["distance"] - middle["distance"]) / project.Z95) ** 2)
        for i, z in enumerate((-1.96, -0.9945, 0, 0.9945, 1.96)):
            assert abs(r[f"q{i}"] - (middle["distance"] + z * spread)) < 0.1 * spread


def test_levels_of_places(spark):
    both = state(spark).unionByName(state(spark, series_id=6, cell=2)).unionByName(state(spark, series_id=7, cell=3))
    rsl = levels(spark, (1, 2))
    for run in (lambda d, place: project.bruun(d, rsl if place else rsl.filter("cell = 2").drop("cell"), ["series_id"], place), lambda d, place: project.monte_carlo(d, rsl if place else rsl.filter("cell = 2").drop("cell"), ["series_id"], place=place)):
        by_place = sorted(map(str, run(both, ["cell"]).filter("series_id = 6").collect()))
        assert by_place == sorted(map(str, run(both.filter("series_id = 6"), None).collect())) and by_place
        assert run(both, ["cell"]).filter("series_id = 7").count() == 0


def test_series_without_a_rate_have_no_samples(spark):
    assert project.monte_carlo(state(spark, rate_se=None), levels(spark).drop("cell"), ["series_id"]).count() == 0


def test_deviates_drawn_in_a_task_are_those_of_the_columns(spark):
    keys = [(5, 1), (-7, 2), (1 << 40, 3)]
    rows = spark.createDataFrame(keys, "seed long, part int").select(deviates.key_words(F.col("seed"), F.col("part")).alias("key"))
    for width in (1, 2, 3):
        want = np.array([r["n"] for r in rows.select(deviates.normals(F.col("key"), 50, width).alias("n")).collect()])
        got = deviates.drawn(np.array([r["key"] for r in rows.collect()]), 50, width)
        assert len(got) == width and all(np.allclose(got[i], want[:, :, i], rtol=0, atol=1e-12) for i in range(width))


def test_samples_are_never_columns_of_the_plan(spark):
    found = project.monte_carlo(state(spark, rate_se=0.1, residual_se=0.1), levels(spark).drop("cell"), ["series_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sequence(" not in plan
    missing = project.monte_carlo(state(spark, rate_se=0.1, residual_se=0.1).withColumn("hist_rslr", F.lit(None).cast("double")), levels(spark).drop("cell"), ["series_id"])
    assert {x for r in missing.collect() for x in r["q"]} == {None}
