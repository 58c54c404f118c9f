"""Raster stacks, rock head, bands, as-of joins and layers in files, against plain walks."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import project as J
from strandline.operators import raster as A
from strandline.operators import runs as U
from strandline.operators import series as S
from strandline.sources import files, rasters


def test_a_stack_is_read_by_name_and_replaced_by_name(spark, tmp_path):
    cells = spark.createDataFrame([(s, y, r, c, float(s * y + r + c)) for s in (2, 8) for y in (2030, 2050) for r in range(3) for c in range(4)], "scenario int, proj_year int, row_ix long, col_ix long, level double")
    path = str(tmp_path / "stack")
    rasters.write_stack(cells, path, ["scenario", "proj_year"])
    rasters.write_stack(cells.filter("scenario = 8 and proj_year = 2050").withColumn("level", F.lit(1.0)), path, ["scenario", "proj_year"])
    got = rasters.read_stack(spark, path, scenario=[8], proj_year=[2050])
    assert got.count() == 12 and got.agg(F.sum("level")).first()[0] == 12.0
    assert "PartitionFilters: [scenario" in got._jdf.queryExecution().toString().replace("isnotnull(scenario#", "scenario#").replace("(scenario", "scenario")
    assert rasters.read_stack(spark, path).count() == 48
    points = spark.createDataFrame([(1, 5.0, 25.0), (2, 35.0, 5.0), (3, 400.0, 5.0)], "k int, x double, y double")
    levels = {r["k"]: r["levels"] for r in A.sample_stack(points, rasters.read_stack(spark, path), ["k"], ["scenario", "proj_year"], "level", 0.0, 30.0, 10.0).collect()}
    assert set(levels) == {1, 2} and [v["level"] for v in levels[1]] == [4060.0, 4100.0, 16240.0, 1.0] and [(v["scenario"], v["proj_year"]) for v in levels[2]] == [(2, 2030), (2, 2050), (8, 2030), (8, 2050)]


def walk(t, low, n=50):
    """The distance of the first low cell along a transect, by two plain searches."""
    x0, y0, x1, y1 = t
    at = lambda p: (math.floor((x0 + p * (x1 - x0)) / 10), math.floor((200 - (y0 + p * (y1 - y0))) / 10))
    hit = next((k for k in range(n) if at(k / (n - 1)) in low), None)
    if hit is None or hit == n - 1:
        return None
    length = math.hypot(x1 - x0, y1 - y0)
    a, b = max(hit - 1, 0) / (n - 1), (hit + 1) / (n - 1)
    m = max(math.floor((b - a) * length), 2)
    fine = next((k for k in range(m) if at(a + (b - a) * k / (m - 1)) in low), None)
    return None if fine is None else length * (a + (b - a) * fine / (m - 1))


def test_rock_is_found_as_by_a_plain_walk(spark):
    rng = random.Random(6)
    value = {(c, r): rng.choice([-1.0, 0.0, 0.39, 0.4, 0.9, 2.0, 3.0, 4.0, 5.0, 9.0, 9.5]) for c in range(20) for r in range(20) if rng.random() < 0.8}
    low = {k for k, v in value.items() if 0 <= v < 0.4}
    ways = {i: tuple(rng.uniform(2, 198) for _ in range(4)) for i in range(80)}
    ways[80] = (5.0, 5.0, 5.0, 5.0)
    t = spark.createDataFrame([(i, *w) for i, w in ways.items()], "k int, start_x double, start_y double, end_x double, end_y double")
    cells = spark.createDataFrame([(c, r, v) for (c, r), v in value.items()], "col_ix long, row_ix long, v double")
    got = {r["k"]: r["distance"] for r in A.first_below(t, cells, ["k"], 0.4, 0.0, 200.0, 10.0).collect()}
    want = {i: d for i, w in ways.items() if (d := walk(w, low)) is not None}
    assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want) and 20 < len(want) < 81


def test_as_of_equals_a_search(spark):
    rng = random.Random(2)
    day = lambda n: datetime.date(2000, 1, 1) + datetime.timedelta(days=n)
    left = [(s, day(rng.randint(0, 30)), float(i)) for s in range(5) for i in range(4)]
    right = [(s, day(d), float(d)) for s in range(4) for d in rng.sample(range(0, 30, 2), 5)]
    schema = "s int, obs_date date, value double"
    got = {(r["s"], r["obs_date"], r["value"]): (r["at_date"], r["at_value"]) for r in S.as_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["s"]).collect()}
    for s, d, v in left:
        own = sorted((e, w) for t, e, w in right if t == s)
        want = next((o for o in reversed(own) if o[0] <= d), own[0] if own else (None, None))
        assert got[s, d, v] == want
    assert {r["s"] for r in S.offset_of(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["s"]).collect()} == {0, 1, 2, 3}


def test_bands_taper_to_nothing_at_their_ends(spark):
    rows = [(1, i, 10.0 + i, 10.0 + i, float(i), None if i in (0, 4, 6) else 8.0 + i, float(i), None if i in (0, 4, 6) else 15.0 + i, float(i), 8.0 + i, 15.0 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "line int, seq int, recent double, recent_x double, recent_y double, low_x double, low_y double, high_x double, high_y double, low double, high double")
    got = [(r["seq"], r["part"], r["low_x"], r["high_x"]) for r in U.boundary_lines(df, ["line"], "seq").orderBy("seq", "part").collect()]
    # Erosion only: the lower line stays at the recent position; transects 5 and 7 stand alone.
    assert got == [(1, 0, 10.0, 10.0), (1, 1, 11.0, 16.0), (2, 1, 12.0, 17.0), (3, 1, 13.0, 18.0), (3, 2, 14.0, 14.0)]
    both = [(r["seq"], r["part"], r["low_x"]) for r in U.boundary_lines(df, ["line"], "seq", False).filter("part = 1").orderBy("seq").collect()]
    assert both == [(1, 1, 9.0), (2, 1, 10.0), (3, 1, 11.0)]
    ends = spark.createDataFrame([(*r[:5], 1.0, r[6], 99.0, *r[8:]) for r in rows], df.schema)
    assert [(r["seq"], r["low_x"]) for r in U.boundary_lines(ends, ["line"], "seq").filter("part <> 1").orderBy("part").collect()] == [(0, 10.0), (7, 17.0)]


def test_sampled_levels_equal_levels_by_place(spark):
    state = spark.createDataFrame([(i, datetime.date(2020, 1, 1), 50.0, 0.3, 1.5, 0.05, 0.02, 10.0, None, None) for i in range(3)], "series_id long, latest_date date, latest_distance double, rate double, hist_rslr double, hinterland double, shoreface double, depth double, defence double, rock double")
    rows = [(i, s, p, datetime.date(y, 1, 1), i + s * p * (y - 2000) / 1e4) for i in (0, 1) for s in (2, 8) for p in (5, 95) for y in (2050, 2030, 2100)]
    long = spark.createDataFrame(rows, "series_id long, scenario int, percentile int, proj_date date, level double")
    packed = long.groupBy("series_id").agg(F.collect_list(F.struct("scenario", "percentile", "proj_date", "level")).alias("levels"))
    a = sorted(map(str, J.projected(J.with_sampled_levels(state, packed, ["series_id"]), ["series_id"]).collect()))
    assert a == sorted(map(str, J.bruun(state, long, ["series_id"], ["series_id"]).collect())) and len(a) == 24


def test_layers_keep_their_names(spark, tmp_path):
    nodes = spark.createDataFrame([(n, k, i, float(i), float(k)) for n in ("MHWS_1900", "a b.c") for k in range(3) for i in range(4)], "layer string, line_id long, seq int, x double, y double")
    files.write_layers(nodes, "layer", ["line_id"], f"file://{tmp_path}/layers")
    assert sorted(p.name for p in (tmp_path / "layers").glob("[!.]*")) == ["MHWS_1900.geojson", "a b.c.geojson"]
    back = files.read_layers(spark, f"file://{tmp_path}/layers").withColumn("name", files.base_name(F.col("source")))
    assert {(r["name"], int(r["properties"]["line_id"]), r["seq"], r["x"], r["y"]) for r in back.collect()} == {(n, k, i, float(i), float(k)) for n in ("MHWS_1900", "a b.c") for k in range(3) for i in range(4)}


def test_forms_by_the_ending_of_a_path(spark, tmp_path):
    rows = spark.createDataFrame([(1, [("2000-01-01", 1.5), ("2001-01-01", None)])], "k int, p array<struct<d: string, v: double>>")
    assert [tuple(r) for r in files.write_as_named(rows, f"{tmp_path}/a.csv", "p").collect()] == [(1, "2000-01-01", 1.5), (1, "2001-01-01", None)]
    for form in ("json", "parquet"):
        assert files.write_as_named(rows, f"{tmp_path}/a.{form}", "p").collect() == rows.collect()
    with pytest.raises(ValueError):
        files.write_as_named(rows, f"{tmp_path}/a.shp", "p")


@pytest.mark.parametrize("g", [1.0, 7.0, 40.0, 500.0])
def test_points_in_polygons_equal_all_edges(spark, g):
    from strandline.operators import spatial as P

    rng = random.Random(int(g))
    rings = {0: [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)], 1: [(50.0, 0.0), (100.0, 0.0), (100.0, 50.0), (50.0, 50.0)]}
    for k in range(2, 6):
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(12))
        rings[k] = [(50 + rng.uniform(5, 60) * math.cos(t), 40 + rng.uniform(5, 60) * math.sin(t)) for t in turns]
    edges = [(k, *a, *b) for k, r in rings.items() for a, b in zip(r, r[1:] + r[:1])]
    points = [(i, rng.choice([rng.uniform(-30, 130), float(rng.randint(-3, 12) * 10)]), rng.choice([rng.uniform(-30, 120), float(rng.randint(-3, 12) * 10)])) for i in range(400)]

    def inside(x, y, ring):
        return sum((y1 <= y) != (y2 <= y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]) if y1 != y2) % 2 == 1

    got = {tuple(r) for r in P.in_polygon(spark.createDataFrame(points, "i int, x double, y double"), "i", spark.createDataFrame(edges, "k int, x1 double, y1 double, x2 double, y2 double"), "k", g).collect()}
    assert got == {(i, k) for i, x, y in points for k, r in rings.items() if inside(x, y, r)} and len(got) > 100
