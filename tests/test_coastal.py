"""Closed-form cases, brute-force twins, properties and edge rows of the coastal operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.expr import along, error_by_age
from strandline.operators import cells as C
from strandline.operators import lines as L
from strandline.operators import profiles as R
from strandline.operators import raster as A
from strandline.operators import runs as U
from strandline.operators import series as S
from strandline.operators import spatial as P
from strandline.operators import storm as X
from strandline.operators import transects as T
from strandline.sources import files

K = ["s"]


@pytest.fixture(scope="module")
def straight(spark):
    return spark.createDataFrame([("a", i, 0.0, 100.0 * i) for i in range(11)], "line_id string, seq long, x double, y double")


def obs(spark, rows):
    return spark.createDataFrame(rows, "s string, obs_date string, value double, error double, source string").withColumn("obs_date", F.to_date("obs_date"))


def test_exact_line_series_gives_one_rate(spark):
    dates = [f"{2000 + 2 * i}-01-01" for i in range(6)]
    rows = [("a", d, float(2 * (np.datetime64(d) - np.datetime64("1970-01-01")).astype(int) / 365.25), 1.0, "x") for d in dates]
    found = {r["method"]: r for r in S.all_rates(obs(spark, rows), K).collect()}
    assert set(found) == set(S.METHODS)
    assert all(abs(r["rate"] - 2) < 1e-6 for r in found.values())
    assert found["OLS"]["r2"] == 1.0


def test_two_points_have_an_end_point_rate_alone(spark):
    rows = [("a", "2000-01-01", 1.0, 3.0, "x"), ("a", "2010-01-01", 11.0, 4.0, "x")]
    found = S.all_rates(obs(spark, rows), K).collect()
    assert [r["method"] for r in found] == ["EPR"]
    assert found[0]["rate_unc"] == pytest.approx(5 / (3653 / 365.25))


def test_weighted_regression_equals_polyfit(spark):
    rng = np.random.default_rng(1)
    d = np.sort(rng.choice(9000, 12, replace=False))
    v, e = rng.normal(0, 5, 12), rng.choice([1.0, 2.0, 5.0], 12)
    rows = [("a", str(np.datetime64("1990-01-01") + int(x)), float(y), float(z), "x") for x, y, z in zip(d, v, e, strict=True)]
    w = np.exp(-(d.max() - d) / 3652.5) / e**2
    slope = np.polyfit(d - d.max(), v, 1, w=w / w.sum())[0]
    assert S.time_weighted(obs(spark, rows), K).first()["rate"] == pytest.approx(slope * 365.25)


def test_upsert_keeps_the_last_arrival(spark):
    raw = spark.createDataFrame([("a", "2000-01-01", 1.0, 1.0, "x", 1), ("a", "2000-01-01", 2.0, 1.0, "y", 2), ("a", "1999-01-01", 9.0, 1.0, "z", 3)], "s string, obs_date string, value double, error double, source string, arrival long").withColumn("obs_date", F.to_date("obs_date"))
    assert sorted((str(r["obs_date"]), r["value"]) for r in S.upsert(raw, K).collect()) == [("1999-01-01", 9.0), ("2000-01-01", 2.0)]


def test_missing_error_gives_no_weighted_rate(spark):
    rows = [("a", f"200{i}-01-01", float(i), None if i == 1 else 1.0, "x") for i in range(5)]
    assert S.time_weighted(obs(spark, rows), K).count() == 0


def test_transects_of_a_straight_coast(straight):
    t = T.generate(straight, 100.0, 50, 50).orderBy("transect_id").collect()
    assert len(t) == 9
    assert all(r["start_x"] == pytest.approx(-50) and r["end_x"] == pytest.approx(50) and r["orient"] == pytest.approx(90) for r in t)


def test_resample_keeps_length_and_ends(straight):
    p = L.points(straight, 30.0, keep_ends=True)
    assert L.line_lengths(p.select("line_id", "seq", "x", "y")).first()["length"] == pytest.approx(1000)


def test_reversed_line_mirrors_transects(straight):
    a = T.generate(straight, 100.0, 50, 50).agg(F.avg("start_x")).first()[0]
    b = T.generate(L.reverse(straight), 100.0, 50, 50).agg(F.avg("start_x")).first()[0]
    assert a == pytest.approx(-b)


def test_savgol_reproduces_its_polynomial(spark):
    nodes = spark.createDataFrame([("a", i, float(i), float(i * i)) for i in range(41)], "line_id string, seq long, x double, y double")
    inner = L.smooth(nodes, 9, 3).filter("seq between 5 and 35").collect()
    assert all(r["y"] == pytest.approx(r["seq"] ** 2) for r in inner)


@pytest.mark.parametrize("g", [7.0, 40.0, 500.0])
def test_intersections_equal_all_pairs(spark, g):
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 100, (2, 30, 4))
    left = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(a)], "a int, ax1 double, ay1 double, ax2 double, ay2 double")
    right = spark.createDataFrame([(i, *map(float, s)) for i, s in enumerate(b)], "b int, bx1 double, by1 double, bx2 double, by2 double")
    found = {(r["a"], r["b"]) for r in P.intersections(left, right, g).collect()}

    def cross(p, q):
        d1, d2 = p[2:] - p[:2], q[2:] - q[:2]
        det = d1[0] * d2[1] - d1[1] * d2[0]
        r = q[:2] - p[:2]
        return 0 <= (r[0] * d2[1] - r[1] * d2[0]) / det <= 1 and 0 <= (r[0] * d1[1] - r[1] * d1[0]) / det <= 1

    assert found == {(i, j) for i in range(30) for j in range(30) if cross(a[i], b[j])}


def test_nearest_segment_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    pts, seg = rng.uniform(0, 1000, (20, 2)), rng.uniform(0, 300, (15, 4))
    p = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(pts)], "k int, x double, y double")
    s = spark.createDataFrame([tuple(map(float, v)) for v in seg], "x1 double, y1 double, x2 double, y2 double")

    def dist(q, v):
        d = v[2:] - v[:2]
        t = np.clip((q - v[:2]) @ d / (d @ d), 0, 1)
        return math.hypot(*(q - v[:2] - t * d))

    for r in P.nearest_segment(p, "k", s, 20.0, 1e5).collect():
        assert r["distance"] == pytest.approx(min(dist(pts[r["k"]], v) for v in seg))


def test_square_cell(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
    e = spark.createDataFrame([("c", *ring[i], *ring[i + 1]) for i in range(4)], "poly string, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 5.0), (3, 0.0, 5.0)], "k int, x double, y double")
    # The left edge belongs to the square, the right one doesn't.
    assert {r["k"] for r in P.in_polygon(p, "k", e, "poly", 4.0).collect()} == {1, 3}


def profile(spark, z):
    return spark.createDataFrame([("a", i, 5.0 * i, None if v is None else float(v)) for i, v in enumerate(z)], "s string, ix int, dist double, z double")


def test_triangle_barrier(spark):
    z = [0, 1, 2, 3, 4, 5, 6, 5.2, 4.3, 3.5, 2.7, 1.8, 1, 1, 1, 1]
    r = R.barriers(profile(spark, z), K, 1.0).first()
    assert (r["crest_z"], r["crest_dist"]) == (6.0, 30.0)
    assert R.crossings(profile(spark, z), K, 3.0).count() == 2
    assert R.widths(profile(spark, z), K, 3.0).first()["n"] == 1


def test_window_moves_the_front_toe_seaward(spark):
    p = profile(spark, [0.2, 0.5, 0.7, 1.2, 4, 5, 4, 2, 1.5, 1.4])
    # Landward from the sea the toe stops at its first node over the level; seaward from the top it goes on to the last node under it.
    assert R.barriers(p, K, 1.0).first()["toe_dist"] == 15
    r = R.barriers_window(p, K, 1.0).first()
    assert (r["toe_dist"], r["top_dist"], r["toe_z"]) == (10, 25, 0.7)
    assert R.barriers_window(p, K, 1.0, least=0.5).first()["toe_dist"] == 15


@pytest.mark.parametrize("z", [[2.0] * 12, [None] * 12, []])
def test_flat_and_empty_profiles_have_nothing(spark, z):
    p = profile(spark, z)
    assert R.cliffs(p, K).count() == 0 and R.barriers(p, K, 1.0).count() == 0 and R.crossings(p, K, 1.0).count() == 0


def test_cliff_has_its_top_and_toe(spark):
    z = [0.5, 1, 1.2, 1.4, 1.6, 18, 18.5, 19, 19.5, 20, 20.2, 20.4, 20.6]
    r = R.cliffs(profile(spark, z), K).first()
    assert r["cliff"] and r["converged"] and (r["toe_dist"], r["top_dist"]) == (20.0, 25.0)


def test_no_barrier_on_rock_or_behind_a_cliff(spark):
    rows = [(t, i, 5.0 * i, float(i % 4)) for t in ("rock", "cliff", "free", "unknown") for i in range(6)]
    p = spark.createDataFrame(rows, "s string, ix int, dist double, z double")
    rocky = spark.createDataFrame([("rock", True), ("cliff", False), ("unknown", None)], "s string, rocky boolean")
    found = spark.createDataFrame([("cliff", 10.0, True), ("free", 5.0, False)], "s string, toe_dist double, cliff boolean")
    left = R.searchable(p, K, rocky, found)
    assert left.columns == p.columns
    assert {r["s"]: r["count"] for r in left.groupBy("s").count().collect()} == {"cliff": 3, "free": 6, "unknown": 6}


def test_binned_cliff(spark):
    sea, face = [-1.0] * 8, [1, 8, 15, 22, 22.5, 23]
    r = R.cliffs_binned(profile(spark, sea + face + [-1.0, 50.0]), K, 5.0).first()
    # Five bins of sea stay, the second sea ends the profile.
    assert (r["toe_dist"], r["top_dist"], r["n_bins"]) == (35.0, 55.0, 11)
    chord = 24 / 50
    assert r["height"] == pytest.approx(23 - 20 * chord) and r["slope_deg"] == pytest.approx(math.degrees(math.atan((23 - 20 * chord) / 20)))
    # Eight bins down in a row end it before the eighth.
    r = R.cliffs_binned(profile(spark, [0.0, 5, 20] + [19.0 - i for i in range(12)]), K, 5.0).first()
    assert (r["top_dist"], r["n_bins"]) == (10.0, 10)
    assert R.cliffs_binned(profile(spark, [-1.0, -2.0]), K, 5.0).count() == 0
    assert R.cliffs_binned(profile(spark, [3.0]), K, 5.0).first()["slope_deg"] is None


def test_simple_barrier(spark):
    r = R.barriers_simple(profile(spark, [-1, 0.5, 0.6, 4, 5, 4.5, 1, 0.8, 0.7]), K).first()
    assert tuple(r)[1:] == (10.0, 15.0, 20.0, 5.0, 25.0, 30.0)
    assert tuple(R.barriers_simple(profile(spark, [3.0]), K).first())[1:] == (0.0, 0.0, 0.0, 3.0, 0.0, 0.0)
    assert R.barriers_simple(profile(spark, [-3.0, None]), K).count() == 0


@pytest.mark.parametrize("twl,setup,want", [(1.0, 0.5, "Swash"), (3.0, 1.0, "Collision"), (6.0, 4.0, "Overwash"), (6.0, 5.5, "Inundation"), (5.0, 1.0, None)])
def test_regimes(spark, twl, setup, want):
    row = spark.range(1).select(X.regime(F.lit(twl), F.lit(setup), F.lit(2.0), F.lit(5.0), F.lit(True), F.lit(None).cast("double"), F.lit(1.0)).alias("r"))
    assert row.first()["r"] == want


def test_islands_keep_both_runs(spark):
    rows = spark.createDataFrame([("a", i, c == "1") for i, c in enumerate("0110111")], "s string, i int, f boolean")
    runs = U.islands(rows, K, "i", F.col("f")).groupBy("run").count().collect()
    assert sorted(r["count"] for r in runs) == [2, 3]


def test_square_patch_area(spark):
    v = spark.createDataFrame([("a", i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], "s string, seq int, x double, y double")
    assert U.patch_area(v, K).first()["area"] == 4.0


def test_loops_are_cut_at_their_crossing(spark):
    line = lambda i, *xy: [(i, n, float(x), float(y)) for n, (x, y) in enumerate(xy)]
    rows = line(1, (0, 0), (10, 0), (10, 5), (5, 5), (5, -5), (20, -5)) + line(2, (0, 0), (4, 0), (4, 4), (0, 4), (0, 0)) + line(3, (0, 0), (5, 0), (9, 1))
    # A loop inside a loop goes with it; a second one after it is cut too.
    rows += line(4, (0, 0), (20, 0), (20, 9), (14, 9), (14, 4), (17, 4), (17, 6), (10, 6), (10, -6), (30, -6), (30, 3), (25, 3), (25, -9))
    got = {}
    for r in L.make_simple(spark.createDataFrame(rows, "line_id long, seq long, x double, y double"), 7.0).orderBy("line_id", "seq").collect():
        got.setdefault(r["line_id"], []).append((r["seq"], r["x"], r["y"]))
    want = {1: [(0, 0), (5, 0), (5, -5), (20, -5)], 2: [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], 3: [(0, 0), (5, 0), (9, 1)], 4: [(0, 0), (10, 0), (10, -6), (25, -6), (25, -9)]}
    assert got == {k: [(n, float(x), float(y)) for n, (x, y) in enumerate(v)] for k, v in want.items()}


def test_dropped_overlaps_leave_no_crossing(spark):
    t = spark.createDataFrame([("a", i) for i in range(5)], "line_id string, transect_id int")
    pairs = spark.createDataFrame([("a", 0, 1, 5.0, 9.0), ("a", 1, 2, 9.0, 4.0), ("a", 3, 4, 1.0, 1.0)], "line_id string, a int, b int, la double, lb double")
    assert {r["transect_id"] for r in T.drop_overlaps(t, pairs).collect()} == {0, 2, 3}


@pytest.mark.parametrize("lengths", [[30.0 - i for i in range(30)], [7.0] * 30])
def test_long_runs_of_overlaps_leave_no_crossing(spark, lengths):
    # Each round removes one: falling lengths from the front, equal lengths from the back.
    t = spark.createDataFrame([("a", i) for i in range(30)], "line_id string, transect_id int")
    pairs = spark.createDataFrame([("a", i, i + 1, lengths[i], lengths[i + 1]) for i in range(29)], "line_id string, a int, b int, la double, lb double")
    kept = {r["transect_id"] for r in T.drop_overlaps(t, pairs).collect()}
    assert kept == ({29} if lengths[0] > lengths[1] else {0})


def test_touching_lines_are_chained(spark):
    nodes = spark.createDataFrame([("b", 0, 1.0, 0.0), ("b", 1, 2.0, 0.0), ("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("c", 0, 9.0, 9.0), ("c", 1, 8.0, 8.0)], "line_id string, seq long, x double, y double")
    chains = {}
    for r in L.merge_touching(nodes).orderBy("chain_id", "seq").collect():
        chains.setdefault(r["chain_id"], []).append(r["x"])
    assert chains == {"a": [0.0, 1.0, 2.0], "c": [9.0, 8.0]}


def test_rings_cycles_and_turned_lines_are_kept(spark):
    lines = {
        1: [(0, 0), (1, 0), (1, 1), (0, 0)],  # a ring
        2: [(10, 0), (11, 0)], 3: [(11, 0), (11, 1), (10, 0)],  # a cycle of two
        4: [(20, 0), (21, 0)], 5: [(22, 0), (21, 0)], 6: [(22, 0), (23, 0)],  # end to end, start to start
        7: [(30, 0), (31, 0)], 8: [(31, 0), (32, 0)], 9: [(31, 0), (31, 5)],  # a junction
        **{100 + i: [(i, 50), (i + 1, 50)] for i in range(70)},
    }
    nodes = spark.createDataFrame([(k, i, float(x), float(y)) for k, own in lines.items() for i, (x, y) in enumerate(own)], "line_id long, seq long, x double, y double")
    chains = {}
    for r in L.merge_touching(nodes).orderBy("chain_id", "seq").collect():
        chains.setdefault(r["chain_id"], []).append((r["x"], r["y"]))
    want = {1: lines[1], 2: [(10, 0), (11, 0), (11, 1), (10, 0)], 4: [(20, 0), (21, 0), (22, 0), (23, 0)], 7: lines[7], 8: lines[8], 9: lines[9], 100: [(i, 50) for i in range(71)]}
    assert chains == {k: [(float(x), float(y)) for x, y in v] for k, v in want.items()}


def test_scores_of_missing_cells_are_null(spark):
    cells = spark.createDataFrame([(1,), (2,)], "cell_id int")
    rates = spark.createDataFrame([(1, 0.5)], "cell_id int, hist_rate double")
    found = {r["cell_id"]: r for r in C.erosion(cells, rates).collect()}
    assert found[1]["n_eros"] == 0 and found[1]["eros_med"] is None and found[2]["n_trans"] is None


def test_error_by_age_and_signed_distance(spark):
    r = spark.range(1).select(error_by_age(F.to_date(F.lit("1890-01-01"))).alias("a"), error_by_age(F.to_date(F.lit("1980-01-01"))).alias("b"), along(F.lit(-3.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("d")).first()
    assert (r["a"], r["b"]) == (5.0, 2.0) and r["d"] == pytest.approx(-3)


def test_bilinear_on_a_plane_is_exact(spark):
    cells = spark.createDataFrame([(r, c, float(2 * c - 3 * r)) for r in range(6) for c in range(6)], "row_ix long, col_ix long, z double")
    p = spark.createDataFrame([(1, 2.3, 3.1), (2, 3.9, 2.2)], "k int, x double, y double")
    for r in A.bilinear(p, cells, "k", 0.0, 6.0, 1.0).collect():
        x, y = {1: (2.3, 3.1), 2: (3.9, 2.2)}[r["k"]]
        assert r["z"] == pytest.approx(2 * (x - 0.5) - 3 * (6 - y - 0.5))


def test_geojson_round_trip(spark, straight, tmp_path):
    files.write_features(straight, ["line_id"], str(tmp_path / "f"))
    feature = spark.read.text(str(tmp_path / "f")).first()["value"]
    (tmp_path / "g.geojson").write_text('{"type": "FeatureCollection", "features": [' + feature + ', {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}')
    back = files.read_geojson_lines(spark, str(tmp_path / "g.geojson"))
    assert back.count() == 11 and back.filter("seq = 10").first()["y"] == 1000.0


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "t.asc").write_text("ncols 2\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 5\nNODATA_value -9999\n1 2\n-9999 4\n")
    got = {(r["x"], r["y"]): r["z"] for r in files.read_ascii_grid(spark, str(tmp_path / "t.asc")).collect()}
    assert got == {(12.5, 27.5): 1.0, (17.5, 27.5): 2.0, (17.5, 22.5): 4.0}


def test_required_columns_and_keys(spark):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    with pytest.raises(ValueError):
        files.require(df, ["b"])
    with pytest.raises(ValueError):
        files.require(df, ["a"], ["a"])


def test_streamed_upsert_equals_batch(spark, tmp_path):
    from strandline.streaming.observations import run_to_end, upsert_batch, upserted

    raw = spark.createDataFrame([("a", "2000-01-01", float(i % 3), 1.0, "x", i) for i in range(6)], "s string, obs_date string, value double, error double, source string, arrival long").withColumn("obs_date", F.to_date("obs_date"))
    for i in range(2):
        raw.filter(F.col("arrival") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        run_to_end(stream, upsert_batch(str(tmp_path / "out"), K), str(tmp_path))
    assert len(list((tmp_path / "out").iterdir())) == 2
    assert [r["value"] for r in upserted(spark, str(tmp_path / "out"), K).collect()] == [r["value"] for r in S.upsert(raw, K).collect()]


def test_late_rows_of_a_stream_are_dropped(spark, tmp_path):
    from strandline.streaming.observations import append_batch, run_to_end, tumbling, updated

    days = [("a", "2020-01-01 01:00:00", 1.0)], [("a", "2020-01-09 01:00:00", 2.0)], [("a", "2020-01-01 02:00:00", 5.0), ("a", "2020-01-09 02:00:00", 4.0)]
    schema = "k string, ts timestamp, value double"
    for i, day in enumerate(days):
        spark.createDataFrame([(k, t, v) for k, t, v in day], "k string, ts string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        run_to_end(tumbling(rows, "ts", "1 day", "1 day", ["k"], "value"), append_batch(str(tmp_path / "out")), str(tmp_path), "update")
    got = {(r["start"].day, r["n"], r["mean"]) for r in updated(spark, str(tmp_path / "out"), ["start", "k"]).collect()}
    assert got == {(1, 1, 1.0), (9, 2, 3.0)}


def test_transects_are_cut_to_the_part_nearest_the_coast(spark):
    # Two squares on the way; the coast point lies nearer the middle of the second.
    box = lambda i, x0: [(i, *e) for e in ((x0, 0.0, x0 + 100, 0.0), (x0 + 100, 0.0, x0 + 100, 100.0), (x0 + 100, 100.0, x0, 100.0), (x0, 100.0, x0, 0.0))]
    edges = spark.createDataFrame(box(1, 0.0) + box(2, 200.0), "cell_id int, x1 double, y1 double, x2 double, y2 double")
    rows = [("a", i, i, 180.0, y, -50.0, y, 350.0, y, 90.0) for i, y in ((0, 300.0), (1, 50.0), (2, 60.0))]
    t = spark.createDataFrame(rows, "line_id string, transect_id long, sid long, coast_x double, coast_y double, start_x double, start_y double, end_x double, end_y double, orient double")
    seg = t.selectExpr("sid", "start_x as ax1", "start_y as ay1", "end_x as ax2", "end_y as ay2")
    found = T.nearest_part(t, "sid", P.clip_segments(seg, "sid", edges, "cell_id", 50.0), "cell_id", 1.0).orderBy("sid").collect()
    assert [(r["sid"], r["number"], r["cell_id"]) for r in found] == [(1, 0, 2), (2, 1, 2)]
    assert all((r["start_x"], r["end_x"]) == pytest.approx((199, 301)) and r["start_y"] == pytest.approx(r["end_y"]) for r in found)


def _peucker(p, tolerance):
    """Kept places of the nodes, by recursion."""
    a, d = p[0], p[-1] - p[0]
    if len(p) < 3:
        return list(range(len(p)))
    f = np.clip(((p - a) @ d) / (d @ d), 0, 1) if d @ d > 0 else np.zeros(len(p))
    far = np.hypot(*(p - a - f[:, None] * d).T)[1:-1]
    i = int(far.argmax()) + 1
    if far.max() <= tolerance:
        return [0, len(p) - 1]
    return _peucker(p[: i + 1], tolerance)[:-1] + [i + k for k in _peucker(p[i:], tolerance)]


def test_simplified_lines_keep_what_douglas_and_peucker_keep(spark):
    rng = np.random.default_rng(8)
    lines = {k: np.cumsum(rng.normal(0, 1, (n, 2)), axis=0) for k, n in enumerate((1, 2, 3, 60, 3000))}
    lines[5] = np.vstack([lines[3], lines[3][:1]])  # a ring
    rows = [(k, 2 * i, *map(float, v)) for k, p in lines.items() for i, v in enumerate(p)]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        # Batches of 50 rows hold several lines, or part of one.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        found = L.simplify(spark.createDataFrame(rows, "line_id long, seq long, x double, y double"), 1.5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    for k, p in lines.items():
        assert sorted(r["seq"] // 2 for r in found if r["line_id"] == k) == (_peucker(p, 1.5) if len(p) > 1 else [0])


def test_merging_snaps_starts_and_ends_and_drops_nodes_on_a_chord(spark):
    # Lines 1 and 2 begin within 0.1 m of each other, line 3 ends so near the start of 4; a node of 2 lies 0.1 m off its chord, one of 4 lies 3 m off.
    rows = [(1, 0, 0.0, 0.0), (1, 1, 0.0, 50.0), (2, 0, 0.06, 0.0), (2, 1, 50.0, 0.1), (2, 2, 100.0, 0.0)]
    rows += [(3, 0, 500.0, 0.0), (3, 1, 600.0, 0.0), (4, 0, 600.0, 0.07), (4, 1, 650.0, 3.0), (4, 2, 700.0, 0.0)]
    found = L.merge_snap(spark.createDataFrame(rows, "line_id long, seq long, x double, y double"), 0.1).orderBy("chain_id", "seq").collect()
    chains = {k: [(r["x"], r["y"]) for r in found if r["chain_id"] == k] for k in {r["chain_id"] for r in found}}
    assert sorted(chains.values()) == [[(0.0, 50.0), (0.0, 0.0), (100.0, 0.0)], [(500.0, 0.0), (600.0, 0.07), (650.0, 3.0), (700.0, 0.0)]] or sorted(chains.values()) == [[(100.0, 0.0), (0.0, 0.0), (0.0, 50.0)], [(500.0, 0.0), (600.0, 0.07), (650.0, 3.0), (700.0, 0.0)]]


def test_each_pass_of_smoothing_resamples_and_keeps_the_ends(spark):
    rng = np.random.default_rng(9)
    lines = {1: np.cumsum(rng.uniform(-9, 30, (40, 2)), axis=0), 2: np.array([[0.0, 0.0], [3.0, 4.0]]), 3: np.array([[0.0, 0.0], [0.0, 20.0], [0.0, 20.0], [0.0, 33.0]])}
    rows = [(k, i, *map(float, v)) for k, p in lines.items() for i, v in enumerate(p)]
    found = L.smooth_passes(spark.createDataFrame(rows, "line_id long, seq long, x double, y double"), 5.0, 5, 1, 3).orderBy("line_id", "seq").collect()
    for k, p in lines.items():
        for _ in range(3):
            at = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
            d = np.r_[np.arange(0, at[-1], 5.0), at[-1]]
            keep = np.r_[True, np.diff(at) > 0]
            p = np.array([np.interp(d, at[keep], v[keep]) for v in p.T]).T
            n = len(p)
            fold = [abs((i + n - 1) % (2 * n - 2) - (n - 1)) for i in range(-2 - (n - 1), n + 2 - (n - 1))]
            fold = [n - 1 - f for f in fold]
            s = np.array([p[[fold[i + j] for j in range(5)]].mean(0) for i in range(n)])
            p = np.vstack([p[:1], s, p[-1:]])
        mine = np.array([(r["x"], r["y"]) for r in found if r["line_id"] == k])
        assert mine.shape == p.shape and np.allclose(mine, p, atol=1e-9)


def test_smoothing_spline_bends_least_within_its_bound(spark):
    rng = np.random.default_rng(10)
    walk = np.cumsum(rng.uniform(2, 30, (14, 2)) * rng.choice([-1, 1], (14, 2), p=[0.2, 0.8]), axis=0)
    lines = {1: walk, 2: np.repeat(walk[:9], 2, axis=0), 3: np.array([[0.0, 0.0], [9.0, 0.2], [20.0, -0.3], [30.5, 0.1], [44.0, 0.0]]), 4: walk[:3]}
    rows = [(k, i, *map(float, v)) for k, p in lines.items() for i, v in enumerate(p)]
    found = L.smooth_spline(spark.createDataFrame(rows, "line_id long, seq long, x double, y double"), 2.0, 1.0).orderBy("line_id", "seq").collect()
    for k, p in lines.items():
        p = p[np.r_[True, np.any(np.diff(p, axis=0) != 0, axis=1)]]
        mine = np.array([(r["x"], r["y"]) for r in found if r["line_id"] == k])
        if len(p) < 4:
            assert np.array_equal(mine, p)
            continue
        n, h = len(p), np.hypot(*np.diff(p, axis=0).T)
        u = np.r_[0, np.cumsum(h)]
        q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
        for j in range(n - 2):
            q[j : j + 3, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
            r[j, j] = (h[j] + h[j + 1]) / 3
            if j:
                r[j, j - 1] = r[j - 1, j] = h[j] / 6
        rest = lambda a: a * q @ np.linalg.solve(r + a * q.T @ q, q.T @ p)  # noqa: E731, B023
        lo, hi = -40.0, 60.0
        for _ in range(100):
            lo, hi = ((lo + hi) / 2, hi) if (rest(2 ** ((lo + hi) / 2)) ** 2).sum() <= 4.0 * n else (lo, (lo + hi) / 2)
        a = 2**lo
        f, g = p - rest(a), np.vstack([np.zeros(2), np.linalg.solve(r + a * q.T @ q, q.T @ p), np.zeros(2)])
        if k == 3:  # within the bound of its straight line
            f, g = np.array([np.polyval(np.polyfit(u, v, 1), u) for v in p.T]).T, g * 0
        else:
            assert ((p - f) ** 2).sum() == pytest.approx(4.0 * n)
        at = np.r_[np.arange(u[1], u[-2], 1.0), u[-1]]
        i = np.minimum(np.searchsorted(u, at, "right") - 1, n - 2)
        b, c, w = (u[i + 1] - at)[:, None], (at - u[i])[:, None], h[i][:, None]
        want = (b * f[i] + c * f[i + 1]) / w - b * c / 6 * ((1 + b / w) * g[i] + (1 + c / w) * g[i + 1])
        assert mine.shape == (len(at) + 2, 2) and np.allclose(mine, np.vstack([p[:1], want, p[-1:]]), atol=1e-6)
