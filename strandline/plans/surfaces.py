"""Registered raster, projection, run and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.deviates import duck_keys, duck_uniform
from strandline.functions.output import rounded
from strandline.functions.stage import cut, few, stored
from strandline.operators import profiles as R
from strandline.operators import project as J
from strandline.operators import raster as A
from strandline.operators import runs as U
from strandline.operators import series as S
from strandline.plans import series as Y
from strandline.plans.registry import query
from strandline.sources.views import duck, view

# Rasters: a strip of 50 rows; points in units of cells, zones and swaths along it.


def _points(spark, sf):
    return view(spark, sf, "grid_point")


_RC = ", pt AS (SELECT site_id, floor(x)::BIGINT AS col_ix, floor(50 - y)::BIGINT AS row_ix FROM grid_point)"
_V = ("grid_point", "raster_cell")


@query("raster_sample_point", duck(*_V, then=_RC + " SELECT site_id, round(arg_min(z, tile), 6) AS z FROM pt JOIN raster_cell USING (row_ix, col_ix) GROUP BY 1"))
def raster_sample_point(spark, sf):
    return rounded(A.sample(_points(spark, sf), view(spark, sf, "raster_cell"), ["site_id"], 0.0, 50.0, 1.0))


@query("raster_sample_rslr", duck(*_V, then=_RC + " SELECT site_id, round(coalesce(arg_min(z, tile), 0), 6) AS z FROM pt LEFT JOIN raster_cell USING (row_ix, col_ix) GROUP BY 1"))
def raster_sample_rslr(spark, sf):
    return rounded(A.sample_or(_points(spark, sf), view(spark, sf, "raster_cell"), ["site_id"], 0.0, 50.0, 1.0, 0.0))


@query("raster_sample_node_z", duck(*_V, then=_RC + " SELECT site_id, round(arg_min(z, tile), 6) AS z FROM pt JOIN raster_cell USING (row_ix, col_ix) WHERE z <> 0 GROUP BY 1"))
def raster_sample_node_z(spark, sf):
    return rounded(A.sample(_points(spark, sf), view(spark, sf, "raster_cell").filter("z <> 0"), ["site_id"], 0.0, 50.0, 1.0))


@query("raster_mosaic_max", duck("raster_cell", then=" SELECT row_ix, col_ix, round(max(z), 6) AS z FROM raster_cell GROUP BY 1, 2"))
def raster_mosaic_max(spark, sf):
    return rounded(A.mosaic_max(view(spark, sf, "raster_cell")))


@query("raster_tile_index", duck("raster_cell", then=" SELECT tile, min(row_ix) AS row_min, max(row_ix) AS row_max, min(col_ix) AS col_min, max(col_ix) AS col_max, count(*) AS n FROM raster_cell GROUP BY 1"))
def raster_tile_index(spark, sf):
    return view(spark, sf, "raster_cell").groupBy("tile").agg(F.min("row_ix").alias("row_min"), F.max("row_ix").alias("row_max"), F.min("col_ix").alias("col_min"), F.max("col_ix").alias("col_max"), F.count("*").alias("n"))


@query("raster_resample_bilinear", duck(*_V, then=""", m AS (SELECT row_ix, col_ix, max(z) AS z FROM raster_cell GROUP BY 1, 2), f AS (SELECT site_id, x - 0.5 AS fx, 50 - y - 0.5 AS fy FROM grid_point),
 n AS (SELECT site_id, (floor(fx) + j)::BIGINT AS col_ix, (floor(fy) + i)::BIGINT AS row_ix, (CASE WHEN j = 1 THEN fx - floor(fx) ELSE 1 - (fx - floor(fx)) END) * (CASE WHEN i = 1 THEN fy - floor(fy) ELSE 1 - (fy - floor(fy)) END) AS w FROM f, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))
 SELECT site_id, round(sum(w * z) / nullif(sum(w), 0), 6) AS z FROM n JOIN m USING (row_ix, col_ix) GROUP BY 1"""))
def raster_resample_bilinear(spark, sf):
    return rounded(A.bilinear(_points(spark, sf), A.mosaic_max(view(spark, sf, "raster_cell")), "site_id", 0.0, 50.0, 1.0))


@query("bathtub_flood", duck("raster_cell", then=" SELECT tile, row_ix, col_ix, round(greatest(8.0 - z, 0), 6) AS depth, (greatest(8.0 - z, 0) > 0)::INT AS flooded FROM raster_cell"))
def bathtub_flood(spark, sf):
    return rounded(A.flood(view(spark, sf, "raster_cell"), 8.0).select("tile", "row_ix", "col_ix", "depth", "flooded"))


def _centres(spark, sf):
    return A.mosaic_max(view(spark, sf, "raster_cell")).select(((F.col("col_ix") + 0.5) * 20).alias("x"), ((49.5 - F.col("row_ix")) * 20).alias("y"), "z", "row_ix", "col_ix")


_CEN = ", cen AS (SELECT (col_ix + 0.5::DOUBLE) * 20 AS x, (49.5::DOUBLE - row_ix) * 20 AS y, max(z) AS z, row_ix, col_ix FROM raster_cell GROUP BY row_ix, col_ix)"


@query("zonal_stats", duck("raster_cell", "zone_box", then=_CEN + " SELECT cell_id, count(z) AS n_pix, round(min(z), 6) AS z_min, round(avg(z), 6) AS z_mean, round(median(z), 6) AS z_median, round(avg((z < 5)::INT), 6) AS low5_frac, round(avg((z < 10)::INT), 6) AS low10_frac FROM zone_box LEFT JOIN cen ON x >= xmin AND x < xmax AND y >= ymin AND y < ymax GROUP BY 1"))
def zonal_stats(spark, sf):
    return rounded(A.zonal(_centres(spark, sf), view(spark, sf, "zone_box"), 200.0))


@query("idw_grid", duck("site_point", then=""", g AS (SELECT id % 20 AS col_ix, id // 20 AS row_ix, (id % 20 + 0.5::DOUBLE) * 50 AS x, (id // 20 + 0.5::DOUBLE) * 50 AS y FROM range(0, 400) r(id)),
 nn AS (SELECT g.row_ix, g.col_ix, s.label / 100.0::DOUBLE AS v, sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) AS d, row_number() OVER (PARTITION BY row_ix, col_ix ORDER BY sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2), site_id) AS r FROM g JOIN site_point s ON sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2) <= 300)
 SELECT row_ix, col_ix, round(sum(CASE WHEN d = 0 THEN 1 ELSE 1 / d END * v) / sum(CASE WHEN d = 0 THEN 1 ELSE 1 / d END), 6) AS v FROM nn WHERE r <= 12 GROUP BY 1, 2"""))
def idw_grid(spark, sf):
    p = view(spark, sf, "site_point").select("site_id", "x", "y", (F.col("label") / 100.0).alias("v"))
    return rounded(A.idw_grid(p, 20, 20, 50.0, 12, 1.0, 300.0))


_SWT = """, tr AS (SELECT cell_id AS transect_id, xmin + 30 AS start_x, ymin + 40 AS start_y, xmax - 20 AS end_x, ymax - 35 AS end_y FROM zone_box),
 sw AS (SELECT transect_id, row_ix, col_ix, z, ((x - start_x) * dx + (y - start_y) * dy) / l AS along, abs((x - start_x) * dy - (y - start_y) * dx) / l AS dto FROM (SELECT *, end_x - start_x AS dx, end_y - start_y AS dy, sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) AS l FROM tr) t, cen
 WHERE abs((x - start_x) * dy - (y - start_y) * dx) / l <= 40 AND ((x - start_x) * dx + (y - start_y) * dy) / l BETWEEN 0 AND l)"""


def _swath(spark, sf):
    t = view(spark, sf, "zone_box").select(F.col("cell_id").alias("transect_id"), (F.col("xmin") + 30).alias("start_x"), (F.col("ymin") + 40).alias("start_y"), (F.col("xmax") - 20).alias("end_x"), (F.col("ymax") - 35).alias("end_y"))
    return A.swath(_centres(spark, sf), t, 40.0, 200.0)


@query("swath_sample", duck("raster_cell", "zone_box", then=_CEN + _SWT + " SELECT transect_id, row_ix, col_ix, round(z, 6) AS z, round(along, 6) AS along, round(dto, 6) AS dist_to FROM sw"))
def swath_sample(spark, sf):
    return rounded(_swath(spark, sf).select("transect_id", "row_ix", "col_ix", "z", "along", F.col("to").alias("dist_to")))


@query("swath_idw", duck("raster_cell", "zone_box", then=_CEN + _SWT + """, nd AS (SELECT *, unnest(range(greatest(ceil((along - 40) / 20), 0)::BIGINT, greatest(floor((along + 40) / 20), 0)::BIGINT + 1)) AS ix FROM sw)
 SELECT transect_id, ix, round(sum(z / greatest((along - ix * 20) ** 2 + dto ** 2, 1e-6)) / sum(1 / greatest((along - ix * 20) ** 2 + dto ** 2, 1e-6)), 6) AS z, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(stddev_pop(z), 6) AS z_std, count(*) AS n FROM nd WHERE abs(along - ix * 20) < 40 GROUP BY 1, 2"""))
def swath_idw(spark, sf):
    return rounded(A.swath_profile(_swath(spark, sf), ["transect_id"], 20.0, 40.0))


@query("swath_percentiles", duck("raster_cell", "zone_box", then=_CEN + _SWT + " SELECT transect_id, round(quantile_cont(z, 0.16), 8) AS p16, round(median(z), 8) AS p50, round(quantile_cont(z, 0.84), 8) AS p84, round(avg(z), 8) AS mean, round(stddev_pop(z), 8) AS std FROM sw GROUP BY 1"))
def swath_percentiles(spark, sf):
    q = F.percentile("z", F.array(F.lit(0.16), F.lit(0.5), F.lit(0.84))).alias("q")
    s = _swath(spark, sf).groupBy("transect_id").agg(q, F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"))
    return rounded(s.select("transect_id", F.col("q")[0].alias("p16"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p84"), "mean", "std"), 8)


# Profiles

_P = ["transect_id"]
_CR = ", cz AS (SELECT *, lead(z) OVER (PARTITION BY transect_id ORDER BY ix) AS z2, lead(dist) OVER (PARTITION BY transect_id ORDER BY ix) AS d2 FROM profile), cr AS (SELECT transect_id, ix, dist + abs((3.0 - z) / (z2 - z)) * (d2 - dist) AS position, z2 > z AS rising, row_number() OVER (PARTITION BY transect_id ORDER BY ix) AS number FROM cz WHERE (z > 3.0) <> (z2 > 3.0) AND z <> z2)"


def _profile(spark, sf):
    return view(spark, sf, "profile")


def _profiles(spark, sf):
    """Whole profiles, an array each, with their roughness, stored once."""
    return stored(R.roughness_of(R.whole(_profile(spark, sf), _P), 5.0, 8.0), "profiles")


def _soft(profiles, where=None):
    """Profiles where barriers are looked for: off rocky transects, up to the toe of a cliff."""
    from strandline.operators.clusters import rougher

    return R.searchable_of(profiles, _P, rougher(cut(profiles.select("slope_rough", "z_rough"))), where)


def barriers(profiles):
    """Barriers of the stored profiles."""
    return R.barriers_of(_soft(profiles), _P, 1.0)


@query("profile_crossings", duck("profile", then=_CR + " SELECT transect_id, ix, round(position, 6) AS position, rising, number FROM cr"))
def profile_crossings(spark, sf):
    return rounded(R.crossings(_profile(spark, sf), _P, 3.0).select("transect_id", "ix", "position", "rising", F.col("number").cast("long").alias("number")))


@query("profile_index_above", duck("profile", then=" SELECT transect_id, min(ix) FILTER (z > 6.0) AS ix_above, CASE WHEN min(ix) FILTER (z > 6.0) > 0 THEN min(ix) FILTER (z > 6.0) - 1 END AS ix_seaward FROM profile GROUP BY 1"))
def profile_index_above(spark, sf):
    return R.index_above(_profile(spark, sf), _P, 6.0)


@query("barrier_width_levels", duck("profile", then=_CR + """, pr AS (SELECT transect_id, ix, nx - position AS w, row_number() OVER (PARTITION BY transect_id ORDER BY ix) AS k FROM (SELECT *, lead(position) OVER p AS nx, lead(rising) OVER p AS nr FROM cr WINDOW p AS (PARTITION BY transect_id ORDER BY ix)) WHERE rising AND NOT nr)
 SELECT transect_id, round(coalesce(sum(w) FILTER (k = 1), 0), 6) AS width, round(coalesce(sum(w), 0), 6) AS total_width, count(w) AS n FROM (SELECT DISTINCT transect_id FROM profile) LEFT JOIN pr USING (transect_id) GROUP BY 1"""))
def barrier_width_levels(spark, sf):
    return rounded(R.widths(_profile(spark, sf), _P, 3.0))


@query("barrier_width_volume", duck("profile", then=_CR + ", b AS (SELECT transect_id, min(position) FILTER (number = 1) AS p0, min(position) FILTER (number = 2) AS p1 FROM cr GROUP BY 1) SELECT transect_id, round(any_value(p1 - p0), 6) AS width, round(sum((z - 3.0) * 5), 6) AS volume FROM profile JOIN b USING (transect_id) WHERE dist >= p0 AND dist <= p1 GROUP BY 1"))
def barrier_width_volume(spark, sf):
    return rounded(R.volume_above(_profile(spark, sf), _P, 3.0, 5.0))


@query("win_gradient", duck("profile", then=""", g AS (SELECT transect_id, ix, CASE WHEN a IS NULL THEN (b - z) / 5 WHEN b IS NULL THEN (z - a) / 5 ELSE (b - a) / 10 END AS slope FROM (SELECT *, lag(z) OVER w AS a, lead(z) OVER w AS b FROM profile WINDOW w AS (PARTITION BY transect_id ORDER BY ix)))
 SELECT transect_id, ix, round(slope, 8) AS slope, round(CASE WHEN a IS NULL THEN (b - slope) / 5 WHEN b IS NULL THEN (slope - a) / 5 ELSE (b - a) / 10 END, 8) AS curvature FROM (SELECT *, lag(slope) OVER w AS a, lead(slope) OVER w AS b FROM g WINDOW w AS (PARTITION BY transect_id ORDER BY ix))"""))
def win_gradient(spark, sf):
    return rounded(R.gradient(_profile(spark, sf), _P, 5.0).select("transect_id", "ix", "slope", "curvature"), 8)


@query("roughness", duck("profile", then=""", r AS (SELECT * FROM (SELECT *, (lead(z) OVER (PARTITION BY transect_id ORDER BY ix) - z) / 5 AS slope FROM profile) WHERE z > -1 AND z < 8)
 SELECT transect_id, round(quantile_cont(slope, 0.95) - quantile_cont(slope, 0.05), 6) AS slope_rough, round(stddev_pop(z), 6) AS z_rough, quantile_cont(slope, 0.95) - quantile_cont(slope, 0.05) > 0.05 AND stddev_pop(z) > 0.2 AS rocky FROM r GROUP BY 1"""))
def roughness(spark, sf):
    return rounded(R.roughness(_profile(spark, sf), _P, 5.0, 8.0))


@query("cliff_detect")
def cliff_detect(spark, sf):
    return rounded(R.cliffs(view(spark, sf, "cliff_profile"), _P))


@query("cliff_detect_window")
def cliff_detect_window(spark, sf):
    return rounded(R.cliffs(view(spark, sf, "cliff_profile").filter("z > 0 and dist <= 300"), _P))


@query("barrier_detect")
def barrier_detect(spark, sf):
    return rounded(barriers(_profiles(spark, sf)))


@query("barrier_detect_window")
def barrier_detect_window(spark, sf):
    inside = lambda a: (a["ix"] > 0) & a["dist"].between(20, 350)
    return rounded(R.barriers_window_of(_soft(_profiles(spark, sf), inside), _P, 1.0))


@query("barrier_elevations")
def barrier_elevations(spark, sf):
    return rounded(barriers(_profiles(spark, sf)).select("transect_id", "toe_z", "top_z", "crest_z", "back_toe_z"))


@query("rocky_cluster")
def rocky_cluster(spark, sf):
    from strandline.operators.clusters import rocky

    return rocky(R.roughness(_profile(spark, sf), _P, 5.0, 8.0), _P)


@query("hinterland_slope", duck("profile", then=""", l AS (SELECT *, dist - min(dist) OVER (PARTITION BY transect_id) AS d FROM profile WHERE z > 0), f AS (SELECT *, max(d) OVER (PARTITION BY transect_id) - d AS w FROM l), s AS (SELECT transect_id, sum(w * d * z) / nullif(sum(w * d * d), 0) AS slope FROM f GROUP BY 1)
 SELECT transect_id, round(CASE WHEN slope <= 0 THEN 0.001 ELSE coalesce(slope, 1) END, 6) AS slope FROM s"""))
def hinterland_slope(spark, sf):
    return rounded(J.hinterland_slope(_profile(spark, sf), _P))


@query("hinterland_stats", duck("profile", then=" SELECT transect_id, round(avg(z), 6) AS z_mean, round((arg_max(z, ix) - arg_min(z, ix)) / nullif(max(dist) - min(dist), 0), 6) AS slope FROM profile WHERE dist >= 150 GROUP BY 1"))
def hinterland_stats(spark, sf):
    h = _profile(spark, sf).filter("dist >= 150").groupBy("transect_id").agg(F.avg("z").alias("z_mean"), ((F.max_by("z", "ix") - F.min_by("z", "ix")) / F.nullif(F.max("dist") - F.min("dist"), F.lit(0.0))).alias("slope"))
    return rounded(h)


@query("barrier_search_window", duck("profile", then=" SELECT transect_id, -50.0::DOUBLE AS seaward, coalesce(arg_min(dist, z) FILTER (dist BETWEEN 100 AND 200), 200)::DOUBLE AS landward FROM profile GROUP BY 1"))
def barrier_search_window(spark, sf):
    low = F.min(F.when(F.col("dist").between(100, 200), F.struct("z", "dist"))).alias("low")
    return _profile(spark, sf).groupBy("transect_id").agg(low).select("transect_id", F.lit(-50.0).alias("seaward"), F.coalesce("low.dist", F.lit(200.0)).alias("landward"))


@query("foreshore_slope", duck("profile", then=""", q AS (SELECT transect_id, min(ix) FILTER (z > 2) AS i0, min(ix) FILTER (z > 6) AS i1 FROM profile GROUP BY 1)
 SELECT q.transect_id, round(CASE WHEN i1 > i0 THEN (b.z - a.z) / (b.dist - a.dist) END, 6) AS slope FROM q LEFT JOIN profile a ON a.transect_id = q.transect_id AND a.ix = i0 LEFT JOIN profile b ON b.transect_id = q.transect_id AND b.ix = i1"""))
def foreshore_slope(spark, sf):
    first = lambda v: F.min(F.when(F.col("z") > v, F.struct("ix", "dist", "z")))
    q = _profile(spark, sf).groupBy("transect_id").agg(first(2).alias("a"), first(6).alias("b"))
    return rounded(q.select("transect_id", F.when(F.col("b.ix") > F.col("a.ix"), (F.col("b.z") - F.col("a.z")) / (F.col("b.dist") - F.col("a.dist"))).alias("slope")))


@query("foreshore_fallback", duck("profile", then=""", q AS (SELECT transect_id, min(ix) FILTER (z > 2) AS i0, min(ix) FILTER (z > 6) AS i1 FROM profile GROUP BY 1)
 SELECT q.transect_id, round(coalesce(CASE WHEN i1 > i0 AND b.z > a.z THEN (b.z - a.z) / (b.dist - a.dist) END, 0.05), 6) AS slope FROM q LEFT JOIN profile a ON a.transect_id = q.transect_id AND a.ix = i0 LEFT JOIN profile b ON b.transect_id = q.transect_id AND b.ix = i1"""))
def foreshore_fallback(spark, sf):
    return foreshore_slope(spark, sf).select("transect_id", F.coalesce(F.when(F.col("slope") > 0, F.col("slope")), F.lit(0.05)).alias("slope"))


@query("intertidal_slope", duck("profile", then=_CR + " SELECT transect_id, round(greatest(2 * 2.1::DOUBLE / nullif(max(position) - min(position), 0), 0.001), 6) AS slope FROM cr GROUP BY 1 HAVING max(position) > min(position)"))
def intertidal_slope(spark, sf):
    c = R.crossings(_profile(spark, sf), _P, 3.0).groupBy("transect_id").agg(F.min("position").alias("a"), F.max("position").alias("b")).filter("b > a")
    return rounded(c.select("transect_id", F.greatest(2 * F.lit(2.1) / (F.col("b") - F.col("a")), F.lit(0.001)).alias("slope")))


@query("profile_compare", duck("profile", then=" SELECT a.transect_id, a.ix, round(b.z - a.z, 6) AS dz FROM profile a JOIN profile b ON b.transect_id = a.transect_id + 1 AND a.ix = b.ix"))
def profile_compare(spark, sf):
    a = _profile(spark, sf)
    b = a.select((F.col("transect_id") - 1).alias("transect_id"), "ix", F.col("z").alias("z2"))
    return rounded(a.join(b, ["transect_id", "ix"]).select("transect_id", "ix", (F.col("z2") - F.col("z")).alias("dz")))


# Projections: all series, at every scenario, percentile and date.

_ST = """, dim AS (SELECT scenario, percentile, make_date(proj_year, 1, 1) AS proj_date, level FROM rsl_dim),
 st AS (SELECT series_id, max(obs_date) AS latest_date, arg_max(value, obs_date) AS latest_distance, (arg_max(value, obs_date) - arg_min(value, obs_date)) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) AS rate, 1.2::DOUBLE AS hist_rslr,
 0.02 + series_id % 7 / 100.0 AS hinterland, 0.015 + series_id % 5 / 100.0 AS shoreface, 12.1::DOUBLE AS depth, CASE WHEN series_id % 3 = 0 THEN 60.0::DOUBLE END AS defence, CASE WHEN series_id % 5 = 0 THEN 70.0::DOUBLE END AS rock FROM obs GROUP BY 1 HAVING min(obs_date) < max(obs_date)),
 lv AS (SELECT scenario, percentile, min(proj_date) AS d1, (list(proj_date ORDER BY proj_date))[2] AS d2, (list(level ORDER BY proj_date))[1] AS l1, (list(level ORDER BY proj_date))[2] AS l2 FROM dim GROUP BY 1, 2),
 b0 AS (SELECT st.*, lv.*, greatest(least(hinterland, shoreface), 0.01) AS s, hist_rslr / 1000 + ((l2 - l1) / (date_diff('day', d1, d2) / 365.2425) - hist_rslr / 1000) * greatest(0, least(1, date_diff('day', (latest_date - INTERVAL 120 MONTH)::DATE, (latest_date - INTERVAL 60 MONTH)::DATE) / date_diff('day', (latest_date - INTERVAL 120 MONTH)::DATE, d2)::DOUBLE)) AS rc FROM st, lv),
 b1 AS (SELECT *, depth * -rate + depth / s * rc AS v FROM b0),
 b2 AS (SELECT b1.*, dim.proj_date, dim.level, date_diff('day', latest_date, dim.proj_date) / 365.2425 AS dt FROM b1 JOIN dim USING (scenario, percentile)),
 b3 AS (SELECT *, latest_distance - (-(level - l1) / s + v * dt / depth) AS raw FROM b2),
 fu AS (SELECT series_id, scenario, percentile, proj_date, level, latest_date, latest_distance, dt, CASE WHEN dt <= 0 THEN latest_distance WHEN defence IS NOT NULL AND raw > defence THEN defence WHEN rock IS NOT NULL AND raw > rock THEN rock ELSE raw END AS distance, -rate AS h FROM b3)"""
_VV = ("obs", "rsl_dim")


def _state(spark, sf):
    obs = view(spark, sf, "obs")
    ends = S.end_point(obs, ["series_id"]).select("series_id", "rate")
    i = F.col("series_id")
    return S.latest(obs, ["series_id"]).join(ends, "series_id").select(
        "series_id", "latest_date", F.col("latest_value").alias("latest_distance"), "rate", F.lit(1.2).alias("hist_rslr"), (0.02 + i % 7 / 100.0).alias("hinterland"), (0.015 + i % 5 / 100.0).alias("shoreface"),
        F.lit(12.1).alias("depth"), F.when(i % 3 == 0, 60.0).alias("defence"), F.when(i % 5 == 0, 70.0).alias("rock"))


def _dim(spark, sf):
    return view(spark, sf, "rsl_dim").select("scenario", "percentile", F.make_date("proj_year", F.lit(1), F.lit(1)).alias("proj_date"), F.col("level").cast("double").alias("level"))


def _future(spark, sf):
    return J.bruun(_state(spark, sf), _dim(spark, sf), ["series_id"])


@query("bruun_predict", duck(*_VV, then=_ST + " SELECT series_id, scenario, percentile, proj_date, round(distance, 6) AS distance, round(CASE WHEN dt > 0 THEN (latest_distance - distance) / dt ELSE h END, 6) AS mean_rate FROM fu"))
def bruun_predict(spark, sf):
    return rounded(_future(spark, sf).select("series_id", "scenario", "percentile", "proj_date", "distance", "mean_rate"))


@query("cross_scenarios", duck(*_VV, then=_ST + " SELECT series_id, scenario, percentile, proj_date, round(level, 9) AS level FROM st, dim"))
def cross_scenarios(spark, sf):
    return rounded(_state(spark, sf).select("series_id").crossJoin(few(_dim(spark, sf))), 9)


@query("calibration_rslr", duck(*_VV, then=_ST + " SELECT series_id, scenario, percentile, round(rc * 1000, 6) AS rate_mm FROM b0"))
def calibration_rslr(spark, sf):
    b = J.with_levels(_state(spark, sf), _dim(spark, sf))
    c = F.col
    rc = J.calibration_rslr(c("latest_date"), c("hist_rslr"), c("second.proj_date"), c("first.level"), c("second.level"), c("first.proj_date"))
    return rounded(b.select("series_id", "scenario", "percentile", (rc * 1000).alias("rate_mm")))


_CHG = """, ch AS (SELECT *, coalesce(lag(distance) OVER w, latest_distance) AS d0, coalesce(lag(proj_date) OVER w, latest_date) AS t0 FROM fu WINDOW w AS (PARTITION BY series_id, scenario, percentile ORDER BY proj_date))"""


@query("future_change", duck(*_VV, then=_ST + _CHG + " SELECT series_id, scenario, percentile, proj_date, round(d0 - distance, 6) AS change, round((d0 - distance) / (date_diff('day', t0, proj_date) / 365.2425), 6) AS period_rate, round(latest_distance - distance, 6) AS total FROM ch"))
def future_change(spark, sf):
    return rounded(J.future_change(_future(spark, sf), ["series_id"]))


@query("future_first_erosion", duck(*_VV, then=_ST + _CHG + " SELECT series_id, scenario, percentile, min(year(proj_date)) FILTER (distance > d0)::INT AS first_year FROM ch GROUP BY 1, 2, 3"))
def future_first_erosion(spark, sf):
    return J.first_erosion(_future(spark, sf), ["series_id"])


@query("future_lookup", duck(*_VV, then=_ST + " SELECT series_id, scenario, percentile, round(distance, 6) AS distance_2050 FROM fu WHERE year(proj_date) = 2050"))
def future_lookup(spark, sf):
    return rounded(_future(spark, sf).filter(F.year("proj_date") == 2050).select("series_id", "scenario", "percentile", F.col("distance").alias("distance_2050")))


@query("future_extrapolate", duck(*_VV, then=_ST + " SELECT series_id, round(rate * (date_diff('day', latest_date, DATE '2050-01-01') / 365.2425), 6) AS extrap_2050, round(rate * (date_diff('day', latest_date, DATE '2100-01-01') / 365.2425), 6) AS extrap_2100 FROM st"))
def future_extrapolate(spark, sf):
    at = lambda y: F.col("rate") * (F.datediff(F.lit(f"{y}-01-01").cast("date"), "latest_date") / J.YEAR)
    return rounded(_state(spark, sf).select("series_id", at(2050).alias("extrap_2050"), at(2100).alias("extrap_2100")))


@query("bruun_range", duck(*_VV, then=_ST + " SELECT series_id, proj_date, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest FROM fu GROUP BY 1, 2"))
def bruun_range(spark, sf):
    return rounded(_future(spark, sf).groupBy("series_id", "proj_date").agg(F.min("distance").alias("nearest"), F.max("distance").alias("farthest")))


@query("sink_future_transects", duck(*_VV, then=_ST + " SELECT series_id, scenario, round(max(distance) FILTER (year(proj_date) = 2050), 6) AS dist_2050, round(max(distance) FILTER (year(proj_date) = 2100), 6) AS dist_2100, round(max(level) FILTER (year(proj_date) = 2050), 6) AS rsl_2050, round(max(level) FILTER (year(proj_date) = 2100), 6) AS rsl_2100 FROM fu WHERE percentile = 50 GROUP BY 1, 2"))
def sink_future_transects(spark, sf):
    p = _future(spark, sf).filter("percentile = 50").withColumn("y", F.year("proj_date")).groupBy("series_id", "scenario").pivot("y", [2050, 2100]).agg(F.max("distance").alias("dist"), F.max("level").alias("rsl"))
    return rounded(p.select("series_id", "scenario", *[F.col(f"{y}_{c}").alias(f"{c}_{y}") for c in ("dist", "rsl") for y in (2050, 2100)]))


_MC = _ST + Y._TWR + f""", sp AS (SELECT scenario, proj_date, max(level) FILTER (percentile = 50) AS mid, (max(level) FILTER (percentile = 95) - max(level) FILTER (percentile = 5)) / (2 * 1.6448536269514722) AS spread FROM dim GROUP BY 1, 2),
 l0 AS (SELECT scenario, min(proj_date) AS d1, (list(proj_date ORDER BY proj_date))[2] AS d2, (list(mid ORDER BY proj_date))[1] AS m1, (list(mid ORDER BY proj_date))[2] AS m2, (list(spread ORDER BY proj_date))[1] AS s1, (list(spread ORDER BY proj_date))[2] AS s2 FROM sp GROUP BY 1),
 ks AS (SELECT st.* EXCLUDE (rate), twr.rate AS fit_rate, rate_se AS se, residual_se AS rse, l0.* FROM st JOIN twr USING (series_id), l0 WHERE rate_se IS NOT NULL),
 sm AS (SELECT *, """ + ", ".join(f"sqrt(-2 * ln({duck_uniform(f'k * 4 + {i}')})) * {f}(2 * pi() * {duck_uniform(f'k * 4 + {i + 1}')}) AS n{n}" for n, i, f in ((0, 0, "cos"), (1, 0, "sin"), (2, 2, "cos"))) + f""" FROM {duck_keys("ks", "series_id", "scenario")}, range(0, 100) r(k)),
 m0 AS (SELECT sm.*, fit_rate + n0 * se AS rk, n1 * rse AS rest, n2 AS z, m1 + n2 * s1 AS l1, m2 + n2 * s2 AS l2, greatest(least(hinterland, shoreface), 0.01) AS s FROM sm),
 m1 AS (SELECT *, hist_rslr / 1000 + ((l2 - l1) / (date_diff('day', d1, d2) / 365.2425) - hist_rslr / 1000) * greatest(0, least(1, date_diff('day', (latest_date - INTERVAL 120 MONTH)::DATE, (latest_date - INTERVAL 60 MONTH)::DATE) / date_diff('day', (latest_date - INTERVAL 120 MONTH)::DATE, d2)::DOUBLE)) AS rc FROM m0),
 m2 AS (SELECT m1.*, sp.proj_date, date_diff('day', latest_date, sp.proj_date) / 365.2425 AS dt, latest_distance - (-(mid + z * spread - l1) / s + (depth * -rk + depth / s * rc) * (date_diff('day', latest_date, sp.proj_date) / 365.2425) / depth) AS raw FROM m1 JOIN sp USING (scenario)),
 mc AS (SELECT series_id, scenario, proj_date, latest_distance, rest + CASE WHEN dt <= 0 THEN latest_distance WHEN defence IS NOT NULL AND raw > defence THEN defence WHEN rock IS NOT NULL AND raw > rock THEN rock ELSE raw END AS d FROM m2)"""


def _sampled(spark, sf, method: str = "TWR"):
    """Percentiles of the sampled projections by the rates of a method."""
    fit = S.rates(view(spark, sf, "obs"), ["series_id"], method).select("series_id", "rate", "rate_se", "residual_se")
    return J.monte_carlo(_state(spark, sf).drop("rate").join(fit, "series_id"), _dim(spark, sf), ["series_id"])


@query("bruun_montecarlo", duck(*_VV, then=_MC + " SELECT series_id, scenario, proj_date, round(quantile_cont(d, 0.025), 4) AS q025, round(quantile_cont(d, 0.16), 4) AS q16, round(quantile_cont(d, 0.5), 4) AS q50, round(quantile_cont(d, 0.84), 4) AS q84, round(quantile_cont(d, 0.975), 4) AS q975 FROM mc GROUP BY 1, 2, 3"))
def bruun_montecarlo(spark, sf):
    q = _sampled(spark, sf)
    return rounded(q.select("series_id", "scenario", "proj_date", *[F.col("q")[i].alias(n) for i, n in enumerate(("q025", "q16", "q50", "q84", "q975"))]), 4)


# Runs along lines of 50 series

_RW = _ST + """, rw AS (SELECT series_id // 200 AS line_id, series_id, latest_distance AS recent, distance, latest_distance * 1.0 AS recent_x, series_id * 10.0 AS recent_y, CASE WHEN series_id % 28 <> 0 THEN distance END AS future_x, CASE WHEN series_id % 28 <> 0 THEN series_id * 10.0 END AS future_y FROM fu WHERE scenario = 8 AND percentile = 50 AND year(proj_date) = 2050)"""


def _rows(spark, sf):
    f = _future(spark, sf).filter((F.col("scenario") == 8) & (F.col("percentile") == 50) & (F.year("proj_date") == 2050))
    has = F.col("series_id") % 28 != 0
    return f.select(F.floor(F.col("series_id") / 200).alias("line_id"), "series_id", F.col("latest_distance").alias("recent"), "distance", F.col("latest_distance").alias("recent_x"), (F.col("series_id") * 10.0).alias("recent_y"), F.when(has, F.col("distance")).alias("future_x"), F.when(has, F.col("series_id") * 10.0).alias("future_y"))


@query("run_islands", duck(*_VV, then=_RW + """, fl AS (SELECT *, future_x IS NOT NULL AND distance > recent AS f FROM rw), g AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY series_id) AS run FROM (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY line_id ORDER BY series_id) THEN 1 ELSE 0 END AS c FROM fl)),
 n AS (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS k FROM g WHERE f) SELECT line_id, run, min(series_id) AS first_id, max(series_id) AS last_id, count(*) AS n FROM n WHERE k >= 2 GROUP BY 1, 2"""))
def run_islands(spark, sf):
    r = U.islands(_rows(spark, sf), ["line_id"], "series_id", F.col("future_x").isNotNull() & (F.col("distance") > F.col("recent")))
    return r.groupBy("line_id", "run").agg(F.min("series_id").alias("first_id"), F.max("series_id").alias("last_id"), F.count("*").alias("n"))


_FL = _RW + """, fg AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY series_id) AS run FROM (SELECT *, future_x IS NOT NULL AS f, CASE WHEN (future_x IS NOT NULL) IS DISTINCT FROM lag(future_x IS NOT NULL) OVER w THEN 1 ELSE 0 END AS c, lag(recent_x) OVER w AS bx, lag(recent_y) OVER w AS by_, lead(recent_x) OVER w AS ax, lead(recent_y) OVER w AS ay FROM rw WINDOW w AS (PARTITION BY line_id ORDER BY series_id))),
 fn AS (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS k, row_number() OVER (PARTITION BY line_id, run ORDER BY series_id) AS i FROM fg WHERE f),
 fv AS (SELECT line_id, run, series_id, 0 AS part, coalesce(bx, recent_x) AS x, coalesce(by_, recent_y) AS y FROM fn WHERE k >= 2 AND i = 1
 UNION ALL SELECT line_id, run, series_id, 1, CASE WHEN distance > recent THEN future_x ELSE recent_x END, CASE WHEN distance > recent THEN future_y ELSE recent_y END FROM fn WHERE k >= 2 AND NOT (i = 1 AND bx IS NULL)
 UNION ALL SELECT line_id, run, series_id, 2, coalesce(ax, recent_x), coalesce(ay, recent_y) FROM fn WHERE k >= 2 AND i = k)"""


@query("future_shorelines", duck(*_VV, then=_FL + " SELECT line_id, run, series_id, part, round(x, 6) AS x, round(y, 6) AS y FROM fv"))
def future_shorelines(spark, sf):
    return rounded(U.future_lines(_rows(spark, sf), ["line_id"], "series_id"))


def _patches(spark, sf):
    rows = U.islands(_rows(spark, sf), ["line_id"], "series_id", F.col("future_x").isNotNull())
    front = rows.select("line_id", "run", F.col("series_id").alias("seq"), F.col("recent_x").alias("x"), F.col("recent_y").alias("y"))
    back = rows.select("line_id", "run", F.col("series_id").alias("seq"), F.col("future_x").alias("x"), F.col("future_y").alias("y"))
    return U.between(front, back, ["line_id", "run"])


_PA = _FL + """, pv AS (SELECT line_id, run, series_id AS seq, recent_x AS x, recent_y AS y FROM fn WHERE k >= 2 UNION ALL SELECT line_id, run, 2000000000 - series_id, future_x, future_y FROM fn WHERE k >= 2)"""


@query("patch_between_lines", duck(*_VV, then=_PA + " SELECT line_id, run, seq, round(x, 6) AS x, round(y, 6) AS y FROM pv"))
def patch_between_lines(spark, sf):
    return rounded(_patches(spark, sf))


@query("eroded_area", duck(*_VV, then=_PA + """ SELECT line_id, run, round(sum(x * y2 - x2 * y) / 2, 4) AS area, count(*) AS n FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM pv WINDOW w AS (PARTITION BY line_id, run ORDER BY seq)) GROUP BY 1, 2"""))
def eroded_area(spark, sf):
    return rounded(U.patch_area(_patches(spark, sf), ["line_id", "run"]), 4)


@query("sink_future_segments", duck(*_VV, then=_RW + """ SELECT line_id, series_id, round((lag(distance) OVER w + distance) / 2, 6) AS from_x, round((lead(distance) OVER w + distance) / 2, 6) AS to_x FROM rw WINDOW w AS (PARTITION BY line_id ORDER BY series_id)"""))
def sink_future_segments(spark, sf):
    from pyspark.sql.window import Window

    w = Window.partitionBy("line_id").orderBy("series_id")
    mid = lambda f: (f("distance").over(w) + F.col("distance")) / 2
    return rounded(_rows(spark, sf).select("line_id", "series_id", mid(F.lag).alias("from_x"), mid(F.lead).alias("to_x")))
