"""Registered queries composed of other operators: sinks by scenario, bands, lines of features, windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.output import rounded
from strandline.functions.stage import cut, few
from strandline.operators import lines as L
from strandline.operators import profiles as R
from strandline.operators import project as J
from strandline.operators import raster as A
from strandline.operators import runs as U
from strandline.operators import series as S
from strandline.operators import spatial as P
from strandline.operators import transects as T
from strandline.plans import geometry as G
from strandline.plans import surfaces as Z
from strandline.plans.registry import query
from strandline.sources.views import duck, view

K = ["series_id"]


# Projection variants


def _bands(spark, sf, error: float | None):
    """Projections for the rate less, as and plus an error; without one, the uncertainty of the rate itself."""
    s = Z._state(spark, sf)
    if error is None:
        s = s.join(S.end_point(view(spark, sf, "obs"), K).select("series_id", "rate_unc"), K)
    s = s.withColumn("k", F.explode(F.array(*[F.lit(i) for i in (-1, 0, 1)]))).withColumn("rate", F.col("rate") + F.col("k") * (F.col("rate_unc") if error is None else error))
    return J.bruun(s, Z._dim(spark, sf), ["series_id", "k"])


def _band_sql(error: float | None) -> str:
    text = Z._ST.replace("lv AS (SELECT scenario", "st3 AS (SELECT st.* REPLACE (rate + k * %s AS rate), k FROM st, (VALUES (-1), (0), (1)) v(k)),\n lv AS (SELECT scenario" % ("rate_unc" if error is None else error))
    if error is None:
        text = text.replace("1.2::DOUBLE AS hist_rslr", "1.2::DOUBLE AS hist_rslr, sqrt(arg_min(error, obs_date) ** 2 + arg_max(error, obs_date) ** 2) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) AS rate_unc")
    return text.replace("b0 AS (SELECT st.*", "b0 AS (SELECT st3.*").replace("AS rc FROM st, lv)", "AS rc FROM st3, lv)").replace("fu AS (SELECT series_id,", "fu AS (SELECT series_id, k,")


@query("bruun_error_range", duck(*Z._VV, then=_band_sql(0.5) + " SELECT series_id, scenario, percentile, proj_date, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest FROM fu GROUP BY 1, 2, 3, 4"))
def bruun_error_range(spark, sf):
    return rounded(_bands(spark, sf, 0.5).groupBy("series_id", "scenario", "percentile", "proj_date").agg(F.min("distance").alias("nearest"), F.max("distance").alias("farthest")))


@query("bruun_best_worst", duck(*Z._VV, then=_band_sql(1.0) + " SELECT series_id, proj_date, round(min(distance) FILTER (k = -1), 6) AS best, round(max(distance) FILTER (k = 1), 6) AS worst FROM fu GROUP BY 1, 2"))
def bruun_best_worst(spark, sf):
    b = _bands(spark, sf, 1.0).groupBy("series_id", "proj_date")
    return rounded(b.agg(F.min(F.when(F.col("k") == -1, F.col("distance"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("distance"))).alias("worst")))


@query("future_max_rate", duck(*Z._VV, then=Z._ST + Z._CHG + " SELECT series_id, round(max(abs(d0 - distance) / (date_diff('day', t0, proj_date) / 365.2425)), 6) AS max_rate FROM ch GROUP BY 1"))
def future_max_rate(spark, sf):
    return rounded(J.future_change(Z._future(spark, sf), K).groupBy("series_id").agg(F.max(F.abs("period_rate")).alias("max_rate")))


@query("shoreline_bathtub", duck("profile", "rsl_dim", then=""", pr AS (SELECT transect_id, scenario, proj_year, dist, z, level + 2.1 AS lv, lead(z) OVER w AS z2, lead(dist) OVER w AS d2, ix FROM profile, rsl_dim WHERE percentile = 50 AND proj_year IN (2050, 2100) WINDOW w AS (PARTITION BY transect_id, scenario, proj_year ORDER BY ix))
 SELECT transect_id, scenario, proj_year, round(arg_min(dist + abs((lv - z) / (z2 - z)) * (d2 - dist), ix), 6) AS position FROM pr WHERE (z > lv) <> (z2 > lv) AND z <> z2 GROUP BY 1, 2, 3"""))
def shoreline_bathtub(spark, sf):
    dim = view(spark, sf, "rsl_dim").filter("percentile = 50 and proj_year in (2050, 2100)").select("scenario", "proj_year", (F.col("level").cast("double") + 2.1).alias("lv"))
    rows = Z._profile(spark, sf).crossJoin(F.broadcast(dim))
    return rounded(R.crossings(rows, ["transect_id", "scenario", "proj_year"], F.col("lv")).filter("number = 1").select("transect_id", "scenario", "proj_year", "position"))


@query("sink_transect_points", duck("obs", then=" SELECT series_id, strftime(max(obs_date), '%Y-%m-%d') AS baseline, strftime(max(obs_date) - INTERVAL 60 MONTH, '%Y-%m-%d') AS calibration FROM obs GROUP BY 1"))
def sink_transect_points(spark, sf):
    s = S.latest(view(spark, sf, "obs"), K)
    return s.select("series_id", F.date_format("latest_date", "yyyy-MM-dd").alias("baseline"), F.date_format(F.add_months("latest_date", -60), "yyyy-MM-dd").alias("calibration"))


# Lines through runs of transects

_RUNQ = ", fm AS (SELECT line_id, run, series_id, recent, distance, recent_y FROM fn WHERE k >= 2)"


def _runs(spark, sf):
    return U.islands(Z._rows(spark, sf), ["line_id"], "series_id", F.col("future_x").isNotNull())


@query("future_proximity", duck(*Z._VV, then=Z._FL + _RUNQ + " SELECT line_id, run, series_id, round(distance + 10, 6) AS x FROM fm WHERE distance > recent"))
def future_proximity(spark, sf):
    return rounded(_runs(spark, sf).filter("distance > recent").select("line_id", "run", "series_id", (F.col("distance") + 10).alias("x")))


@query("error_lines", duck(*Z._VV, then=_band_sql(None) + """, eb AS (SELECT series_id // 200 AS line_id, series_id, series_id % 28 <> 0 AS f, min(distance) AS low_x, max(distance) AS high_x FROM fu WHERE scenario = 8 AND percentile = 50 AND year(proj_date) = 2050 GROUP BY 1, 2, 3),
 er AS (SELECT *, sum(c) OVER (PARTITION BY line_id ORDER BY series_id) AS run FROM (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY line_id ORDER BY series_id) THEN 1 ELSE 0 END AS c FROM eb)),
 ek AS (SELECT *, count(*) OVER (PARTITION BY line_id, run) AS n FROM er WHERE f) SELECT line_id, run, series_id, round(low_x, 6) AS low_x, round(high_x, 6) AS high_x FROM ek WHERE n >= 2"""))
def error_lines(spark, sf):
    """Lines through the nearest and farthest projection when each rate is off by its own uncertainty."""
    b = _bands(spark, sf, None).filter((F.col("scenario") == 8) & (F.col("percentile") == 50) & (F.year("proj_date") == 2050))
    ends = b.groupBy(F.floor(F.col("series_id") / 200).alias("line_id"), "series_id").agg(F.min("distance").alias("low_x"), F.max("distance").alias("high_x"))
    return rounded(U.islands(ends, ["line_id"], "series_id", F.col("series_id") % 28 != 0).select("line_id", "run", "series_id", "low_x", "high_x"))


@query("erosion_buffer", duck(*Z._VV, then=Z._FL + _RUNQ + ", bv AS (SELECT line_id, run, series_id AS seq, distance AS x, recent_y AS y FROM fm UNION ALL SELECT line_id, run, 2000000000 - series_id, distance + 10, recent_y FROM fm) SELECT line_id, run, round(sum(x * y2 - x2 * y) / 2, 4) AS area FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM bv WINDOW w AS (PARTITION BY line_id, run ORDER BY seq)) GROUP BY 1, 2"))
def erosion_buffer(spark, sf):
    r = _runs(spark, sf)
    front = r.select("line_id", "run", F.col("series_id").alias("seq"), F.col("distance").alias("x"), F.col("recent_y").alias("y"))
    back = r.select("line_id", "run", F.col("series_id").alias("seq"), (F.col("distance") + 10).alias("x"), F.col("recent_y").alias("y"))
    return rounded(U.patch_area(U.between(front, back, ["line_id", "run"]), ["line_id", "run"]).select("line_id", "run", "area"), 4)


@query("range_lines", duck(*Z._VV, then=Z._ST + " SELECT series_id // 200 AS line_id, series_id, round(min(distance), 6) AS low_x, round(max(distance), 6) AS high_x FROM fu WHERE year(proj_date) = 2050 GROUP BY 1, 2"))
def range_lines(spark, sf):
    f = Z._future(spark, sf).filter(F.year("proj_date") == 2050)
    return rounded(f.groupBy(F.floor(F.col("series_id") / 200).alias("line_id"), "series_id").agg(F.min("distance").alias("low_x"), F.max("distance").alias("high_x")))


@query("extreme_lines", duck("profile", then=Z._CR + " SELECT transect_id // 50 AS line_id, transect_id, round(min(position), 6) AS front_x, round(max(position), 6) AS back_x FROM cr GROUP BY 1, 2 HAVING count(*) >= 2"))
def extreme_lines(spark, sf):
    c = R.crossings(Z._profile(spark, sf), ["transect_id"], 3.0).groupBy(F.floor(F.col("transect_id") / 50).alias("line_id"), "transect_id").agg(F.min("position").alias("front_x"), F.max("position").alias("back_x"), F.count("*").alias("n"))
    return rounded(c.filter("n >= 2").drop("n"))


@query("sink_extreme", duck("profile", then=Z._CR + " SELECT transect_id // 50 AS line_id, count(*) AS n, round(sum(w), 6) AS width FROM (SELECT transect_id, max(position) - min(position) AS w FROM cr GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1"))
def sink_extreme(spark, sf):
    c = R.crossings(Z._profile(spark, sf), ["transect_id"], 3.0).groupBy("transect_id").agg((F.max("position") - F.min("position")).alias("w"), F.count("*").alias("n")).filter("n >= 2")
    return rounded(c.groupBy(F.floor(F.col("transect_id") / 50).alias("line_id")).agg(F.count("*").alias("n"), F.sum("w").alias("width")))


# Profiles


@query("profile_sample", duck("raster_cell", "zone_box", then=""", pn AS (SELECT cell_id AS transect_id, ix, xmin + 10 + ix * 9.0::DOUBLE AS x, ymin + 20 + ix * 8.0::DOUBLE AS y FROM zone_box, range(0, 20) r(ix))
 SELECT transect_id, ix, round(arg_min(z, tile), 6) AS z FROM pn JOIN raster_cell ON col_ix = floor(x / 20)::BIGINT AND row_ix = floor((1000 - y) / 20)::BIGINT WHERE z > 0 GROUP BY 1, 2"""))
def profile_sample(spark, sf):
    n = view(spark, sf, "zone_box").withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).select(F.col("cell_id").alias("transect_id"), "ix", (F.col("xmin") + 10 + F.col("ix") * 9.0).alias("x"), (F.col("ymin") + 20 + F.col("ix") * 8.0).alias("y"))
    return rounded(A.sample(n, view(spark, sf, "raster_cell").filter("z > 0"), ["transect_id", "ix"], 0.0, 1000.0, 20.0))


@query("swath_combined", duck("raster_cell", "zone_box", then=Z._CEN + Z._SWT + " SELECT transect_id, floor(along / 20)::BIGINT AS ix, round(sum(z / greatest(dto, 1) ** 2) / sum(1 / greatest(dto, 1) ** 2), 6) AS z, count(*) AS n FROM sw GROUP BY 1, 2"))
def swath_combined(spark, sf):
    w = 1 / F.greatest(F.col("to"), F.lit(1.0)) ** 2
    return rounded(Z._swath(spark, sf).groupBy("transect_id", F.floor(F.col("along") / 20).alias("ix")).agg((F.sum(F.col("z") * w) / F.sum(w)).alias("z"), F.count("*").alias("n")))


@query("point_lookup", duck("profile", then=" SELECT transect_id, round(max(z), 6) AS crest_z, min(dist) FILTER (z = zm) AS crest_dist FROM (SELECT *, max(z) OVER (PARTITION BY transect_id) AS zm FROM profile) GROUP BY 1"))
def point_lookup(spark, sf):
    top = F.max(F.struct("z", (-F.col("dist")).alias("d"))).alias("t")
    return rounded(Z._profile(spark, sf).groupBy("transect_id").agg(top).select("transect_id", F.col("t.z").alias("crest_z"), (-F.col("t.d")).alias("crest_dist")))


@query("profile_unmask", duck("profile", then=" SELECT transect_id, ix, round(z, 6) AS z, CASE WHEN NOT dist BETWEEN 50 AND 200 THEN round(z, 6) + 0 END AS searched FROM profile"))
def profile_unmask(spark, sf):
    """Each node's height, and its height in the search from which 50 to 200 m are masked: the mask is a column, so nothing is lost by it."""
    z = F.round("z", 6)
    return Z._profile(spark, sf).select("transect_id", "ix", z.alias("z"), F.when(~F.col("dist").between(50, 200), z).alias("searched"))


@query("barrier_residuals", duck("profile", then=""", m AS (SELECT *, arg_max(dist, z * 1000000 - ix) OVER p AS dm, max(z) OVER p AS zm, min(dist) OVER p AS d0, arg_min(z, ix) OVER p AS z0 FROM profile WINDOW p AS (PARTITION BY transect_id)),
 r AS (SELECT transect_id, dist, ix, z - z0 - (dist - d0) * (zm - z0) / nullif(dm - d0, 0) AS res FROM m WHERE dist <= dm) SELECT transect_id, round(min(res), 9) AS lowest, round(max(res), 9) AS highest FROM r GROUP BY 1"""))
def barrier_residuals(spark, sf):
    w = Window.partitionBy("transect_id")
    m = Z._profile(spark, sf).withColumns({"top": F.max(F.struct("z", (-F.col("ix")).alias("i"), "dist")).over(w), "low": F.min(F.struct("ix", "dist", "z")).over(w)})
    res = F.col("z") - F.col("low.z") - (F.col("dist") - F.col("low.dist")) * (F.col("top.z") - F.col("low.z")) / F.nullif(F.col("top.dist") - F.col("low.dist"), F.lit(0.0))
    return rounded(m.filter(F.col("dist") <= F.col("top.dist")).groupBy("transect_id").agg(F.min(res).alias("lowest"), F.max(res).alias("highest")), 9)


@query("profile_bins", duck("profile", then=" SELECT transect_id, floor(dist / 25)::BIGINT AS bin, round(avg(z), 9) AS z_mean, count(*) AS n FROM profile WHERE z > 0 GROUP BY 1, 2"))
def profile_bins(spark, sf):
    return rounded(Z._profile(spark, sf).filter("z > 0").groupBy("transect_id", F.floor(F.col("dist") / 25).alias("bin")).agg(F.avg("z").alias("z_mean"), F.count("*").alias("n")), 9)


@query("barrier_detect_simple", duck("profile", then=""", m AS (SELECT *, max(z) OVER p AS hz, arg_max(ix, z * 1000000 - ix) OVER p AS hi, min(ix) OVER p AS i0, max(ix) OVER p AS i1 FROM profile WHERE z > 0 WINDOW p AS (PARTITION BY transect_id)),
 e AS (SELECT transect_id, max(hi) AS hi, max(dist) FILTER (ix = hi) AS hd, max(hz) AS hz, max(dist) FILTER (ix = i0) AS d0, max(z) FILTER (ix = i0) AS z0, max(dist) FILTER (ix = i1) AS d1, max(z) FILTER (ix = i1) AS z1 FROM m GROUP BY 1),
 r AS (SELECT p.transect_id, p.ix, p.dist, CASE WHEN p.ix <= hi THEN z + (d0 - dist) * coalesce((hz - z0) / nullif(hd - d0, 0), 0) END AS fr, CASE WHEN p.ix >= hi THEN z + (d1 - dist) * coalesce((hz - z1) / nullif(hd - d1, 0), 0) END AS br FROM profile p JOIN e USING (transect_id) WHERE z > 0),
 t AS (SELECT transect_id, first(dist ORDER BY fr DESC, ix) FILTER (fr IS NOT NULL) AS ft, first(dist ORDER BY fr, ix) FILTER (fr IS NOT NULL) AS fb, first(dist ORDER BY br DESC, ix) FILTER (br IS NOT NULL) AS bt, first(dist ORDER BY br, ix) FILTER (br IS NOT NULL) AS bb FROM r GROUP BY 1)
 SELECT transect_id, fb AS toe_dist, CASE WHEN ft < fb THEN hd ELSE ft END AS top_dist, hd AS crest_dist, round(hz, 6) AS crest_z, CASE WHEN bt > bb THEN hd ELSE bt END AS back_top_dist, bb AS back_toe_dist FROM t JOIN e USING (transect_id)"""))
def barrier_detect_simple(spark, sf):
    return rounded(R.barriers_simple(Z._profile(spark, sf), ["transect_id"]))


@query("cliff_detect_binned", duck("profile", then=""", b AS (SELECT *, row_number() OVER (PARTITION BY transect_id ORDER BY bin) AS n FROM (SELECT transect_id, floor(dist / 10) AS bin, avg(dist) AS d, avg(z) AS z FROM profile WHERE z IS NOT NULL GROUP BY 1, 2)),
 l AS (SELECT *, min(n) FILTER (z > 0) OVER (PARTITION BY transect_id) AS land FROM b), s AS (SELECT *, min(n) FILTER (n > land AND z <= 0) OVER (PARTITION BY transect_id) AS sea FROM l WHERE n >= land - 5),
 f AS (SELECT *, coalesce(z < lag(z) OVER (PARTITION BY transect_id ORDER BY n), false) AS falls FROM s WHERE sea IS NULL OR n < sea),
 w AS (SELECT *, n - max(n) FILTER (NOT falls) OVER (PARTITION BY transect_id ORDER BY n) AS down FROM f), x AS (SELECT *, min(n) FILTER (down >= 8) OVER (PARTITION BY transect_id) AS stop FROM w),
 k AS (SELECT * FROM x WHERE stop IS NULL OR n < stop), e AS (SELECT transect_id, min(n) AS n0, arg_min(d, n) AS d0, arg_min(z, n) AS z0, arg_max(d, n) AS d1, arg_max(z, n) AS z1 FROM k GROUP BY 1),
 r AS (SELECT k.*, n0, z - (d1 - d) * coalesce((z0 - z1) / nullif(d1 - d0, 0), 0) AS r FROM k JOIN e USING (transect_id)),
 t AS (SELECT transect_id, first(r ORDER BY r DESC, n) FILTER (z <> 0) AS tr, first(d ORDER BY r DESC, n) FILTER (z <> 0) AS td, max(r) FILTER (n = greatest(land - 1, n0)) AS br, max(d) FILTER (n = greatest(land - 1, n0)) AS bd, count(*) AS n_bins FROM r GROUP BY 1)
 SELECT transect_id, round(td, 6) AS top_dist, round(bd, 6) AS toe_dist, round(tr - br, 6) AS height, round(degrees(atan((tr - br) / nullif(abs(td - bd), 0))), 6) AS slope_deg, n_bins FROM t"""))
def cliff_detect_binned(spark, sf):
    return rounded(R.cliffs_binned(Z._profile(spark, sf), ["transect_id"], 10.0))


@query("barrier_extent_map", duck("raster_cell", "zone_box", then=Z._CEN + Z._SWT + " SELECT transect_id, count(*) FILTER (z > 6) AS n_above, round(min(along) FILTER (z > 6), 6) AS first_along, round(max(along) FILTER (z > 6), 6) AS last_along FROM sw GROUP BY 1"))
def barrier_extent_map(spark, sf):
    above = F.when(F.col("z") > 6, F.col("along"))
    return rounded(Z._swath(spark, sf).groupBy("transect_id").agg(F.count(above).alias("n_above"), F.min(above).alias("first_along"), F.max(above).alias("last_along")))


@query("morphology_all")
def morphology_all(spark, sf):
    p = Z._profiles(spark, sf)
    rough = p.filter("z_rough is not null").select("transect_id", "slope_rough", "z_rough", "rocky")
    return rounded(rough.join(Z.barriers(p).select("transect_id", "crest_z", "front_height", "toe_width"), "transect_id", "left"))


def _barriers(spark, sf):
    return Z.barriers(Z._profiles(spark, sf)).withColumn("line_id", F.floor(F.col("transect_id") / 50))


@query("crest_lines")
def crest_lines(spark, sf):
    b = U.islands(_barriers(spark, sf), ["line_id"], "transect_id", F.col("crest_z").isNotNull())
    return rounded(b.select("line_id", "run", "transect_id", "crest_dist", "crest_z"))


@query("barrier_lines")
def barrier_lines(spark, sf):
    b = U.islands(_barriers(spark, sf), ["line_id"], "transect_id", F.col("crest_z").isNotNull())
    return rounded(b.select("line_id", "run", "transect_id", F.col("toe_dist").alias("front_dist"), F.col("back_toe_dist").alias("back_dist")))


@query("cliff_lines")
def cliff_lines(spark, sf):
    c = R.cliffs(view(spark, sf, "cliff_profile"), ["transect_id"]).withColumn("line_id", F.floor(F.col("transect_id") / 50))
    return rounded(U.islands(c, ["line_id"], "transect_id", F.col("height") > 0, least=1).select("line_id", "run", "transect_id", "top_dist", "toe_dist"))


@query("sink_crest_points")
def sink_crest_points(spark, sf):
    return rounded(_barriers(spark, sf).select("line_id", "transect_id", "crest_dist", "crest_z", "toe_width", "volume"))


@query("sink_front_points")
def sink_front_points(spark, sf):
    return rounded(_barriers(spark, sf).select("line_id", "transect_id", "toe_dist", "toe_z", "front_height"))


@query("sink_barrier_table")
def sink_barrier_table(spark, sf):
    return rounded(_barriers(spark, sf).select("transect_id", "toe_z", "crest_z", "back_toe_z"))


@query("sink_dune_params")
def sink_dune_params(spark, sf):
    p = Z._profile(spark, sf).select("transect_id").distinct()
    slopes = Z.foreshore_fallback(spark, sf)
    return rounded(p.join(slopes, "transect_id", "left").join(_barriers(spark, sf).select("transect_id", "toe_z", "crest_z", "toe_dist", "crest_dist"), "transect_id", "left"))


def _barrier_runs(spark, sf):
    """Barriers of runs of two and more transects; a transect without a barrier ends a run."""
    p = Z._profiles(spark, sf)
    every = p.select("transect_id").join(Z.barriers(p), "transect_id", "left").withColumn("line_id", F.floor(F.col("transect_id") / 50))
    return U.islands(every, ["line_id"], "transect_id", F.col("crest_z").isNotNull())


#: A barrier's lines and the pairs of them with a patch between.
_SIDES = {"front_top": "top_dist", "front_toe": "toe_dist", "back_top": "back_top_dist", "back_toe": "back_toe_dist"}
_PATCHES = {"top": ("front_top", "back_top"), "toe": ("front_toe", "back_toe")}


@query("sink_barriers")
def sink_barriers(spark, sf):
    """Vertices of the lines through the tops and toes of runs of barriers, and of the patches between front and back."""
    c, y = F.col, F.col("transect_id") * 10.0
    b = _barrier_runs(spark, sf)
    vertex = lambda kind, seq, d: F.struct(F.lit(kind).alias("kind"), seq.cast("long").alias("seq"), c(d).alias("x"), y.alias("y"))
    seq, back = c("transect_id"), F.lit(2_000_000_000) - c("transect_id")
    lines = [vertex(kind, seq, d) for kind, d in _SIDES.items()]
    # A patch is one line, then the other reversed, as in ``runs.between``.
    patches = [v for kind, (one, two) in _PATCHES.items() for v in (vertex(f"{kind}_patch", seq, _SIDES[one]), vertex(f"{kind}_patch", back, _SIDES[two]))]
    return rounded(b.select("line_id", "run", F.inline(F.array(*lines, *patches))).select("kind", "line_id", "run", "seq", "x", "y"))


def _cliff_pairs(spark, sf):
    """Vertices of the patches between the tops and the toes of runs of cliffs."""
    c = cliff_lines(spark, sf)
    side = lambda d: c.select("line_id", "run", F.col("transect_id").alias("seq"), F.col(d).alias("x"), (F.col("transect_id") * 10.0).alias("y"))
    return U.between(side("top_dist"), side("toe_dist"), ["line_id", "run"])


@query("sink_cliffs")
def sink_cliffs(spark, sf):
    return rounded(_cliff_pairs(spark, sf).select("line_id", "run", "seq", "x", "y"))


@query("sink_crest_lines")
def sink_crest_lines(spark, sf):
    """Vertices of the crest lines of runs of barriers."""
    c = F.col
    return rounded(_barrier_runs(spark, sf).select("line_id", "run", c("transect_id").cast("long").alias("seq"), c("crest_dist").alias("x"), (c("transect_id") * 10.0).alias("y"), c("crest_z").alias("z")))


@query("sink_dune_sis")
def sink_dune_sis(spark, sf):
    """Dune parameters of each transect with water level, regime and asset of each scenario."""
    from strandline.operators import storm as X
    from strandline.plans import cells as C

    water = C._regimes(spark, sf).select("transect_id", "scenario", "twl", "regime", "asset_dist", "asset_elev")
    return rounded(sink_dune_params(spark, sf).join(water.filter(F.col("regime").isin(*X.REGIMES)), "transect_id", "left"))


@query("sink_patches", duck(*Z._VV, then=Z._PA + " SELECT 8 AS scenario, 2050 AS year, line_id, run, count(*) AS n, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x FROM pv GROUP BY ALL"))
def sink_patches(spark, sf):
    fields = Z._patches(spark, sf).withColumns({"scenario": F.lit(8), "year": F.lit(2050)})
    return rounded(fields.groupBy("scenario", "year", "line_id", "run").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.max("x").alias("max_x")))


# Lines and transects


@query("coast_spline", duck("line_node", then=G._CR + " SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY seq, k) - 1 AS seq, round(x, 9) AS x, round(y, 9) AS y FROM cr"))
def coast_spline(spark, sf):
    """Every line of the coast as a curve of points at most 5 m apart."""
    return rounded(L.densify(G._nodes(spark, sf), 5.0).select("line_id", "seq", "x", "y"), 9)


def _spline_sql(tolerance: float, interval: float) -> str:
    """``so``: the weight of bending is found by halving its logarithm; each trial goes through a line's rows with the derivatives of all it makes, whose sum is the squared distance."""
    both = lambda text: ", ".join(text.replace("#", c) for c in "xy")
    return f""", sn AS MATERIALIZED (SELECT *, coalesce(sum(h) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM (
  SELECT line_id, x, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY line_id) AS n, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS h FROM (
   SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM line_node WINDOW v AS (PARTITION BY line_id ORDER BY seq)) WHERE px IS NULL OR px <> x OR py <> y WINDOW w AS (PARTITION BY line_id ORDER BY seq))),
 sl AS MATERIALIZED (SELECT line_id, n, n * {tolerance}::DOUBLE ** 2 AS s, {both("regr_slope(#, u) AS m#, regr_intercept(#, u) AS c#")}, {" + ".join(f"regr_syy({c}, u) - regr_sxy({c}, u) ** 2 / regr_sxx({c}, u)" for c in "xy")} AS res FROM sn WHERE n >= 4 GROUP BY 1, 2),
 sq AS (SELECT *, 1 / h0 AS q0, -1 / h0 - 1 / h AS q1, 1 / h AS q2, {both("(#2 - #) / h - (# - #0) / h0 AS r#")} FROM (SELECT *, lag(h) OVER w AS h0, {both("lag(#) OVER w AS #0, lead(#) OVER w AS #2")} FROM sn WINDOW w AS (PARTITION BY line_id ORDER BY i)) WHERE i > 0 AND i < n - 1),
 sc AS MATERIALIZED (SELECT line_id, i AS cj, (h0 + h) / 3 AS r0, CASE WHEN i < n - 2 THEN h / 6 ELSE 0 END AS r1, q0 ** 2 + q1 ** 2 + q2 ** 2 AS b0, coalesce(q1 * lead(q0) OVER w + q2 * lead(q1) OVER w, 0) AS b1, coalesce(q2 * lead(q0, 2) OVER w, 0) AS b2, rx, ry FROM sq WINDOW w AS (PARTITION BY line_id ORDER BY i)),
 sw AS MATERIALIZED (WITH RECURSIVE w(line_id, s, it, j, lo, hi, d, vd, l1, v1, l2, v2, dp, vdp, l2p, v2p, zx, wx, zy, wy, zxp, wxp, zyp, wyp, acc) AS (SELECT line_id, s, 0, 0::BIGINT, -80.0::DOUBLE, 120.0::DOUBLE, {", ".join(["0.0::DOUBLE"] * 19)} FROM sl WHERE res > s
  UNION ALL SELECT line_id, s, it + (cj IS NULL)::INT, coalesce(cj, 0), CASE WHEN cj IS NULL AND al * al * acc <= s THEN mid ELSE lo END, CASE WHEN cj IS NULL AND al * al * acc > s THEN mid ELSE hi END,
   coalesce(d1, 0), coalesce(vd1, 0), coalesce(l11, 0), coalesce((b1 - vd * l1 * l2 - d * v1 * l2 - d * l1 * v2 - l11 * vd1) / d1, 0), coalesce(l21, 0), coalesce((b2 - l21 * vd1) / d1, 0), CASE WHEN cj IS NULL THEN 0 ELSE d END, CASE WHEN cj IS NULL THEN 0 ELSE vd END, CASE WHEN cj IS NULL THEN 0 ELSE l2 END, CASE WHEN cj IS NULL THEN 0 ELSE v2 END,
   {both("coalesce(z#1, 0), coalesce(w#1, 0)")}, {both("CASE WHEN cj IS NULL THEN 0 ELSE z# END, CASE WHEN cj IS NULL THEN 0 ELSE w# END")},
   coalesce(acc - (2 * (zx1 * wx1 + zy1 * wy1) / d1 - (zx1 ** 2 + zy1 ** 2) * vd1 / d1 ** 2), 0)
  FROM (SELECT *, (r1 + al * b1 - d * l1 * l2) / d1 AS l11, al * b2 / d1 AS l21 FROM (SELECT *, r0 + al * b0 - d * l1 ** 2 - dp * l2p ** 2 AS d1, b0 - vd * l1 ** 2 - 2 * d * l1 * v1 - vdp * l2p ** 2 - 2 * dp * l2p * v2p AS vd1,
   {both("r# - l1 * z# - l2p * z#p AS z#1, - v1 * z# - l1 * w# - v2p * z#p - l2p * w#p AS w#1")} FROM (SELECT w.*, (lo + hi) / 2 AS mid, 2.0::DOUBLE ** ((lo + hi) / 2) AS al, sc.* EXCLUDE (line_id) FROM w LEFT JOIN sc ON sc.line_id = w.line_id AND sc.cj = w.j + 1)))
  WHERE NOT (it = 50 AND cj IS NULL)) SELECT * FROM w WHERE it = 50 AND j > 0),
 sb AS MATERIALIZED (WITH RECURSIVE b(line_id, j, gx, gy, gxn, gyn) AS (SELECT line_id, n - 1, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM sl WHERE res > s
  UNION ALL SELECT b.line_id, sw.j, zx / d - l1 * gx - l2 * gxn, zy / d - l1 * gy - l2 * gyn, gx, gy FROM b JOIN sw ON sw.line_id = b.line_id AND sw.j = b.j - 1) SELECT * FROM b),
 sg AS (SELECT sn.*, res > s AS bends, {both("m# * u + c# AS s#, coalesce(g#, 0) AS g#")}, al FROM sn JOIN sl USING (line_id, n) LEFT JOIN sb ON sb.line_id = sn.line_id AND sb.j = sn.i LEFT JOIN (SELECT DISTINCT line_id, 2.0::DOUBLE ** ((lo + hi) / 2) AS al FROM sw) a ON a.line_id = sn.line_id),
 sf AS (SELECT *, {both("CASE WHEN bends THEN # - al * (coalesce((lead(g#) OVER w - g#) / h, 0) - coalesce((g# - lag(g#) OVER w) / lag(h) OVER w, 0)) ELSE s# END AS f#")} FROM sg WINDOW w AS (PARTITION BY line_id ORDER BY i)),
 se AS (SELECT *, {both("lead(f#) OVER w AS f#2, lead(g#) OVER w AS g#2")}, lead(u) OVER w AS u2, max(CASE WHEN i = 1 THEN u END) OVER (PARTITION BY line_id) AS u1, max(CASE WHEN i = n - 2 THEN u END) OVER (PARTITION BY line_id) AS u9 FROM sf WINDOW w AS (PARTITION BY line_id ORDER BY i)),
 sp AS (SELECT *, u2 - u1 - k * {interval} AS a, u1 + k * {interval} - u AS b FROM (SELECT *, unnest(range(ceil((u - u1) / {interval})::BIGINT, ceil((u2 - u1) / {interval})::BIGINT)) AS k FROM se WHERE i > 0 AND i < n - 2)),
 so AS (SELECT line_id, 1 + k AS seq, {both("(a * f# + b * f#2) / h - a * b / 6 * ((1 + a / h) * g# + (1 + b / h) * g#2) AS #")} FROM sp UNION ALL SELECT line_id, ceil((u9 - u1) / {interval})::BIGINT + 1, fx, fy FROM se WHERE i = n - 1
  UNION ALL SELECT line_id, CASE WHEN i = 0 THEN 0 ELSE ceil((u9 - u1) / {interval})::BIGINT + 2 END, x, y FROM se WHERE i = 0 OR i = n - 1 UNION ALL SELECT line_id, i, x, y FROM sn WHERE n < 4)
 SELECT line_id, seq, round(x, 4) AS x, round(y, 4) AS y FROM so"""


@query("line_smooth_output", duck("line_node", then=_spline_sql(0.5, 1.0)))
def line_smooth_output(spark, sf):
    """A point every metre on the smoothing spline that stays within half a metre of the nodes, as their mean square goes."""
    return rounded(L.smooth_spline(G._nodes(spark, sf), 0.5, 1.0), 4)


_SNAP = """, jn AS (SELECT line_id, seq, x, y + CASE WHEN seq % 10 = 0 AND seq > 0 AND seq < max(seq) OVER (PARTITION BY line_id) THEN 0.05 ELSE 0 END AS y FROM line_node),
 pc AS (SELECT line_id, part, seq, x, y FROM (SELECT DISTINCT line_id, seq // 10 AS part FROM line_node) JOIN jn USING (line_id) WHERE seq BETWEEN part * 10 AND part * 10 + 10),
 ch AS (WITH RECURSIVE w(line_id, part, lo, hi) AS (SELECT line_id, part, min(seq), max(seq) FROM pc GROUP BY 1, 2 UNION ALL
  SELECT line_id, part, CASE k WHEN 0 THEN lo ELSE seq END, CASE k WHEN 0 THEN seq ELSE hi END FROM (SELECT *, row_number() OVER (PARTITION BY line_id, part, lo ORDER BY d DESC, seq) AS r FROM (
   SELECT *, sqrt((px - f * dx) ** 2 + (py - f * dy) ** 2) AS d FROM (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx ** 2 + dy ** 2))) END AS f FROM (
    SELECT w.*, n.seq, n.x - a.x AS px, n.y - a.y AS py, b.x - a.x AS dx, b.y - a.y AS dy FROM w JOIN pc a ON a.line_id = w.line_id AND a.part = w.part AND a.seq = w.lo JOIN pc b ON b.line_id = w.line_id AND b.part = w.part AND b.seq = w.hi
    JOIN pc n ON n.line_id = w.line_id AND n.part = w.part AND n.seq > w.lo AND n.seq < w.hi)))), (VALUES (0), (1)) v(k) WHERE r = 1 AND d > 0.2) SELECT * FROM w),
 kp AS (SELECT line_id, lo AS seq FROM ch UNION SELECT line_id, hi FROM ch)"""


@query("line_merge_snap", duck("line_node", then=_SNAP + " SELECT line_id::BIGINT * 1000000000 AS chain_id, row_number() OVER (PARTITION BY line_id ORDER BY seq) - 1 AS seq, x, round(y, 6) AS y FROM jn JOIN kp USING (line_id, seq)"))
def line_merge_snap(spark, sf):
    """Pieces of ten segments, each begun 5 cm beside the end of the one before, simplified and joined again where they begin."""
    n = G._nodes(spark, sf).withColumn("part", F.floor(F.col("seq") / 10))
    ends = n.filter((F.col("seq") % 10 == 0) & (F.col("seq") > 0)).withColumn("part", F.col("part") - 1)
    cut = n.withColumn("y", F.when((F.col("seq") % 10 == 0) & (F.col("seq") > 0), F.col("y") + 0.05).otherwise(F.col("y"))).unionByName(ends)
    cut = cut.select((F.col("line_id").cast("long") * G.PIECES + F.col("part")).alias("line_id"), (F.col("seq") - F.col("part") * 10).alias("seq"), "x", "y")
    whole = cut.groupBy("line_id").agg(F.count("*").alias("n")).filter("n > 1").select("line_id")
    return rounded(L.merge_snap(cut.join(whole, "line_id"), 0.1).select("chain_id", "seq", "x", "y"))


_BOX = """, sg AS (SELECT line_id, transect_id, orient, line_id::BIGINT * 1000000000 + transect_id AS sid, coast_x, coast_y - start_y + (start_y + 1e9) % 1000 AS coast_y, start_x AS x1, (start_y + 1e9) % 1000 AS y1, end_x - start_x AS dx, end_y - start_y AS dy FROM tr),
 sd AS (SELECT *, CASE WHEN abs(dx) > 1e-6 THEN least((xmin - x1) / dx, (xmax - x1) / dx) WHEN x1 >= xmin AND x1 < xmax THEN 0 ELSE 2 END AS tx0, CASE WHEN abs(dx) > 1e-6 THEN greatest((xmin - x1) / dx, (xmax - x1) / dx) ELSE 1 END AS tx1,
  CASE WHEN abs(dy) > 1e-6 THEN least((ymin - y1) / dy, (ymax - y1) / dy) WHEN y1 >= ymin AND y1 < ymax THEN 0 ELSE 2 END AS ty0, CASE WHEN abs(dy) > 1e-6 THEN greatest((ymin - y1) / dy, (ymax - y1) / dy) ELSE 1 END AS ty1 FROM sg, cell_box),
 tt AS (SELECT *, greatest(0, tx0, ty0) AS t0, least(1, tx1, ty1) AS t1 FROM sd),
 nr AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY round(sqrt((x1 + (t0 + t1) / 2 * dx - coast_x) ** 2 + (y1 + (t0 + t1) / 2 * dy - coast_y) ** 2), 6), cell_id, t0) AS rn FROM tt WHERE t1 > t0 + 1e-9),
 nw AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY transect_id) - 1 AS number, x1 + t0 * dx - sin(radians(orient)) AS start_x, y1 + t0 * dy - cos(radians(orient)) AS start_y, x1 + t1 * dx + sin(radians(orient)) AS end_x, y1 + t1 * dy + cos(radians(orient)) AS end_y FROM nr WHERE rn = 1)"""


@query("transect_clip_polygon", G._sql(f"SELECT sid, cell_id, number, {G._r('t0', 't1', 'start_x', 'start_y', 'end_x', 'end_y')} FROM nw", G._TR, _BOX, views=("line_node", "cell_box")))
def transect_clip_polygon(spark, sf):
    """Each transect cut to its part in a polygon that is nearest the coast, and a metre longer at both ends; those in no polygon are left out."""
    c = F.col
    y1 = (c("start_y") + F.lit(1e9)) % 1000
    t = G._transects(spark, sf).withColumn("sid", c("line_id").cast("long") * G.PIECES + c("transect_id"))
    t = t.withColumns({"start_y": y1, "end_y": y1 + c("end_y") - c("start_y"), "coast_y": c("coast_y") - c("start_y") + y1})
    seg = t.select("sid", c("start_x").alias("ax1"), c("start_y").alias("ay1"), c("end_x").alias("ax2"), c("end_y").alias("ay2"))
    pieces = P.clip_segments(seg, "sid", G._edges(spark, sf), "cell_id", 200.0).filter("t1 > t0 + 1e-9")
    return rounded(T.nearest_part(t, "sid", pieces, "cell_id", 1.0).select("sid", "cell_id", c("number").cast("long").alias("number"), "t0", "t1", *G._TRC[2:]))


@query("lines_clip_polygon", duck("line_node", "cell_box", then=G._SEG + ", md AS (SELECT line_id, seq, (x + x2) / 2 AS mx, ((y + y2) / 2 + 1e9) % 1000 AS my, length FROM seg WHERE x2 IS NOT NULL) SELECT line_id, cell_id, count(*) AS n, round(sum(length), 6) AS length FROM md JOIN cell_box ON mx >= xmin AND mx < xmax AND my >= ymin AND my < ymax GROUP BY 1, 2"))
def lines_clip_polygon(spark, sf):
    seg = L.segments(G._nodes(spark, sf)).filter("x2 is not null").select(F.col("line_id"), F.concat_ws(":", "line_id", "seq").alias("sid"), ((F.col("x") + F.col("x2")) / 2).alias("x"), (((F.col("y") + F.col("y2")) / 2 + F.lit(1e9)) % 1000).alias("y"), "length")
    inside = P.in_polygon(seg, "sid", G._edges(spark, sf), "cell_id", 200.0)
    return rounded(seg.join(inside, "sid").groupBy("line_id", "cell_id").agg(F.count("*").alias("n"), F.sum("length").alias("length")))


@query("transect_from_contour", G._sql("""SELECT site_id, round(min(sqrt((px - (x + t * (x2 - x))) ** 2 + (py - (y + t * (y2 - y))) ** 2)), 6) AS length FROM (SELECT p.site_id, p.x AS px, p.y AS py, s.*, greatest(0, least(1, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / s.length ** 2)) AS t FROM site_point p, seg s WHERE s.length > 0) GROUP BY 1""", views=("line_node", "site_point")))
def transect_from_contour(spark, sf):
    seg = L.segments(G._nodes(spark, sf)).filter("length > 0").select(F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    near = P.nearest_segment(view(spark, sf, "site_point"), "site_id", seg, 100.0, 1e6)
    return rounded(near.select("site_id", F.col("distance").alias("length")))


@query("extract_contours", G._sql("""SELECT site_id, level, round(min(sqrt((px - (x + t * (x2 - x))) ** 2 + (py - (y + t * (y2 - y))) ** 2)), 6) AS distance FROM (SELECT p.site_id, p.x AS px, p.y AS py, s.line_id % 2 AS level, s.*, greatest(0, least(1, ((p.x - s.x) * (s.x2 - s.x) + (p.y - s.y) * (s.y2 - s.y)) / s.length ** 2)) AS t FROM site_point p, seg s WHERE s.length > 0) GROUP BY 1, 2""", views=("line_node", "site_point")))
def extract_contours(spark, sf):
    seg = L.segments(G._nodes(spark, sf)).filter("length > 0").select((F.col("line_id") % 2).alias("level"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    p = view(spark, sf, "site_point")
    parts = [P.nearest_segment(p, "site_id", seg.filter(F.col("level") == v), 100.0, 1e6).withColumn("level", F.lit(v).cast("long")) for v in (0, 1)]
    return rounded(parts[0].unionByName(parts[1]).select("site_id", "level", "distance"))


@query("transect_extend_to_line", G._sql("SELECT line_id, transect_id, round(coalesce(arg_min(ix, round(t, 9)), any_value(tr.start_x)), 6) AS start_x, round(coalesce(arg_min(iy, round(t, 9)), any_value(tr.start_y)), 6) AS start_y FROM tr LEFT JOIN (SELECT line_id, transect_id, t, ix, iy FROM hit) h USING (line_id, transect_id) GROUP BY 1, 2", G._TR, G._HIT))
def transect_extend_to_line(spark, sf):
    t = F.round("t", 9)
    h = G._hits(spark, sf).groupBy(*G._K).agg(F.min_by("ix", t).alias("hx"), F.min_by("iy", t).alias("hy"))
    j = G._transects(spark, sf).join(h, G._K, "left")
    return rounded(j.select(*G._K, F.coalesce("hx", "start_x").alias("start_x"), F.coalesce("hy", "start_y").alias("start_y")))


_NEAR = """, nt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(d, 6), line_id, transect_id) AS rn FROM (SELECT *, sqrt((x - start_x - t * (end_x - start_x)) ** 2 + (y - start_y - t * (end_y - start_y)) ** 2) AS d FROM (
 SELECT site_id, x, y, tr.* EXCLUDE (coast_x, coast_y), greatest(0, least(1, ((x - start_x) * (end_x - start_x) + (y - start_y) * (end_y - start_y)) / ((end_x - start_x) ** 2 + (end_y - start_y) ** 2))) AS t FROM site_point, tr)) WHERE d <= 200) WHERE rn = 1),
 oc AS (SELECT line_id, transect_id, obs_date, distance AS change FROM (SELECT *, row_number() OVER (PARTITION BY line_id, transect_id ORDER BY round(abs(distance), 6), obs_date, distance) AS rn FROM hit) WHERE rn = 1)"""


@query("nearest_transect_200m", G._sql("SELECT site_id, line_id, transect_id, round(d, 6) AS distance, round(orient, 6) AS orient, obs_date, round(change, 6) AS change FROM site_point LEFT JOIN nt USING (site_id) LEFT JOIN oc USING (line_id, transect_id)", G._TR, G._HIT, _NEAR, views=("line_node", "site_point")))
def nearest_transect_200m(spark, sf):
    """The older transect nearest to each site, if one is within 200 m of it, with its orientation and the older shoreline on it that is nearest its coast."""
    k, t = G._K, cut(G._transects(spark, sf))
    seg = t.select(*k, F.col("start_x").alias("x1"), F.col("start_y").alias("y1"), F.col("end_x").alias("x2"), F.col("end_y").alias("y2"))
    sites = view(spark, sf, "site_point").select("site_id", "x", "y")
    near = cut(P.nearest_segment(sites, "site_id", seg, 100.0, 200.0, ids=k).select("site_id", *k, "distance"))
    own = t.join(few(near.select(*k).distinct()), k)
    first = F.min(F.struct(F.round(F.abs("distance"), 6).alias("a"), "obs_date", "distance")).alias("b")
    change = G._hits(spark, sf, transects=own).groupBy(*k).agg(first).select(*k, "b.obs_date", F.col("b.distance").alias("change"))
    found = near.join(own.select(*k, "orient"), k).join(change, k, "left")
    return rounded(sites.select("site_id").join(found, "site_id", "left").select("site_id", *k, "distance", "orient", "obs_date", "change"))


def _spaced(spacing: float) -> str:
    return G._pts(spacing) + f", tr AS (SELECT line_id, seq AS transect_id, x AS coast_x, y AS coast_y, x + 100.0 * sin(radians(bearing - 90)) AS start_x, y + 100.0 * cos(radians(bearing - 90)) AS start_y, x + 100.0 * sin(radians(bearing + 90)) AS end_x, y + 100.0 * cos(radians(bearing + 90)) AS end_y, (bearing + 90) % 360 AS orient FROM pts)"


@query("foreshore_width", G._sql("SELECT line_id, transect_id, round(max(distance) - min(distance), 6) AS width FROM hit GROUP BY 1, 2 HAVING count(*) > 1", _spaced(500.0), G._HIT))
def foreshore_width(spark, sf):
    t = T.generate(G._nodes(spark, sf), 500.0, 100.0, 100.0).select("line_id", "transect_id", "coast_x", "coast_y", "orient", F.col("start_x").alias("ax1"), F.col("start_y").alias("ay1"), F.col("end_x").alias("ax2"), F.col("end_y").alias("ay2"))
    from strandline.functions.expr import along

    c = F.col
    h = P.intersections(t, G._shifted(spark, sf), 200.0).withColumn("distance", along(c("ix"), c("iy"), c("coast_x"), c("coast_y"), c("orient")))
    g = h.groupBy(*G._K).agg((F.max("distance") - F.min("distance")).alias("width"), F.count("*").alias("n"))
    return rounded(g.filter("n > 1").drop("n"))


@query("coast_segments_1km", G._sql("SELECT line_id, seq, round(x, 6) AS x, round(y, 6) AS y FROM pts", G._pts(1000.0)))
def coast_segments_1km(spark, sf):
    return rounded(L.points(G._nodes(spark, sf), 1000.0, keep_ends=False).select("line_id", "seq", "x", "y"))


_SIMPLE = """, ln AS (SELECT line_id, seq, x + CASE seq % 6 WHEN 3 THEN 60 WHEN 4 THEN -45 ELSE 0 END AS x, y FROM line_node),
 sg AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy FROM ln WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
 cr AS (SELECT line_id, a + t AS f, b + u AS g, x + t * dx AS x, y + t * dy AS y FROM (SELECT a.line_id, a.seq AS a, b.seq AS b, a.x, a.y, a.dx, a.dy, ((b.x - a.x) * b.dy - (b.y - a.y) * b.dx) / nullif(a.dx * b.dy - a.dy * b.dx, 0) AS t, ((b.x - a.x) * a.dy - (b.y - a.y) * a.dx) / nullif(a.dx * b.dy - a.dy * b.dx, 0) AS u
  FROM sg a JOIN sg b ON a.line_id = b.line_id AND b.seq > a.seq + 1) WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 lp AS (WITH RECURSIVE w(line_id, f, g, x, y) AS (SELECT DISTINCT line_id, -1.0::DOUBLE, -1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM ln UNION ALL
  SELECT line_id, f, g, x, y FROM (SELECT cr.*, row_number() OVER (PARTITION BY cr.line_id ORDER BY cr.f, cr.g DESC) AS r FROM w JOIN cr ON cr.line_id = w.line_id AND cr.f >= w.g) WHERE r = 1) SELECT * FROM w WHERE f >= 0),
 st AS (SELECT line_id, seq::DOUBLE AS pos, x, y FROM ln WHERE NOT EXISTS (SELECT 1 FROM lp WHERE lp.line_id = ln.line_id AND lp.f < ln.seq AND ln.seq <= lp.g) UNION ALL SELECT line_id, f, x, y FROM lp WHERE f > floor(f))"""


@query("line_make_simple", duck("line_node", then=_SIMPLE + " SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY pos) - 1 AS seq, round(x, 6) AS x, round(y, 6) AS y FROM st"))
def line_make_simple(spark, sf):
    # Every sixth node stands ahead of the one after it, so lines run back and cross themselves.
    back = F.when(F.col("seq") % 6 == 3, 60).when(F.col("seq") % 6 == 4, -45).otherwise(0)
    return rounded(L.make_simple(G._nodes(spark, sf).withColumn("x", F.col("x") + back), 200.0))


# Scalars


@query("fn_round3", duck("obs", then=" SELECT series_id, round(avg(value), 3) AS mean3 FROM obs GROUP BY 1"))
def fn_round3(spark, sf):
    return rounded(view(spark, sf, "obs").groupBy("series_id").agg(F.avg("value").alias("mean3")), 3)


@query("fn_round5", duck("storm_in", then=" SELECT transect_id, scenario, (round_even(asset_dist / 5, 0) * 5)::DOUBLE AS round5 FROM storm_in"))
def fn_round5(spark, sf):
    return view(spark, sf, "storm_in").select("transect_id", "scenario", (F.bround((F.col("asset_dist") / 5).cast("double"), 0) * 5).alias("round5"))
