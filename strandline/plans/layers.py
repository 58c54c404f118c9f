"""Registered queries of layers in files, raster stacks, rock head, uncertainty bands, vegetation edges and sinks that write."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.expr import along
from strandline.functions.output import rounded
from strandline.functions.stage import few, new_folder
from strandline.operators import lines as L
from strandline.operators import project as J
from strandline.operators import raster as A
from strandline.operators import runs as U
from strandline.operators import series as S
from strandline.operators import spatial as P
from strandline.plans import geometry as G
from strandline.plans import surfaces as Z
from strandline.plans.registry import query
from strandline.sources.files import base_name, read_layers, write_as_named, write_layers
from strandline.sources.rasters import read_stack, write_stack
from strandline.sources.views import duck, view

K = ["series_id"]

# Raster stacks: the sea-level rasters are written by name and read back by name.

_NAMES = ["scenario", "percentile", "proj_year"]


def _stack(spark, sf, **wanted):
    path = new_folder(spark, "sea-levels")
    write_stack(view(spark, sf, "level_cell"), path, _NAMES)
    return read_stack(spark, path, **wanted)


def _sampled_levels(spark, sf):
    """(series_id, levels) of every series that lies on a cell."""
    return A.sample_stack(view(spark, sf, "series_place"), _stack(spark, sf), K, _NAMES, "level", 0.0, 1000.0, 200.0)


@query("scan_raster_by_name", duck("level_cell", then=" SELECT scenario, percentile, proj_year, count(*) AS n, round(sum(level), 6) AS level, round(max(level), 6) AS highest FROM level_cell WHERE scenario = 8 AND proj_year = 2050 GROUP BY 1, 2, 3"))
def scan_raster_by_name(spark, sf):
    s = _stack(spark, sf, scenario=[8], proj_year=[2050])
    return rounded(s.groupBy(*_NAMES).agg(F.count("*").alias("n"), F.sum("level").alias("level"), F.max("level").alias("highest")))


_SAMPLED = ", pl AS (SELECT series_id, scenario, percentile, proj_year, level FROM series_place JOIN level_cell ON col_ix = floor(x / 200)::BIGINT AND row_ix = floor((1000 - y) / 200)::BIGINT)"


@query("rsl_sample", duck("level_cell", "series_place", then=_SAMPLED + " SELECT series_id, scenario, percentile, proj_year, round(level, 9) AS level FROM pl"))
def rsl_sample(spark, sf):
    return rounded(_sampled_levels(spark, sf).select("series_id", F.explode("levels").alias("v")).select("series_id", "v.*"), 9)


_PLACE = _SAMPLED + (
    Z._ST.replace("dim AS (SELECT scenario, percentile, make_date(proj_year, 1, 1) AS proj_date, level FROM rsl_dim)", "dim AS (SELECT series_id, scenario, percentile, make_date(proj_year, 1, 1) AS proj_date, level FROM pl)")
    .replace("lv AS (SELECT scenario, percentile,", "lv AS (SELECT series_id, scenario, percentile,").replace("FROM dim GROUP BY 1, 2)", "FROM dim GROUP BY 1, 2, 3)")
    .replace("SELECT st.*, lv.*,", "SELECT st.*, lv.* EXCLUDE (series_id),").replace("FROM st, lv)", "FROM st JOIN lv USING (series_id))").replace("JOIN dim USING (scenario, percentile)", "JOIN dim USING (series_id, scenario, percentile)"))


@query("bruun_predict_place", duck("obs", "level_cell", "series_place", then=_PLACE + " SELECT series_id, scenario, percentile, proj_date, round(level, 9) AS level, round(distance, 6) AS distance FROM fu"))
def bruun_predict_place(spark, sf):
    """Projections by the levels of each series' own place."""
    dated = F.transform("levels", lambda v: F.named_struct(F.lit("scenario"), v["scenario"], F.lit("percentile"), v["percentile"], F.lit("proj_date"), F.make_date(v["proj_year"], F.lit(1), F.lit(1)), F.lit("level"), v["level"]))
    base = J.with_sampled_levels(Z._state(spark, sf), _sampled_levels(spark, sf).select("series_id", dated.alias("levels")), K)
    p = J.projected(base, K)
    return p.select("series_id", "scenario", "percentile", "proj_date", F.round("level", 9).alias("level"), F.round("distance", 6).alias("distance"))


# Rock head


@query("rockhead_limit", duck("soft_cell", "rock_transect", "obs", then=""", c0 AS (SELECT t.*, k, k / 49.0::DOUBLE AS part FROM rock_transect t, range(0, 50) r(k)),
 c1 AS (SELECT series_id, start_x, start_y, end_x, end_y, min(k) AS k FROM (SELECT *, start_x + part * (end_x - start_x) AS x, start_y + part * (end_y - start_y) AS y FROM c0) JOIN soft_cell ON col_ix = floor(x / 10)::BIGINT AND row_ix = floor((500 - y) / 10)::BIGINT WHERE v >= 0 AND v < 0.4 GROUP BY 1, 2, 3, 4, 5),
 c2 AS (SELECT *, sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) AS length, greatest(k - 1, 0) / 49.0::DOUBLE AS a, (k + 1) / 49.0::DOUBLE AS b FROM c1 WHERE k < 49),
 c3 AS (SELECT *, unnest(range(0, n)) AS m FROM (SELECT *, greatest(floor((b - a) * length)::BIGINT, 2) AS n FROM c2)),
 c4 AS (SELECT *, a + (b - a) * m / (n - 1) AS part FROM c3),
 c5 AS (SELECT series_id, min(length * part) AS distance FROM (SELECT *, start_x + part * (end_x - start_x) AS x, start_y + part * (end_y - start_y) AS y FROM c4) JOIN soft_cell ON col_ix = floor(x / 10)::BIGINT AND row_ix = floor((500 - y) / 10)::BIGINT WHERE v >= 0 AND v < 0.4 GROUP BY 1)
 SELECT series_id, round(distance, 6) AS rock_distance, round(CASE WHEN recent > distance THEN recent ELSE distance END + 25, 6) AS limit_distance FROM c5 LEFT JOIN (SELECT series_id, arg_max(value, obs_date) AS recent FROM obs GROUP BY 1) USING (series_id)"""))
def rockhead_limit(spark, sf):
    """Where erosion is held: 25 m behind the first rock along a transect, or behind the latest position where that lies past it."""
    found = A.first_below(view(spark, sf, "rock_transect"), view(spark, sf, "soft_cell"), K, 0.4, 0.0, 500.0, 10.0)
    recent = S.latest(view(spark, sf, "obs"), K).select("series_id", F.col("latest_value").alias("recent"))
    limit = F.when(F.col("recent") > F.col("distance"), F.col("recent")).otherwise(F.col("distance")) + 25
    return rounded(found.join(recent, K, "left").select("series_id", F.col("distance").alias("rock_distance"), limit.alias("limit_distance")))


# Bands of uncertainty at the last date, by scenario, from the samples' percentiles

_UB = Z._MC + """, uq AS (SELECT series_id, scenario, any_value(latest_distance) AS recent, quantile_cont(d, 0.025) AS q025, quantile_cont(d, 0.16) AS q16, quantile_cont(d, 0.84) AS q84, quantile_cont(d, 0.975) AS q975 FROM mc WHERE year(proj_date) = 2100 GROUP BY 1, 2),
 ua AS (SELECT st.series_id // 200 AS line_id, st.series_id, s.scenario, i.band, latest_distance AS recent, CASE WHEN i.band = 68 THEN q16 ELSE q025 END AS low, CASE WHEN i.band = 68 THEN q84 ELSE q975 END AS high FROM st, (SELECT DISTINCT scenario FROM dim) s, (VALUES (68), (95)) i(band) LEFT JOIN uq ON uq.series_id = st.series_id AND uq.scenario = s.scenario),
 ub AS (SELECT *, lag(recent) OVER w AS before, lead(recent) OVER w AS after, sum(c) OVER w AS run FROM (SELECT *, low IS NOT NULL AND series_id % 28 <> 0 AS f, CASE WHEN (low IS NOT NULL AND series_id % 28 <> 0) IS DISTINCT FROM lag(low IS NOT NULL AND series_id % 28 <> 0) OVER w THEN 1 ELSE 0 END AS c FROM ua WINDOW w AS (PARTITION BY scenario, band, line_id ORDER BY series_id)) WINDOW w AS (PARTITION BY scenario, band, line_id ORDER BY series_id)),
 uc AS (SELECT *, count(*) OVER (PARTITION BY scenario, band, line_id, run) AS n, row_number() OVER (PARTITION BY scenario, band, line_id, run ORDER BY series_id) AS i FROM ub WHERE f),
 ud AS (SELECT scenario, band, line_id, series_id, 0 AS part, coalesce(before, recent) AS low_x, coalesce(before, recent) AS high_x FROM uc WHERE n >= 2 AND i = 1
 UNION ALL SELECT scenario, band, line_id, series_id, 1, greatest(low, recent), greatest(high, recent) FROM uc WHERE n >= 2
 UNION ALL SELECT scenario, band, line_id, series_id, 2, coalesce(after, recent), coalesce(after, recent) FROM uc WHERE n >= 2 AND i = n)"""


@query("uncertainty_bounds", duck(*Z._VV, then=_UB + " SELECT scenario, band, line_id, series_id, part, round(low_x, 4) AS low_x, round(high_x, 4) AS high_x FROM ud"))
def uncertainty_bounds(spark, sf):
    q = Z._sampled(spark, sf).filter(F.year("proj_date") == 2100)
    band = F.explode(F.array(*[F.struct(F.lit(n).alias("band"), F.col("q")[a].alias("low"), F.col("q")[b].alias("high")) for n, a, b in ((68, 1, 3), (95, 0, 4))]))
    bands = q.select("series_id", "scenario", band.alias("b")).select("series_id", "scenario", "b.*")
    kinds = few(Z._dim(spark, sf).select("scenario").distinct().crossJoin(spark.sql("SELECT band FROM VALUES (68), (95) AS t (band)")))
    rows = Z._state(spark, sf).select("series_id", F.col("latest_distance").alias("recent")).crossJoin(kinds).join(bands, ["series_id", "scenario", "band"], "left")
    y, has = F.col("series_id") * 10.0, F.col("series_id") % 28 != 0
    rows = rows.select("scenario", "band", F.floor(F.col("series_id") / 200).alias("line_id"), "series_id", "recent", F.col("recent").alias("recent_x"), y.alias("recent_y"), "low", "high",
                       F.when(has, F.col("low")).alias("low_x"), y.alias("low_y"), F.when(has, F.col("high")).alias("high_x"), y.alias("high_y"))
    b = U.boundary_lines(rows, ["scenario", "band", "line_id"], "series_id")
    return rounded(b.select("scenario", "band", "line_id", "series_id", "part", "low_x", "high_x"), 4)


# Dated layers in a folder: lines moved by year are written as files, and all else starts from the files.

_YEARS = (1895, 1950, 1985, 2005, 2020)


def _layers(spark, sf):
    path = new_folder(spark, "layers")
    years = F.explode(F.array(*[F.lit(y) for y in _YEARS])).alias("year")
    nodes = G._nodes(spark, sf).select("line_id", "seq", "x", "y", years).withColumn("y", F.col("y") + 60 - (F.col("year") - 1880) / 4.0 + F.col("line_id") % 3)
    nodes = nodes.withColumns({"layer": F.concat(F.lit("MHWS_"), F.col("year").cast("string")), "Date": F.concat(F.col("year").cast("string"), F.lit("-06-01"))})
    write_layers(nodes, "layer", ["Date", "line_id"], path)
    return read_layers(spark, path)


_YEAR_ROWS = ", ".join(f"({y})" for y in _YEARS)


@query("scan_dir_with_source", duck("line_node", then=f" SELECT 'MHWS_' || year || '.geojson' AS source, count(*) AS n, count(DISTINCT line_id) AS n_lines FROM line_node, (VALUES {_YEAR_ROWS}) t(year) GROUP BY 1"))
def scan_dir_with_source(spark, sf):
    """Nodes of every file of a folder of layers, by the name of the file that holds them."""
    return _layers(spark, sf).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct(F.col("properties")["line_id"]).alias("n_lines"))


@query("fn_source_name", duck("line_node", then=f" SELECT 'MHWS_' || year AS name, year::INT AS year, min(line_id) AS first_line FROM line_node, (VALUES {_YEAR_ROWS}) t(year) GROUP BY 1, 2"))
def fn_source_name(spark, sf):
    """Base name and year of each layer's file."""
    name = base_name(F.col("source"))
    return _layers(spark, sf).groupBy(name.alias("name"), F.regexp_extract(name, r"(\d{4})$", 1).cast("int").alias("year")).agg(F.min(F.col("properties")["line_id"].cast("long")).alias("first_line"))


_LAYER_HITS = f""", lay AS (SELECT line_id AS layer_id, seq AS layer_seq, year, x AS bx1, y + 60 - (year - 1880) / 4.0::DOUBLE + line_id % 3 AS by1, x2 AS bx2, y2 + 60 - (year - 1880) / 4.0::DOUBLE + line_id % 3 AS by2 FROM seg, (VALUES {_YEAR_ROWS}) t(year) WHERE x2 IS NOT NULL),
 hx AS (SELECT tr.*, lay.*, (end_x - start_x) * (by2 - by1) - (end_y - start_y) * (bx2 - bx1) AS det FROM tr JOIN lay ON least(start_x, end_x) <= greatest(bx1, bx2) AND greatest(start_x, end_x) >= least(bx1, bx2) AND least(start_y, end_y) <= greatest(by1, by2) AND greatest(start_y, end_y) >= least(by1, by2)),
 hy AS (SELECT *, ((bx1 - start_x) * (by2 - by1) - (by1 - start_y) * (bx2 - bx1)) / det AS t, ((bx1 - start_x) * (end_y - start_y) - (by1 - start_y) * (end_x - start_x)) / det AS u FROM hx WHERE det <> 0),
 hz AS (SELECT *, (start_x + t * (end_x - start_x) - coast_x) * sin(radians(orient)) + (start_y + t * (end_y - start_y) - coast_y) * cos(radians(orient)) AS distance FROM hy WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
 obs AS (SELECT line_id, transect_id, make_date(year::INT, 6, 1) AS obs_date, distance AS value FROM (SELECT *, row_number() OVER (PARTITION BY line_id, transect_id, year ORDER BY round(abs(distance), 6), distance) AS rn FROM hz) WHERE rn = 1)"""


@query("layer_rates", G._sql("""SELECT line_id, transect_id, count(*) AS n, round((arg_max(value, obs_date) - arg_min(value, obs_date)) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25), 5) AS epr,
 round(CASE WHEN count(*) >= 3 THEN regr_slope(value, date_diff('day', DATE '1970-01-01', obs_date)) * 365.25 END, 5) AS ols FROM obs GROUP BY 1, 2 HAVING min(obs_date) < max(obs_date)""", G._TR, _LAYER_HITS))
def layer_rates(spark, sf):
    """From a folder of dated layers to rates: files are read by name, crossed with transects, and each transect's series is fitted."""
    nodes = _layers(spark, sf).select((F.col("properties")["line_id"].cast("long") * 10_000 + F.year(F.to_date(F.col("properties")["Date"]))).alias("line_id"), "seq", "x", "y")
    seg = L.segments(nodes).filter("x2 is not null").select((F.col("line_id") % 10_000).alias("year"), F.col("x").alias("bx1"), F.col("y").alias("by1"), F.col("x2").alias("bx2"), F.col("y2").alias("by2"))
    t = G._transects(spark, sf).select("line_id", "transect_id", "coast_x", "coast_y", "orient", F.col("start_x").alias("ax1"), F.col("start_y").alias("ay1"), F.col("end_x").alias("ax2"), F.col("end_y").alias("ay2"))
    key = ["line_id", "transect_id"]
    hits = P.intersections(t, seg, 200.0).withColumn("distance", along(F.col("ix"), F.col("iy"), F.col("coast_x"), F.col("coast_y"), F.col("orient")))
    near = F.min(F.struct(F.round(F.abs("distance"), 6).alias("a"), F.col("distance").alias("d"))).alias("b")
    obs = hits.groupBy(*key, "year").agg(near).select(*key, F.make_date(F.col("year").cast("int"), F.lit(6), F.lit(1)).alias("obs_date"), F.col("b.d").alias("value"), F.lit(1.0).alias("error"))
    epr, ols = S.end_point(obs, key).select(*key, F.col("rate").alias("epr")), S.least_squares(obs, key).select(*key, F.col("rate").alias("ols"))
    n = obs.groupBy(*key).agg(F.count("*").alias("n"))
    return rounded(n.join(epr, key).join(ols, key, "left").select(*key, "n", "epr", "ols"), 5)


# Vegetation edge: a second series, offset from the first as of its latest date

_VE = Z._ST + """, vl AS (SELECT series_id, max(obs_date) AS obs_date, arg_max(value, obs_date) AS veg FROM veg GROUP BY 1),
 vo AS (SELECT vl.series_id, coalesce((SELECT arg_max(value, o.obs_date) FROM obs o WHERE o.series_id = vl.series_id AND o.obs_date <= vl.obs_date), (SELECT arg_min(value, o.obs_date) FROM obs o WHERE o.series_id = vl.series_id)) - veg AS offs FROM vl),
 ve AS (SELECT fu.*, offs, distance - offs AS veg_distance FROM fu JOIN vo USING (series_id) WHERE offs IS NOT NULL)"""
_VEV = (*Z._VV, "veg")


def _veg(spark, sf):
    offsets = S.offset_of(view(spark, sf, "veg"), view(spark, sf, "obs"), K)
    return Z._future(spark, sf).join(offsets, K).withColumn("distance", F.col("distance") - F.col("offset"))


@query("veg_edge_predict", duck(*_VEV, then=_VE + " SELECT series_id, scenario, percentile, proj_date, round(veg_distance, 6) AS distance FROM ve"))
def veg_edge_predict(spark, sf):
    return rounded(_veg(spark, sf).select("series_id", "scenario", "percentile", "proj_date", "distance"))


_VL = _VE + """, vy AS (SELECT series_id // 200 AS line_id, series_id, year(proj_date)::INT AS year, veg_distance AS x, series_id % 28 <> 0 AS f FROM ve WHERE scenario = 8 AND percentile = 50),
 vr AS (SELECT *, sum(c) OVER (PARTITION BY line_id, year ORDER BY series_id) AS run FROM (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER (PARTITION BY line_id, year ORDER BY series_id) THEN 1 ELSE 0 END AS c FROM vy)),
 vk AS (SELECT *, count(*) OVER (PARTITION BY line_id, year, run) AS k FROM vr WHERE f)"""


def _veg_lines(spark, sf):
    f = _veg(spark, sf).filter((F.col("scenario") == 8) & (F.col("percentile") == 50))
    rows = f.select(F.year("proj_date").alias("year"), F.floor(F.col("series_id") / 200).alias("line_id"), "series_id", F.col("distance").alias("x"), (F.col("series_id") % 28 != 0).alias("has"))
    return U.islands(rows, ["line_id", "year"], "series_id", F.col("has")).select("year", "line_id", "run", "series_id", "x")


@query("veg_edge_lines", duck(*_VEV, then=_VL + " SELECT line_id, run, series_id, round(x, 6) AS x FROM vk WHERE k >= 2 AND year = 2050"))
def veg_edge_lines(spark, sf):
    return rounded(_veg_lines(spark, sf).filter("year = 2050").select("line_id", "run", "series_id", "x"))


@query("sink_future_veg", duck(*_VEV, then=_VL + " SELECT year, line_id, run, series_id, round(x, 6) AS x FROM vk WHERE k >= 2"))
def sink_future_veg(spark, sf):
    """Vegetation-edge lines of every projection year, written as a layer for each year and read back from the files."""
    path = new_folder(spark, "vegetation")
    lines = _veg_lines(spark, sf).select(F.concat(F.lit("VEdge_"), F.col("year").cast("string")).alias("layer"), "line_id", "run", F.col("series_id").alias("seq"), "x", F.col("series_id").cast("double").alias("y"))
    write_layers(lines, "layer", ["line_id", "run"], path)
    p = F.col("properties")
    back = read_layers(spark, path).select(F.regexp_extract("source", r"(\d{4})", 1).cast("int").alias("year"), p["line_id"].cast("long").alias("line_id"), p["run"].cast("long").alias("run"), F.col("y").cast("long").alias("series_id"), "x")
    return rounded(back)


# Sinks that write: forms by the file's ending, partitions replaced one by one, batches appended


@query("sink_transects_dispatch", duck("obs", then=" SELECT 'csv' AS form, series_id, strftime(obs_date, '%Y-%m-%d') AS obs_date, value FROM obs UNION ALL SELECT 'json', series_id, strftime(obs_date, '%Y-%m-%d'), value FROM obs UNION ALL SELECT 'parquet', series_id, strftime(obs_date, '%Y-%m-%d'), value FROM obs"))
def sink_transects_dispatch(spark, sf):
    """Each series with its observations, written flat or nested by the ending of the path, and read back."""
    packed = view(spark, sf, "obs").groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("obs_date", "value"))).alias("positions"))
    out = None
    for form in ("csv", "json", "parquet"):
        back = write_as_named(packed, f"{new_folder(spark, 'transects')}.{form}", "positions")
        if "positions" in back.columns:
            back = back.select("series_id", F.explode("positions").alias("p")).select("series_id", "p.*")
        back = back.select(F.lit(form).alias("form"), "series_id", F.date_format("obs_date", "yyyy-MM-dd").alias("obs_date"), "value")
        out = back if out is None else out.unionByName(back)
    return out


@query("sink_append_counts", duck("storm_in", then=" SELECT scenario, transect_id % 11 AS subcell, count(*) AS n, count(*) FILTER (barrier) AS barriers, round(avg(hs), 6) AS hs FROM storm_in GROUP BY 1, 2"))
def sink_append_counts(spark, sf):
    """Counts of each scenario appended to one table, a batch each, and the whole table read back."""
    path = new_folder(spark, "counts")
    rows = view(spark, sf, "storm_in")
    for scenario in ("H", "M45", "M85", "E45", "E85"):
        rows.filter(F.col("scenario") == scenario).groupBy("scenario", (F.col("transect_id") % 11).alias("subcell")).agg(
            F.count("*").alias("n"), F.count_if("barrier").alias("barriers"), F.avg(F.col("hs").cast("double")).alias("hs")).write.mode("append").parquet(path)
    return rounded(spark.read.parquet(path))


@query("sink_by_scenario_sheets", duck(*Z._VV, then=Z._ST + " SELECT scenario, percentile, series_id, round(distance + CASE WHEN scenario = 8 THEN 1 ELSE 0 END, 6) AS distance FROM fu WHERE year(proj_date) = 2050"))
def sink_by_scenario_sheets(spark, sf):
    """A sheet for each scenario; one is written again with other values, which replaces it alone."""
    path = new_folder(spark, "sheets")
    f = Z._future(spark, sf).filter(F.year("proj_date") == 2050).select("scenario", "percentile", "series_id", "distance")
    write_stack_of = lambda rows: rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scenario").parquet(path)
    write_stack_of(f)
    write_stack_of(f.filter("scenario = 8").withColumn("distance", F.col("distance") + 1))
    return rounded(spark.read.parquet(path).select("scenario", "percentile", "series_id", "distance"))


_ALL_LINES = Z._FL.replace("series_id // 200 AS line_id", "concat_ws('/', scenario, percentile, year(proj_date), series_id // 200) AS line_id").replace(" WHERE scenario = 8 AND percentile = 50 AND year(proj_date) = 2050", "")


@query("sink_future_shorelines", duck(*Z._VV, then=_ALL_LINES + " SELECT split_part(line_id, '/', 1)::INT AS scenario, split_part(line_id, '/', 2)::INT AS percentile, split_part(line_id, '/', 3)::INT AS proj_year, split_part(line_id, '/', 4)::BIGINT AS line_id, run, series_id, part, round(x, 6) AS x, round(y, 6) AS y FROM fv"))
def sink_future_shorelines(spark, sf):
    """Future shorelines of every scenario, percentile and year, a folder each, read back."""
    path = new_folder(spark, "future-shorelines")
    f = Z._future(spark, sf)
    has = F.col("series_id") % 28 != 0
    rows = f.select("scenario", "percentile", F.year("proj_date").alias("proj_year"), F.floor(F.col("series_id") / 200).alias("line_id"), "series_id", F.col("latest_distance").alias("recent"), "distance", F.col("latest_distance").alias("recent_x"),
                    (F.col("series_id") * 10.0).alias("recent_y"), F.when(has, F.col("distance")).alias("future_x"), F.when(has, F.col("series_id") * 10.0).alias("future_y"))
    lines = U.future_lines(rows, [*_NAMES, "line_id"], "series_id")
    lines.repartition(*_NAMES).write.mode("overwrite").partitionBy(*_NAMES).parquet(path)
    return rounded(spark.read.parquet(path).select(*_NAMES, "line_id", "run", "series_id", "part", "x", "y"))
