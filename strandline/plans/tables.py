"""Registered source, sink, scalar, set and streaming queries."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.output import rounded
from strandline.functions.reproject import to_wgs84
from strandline.functions.stage import new_folder, shared_folder
from strandline.operators import lines as L
from strandline.operators import series as S
from strandline.plans.registry import query
from strandline.sources.files import lines_as_features, read_layers, require, write_layers
from strandline.sources.views import duck, table_stream, view
from strandline.streaming import observations as O


@query("scan_dates", duck("obs", then=" SELECT source, min(obs_date) AS first_date, max(obs_date) AS last_date, count(DISTINCT obs_date) AS n_dates FROM obs GROUP BY 1"))
def scan_dates(spark, sf):
    rows = require(view(spark, sf, "obs"), ["obs_date", "source"]).withColumn("obs_date", F.to_date(F.col("obs_date").cast("string"), "yyyy-MM-dd"))
    return rows.groupBy("source").agg(F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"), F.countDistinct("obs_date").alias("n_dates"))


@query("scan_points_attr", duck("site_point", then=" SELECT site_id, round(x, 6) AS x, round(y, 6) AS y, label FROM site_point WHERE label IS NOT NULL"))
def scan_points_attr(spark, sf):
    return rounded(view(spark, sf, "site_point").filter("label is not null"))


@query("scan_multipart_flatten", duck("line_node", then=" SELECT line_id, seq // 20 AS part, count(*) AS n FROM line_node GROUP BY 1, 2"))
def scan_multipart_flatten(spark, sf):
    parts = view(spark, sf, "line_node").withColumn("part", F.floor(F.col("seq") / 20)).groupBy("line_id", "part").agg(F.collect_list(F.struct("seq", "x", "y")).alias("line"))
    multi = parts.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("part", "line"))).alias("lines"))
    flat = multi.select("line_id", F.explode("lines").alias("l")).filter(F.col("l.line").isNotNull()).select("line_id", "l.part", F.explode("l.line").alias("node"))
    return flat.groupBy("line_id", "part").agg(F.count("*").alias("n"))


@query("scan_ascii_grid", duck("raster_cell", then=" SELECT col_ix::INT AS col_ix, row_ix::INT AS row_ix, round((col_ix + 0.5) * 5, 6) AS x, round((50 - row_ix - 0.5) * 5, 6) AS y, round(max(z), 6) AS z FROM raster_cell GROUP BY ALL"))
def scan_ascii_grid(spark, sf):
    """The raster's tiles written as ASCII grids of 50 by 22 cells and read back; where tiles overlap, the highest cell."""
    import uuid

    from strandline.functions.stage import shared_folder
    from strandline.sources.files import read_ascii_grid

    cells = view(spark, sf, "raster_cell")
    ix = lambda first, n: F.explode(F.sequence(first, first + n - 1))
    whole = cells.select("tile").distinct().select("tile", ix(F.lit(0).cast("long"), 50).alias("row_ix")).select("tile", "row_ix", ix(F.col("tile") * 20, 22).alias("col_ix"))
    values = whole.join(cells, ["tile", "row_ix", "col_ix"], "left").groupBy("tile", "row_ix").agg(F.array_sort(F.collect_list(F.struct("col_ix", F.coalesce("z", F.lit(-9999.0)).cast("string").alias("v")))).alias("c"))
    text = values.groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("row_ix", F.array_join("c.v", " ").alias("line")))).alias("r"))
    head = F.format_string("ncols 22\nnrows 50\nxllcorner %d\nyllcorner 0\ncellsize 5\nNODATA_value -9999\n", F.col("tile") * 100)
    path = f"{shared_folder(spark)}/strandline-tables/{spark.sparkContext.applicationId}/grids-{uuid.uuid4().hex}"
    text.select("tile", F.concat(head, F.array_join("r.line", "\n")).alias("value")).repartition("tile").write.partitionBy("tile").text(path)
    return rounded(read_ascii_grid(spark, path).groupBy(F.floor(F.col("x") / 5).cast("int").alias("col_ix"), "row_ix", "x", "y").agg(F.max("z").alias("z")))


# Sinks give the rows that are written.


@query("sink_lines", duck("line_node", then=" SELECT line_id, seq::INT AS seq, x, round(y, 6) AS y FROM line_node"))
def sink_lines(spark, sf):
    """All lines written as one layer of features and read back from its file."""
    path = new_folder(spark, "lines")
    write_layers(view(spark, sf, "line_node").withColumn("layer", F.lit("lines")), "layer", ["line_id"], path)
    return rounded(read_layers(spark, path).select(F.col("properties")["line_id"].cast("int").alias("line_id"), "seq", "x", "y"))


_EPR = "SELECT series_id, count(*) AS n, arg_max(value, obs_date) AS latest_value, (arg_max(value, obs_date) - arg_min(value, obs_date)) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) AS epr FROM obs GROUP BY 1 HAVING min(obs_date) < max(obs_date)"


@query("sink_transects_flat", duck("obs", then=f" SELECT series_id, n, latest_value, round(epr, 6) AS epr FROM ({_EPR})"))
def sink_transects_flat(spark, sf):
    obs = view(spark, sf, "obs")
    return rounded(S.latest(obs, ["series_id"]).join(S.end_point(obs, ["series_id"]), "series_id").select("series_id", "n", "latest_value", F.col("rate").alias("epr")))


@query("sink_transects_nested", duck("obs", then=" SELECT series_id, count(*) AS n, round(sum(value), 6) AS total FROM obs GROUP BY 1"))
def sink_transects_nested(spark, sf):
    packed = view(spark, sf, "obs").groupBy("series_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("obs_date", F.nanvl("value", F.lit(None).cast("double")).alias("value"))))).alias("json"))
    back = F.from_json("json", "array<struct<obs_date: date, value: double>>")
    return rounded(packed.select("series_id", F.size(back).cast("long").alias("n"), F.aggregate(back, F.lit(0.0), lambda s, o: s + o["value"]).alias("total")))


@query("sink_rate_points", duck("obs", then=f" SELECT series_id, round(epr, 6) AS epr, round(ols, 6) AS ols FROM ({_EPR}) LEFT JOIN (SELECT series_id, regr_slope(value, date_diff('day', DATE '1970-01-01', obs_date)) * 365.25 AS ols FROM obs GROUP BY 1 HAVING count(*) >= 3) USING (series_id)"))
def sink_rate_points(spark, sf):
    obs, k = view(spark, sf, "obs"), ["series_id"]
    both = S.end_point(obs, k).select("series_id", F.lit("epr").alias("m"), "rate").unionByName(S.least_squares(obs, k).select("series_id", F.lit("ols").alias("m"), "rate"))
    return rounded(both.groupBy("series_id").pivot("m", ["epr", "ols"]).agg(F.first("rate")).filter("epr is not null"))


@query("sink_storm_transects", duck("storm_in", then=" SELECT transect_id, " + ", ".join(f"round(max(hs) FILTER (scenario = '{s}'), 6) AS hs_{s.lower()}" for s in ("H", "M45", "M85", "E45", "E85")) + " FROM storm_in GROUP BY 1"))
def sink_storm_transects(spark, sf):
    p = view(spark, sf, "storm_in").withColumn("hs", F.col("hs").cast("double")).groupBy("transect_id").pivot("scenario", ["H", "M45", "M85", "E45", "E85"]).agg(F.max("hs"))
    return rounded(p.select("transect_id", *[F.col(s).alias(f"hs_{s.lower()}") for s in ("H", "M45", "M85", "E45", "E85")]))


@query("sink_points", duck("line_node", then=" SELECT line_id, seq, x, round(y, 6) AS y FROM line_node"))
def sink_points(spark, sf):
    return rounded(view(spark, sf, "line_node").select("line_id", "seq", "x", "y"))


@query("sink_profile_csv", duck("profile", then=" SELECT transect_id, ix, dist, round(z, 6) AS z FROM profile"))
def sink_profile_csv(spark, sf):
    csv = view(spark, sf, "profile").select(F.to_csv(F.struct("transect_id", "ix", "dist", "z")).alias("row"))
    back = csv.select(F.from_csv("row", "transect_id long, ix long, dist double, z double").alias("r")).select("r.*")
    return rounded(back)


@query("sink_slope_table", duck("profile", then=" SELECT transect_id, round(regr_slope(z, dist), 6) AS slope FROM profile GROUP BY 1"))
def sink_slope_table(spark, sf):
    return rounded(view(spark, sf, "profile").groupBy("transect_id").agg(F.regr_slope("z", "dist").alias("slope")))


@query("stage_checkpoint", duck("obs", then=" SELECT series_id, count(*) AS n FROM obs GROUP BY 1"))
def stage_checkpoint(spark, sf):
    from strandline.functions.stage import cut

    return cut(view(spark, sf, "obs")).groupBy("series_id").agg(F.count("*").alias("n"))


# From the national grid to longitude and latitude on WGS84

_LL = """,
 c AS (SELECT *, 6377563.396::DOUBLE AS a, 6356256.909::DOUBLE AS b, 0.9996012717::DOUBLE AS f0, radians(49::DOUBLE) AS lat0, radians(-2::DOUBLE) AS lon0 FROM p), n AS (SELECT *, (a - b) / (a + b) AS n, 1 - b * b / (a * a) AS e2 FROM c),
 l0 AS (SELECT *, lat0 + (y + 100000) / (a * f0) AS lat FROM n)""" + "".join(f""",
 l{i + 1} AS (SELECT * REPLACE (lat + (y + 100000 - b * f0 * ((1 + n + 1.25 * n ** 2 + 1.25 * n ** 3) * (lat - lat0) - (3 * n + 3 * n ** 2 + 2.625 * n ** 3) * sin(lat - lat0) * cos(lat + lat0) + (1.875 * n ** 2 + 1.875 * n ** 3) * sin(2 * (lat - lat0)) * cos(2 * (lat + lat0)) - (35.0::DOUBLE / 24) * n ** 3 * sin(3 * (lat - lat0)) * cos(3 * (lat + lat0)))) / (a * f0) AS lat) FROM l{i})""" for i in range(5)) + """,
 q AS (SELECT *, a * f0 / sqrt(1 - e2 * sin(lat) ** 2) AS nu, a * f0 * (1 - e2) / (1 - e2 * sin(lat) ** 2) ** 1.5 AS rho, tan(lat) AS t, x - 400000 AS de FROM l5),
 r AS (SELECT *, lon0 + 1 / cos(lat) / nu * de - 1 / cos(lat) / (6 * nu ** 3) * (nu / rho + 2 * t ** 2) * de ** 3 + 1 / cos(lat) / (120 * nu ** 5) * (5 + 28 * t ** 2 + 24 * t ** 4) * de ** 5 AS lam, lat - t / (2 * rho * nu) * de ** 2 + t / (24 * rho * nu ** 3) * (5 + 3 * t ** 2 + (nu / rho - 1) - 9 * t ** 2 * (nu / rho - 1)) * de ** 4 - t / (720 * rho * nu ** 5) * (61 + 90 * t ** 2 + 45 * t ** 4) * de ** 6 AS phi FROM q),
 g AS (SELECT *, a / sqrt(1 - e2 * sin(phi) ** 2) AS nu0 FROM r),
 g1 AS (SELECT *, nu0 * cos(phi) * cos(lam) AS gx, nu0 * cos(phi) * sin(lam) AS gy, nu0 * (1 - e2) * sin(phi) AS gz FROM g),
 g2 AS (SELECT *, 446.448 + (1 - 20.4894e-6) * gx - radians(0.8421 / 3600) * gy + radians(0.2470 / 3600) * gz AS wx, -125.157 + radians(0.8421 / 3600) * gx + (1 - 20.4894e-6) * gy - radians(0.1502 / 3600) * gz AS wy,
  542.060 - radians(0.2470 / 3600) * gx + radians(0.1502 / 3600) * gy + (1 - 20.4894e-6) * gz AS wz, 6378137.0::DOUBLE AS wa, 1 - 6356752.314245::DOUBLE ** 2 / 6378137.0::DOUBLE ** 2 AS we FROM g1),
 w0 AS (SELECT *, atan2(wz, sqrt(wx ** 2 + wy ** 2) * (1 - we)) AS wphi FROM g2)""" + "".join(f""",
 w{i + 1} AS (SELECT * REPLACE (atan2(wz + we * wa / sqrt(1 - we * sin(wphi) ** 2) * sin(wphi), sqrt(wx ** 2 + wy ** 2)) AS wphi) FROM w{i})""" for i in range(5)) + """,
 ll AS (SELECT * EXCLUDE (lat), degrees(atan2(wy, wx)) AS lon, degrees(wphi) AS lat FROM w5)"""


@query("reproject_osgb", duck("site_point", then=", p AS (SELECT site_id, x + 300000 AS x, y + 700000 AS y FROM site_point)" + _LL + " SELECT site_id, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll"))
def reproject_osgb(spark, sf):
    lon, lat = to_wgs84(F.col("x") + 300000, F.col("y") + 700000)
    return rounded(view(spark, sf, "site_point").select("site_id", lon.alias("lon"), lat.alias("lat")), 7)


@query("convert_layers_4326", duck("line_node", then=", p AS (SELECT line_id, seq, x + 300000 AS x, y + 700000 AS y FROM line_node)" + _LL + " SELECT 'line_' || line_id || '.geojson' AS source, seq::INT AS seq, round(lon, 7) AS lon, round(lat, 7) AS lat FROM ll"))
def convert_layers_4326(spark, sf):
    """Each line as a layer of its own, written with its nodes in longitude and latitude, and read back."""
    lon, lat = to_wgs84(F.col("x") + 300000, F.col("y") + 700000)
    nodes = view(spark, sf, "line_node").select(F.concat(F.lit("line_"), F.col("line_id").cast("string")).alias("layer"), "line_id", "seq", lon.alias("lon"), lat.alias("lat"))
    # Named first, renamed then: within one select, ``x`` in a lambda would be the new one.
    nodes = nodes.withColumnsRenamed({"lon": "x", "lat": "y"})
    path = new_folder(spark, "layers-4326")
    write_layers(nodes, "layer", ["line_id"], path)
    return rounded(read_layers(spark, path).select("source", "seq", F.col("x").alias("lon"), F.col("y").alias("lat")), 7)


# Windows, sets and sorts


@query("win_cumlen", duck("line_node", then=""" SELECT line_id, seq, round(sum(l) OVER (PARTITION BY line_id ORDER BY seq), 6) AS upto FROM (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS l FROM line_node WINDOW w AS (PARTITION BY line_id ORDER BY seq))"""))
def win_cumlen(spark, sf):
    return rounded(L.segments(view(spark, sf, "line_node")).select("line_id", "seq", F.col("before").alias("upto")))


@query("win_neighbours", duck("obs", then=" SELECT series_id, obs_date, lag(value) OVER w AS before, lead(value) OVER w AS after FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)"))
def win_neighbours(spark, sf):
    w = Window.partitionBy("series_id").orderBy("obs_date")
    return view(spark, sf, "obs").select("series_id", "obs_date", F.lag("value").over(w).alias("before"), F.lead("value").over(w).alias("after"))


@query("win_diff", duck("obs", then=" SELECT series_id, obs_date, date_diff('day', lag(obs_date) OVER w, obs_date)::INT AS gap FROM obs WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)"))
def win_diff(spark, sf):
    w = Window.partitionBy("series_id").orderBy("obs_date")
    return view(spark, sf, "obs").select("series_id", "obs_date", F.datediff("obs_date", F.lag("obs_date").over(w)).alias("gap"))


@query("win_rank_nearest", duck("obs", then=" SELECT series_id, obs_date, value FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY abs(value - 25), obs_date) AS r FROM obs) WHERE r = 1"))
def win_rank_nearest(spark, sf):
    best = F.min(F.struct(F.abs(F.col("value") - 25).alias("d"), "obs_date", "value")).alias("b")
    return view(spark, sf, "obs").groupBy("series_id").agg(best).select("series_id", "b.obs_date", "b.value")


@query("sort_by_distance", duck("site_point", then=" SELECT label, site_id, row_number() OVER (PARTITION BY label ORDER BY round(sqrt((x - 500) ** 2 + (y - 500) ** 2), 9), site_id)::INT AS place, round(sqrt((x - 500) ** 2 + (y - 500) ** 2), 6) AS distance FROM site_point"))
def sort_by_distance(spark, sf):
    """Sites of each label in order of their distance from the middle of the area."""
    d = F.hypot(F.col("x") - 500, F.col("y") - 500)
    by = Window.partitionBy("label").orderBy(F.round("distance", 9), "site_id")
    return rounded(view(spark, sf, "site_point").select("label", "site_id", d.alias("distance")).withColumn("place", F.row_number().over(by)))


@query("union_layers", duck("cell_rate", "cell_coast", then=" SELECT cell_id, count(hist_rate) AS n_rate, count(len) AS n_len FROM (SELECT cell_id, hist_rate, NULL::DOUBLE AS len FROM cell_rate UNION ALL SELECT cell_id, NULL, len FROM cell_coast) GROUP BY 1"))
def union_layers(spark, sf):
    both = view(spark, sf, "cell_rate").select("cell_id", "hist_rate").unionByName(view(spark, sf, "cell_coast").select("cell_id", "len"), allowMissingColumns=True)
    return both.groupBy("cell_id").agg(F.count("hist_rate").alias("n_rate"), F.count("len").alias("n_len"))


@query("dedupe_keep_order", duck("obs_raw", then=" SELECT series_id, obs_date, row_number() OVER (PARTITION BY series_id ORDER BY first_seen, obs_date)::INT AS place FROM (SELECT series_id, obs_date, min(arrival) AS first_seen FROM obs_raw GROUP BY 1, 2)"))
def dedupe_keep_order(spark, sf):
    """The different dates of each series in the order in which they first came."""
    first = view(spark, sf, "obs_raw").groupBy("series_id", "obs_date").agg(F.min("arrival").alias("first_seen"))
    by = Window.partitionBy("series_id").orderBy("first_seen", "obs_date")
    return first.select("series_id", "obs_date", F.row_number().over(by).alias("place"))


# Scalars


@query("fn_year_normalise", duck("obs", then=" SELECT series_id, max(obs_date) AS d, make_date(year(max(obs_date))::INT, 1, 1) AS from_year, max(obs_date) AS from_text FROM obs GROUP BY 1"))
def fn_year_normalise(spark, sf):
    d = F.max("obs_date")
    return view(spark, sf, "obs").groupBy("series_id").agg(d.alias("d")).select("series_id", "d", F.make_date(F.year("d"), F.lit(1), F.lit(1)).alias("from_year"), F.to_date(F.date_format("d", "yyyy-MM-dd")).alias("from_text"))


@query("fn_cell_split", "SELECT p_partkey, (p_partkey % 11 + 1)::INT AS cell, chr((97 + p_partkey % 4)::INT) AS sub FROM part")
def fn_cell_split(spark, sf):
    name = F.concat((F.col("p_partkey") % 11 + 1).cast("string"), F.chr(97 + F.col("p_partkey") % 4))
    p = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", name.alias("name"))
    return p.select("p_partkey", F.regexp_extract("name", r"^(\d+)", 1).cast("int").alias("cell"), F.regexp_extract("name", r"([a-z]+)$", 1).alias("sub"))


@query("fn_series_name", duck("rsl_dim", "site_point", then=" SELECT site_id, printf('RSL_RCP%d_P%02d', scenario, percentile) AS name FROM site_point, (SELECT DISTINCT scenario, percentile FROM rsl_dim)"))
def fn_series_name(spark, sf):
    dim = view(spark, sf, "rsl_dim").select("scenario", "percentile").distinct()
    return view(spark, sf, "site_point").crossJoin(F.broadcast(dim)).select("site_id", F.format_string("RSL_RCP%d_P%02d", "scenario", "percentile").alias("name"))


@query("fn_scenario_labels", "SELECT o_orderkey, 'RCP' || (o_orderkey % 3 * 2 + 4) AS rcp, (o_orderkey % 2 * 45 + 50) || 'th' AS pth FROM orders")
def fn_scenario_labels(spark, sf):
    k = F.col("o_orderkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.concat(F.lit("rcp"), (k % 3 * 2 + 4).cast("string"), F.lit("_"), (k % 2 * 45 + 50).cast("string")).alias("name"))
    return o.select("o_orderkey", F.upper(F.split("name", "_")[0]).alias("rcp"), F.concat(F.split("name", "_")[1], F.lit("th")).alias("pth"))


@query("fn_error_by_age", "SELECT o_orderkey, CASE WHEN year(o_orderdate) - 28 < 1970 THEN 5.0::DOUBLE WHEN year(o_orderdate) - 28 < 2000 THEN 2.0 ELSE 1.0 END AS error FROM orders")
def fn_error_by_age(spark, sf):
    from strandline.functions.expr import error_by_age

    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", error_by_age(F.add_months(F.col("o_orderdate").cast("date"), -336)).alias("error"))


@query("fn_clip", "SELECT l_orderkey, l_linenumber, round(least(greatest(l_discount * 20 - 0.3, 0), 1), 6)::DOUBLE AS clipped, (round_even(l_quantity / 5, 0) * 5)::DOUBLE AS round5 FROM lineitem")
def fn_clip(spark, sf):
    from strandline.functions.expr import clip

    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rounded(rows.select("l_orderkey", "l_linenumber", clip((F.col("l_discount") * 20 - 0.3).cast("double"), 0.0, 1.0).alias("clipped"), (F.bround((F.col("l_quantity") / 5).cast("double"), 0) * 5).alias("round5")))


@query("fn_trig", duck("site_point", then=" SELECT site_id, round(sin(radians(x)), 6) AS s, round(cos(radians(y)), 6) AS c, round(sqrt(x * x + y * y), 6) AS h, round(degrees(atan2(x, y)), 6) AS a FROM site_point"))
def fn_trig(spark, sf):
    x, y = F.col("x"), F.col("y")
    return rounded(view(spark, sf, "site_point").select("site_id", F.sin(F.radians(x)).alias("s"), F.cos(F.radians(y)).alias("c"), F.hypot(x, y).alias("h"), F.degrees(F.atan2(x, y)).alias("a")))


@query("fn_array", duck("profile", then=" SELECT transect_id, arg_max(ix, z * 1000000 - ix) AS top_ix, count(*) AS n FROM profile GROUP BY 1"))
def fn_array(spark, sf):
    p = view(spark, sf, "profile").groupBy("transect_id").agg(F.array_sort(F.collect_list(F.struct("ix", "z"))).alias("p"))
    top = F.array_max(F.transform("p", lambda a: F.struct(a["z"].alias("z"), (-a["ix"]).alias("i"))))
    return p.select("transect_id", (-top["i"]).cast("long").alias("top_ix"), F.size("p").cast("long").alias("n"))


@query("fn_json", duck("obs", then=" SELECT series_id, count(*) AS n FROM obs WHERE value > 40 GROUP BY 1"))
def fn_json(spark, sf):
    high = F.when(F.col("value") <= 40, F.lit(float("nan"))).otherwise(F.col("value"))
    j = view(spark, sf, "obs").groupBy("series_id").agg(F.to_json(F.collect_list(F.struct(F.nanvl(high, F.lit(None).cast("double")).alias("v")))).alias("j"))
    back = F.from_json("j", "array<struct<v: double>>")
    n = F.size(F.filter(back, lambda o: o["v"].isNotNull()))
    return j.select("series_id", n.cast("long").alias("n")).filter("n > 0")


# Streams read the stored tables to their end and write each batch to the shared folder; each is compared with its batch form.


def _stream_folder(spark):
    return f"{shared_folder(spark)}/streams/{uuid4().hex}"


@query("stream_obs_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_obs_tumbling(spark, sf):
    events = table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz").cast("timestamp"))
    folder = _stream_folder(spark)
    O.run_to_end(O.tumbling(events, "ts", "1 day", "1 day", ["event_type"], "value"), O.append_batch(f"{folder}/out"), folder, "update")
    return rounded(O.updated(spark, f"{folder}/out", ["start", "event_type"])).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _feed(spark, sf, folder):
    """The raw observations in files of mixed dates, read in three batches, each by all tasks: later ones bring late dates and replacements."""
    raw = view(spark, sf, "obs_raw")
    files = spark.sparkContext.defaultParallelism
    raw.repartition(3 * files, F.xxhash64("arrival")).write.parquet(f"{folder}/feed")
    O.run_to_end(O.observed(spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/feed"), ["series_id"]), O.append_batch(f"{folder}/out"), folder, "update")
    return f"{folder}/out"


@query("stream_rate_epr_ols", duck("obs", then=""" SELECT series_id, count(*) AS n, round(CASE WHEN max(obs_date) > min(obs_date) THEN (arg_max(value, obs_date) - arg_min(value, obs_date)) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) END, 6) AS epr,
 round(CASE WHEN count(*) >= 3 THEN regr_slope(value, date_diff('day', DATE '1970-01-01', obs_date) / 365.25) END, 6) AS ols FROM obs GROUP BY 1"""))
def stream_rate_epr_ols(spark, sf):
    return rounded(O.updated(spark, _feed(spark, sf, _stream_folder(spark)), ["series_id"], ["n", "epr", "ols"]))


@query("stream_ts_upsert", duck("obs", then=" SELECT series_id, obs_date, value FROM obs"))
def stream_ts_upsert(spark, sf):
    return O.changed(spark, _feed(spark, sf, _stream_folder(spark)), ["series_id"]).select("series_id", "obs_date", "value")
