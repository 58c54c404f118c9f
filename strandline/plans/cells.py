"""Registered cell scores, summaries and storm queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.output import rounded
from strandline.operators import cells as C
from strandline.operators import storm as X
from strandline.plans.registry import query
from strandline.sources.views import duck, view

_EROSION = """, ero AS (SELECT p_partkey AS cell_id, n_trans, n_eros, eros_med, eros_p10, n_eros / n_trans AS eros_frac FROM part LEFT JOIN (SELECT cell_id, count(*) AS n_trans, count(*) FILTER (hist_rate < 0) AS n_eros,
 median(hist_rate) FILTER (hist_rate < 0) AS eros_med, quantile_cont(hist_rate, 0.1) FILTER (hist_rate < 0) AS eros_p10 FROM cell_rate GROUP BY 1) r ON r.cell_id = p_partkey)"""
_COAST = """, typ0 AS (SELECT cell_id, coalesce(sum(len) FILTER (ct = 'H'), 0) AS len_h, coalesce(sum(len) FILTER (ct = 'S'), 0) AS len_s, coalesce(sum(len) FILTER (ct = 'A'), 0) AS len_a FROM cell_coast GROUP BY 1),
 typ AS (SELECT p_partkey AS cell_id, len_h, len_s, len_a, len_h + len_s + len_a AS len_total, len_h / (len_h + len_s + len_a) AS frac_h, len_s / (len_h + len_s + len_a) AS frac_s, len_a / (len_h + len_s + len_a) AS frac_a,
 CASE WHEN len_h IS NULL THEN NULL WHEN len_h >= greatest(len_s, len_a) THEN 'H' WHEN len_s >= len_a THEN 'S' ELSE 'A' END AS dominant FROM part LEFT JOIN typ0 t ON t.cell_id = p_partkey)"""


def _cells(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("cell_id"))


@query("cell_erosion", duck("cell_rate", then=_EROSION + " SELECT cell_id, n_trans, n_eros, round(eros_med, 6) AS eros_med, round(eros_p10, 6) AS eros_p10, round(eros_frac, 6) AS eros_frac FROM ero"))
def cell_erosion(spark, sf):
    return rounded(C.erosion(_cells(spark, sf), view(spark, sf, "cell_rate")))


@query("cell_coast_type", duck("cell_coast", then=_COAST + " SELECT cell_id, round(len_h, 6) AS len_h, round(len_s, 6) AS len_s, round(len_a, 6) AS len_a, round(len_total, 6) AS len_total, round(frac_h, 6) AS frac_h, round(frac_s, 6) AS frac_s, round(frac_a, 6) AS frac_a, dominant FROM typ"))
def cell_coast_type(spark, sf):
    return rounded(C.coast_type(_cells(spark, sf), view(spark, sf, "cell_coast")))


_AGE = "CASE WHEN age IS NULL OR age >= 10 THEN 1.0::DOUBLE WHEN age < 0 THEN 0.0 WHEN age <= 5 THEN 0.6::DOUBLE * age / 5 ELSE 0.6::DOUBLE + 0.4::DOUBLE * (age - 5) / 5 END"


@query("score_lidar_age", duck("cell_attr", then=f" SELECT cell_id, round({_AGE}, 6) AS score FROM (SELECT *, 2026 - max_lid_yr AS age FROM cell_attr)"))
def score_lidar_age(spark, sf):
    return rounded(view(spark, sf, "cell_attr").select("cell_id", C.age_score(2026 - F.col("max_lid_yr")).alias("score")))


@query("score_assets", duck("cell_attr", then=" SELECT cell_id, CASE upper(trim(assets)) WHEN 'Y' THEN 1.0::DOUBLE WHEN 'N' THEN 0.0::DOUBLE END AS score FROM cell_attr"))
def score_assets(spark, sf):
    return view(spark, sf, "cell_attr").select("cell_id", C.asset_score(F.col("assets")).alias("score"))


@query("score_coast_type", duck("cell_coast", then=_COAST + " SELECT cell_id, round(CASE WHEN frac_s IS NOT NULL THEN least(greatest(frac_s + 0.5 * frac_a, 0), 1) END, 6) AS score FROM typ"))
def score_coast_type(spark, sf):
    return rounded(C.coast_type(_cells(spark, sf), view(spark, sf, "cell_coast")).select("cell_id", C.coast_score(F.col("frac_s"), F.col("frac_a")).alias("score")))


@query("score_lowlying", "SELECT cell_id, round(avg(CASE WHEN z < 5 THEN 1.0 ELSE 0.0 END), 6) AS score FROM (SELECT o_custkey % 100 AS cell_id, o_totalprice / 30000 AS z FROM orders) GROUP BY 1")
def score_lowlying(spark, sf):
    z = spark.read.parquet(f"{sf}/orders.parquet").select((F.col("o_custkey") % 100).alias("cell_id"), (F.col("o_totalprice") / 30000).alias("z"))
    return rounded(z.groupBy("cell_id").agg(F.avg(F.when(F.col("z") < 5, 1.0).otherwise(0.0)).alias("low5")).select("cell_id", C.low_lying_score(F.col("low5")).alias("score")))


_ESC = "CASE WHEN eros_frac IS NULL THEN NULL WHEN eros_frac <= 0 THEN 0.0::DOUBLE ELSE 0.5 * eros_frac + 0.3 * coalesce(least(abs(eros_med), 1), 0) + 0.2 * coalesce(least(abs(eros_p10) / 2, 1), 0) END"


@query("score_erosion", duck("cell_rate", then=_EROSION + f" SELECT cell_id, round({_ESC}, 6) AS score FROM ero"))
def score_erosion(spark, sf):
    e = C.erosion(_cells(spark, sf), view(spark, sf, "cell_rate"))
    return rounded(e.select("cell_id", C.erosion_score(F.col("eros_frac"), F.col("eros_med"), F.col("eros_p10")).alias("score")))


def _scored(spark, sf):
    e = C.erosion(_cells(spark, sf), view(spark, sf, "cell_rate"))
    t = C.coast_type(_cells(spark, sf), view(spark, sf, "cell_coast"))
    a = view(spark, sf, "cell_attr")
    rows = a.join(e, "cell_id", "left").join(t, "cell_id", "left").select(
        "cell_id", "max_lid_yr", "frac_h", "eros_med", C.age_score(2026 - F.col("max_lid_yr")).alias("s_age"), C.asset_score(F.col("assets")).alias("s_assets"),
        C.coast_score(F.col("frac_s"), F.col("frac_a")).alias("s_coast"), C.erosion_score(F.col("eros_frac"), F.col("eros_med"), F.col("eros_p10")).alias("s_erosion"))
    return C.priority(rows, ["s_age", "s_assets", "s_coast", "s_erosion"], "max_lid_yr", "frac_h", "s_assets")


_PRIORITY = _EROSION + _COAST + f""", sc AS (SELECT a.cell_id, a.max_lid_yr, frac_h, eros_med, {_AGE.replace('age', '(2026 - max_lid_yr)')} AS s_age, CASE upper(trim(assets)) WHEN 'Y' THEN 1.0::DOUBLE WHEN 'N' THEN 0.0::DOUBLE END AS s_assets,
 CASE WHEN frac_s IS NOT NULL THEN least(greatest(frac_s + 0.5 * frac_a, 0), 1) END AS s_coast, {_ESC} AS s_erosion FROM cell_attr a LEFT JOIN ero USING (cell_id) LEFT JOIN typ USING (cell_id)),
 pr AS (SELECT *, (s_age IS NOT NULL)::INT + (s_assets IS NOT NULL)::INT + (s_coast IS NOT NULL)::INT + (s_erosion IS NOT NULL)::INT AS n_score, coalesce(s_age, 0) + coalesce(s_assets, 0) + coalesce(s_coast, 0) + coalesce(s_erosion, 0) AS total FROM sc),
 pri AS (SELECT cell_id, eros_med, n_score, n_score = 4 AS score_ok, CASE WHEN frac_h >= 0.9 AND coalesce(s_assets, 0) = 0 THEN 0 WHEN max_lid_yr IS NULL THEN greatest(total / n_score, 0.8) ELSE total / n_score END AS priority FROM pr)"""


@query("priority_index", duck("cell_rate", "cell_coast", "cell_attr", then=_PRIORITY + " SELECT cell_id, round(priority, 6) AS priority, n_score, score_ok FROM pri"))
def priority_index(spark, sf):
    return rounded(_scored(spark, sf).select("cell_id", "priority", "n_score", "score_ok"))


@query("survey_interval", duck("cell_rate", then=_EROSION + " SELECT cell_id, round(CASE WHEN eros_med < 0 THEN least(greatest(2 / abs(eros_med), 1), 10) END, 6) AS years FROM ero"))
def survey_interval(spark, sf):
    return rounded(C.erosion(_cells(spark, sf), view(spark, sf, "cell_rate")).select("cell_id", C.survey_interval(F.col("eros_med")).alias("years")))


@query("qa_summary", duck("cell_rate", "cell_coast", "cell_attr", then=_PRIORITY + " SELECT count(*) AS cells, count(*) FILTER (score_ok) AS complete, count(eros_med) AS matched, round(median(priority), 6) AS median_priority, round(min(priority), 6) AS least_priority, round(max(priority), 6) AS most_priority FROM pri"))
def qa_summary(spark, sf):
    return rounded(_scored(spark, sf).agg(
        F.count("*").alias("cells"), F.count_if("score_ok").alias("complete"), F.count("eros_med").alias("matched"), F.median("priority").alias("median_priority"),
        F.min("priority").alias("least_priority"), F.max("priority").alias("most_priority")))


@query("mean_erosion", duck("cell_rate", then=" SELECT cell_id, count(*) FILTER (hist_rate < 0) AS n_eroding, round(coalesce(avg(hist_rate) FILTER (hist_rate < 0), 0), 6) AS mean_erosion FROM cell_rate GROUP BY 1"))
def mean_erosion(spark, sf):
    return rounded(C.mean_erosion(view(spark, sf, "cell_rate"), ["cell_id"], "hist_rate"))


@query("transect_count", duck("cell_rate", then=" SELECT cell_id, count(*) FILTER (hist_rate IS NOT NULL) AS n FROM cell_rate GROUP BY 1"))
def transect_count(spark, sf):
    return view(spark, sf, "cell_rate").groupBy("cell_id").agg(F.count_if(F.col("hist_rate").isNotNull()).alias("n"))


@query("erosion_lists", duck("cell_rate", then=" SELECT cell_id, transect_id, round(hist_rate, 6) AS hist_rate FROM cell_rate WHERE hist_rate < 0"))
def erosion_lists(spark, sf):
    return rounded(view(spark, sf, "cell_rate").filter("hist_rate < 0"))


@query("recent_year_list", duck("obs", then=" SELECT series_id, year(max(obs_date))::INT AS latest_year FROM obs GROUP BY 1"))
def recent_year_list(spark, sf):
    return view(spark, sf, "obs").groupBy("series_id").agg(F.year(F.max("obs_date")).alias("latest_year"))


@query("summary_rollup", duck("cell_rate", then=""" SELECT cell, subcell, CAST(GROUPING(cell, subcell) AS INT) AS level, count(*) AS n, count(*) FILTER (hist_rate < 0) AS n_eros, round(avg(hist_rate) FILTER (hist_rate < 0), 6) AS mean_eros,
 round(100.0 * count(*) FILTER (hist_rate < 0) / count(*), 6) AS pct_eros FROM (SELECT cell_id % 11 AS cell, cell_id AS subcell, hist_rate FROM cell_rate) GROUP BY ROLLUP (cell, subcell)"""))
def summary_rollup(spark, sf):
    rows = view(spark, sf, "cell_rate").select((F.col("cell_id") % 11).alias("cell"), F.col("cell_id").alias("subcell"), "hist_rate")
    return rounded(C.rollup_summary(rows))


@query("hist_baseline_year", duck("obs", then=", y AS (SELECT year(max(obs_date))::INT AS latest_year FROM obs GROUP BY series_id) SELECT latest_year, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS density FROM y GROUP BY 1"))
def hist_baseline_year(spark, sf):
    years = view(spark, sf, "obs").groupBy("series_id").agg(F.year(F.max("obs_date")).alias("latest_year"))
    h = C.histogram(years, "latest_year", 1, [])
    return rounded(h.select(F.col("left_edge").cast("int").alias("latest_year"), "n", "density"))


@query("hist_erosion", duck("cell_rate", then=""", r AS (SELECT cell_id % 11 AS cell, hist_rate * 27 AS move FROM cell_rate WHERE hist_rate < 0), l AS (SELECT cell, min(move) AS low, count(*) AS total FROM r GROUP BY 1)
 SELECT cell, round(low + floor((move - low) / 5) * 5, 6) AS left_edge, count(*) AS n, round(count(*) / (any_value(total) * 5.0), 6) AS density FROM r JOIN l USING (cell) GROUP BY cell, low, floor((move - low) / 5)"""))
def hist_erosion(spark, sf):
    rows = view(spark, sf, "cell_rate").filter("hist_rate < 0").select((F.col("cell_id") % 11).alias("cell"), (F.col("hist_rate") * 27).alias("move"))
    return rounded(C.histogram(rows, "move", 5.0, ["cell"]))


@query("equi_join_left", duck("cell_rate", then=_EROSION + " SELECT cell_id, n_trans, n_trans IS NOT NULL AS matched FROM ero"))
def equi_join_left(spark, sf):
    return C.erosion(_cells(spark, sf), view(spark, sf, "cell_rate")).select("cell_id", "n_trans", F.col("n_trans").isNotNull().alias("matched"))


# Storms

_LEN = "(9.81::DOUBLE * tp * tp / (2 * pi()))"
_GEN = f"1.1::DOUBLE * (0.35 * slope * sqrt(hs * {_LEN}) + sqrt(hs * {_LEN} * (0.563::DOUBLE * slope * slope + 0.004)) / 2)"
_RUN = f""", ru AS (SELECT *, CASE WHEN shingle AND slope > 0.095 THEN {_GEN} WHEN slope / sqrt(hs / {_LEN}) < 0.3 THEN 0.043::DOUBLE * sqrt(hs * {_LEN}) ELSE {_GEN} END AS runup,
 CASE WHEN shingle AND slope > 0.095 THEN 0.3::DOUBLE * hs WHEN slope / sqrt(hs / {_LEN}) < 0.3 THEN 0.016::DOUBLE * sqrt(hs * {_LEN}) ELSE 0.35::DOUBLE * slope * sqrt(hs * {_LEN}) END AS setup,
 NOT (shingle AND slope > 0.095) AND slope / sqrt(hs / {_LEN}) < 0.3 AS dissipative FROM storm_in),
 lv AS (SELECT *, esl + runup AS twl, esl + setup AS setup_level FROM ru)"""
_DUNE = """, fd0 AS (SELECT s.*, m.slr AS mid_slr, CASE WHEN s.scenario = 'H' THEN s.toe ELSE s.toe + s.slr END AS toe_f,
 CASE WHEN s.scenario <> 'H' AND s.hist_rate >= 0 THEN s.crest + m.slr ELSE s.crest END AS crest_0 FROM lv s LEFT JOIN lv m ON m.transect_id = s.transect_id AND m.scenario = CASE s.scenario WHEN 'M45' THEN 'M45' WHEN 'E45' THEN 'M45' WHEN 'M85' THEN 'M85' WHEN 'E85' THEN 'M85' END),
 fd AS (SELECT *, scenario <> 'H' AND toe_f > crest_0 AS drowned, CASE WHEN scenario <> 'H' AND toe_f > crest_0 THEN toe_f ELSE crest_0 END AS crest_f FROM fd0)"""
_REG = """, rg AS (SELECT *, CASE WHEN barrier THEN CASE WHEN twl < toe_f THEN 'Swash' WHEN twl > toe_f AND twl < crest_f THEN 'Collision' WHEN twl > crest_f THEN CASE WHEN setup_level > crest_f THEN 'Inundation' ELSE 'Overwash' END END
 WHEN asset_dist < 200 THEN CASE WHEN twl > asset_elev THEN CASE WHEN setup_level > asset_elev THEN 'NB_Inundation' ELSE 'NB_Overwash' END WHEN asset_elev - twl > 5 THEN 'NB_Swash' ELSE 'NB_Collision' END ELSE 'NB_NoAsset' END AS regime FROM fd)"""


def _storm(spark, sf):
    return X.with_levels(X.with_runup(view(spark, sf, "storm_in")))


def _regimes(spark, sf):
    rows = X.future_dunes(_storm(spark, sf))
    c = F.col
    return rows.withColumn("regime", X.regime(c("twl"), c("setup_level"), c("toe_f"), c("crest_f"), c("barrier"), c("asset_dist"), c("asset_elev")))


@query("adjust_tp", duck("storm_in", then=" SELECT transect_id, scenario, round(CASE WHEN subcell IN ('6f', '7') THEN tp * 0.67::DOUBLE ELSE tp END, 6) AS tp FROM (SELECT *, CASE transect_id % 3 WHEN 0 THEN '6f' WHEN 1 THEN '7' ELSE '2c' END AS subcell FROM storm_in)"))
def adjust_tp(spark, sf):
    rows = view(spark, sf, "storm_in").withColumn("subcell", F.element_at(F.array(F.lit("6f"), F.lit("7"), F.lit("2c")), (F.col("transect_id") % 3 + 1).cast("int")))
    return rounded(rows.select("transect_id", "scenario", X.adjust_tp(F.col("tp"), F.col("subcell")).alias("tp")))


@query("extreme_runup", duck("storm_in", then=_RUN + " SELECT transect_id, scenario, round(runup, 6) AS runup, round(setup, 6) AS setup, dissipative FROM ru"))
def extreme_runup(spark, sf):
    return rounded(X.with_runup(view(spark, sf, "storm_in")).select("transect_id", "scenario", "runup", "setup", "dissipative"))


@query("total_water_level", duck("storm_in", then=_RUN + " SELECT transect_id, scenario, round(twl, 6) AS twl, round(setup_level, 6) AS setup_level FROM lv"))
def total_water_level(spark, sf):
    return rounded(_storm(spark, sf).select("transect_id", "scenario", "twl", "setup_level"))


@query("future_dunes", duck("storm_in", then=_RUN + _DUNE + " SELECT transect_id, scenario, round(toe_f, 6) AS toe_f, round(crest_f, 6) AS crest_f, drowned FROM fd"))
def future_dunes(spark, sf):
    return rounded(X.future_dunes(_storm(spark, sf)).select("transect_id", "scenario", "toe_f", "crest_f", "drowned"))


@query("storm_regime", duck("storm_in", then=_RUN + _DUNE + _REG + " SELECT transect_id, scenario, regime FROM rg"))
def storm_regime(spark, sf):
    return _regimes(spark, sf).select("transect_id", "scenario", "regime")


@query("storm_counts", duck("storm_in", then=_RUN + _DUNE + _REG + " SELECT transect_id % 11 AS subcell, scenario, " + ", ".join(f"count(*) FILTER (regime = '{r}') AS {r.lower()}" for r in X.REGIMES) + " FROM rg GROUP BY 1, 2"))
def storm_counts(spark, sf):
    return X.regime_counts(_regimes(spark, sf).withColumn("subcell", F.col("transect_id") % 11), ["subcell", "scenario"])


@query("headroom", duck("storm_in", then=_RUN + _DUNE + " SELECT transect_id, scenario, round(crest_f - twl, 6) AS headroom FROM fd WHERE barrier"))
def headroom(spark, sf):
    return rounded(X.future_dunes(_storm(spark, sf)).filter("barrier").select("transect_id", "scenario", (F.col("crest_f") - F.col("twl")).alias("headroom")))


@query("asset_distance", "SELECT p_partkey AS transect_id, CASE WHEN least(road, rail, house) < 200 THEN least(road, rail, house) END AS asset_dist FROM (SELECT p_partkey, p_size * 7.0::DOUBLE AS road, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE (p_partkey % 97) * 5.0::DOUBLE END AS rail, (p_partkey % 53) * 9.0::DOUBLE AS house FROM part)")
def asset_distance(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    rows = p.select(F.col("p_partkey").alias("transect_id"), (F.col("p_size") * 7.0).alias("road"), F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 97) * 5.0).alias("rail"), ((F.col("p_partkey") % 53) * 9.0).alias("house"))
    return rows.select("transect_id", X.nearest_asset(["road", "rail", "house"], F.lit(400.0)).alias("asset_dist"))


@query("asset_elevation", duck("storm_in", "profile", then=", a AS (SELECT DISTINCT transect_id % 150 AS transect_id, round_even(asset_dist / 5, 0) * 5 AS dist FROM storm_in WHERE asset_dist IS NOT NULL) SELECT a.transect_id, a.dist, round(p.z, 6) AS asset_elev FROM a JOIN profile p ON p.transect_id = a.transect_id AND p.dist = a.dist"))
def asset_elevation(spark, sf):
    a = view(spark, sf, "storm_in").filter("asset_dist is not null").select((F.col("transect_id") % 150).alias("transect_id"), X.asset_bin(F.col("asset_dist")).alias("dist")).distinct()
    return rounded(a.join(view(spark, sf, "profile"), ["transect_id", "dist"]).select("transect_id", "dist", F.col("z").alias("asset_elev")))


@query("extreme_level", duck("storm_in", then=" SELECT transect_id, scenario, level_kind, round(level, 6) AS level FROM (SELECT transect_id, scenario, esl - 0.2 AS c1, esl AS t25, esl + 0.3 AS c3 FROM storm_in) UNPIVOT (level FOR level_kind IN (c1, t25, c3))"))
def extreme_level(spark, sf):
    rows = view(spark, sf, "storm_in").select("transect_id", "scenario", (F.col("esl") - 0.2).alias("c1"), F.col("esl").alias("t25"), (F.col("esl") + 0.3).alias("c3"))
    return rounded(rows.unpivot(["transect_id", "scenario"], ["c1", "t25", "c3"], "level_kind", "level"))
