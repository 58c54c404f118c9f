"""Registered time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.output import rounded
from strandline.operators import series as S
from strandline.plans.registry import query
from strandline.sources.views import duck, view

K = ["series_id"]


@query("ts_upsert", duck("obs", then="SELECT * FROM obs"))
def ts_upsert(spark, sf):
    return S.upsert(view(spark, sf, "obs_raw"), K)


@query("ts_reset", duck("obs", then="SELECT * FROM obs WHERE series_id NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)"))
def ts_reset(spark, sf):
    gone = spark.read.parquet(f"{sf}/part.parquet").filter("p_size > 25").select(F.col("p_partkey").alias("series_id"))
    return S.reset(view(spark, sf, "obs"), gone, K)


_ENDS = """SELECT series_id, max(obs_date) AS latest_date, arg_max(value, obs_date) AS latest_value, arg_max(source, obs_date) AS latest_source,
 min(obs_date) AS oldest_date, arg_min(value, obs_date) AS oldest_value, count(*) AS n FROM obs GROUP BY series_id"""


@query("ts_latest", duck("obs", then=f"SELECT series_id, latest_date, latest_value, latest_source FROM ({_ENDS})"))
def ts_latest(spark, sf):
    return S.latest(view(spark, sf, "obs"), K).select("series_id", "latest_date", "latest_value", "latest_source")


@query("ts_oldest", duck("obs", then=f"SELECT series_id, oldest_date, oldest_value FROM ({_ENDS})"))
def ts_oldest(spark, sf):
    return S.latest(view(spark, sf, "obs"), K).select("series_id", "oldest_date", "oldest_value")


@query("ts_has_data", duck("obs", then="SELECT series_id, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 30"))
def ts_has_data(spark, sf):
    return S.latest(view(spark, sf, "obs"), K).filter("n >= 30").select("series_id", "n")


@query("ts_source_year", duck("obs", then="SELECT series_id, year(min(obs_date) FILTER (source LIKE '%A'))::INT AS source_year FROM obs GROUP BY 1"))
def ts_source_year(spark, sf):
    return S.source_date(view(spark, sf, "obs"), K, "A").select("series_id", F.year("source_date").alias("source_year"))


_EPR = """, epr AS (SELECT series_id, 'EPR' AS method, (arg_max(value, obs_date) - arg_min(value, obs_date)) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) AS rate,
 NULL::DOUBLE AS rate_se, sqrt(arg_min(error, obs_date) ** 2 + arg_max(error, obs_date) ** 2) / (date_diff('day', min(obs_date), max(obs_date)) / 365.25) AS rate_unc,
 NULL::DOUBLE AS residual_se, NULL::DOUBLE AS intercept, NULL::DOUBLE AS r2, NULL::BIGINT AS n, min(obs_date) AS start_date, max(obs_date) AS end_date
 FROM obs GROUP BY 1 HAVING min(obs_date) < max(obs_date))"""


@query("rate_epr", duck("obs", then=_EPR + " SELECT series_id, round(rate, 6) AS rate, round(rate_unc, 6) AS rate_unc, start_date, end_date FROM epr"))
def rate_epr(spark, sf):
    return rounded(S.end_point(view(spark, sf, "obs"), K))


def _ols(name: str, years: int | None) -> str:
    kept = "" if years is None else f"WHERE x >= last_x - {years} * 365.25"
    return f""", {name} AS (SELECT series_id, '{name.upper()}' AS method, b * 365.25 AS rate, CASE WHEN n > 2 THEN sqrt(rss / (n - 2) / sxx) * 365.25 END AS rate_se,
 CASE WHEN n > 2 THEN 1.96 * sqrt(rss / (n - 2) / sxx) * 365.25 END AS rate_unc, CASE WHEN n > 2 THEN sqrt(rss / (n - 2)) END AS residual_se, intercept,
 CASE WHEN n > 2 AND syy > 0 THEN round(1 - rss / syy, 3) END AS r2, n, start_date, end_date FROM (
 SELECT series_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, greatest(0, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x)) AS rss,
 count(*) AS n, min(obs_date) AS start_date, max(obs_date) AS end_date FROM (
 SELECT series_id, obs_date, date_diff('day', DATE '1970-01-01', obs_date)::DOUBLE AS x, value AS y, count(*) OVER w AS all_n, max(date_diff('day', DATE '1970-01-01', obs_date)) OVER w AS last_x FROM obs WINDOW w AS (PARTITION BY series_id)) {kept if kept else 'WHERE TRUE'} AND all_n >= 3
 GROUP BY series_id HAVING count(*) >= 2) WHERE sxx > 0)"""


_OLS_OUT = "SELECT series_id, round(rate, 6) AS rate, round(rate_se, 6) AS rate_se, round(rate_unc, 6) AS rate_unc, round(residual_se, 6) AS residual_se, round(intercept, 6) AS intercept, r2, n, start_date, end_date FROM "


@query("rate_ols", duck("obs", then=_ols("ols", None) + _OLS_OUT + "ols"))
def rate_ols(spark, sf):
    return rounded(S.least_squares(view(spark, sf, "obs"), K))


@query("rate_ols5", duck("obs", then=_ols("ols5", 5) + _OLS_OUT + "ols5"))
def rate_ols5(spark, sf):
    return rounded(S.least_squares(view(spark, sf, "obs"), K, 5))


@query("rate_ols10", duck("obs", then=_ols("ols10", 10) + _OLS_OUT + "ols10"))
def rate_ols10(spark, sf):
    return rounded(S.least_squares(view(spark, sf, "obs"), K, 10))


_TS = """, o AS (SELECT series_id, date_diff('day', DATE '1970-01-01', obs_date)::DOUBLE AS x, value AS y FROM obs),
 sl AS (SELECT a.series_id, list_sort(list((b.y - a.y) / (b.x - a.x))) AS s FROM o a JOIN o b ON a.series_id = b.series_id AND b.x > a.x GROUP BY 1),
 ty AS (SELECT series_id, sum(k * (k - 1) * (2 * k + 5)) AS t FROM (SELECT series_id, y, count(*) AS k FROM o GROUP BY 1, 2) GROUP BY 1),
 st AS (SELECT series_id, count(*) AS n, median(x) AS mx, median(y) AS my, avg(y) AS ay FROM o GROUP BY 1 HAVING count(*) >= 3),
 f AS (SELECT st.*, len(s) AS m, s, list_aggregate(s, 'median') AS b, sqrt((n * (n - 1) * (2 * n + 5) - t) / 18.0) AS sigma FROM st JOIN sl USING (series_id) JOIN ty USING (series_id)),
 theilsen AS (SELECT f.series_id, any_value(b) * 365.25 AS rate, any_value(s[greatest(round_even((m - 1.959963984540054 * sigma) / 2, 0)::INT - 1, 0) + 1]) * 365.25 AS rate_lo,
 any_value(s[least(round_even((m + 1.959963984540054 * sigma) / 2, 0)::INT, m - 1) + 1]) * 365.25 AS rate_hi, sqrt(sum((y - (my - b * mx) - b * x) ** 2) / (any_value(n) - 2)) AS residual_se,
 any_value(my - b * mx) AS intercept, CASE WHEN sum((y - ay) ** 2) > 0 THEN round(1 - sum((y - (my - b * mx) - b * x) ** 2) / sum((y - ay) ** 2), 3) END AS r2, any_value(n) AS n
 FROM f JOIN o USING (series_id) GROUP BY 1)"""


@query("rate_theilsen", duck("obs", then=_TS + " SELECT series_id, round(rate, 6) AS rate, round(rate_lo, 6) AS rate_lo, round(rate_hi, 6) AS rate_hi, round(residual_se, 6) AS residual_se, round(intercept, 6) AS intercept, r2, n FROM theilsen"))
def rate_theilsen(spark, sf):
    return rounded(S.theil_sen(view(spark, sf, "obs"), K))


_TWR = """, t1 AS (SELECT series_id, date_diff('day', DATE '1970-01-01', obs_date)::DOUBLE AS d, value AS y, error, max(date_diff('day', DATE '1970-01-01', obs_date)) OVER (PARTITION BY series_id) AS last FROM obs),
 t2 AS (SELECT *, d - last AS x, exp((d - last) / 3652.5) / error ** 2 AS w0 FROM t1),
 t3 AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY series_id) AS w, count(*) OVER (PARTITION BY series_id) AS n FROM t2),
 t4 AS (SELECT *, sum(w * w * x) OVER p / sum(w * w) OVER p AS mx, sum(w * w * y) OVER p / sum(w * w) OVER p AS my FROM t3 WHERE n >= 3 WINDOW p AS (PARTITION BY series_id)),
 t5 AS (SELECT *, sum(w * w * (x - mx) * (y - my)) OVER p / sum(w * w * (x - mx) ** 2) OVER p AS b FROM t4 WINDOW p AS (PARTITION BY series_id)),
 t6 AS (SELECT series_id, any_value(b) AS b, any_value(my - b * (mx + last)) AS intercept, sum(w * (y - my - b * (x - mx)) ** 2) AS rss, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, count(*) AS n FROM t5 GROUP BY 1),
 twr AS (SELECT series_id, b * 365.25 AS rate, sqrt(rss / (n - 2) / sxx) * 365.25 AS rate_se, 1.96 * sqrt(rss / (n - 2) / sxx) * 365.25 AS rate_unc, sqrt(rss / (n - 2)) AS residual_se, intercept,
 CASE WHEN syy > 0 THEN round(1 - rss / syy, 3) END AS r2, n FROM t6 WHERE sxx > 0)"""


@query("rate_twr", duck("obs", then=_TWR + " SELECT series_id, round(rate, 6) AS rate, round(rate_se, 6) AS rate_se, round(rate_unc, 6) AS rate_unc, round(residual_se, 6) AS residual_se, round(intercept, 6) AS intercept, r2, n FROM twr"))
def rate_twr(spark, sf):
    return rounded(S.time_weighted(view(spark, sf, "obs"), K))


_ALL = "SELECT series_id, method, round(rate, 6) AS rate, round(rate_se, 6) AS rate_se, round(rate_unc, 6) AS rate_unc, round(residual_se, 6) AS residual_se, round(intercept, 6) AS intercept, r2, n FROM ({})"
_PICK = "SELECT series_id, '{}' AS method, rate, {} AS rate_se, {} AS rate_unc, residual_se, intercept, r2, n FROM {}"


@query("rate_all", duck("obs", then=_EPR + _ols("ols", None) + _ols("ols5", 5) + _ols("ols10", 10) + _TS + _TWR + " " + _ALL.format(" UNION ALL ".join(
    [_PICK.format(m, a, b, t) for m, a, b, t in (("EPR", "rate_se", "rate_unc", "epr"), ("OLS", "rate_se", "rate_unc", "ols"), ("OLS5", "rate_se", "rate_unc", "ols5"), ("OLS10", "rate_se", "rate_unc", "ols10"), ("TheilSen", "NULL", "NULL", "theilsen"), ("TWR", "rate_se", "rate_unc", "twr"))]))))
def rate_all(spark, sf):
    return rounded(S.all_rates(view(spark, sf, "obs"), K))


@query("ts_fitted", duck("obs", then=_ols("ols", None) + """ SELECT o.series_id, o.obs_date, o.value, round(intercept + rate / 365.25 * date_diff('day', DATE '1970-01-01', obs_date), 6) AS fitted,
 round(value - (intercept + rate / 365.25 * date_diff('day', DATE '1970-01-01', obs_date)), 6) AS residual FROM obs o JOIN ols USING (series_id)"""))
def ts_fitted(spark, sf):
    obs = view(spark, sf, "obs")
    return rounded(S.fitted(obs, S.least_squares(obs, K), K))


@query("ts_interp", duck("obs", then=""", pts AS (SELECT DISTINCT series_id, DATE '1996-07-01' AS at_date FROM obs),
 ab AS (SELECT series_id, at_date, max(obs_date) FILTER (obs_date <= at_date) AS d0, arg_max(value, obs_date) FILTER (obs_date <= at_date) AS v0, min(obs_date) FILTER (obs_date >= at_date) AS d1, arg_min(value, obs_date) FILTER (obs_date >= at_date) AS v1 FROM obs JOIN pts USING (series_id) GROUP BY 1, 2)
 SELECT series_id, at_date, round(CASE WHEN d0 IS NULL THEN v1 WHEN d1 IS NULL OR d0 = d1 THEN v0 ELSE v0 + (v1 - v0) * date_diff('day', d0, at_date) / date_diff('day', d0, d1) END, 6) AS value FROM ab"""))
def ts_interp(spark, sf):
    obs = view(spark, sf, "obs")
    at = obs.select("series_id").distinct().withColumn("at_date", F.lit("1996-07-01").cast("date"))
    return rounded(S.interpolate(obs, at, K))


_Z = S.Z95_EXACT
_STUDENT = f"({_Z} + {(_Z**3 + _Z) / 4} / nu + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / nu ** 2 + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / nu ** 3 + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / nu ** 4)"


@query("rate_bayes_linear", duck("obs", then=f""", r AS (SELECT series_id, date_diff('day', DATE '1970-01-01', obs_date) / 365.25 - 25 AS x, value AS y FROM obs),
 s AS (SELECT series_id, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM r GROUP BY 1),
 t AS (SELECT *, (n + 0.01) * (sxx + 0.01) - sx * sx AS det, ((n + 0.01) * sxy - sx * sy) / ((n + 0.01) * (sxx + 0.01) - sx * sx) AS slope, ((sxx + 0.01) * sy - sx * sxy) / ((n + 0.01) * (sxx + 0.01) - sx * sx) AS level FROM s),
 u AS (SELECT *, 2 + n / 2.0 AS an, 4.0::DOUBLE + n AS nu, 1 + greatest(0, syy - slope * sxy - level * sy) / 2 AS bn FROM t)
 SELECT series_id, round(slope, 6) AS slope, round(level, 6) AS level, round(sqrt(bn / (an - 1)), 6) AS noise, round(slope - {_STUDENT} * sqrt(bn / an * (n + 0.01) / det), 6) AS slope_low, round(slope + {_STUDENT} * sqrt(bn / an * (n + 0.01) / det), 6) AS slope_high, n FROM u"""))
def rate_bayes_linear(spark, sf):
    return rounded(S.bayes_linear(view(spark, sf, "obs"), K))


@query("rate_distribution", duck("obs", then=_EPR + """ SELECT round(median(rate), 6) AS p50, round(quantile_cont(rate, 0.16), 6) AS p16, round(quantile_cont(rate, 0.84), 6) AS p84, round(min(rate), 6) AS lowest, round(max(rate), 6) AS highest, round(median(rate) * 27, 6) AS p50_27y FROM epr"""))
def rate_distribution(spark, sf):
    q = F.percentile("rate", F.array(F.lit(0.5), F.lit(0.16), F.lit(0.84)))
    r = S.end_point(view(spark, sf, "obs"), K).agg(q.alias("q"), F.min("rate").alias("lowest"), F.max("rate").alias("highest"))
    return rounded(r.select(F.col("q")[0].alias("p50"), F.col("q")[1].alias("p16"), F.col("q")[2].alias("p84"), "lowest", "highest", (F.col("q")[0] * 27).alias("p50_27y")))
