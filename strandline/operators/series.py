"""Time-series operators: one series of dated positions for each transect.

``keys`` names the columns that identify a series.  Days count from 1970-01-01.
Regressions use years of 365.25 days, and sums are centred by Spark's ``regr_*``
functions or on the last date, so large day numbers cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from strandline.functions.expr import let
from strandline.operators.slopes import median_slope

YEAR = 365.25
#: Two-sided 95 % points: as rounded in regression intervals, and exact for rank intervals.
Z95, Z95_EXACT = 1.96, 1.959963984540054


def days(date: Column | str) -> Column:
    """Days since 1970-01-01."""
    return F.datediff(F.col(date) if isinstance(date, str) else date, F.lit("1970-01-01").cast("date")).cast("double")


def upsert(raw: DataFrame, keys: list[str]) -> DataFrame:
    """One observation for each series and date: of equal dates the last to arrive stays.

    ``raw`` has obs_date, value, error, source and arrival.  Ties of arrival go
    to the larger value, then the larger source.
    """
    last = F.max(F.struct("arrival", "value", "source", "error"))
    return raw.groupBy(*keys, "obs_date").agg(last.alias("o")).select(*keys, "obs_date", "o.value", "o.error", "o.source")


def reset(obs: DataFrame, signals: DataFrame, keys: list[str]) -> DataFrame:
    """``obs`` without the series named in ``signals``."""
    return obs.join(signals.select(*keys).distinct(), keys, "left_anti")


def latest(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Last and first observation of each series, side by side."""
    o = F.struct("obs_date", "value", "source")
    return obs.groupBy(*keys).agg(F.max(o).alias("b"), F.min(o).alias("a"), F.count("*").alias("n")).select(
        *keys, F.col("b.obs_date").alias("latest_date"), F.col("b.value").alias("latest_value"), F.col("b.source").alias("latest_source"),
        F.col("a.obs_date").alias("oldest_date"), F.col("a.value").alias("oldest_value"), "n")


def end_point(obs: DataFrame, keys: list[str]) -> DataFrame:
    """(last - first) / years and its uncertainty; series of one date have none."""
    o = F.struct("obs_date", "value", "error")
    ends = obs.groupBy(*keys).agg(F.min(o).alias("a"), F.max(o).alias("b"))
    years = F.datediff("b.obs_date", "a.obs_date") / YEAR
    return ends.filter(F.col("b.obs_date") > F.col("a.obs_date")).select(
        *keys, ((F.col("b.value") - F.col("a.value")) / years).alias("rate"),
        (F.sqrt(F.col("a.error") ** 2 + F.col("b.error") ** 2) / years).alias("rate_unc"),
        F.col("a.obs_date").alias("start_date"), F.col("b.obs_date").alias("end_date"))


def least_squares(obs: DataFrame, keys: list[str], years: int | None = None) -> DataFrame:
    """Ordinary least squares over all dates, or those of the last ``years``.

    Needs 3 observations in all and 2 in the window; standard errors and R2
    need 3 in the window.
    """
    rows = obs.select(*keys, days("obs_date").alias("x"), F.col("value").alias("y"))
    whole = Window.partitionBy(*keys)
    rows = rows.withColumn("all_n", F.count("*").over(whole)).filter("all_n >= 3")
    if years is not None:
        rows = rows.withColumn("last_x", F.max("x").over(whole)).filter(F.col("x") >= F.col("last_x") - years * YEAR)
    sums = rows.groupBy(*keys).agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("intercept"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    rss = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"))
    enough = (F.col("n") > 2) & (F.col("sxx") > 0)
    se = F.when(enough, F.sqrt(rss / (F.col("n") - 2) / F.col("sxx")) * YEAR)
    return sums.filter("n >= 2 and sxx > 0").select(
        *keys, (F.col("b") * YEAR).alias("rate"), se.alias("rate_se"), (Z95 * se).alias("rate_unc"),
        F.when(enough, F.sqrt(rss / (F.col("n") - 2))).alias("residual_se"), "intercept",
        F.when(enough & (F.col("syy") > 0), F.round(1 - rss / F.col("syy"), 3)).alias("r2"), "n",
        F.date_add(F.lit("1970-01-01").cast("date"), F.col("x0").cast("int")).alias("start_date"), F.date_add(F.lit("1970-01-01").cast("date"), F.col("x1").cast("int")).alias("end_date"))


def _median(sorted_array: Column) -> Column:
    n = F.size(sorted_array)
    return (F.get(sorted_array, F.floor((n - 1) / 2).cast("int")) + F.get(sorted_array, F.floor(n / 2).cast("int"))) / 2


def _with_slopes(packed: DataFrame) -> DataFrame:
    """``packed`` with ``slopes`` (b, lo, hi) of each series' dates and values ``_p``, by ``median_slope``."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("_p")
            ends, flat = own.offsets.to_numpy() - own.offsets[0].as_py(), own.flatten()
            x, y = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = [median_slope(x[i:j], y[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            slopes = pa.array([None if f is None else dict(zip(("b", "lo", "hi"), f, strict=True)) for f in found], _SLOPES)
            yield pa.RecordBatch.from_arrays([*batch.columns, slopes], [*batch.schema.names, "slopes"])

    return packed.mapInArrow(rank, StructType([*packed.schema.fields, StructField("slopes", StructType.fromDDL("b double, lo double, hi double"))]))


_SLOPES = pa.struct([(n, pa.float64()) for n in ("b", "lo", "hi")])


def _around() -> dict[str, Column]:
    """Intercept, residual and total squares of the packed values ``_p`` around the line of median slope."""
    b = F.col("slopes.b")
    values = F.transform("_p", lambda o: o["y"])
    level = _median(F.sort_array(values)) - b * _median(F.transform("_p", lambda o: o["x"]))
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size("_p")
    rss = lambda a: F.aggregate("_p", F.lit(0.0), lambda s, o: s + (o["y"] - a - b * o["x"]) ** 2)
    tss = lambda m: F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - m) ** 2)
    return {"ts_a": level, "ts_rss": let(level, rss), "ts_tss": let(mean, tss)}


def theil_sen(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Median of the slopes of all pairs of a series, with its 95 % rank interval.

    A series is one row, packed in order of date; no pair leaves it.  Its
    slopes are ranked in bounded memory, so a series may have many thousand dates.
    """
    packed = obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(days("obs_date").alias("x"), F.col("value").alias("y")))).alias("_p"))
    fit = _with_slopes(packed).filter("slopes is not null").withColumns(_around())
    c = F.col
    return fit.select(
        *keys, (c("slopes.b") * YEAR).alias("rate"), (c("slopes.lo") * YEAR).alias("rate_lo"), (c("slopes.hi") * YEAR).alias("rate_hi"),
        F.sqrt(c("ts_rss") / (F.size("_p") - 2)).alias("residual_se"), c("ts_a").alias("intercept"),
        F.when(c("ts_tss") > 0, F.round(1 - c("ts_rss") / c("ts_tss"), 3)).alias("r2"), F.size("_p").cast("long").alias("n"))


def time_weighted(obs: DataFrame, keys: list[str], tau: float = 10.0) -> DataFrame:
    """Regression weighted by recency (e-folding ``tau`` years) and 1 / error squared.

    The fit minimises squares of weighted residuals, so its weights are those
    squared.  The residual variance is weighted once; spread and total squares
    are unweighted.  Series with a missing error have no rate.
    """
    whole = Window.partitionBy(*keys)
    rows = obs.select(*keys, days("obs_date").alias("d"), F.col("value").alias("y"), "error")
    rows = rows.withColumn("last", F.max("d").over(whole)).withColumn("x", F.col("d") - F.col("last"))
    rows = rows.withColumn("w", F.exp(F.col("x") / (YEAR * tau)) / F.col("error") ** 2)
    rows = rows.withColumn("sw", F.sum("w").over(whole)).withColumn("w", F.col("w") / F.col("sw")).withColumn("q", F.col("w") ** 2)
    total = lambda c: F.sum(c).over(whole)
    rows = (
        rows.withColumn("n", F.count("*").over(whole)).withColumn("known", F.count("error").over(whole)).filter("n >= 3 and known = n")
        .withColumn("mx", total(F.col("q") * F.col("x")) / total("q")).withColumn("my", total(F.col("q") * F.col("y")) / total("q"))
        .withColumn("b", total(F.col("q") * (F.col("x") - F.col("mx")) * (F.col("y") - F.col("my"))) / total(F.col("q") * (F.col("x") - F.col("mx")) ** 2))
        .withColumn("r", F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")))
    )
    sums = rows.groupBy(*keys).agg(
        F.first("b").alias("b"), (F.first("my") - F.first("b") * (F.first("mx") + F.first("last"))).alias("intercept"), F.sum(F.col("w") * F.col("r") ** 2).alias("rss"),
        F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy"), F.count("*").alias("n"))
    se = F.sqrt(F.col("rss") / (F.col("n") - 2) / F.col("sxx")) * YEAR
    return sums.filter("sxx > 0").select(
        *keys, (F.col("b") * YEAR).alias("rate"), se.alias("rate_se"), (Z95 * se).alias("rate_unc"), F.sqrt(F.col("rss") / (F.col("n") - 2)).alias("residual_se"), "intercept",
        F.when(F.col("syy") > 0, F.round(1 - F.col("rss") / F.col("syy"), 3)).alias("r2"), "n")


METHODS = ("EPR", "OLS", "OLS5", "OLS10", "TheilSen", "TWR")


def rates(obs: DataFrame, keys: list[str], method: str = "TWR", tau: float = 10.0) -> DataFrame:
    """The rates of one method, with rate_se and residual_se (null where the method has none)."""
    fits = {
        "EPR": lambda: end_point(obs, keys), "OLS": lambda: least_squares(obs, keys), "OLS5": lambda: least_squares(obs, keys, 5),
        "OLS10": lambda: least_squares(obs, keys, 10), "TheilSen": lambda: theil_sen(obs, keys), "TWR": lambda: time_weighted(obs, keys, tau)}
    if method not in fits:
        raise ValueError(f"no such method: {method}")
    fit = fits[method]()
    return fit.withColumns({c: F.lit(None).cast("double") for c in ("rate_se", "residual_se") if c not in fit.columns})


def all_rates(obs: DataFrame, keys: list[str], tau: float = 10.0) -> DataFrame:
    """(keys, method, rate, rate_se, rate_unc, residual_se, intercept, r2, n) for all six methods.

    Each series is dealt to its task once and aggregated once, into the sums of
    all methods and its packed dates and values; the methods are rows made of that one.
    """
    c, by = F.col, Window.partitionBy(*keys)
    rows = obs.select(*keys, days("obs_date").alias("d"), c("value").alias("y"), "error").withColumn("last", F.max("d").over(by)).withColumn("t", c("d") - c("last"))
    rows = rows.withColumn("w", F.exp(c("t") / (YEAR * tau)) / c("error") ** 2).withColumn("q", c("w") ** 2)
    end = F.struct("d", "y", "error")
    sums = [F.count("*").alias("n"), F.count("error").alias("known"), F.first("last").alias("last"), F.min(end).alias("a"), F.max(end).alias("b"),
            F.array_sort(F.collect_list(F.struct(c("d").alias("x"), "y", "w"))).alias("_p"),
            F.sum("w").alias("sw"), F.sum("q").alias("sq"), (F.sum(c("q") * c("t")) / F.sum("q")).alias("mx"), (F.sum(c("q") * c("y")) / F.sum("q")).alias("my"), F.sum(c("q") * c("t") * c("y")).alias("qty"), F.sum(c("q") * c("t") * c("t")).alias("qtt")]
    for name, years in (("OLS", None), ("OLS5", 5), ("OLS10", 10)):
        t = c("t") if years is None else F.when(c("t") >= -years * YEAR, c("t"))
        sums.append(F.struct(F.regr_slope("y", t).alias("b"), F.regr_intercept("y", t).alias("a"), F.regr_sxx("y", t).alias("sxx"), F.regr_syy("y", t).alias("syy"), F.regr_sxy("y", t).alias("sxy"), F.regr_count("y", t).alias("n")).alias(name))
    s = _with_slopes(rows.groupBy(*keys).agg(*sums)).withColumns(_around())
    s = s.withColumn("tb", (c("qty") - c("sq") * c("mx") * c("my")) / F.nullif(c("qtt") - c("sq") * c("mx") ** 2, F.lit(0.0)))
    s = s.withColumn("twr_rss", F.aggregate("_p", F.lit(0.0), lambda z, o: z + o["w"] * (o["y"] - c("my") - c("tb") * (o["x"] - c("last") - c("mx"))) ** 2) / c("sw"))
    none = F.lit(None).cast("double")

    def method(name: str, valid: Column, **values: Column) -> Column:
        fields = {"rate": none, "rate_se": none, "rate_unc": none, "residual_se": none, "intercept": none, "r2": none, "n": F.lit(None).cast("long")} | values
        return F.when(valid, F.struct(F.lit(name).alias("method"), *[v.cast("long" if k == "n" else "double").alias(k) for k, v in fields.items()]))

    def ols(name: str) -> Column:
        f = lambda x: c(f"{name}.{x}")
        rss = F.greatest(F.lit(0.0), f("syy") - f("sxy") ** 2 / f("sxx"))
        enough = f("n") > 2
        se = F.when(enough, F.sqrt(rss / (f("n") - 2) / f("sxx")) * YEAR)
        return method(name, (c("n") >= 3) & (f("n") >= 2) & (f("sxx") > 0), rate=f("b") * YEAR, rate_se=se, rate_unc=Z95 * se, residual_se=F.when(enough, F.sqrt(rss / (f("n") - 2))),
                      intercept=f("a") - f("b") * c("last"), r2=F.when(enough & (f("syy") > 0), F.round(1 - rss / f("syy"), 3)), n=f("n"))

    years = (c("b.d") - c("a.d")) / YEAR
    se = F.sqrt(c("twr_rss") / (c("n") - 2) / c("OLS.sxx")) * YEAR
    parts = F.array(
        method("EPR", c("b.d") > c("a.d"), rate=(c("b.y") - c("a.y")) / years, rate_unc=F.sqrt(c("a.error") ** 2 + c("b.error") ** 2) / years),
        ols("OLS"), ols("OLS5"), ols("OLS10"),
        method("TheilSen", c("slopes").isNotNull(), rate=c("slopes.b") * YEAR, residual_se=F.sqrt(c("ts_rss") / (c("n") - 2)), intercept=c("ts_a"), r2=F.when(c("ts_tss") > 0, F.round(1 - c("ts_rss") / c("ts_tss"), 3)), n=c("n")),
        method("TWR", (c("n") >= 3) & (c("known") == c("n")) & (c("OLS.sxx") > 0), rate=c("tb") * YEAR, rate_se=se, rate_unc=Z95 * se, residual_se=F.sqrt(c("twr_rss") / (c("n") - 2)),
               intercept=c("my") - c("tb") * (c("mx") + c("last")), r2=F.when(c("OLS.syy") > 0, F.round(1 - c("twr_rss") / c("OLS.syy"), 3)), n=c("n")))
    return s.select(*keys, F.explode(F.filter(parts, lambda m: m.isNotNull())).alias("m")).select(*keys, "m.*")


def fitted(obs: DataFrame, rates: DataFrame, keys: list[str]) -> DataFrame:
    """Fitted value and residual of each observation under its series' line."""
    line = rates.select(*keys, (F.col("rate") / YEAR).alias("b"), "intercept")
    value = F.col("intercept") + F.col("b") * days("obs_date")
    return obs.join(line, keys).select(*keys, "obs_date", "value", value.alias("fitted"), (F.col("value") - value).alias("residual"))


def student_point(z: float, freedom: Column) -> Column:
    """The point of Student's law that is ``z`` on the normal law, by its expansion in 1 / ``freedom`` (from 5 on to three decimals)."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return sum((F.lit(t) / freedom ** (i + 1) for i, t in enumerate(terms)), F.lit(z))


def bayes_linear(obs: DataFrame, keys: list[str], prior_sd: float = 10.0, shape: float = 2.0, scale: float = 1.0) -> DataFrame:
    """(keys, slope, level, noise, slope_low, slope_high, n): posterior of a line with unknown noise.

    The prior is conjugate: noise variance inverse gamma (``shape``, ``scale``),
    slope and level normal around 0 with ``prior_sd`` times the noise.  Slope
    and level are posterior means (years counted from 1995), ``noise`` the root
    of the mean variance, and the interval holds 95 % of the slope's posterior,
    a Student law with twice the posterior shape as freedom.
    """
    years = days("obs_date") / YEAR
    rows = obs.filter("value is not null").select(*keys, (years - 25).alias("x"), F.col("value").alias("y"))
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") ** 2).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("y") ** 2).alias("syy"))
    c = F.col
    p = 1 / prior_sd**2
    a, b, d = c("n") + p, c("sx"), c("sxx") + p
    s = s.withColumn("det", a * d - b * b).withColumns({"slope": (a * c("sxy") - b * c("sy")) / c("det"), "level": (d * c("sy") - b * c("sxy")) / c("det")})
    s = s.withColumns({"shape": shape + c("n") / 2, "scale": scale + F.greatest(F.lit(0.0), c("syy") - c("slope") * c("sxy") - c("level") * c("sy")) / 2})
    half = student_point(Z95_EXACT, 2 * c("shape")) * F.sqrt(c("scale") / c("shape") * a / c("det"))
    return s.select(*keys, "slope", "level", F.sqrt(c("scale") / (c("shape") - 1)).alias("noise"), (c("slope") - half).alias("slope_low"), (c("slope") + half).alias("slope_high"), "n")


def source_date(obs: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """First date of each series whose source ends with ``suffix``; null where none does."""
    return obs.groupBy(*keys).agg(F.min(F.when(F.col("source").endswith(suffix), F.col("obs_date"))).alias("source_date"))


def interpolate(obs: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """Value of each series at ``at_date``, linear between dates, clamped at the ends.

    ``at`` has the keys and at_date.  Both neighbours come from one grouping.
    """
    o = F.struct("obs_date", "value")
    pairs = obs.join(at, keys)
    both = pairs.groupBy(*keys, "at_date").agg(F.max(F.when(F.col("obs_date") <= F.col("at_date"), o)).alias("a"), F.min(F.when(F.col("obs_date") >= F.col("at_date"), o)).alias("b"))
    span = F.datediff("b.obs_date", "a.obs_date")
    inside = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * F.datediff("at_date", "a.obs_date") / F.when(span > 0, span)
    return both.select(*keys, "at_date", F.coalesce(inside, F.col("a.value"), F.col("b.value")).alias("value"))


def as_of(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` (keys, obs_date, value) with ``at_date`` and ``at_value``: the last of ``right`` at or before its date, else the first of all.

    Both sides are sorted once by series and date; a date of both counts as at it.
    """
    rows = left.select(*keys, "obs_date", "value", F.lit(1).alias("_side"), F.lit(None).cast("struct<d: date, v: double>").alias("_o")).unionByName(
        right.select(*keys, "obs_date", F.lit(None).cast("double").alias("value"), F.lit(0).alias("_side"), F.struct(F.col("obs_date").alias("d"), F.col("value").alias("v")).alias("_o")))
    by = Window.partitionBy(*keys).orderBy("obs_date", "_side")
    before = F.last("_o", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_o", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn("_at", F.coalesce(before, after)).filter("_side = 1").select(*keys, "obs_date", "value", F.col("_at.d").alias("at_date"), F.col("_at.v").alias("at_value"))


def offset_of(second: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, offset): how far the first series lies past the second at the second's latest date, as of that date."""
    newest = second.groupBy(*keys).agg(F.max(F.struct("obs_date", "value")).alias("o")).select(*keys, "o.obs_date", "o.value")
    return as_of(newest, first, keys).filter("at_value is not null").select(*keys, (F.col("at_value") - F.col("value")).alias("offset"))
