"""Projection of shoreline positions under sea-level scenarios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from strandline.functions.deviates import drawn, key_words
from strandline.functions.stage import few

YEAR = 365.2425


def hinterland_slope(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of a line through the seaward end of the land, near points weighing more.

    Nodes above zero; distance from their first; weight the root of the
    distance to the last.  Slopes of zero or less are 0.001.
    """
    land = profile.filter("z > 0").withColumn("d", F.col("dist") - F.min("dist").over(Window.partitionBy(*keys))).withColumn("far", F.max("d").over(Window.partitionBy(*keys)))
    w = F.col("far") - F.col("d")
    s = land.groupBy(*keys).agg((F.sum(w * F.col("d") * F.col("z")) / F.nullif(F.sum(w * F.col("d") * F.col("d")), F.lit(0.0))).alias("slope"))
    return s.select(*keys, F.when(F.col("slope") <= 0, 0.001).otherwise(F.coalesce("slope", F.lit(1.0))).alias("slope"))


def calibration_rslr(latest: Column, hist_mm: Column, date2: Column, l1: Column, l2: Column, date1: Column) -> Column:
    """Sea-level rate five years before the latest date, between the historical and the first future rate."""
    start, at = F.add_months(latest, -120), F.add_months(latest, -60)
    first = (l2 - l1) / (F.datediff(date2, date1) / YEAR)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.datediff(at, start) / F.nullif(F.datediff(date2, start).cast("double"), F.lit(0.0))))
    return hist_mm / 1000 + (first - hist_mm / 1000) * F.coalesce(share, F.lit(0.0))


def _level(p: str, field: str) -> Column:
    """``field`` of the dated entries ``p`` at latest_date: linear between dates, clamped at the ends."""
    before = F.array_max(F.filter(p, lambda a: a["proj_date"] <= F.col("latest_date")))
    after = F.array_min(F.filter(p, lambda a: a["proj_date"] >= F.col("latest_date")))
    span = F.datediff(after["proj_date"], before["proj_date"]).cast("double")
    inside = before[field] + (after[field] - before[field]) * F.datediff("latest_date", before["proj_date"]) / F.nullif(span, F.lit(0.0))
    return F.coalesce(inside, before[field], after[field])


def with_levels(state: DataFrame, rsl: DataFrame, place: list[str] | None = None) -> DataFrame:
    """``state`` with scenario, percentile and ``p``, the array of (proj_date, level) in order, for each of them.

    ``rsl`` (scenario, percentile, proj_date, level) is a dimension of a few
    rows for each scenario.  With ``place``, columns of both sides, it holds
    levels for each place instead, and the two are joined on them by Spark's
    own choice of join.  ``level0`` is the level at latest_date, ``first`` and
    ``second`` are the first two entries of ``p``.
    """
    place = place or []
    packed = rsl.groupBy(*place, "scenario", "percentile").agg(F.array_sort(F.collect_list(F.struct("proj_date", "level"))).alias("p"))
    rows = state.join(packed, place) if place else state.crossJoin(few(packed))
    return rows.withColumns({"level0": _level("p", "level"), "first": F.get("p", F.lit(0)), "second": F.get("p", F.lit(1))})


def _clamped(raw: Column) -> Column:
    """A distance held at the defence, else at the rock, where it lies landward of it."""
    c = F.col
    return F.when(c("defence").isNotNull() & (raw > c("defence")), c("defence")).when(c("rock").isNotNull() & (raw > c("rock")), c("rock")).otherwise(raw)


def with_sampled_levels(state: DataFrame, sampled: DataFrame, keys: list[str]) -> DataFrame:
    """As ``with_levels``, from levels sampled for each series: (keys, levels), an array of (scenario, percentile, proj_date, level).

    The array stays in the row of its series: nothing but ``state`` and the samples is shuffled.  The two are merged,
    as neither is small for the estimate of its files.
    """
    rows = state.join(sampled.select(*keys, "levels").hint("merge"), keys).withColumn("_s", F.explode(F.array_distinct(F.transform("levels", lambda a: F.struct(a["scenario"], a["percentile"])))))
    own = F.filter("levels", lambda a: (a["scenario"] == F.col("_s.scenario")) & (a["percentile"] == F.col("_s.percentile")))
    p = F.array_sort(F.transform(own, lambda a: F.struct(a["proj_date"], a["level"])))
    rows = rows.select(*state.columns, "_s.scenario", "_s.percentile", p.alias("p"))
    return rows.withColumns({"level0": _level("p", "level"), "first": F.get("p", F.lit(0)), "second": F.get("p", F.lit(1))})


def bruun(state: DataFrame, rsl: DataFrame, keys: list[str], place: list[str] | None = None) -> DataFrame:
    """Future distance and mean rate for each date of every scenario and percentile.

    ``state`` has the keys, latest_date, latest_distance, rate (landward
    positive), hist_rslr (mm a year), hinterland, shoreface, depth, and the
    limits defence and rock (null: none).  Sea levels are one dimension for all
    series, or those of each series' ``place``.
    """
    return projected(with_levels(state, rsl, place), keys)


def projected(base: DataFrame, keys: list[str]) -> DataFrame:
    """``bruun`` of a state that has its levels."""
    c = F.col
    s = F.greatest(F.least("hinterland", "shoreface"), F.lit(0.01))
    rc = calibration_rslr(c("latest_date"), c("hist_rslr"), c("second.proj_date"), c("first.level"), c("second.level"), c("first.proj_date"))
    base = base.withColumns({"h": -c("rate"), "s": s}).withColumn("v", c("depth") * c("h") + c("depth") / c("s") * rc)
    rows = base.withColumn("x", F.explode("p")).withColumns({"proj_date": c("x.proj_date"), "level": c("x.level")}).withColumn("dt", F.datediff("proj_date", "latest_date") / YEAR)
    change = -(c("level") - c("level0")) / c("s") + c("v") * c("dt") / c("depth")
    raw = c("latest_distance") - change
    d = F.when(c("dt") <= 0, c("latest_distance")).otherwise(_clamped(raw))
    return rows.withColumn("distance", d).select(*keys, "scenario", "percentile", "proj_date", "level", "latest_date", "latest_distance", "distance", F.when(c("dt") > 0, (c("latest_distance") - c("distance")) / c("dt")).otherwise(c("h")).alias("mean_rate"))


def future_change(future: DataFrame, keys: list[str]) -> DataFrame:
    """Change since the date before (erosion negative), its rate and the total since the latest position."""
    by = Window.partitionBy(*keys, "scenario", "percentile").orderBy("proj_date")
    before, date0 = F.coalesce(F.lag("distance").over(by), F.col("latest_distance")), F.coalesce(F.lag("proj_date").over(by), F.col("latest_date"))
    years = F.datediff("proj_date", date0) / YEAR
    return future.select(*keys, "scenario", "percentile", "proj_date", (before - F.col("distance")).alias("change"), ((before - F.col("distance")) / F.when(years > 0, years)).alias("period_rate"), (F.col("latest_distance") - F.col("distance")).alias("total"))


def first_erosion(future: DataFrame, keys: list[str]) -> DataFrame:
    """First year whose distance is further landward than the one before; null if none is."""
    by = Window.partitionBy(*keys, "scenario", "percentile").orderBy("proj_date")
    rows = future.withColumn("before", F.coalesce(F.lag("distance").over(by), F.col("latest_distance")))
    return rows.groupBy(*keys, "scenario", "percentile").agg(F.min(F.when(F.col("distance") > F.col("before"), F.year("proj_date"))).alias("first_year"))


#: The 95 % point of the normal law.
Z95 = 1.6448536269514722


def monte_carlo(
    state: DataFrame, rsl: DataFrame, keys: list[str], samples: int = 100, shares: tuple[float, ...] = (0.025, 0.16, 0.5, 0.84, 0.975), place: list[str] | None = None,
) -> DataFrame:
    """Percentiles of the future distance for each scenario and date: (keys, scenario, proj_date, latest_distance, q).

    ``state`` is that of ``bruun`` with rate_se and residual_se; its first key
    is a whole number that seeds the deviates together with the scenario.  A
    sample draws one rate, one residual and one sea-level score for all dates:
    the level is the median plus score times spread, with the spread from the
    5th and 95th percentile.  Samples are drawn and sorted in the task, a block
    of rows at a time, and never are rows of their own; percentiles are
    interpolated between sorted samples.  Series without rate, rate_se or residual_se have none.
    """
    c = F.col
    place = place or []
    level = lambda p: F.max(F.when(c("percentile") == p, c("level")))
    both = rsl.groupBy(*place, "scenario", "proj_date").agg(level(50).alias("mid"), ((level(95) - level(5)) / (2 * Z95)).alias("spread"))
    packed = both.groupBy(*place, "scenario").agg(F.array_sort(F.collect_list(F.struct("proj_date", "mid", "spread"))).alias("p"))
    known = state.filter("rate is not null and rate_se is not null and residual_se is not null")
    base = known.join(packed, place) if place else known.crossJoin(few(packed))
    # A row costs thousands of steps but few bytes: dealt by number, small partitions aren't joined to one.
    base = base.repartition(int(state.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "scenario").withColumn("_key", key_words(c(keys[0]), c("scenario")))
    base = base.withColumns({
        "s": F.greatest(F.least("hinterland", "shoreface"), F.lit(0.01)), "first": F.get("p", F.lit(0)), "second": F.get("p", F.lit(1)),
        "mid0": _level("p", "mid"), "spread0": _level("p", "spread")})

    # A sampled position is linear in its rate and score, so each date holds the factors and samples take a few steps each.
    years = lambda hist, n: calibration_rslr(c("latest_date"), hist, c("second.proj_date"), c(f"first.{n}"), c(f"second.{n}"), c("first.proj_date"))
    base = base.withColumns({"by_mid": years(c("hist_rslr"), "mid") / c("s"), "by_spread": years(F.lit(0.0), "spread") / c("s")})
    dt = lambda x: F.datediff(x["proj_date"], c("latest_date")) / YEAR
    moved = lambda x, n: (x[n] - c(f"{n}0")) / c("s") - c(f"by_{n}") * dt(x)
    dates = F.transform("p", lambda x: F.struct(x["proj_date"].alias("proj_date"), dt(x).alias("dt"), (c("latest_distance") + moved(x, "mid")).alias("base"), moved(x, "spread").alias("by_score")))
    rows = base.select(*keys, "scenario", "latest_distance", *[c("_key")[i].alias(f"_key{i}") for i in (0, 1)], *[c(n).cast("double").alias(f"_{n}") for n in ("rate", "rate_se", "residual_se", "latest_distance", "defence", "rock")], dates.alias("_dates"))
    own = [*keys, "scenario", "latest_distance"]

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dates = batch.column("_dates")
            counts = np.diff(dates.offsets.to_numpy())
            # Blocks of about half a million sampled positions.
            block = np.cumsum(counts) * samples // 500_000
            for at in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(block)) + 1):
                if len(at):
                    yield _sampled(batch.slice(at[0], len(at)), own, samples, shares)

    fields = [rows.schema[n] for n in own]
    schema = StructType([*fields[:-1], *StructType.fromDDL("proj_date date"), fields[-1], *StructType.fromDDL("q array<double>")])
    return rows.mapInArrow(sample, schema)


def _sampled(batch: pa.RecordBatch, own: list[str], samples: int, shares: tuple[float, ...]) -> pa.RecordBatch:
    """Percentiles of the sampled positions of each row and date; null where a factor is."""
    number = lambda a: a.to_numpy(zero_copy_only=False).astype(float)
    dates = batch.column("_dates")
    flat, row = dates.flatten(), np.repeat(np.arange(batch.num_rows), np.diff(dates.offsets.to_numpy()))
    n0, n1, z = drawn(np.column_stack([batch.column(f"_key{i}").to_numpy() for i in (0, 1)]), samples, 3)
    rate, rate_se, residual_se, latest, defence, rock = (number(batch.column(f"_{n}"))[:, None] for n in ("rate", "rate_se", "residual_se", "latest_distance", "defence", "rock"))
    rate, residual = rate + n0 * rate_se, n1 * residual_se
    dt, base, by_score = (number(flat.field(n))[:, None] for n in ("dt", "base", "by_score"))
    raw = base + dt * rate[row] + by_score * z[row]
    rock, defence, latest = rock[row], defence[row], latest[row]
    d = np.where(dt <= 0, latest, np.where(raw > defence, defence, np.where(raw > rock, rock, raw))) + residual[row]
    d.sort(axis=1)
    q = []
    for at in (share * (samples - 1) for share in shares):
        below, above = d[:, int(at)], d[:, min(int(at) + 1, samples - 1)]
        q.append(below + (above - below) * (at - int(at)))
    q = np.column_stack(q)
    missing = np.zeros(len(row), dtype=bool)
    needed = [latest] + [np.where(dt <= 0, 0.0, x) for x in (base, by_score, dt)]
    for x in needed:
        missing |= np.isnan(x[:, 0])
    values = pa.array(q.ravel(), mask=np.repeat(missing, len(shares)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1, dtype=np.int32) * len(shares), pa.int32()), values)
    held = [batch.column(n).take(pa.array(row)) for n in own]
    return pa.RecordBatch.from_arrays([*held[:-1], flat.field("proj_date"), held[-1], lists], [*own[:-1], "proj_date", own[-1], "q"])
