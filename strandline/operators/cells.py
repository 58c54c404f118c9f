"""Scores and summaries of coastal cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expr import clip

# Weights and limits of the survey-priority scores.
NEVER_SURVEYED_FLOOR, HARD_ROCK = 0.8, 0.9
INTERVAL_MOVE, INTERVAL_MIN, INTERVAL_MAX = 2.0, 1.0, 10.0


def erosion(cells: DataFrame, rates: DataFrame) -> DataFrame:
    """Transects, eroding transects (rate < 0) and their median and 10th percentile, by cell.

    Cells without transects have nulls; cells without eroding ones 0 and nulls.
    """
    eroding = F.when(F.col("hist_rate") < 0, F.col("hist_rate"))
    sums = rates.groupBy("cell_id").agg(
        F.count("*").alias("n_trans"), F.count(eroding).alias("n_eros"), F.median(eroding).alias("eros_med"), F.percentile(eroding, 0.1).alias("eros_p10"))
    sums = sums.withColumn("eros_frac", F.col("n_eros") / F.col("n_trans"))
    return cells.select("cell_id").join(sums, "cell_id", "left")


def coast_type(cells: DataFrame, parts: DataFrame) -> DataFrame:
    """Length by hard, soft and artificial coast, fractions and the dominant type (first of equals)."""
    sums = parts.groupBy("cell_id").agg(*[F.coalesce(F.sum(F.when(F.col("ct") == t, F.col("len"))), F.lit(0.0)).alias(f"len_{t.lower()}") for t in "HSA"])
    total = F.col("len_h") + F.col("len_s") + F.col("len_a")
    most = F.greatest("len_h", "len_s", "len_a")
    out = sums.select(
        "cell_id", "len_h", "len_s", "len_a", total.alias("len_total"), *[(F.col(f"len_{t}") / F.when(total > 0, total)).alias(f"frac_{t}") for t in "hsa"],
        F.when(F.col("len_h") == most, "H").when(F.col("len_s") == most, "S").otherwise("A").alias("dominant"))
    return cells.select("cell_id").join(out, "cell_id", "left")


def age_score(age: Column) -> Column:
    """0 to 0.6 over five years, to 1 over ten; never surveyed 1; negative ages 0."""
    return F.when(age.isNull() | (age >= 10), 1.0).when(age < 0, 0.0).when(age <= 5, 0.6 * age / 5).otherwise(0.6 + 0.4 * (age - 5) / 5)


def asset_score(flag: Column) -> Column:
    clean = F.upper(F.trim(flag))
    return F.when(clean == "Y", 1.0).when(clean == "N", 0.0)


def coast_score(soft: Column, artificial: Column) -> Column:
    return clip(soft + 0.5 * artificial, 0.0, 1.0)


def low_lying_score(low5: Column) -> Column:
    return clip(low5, 0.0, 1.0)


def erosion_score(frac: Column, med: Column, p10: Column) -> Column:
    """Share, median and 10th percentile of erosion; missing terms of a cell without erosion are 0."""
    term = lambda c, full: F.coalesce(F.least(F.abs(c) / full, F.lit(1.0)), F.lit(0.0))
    return F.when(frac.isNotNull(), F.when(frac <= 0, 0.0).otherwise(0.5 * frac + 0.3 * term(med, 1.0) + 0.2 * term(p10, 2.0)))


def priority(scores: DataFrame, columns: list[str], year: str, hard: str, assets: str) -> DataFrame:
    """Mean of the scores that exist, with the floor and the rock rule applied in that order."""
    listed = F.filter(F.array(*columns), lambda s: s.isNotNull())
    mean = F.aggregate(listed, F.lit(0.0), lambda s, x: s + x) / F.when(F.size(listed) > 0, F.size(listed))
    floored = F.when(F.col(year).isNull(), F.greatest(mean, F.lit(NEVER_SURVEYED_FLOOR))).otherwise(mean)
    rock = (F.col(hard) >= HARD_ROCK) & (F.coalesce(F.col(assets), F.lit(0.0)) == 0)
    return scores.withColumn("priority", F.when(rock, 0.0).otherwise(floored)).withColumn("n_score", F.size(listed)).withColumn("score_ok", F.size(listed) == len(columns))


def survey_interval(med: Column) -> Column:
    """Years in which an eroding cell moves two metres, from 1 to 10."""
    return F.when(med < 0, clip(INTERVAL_MOVE / F.abs(med), INTERVAL_MIN, INTERVAL_MAX))


def mean_erosion(rates: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count and mean over eroding rows only; 0 where there are none."""
    loss = F.when(F.col(value) < 0, F.col(value))
    return rates.groupBy(*keys).agg(F.count(loss).alias("n_eroding"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("mean_erosion"))


def rollup_summary(rates: DataFrame) -> DataFrame:
    """Counts, eroding counts and means by (cell, subcell), by cell and for all."""
    loss = F.when(F.col("hist_rate") < 0, F.col("hist_rate"))
    return rates.rollup("cell", "subcell").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.count(loss).alias("n_eros"), F.avg(loss).alias("mean_eros"),
        (100.0 * F.count(loss) / F.count("*")).alias("pct_eros"))


def histogram(rows: DataFrame, value: str, width: float, keys: list[str]) -> DataFrame:
    """Density of ``value`` in bins of ``width`` that start at its smallest, within ``keys``."""
    low = rows.groupBy(*keys).agg(F.min(value).alias("low"), F.count(value).alias("total"))
    joined = rows.filter(F.col(value).isNotNull()).join(low, keys) if keys else rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(low))
    bins = joined.withColumn("bin", F.floor((F.col(value) - F.col("low")) / width)).groupBy(*keys, "low", "total", "bin").agg(F.count("*").alias("n"))
    return bins.select(*keys, (F.col("low") + F.col("bin") * width).alias("left_edge"), "n", (F.col("n") / (F.col("total") * width)).alias("density"))
