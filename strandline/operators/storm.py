"""Storm impact on barriers, one row for each transect and scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.expr import runup

REGIMES = ("Swash", "Collision", "Overwash", "Inundation", "NB_Swash", "NB_Collision", "NB_Overwash", "NB_Inundation", "NB_NoAsset")
#: Future scenarios and the mid-century scenario of the same pathway.
MIDDLE = {"M45": "M45", "M85": "M85", "E45": "M45", "E85": "M85"}


def adjust_tp(tp: Column, subcell: Column) -> Column:
    """Peak period of short-fetch subcells, reduced."""
    return F.when(subcell.isin("6f", "7"), tp * 0.67).otherwise(tp)


def with_runup(storm: DataFrame, pure_gravel: bool = False) -> DataFrame:
    up, setup, flat = runup(F.col("hs"), F.col("tp"), F.col("slope"), F.col("shingle"), pure_gravel)
    return storm.withColumns({"runup": up, "setup": setup, "dissipative": flat})


def with_levels(storm: DataFrame) -> DataFrame:
    """Total water level and level of the setup alone."""
    return storm.withColumns({"twl": F.col("esl") + F.col("runup"), "setup_level": F.col("esl") + F.col("setup")})


def future_dunes(storm: DataFrame) -> DataFrame:
    """Toe and crest of each scenario after sea-level rise.

    The toe rises with the sea.  The crest keeps up to mid-century unless the
    transect erodes or its rate is unknown.  A toe above its crest is drowned.
    """
    mid = F.create_map(*[F.lit(x) for p in MIDDLE.items() for x in p])
    other = storm.select("transect_id", F.col("scenario").alias("mid_scenario"), F.col("slr").alias("mid_slr"))
    rows = storm.withColumn("mid_scenario", mid[F.col("scenario")]).join(other, ["transect_id", "mid_scenario"], "left")
    toe = F.when(F.col("mid_scenario").isNull(), F.col("toe")).otherwise(F.col("toe") + F.col("slr"))
    rises = F.col("mid_scenario").isNotNull() & F.col("hist_rate").isNotNull() & (F.col("hist_rate") >= 0)
    crest = F.when(rises, F.col("crest") + F.col("mid_slr")).otherwise(F.col("crest"))
    rows = rows.withColumns({"toe_f": toe, "crest_0": crest})
    drowned = F.col("mid_scenario").isNotNull() & (F.col("toe_f") > F.col("crest_0"))
    return rows.withColumn("drowned", drowned).withColumn("crest_f", F.when(drowned, F.col("toe_f")).otherwise(F.col("crest_0"))).drop("mid_scenario", "mid_slr", "crest_0")


def regime(twl: Column, setup_level: Column, toe: Column, crest: Column, barrier: Column, asset_dist: Column, asset_elev: Column) -> Column:
    """The storm-impact regime; a level equal to a limit is not assigned."""
    own = (
        F.when(twl < toe, "Swash").when((twl > toe) & (twl < crest), "Collision")
        .when(twl > crest, F.when(setup_level > crest, "Inundation").otherwise("Overwash"))
    )
    asset = (
        F.when(twl > asset_elev, F.when(setup_level > asset_elev, "NB_Inundation").otherwise("NB_Overwash"))
        .when(asset_elev - twl > 5, "NB_Swash").otherwise("NB_Collision")
    )
    return F.when(barrier, own).when(asset_dist < 200, asset).otherwise("NB_NoAsset")


def regime_counts(storm: DataFrame, keys: list[str]) -> DataFrame:
    """Transects of each regime, one column for each."""
    return storm.groupBy(*keys).agg(*[F.count_if(F.col("regime") == r).alias(r.lower()) for r in REGIMES])


def nearest_asset(columns: list[str], length: Column) -> Column:
    """Distance to the nearest asset on the landward half of a transect, else null."""
    near = F.least(*columns)
    return F.when(near < length / 2, near)


def asset_bin(dist: Column) -> Column:
    """Distance rounded half-even to the 5 m of a profile."""
    return F.bround(dist / 5, 0) * 5
