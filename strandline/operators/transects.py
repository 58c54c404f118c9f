"""Shore-normal transects: bearing across the line, sea at its start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.expr import ahead, along, bearing
from strandline.operators.lines import points


def generate(nodes: DataFrame, spacing: float, sea: float, land: float) -> DataFrame:
    """A transect every ``spacing`` metres: coast point, seaward start, landward end.

    The sea lies on the line's left, so the start is at its bearing less 90;
    ``orient`` is the bearing from start to end.
    """
    p = points(nodes, spacing, keep_ends=False)
    sx, sy = ahead(F.col("x"), F.col("y"), F.col("bearing") - 90, F.lit(float(sea)))
    ex, ey = ahead(F.col("x"), F.col("y"), F.col("bearing") + 90, F.lit(float(land)))
    return p.select("line_id", F.col("seq").alias("transect_id"), F.col("x").alias("coast_x"), F.col("y").alias("coast_y"), sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"), F.pmod(F.col("bearing") + 90, F.lit(360.0)).alias("orient"))


def length() -> Column:
    return F.hypot(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y"))


def redraw(t: DataFrame) -> DataFrame:
    """Bearing and length from the ends."""
    return t.withColumns({"orient": bearing(F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")), "length": length()})


def extend(t: DataFrame, sea: float, land: float) -> DataFrame:
    """Both ends further out."""
    sx, sy = ahead(F.col("start_x"), F.col("start_y"), F.col("orient") + 180, F.lit(float(sea)))
    ex, ey = ahead(F.col("end_x"), F.col("end_y"), F.col("orient"), F.lit(float(land)))
    return t.withColumns({"start_x": sx, "start_y": sy, "end_x": ex, "end_y": ey})


def window(t: DataFrame, first: Column, last: Column) -> DataFrame:
    """Transects cut to signed distances ``first`` (seaward) to ``last`` from the coast point."""
    sx, sy = ahead(F.col("coast_x"), F.col("coast_y"), F.col("orient"), first)
    ex, ey = ahead(F.col("coast_x"), F.col("coast_y"), F.col("orient"), last)
    return t.withColumns({"start_x": sx, "start_y": sy, "end_x": ex, "end_y": ey})


def truncate(t: DataFrame, spans: DataFrame, keys: list[str], least: float = 25.0) -> DataFrame:
    """Transects cut to the distances they need, at least ``least`` long around their middle.

    ``spans`` has the keys and ``distance``: all positions that must stay.
    """
    need = spans.groupBy(*keys).agg(F.min("distance").alias("d0"), F.max("distance").alias("d1"))
    short = F.greatest(F.lit(0.0), least - (F.col("d1") - F.col("d0"))) / 2
    return window(t.join(need, keys), F.col("d0") - short, F.col("d1") + short).drop("d0", "d1")


def sample_nodes(t: DataFrame, keys: list[str], spacing: float) -> DataFrame:
    """ceil(length / spacing) - 1 evenly spaced nodes, ends included, with signed distance."""
    rows = t.withColumn("_n", (F.ceil(length() / spacing) - 1).cast("int")).filter("_n >= 2")
    rows = rows.withColumn("ix", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("_t", F.col("ix") / (F.col("_n") - 1))
    x, y = F.col("start_x") + F.col("_t") * (F.col("end_x") - F.col("start_x")), F.col("start_y") + F.col("_t") * (F.col("end_y") - F.col("start_y"))
    return rows.select(*keys, "ix", x.alias("x"), y.alias("y"), along(x, y, F.col("coast_x"), F.col("coast_y"), F.col("orient")).alias("dist"))


def midpoints(t: DataFrame) -> DataFrame:
    """The line through the middles of each line's transects."""
    return t.select("line_id", F.col("transect_id").alias("seq"), ((F.col("start_x") + F.col("end_x")) / 2).alias("x"), ((F.col("start_y") + F.col("end_y")) / 2).alias("y"))


def fix_topology(t: DataFrame, crossings: DataFrame, thin: int = 1) -> DataFrame:
    """Runs of crossing transects respread evenly between their outer ends.

    ``crossings`` holds (line_id, transect_id) of transects that cross others.
    Within a run the end points move to equal steps between those of its first
    and last; every ``thin``-th transect of a run stays.
    """
    order = Window.partitionBy("line_id").orderBy("transect_id")
    flagged = t.join(crossings.select("line_id", "transect_id").distinct().withColumn("_flag", F.lit(1)), ["line_id", "transect_id"], "left").withColumn("_flag", F.coalesce("_flag", F.lit(0)))
    flagged = flagged.withColumn("_new", F.when(F.col("_flag") != F.coalesce(F.lag("_flag").over(order), F.lit(-1)), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(order))
    run = Window.partitionBy("line_id", "_run").orderBy("transect_id")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = flagged.withColumn("_i", F.row_number().over(run) - 1).withColumn("_n", F.count("*").over(whole))
    for end in ("start", "end"):
        for c in "xy":
            first, last = F.first(f"{end}_{c}").over(whole), F.last(f"{end}_{c}").over(whole)
            rows = rows.withColumn(f"_{end}_{c}", F.when((F.col("_flag") == 1) & (F.col("_n") > 1), first + (last - first) * F.col("_i") / (F.col("_n") - 1)).otherwise(F.col(f"{end}_{c}")))
    rows = rows.filter((F.col("_flag") == 0) | (F.col("_i") % thin == 0))
    return rows.select("line_id", "transect_id", "coast_x", "coast_y", *[F.col(f"_{e}_{c}").alias(f"{e}_{c}") for e in ("start", "end") for c in "xy"])


def drop_overlaps(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """Transects of which no two cross.

    ``pairs`` holds crossing (a, b) with lengths (la, lb).  The longest of all
    that still cross another goes, and so on (ties: the larger number).  One
    goes, then, just when it crosses a shorter one: the shorter cannot have
    gone before it.  So one pass tells which, however long a run of crossings is.
    """
    mine, other = F.struct(F.col("la").alias("l"), F.col("a").alias("i")), F.struct(F.col("lb").alias("l"), F.col("b").alias("i"))
    longer = F.when(mine > other, F.col("a")).otherwise(F.col("b"))
    gone = pairs.filter("line_id is not null and a <> b").select("line_id", longer.alias("transect_id")).distinct()
    return t.join(gone, ["line_id", "transect_id"], "left_anti")


def nearest_part(t: DataFrame, key: str, pieces: DataFrame, poly: str, more: float) -> DataFrame:
    """Transects cut to the one of their pieces (key, polygon, t0, t1) whose middle is nearest the coast point, and ``more`` metres longer at both ends.

    Transects without a piece are left out, the others numbered anew along
    their line.  Ties go to the smaller polygon.
    """
    c, dx, dy = F.col, F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    m = (c("t0") + c("t1")) / 2
    away = F.hypot(c("start_x") + m * dx - c("coast_x"), c("start_y") + m * dy - c("coast_y"))
    near = F.min(F.struct(F.round(away, 6).alias("d"), poly, "t0", "t1")).alias("b")
    best = t.join(pieces, key).groupBy(key).agg(near).select(key, f"b.{poly}", "b.t0", "b.t1")
    ends = {f"{e}_{x}": c(f"start_{x}") + c(at) * d for e, at in (("start", "t0"), ("end", "t1")) for x, d in (("x", dx), ("y", dy))}
    number = F.row_number().over(Window.partitionBy("line_id").orderBy("transect_id")) - 1
    return extend(t.join(best, key).withColumns(ends), more, more).withColumn("number", number)
