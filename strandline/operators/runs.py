"""Runs of flagged transects along a line, the lines through them and the patches between lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(rows: DataFrame, keys: list[str], order: str, flag: Column, least: int = 2) -> DataFrame:
    """Rows of runs of at least ``least`` neighbours whose flag is set, with ``run`` numbers."""
    by = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_f", F.coalesce(flag, F.lit(False))).withColumn("_c", F.when(F.col("_f") != F.coalesce(F.lag("_f").over(by), ~F.col("_f")), 1).otherwise(0)).withColumn("run", F.sum("_c").over(by))
    n = F.count("*").over(Window.partitionBy(*keys, "run"))
    return marked.filter("_f").withColumn("_n", n).filter(F.col("_n") >= least).drop("_f", "_c", "_n")


def future_lines(rows: DataFrame, keys: list[str], order: str, erosion_only: bool = True) -> DataFrame:
    """Vertices of future shorelines: each run of transects with its anchors.

    ``rows`` has recent_x/y, future_x/y (null: no prediction), recent and
    distance.  A run begins at the recent position of the transect before it
    (else of its own first) and ends at that of the one after it (else its last).
    """
    by = Window.partitionBy(*keys).orderBy(order)
    near = rows
    for c in ("recent_x", "recent_y"):
        near = near.withColumns({f"_b_{c}": F.lag(c).over(by), f"_a_{c}": F.lead(c).over(by)})
    run = islands(near, keys, order, F.col("future_x").isNotNull())
    place = Window.partitionBy(*keys, "run").orderBy(order)
    run = run.withColumns({"_first": F.row_number().over(place) == 1, "_last": F.lead(order).over(place).isNull()})
    moved = (F.col("distance") > F.col("recent")) | F.lit(not erosion_only)
    own = F.struct(F.lit(1).alias("part"), F.when(moved, F.col("future_x")).otherwise(F.col("recent_x")).alias("x"), F.when(moved, F.col("future_y")).otherwise(F.col("recent_y")).alias("y"))
    begin = F.when(F.col("_first"), F.struct(F.lit(0).alias("part"), F.coalesce("_b_recent_x", "recent_x").alias("x"), F.coalesce("_b_recent_y", "recent_y").alias("y")))
    end = F.when(F.col("_last"), F.struct(F.lit(2).alias("part"), F.coalesce("_a_recent_x", "recent_x").alias("x"), F.coalesce("_a_recent_y", "recent_y").alias("y")))
    # A run at the line's first transect begins at that transect's recent position in place of its prediction.
    middle = F.when(~(F.col("_first") & F.col("_b_recent_x").isNull()), own)
    vertex = F.explode(F.filter(F.array(begin, middle, end), lambda v: v.isNotNull()))
    return run.withColumn("v", vertex).select(*keys, "run", order, "v.part", "v.x", "v.y")


def patch_area(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Signed area of the polygon through vertices (seq, x, y), by the shoelace rule."""
    by = Window.partitionBy(*keys).orderBy("seq")
    first = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = vertices.withColumns({"x2": F.coalesce(F.lead("x").over(by), F.first("x").over(first)), "y2": F.coalesce(F.lead("y").over(by), F.first("y").over(first))})
    return rows.groupBy(*keys).agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2).alias("area"), F.count("*").alias("n"))


def between(front: DataFrame, back: DataFrame, keys: list[str]) -> DataFrame:
    """Vertices of the patches between two lines: one line, then the other reversed."""
    return front.select(*keys, F.col("seq").cast("long").alias("seq"), "x", "y").unionByName(back.select(*keys, (F.lit(2_000_000_000) - F.col("seq")).cast("long").alias("seq"), "x", "y"))


def boundary_lines(rows: DataFrame, keys: list[str], order: str, erosion_only: bool = True) -> DataFrame:
    """Vertices of two lines around a prediction, that meet at both ends of each run.

    ``rows`` has recent, recent_x/y, and low, high with low_x/y and high_x/y
    (null: no prediction).  Both begin at the recent position of the transect
    before the run (else of its first) and end at that of the one after it
    (else of its last), so the band tapers to nothing.
    """
    c = F.col
    by = Window.partitionBy(*keys).orderBy(order)
    near = rows.withColumns({f"_{n}_{x}": f(f"recent_{x}").over(by) for n, f in (("b", F.lag), ("a", F.lead)) for x in "xy"})
    run = islands(near, keys, order, c("low_x").isNotNull() & c("high_x").isNotNull())
    place = Window.partitionBy(*keys, "run").orderBy(order)
    run = run.withColumns({"_first": F.row_number().over(place) == 1, "_last": F.lead(order).over(place).isNull()})

    def at(side: str, x: str) -> Column:
        return F.when((c(side) > c("recent")) | F.lit(not erosion_only), c(f"{side}_{x}")).otherwise(c(f"recent_{x}"))

    def vertex(part: int, *xy: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), *[v.alias(n) for v, n in zip(xy, ("low_x", "low_y", "high_x", "high_y"), strict=True)])

    def anchor(n: str) -> list[Column]:
        return [F.coalesce(f"_{n}_{x}", f"recent_{x}") for x in "xy"] * 2

    own = vertex(1, *[at(side, x) for side in ("low", "high") for x in "xy"])
    parts = F.array(F.when(c("_first"), vertex(0, *anchor("b"))), own, F.when(c("_last"), vertex(2, *anchor("a"))))
    return run.withColumn("v", F.explode(F.filter(parts, lambda v: v.isNotNull()))).select(*keys, "run", order, "v.*")
