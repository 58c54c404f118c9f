"""Spatial joins by grid buckets.

Both sides are keyed by the cells of a square grid that their boxes touch, the
join is an equi-join on the cell, the exact predicate follows, and a pair that
meets in several cells counts once.  Segments are cut at cell size, so a long
segment meets only cells along its own box.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.functions.stage import cut, few


def _cells(x0: Column, x1: Column, y0: Column, y1: Column, g: float, pad: float = 0.0) -> Column:
    """Grid cells that a box touches, as structs."""
    lo = lambda v: F.floor((v - pad) / g)
    hi = lambda v: F.floor((v + pad) / g)
    return F.flatten(F.transform(F.sequence(lo(F.least(x0, x1)), hi(F.greatest(x0, x1))), lambda i: F.transform(F.sequence(lo(F.least(y0, y1)), hi(F.greatest(y0, y1))), lambda j: F.struct(i.alias("gx"), j.alias("gy")))))


def bucketed(df: DataFrame, x0: str, y0: str, x1: str, y1: str, g: float, pad: float = 0.0) -> DataFrame:
    """``df`` once for each grid cell its box touches, with gx and gy."""
    return df.withColumn("_c", F.explode(_cells(F.col(x0), F.col(x1), F.col(y0), F.col(y1), g, pad))).select(*df.columns, "_c.gx", "_c.gy")


def intersections(a: DataFrame, b: DataFrame, g: float, on: list[str] | None = None) -> DataFrame:
    """Crossing points of segments ``a`` (ax1, ay1, ax2, ay2) and ``b`` (bx1 …).

    Returns all columns of both with t and u in [0, 1] along each and the point
    (ix, iy).  With ``on``, only pairs equal in those columns meet.  A pair counts in the cell of its crossing point alone.
    """
    met = bucketed(a, "ax1", "ay1", "ax2", "ay2", g).join(bucketed(b, "bx1", "by1", "bx2", "by2", g), [*(on or []), "gx", "gy"])
    c = F.col
    dax, day, dbx, dby = c("ax2") - c("ax1"), c("ay2") - c("ay1"), c("bx2") - c("bx1"), c("by2") - c("by1")
    det = dax * dby - day * dbx
    rx, ry = c("bx1") - c("ax1"), c("by1") - c("ay1")
    # Parallel pairs have no determinant and fall out with the nulls.
    met = met.withColumn("_det", F.nullif(det, F.lit(0.0))).withColumns({"t": (rx * dby - ry * dbx) / c("_det"), "u": (rx * day - ry * dax) / c("_det")})
    hit = met.filter("t between 0 and 1 and u between 0 and 1").withColumns({"ix": c("ax1") + c("t") * dax, "iy": c("ay1") + c("t") * day})
    # The crossing point lies in one cell; rounding may put it next to both boxes, so duplicates go by pair, not by cell.
    return hit.drop("_det", "gx", "gy").distinct()


def point_to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """(distance, x, y) of the nearest point of a segment."""
    dx, dy = x2 - x1, y2 - y1
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / size))).otherwise(0.0)
    nx, ny = x1 + t * dx, y1 + t * dy
    return F.hypot(px - nx, py - ny), nx, ny


def nearest_segment(p: DataFrame, key: str, seg: DataFrame, g: float, most: float, ids: list[str] | None = None) -> DataFrame:
    """The nearest point of segments (x1, y1, x2, y2) for each point (x, y), at most ``most`` away.

    Points search by the grid cell of width ``g`` they lie in.  The radius grows
    fourfold until every cell's centre has a segment nearer than it, or exceeds
    ``most``; answered cells leave the search.  With the centre's distance known,
    the nearest segment of any point of the cell lies within that and the cell's
    diagonal of the centre, so points meet those few segments alone, however
    many others there are.  Points without an answer are left out, ties go to
    the smaller point; with ``ids``, columns of the segments that are returned
    too, distances tie to the sixth digit and ties go to the smaller ids.
    """
    c, reach, ids = F.col, g * 2**0.5 / 2, ids or []
    at = p.select(key, "x", "y", F.floor(c("x") / g).alias("cx"), F.floor(c("y") / g).alias("cy"))
    centres = at.select("cx", "cy").distinct().select("cx", "cy", ((c("cx") + 0.5) * g).alias("x"), ((c("cy") + 0.5) * g).alias("y"))
    ends = ["x1", "y1", "x2", "y2"]
    seg = cut(seg.select(*ids, *ends).distinct())
    open_, near, radius = cut(centres.filter("x is not null and y is not null")), None, g
    d, _, _ = point_to_segment(c("x"), c("y"), *map(c, ends))

    def met(box: DataFrame, radius: float, pad: Column) -> DataFrame:
        """Centres with the segments in grid cells that the box of ``pad`` around them touches, and their distance."""
        cells = box.withColumn("_c", F.explode(_cells(c("x") - pad, c("x") + pad, c("y") - pad, c("y") + pad, radius))).select(*box.columns, "_c.gx", "_c.gy")
        return spread(bucketed(seg, *ends, radius), cells, ["gx", "gy"]).withColumn("d", d)

    while True:
        best = cut(met(open_, radius, F.lit(radius)).filter(c("d") <= radius).groupBy("cx", "cy", "x", "y").agg(F.min("d").alias("far")))
        # Rounding must not lose a segment as near as the nearest.
        bound = c("far") + 2 * reach * (1 + 1e-9) + 1e-9 * radius + (2e-6 if ids else 0.0)
        found = met(best, radius, bound).filter(c("d") <= bound).select("cx", "cy", *ids, *ends).distinct()
        near = found if near is None else near.union(found)
        open_ = cut(open_.join(best.select("cx", "cy"), ["cx", "cy"], "left_anti"))
        if radius >= most + reach or open_.limit(1).count() == 0:
            break
        radius = min(radius * 4, most + reach)
    d, nx, ny = point_to_segment(c("x"), c("y"), *map(c, ends))
    order = [F.round(d, 6).alias("_d"), *ids] if ids else []
    pairs = spread(at, near, ["cx", "cy"]).select(key, F.struct(*order, d.alias("distance"), nx.alias("near_x"), ny.alias("near_y")).alias("b"))
    return pairs.filter(c("b.distance") <= most).groupBy(key).agg(F.min("b").alias("b")).select(key, "b.*").drop("_d")


def spread(rows: DataFrame, cells: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` joined with ``cells`` on grid cells, ``cells`` broadcast only if it is counted and few.

    Spark's estimate of a side takes no account of the cells that its rows were
    exploded to, and would broadcast millions of them by way of the driver.
    """
    kept = cut(cells)
    side = few(kept)
    return rows.join(kept.hint("merge") if side is kept else side, on)


def points_within(p: DataFrame, q: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (x, y) and (qx, qy) at most ``radius`` apart, with their distance.

    The sides are merged: points of ``q`` stand in nine cells each, which Spark's estimate of their size leaves out.
    """
    a = p.withColumns({"gx": F.floor(F.col("x") / radius), "gy": F.floor(F.col("y") / radius)})
    b = bucketed(q, "qx", "qy", "qx", "qy", radius, radius)
    d = F.hypot(F.col("x") - F.col("qx"), F.col("y") - F.col("qy"))
    return a.join(b.hint("merge"), ["gx", "gy"]).withColumn("distance", d).filter(F.col("distance") <= radius).drop("gx", "gy")


def k_nearest_within(p: DataFrame, key: str, q: DataFrame, q_key: str, k: int, radius: float, same: bool = False) -> DataFrame:
    """(key, q_key, distance, rank) of the ``k`` nearest of ``q`` within ``radius`` of each of ``p``; ties go to the smaller key.

    The searched radius doubles up to ``radius`` from one that holds about
    ``k`` points where they are densest; a point with ``k`` partners leaves the
    search, so pairs grow with the points, not with their density.  Points in
    one place are equally far from any other, so those after its ``k`` + 1
    smallest keys are never among the ``k`` nearest.  ``same`` says that both
    are one set, so a point isn't its own neighbour.
    """
    q = _first_of_places(q, q_key, k)
    return _search(p, key, q, q_key, k, radius, _halvings(_densest(q, radius), k), same)


def k_nearest(p: DataFrame, key: str, q: DataFrame, q_key: str, k: int, same: bool = False) -> DataFrame:
    """As ``k_nearest_within``, however far they are: a point has fewer than ``k`` partners only if there are no more.

    The last radius is the diagonal of the box of both sides.  The first is
    made smaller until no cell of it holds much more than ``k`` points.
    """
    c = F.col
    q = _first_of_places(q, q_key, k)
    box = p.select("x", "y").unionByName(q.select(c("qx").alias("x"), c("qy").alias("y")))
    w, h = box.filter(~F.isnan("x") & ~F.isnan("y")).agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
    radius, halvings = math.hypot(w or 0.0, h or 0.0) * (1 + 1e-9) or 1.0, 0
    # Forty halvings part points that are a thousand-billionth of the box apart.
    while halvings < 40 and (more := _halvings(_densest(q, radius / 2**halvings), 4 * k)):
        halvings += more
    return _search(p, key, q, q_key, k, radius, halvings, same)


def _first_of_places(q: DataFrame, q_key: str, k: int) -> DataFrame:
    """The ``k`` + 1 smallest keys of each place: one may be the point itself."""
    place = Window.partitionBy("qx", "qy").orderBy(q_key)
    return cut(q.select(q_key, "qx", "qy").withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k + 1).drop("_r"))


def _densest(q: DataFrame, radius: float) -> int:
    """The points of the fullest grid cell of width ``radius``."""
    return q.groupBy(F.floor(F.col("qx") / radius), F.floor(F.col("qy") / radius)).count().agg(F.max("count")).first()[0] or 0


def _halvings(most: int, k: int) -> int:
    """How often to halve a cell of ``most`` points that lie evenly until it holds ``k``."""
    return max(0, math.ceil(math.log2(max(most / k, 1.0)) / 2))


def _search(p: DataFrame, key: str, q: DataFrame, q_key: str, k: int, radius: float, halvings: int, same: bool) -> DataFrame:
    """The ``k`` nearest within ``radius``, searched from ``halvings`` halves of it on; a point with ``k`` partners leaves."""
    c = F.col
    open_, found = p.select(key, "x", "y"), None
    by = Window.partitionBy(key).orderBy("distance", q_key)
    for i in range(halvings, -1, -1):
        pairs = points_within(open_, q, radius / 2**i)
        pairs = pairs.filter(c(key) != c(q_key)) if same else pairs
        best = pairs.select(key, q_key, "distance").withColumn("rank", F.row_number().over(by)).filter(c("rank") <= k)
        if i > 0:
            best = cut(best)
            done = best.filter(c("rank") == k).select(key)
            best, open_ = best.join(done, key, "left_semi"), cut(open_.join(done, key, "left_anti"))
        found = best if found is None else found.unionByName(best)
    return found


def nearest_within(p: DataFrame, key: str, q: DataFrame, q_key: str, radius: float, same: bool = False) -> DataFrame:
    """The nearest of ``q`` within ``radius`` of each of ``p``; ties go to the smaller key.

    ``same`` says that both are one set of points, so a point isn't its own neighbour.
    """
    return k_nearest_within(p, key, q, q_key, 1, radius, same).select(key, q_key, "distance")


def _odd(at: DataFrame, key: str, edges: DataFrame, poly: str, g: float) -> DataFrame:
    """(key, polygon) of pairs (key, polygon, x, y, gy) whose point has an odd number of the polygon's edges to the right.

    An edge counts if the point's y lies in its half-open range, so points on
    shared edges belong to one side.
    """
    c = F.col
    rows = edges.filter(c("y1") != c("y2")).withColumn("gy", F.explode(F.sequence(F.floor(F.least("y1", "y2") / g), F.floor(F.greatest("y1", "y2") / g))))
    spans = (c("y1") <= c("y")) != (c("y2") <= c("y"))
    right = c("x") < c("x1") + (c("y") - c("y1")) * (c("x2") - c("x1")) / (c("y2") - c("y1"))
    return at.join(rows, [poly, "gy"]).filter(spans & right).groupBy(key, poly).agg(F.count("*").alias("n")).filter("n % 2 = 1").select(key, poly)


def inside_cells(edges: DataFrame, poly: str, g: float) -> tuple[DataFrame, DataFrame]:
    """(polygon, gx, gy) of the grid cells that polygons hold whole, and of those that their edges may touch.

    Between two touched cells of a row all cells are alike, so one centre tells
    for the whole gap.  There are as many cells as the polygons' area holds.
    """
    c = F.col
    touched = cut(bucketed(edges.select(poly, "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2", g).select(poly, "gx", "gy").distinct())
    gaps = touched.withColumn("to", F.lead("gx").over(Window.partitionBy(poly, "gy").orderBy("gx"))).filter(c("to") > c("gx") + 1)
    gaps = gaps.select(poly, "gy", (c("gx") + 1).alias("gx"), (c("to") - 1).alias("to"))
    centres = gaps.select(poly, "gx", "gy", ((c("gx") + 0.5) * g).alias("x"), ((c("gy") + 0.5) * g).alias("y"), F.struct("gx", "gy").alias("gap"))
    held = _odd(centres, "gap", edges, poly, g).select(poly, c("gap.gx").alias("gx"), c("gap.gy").alias("gy"))
    whole = gaps.join(held, [poly, "gx", "gy"]).select(poly, F.explode(F.sequence("gx", "to")).alias("gx"), "gy")
    return whole, touched


def in_polygon(p: DataFrame, key: str, edges: DataFrame, poly: str, g: float) -> DataFrame:
    """(key, polygon) of points inside polygons, given by ``edges`` (poly, x1, y1, x2, y2).

    A point in a cell that a polygon holds whole is inside without a look at
    any edge; one in a cell that its edges touch meets the edges of that polygon
    in its row of the grid; all others are outside.
    """
    at = p.select(key, "x", "y").withColumns({"gx": F.floor(F.col("x") / g), "gy": F.floor(F.col("y") / g)})
    whole, touched = inside_cells(edges, poly, g)
    inner = at.join(whole, ["gx", "gy"]).select(key, poly)
    border = _odd(at.join(touched, ["gx", "gy"]).select(key, poly, "x", "y", "gy"), key, edges, poly, g)
    return inner.distinct().unionByName(border)


def box_distance(x: Column, y: Column) -> Column:
    """Distance from a point to the box xmin … ymax, 0 inside."""
    c = F.col
    dx = F.greatest(c("xmin") - x, F.lit(0.0), x - c("xmax"))
    dy = F.greatest(c("ymin") - y, F.lit(0.0), y - c("ymax"))
    return F.hypot(dx, dy)


def assign_boxes(p: DataFrame, key: str, boxes: DataFrame, cell: str, g: float, most: float) -> DataFrame:
    """The nearest boxes of each point, all of equal distance, within ``most``."""
    b = bucketed(boxes, "xmin", "ymin", "xmax", "ymax", g, most)
    a = p.withColumns({"gx": F.floor(F.col("x") / g), "gy": F.floor(F.col("y") / g)})
    met = a.join(b, ["gx", "gy"]).withColumn("distance", box_distance(F.col("x"), F.col("y"))).filter(F.col("distance") <= most)
    rank = F.rank().over(Window.partitionBy(key).orderBy("distance"))
    return met.withColumn("_r", rank).filter("_r = 1").select(key, cell, "distance")


def clip_segments(seg: DataFrame, key: str, edges: DataFrame, poly: str, g: float) -> DataFrame:
    """Pieces (key, polygon, t0, t1) of segments (ax1, ay1, ax2, ay2) inside polygons.

    A segment is cut where it crosses a polygon's edges; a piece is inside if
    its middle is.  ``t`` runs from 0 to 1 along the segment.
    """
    c = F.col
    ring = edges.select(poly, c("x1").alias("bx1"), c("y1").alias("by1"), c("x2").alias("bx2"), c("y2").alias("by2"))
    own = seg.select(key, "ax1", "ay1", "ax2", "ay2")
    cuts = intersections(own, ring, g).select(key, poly, F.round("t", 12).alias("t"))
    # Polygons that hold an end without crossing count too, so every met polygon gets both ends.
    ends = own.select(F.col(key), c("ax1").alias("x"), c("ay1").alias("y"))
    met = cuts.select(key, poly).union(in_polygon(ends, key, edges, poly, g)).distinct()
    marks = cuts.union(met.select(key, poly, F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("t"))).distinct()
    by = Window.partitionBy(key, poly).orderBy("t")
    pieces = marks.withColumn("t1", F.lead("t").over(by)).filter("t1 > t").join(own, key)
    m = (c("t") + c("t1")) / 2
    pieces = pieces.withColumns({"pid": F.concat_ws("|", key, poly, "t"), "x": c("ax1") + m * (c("ax2") - c("ax1")), "y": c("ay1") + m * (c("ay2") - c("ay1"))})
    inside = in_polygon(pieces, "pid", edges.withColumnRenamed(poly, "_in"), "_in", g)
    return pieces.join(inside, "pid").filter(c("_in") == c(poly)).select(key, poly, c("t").alias("t0"), "t1")
