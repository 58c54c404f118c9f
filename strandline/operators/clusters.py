"""Clusters of transects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.stage import cut


def two_means(rows: DataFrame, x: str, y: str) -> tuple[tuple[float, float], tuple[float, float]] | None:
    """The centres of two clusters of points, the lower first; none for no points.

    They start in the corners of all points' bounding box and move to the mean
    of the points that are nearer to them (of equal distances, the lower) until
    no centre moves.  A round is one aggregate; the driver holds two points.
    """
    box = rows.agg(*(f(c) for f in (F.min, F.max) for c in (x, y))).first()
    if box[0] is None:
        return None
    low, high = (float(box[0]), float(box[1])), (float(box[2]), float(box[3]))
    while True:
        near = nearer(x, y, low, high)
        means = rows.agg(*(F.avg(F.when(side, F.col(c))) for side in (near, ~near) for c in (x, y))).first()
        found = tuple(tuple(old if m is None else m for m, old in zip(means[i : i + 2], was, strict=True)) for i, was in ((0, low), (2, high)))
        if all(abs(a - b) <= 1e-12 for new, was in zip(found, (low, high), strict=True) for a, b in zip(new, was, strict=True)):
            return low, high
        low, high = found


def nearer(x: str, y: str, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """Whether a point is as near to ``low`` as to ``high``, or nearer."""
    far = lambda c: (F.col(x) - c[0]) ** 2 + (F.col(y) - c[1]) ** 2
    return far(low) <= far(high)


def rocky(rough: DataFrame, keys: list[str]) -> DataFrame:
    """Two clusters on (slope, height) roughness; the rougher one is rocky.

    The same rows have the same clusters however they are partitioned.  Rows
    with a missing measure have no cluster and stay.  The measures are stored
    once, so a round reads a few numbers of each transect, not its profile.
    """
    rough = cut(rough.select(*keys, "slope_rough", "z_rough"))
    return rough.select(*keys, rougher(rough).alias("rocky"))


def rougher(rough: DataFrame) -> Column:
    """Whether a row with (slope_rough, z_rough) is of the rougher cluster of ``rough``; null without a measure.

    Every round reads ``rough``, which should be stored.
    """
    centres = two_means(rough.filter("slope_rough is not null and z_rough is not null"), "slope_rough", "z_rough")
    return F.lit(None).cast("boolean") if centres is None else ~nearer("slope_rough", "z_rough", *centres)
