"""Column expressions of coastal geometry and physics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAVITY = 9.81


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` between two limits; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing of a direction, clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def ahead(x: Column, y: Column, bearing_deg: Column, d: Column) -> tuple[Column, Column]:
    """The point ``d`` metres from (x, y) along a bearing."""
    a = F.radians(bearing_deg)
    return x + d * F.sin(a), y + d * F.cos(a)


def along(px: Column, py: Column, x: Column, y: Column, bearing_deg: Column) -> Column:
    """Signed distance of a point along a bearing from (x, y): negative is seaward."""
    a = F.radians(bearing_deg)
    return (px - x) * F.sin(a) + (py - y) * F.cos(a)


def error_by_age(date: Column) -> Column:
    """Position error in metres by the age of its source."""
    return F.when(F.year(date) < 1900, F.lit(5.0)).when(F.year(date) < 1970, F.lit(5.0)).when(F.year(date) < 2000, F.lit(2.0)).otherwise(F.lit(1.0))


def wave_length(tp: Column) -> Column:
    """Deep-water wave length."""
    return GRAVITY * tp * tp / (2 * F.pi())


def runup(hs: Column, tp: Column, slope: Column, shingle: Column, pure_gravel: bool) -> tuple[Column, Column, Column]:
    """(run-up, setup, dissipative) by beach type.

    Steep shingle has its own formulae (another one in pure-gravel subcells);
    of the rest, beaches with an Iribarren number under 0.3 are dissipative.
    """
    length = wave_length(tp)
    root = F.sqrt(hs * length)
    general = 1.1 * (0.35 * slope * root + F.sqrt(hs * length * (0.563 * slope * slope + 0.004)) / 2)
    steep = shingle & (slope > 0.095)
    flat = slope / F.sqrt(hs / length) < 0.3
    gravel = 0.33 * F.sqrt(slope) * hs * tp if pure_gravel else general
    up = F.when(steep, gravel).when(flat, 0.043 * root).otherwise(general)
    setup = F.when(steep, 0.3 * hs).when(flat, 0.016 * root).otherwise(0.35 * slope * root)
    return up, setup, ~steep & flat
