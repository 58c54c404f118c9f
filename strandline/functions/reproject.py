"""British National Grid to longitude and latitude, as column expressions."""

from __future__ import annotations

from math import radians

from pyspark.sql import Column
from pyspark.sql import functions as F

# Airy 1830 ellipsoid and the National Grid's projection.
A, B, F0 = 6377563.396, 6356256.909, 0.9996012717
LAT0, LON0, E0, N0 = radians(49), radians(-2), 400000.0, -100000.0
E2 = 1 - (B * B) / (A * A)
# The WGS84 ellipsoid, and the published shift to it in metres, parts per million and seconds of arc.
WGS_A, WGS_B = 6378137.0, 6356752.314245
WGS_E2 = 1 - (WGS_B * WGS_B) / (WGS_A * WGS_A)
SHIFT, SCALE, TURN = (446.448, -125.157, 542.060), -20.4894e-6, tuple(radians(s / 3600) for s in (0.1502, 0.2470, 0.8421))
N = (A - B) / (A + B)


def _meridian(lat: Column) -> Column:
    d, s = lat - LAT0, lat + LAT0
    return B * F0 * (
        (1 + N + 1.25 * N**2 + 1.25 * N**3) * d
        - (3 * N + 3 * N**2 + 2.625 * N**3) * F.sin(d) * F.cos(s)
        + (1.875 * N**2 + 1.875 * N**3) * F.sin(2 * d) * F.cos(2 * s)
        - (35 / 24) * N**3 * F.sin(3 * d) * F.cos(3 * s)
    )


def to_lonlat(x: Column, y: Column, rounds: int = 4) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees on the grid's own datum; ``to_wgs84`` shifts them."""
    from strandline.functions.expr import let

    def refine(lat: Column, left: int) -> Column:
        better = lat + (y - N0 - _meridian(lat)) / (A * F0)
        return better if left == 0 else let(better, lambda v: refine(v, left - 1))

    def both(lat: Column) -> Column:
        s2 = F.sin(lat) ** 2
        nu = A * F0 / F.sqrt(1 - E2 * s2)
        rho = A * F0 * (1 - E2) / (1 - E2 * s2) ** 1.5
        t, de = F.tan(lat), x - E0
        eta = nu / rho - 1
        sec = 1 / F.cos(lat)
        phi = lat - t / (2 * rho * nu) * de**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta - 9 * t**2 * eta) * de**4 - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * de**6
        lam = LON0 + sec / nu * de - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * de**3 + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * de**5
        return F.struct(F.degrees(lam).alias("lon"), F.degrees(phi).alias("lat"))

    out = let(refine(LAT0 + (y - N0) / (A * F0), rounds), both)
    return out["lon"], out["lat"]


def to_wgs84(x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees on WGS84, within about 5 m.

    Grid to geographic on the grid's datum, to geocentric coordinates at height
    zero, the shift in seven parameters, and back with latitude refined in ``rounds``.
    """
    from strandline.functions.expr import let

    def geocentric(p: Column) -> Column:
        lam, phi = F.radians(p["lon"]), F.radians(p["lat"])
        nu = A / F.sqrt(1 - E2 * F.sin(phi) ** 2)
        return F.named_struct(F.lit("x"), nu * F.cos(phi) * F.cos(lam), F.lit("y"), nu * F.cos(phi) * F.sin(lam), F.lit("z"), nu * (1 - E2) * F.sin(phi))

    def shifted(g: Column) -> Column:
        rx, ry, rz = TURN
        s = 1 + SCALE
        return F.named_struct(F.lit("x"), SHIFT[0] + s * g["x"] - rz * g["y"] + ry * g["z"], F.lit("y"), SHIFT[1] + rz * g["x"] + s * g["y"] - rx * g["z"], F.lit("z"), SHIFT[2] - ry * g["x"] + rx * g["y"] + s * g["z"])

    def geographic(g: Column) -> Column:
        across = F.hypot(g["x"], g["y"])

        def refine(phi: Column, left: int) -> Column:
            better = F.atan2(g["z"] + WGS_E2 * WGS_A / F.sqrt(1 - WGS_E2 * F.sin(phi) ** 2) * F.sin(phi), across)
            return better if left == 0 else let(better, lambda v: refine(v, left - 1))

        lat = let(F.atan2(g["z"], across * (1 - WGS_E2)), lambda v: refine(v, rounds - 1))
        return F.named_struct(F.lit("lon"), F.degrees(F.atan2(g["y"], g["x"])), F.lit("lat"), F.degrees(lat))

    lon, lat = to_lonlat(x, y)
    start = F.named_struct(F.lit("lon"), lon, F.lit("lat"), lat)
    out = let(let(let(start, geocentric), shifted), geographic)
    return out["lon"], out["lat"]
