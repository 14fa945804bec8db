"""Longitude and latitude to UTM as column expressions: the transverse Mercator series of Krueger to the sixth power of the
third flattening, exact to well below a millimetre within a zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ellipsoid WGS 84, the scale on the central meridian and the false coordinates.
AXIS, FLATTENING, SCALE, EAST, SOUTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
N = FLATTENING / (2 - FLATTENING)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: The series' coefficients as published.
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)


def utm(lon: Column, lat: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees on WGS 84, in the given zone. Null where either is null."""
    phi, away = F.radians(lat), F.radians(lon - float(6 * zone - 183))
    e = ECCENTRICITY
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * RADIUS * x, (SOUTH if south else 0.0) + SCALE * RADIUS * y


def utm_sql(lon: str, lat: str, zone: int) -> tuple[str, str]:
    """The same in SQL."""
    f = lambda v: f"{v!r}::DOUBLE"
    phi, away, e = f"radians({lat})", f"radians({lon} - {f(float(6 * zone - 183))})", f(ECCENTRICITY)
    t = f"sinh(atanh(sin({phi})) - {e} * atanh({e} * sin({phi})))"
    xi, eta = f"atan2({t}, cos({away}))", f"atanh(sin({away}) / sqrt(1 + {t} * {t}))"
    x = " + ".join([eta, *[f"{f(a)} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1)]])
    y = " + ".join([xi, *[f"{f(a)} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(ALPHA, 1)]])
    return f"{f(EAST)} + {f(SCALE * RADIUS)} * ({x})", f"{f(SCALE * RADIUS)} * ({y})"
