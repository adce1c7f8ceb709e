"""Lambert azimuthal equal-area projection of Europe (EPSG:3035) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The GRS80 ellipsoid, and the origin and false coordinates of EPSG:3035.
A, INVERSE_FLATTENING = 6378137.0, 298.257222101
LAT0, LON0, EASTING, NORTHING = 52.0, 10.0, 4321000.0, 3210000.0

E2 = 2 / INVERSE_FLATTENING - 1 / INVERSE_FLATTENING**2
_E = math.sqrt(E2)


def _q(s: float) -> float:
    """The authalic function of the sine of a latitude."""
    return (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(_E * s) / _E)


_S0 = math.sin(math.radians(LAT0))
_QP = _q(1.0)
_RQ = A * math.sqrt(_QP / 2)
_B0 = math.asin(_q(_S0) / _QP)
_D = A * math.cos(math.radians(LAT0)) / math.sqrt(1 - E2 * _S0 * _S0) / (_RQ * math.cos(_B0))


def laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of longitude and latitude in degrees; null where either is, or at the antipode."""
    s = F.sin(F.radians(lat))
    q = (1 - E2) * (s / (1 - E2 * s * s) + F.atanh(_E * s) / _E)
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / _QP)))
    turn = F.radians(lon - LON0)
    c = 1 + math.sin(_B0) * F.sin(b) + math.cos(_B0) * F.cos(b) * F.cos(turn)
    r = _RQ * F.sqrt(2.0 / F.when(c > 1e-12, c))
    east = EASTING + r * _D * F.cos(b) * F.sin(turn)
    north = NORTHING + r / _D * (math.cos(_B0) * F.sin(b) - math.sin(_B0) * F.cos(b) * F.cos(turn))
    known = lon.isNotNull() & lat.isNotNull()
    return F.when(known, east), F.when(known, north)
