"""Points and boxes on the unit sphere, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_vector(latitude: Column, longitude: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(latitude), F.radians(longitude)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Angle between two places in radians."""
    half_phi = F.sin((F.radians(lat1) - F.radians(lat2)) / 2)
    half_lam = F.sin((F.radians(lon1) - F.radians(lon2)) / 2)
    h = half_phi * half_phi + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lam * half_lam
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


AXES = ("x", "y", "z")


def box_gap2(a: str, b: str) -> Column:
    """Squared smallest distance between boxes with columns like ``a_lo_x``."""
    gaps = [
        F.greatest(F.col(f"{a}_lo_{k}") - F.col(f"{b}_hi_{k}"), F.col(f"{b}_lo_{k}") - F.col(f"{a}_hi_{k}"), F.lit(0.0))
        for k in AXES
    ]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def box_span2(a: str, b: str) -> Column:
    """Squared largest distance between two boxes."""
    spans = [
        F.greatest(F.col(f"{a}_hi_{k}") - F.col(f"{b}_lo_{k}"), F.col(f"{b}_hi_{k}") - F.col(f"{a}_lo_{k}"))
        for k in AXES
    ]
    return spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2]
