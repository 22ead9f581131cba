"""Humidity and distance formulas as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dew_point(t: Column, rh: Column) -> Column:
    """Magnus, A = 17.62 and B = 243.12; null without a positive humidity or where the formula has no value."""
    g = F.ln(rh / 100.0) + 17.62 * t / F.nullif(t + 243.12, F.lit(0.0))
    return F.when(rh > 0, 243.12 * g / F.nullif(17.62 - g, F.lit(0.0)))


def wet_bulb(t: Column, rh: Column) -> Column:
    """Stull's fit, for humidity from 0."""
    return F.when(rh >= 0, t * F.atan(0.151977 * F.sqrt(rh + 8.313659)) + F.atan(t + rh) - F.atan(rh - 1.676331) + 0.00391838 * F.pow(rh, 1.5) * F.atan(0.023101 * rh) - 4.686035)


def humidity_from_dew_point(t: Column, td: Column) -> Column:
    """Relative humidity in percent, A = 17.625 and B = 243.04, held in 0 to 100."""
    def over(x: Column) -> Column:
        return 17.625 * x / (x + 243.04)

    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * F.exp(over(td) - over(t))))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
