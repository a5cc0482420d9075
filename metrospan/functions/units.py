"""Unit conversion to SI."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import col, is_finite

# Accepted units and their factor to SI.
SI_FACTORS = {
    "um": 1e-6, "nm": 1e-9, "min": 60.0, "h": 3600.0,
    "mPa_s": 1e-3, "Pa_s": 1.0, "m": 1.0, "s": 1.0,
}
ABSOLUTE_ZERO_C = -273.15


def to_si(value, unit) -> Column:
    """SI value; NULL for an unknown unit, a non-finite value or below 0 K."""
    value, unit = col(value).cast("double"), col(unit)
    pairs = [F.lit(x) for item in SI_FACTORS.items() for x in item]
    factor = F.try_element_at(F.create_map(*pairs), unit)
    kelvin = F.when(value > ABSOLUTE_ZERO_C, value - ABSOLUTE_ZERO_C)
    return F.when(is_finite(value), F.when(unit == "C", kelvin).otherwise(value * factor))


def to_si_status(value, unit) -> Column:
    value, unit = col(value).cast("double"), col(unit)
    return (
        F.when(~is_finite(value), "nonfinite")
        .when(unit == "C", F.when(value <= ABSOLUTE_ZERO_C, "below_absolute_zero").otherwise("ok"))
        .when(unit.isin(*SI_FACTORS), "ok")
        .otherwise("unknown_unit")
    )
