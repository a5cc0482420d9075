"""Error propagation and relative-error expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .rules import col, is_finite


def ratio_sd(top, bottom, sd_top, sd_bottom, rho=0.0) -> Column:
    """First-order SD of bottom/top; NULL for an SD or correlation out of range.

    With the two relative parts u and v the variance is u^2 - 2 rho u v + v^2,
    the sum of squares (u - rho v)^2 + (1 - rho^2) v^2: it cannot turn negative.
    """
    rho = F.lit(float(rho)) if isinstance(rho, (int, float)) else col(rho)
    ratio = col(bottom) / col(top)
    u, v = col(sd_bottom) / col(top), ratio * col(sd_top) / col(top)
    spread = F.sqrt(F.pow(u - rho * v, 2) + (1 - rho * rho) * v * v)
    in_range = (F.least(col(sd_top), col(sd_bottom)) >= 0) & rho.between(-1.0, 1.0)
    return F.when(in_range & is_finite(sd_top) & is_finite(sd_bottom) & is_finite(spread), spread)


def signed_percent_error(predicted, actual) -> Column:
    predicted, actual = col(predicted), col(actual)
    return F.when(actual != 0, 100 * (predicted - actual) / actual)


def absolute_percent_error(predicted, actual) -> Column:
    return F.abs(signed_percent_error(predicted, actual))


def transmittance(image, ref, dark) -> Column:
    """(I - D) / (R - D); NULL where the denominator is not positive."""
    image, ref, dark = (col(c).cast("double") for c in (image, ref, dark))
    return F.when(ref - dark > 0, (image - dark) / (ref - dark))


def optical_density(t) -> Column:
    t = col(t)
    return F.when(t > 0, -F.log10(t))


def luminance(red, green, blue, full_scale) -> Column:
    """Weighted channels over the full scale, whatever their range."""
    r, g, b = (col(c).cast("double") / full_scale for c in (red, green, blue))
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def gray(red, green, blue, full_scale) -> Column:
    """Luminance in [0, 1] from integer channels; NULL outside the range."""
    r, g, b = (col(c).cast("double") / full_scale for c in (red, green, blue))
    value = luminance(red, green, blue, full_scale)
    inside = F.least(r, g, b) >= 0
    return F.when(inside & (F.greatest(r, g, b) <= 1), value)
