"""Student-t tail and quantile as Column expressions, one formula for every df.

With y = sqrt(df ln(1 + s^2 / df)) the upper tail of the density becomes the
integral of exp(-y^2 (df - 1) / (2 df)) y / s over y, whose integrand falls at
least as fast as a normal density whatever df is.  A fixed Gauss-Legendre rule
over the range in which it falls by 42 nats gives the tail to about ten
digits; dividing by the integral from zero makes it a probability.
"""

from __future__ import annotations

from numpy.polynomial.legendre import leggauss
from pyspark.sql import Column, functions as F

from .rules import col

Z_975 = 1.959963984540054
NODES, NEWTON_STEPS = 64, 12


def _rule() -> str:
    """The quadrature rule on (0, 1) as a literal array of (x, w)."""
    x, w = leggauss(NODES)
    return "array(" + ", ".join(f"named_struct('x', {(a + 1) / 2!r}D, 'w', {b / 2!r}D)" for a, b in zip(x.tolist(), w.tolist())) + ")"


def t_two_sided_p(t, df) -> Column:
    """P(|T| > |t|); also the upper tail of F(1, df) at t squared."""
    both = F.array(F.struct(F.abs(col(t)).cast("double").alias("t"), col(df).cast("double").alias("v")))

    return F.transform(both, _ratio)[0]


def _ratio(r: Column) -> Column:
    y = F.sqrt(r["v"] * F.log1p(r["t"] * r["t"] / r["v"]))
    return F.when((r["v"] >= 1) & r["t"].isNotNull(), F.least(F.lit(1.0), _integral(y, r["v"]) / _integral(F.lit(0.0), r["v"])))


def _integral(y: Column, v: Column) -> Column:
    width = F.sqrt(y * y + 84) - y

    def term(a: Column, q: Column) -> Column:
        at = y + q["x"] * width
        return a + q["w"] * F.exp(-at * at * (v - 1) / (2 * v)) * at / F.sqrt(v * F.expm1(at * at / v))

    return width * F.aggregate(F.expr(_rule()), F.lit(0.0), term)


def t_quantile_975(df) -> Column:
    """t with P(|T| > t) = 0.05: Newton steps on the logarithms of both, which
    are nearly a straight line for small and a parabola for large df."""
    def solve(v: Column) -> Column:
        whole = _integral(F.lit(0.0), v)

        def step(x: Column, _: Column) -> Column:
            t = F.exp(x)
            tail = _integral(F.sqrt(v * F.log1p(t * t / v)), v)
            density = F.exp(-(v + 1) / 2 * F.log1p(t * t / v))
            return x + (F.ln(tail / whole) - F.ln(F.lit(0.05))) * tail / (t * density)

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.ln(F.lit(2.0)), step))

    return F.when(col(df) >= 1, F.transform(F.array(col(df).cast("double")), solve)[0])


def wilson_bounds(successes, n) -> tuple[Column, Column]:
    """95 % score interval of a proportion, non-zero width at 0/n and n/n."""
    s, n = col(successes).cast("double"), col(n).cast("double")
    p, z2 = s / n, F.lit(Z_975**2)
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z_975) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
