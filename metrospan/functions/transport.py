"""Closed-form concentration profile of a reacting channel, as Spark SQL text.

With phi = sqrt(Da), depth fraction x and end coefficient Bi the profile is
    u(x) = exp(-phi x) * G(2 phi (1 - x)) / G(2 phi)
    G(z) = 2 phi + (Bi - phi) * (1 - exp(-z))
G is a sum of non-negative terms for every phi and Bi, so no cancellation
occurs, and logs of u stay finite in deep channels.

The functions take and return SQL expressions as text (a column name is one);
wrap the result in ``F.expr``.  Text composes without a round trip to the JVM
per operator, which matters for curves that appear inside other expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

GAS_CONSTANT = 8.31446261815324
KELVIN = 273.15
FLAT_PHI = 1e-10  # below this the profile is linear

Sql = str | float | int


def sql(v: Sql) -> str:
    """Numbers as exact double literals, text in parentheses."""
    if isinstance(v, (int, float)):
        return f"{float(v)!r}D"
    return v if v.isidentifier() else f"({v})"


def log_mean(lo: Sql, hi: Sql, phi: Sql, biot: Sql) -> str:
    """log of the mean profile over depth fractions [lo, hi]; a point if equal."""
    point = lo == hi
    a, b, p, bi = sql(lo), sql(hi), sql(phi), sql(biot)

    def gain(z: str) -> str:
        return f"(2 * {p} + ({bi} - {p}) * -expm1(-({z})))"

    width = "0" if point else f"{p} * ({b} - {a})"
    averaged = "0" if point else f"CASE WHEN {b} > {a} THEN ln(-expm1(-{width}) / ({width})) ELSE 0D END"
    deep = f"-{p} * {a} + {averaged} + ln({gain(f'2 * {p} * (1 - {b}) + {width}')} / {gain(f'2 * {p}')})"
    flat = f"ln((1 + {bi} * (1 - ({a} + {b}) / 2)) / (1 + {bi}))"
    return f"(CASE WHEN {p} < {FLAT_PHI!r}D THEN {flat} ELSE {deep} END)"


def log_profile(x: Sql, da: Sql, biot: Sql) -> str:
    return log_mean(x, x, f"sqrt({sql(da)})", biot)


def profile(x: Sql, da: Sql, biot: Sql) -> str:
    return f"exp({log_profile(x, da, biot)})"


def window_log_mean(lo: Sql, hi: Sql, length: Sql, da: Sql, biot: Sql) -> str:
    """Same as :func:`log_mean` with the window in length units."""
    n = sql(length)
    return log_mean(f"{sql(lo)} / {n}", f"{sql(hi)} / {n}", f"sqrt({sql(da)})", biot)


def coverage(phi: Sql, biot: Sql, top: tuple = (0.0, 0.0), bottom: tuple = (1.0, 1.0)) -> str:
    """Bottom over top mean profile; windows are depth fractions."""
    below = log_mean(*bottom, phi, biot)
    if top == (0.0, 0.0):  # u(0) = 1
        return f"exp({below})"
    return f"exp({below} - {log_mean(*top, phi, biot)})"


def da_at_coverage(sc: Sql) -> str:
    """Da that gives an end-point coverage with a closed, non-reacting end."""
    return f"(CASE WHEN {sql(sc)} > 0 AND {sql(sc)} <= 1 THEN pow(acosh(1 / {sql(sc)}), 2) END)"


def stokes_einstein(d_ref: Sql, t_c: Sql, t_ref_c: Sql, eta_ref: Sql, eta: Sql) -> str:
    kelvin = f"(({sql(t_c)} + {KELVIN}D) / ({sql(t_ref_c)} + {KELVIN}D))"
    return f"({sql(d_ref)} * {kelvin} * {sql(eta_ref)} / {sql(eta)})"


def arrhenius(k_ref: Sql, energy: Sql, t_c: Sql, t_ref_c: Sql) -> str:
    inverse = f"(1 / ({sql(t_ref_c)} + {KELVIN}D) - 1 / ({sql(t_c)} + {KELVIN}D))"
    return f"({sql(k_ref)} * exp({sql(energy)} / {GAS_CONSTANT!r}D * {inverse}))"


@dataclass(frozen=True)
class SlitParameters:
    """Reference values of the two-wall slit model (assumptions, not measurements)."""

    width_um: float = 30.0
    diffusivity_ref_m2_s: float = 6e-10
    reference_temperature_c: float = 25.0
    reference_viscosity_mpa_s: float = 0.89
    surface_rate_ref_m_s: float = 2e-8
    activation_energy_j_mol: float = 40000.0
    bottom_surface_rate_ratio: float = 1.0


def slit_coefficients(aspect_ratio: Sql, viscosity_mpa_s: Sql, temperature_c: Sql, p: SlitParameters) -> dict[str, str]:
    width = p.width_um * 1e-6
    depth = f"({sql(aspect_ratio)} * {sql(width)})"
    d = stokes_einstein(p.diffusivity_ref_m2_s, temperature_c, p.reference_temperature_c,
                        p.reference_viscosity_mpa_s, viscosity_mpa_s)
    rate = arrhenius(p.surface_rate_ref_m_s, p.activation_energy_j_mol, temperature_c, p.reference_temperature_c)
    sink = f"(2 * {rate} / {sql(width)})"
    return {
        "depth_m": depth,
        "diffusivity_m2_s": d,
        "surface_rate_m_s": rate,
        "sink_rate_s_inv": sink,
        "da": f"({sink} * {depth} * {depth} / {d})",
        "bottom_biot": f"({sql(p.bottom_surface_rate_ratio)} * {rate} * {depth} / {d})",
    }


def wall_perimeters(w: Sql, h: Sql, faces: Sql, materials, names=("glass", "pdms")) -> dict[str, str]:
    """Reactive perimeter per material: walls left, right, floor, ceiling in
    order, the first ``faces`` of which exist; inert walls do not count.

    A material is a quoted SQL string or a column name.
    """
    walls = [(h, 1), (h, 2), (w, 3), (w, 4)]
    return {
        name: "(" + " + ".join(
            f"CASE WHEN {m} = '{name}' AND {sql(faces)} >= {rank} THEN {sql(length)} ELSE 0D END"
            for (length, rank), m in zip(walls, materials)) + ")"
        for name in names}


def quoted(materials) -> list[str]:
    return [f"'{m}'" for m in materials]


def channel_coefficients(w: Sql, h: Sql, length: Sql, perimeters: dict[str, str], rates: dict[str, Sql], d: Sql, k_end: Sql) -> str:
    """Struct of da, biot, sink and effective rate of a rectangular channel.

    A material with perimeter but without a rate makes every field NULL.
    """
    flux = " + ".join(
        f"CASE WHEN {p} > 0 THEN {sql(rates[name]) if name in rates else 'CAST(NULL AS DOUBLE)'} * {p} ELSE 0D END"
        for name, p in perimeters.items())
    total = " + ".join(perimeters.values())
    base = (f"named_struct('flux', {flux}, 'total', {total}, 'w', {sql(w)}, 'h', {sql(h)}, 'l', {sql(length)}, "
            f"'d', {sql(d)}, 'k', {sql(k_end)})")
    return (f"transform(array({base}), c -> named_struct('da', c.flux / (c.w * c.h) * c.l * c.l / c.d, "
            "'biot', c.k * c.l / c.d + 0 * c.flux, 'sink', c.flux / (c.w * c.h), "
            "'ks_effective', CASE WHEN c.total > 0 THEN c.flux / c.total ELSE 0 * c.flux END))[0]")


def end_crossing(phi1: Sql, bi1: Sql, target: float, limit: float) -> str:
    """:func:`crossing` of the end-point coverage from zero, in closed form.

    ``phi1`` and ``bi1`` are phi and Bi per unit of the variable x.  With their
    ratio r the coverage is 1 / (cosh(phi) + r sinh(phi)), a quadratic in
    exp(phi); written for exp(phi) - 1 it is a sum of positive terms.
    """
    p, b, limit_ = sql(phi1), sql(bi1), sql(limit)
    if target >= 1:
        status, value = ("'root'", "0D") if target == 1 else ("'below_target_at_lower_bound'", "CAST(NULL AS DOUBLE)")
        return f"named_struct('status', {status}, 'value', {value})"
    if target <= 0:
        return "named_struct('status', 'no_boundary_within_domain', 'value', CAST(NULL AS DOUBLE))"
    excess = (1 - target) / target
    square = excess * (excess + 2)
    root = f"log1p(({excess!r}D + {square!r}D / (sqrt({square!r}D + c.r * c.r) + c.r)) / (1 + c.r)) / c.p"
    x = f"CASE WHEN c.p > 0 THEN {root} WHEN c.b > 0 THEN {excess!r}D / c.b WHEN c.p = 0 AND c.b = 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 * c.p * c.b END"
    base = f"named_struct('p', {p}, 'b', {b}, 'r', CASE WHEN {p} > 0 THEN {b} / {p} END)"
    return (f"transform(transform(array({base}), c -> {x}), x -> named_struct('status', "
            f"CASE WHEN x > {limit_} THEN 'no_boundary_within_domain' WHEN x <= {limit_} THEN 'root' END, 'value', CASE WHEN x <= {limit_} THEN x END))[0]")


def crossing(curve: Callable[[str], str], target: Sql, lower: Sql, limit: Sql, steps: int = 60) -> str:
    """Smallest point where a decreasing curve falls to ``target``.

    ``curve`` maps SQL text to SQL text.  The bracket doubles from ``lower`` up
    to ``limit`` and carries the values of both ends, so that nothing is
    computed again once it is closed.  Inside it the secant point, every third
    time the middle, replaces one end; an end that stays twice counts half.
    The search stops when two points in a row agree to the last digits, after
    ``steps`` at most.  Gives struct(status, value); an unattained target keeps
    a status and a NULL value.
    """
    t, lo, end = sql(target), sql(lower), sql(limit)
    start = f"least(greatest(1D, 2 * {lo}), {end})"
    ends = "named_struct('f0', {f0}, 'a', {a}, 'fa', {fa}, 'b', {b}, 'fb', {fb})".format
    twice = f"least(2 * g.b, {end})"
    closed = (f"aggregate(sequence(1, 64), transform(transform(array({start}), u -> named_struct('u', u, 'f', {curve(str(lo))})), r -> "
              f"{ends(f0='r.f', a=f'CAST({lo} AS DOUBLE)', fa='r.f', b='CAST(r.u AS DOUBLE)', fb=curve('r.u'))})[0], (g, i) -> "
              f"CASE WHEN g.b < {end} AND g.fb > {t} THEN {ends(f0='g.f0', a='g.b', fa='g.fb', b=f'CAST({twice} AS DOUBLE)', fb=curve(twice))} ELSE g END)")
    state = "named_struct('a', {a}, 'fa', {fa}, 'b', {b}, 'fb', {fb}, 'x', {x}, 'side', {side}, 'done', {done})".format
    secant, middle = "(g.a + (g.b - g.a) * (g.fa / (g.fa - g.fb)))", "((g.a + g.b) / 2)"
    point = f"CASE WHEN i % 3 > 0 AND {secant} > g.a AND {secant} < g.b THEN {secant} ELSE {middle} END"
    done = f"abs(r.f) <= 1e-16D * abs({t}) OR abs(r.c - r.g.x) <= 4e-16D * abs(r.c)"
    right = state(a="r.c", fa="r.f", b="r.g.b", fb="CASE WHEN r.g.side = 1 THEN r.g.fb / 2 ELSE r.g.fb END", x="r.c", side="1", done=done)
    left = state(a="r.g.a", fa="CASE WHEN r.g.side = -1 THEN r.g.fa / 2 ELSE r.g.fa END", b="r.c", fb="r.f", x="r.c", side="-1", done=done)
    step = (f"transform(transform(array(named_struct('g', g, 'c', {point})), q -> named_struct('g', q.g, 'c', q.c, 'f', {curve('q.c')} - {t})), "
            f"r -> CASE WHEN r.f > 0 THEN {right} ELSE {left} END)[0]")
    first = state(a="s.a", fa=f"s.fa - {t}", b="s.b", fb=f"s.fb - {t}", x="s.b", side="0", done=f"s.fb = {t}")
    root = f"aggregate(sequence(1, {steps}), {first}, (g, i) -> CASE WHEN g.done THEN g ELSE {step} END, g -> g.x)"
    status = (f"CASE WHEN s.f0 < {t} THEN 'below_target_at_lower_bound' WHEN s.f0 = {t} THEN 'root' "
              f"WHEN s.fb > {t} THEN 'no_boundary_within_domain' WHEN s.fb <= {t} AND s.f0 > {t} THEN 'root' END")
    value = f"CASE WHEN s.f0 = {t} THEN CAST({lo} AS DOUBLE) WHEN s.f0 > {t} AND s.fb <= {t} THEN {root} END"
    return f"transform(array({closed}), s -> named_struct('status', {status}, 'value', {value}))[0]"
