"""Predicates and text rules used by the data contracts (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted text for a scale without a unit, the capture-name
# formats and the acquisition domains of the data contract.
DECIMAL_TEXT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TRENCH_NAME = r"(?i)^R(\d{2,})_C(\d+)_T(\d+)_(top|bot)\.tiff?$"
FLAT_NAME = r"(?i)^CAL_([\d.]+)C_G([\d.]+)_(glass|pdms)_([\d.]+)min\.tiff?$"
FRAME_NAME = r"(?i)^(REF|DARK)_(.+)\.tiff?$"
ACQUISITION_FIELDS = (
    "session_id", "exposure_ms", "gain", "illumination_id", "magnification",
    "bit_depth", "auto_exposure", "gamma", "white_balance", "color_channel",
)
BIT_DEPTHS = (8, 12, 16)
COLOR_CHANNELS = ("mono", "red", "green", "blue")
ORIENTATIONS = ("x+", "x-", "y+", "y-")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c) -> Column:
    """The value as a number; NULL for text that is none."""
    return col(c).try_cast("double")


def is_finite(c) -> Column:
    """True only for a number that is present, not NaN and not infinite."""
    v = number(c)
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def is_blank(c) -> Column:
    """Missing, or text made of white space only."""
    c = col(c)
    return c.isNull() | c.cast("string").rlike(r"^\s*$")


def is_integer_valued(c) -> Column:
    v = number(c)
    return is_finite(v) & (v == F.floor(v))


def is_iso_date(c) -> Column:
    return F.try_to_timestamp(col(c).cast("string")).isNotNull()


def is_decimal_text(c) -> Column:
    """Positive finite decimal text without unit suffix, separators or words."""
    text = F.trim(col(c).cast("string"))
    value = text.try_cast("double")
    return F.coalesce(text.rlike(DECIMAL_TEXT) & is_finite(value) & (value > 0), F.lit(False))


def is_false_text(c) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("false", "0")


def is_contained_path(c) -> Column:
    """Relative path that never climbs out of its root."""
    c = col(c)
    return ~c.startswith("/") & ~c.rlike(r"^[A-Za-z]:[\\/]") & ~c.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def within(actual, expected, rtol: float, atol: float = 1e-8) -> Column:
    """|actual - expected| <= atol + rtol * |expected| (the second side scales)."""
    actual, expected = col(actual), col(expected)
    return F.abs(actual - expected) <= F.lit(atol) + F.lit(rtol) * F.abs(expected)


def same_field(a, b) -> Column:
    """Equal as text (ignoring case), or equal as numbers."""
    ta, tb = F.lower(col(a).cast("string")), F.lower(col(b).cast("string"))
    return F.coalesce((ta == tb) | (ta.try_cast("double") == tb.try_cast("double")), F.lit(False))


def general_number(c) -> Column:
    """Six significant digits, no trailing zeros, exponent form outside 1e-4..1e6."""
    v = number(c)

    def layout(parts: Column) -> Column:
        """From (mantissa d.ddddd, power) to the shortest text."""
        m, power = parts["m"], parts["p"]
        digits = F.replace(m, F.lit("."), F.lit(""))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(6)))
        plain = F.when(power >= 0, large).otherwise(small)
        sign = F.when(power < 0, "-").otherwise("+")
        exponent = F.concat(F.lit("e"), sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
        bare = lambda t: F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))
        return F.when((power >= -4) & (power < 6), bare(plain)).otherwise(F.concat(bare(m), exponent))

    sci = F.format_string("%.5e", F.abs(v))
    parts = F.struct(F.substring_index(sci, "e", 1).alias("m"), F.substring_index(sci, "e", -1).try_cast("int").alias("p"))
    text = F.transform(F.array(parts), layout)[0]
    signed = F.when(v == 0, F.lit("0")).when(v < 0, F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(is_finite(v), signed)


def condition_key(temperature, composition, basis) -> Column:
    return F.concat(
        general_number(temperature), F.lit("C_G"), general_number(composition),
        F.lit("_"), col(basis))


def capture_groups(c) -> Column:
    """Groups of a capture name in each of its formats (NULL where it has another).

    One replacement per format isolates all of its groups at once.
    """
    c, sep = col(c), "\x01"

    def groups(pattern: str, n: int) -> Column:
        parts = F.split(F.regexp_replace(c, pattern, sep.join(f"${k + 1}" for k in range(n))), sep)
        return F.when(c.rlike(pattern), parts)

    return F.struct(groups(TRENCH_NAME, 4).alias("_trench"), groups(FLAT_NAME, 4).alias("_flat"), groups(FRAME_NAME, 2).alias("_frame"))


def capture_fields(t: Column, f: Column, r: Column) -> Column:
    """Typed fields from the groups of ``capture_groups``; ``kind`` is NULL when no format matches."""
    digits = t[0].try_cast("long").cast("string")
    run = F.when(F.length(digits) >= 2, digits).otherwise(F.lpad(digits, 2, "0"))
    known = t.isNotNull() | f.isNotNull()
    return F.struct(
        F.when(t.isNotNull(), "trench").when(f.isNotNull(), "flat").otherwise(F.upper(r[0])).alias("kind"),
        F.concat(F.lit("R"), run).alias("run_id"),
        t[1].try_cast("int").alias("chip"),
        t[2].try_cast("int").alias("slot"),
        F.lower(t[3]).alias("pos"),
        f[0].try_cast("double").alias("T_C"),
        f[1].try_cast("double").alias("gly_pct"),
        F.lower(f[2]).alias("substrate"),
        f[3].try_cast("double").alias("t_min"),
        F.when(~known, r[1]).alias("session_id"),
    )


def parse_capture_name(c) -> Column:
    """Typed fields of a capture name."""
    g = capture_groups(c)
    return capture_fields(g["_trench"], g["_flat"], g["_frame"])


def with_capture_name(df: DataFrame, c, out: str) -> DataFrame:
    """``df`` with the typed fields of a capture name as the struct ``out``.

    The patterns run once a row: a generated row is not merged into the
    expressions that use it, which would match again for every field.
    """
    return df.select("*", F.inline(F.array(capture_groups(c)))).withColumn(
        out, capture_fields(F.col("_trench"), F.col("_flat"), F.col("_frame"))).drop("_trench", "_flat", "_frame")


def acquisition_faults(prefix: str = "") -> dict[str, Column]:
    """Fault predicates of one acquisition block, keyed by rule name."""
    f = {name: F.col(prefix + name) for name in ACQUISITION_FIELDS}
    faults = {f"missing_{name}": is_blank(c) for name, c in f.items()}
    for name in ("exposure_ms", "gain", "magnification"):
        faults[f"invalid_{name}"] = ~is_finite(f[name]) | (number(f[name]) <= 0)
    faults["auto_exposure_on"] = ~is_false_text(f["auto_exposure"])
    faults["gamma_not_one"] = number(f["gamma"]) != 1.0
    faults["white_balance_not_fixed"] = f["white_balance"] != "fixed"
    faults["bit_depth"] = ~number(f["bit_depth"]).isin(*[float(b) for b in BIT_DEPTHS])
    faults["color_channel"] = ~f["color_channel"].isin(*COLOR_CHANNELS)
    return {k: F.coalesce(v, F.lit(True)) for k, v in faults.items()}
