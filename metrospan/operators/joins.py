"""Contract-checked joins.

No side is hinted to broadcast unless its size is fixed: Spark measures the
sides at run time (adaptive execution), broadcasts what is small and splits
hot keys of what is not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import same_field
from ..session import stored


def exactly_one(facts: DataFrame, dim: DataFrame, on: list[str], keep: list[str], derived: bool = False) -> DataFrame:
    """Join each fact row to its only dimension row.

    ``derived`` says the dimension is a result of a large table: it is written
    first, so that the planner knows its size.

    Adds ``match_status``: ok, missing, ambiguous or no_key.  The dimension is
    reduced to one row per key before the join, so an ambiguous key cannot
    multiply fact rows.
    """
    one = dim.groupBy(*on).agg(
        F.count(F.lit(1)).alias("_matches"), *[F.min(c).alias(c) for c in keep])
    joined = facts.join(stored(one) if derived else one, on, "left")
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in on])
    status = (F.when(no_key, "no_key").when(F.col("_matches").isNull(), "missing")
              .when(F.col("_matches") > 1, "ambiguous").otherwise("ok"))
    clean = [F.when(F.col("_matches") == 1, F.col(c)).alias(c) for c in keep]
    return joined.select(*facts.columns, *clean, status.alias("match_status"))


def role_lookup(facts: DataFrame, registry: DataFrame, roles: dict[str, str], key: str, kind: str, fields: list[str],
                carry: list[str] = ()) -> DataFrame:
    """Look the same registry up once per role and check kind and fields.

    ``roles`` maps a fact key column to the kind its entry must have.  Adds
    ``<fact key>_status`` (ok, missing, ambiguous, wrong_kind or
    field_mismatch) and ``<fact key>_<column>`` for every carried registry
    column.  A repeated registry key is reduced to one row and named
    ambiguous, so that it cannot multiply fact rows.
    """
    out, types, given = facts, dict(facts.dtypes), dict(registry.dtypes)
    one = registry.groupBy(key).agg(F.count(F.lit(1)).alias("_matches"), *[F.min(c).alias(c) for c in dict.fromkeys([kind, *fields, *carry]) if c != key])
    for fact_key, expected in roles.items():
        side = one.select(
            F.col(key).alias(fact_key), F.col(kind).alias("_kind"), "_matches",
            *[F.col(f).alias(f"_{f}") for f in fields], *[F.col(c).alias(f"{fact_key}_{c}") for c in carry])
        # Equal values of one type need no text.  As an array the comparisons are generated in many small
        # methods; in one method with the joins around them they are too large for the JVM to compile.
        agree = F.forall(F.array(F.lit(True), *[
            F.coalesce(F.col(f) == F.col(f"_{f}"), F.lit(False)) | same_field(f, f"_{f}") if types[f] == given[f] else same_field(f, f"_{f}")
            for f in fields]), lambda same: same)
        status = (F.when(F.col("_matches").isNull(), "missing").when(F.col("_matches") > 1, "ambiguous")
                  .when(~F.col("_kind").eqNullSafe(F.lit(expected)), "wrong_kind").when(~agree, "field_mismatch").otherwise("ok"))
        out = (out.join(side, fact_key, "left").withColumn(f"{fact_key}_status", status)
               .drop("_kind", "_matches", *[f"_{f}" for f in fields]))
    return out


def optional_match(facts: DataFrame, labels: DataFrame, fact_key: str, label_key: str, keep: list[str]) -> DataFrame:
    """Left join used only where the key is present; a present key without a
    partner is a fault, a missing key is not."""
    side = labels.groupBy(label_key).agg(
        F.count(F.lit(1)).alias("_matches"), *[F.min(c).alias(c) for c in keep])
    side = side.withColumnRenamed(label_key, "_label_key")
    joined = facts.join(side, F.col(fact_key) == F.col("_label_key"), "left")
    status = (F.when(F.col(fact_key).isNull(), "unlabelled").when(F.col("_matches").isNull(), "missing_label")
              .when(F.col("_matches") > 1, "ambiguous_label").otherwise("ok"))
    return joined.select(*facts.columns, *keep, status.alias("label_status"))


def stale_rows(given: DataFrame, current: DataFrame, key: str, exact: list[str], numeric: list[str],
               rtol: float = 1e-9, atol: float = 1e-12) -> DataFrame:
    """Exported rows compared with the authoritative rows, column by column.

    NULL equals NULL; ``exact`` columns compare as text, ``numeric`` ones under
    a tolerance relative to the authoritative value.
    """
    columns = [*exact, *numeric]
    a = given.select(F.col(key), F.lit(True).alias("_in_given"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    b = current.select(F.col(key), F.lit(True).alias("_in_current"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    joined = a.join(b, key, "full")

    def differs(c: str) -> Column:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same = x.cast("string").eqNullSafe(y.cast("string"))
        if c in numeric:
            same = same | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        return ~same

    both = F.col("_in_given").isNotNull() & F.col("_in_current").isNotNull()
    fields = F.concat_ws(",", *[F.when(differs(c), F.lit(c)) for c in columns])
    status = (F.when(F.col("_in_given").isNull(), "not_exported").when(F.col("_in_current").isNull(), "not_current")
              .when(fields != "", "stale").otherwise("ok"))
    return joined.select(F.col(key), status.alias("status"), F.when(both, fields).otherwise("").alias("fields"))


def shared_ids(calibration: DataFrame, id_text: str, evaluation: DataFrame, ids: list[str], sep: str = r"\|") -> DataFrame:
    """Evaluation ids that also appear in the joined id lists of a calibration."""
    used = calibration.select(F.explode(F.split(id_text, sep)).alias("id")).distinct()
    measured = reduce(lambda a, b: a.union(b), [
        evaluation.select(F.col(c).cast("string").alias("id")) for c in ids]).where("id is not null").distinct()
    return measured.join(used, "id", "left_semi")


def leakage_audit(df: DataFrame, keys: list[str], role: str) -> DataFrame:
    """Values seen in both roles, counted per key.

    The unpivot and the first grouping combine on the map side; only
    (key, value) pairs with their smallest and largest role are shuffled.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])
    long = df.select(role, F.inline(entries)).where("value is not null")
    per_value = long.groupBy("key", "value").agg(F.min(role).alias("_lo"), F.max(role).alias("_hi"))
    leak = F.col("_lo") != F.col("_hi")
    return per_value.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_values"), F.count_if(leak).alias("n_leaked"),
        F.min(F.when(leak, F.col("value"))).alias("example"))


def one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is unique on both sides, and one row that says what the
    comparison rests on: counts of unique, repeated and unpaired keys, and a
    status: REPEATED_KEYS, NOT_RUN (nothing pairs) or OK."""
    def reduced(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in on]
        return df.groupBy(*on).agg(F.count(F.lit(1)).alias(f"_{side}"), *[F.min(c).alias(c) for c in rest])

    both = reduced(left, "l").join(reduced(right, "r"), on, "full")
    l, r = (F.coalesce(F.col(c), F.lit(0)) for c in ("_l", "_r"))
    paired, repeated = (l == 1) & (r == 1), (l > 1) | (r > 1)
    counts = both.agg(F.count_if(paired).alias("n_paired"), F.count_if(repeated).alias("n_repeated"),
                      F.count_if((l > 0) & (r == 0)).alias("n_left_only"), F.count_if((r > 0) & (l == 0)).alias("n_right_only"))
    status = F.when(F.col("n_repeated") > 0, "REPEATED_KEYS").when(F.col("n_paired") == 0, "NOT_RUN").otherwise("OK")
    return both.where(paired).drop("_l", "_r"), counts.withColumn("status", status)
