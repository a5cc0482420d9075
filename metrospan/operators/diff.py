"""Comparison of two versions of a table under declared tolerances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# The comparison policy.
RTOL, ATOL = 1e-8, 1e-10
JSON_TOKEN = r'("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|[\[\]{},:])'


def _cells(before: DataFrame, after: DataFrame, key: list[str], exact: list[str], numeric: list[str],
           discrete: list[str]) -> DataFrame:
    """Long table (key..., column, mode, before, after, number before/after)."""
    columns = [(c, "exact_text") for c in exact] + [(c, "exact_discrete") for c in discrete] + [
        (c, "numeric_tolerance") for c in numeric]
    a = before.select(*key, *[F.col(c).alias(f"_a_{c}") for c, _ in columns], F.lit(True).alias("_ina"))
    b = after.select(*key, *[F.col(c).alias(f"_b_{c}") for c, _ in columns], F.lit(True).alias("_inb"))
    null = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(c).alias("column"), F.lit(mode).alias("mode"),
            F.col(f"_a_{c}").cast("string").alias("before"), F.col(f"_b_{c}").cast("string").alias("after"),
            (null if mode == "exact_text" else F.col(f"_a_{c}").cast("double")).alias("x"),
            (null if mode == "exact_text" else F.col(f"_b_{c}").cast("double")).alias("y"))
        for c, mode in columns]
    joined = a.join(b, key, "full")
    return joined.select(*key, (F.col("_ina").isNotNull() & F.col("_inb").isNotNull()).alias("paired"),
                         F.inline(F.array(*entries)))


def _differs(rtol: float, atol: float) -> Column:
    x, y = F.col("x"), F.col("y")
    same_text = F.col("before").eqNullSafe(F.col("after"))
    finite = (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    close = F.coalesce(finite & (F.abs(y - x) <= atol + rtol * F.abs(x)), F.lit(False))
    return ~(same_text | ((F.col("mode") == "numeric_tolerance") & close))


def table_diff(before: DataFrame, after: DataFrame, key: list[str], exact: list[str] = (), numeric: list[str] = (),
               discrete: list[str] = (), rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """One row per column: missing masks, differing rows, largest errors."""
    cells = _cells(before, after, key, list(exact), list(numeric), list(discrete)).where("paired")
    err = F.abs(F.col("y") - F.col("x"))
    rel = F.when(F.col("x") != 0, err / F.abs("x")).when(err == 0, 0.0)
    a0, b0 = F.col("before").isNull(), F.col("after").isNull()
    return cells.groupBy("column", "mode").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(a0).alias("missing_before"), F.count_if(b0).alias("missing_after"),
        (F.count_if(a0 != b0) == 0).alias("missing_mask_equal"),
        F.count_if(_differs(rtol, atol)).alias("different_rows"),
        F.max(err).alias("max_abs_error"), F.max(rel).alias("max_rel_error"),
        F.count_if((F.col("x") == 0) & (err > 0)).alias("unbounded_relative_error_count"),
    ).withColumn("within_policy", F.col("different_rows") == 0)


def diff_examples(before: DataFrame, after: DataFrame, key: list[str], exact: list[str] = (), numeric: list[str] = (),
                  discrete: list[str] = (), n: int = 3, rtol: float = RTOL, atol: float = ATOL) -> DataFrame:
    """First ``n`` differing rows per column, by key.

    ``row_number <= n`` is pruned on each map task before the shuffle.
    """
    cells = _cells(before, after, key, list(exact), list(numeric), list(discrete)).where("paired")
    w = W.partitionBy("column").orderBy(*key)
    bad = cells.where(_differs(rtol, atol)).withColumn("example", F.row_number().over(w)).where(F.col("example") <= n)
    return bad.select("column", *key, "example", "before", "after")


def artifact_status(before: DataFrame, after: DataFrame, key: list[str], exact: list[str] = (),
                    numeric: list[str] = (), discrete: list[str] = ()) -> DataFrame:
    """One row that classifies the change of a whole artifact."""
    spark = (before or after).sparkSession
    if before is None or after is None:
        return spark.range(1).select(F.lit("MISSING_ARTIFACT").alias("status"), F.lit(None).cast("bigint").alias("rows_before"),
                                     F.lit(None).cast("bigint").alias("rows_after"), F.lit(None).cast("bigint").alias("different_columns"))
    added = [c for c in after.columns if c not in before.columns]
    removed = [c for c in before.columns if c not in after.columns]
    order_same = [c for c in before.columns if c in after.columns] == [c for c in after.columns if c in before.columns]
    diff = table_diff(before, after, key, exact, numeric, discrete)
    d = diff.agg(F.count_if(~F.col("within_policy")).alias("bad"), F.max("max_abs_error").alias("err"))
    na = before.agg(F.count(F.lit(1)).alias("rows_before"))
    nb = after.agg(F.count(F.lit(1)).alias("rows_after"))
    value = F.lit("VALUE_CHANGED_WITH_SCHEMA_CHANGE" if added or removed else "VALUE_CHANGED")
    same = ("SCHEMA_CHANGED_COMMON_VALUES_WITHIN_POLICY" if added or removed else
            "COLUMN_ORDER_CHANGED" if not order_same else None)
    settled = F.lit(same) if same else F.when(F.coalesce(F.col("err"), F.lit(0.0)) == 0, "IDENTICAL").otherwise(
        "VALUES_WITHIN_POLICY")
    from .scalars import one_row
    t = d.withColumn("rows_before", one_row(na)["rows_before"]).withColumn("rows_after", one_row(nb)["rows_after"])
    status = (F.when(F.col("rows_before") != F.col("rows_after"), "ROW_COUNT_CHANGED").when(F.col("bad") > 0, value)
              .otherwise(settled))
    return t.select(status.alias("status"), "rows_before", "rows_after", F.col("bad").alias("different_columns"))


def run_summary(statuses: DataFrame) -> DataFrame:
    """Roll-up over artifact rows (status column)."""
    s = F.col("status")
    return statuses.agg(
        F.count(F.lit(1)).alias("artifacts"), F.count_if(s == "MISSING_ARTIFACT").alias("missing"),
        F.count_if(s == "IDENTICAL").alias("identical"), F.count_if(s == "ROW_COUNT_CHANGED").alias("row_count_changed"),
        F.count_if(s.startswith("VALUE_CHANGED")).alias("changed"),
        F.count_if(s.isin("IDENTICAL", "VALUES_WITHIN_POLICY")).alias("within_policy"))


def _tokens(c: Column) -> Column:
    """Tokens of JSON text after key sorting; NULL for malformed or repeated keys."""
    return F.regexp_extract_all(F.to_json(F.try_parse_json(c)), F.lit(JSON_TOKEN), F.lit(1))


def json_cells_equal(a: Column, b: Column, rtol: float = RTOL, atol: float = ATOL) -> Column:
    """Equal structure with every number within tolerance; key order is ignored."""
    return _tokens_equal(_tokens(a), _tokens(b), rtol, atol)


def _tokens_equal(x: Column, y: Column, rtol: float, atol: float) -> Column:
    number = r"^-?\d"

    def same(s: Column, t: Column) -> Column:
        u, v = s.try_cast("double"), t.try_cast("double")
        close = F.abs(v - u) <= atol + rtol * F.abs(u)
        return (s == t) | F.coalesce(s.rlike(number) & t.rlike(number) & close, F.lit(False))

    pairs = F.zip_with(x, y, lambda s, t: F.coalesce(same(s, t), F.lit(False)))
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("boolean")).when(F.size(x) != F.size(y), F.lit(False)).otherwise(
        F.forall(pairs, lambda p: p))


def json_cell_diff(df: DataFrame, before: str, after: str) -> DataFrame:
    """Counts of JSON cells by outcome of the comparison."""
    same = F.col(before) == F.col(after)
    # Parsed once per cell, and only where the text differs.
    t = df.select(same.alias("_same"), F.when(~same, _tokens(F.col(before))).alias("_x"), F.when(~same, _tokens(F.col(after))).alias("_y"))
    t = t.withColumn("_equal", _tokens_equal(F.col("_x"), F.col("_y"), RTOL, ATOL))
    status = (F.when(F.col("_same"), "identical_text").when(F.col("_equal").isNull(), "invalid_json")
              .when(F.col("_equal"), "equal_after_normalisation").otherwise("different"))
    return t.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def pixel_diff(before: DataFrame, after: DataFrame, image: str) -> DataFrame:
    """Differing, vanished and new pixels per image."""
    key = [image, "y", "x"]
    j = (before.select(*key, F.col("value").alias("_a"), F.lit(1).alias("_ina"))
         .join(after.select(*key, F.col("value").alias("_b"), F.lit(1).alias("_inb")), key, "full"))
    ina, inb = F.col("_ina").isNotNull(), F.col("_inb").isNotNull()
    return j.groupBy(image).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(ina & inb & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
        F.count_if(ina & ~inb).alias("removed"), F.count_if(inb & ~ina).alias("added"))


def inventory_diff(before: DataFrame, after: DataFrame, path: str, digest: str) -> DataFrame:
    """Artifacts only before, only after, equal or changed (both sides kept)."""
    j = (before.groupBy(path).agg(F.min(digest).alias("_a"))
         .join(after.groupBy(path).agg(F.min(digest).alias("_b")), path, "full"))
    status = (F.when(F.col("_b").isNull(), "only_before").when(F.col("_a").isNull(), "only_after")
              .when(F.col("_a") == F.col("_b"), "equal").otherwise("changed"))
    return j.select(path, status.alias("status"))
