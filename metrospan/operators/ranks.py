"""Row numbers over whole tables without a single-task window.

Both helpers cut the table into many ordered slices, count the slices, and add
the running offset to a window that only ever sees one slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import durable, stored, shuffle_width


def _offsets(counts: DataFrame, slice_col: str, partition: list[str] = ()) -> DataFrame:
    """Rows before each slice.  One row per slice, so the window is tiny."""
    before = W.partitionBy(*partition).orderBy(slice_col).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*partition, slice_col, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))


def uniform_rank(df: DataFrame, u: str, tie: list[str], out: str = "rank", slices: int | None = None,
                 partition: list[str] = ()) -> DataFrame:
    """1-based rank by a uniform column ``u`` in (0, 1), ties by ``tie``.

    A uniform key fills equal slices by construction, so no slice can be hot
    and the slice of a row depends on its own values only.  ``partition`` is
    for parameter-sized axes such as repeats.
    """
    n = slices or 8 * shuffle_width(df.sparkSession)
    keys = [*partition, "_slice"]
    cut = df.withColumn("_slice", F.floor(F.col(u) * n).cast("int"))
    offsets = _offsets(cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "_slice", list(partition))
    local = F.row_number().over(W.partitionBy(*keys).orderBy(u, *tie))
    # One row per slice: the planner, which sees only the size of the files, might send the table instead.
    return (
        cut.withColumn("_local", local)
        .join(F.broadcast(offsets), keys)
        .withColumn(out, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_slice", "_before", "_local")
    )


def ordered_rank(df: DataFrame, order: list[Column | str], partition: list[str] = (), out: str = "rank") -> DataFrame:
    """1-based row number in ``partition`` by ``order``, safe for a hot partition.

    The table is range-sorted on (partition, order) together, so one partition
    value may span many tasks; the last order key should make rows distinct.
    The sorted rows are checkpointed once: a second, differently sampled sort
    would break the offsets.
    """
    keys = [*partition, *order]
    marked = durable(
        df.repartitionByRange(shuffle_width(df.sparkSession), *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_slice", F.shiftright("_id", 33))
    )
    offsets = _offsets(marked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")), "_slice")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    # One row per shuffle partition.
    placed = marked.join(F.broadcast(offsets), "_slice").withColumn(out, place.cast("long"))
    placed = placed.drop("_id", "_slice", "_before")
    if not partition:
        return placed
    first = placed.groupBy(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(partition)]).agg(F.min(out).alias("_first"))
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_p{i}")) for i, p in enumerate(partition)])
    return placed.join(stored(first), same).select(*df.columns, (F.col(out) - F.col("_first") + 1).alias(out))


def id_list_chunks(df: DataFrame, by: list[str], item: str, chunk: int = 1000, sep: str = "|") -> DataFrame:
    """Sorted distinct ids per group as text, ``chunk`` ids per row.

    Nothing is dropped: a group with more ids has more rows, and no task ever
    holds more than one chunk.
    """
    distinct = df.select(*by, F.col(item).cast("string").alias("_item")).where(F.col("_item").isNotNull()).distinct()
    ranked = ordered_rank(distinct, ["_item"], by, "_rank")
    return (
        ranked.groupBy(*by, F.floor((F.col("_rank") - 1) / chunk).cast("long").alias("chunk_no"))
        .agg(F.count(F.lit(1)).alias("n_ids"),
             F.array_join(F.sort_array(F.collect_list("_item")), sep).alias("ids"))
    )
