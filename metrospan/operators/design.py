"""Space-filling subset of a candidate table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable


def importance_weights(importance: list[float]) -> list[float]:
    """Non-negative importances scaled to one, floored at a tenth each."""
    positive = [max(0.0, v) for v in importance]
    total = sum(positive)
    share = [v / total for v in positive] if total else [1 / len(positive)] * len(positive)
    return [0.1 + 0.7 * s for s in share]


def farthest_points(df: DataFrame, key: str, scaled: list[str], weights: list[float], runs: int,
                    response: str | None = None, cut_every: int = 8) -> DataFrame:
    """Pick ``runs`` rows: the one nearest the centre, then always the row
    farthest from all picks.

    ``scaled`` are coordinates in [0, 1]; ``response`` (in [0, 1]) adds a
    half-weight coordinate.  Each round is one distributed arg-max over the
    table; only the picked row (a key and its coordinates) reaches the driver.
    """
    coords = [F.col(c) * (w ** 0.5) for c, w in zip(scaled, weights)]
    if response:
        coords.append(0.5 * F.col(response))
    t = df.select(key, F.array(*coords).alias("_p"),
                  reduce(lambda a, b: a + b, [F.pow(F.col(c) - 0.5, 2) for c in scaled]).alias("_centre"))
    t = durable(t.withColumn("_d", F.lit(float("inf"))))
    first = t.agg(F.min(F.struct("_centre", key, "_p")).alias("r")).first()["r"]
    picks = [(1, first[key], None)]
    chosen, point = [first[key]], first["_p"]
    while len(picks) < runs:
        t = t.withColumn("_d", F.least("_d", _squared_distance(F.col("_p"), point)))
        if len(picks) % cut_every == 0:
            t = durable(t)
        # Largest distance first, then the smallest key.
        best = t.where(~F.col(key).isin(chosen)).agg(
            F.min(F.struct((-F.col("_d")).alias("m"), F.col(key).alias("k"), F.col("_p").alias("p"))).alias("r")).first()["r"]
        if best is None:
            break
        picks.append((len(picks) + 1, best["k"], -best["m"]))
        chosen.append(best["k"])
        point = best["p"]
    kind = dict(df.dtypes)[key]
    return df.sparkSession.createDataFrame(picks, f"selection_index int, {key} {kind}, squared_distance double")


def _squared_distance(p: Column, point: list[float]) -> Column:
    other = F.array(*[F.lit(float(v)) for v in point])
    return F.aggregate(F.zip_with(p, other, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
