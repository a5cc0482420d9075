"""Language identification with Kneser-Ney character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .charlm import CharModels, build_models, gram_counts, gram_pieces, gram_weights
from .frames import batch_of

ORDER = 4
UNKNOWN = "und"


def train_models(df: DataFrame, text: Column, label: Column, order: int = ORDER) -> CharModels:
    """One interpolated Kneser-Ney model per label, counted over all given rows."""
    return build_models(gram_weights(gram_counts(df, text, label, order, True), order, "kneser-ney"), order)


def entropies(df: DataFrame, columns: dict[str, Column], text: Column, models: CharModels) -> DataFrame:
    """``columns`` and per row: n_scored (characters), best and second class by
    cross-entropy in nats a character (ties go to the label that sorts first).
    Null and letterless texts have no best class."""
    shared, kept = df.sparkSession.sparkContext.broadcast(models), list(columns)
    picked = df.select(text.alias("ll_text"), *[c.alias(n) for n, c in columns.items()])

    def score(batches):
        own = shared.value
        names = np.array([*own.labels, None], object)
        for batch in batches:
            n = batch.num_rows
            total, size = np.zeros((n, len(own.labels))), np.zeros(n, np.int64)
            for start, codes, rows in gram_pieces(batch.column(0), own.order, True):
                if not len(codes):
                    continue
                logs = own.log_probabilities(codes)
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                np.add.at(total, start + rows[first], np.add.reduceat(logs, first, axis=0, dtype=np.float64))
                np.add.at(size, start + rows[first], np.diff(np.r_[first, len(rows)]))
            entropy = -total / np.maximum(size, 1)[:, None]
            order = np.argsort(entropy, axis=1, kind="stable")
            row = np.arange(n)
            best = entropy[row, order[:, 0]] if own.labels else np.zeros(n)
            second = entropy[row, order[:, 1]] if len(own.labels) > 1 else best + 1.0
            seen = (size > 0) & bool(own.labels)
            pred = np.where(seen, order[:, 0] if own.labels else 0, len(own.labels))
            out = {name: batch.column(k + 1) for k, name in enumerate(kept)}
            out |= {"n_scored": size, "best": pa.array(names[pred].tolist(), pa.string()), "entropy": np.where(seen, best, 0.0), "margin": np.where(seen, second - best, 0.0)}
            yield batch_of(out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(score, f"{kinds}, n_scored long, best string, entropy double, margin double")


def fit_calibration(scored: DataFrame, label: str) -> dict:
    """From scored rows of a known class: a logistic curve from the total
    log-likelihood margin to the share of right answers (fitted on a histogram
    of fixed bins), and mean and spread of each class's own cross-entropy."""
    x = F.least(F.floor(F.log1p(F.col("margin") * F.col("n_scored")) * 8), F.lit(127)).cast("int")
    known = scored.where((F.col("n_scored") > 0) & F.col(label).isNotNull())
    bins = known.groupBy(x.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("best") == F.col(label)).cast("long")).alias("right")).collect()
    curve = _logistic([(r["bin"] / 8 + 1 / 16, r["right"], r["n"]) for r in bins])
    weight, h = F.col("n_scored"), F.col("entropy")
    own = known.where(F.col("best") == F.col(label)).groupBy("best").agg(
        F.sum(weight * h).alias("wh"), F.sum(weight).alias("w"), F.sum(weight * h * h).alias("whh"), F.count(F.lit(1)).alias("n")).collect()
    limits = {}
    for r in own:
        mean = r["wh"] / r["w"]
        limits[r["best"]] = (mean, max(1e-3, (r["whh"] - 2 * mean * r["wh"] + mean * mean * r["w"]) / r["n"]) ** 0.5)
    return {"curve": curve, "limits": limits}


def _logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve by Newton steps, with one
    pseudo row of each answer in the middle of the scale."""
    rows = [*points, (2.0, 1, 2)]
    x, y, n = (np.array([r[k] for r in rows], float) for k in range(3))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(offset + slope * x, -30, 30)))
        g0, g1 = np.sum(y - n * p), np.sum((y - n * p) * x) - 0.01 * slope
        w = n * p * (1 - p) + 1e-9
        a, b, c = w.sum() + 1e-6, (w * x).sum(), (w * x * x).sum() + 0.01
        d = a * c - b * b
        step0, step1 = (c * g0 - b * g1) / d, (a * g1 - b * g0) / d
        offset, slope = offset + float(np.clip(step0, -2, 2)), max(0.0, slope + float(np.clip(step1, -2, 2)))
    return slope, offset


def identify(df: DataFrame, columns: dict[str, Column], text: Column, models: CharModels, calibration: dict,
             min_score: float = 0.5, max_deviation: float = 6.0) -> DataFrame:
    """``columns`` with lang_pred, score (probability that the answer is right),
    entropy, n_scored and rejected: the score is below ``min_score`` or the
    length-normalised cross-entropy lies ``max_deviation`` calibrated
    deviations above that of the class's own texts.  Null and letterless texts,
    and all texts where nothing could be learned, are ``und`` with score 0."""
    slope, offset = calibration["curve"]
    logit = F.lit(offset) + F.lit(slope) * F.log1p(F.col("margin") * F.col("n_scored"))
    scored = F.when(F.col("best").isNull(), 0.0).otherwise(1 / (1 + F.exp(-logit)))
    limits = calibration["limits"]
    high = F.lit(False)
    for name, (mean, spread) in limits.items():
        far = (F.col("entropy") - mean) * F.sqrt(F.col("n_scored").cast("double")) / spread > max_deviation
        high = F.when(F.col("best") == name, far).otherwise(high)
    rows = entropies(df, columns, text, models)
    return rows.select(*columns, F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), scored.alias("score"), "entropy", "n_scored",
                       (F.col("best").isNull() | (scored < min_score) | high).alias("rejected"))


def language_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred,
    score, entropy, n_scored, rejected.

    Models count the rows whose crc32(doc_id) mod 4 is 0 or 1 (or whose id is
    null), the calibration uses those where it is 3, and rows where it is 2 are
    held out of both.  A row's prediction depends on its text alone: repeated
    rows and equal texts get equal answers.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))
    text, lang = F.col("text"), F.col("lang").cast("string")
    models = train_models(docs.where(fold < 2), text, lang)
    calibration = {"curve": (1.0, 0.0), "limits": {}}
    if models.labels:
        calibration = fit_calibration(entropies(docs.where((fold == 3) & lang.isNotNull()), {"truth": lang}, text, models), "truth")
    return identify(docs, {"doc_id": F.col("doc_id"), "held_out": fold == 2}, text, models, calibration)
