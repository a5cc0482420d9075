"""Importance resampling between a target and a raw n-gram model."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, smallest_hashes, steps, stored, text_buffers
from .words import LOWER, mix, span_hashes, windows, word_spans

#: Buckets of the hashed word and word-pair models.
BUCKETS = 10_000


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, LOWER)
    pairs, at = windows(hashes, rows, 2)
    return (np.r_[mix(hashes), pairs] % np.uint64(BUCKETS)).astype(np.int64), np.r_[rows, rows[at]]


def gram_table(df: DataFrame, text: Column) -> np.ndarray:
    """Counts of the hashed words and word pairs of all rows: each task adds up
    its own, the result has one number for each bucket."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in steps(offsets):
                total += np.bincount(_grams(data, offsets[a: b + 1])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield batch_of({"bucket": at, "n": total[at]})

    out = np.zeros(BUCKETS, np.int64)
    for r in df.select(text.alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of the add-one smoothed target share over the raw share of each bucket."""
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def weigh(df: DataFrame, columns: list[str], text: Column, ratios: np.ndarray, seed_key: Column, seed: int = 0) -> DataFrame:
    """``columns`` with log_weight (sum over the text's n-grams; 0 for null or
    wordless text), gumbel_key = log_weight + standard Gumbel noise from a hash
    of (seed, key), and rank_key, an integer in the order of gumbel_key."""
    shared = df.sparkSession.sparkContext.broadcast(ratios)
    picked = df.select(text.alias("ll_text"), F.xxhash64(F.lit(seed), seed_key).alias("ll_seed"), *columns)

    def score(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            weight = np.zeros(batch.num_rows)
            for a, b in steps(offsets):
                buckets, rows = _grams(data, offsets[a: b + 1])
                weight[a:b] = np.bincount(rows, shared.value[buckets], b - a)
            u = ((mix(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
            key = weight - np.log(-np.log(u))
            bits = (key + 0.0).view(np.int64)
            yield batch_of({c: batch.column(k + 2) for k, c in enumerate(columns)} | {
                "log_weight": weight, "gumbel_key": key, "rank_key": np.where(bits < 0, ~bits | np.int64(-1 << 63), bits)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[2:])
    return picked.mapInArrow(score, f"{kinds}, log_weight double, gumbel_key double, rank_key long")


def kth_largest(df: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest value of an integer column, found digit by digit: each
    round counts the next eight bits of the rows that share the digits so far."""
    if k <= 0:
        return None
    prefix, left = 0, k
    digits = F.col(key).bitwiseXOR(F.lit(-(1 << 63)))  # order of the bits as an unsigned number
    for shift in range(56, -8, -8):
        digit = F.shiftrightunsigned(digits, shift).bitwiseAND(F.lit(255))
        rows = df if shift == 56 else df.where(F.shiftrightunsigned(digits, shift + 8) == prefix)
        counts = {r["d"]: r["n"] for r in rows.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if left <= counts[d]:
                prefix = prefix * 256 + d
                break
            left -= counts[d]
        else:
            return None
    return (prefix ^ (1 << 63)) - (1 << 64 if (prefix ^ (1 << 63)) >= 1 << 63 else 0)


def resample_query(docs: DataFrame, labels: DataFrame, share: float = 0.5, target_rows: int = 20_000) -> DataFrame:
    """Every row of ``docs``: doc_id, log_weight, gumbel_key, sampled.

    The target model is fitted on at most ``target_rows`` labelled rows with
    quality 1 and not toxic (smallest hash of the id), the raw model on all
    rows.  The ceil(share x rows) rows of largest gumbel_key are sampled, which
    draws without replacement in proportion to the weights; rows that tie with
    the last one (repeated rows) are sampled with it.  Without target rows all
    weights are those of the smoothed models, an empty table gives no row.
    """
    bad = F.coalesce(F.col("toxic"), F.lit(0)) != 0
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((bad | F.coalesce(F.col("quality") != 1, F.lit(True))).cast("int")).alias("bad"))
    # At most ``target_rows`` ids.
    chosen = F.broadcast(smallest_hashes(good.where("bad = 0").select("doc_id"), "doc_id", target_rows))
    raw = gram_table(docs, F.col("text"))
    target = gram_table(docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi"), F.col("text"))
    keyed = stored(weigh(docs, ["doc_id"], F.col("text"), log_ratios(target, raw), F.col("doc_id")), "weighed")
    k = math.ceil(Fraction(str(share)) * keyed.count())
    least = kth_largest(keyed, "rank_key", k)
    return keyed.select("doc_id", "log_weight", "gumbel_key", (F.col("rank_key") >= F.lit(least)).alias("sampled") if least is not None else F.lit(False).alias("sampled"))
