"""URL filtering: suffix rules first, then a ratio of two character models."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .charlm import CharModels, build_models, gram_counts, gram_pieces, gram_weights
from .frames import batch_of

ORDER = 5

#: Fixed values: (host, path, verdict) of the given rules.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to a slash, question mark, hash or the end, A-Z lower-cased."""
    found = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for domain, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        rule, verdict = F.when(fits, domain + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def differences(df: DataFrame, columns: list[str], models: CharModels, good: str, bad: str) -> DataFrame:
    """``columns`` with ``difference``: log-likelihood of the accepted less that
    of the rejected model, per character; 0 for empty text or a missing model."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    picked = df.select("ll_url", *columns)

    def score(batches):
        own = shared.value
        usable = good in own.labels and bad in own.labels
        for batch in batches:
            total, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if usable:
                a, b = own.labels.index(good), own.labels.index(bad)
                for start, codes, rows in gram_pieces(batch.column(0), own.order, False):
                    logs = own.log_probabilities(codes).astype(np.float64)
                    n = int(rows[-1]) + 1 if len(rows) else 0
                    total[start: start + n] += np.bincount(rows, logs[:, a] - logs[:, b], n)
                    size[start: start + n] += np.bincount(rows, minlength=n)
            yield batch_of({c: batch.column(k + 1) for k, c in enumerate(columns)} | {"difference": total / np.maximum(size, 1)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(score, f"{kinds}, difference double")


def calibrated_threshold(scored: DataFrame, label: str, good: str, bins: int = 2000) -> float:
    """The difference that splits labelled rows with the least mean error of the
    two classes, from a histogram of fixed bins over (-4, 4); ties go to the
    bin nearest to zero.  Zero without rows of both classes."""
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("difference") + 4) / 8 * bins))).cast("int")
    table = np.zeros((bins, 2))
    for r in scored.groupBy(place.alias("bin"), (F.col(label) == good).alias("good")).count().collect():
        table[r["bin"], int(r["good"])] += r["count"]
    if not table.sum(0).all():
        return 0.0
    share = np.vstack([np.zeros(2), np.cumsum(table, 0)]) / table.sum(0)
    error = share[:, 1] + 1 - share[:, 0]  # accepted below the edge, rejected above it
    edges = -4 + np.arange(bins + 1) * 8 / bins
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Every row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, difference.

    URLs that a rule decides are the labelled rows: three quarters of them (by
    hash of the URL) are counted into the two variable-order Markov models of
    host and path, the rest calibrates the threshold.  The models judge the
    others: allow at or above the threshold, else block.  A null URL or one
    without ``://`` has empty host and path, fits no rule and has difference 0.
    Equal URLs get equal answers.  Without labelled rows of both kinds the
    difference is 0 everywhere and everything undecided is allowed.
    """
    url = F.col("url")
    host, path = url_host(url), url_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), F.concat("host", "path").alias("ll_url"))
    known = rows.where(F.col("says").isNotNull())
    check = F.pmod(F.xxhash64("ll_url"), F.lit(4)) == 3
    counts = gram_counts(known.where(~check), F.col("ll_url"), F.col("says"), ORDER, False)
    models = build_models(gram_weights(counts, ORDER, "witten-bell"), ORDER)
    threshold = calibrated_threshold(differences(known.where(check), ["says"], models, "allow", "block"), "says", "allow")
    scored = differences(rows, ["page_id", "host", "path", "rule", "says"], models, "allow", "block")
    verdict = F.coalesce("says", F.when(F.col("difference") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "difference")
