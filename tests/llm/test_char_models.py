"""Kneser-Ney and Witten-Bell probabilities of every counted n-gram against plain Python."""
import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metrospan.llm import charlm

ORDER = 4
TEXTS = [("en", "the cat sat on the mat and the dog sat too"), ("en", "a cat and a dog"), ("de", "der hund sitzt auf der matte und die katze auch"), ("de", "das haus"), ("xx", "q")]


def grams(text):
    """The n-grams of the highest order as tuples of character numbers."""
    out = []
    for _, codes, _ in charlm.gram_pieces(pa.array([text]), ORDER, True):
        out += [tuple(int(c) >> charlm.BITS * k & (1 << charlm.BITS) - 1 for k in reversed(range(ORDER))) for c in codes]
    return out


def levels(own, kneser_ney):
    """Counts of every order; below the highest, Kneser-Ney counts different extensions."""
    out = {ORDER: collections.Counter(own)}
    for n in range(ORDER - 1, 0, -1):
        out[n] = collections.Counter()
        for g, c in out[n + 1].items():
            out[n][g[1:]] += 1 if kneser_ney else c
    return out


def probability(gram, counts, kneser_ney):
    n = len(gram)
    if n == 0:
        return 1.0 / (1 << charlm.BITS)
    lower = probability(gram[1:], counts, kneser_ney)
    same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
    if not same:
        return lower
    total = sum(same.values())
    if kneser_ney:
        n1, n2 = (sum(c == k for c in counts[n].values()) for k in (1, 2))
        drop = min(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.95)
        alpha = {g: max(c - drop, 0) / total for g, c in same.items()}
    else:
        alpha = {g: c / (total + len(same)) for g, c in same.items()}
    return alpha.get(gram, 0.0) + min(1.0, max(1e-6, 1 - sum(alpha.values()))) * lower


@pytest.mark.parametrize("smoothing", ["kneser-ney", "witten-bell"])
def test_probabilities_of_all_grams(spark, smoothing):
    df = spark.createDataFrame(TEXTS, "label string, text string").repartition(2)
    counts = charlm.gram_counts(df, F.col("text"), F.col("label"), ORDER, True)
    model = charlm.build_models(charlm.gram_weights(counts, ORDER, smoothing), ORDER)
    assert model.labels == ["de", "en", "xx"]
    per = {lab: levels([g for name, t in TEXTS if name == lab for g in grams(t)], smoothing == "kneser-ney") for lab in model.labels}
    # Every n-gram that was counted once is stored, whatever its share.
    for n in range(1, ORDER + 1):
        assert len(model.keys[n]) == len({g for c in per.values() for g in c[n]})
    asked = sorted({g for _, t in [*TEXTS, ("", "the zebra und der cat")] for g in grams(t)})
    codes = np.array([sum(v << charlm.BITS * k for k, v in enumerate(reversed(g))) for g in asked], np.uint64)
    got = model.log_probabilities(codes)
    want = np.log([[probability(g, per[lab], smoothing == "kneser-ney") for lab in model.labels] for g in asked])
    assert np.allclose(got, want, atol=1e-4)


def test_rare_grams_of_small_and_large_classes_stay(spark):
    df = spark.createDataFrame([("big", "ab" * 40_000)] * 50 + [("big", "xyz"), ("small", "ab xyz")], "label string, text string")
    model = charlm.build_models(charlm.gram_weights(charlm.gram_counts(df, F.col("text"), F.col("label"), ORDER, True), ORDER, "kneser-ney"), ORDER)
    codes = np.array([sum(v << charlm.BITS * k for k, v in enumerate(reversed(g))) for g in grams("xyz")], np.uint64)
    assert np.isin(codes, model.keys[ORDER]).all()
