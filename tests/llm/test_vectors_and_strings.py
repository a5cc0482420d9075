"""Whitening, fill-in-the-middle and substring dedup against plain Python and NumPy."""
import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrospan.llm import fill_middle, induced, substring_dedup, whitening

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, spans string, n_bytes long, ll_text string"


def documents(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "clash", 7, None) for i, t in rows], EXTRA).repartition(parts)


# ---- whitening -------------------------------------------------------------

def faddeev(matrix):
    """Characteristic polynomial by the Faddeev-LeVerrier recurrence in fractions."""
    d, c = len(matrix), [Fraction(1)]
    n = [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        a = [[n[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        n = [[sum(matrix[i][m] * a[m][j] for m in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(n[i][i] for i in range(d)) / k)
    return [int(v) for v in c[::-1]]


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_characteristic_polynomial(spark, d):
    b = np.random.default_rng(d).integers(-1000, 1000, (d, d + 1))
    if d == 6:
        b[3] = b[2]  # singular, and a zero below the diagonal on the way
        b[0] = 0
    matrix = (b @ b.T).tolist()
    assert whitening.characteristic_polynomial(spark, matrix) == faddeev(matrix)


def test_largest_roots_with_equal_ones():
    poly = [int(round(v)) for v in np.poly([5, 5, 5, 2, 0, 0])[::-1]]
    assert [r / (1 << b) for r, b, _ in whitening.largest_roots(poly, 6)] == [5, 5, 5, 2, 0, 0]


def whitened(rows, many=4):
    ok = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max(len(v) for _, v in ok)
    xs = [[int(np.floor(256 * float(np.float32(c)))) for c in v] + [0] * (d - len(v)) for _, v in ok]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    cov = np.cov(np.array(fit, float).T, bias=True).reshape(d, d)
    e, u = np.linalg.eigh(cov)
    order = np.argsort(-e)[:many]
    return [(i, k, n, sum((n * a - b) ** 2 for a, b in zip(x, sums)), abs((np.array(x) - np.array(sums) / n) @ u[:, c] / np.sqrt(e[c])), e[c] / np.trace(cov))
            for (i, _), x in zip(ok, xs) for k, c in enumerate(order, 1)]


@pytest.mark.parametrize("scale", [1.0, 30_000.0])
def test_whitening_against_eigh(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=6) * scale).tolist()) for i in range(40)]
    rows += [(100, None), (101, [None] * 6), (102, [float("nan")] * 6), (103, [float("inf")] * 6), (104, [0.1, 0.2]), (105, []), (None, [0.5] * 6)]
    rows += rows[:3]
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<float>, ll_x string, n int").repartition(3)
    got = sorted(whitening.whitening_query(df).collect(), key=lambda r: (str(r.vec_id), r.component))
    want = sorted(whitened(rows), key=lambda r: (str(r[0]), r[1]))
    assert len(got) == len(want)
    for g, (i, k, n, deviation, white, share) in zip(got, want):
        assert (g.vec_id, g.component, g.n, g.deviation) == (i, k, n, deviation if deviation < 2 ** 63 else None)
        assert abs(abs(g.whitened) - white) < 1e-9 and abs(g.explained - share) < 1e-12 and g.identity_error < 1e-12


@pytest.mark.parametrize("rows, many", [([], 0), ([(1, [])], 0), ([(1, [1.0, 2.0])], 2), ([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 0.0])], 6)])
def test_whitening_of_few_vectors(spark, rows, many):
    got = whitening.whitening_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == many
    assert len(rows) != 1 or all(r.whitened is None and r.identity_error is None for r in got)


def test_equal_eigenvalues(spark):
    rows = [(k, [8.0 * (1 if k < 6 else -1) if i == k % 6 else 0.0 for i in range(6)]) for k in range(12)]
    got = whitening.whitening_query(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 48 and max(r.identity_error for r in got) < 1e-12 and all(abs(r.explained - 1 / 6) < 1e-12 for r in got)


def test_exact_sums_of_large_entries():
    x = np.array([[(1 << 62) + 5, -7], [-(1 << 63), 3], [1 << 40, -(1 << 21)]], np.int64)
    back = sum(p.astype(np.int64).astype(object) * (1 << (20 * k)) for k, p in enumerate(whitening._digits(x)))
    assert back.tolist() == x.astype(object).tolist()


# ---- fill in the middle ----------------------------------------------------

def rewritten(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 80 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_middle_round_trip(spark):
    rng = random.Random(5)
    rows = [(None, None), (1, ""), (2, " "), (3, "a"), (4, "  a  "), (5, "a bé   c\x85 d\x1c e"), (6, "x <P> y"), (7, "中文 中 \U0001f600 b" * 50), (8, "<S"), (9, "<P" * 40), (10, "word " * 400_000), (11, "\n" * 70)]
    rows += [(100 + k, "".join(rng.choice("ab \n\té中<PSM>\x0b\x1c") for _ in range(rng.randint(0, 60)))) for k in range(300)]
    rows += [(4, "  a  "), (4, "other text")]
    got = fill_middle.fill_middle(documents(spark, rows), ["doc_id", "spans"], F.col("text"), F.col("doc_id")).collect()
    want = sorted([(i, *rewritten(i, t), t or "") for i, t in rows], key=str)
    assert sorted([(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got], key=str) == want


def test_fill_middle_empty(spark):
    assert fill_middle.fill_middle_query(documents(spark, [], 1)).collect() == []


# ---- substrings ------------------------------------------------------------

@pytest.mark.parametrize("buckets", [1024, 2])
def test_suffix_arrays(monkeypatch, buckets):
    monkeypatch.setattr(induced, "BUCKETS", buckets)
    rng = np.random.default_rng(buckets)
    for _ in range(150):
        text = np.append(rng.integers(1, int(rng.integers(1, 6)) + 1, int(rng.integers(0, 60))), 0)
        order = induced.suffix_array(text)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = induced.common_prefixes(text, order)
        for i, j in zip(order[1:], order):
            a, b = text[i:].tolist(), text[j:].tolist()
            assert shared[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[i, t] = (i, len(data), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return sorted([out[r] for r in rows], key=str)


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é中") for _ in range(rng.randint(20, 400))) for _ in range(12)]
    rows = [(None, None), (1, ""), (2, None), (3, "x" * 350), (4, "x" * 150), (5, "ab" * 300), (6, "ab" * 55), (7, "x" * 99)]
    rows += [(10 + k, "".join(rng.choice(base)[rng.randint(0, 50):] if rng.random() < .6 else "".join(rng.choice("qrstuv\n") for _ in range(rng.randint(0, 150)))
                              for _ in range(rng.randint(0, 5)))) for k in range(100)]
    return rows + [(None, rows[40][1]), rows[50], rows[50]]


@pytest.mark.parametrize("bounds", [None, (2000, 5)])
def test_substrings_against_all_strings(spark, monkeypatch, bounds):
    if bounds:  # many shards, and most anchors split over several
        monkeypatch.setattr(substring_dedup.shard_texts, "__defaults__", bounds)
    rows = passages(4 if bounds else 5)
    assert sorted(map(tuple, substring_dedup.substring_query(documents(spark, rows)).collect()), key=str) == removed(rows)


def test_substrings_of_a_long_text(spark):
    rng = random.Random(8)
    big = "".join(rng.choice("klmno pé") for _ in range(1_300_000))
    rows = [(2, big + big[1000:1300] + big[7:100_000]), (1, big[40_000:90_000])]
    assert sorted(map(tuple, substring_dedup.substring_query(documents(spark, rows, 1)).collect()), key=str) == removed(rows)


def test_substrings_text_ids_and_empty(spark):
    rows = [("b", "z" * 50 + "same words here " * 9), ("a", "y" * 20 + "same words here " * 9), (None, "same words here " * 9)]
    got = substring_dedup.substring_query(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == removed(rows)
    assert substring_dedup.substring_query(documents(spark, [], 1)).collect() == []
