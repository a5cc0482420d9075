"""The randomness battery and its discovery limits against plain Python, and very long tokens."""
import math
import random

import pytest

from metrospan.llm import secret_scan

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def phi(z):
    return max(1e-20, 0.5 * math.erfc(-z / math.sqrt(2)))


def battery(token):
    """(encoding, n, p_random, p_ordinary) by the formulas, character by character."""
    import re
    body = token.rstrip("=")
    name, alphabet, chance = next((e[0], e[2], e[3]) for e in secret_scan.ENCODINGS if re.fullmatch(e[1], body))
    n, k, s = len(body), len(alphabet), [alphabet.index(c) + 1 for c in body]
    chi = k / n * sum(s.count(j) ** 2 for j in range(1, k + 1)) - n
    high = [v > k / 2 for v in s]
    runs, up = 1 + sum(a != b for a, b in zip(high, high[1:])), sum(high)
    mean = sum(s) / n
    serial = sum((a - mean) * (b - mean) for a, b in zip(s, s[1:])) / max(1e-9, sum((a - mean) ** 2 for a in s))
    even = 2 * up * (n - up)
    z1 = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    z2 = 40 if even == 0 else abs(runs - 1 - even / n) / math.sqrt(max(1e-9, even * (even - n) / (n * n * (n - 1))))
    z3 = abs(serial + 1 / n) * math.sqrt(n)
    z0 = (chi - (k * (1 + (n - 1) * chance) - n)) / math.sqrt(2 * (k - 1) * (n - 1) / n + 4 * n * (k * chance - 1))
    return name, n, min(1, 3 * min(phi(-z1), 2 * phi(-z2), 2 * phi(-z3))), phi(z0)


def tokens(seed, alphabet, low, high, many):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(low, high))) for _ in range(many)]


def test_battery_against_formulas(spark):
    every = tokens(1, BASE64, 20, 90, 30) + tokens(2, "0123456789abcdef", 20, 70, 20) + tokens(3, "abcdefgh", 20, 60, 10) + ["a" * 30, "ab" * 20, "Word" * 9, "A" * 25 + "==", "x_-" * 12]
    rows = secret_scan.test_tokens(spark.createDataFrame([(t,) for t in every], "token string")).collect()
    assert len(rows) == len(every)
    for r in rows:
        name, n, p_random, p_ordinary = battery(r.token)
        assert (r.encoding, r.n) == (name, n)
        assert r.p_random == pytest.approx(p_random, abs=1e-6) and r.p_ordinary == pytest.approx(p_ordinary, abs=1e-6)


def test_discovery_limits_step_up(spark):
    rng = random.Random(6)
    rows = [(rng.choice([20, 32]), 10 ** -rng.uniform(0, 6) if rng.random() < .3 else rng.random()) for _ in range(400)]
    limits = secret_scan.discovery_limits(spark.createDataFrame(rows, "band int, p_ordinary double"), 0.05)
    for band in (20, 32):
        p = [v for b, v in rows if b == band]
        ends = sorted({10 ** (-min(400, math.floor(-math.log10(v) * 20)) / 20) for v in p})
        want = max((u for u in ends if u <= 0.05 * sum(10 ** (-math.floor(-math.log10(v) * 20) / 20) <= u for v in p) / len(p)), default=0.0)
        assert limits[band] == pytest.approx(want)


@pytest.mark.parametrize("n", [50_000, 1_000_000])
def test_long_tokens(spark, n):
    token = tokens(n, BASE64, n, n, 1)[0]
    rows = spark.createDataFrame([(1, f"see {token} there"), (2, "plain words"), (3, "a" * n)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.secret_query(rows).collect()}
    assert got == {1: f"random:4:{n + 4}", 2: "", 3: got[3]} and "random" not in got[3]
