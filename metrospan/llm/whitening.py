"""Whitening of embeddings with components of an exact characteristic polynomial."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .frames import batch_of, stored

#: Entries are multiples of 1 / SCALE; components that a vector gets.
SCALE, COMPONENTS = 256, 4
#: Entries are added up as digits of this many bits, so that products of digits stay exact in doubles.
_DIGIT = 20
#: Relative width, in bits, of the intervals around eigenvalues: nearer ones count as equal.
_ROOT_BITS = 256
_LARGEST = (1 << 63) - 1
_FULL = 1 << 62


def integer_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``ll_x``, the entries times SCALE rounded down, as longs;
    without rows whose vector is null or holds null, NaN or infinite entries.
    Vectors shorter than the longest are filled with zeros; products beyond
    the range of long are its ends."""
    finite = F.expr(f"forall(`{vector}`, c -> c IS NOT NULL AND abs(cast(c AS double)) < double('infinity'))")
    kept = rows.where(F.col(vector).isNotNull() & finite)
    c = f"{SCALE} * cast(c AS double)"
    x = F.expr(f"transform(`{vector}`, c -> CASE WHEN {c} >= {float(1 << 63)}D THEN {_LARGEST}L WHEN {c} <= {-float(1 << 63)}D THEN {-_LARGEST}L - 1L ELSE floor({c}) END)")
    size = kept.agg(F.max(F.size(vector))).first()[0] or 0
    return kept.withColumn("ll_x", x).withColumn("ll_x", F.when(F.size("ll_x") < size, F.concat("ll_x", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("ll_x")))).otherwise(F.col("ll_x")))


def _matrix(column) -> np.ndarray:
    """Rows of a list column of longs of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _digits(x: np.ndarray) -> list[np.ndarray]:
    """Signed digits of ``_DIGIT`` bits, lowest first, as doubles."""
    out, rest = [], x
    while rest.max(initial=0) >= 1 << _DIGIT or rest.min(initial=0) < -(1 << _DIGIT):
        out.append((rest & ((1 << _DIGIT) - 1)).astype(np.float64))
        rest = rest >> _DIGIT
    return out + [rest.astype(np.float64)]


def _sums(batches):
    """Exact sums of a task's vectors: (i, j, digit, total) of products, with i = -1 for plain sums and j = -1 for their number."""
    total: dict[tuple[int, int], int] = {}
    for batch in batches:
        whole = _matrix(batch.column(0))
        for a in range(0, len(whole), 4096):
            x = whole[a: a + 4096]
            parts = _digits(x) if x.size else []
            for d, p in enumerate(parts):
                _add(total, (-1, d), p.sum(0))
                for e, q in enumerate(parts):
                    _add(total, (0, d + e), p.T @ q)
            _add(total, (-2, 0), np.array([float(len(x))]))
    rows = []
    for (kind, digit), values in total.items():
        if kind == 0:
            i, j = np.triu_indices(values.shape[0])
            rows += zip(i.tolist(), j.tolist(), [digit] * len(i), values[i, j].tolist())
        else:
            rows += [(-1, -1 if kind == -2 else j, digit, v) for j, v in enumerate(values.tolist())]
    for a in range(0, len(rows), 8192):
        i, j, digit, value = zip(*rows[a: a + 8192])
        yield batch_of({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "digit": pa.array(digit, pa.int32()), "value": pa.array([str(v) for v in value])})


def _add(total: dict, key: tuple, values: np.ndarray) -> None:
    """Doubles that hold integers of less than 2**53 are added to Python integers."""
    values = values.astype(np.int64)
    if key in total:
        old = total[key]
        total[key] = old + values if old.dtype != object and np.abs(old).max(initial=0) < _FULL - (1 << 53) else old.astype(object) + values
    else:
        total[key] = values


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the integer scatter n * sum(x x^T) - S S^T of the
    distinct vectors ``fit`` (ll_x).  Each task adds up its own vectors exactly;
    the tasks' sums meet in one aggregate of d (d + 3) / 2 cells, which alone
    comes to the driver: its size depends on the dimension only."""
    cells = fit.select("ll_x").mapInArrow(_sums, "i int, j int, digit int, value string")
    sums: dict[tuple[int, int], int] = {}
    for r in cells.groupBy("i", "j", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect():
        sums[r["i"], r["j"]] = sums.get((r["i"], r["j"]), 0) + (int(r["value"]) << (_DIGIT * r["digit"]))
    n, d = sums.get((-1, -1), 0), sum(1 for i, j in sums if i == -1 and j >= 0)
    s = [sums[-1, j] for j in range(d)]
    return n, s, [[n * sums[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def primes_below(limit: int, product: int) -> list[int]:
    """Largest primes below ``limit`` (at most 2**31) whose product exceeds ``product``."""
    out, p, so_far = [], limit - 1 | 1, 1
    while so_far <= product:
        p -= 2
        if _strong(p):
            out.append(p)
            so_far *= p
    return out


def _strong(p: int) -> bool:
    """Strong pseudoprime test to bases that decide all numbers below 3.2e9."""
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in (2, 3, 5, 7):
        y = pow(b, odd, p)
        if y not in (1, p - 1) and not any((y := y * y % p) == p - 1 for _ in range(twos - 1)):
            return False
    return True


def polynomials_modulo(matrix: list[list[int]], primes: np.ndarray) -> np.ndarray:
    """Characteristic polynomial det(t I - matrix) modulo each of the primes
    (below 2**31), constant term first: Hessenberg form by similarity steps,
    then the recurrence of its leading minors, for all primes at once."""
    d, p = len(matrix), primes.astype(np.int64)
    h = np.array([[[v % q for v in row] for row in matrix] for q in p.tolist()], np.int64).reshape(len(p), d, d)
    m = p[:, None]
    every = np.arange(len(p))
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1:, k] != 0, axis=1)
        h[every, k + 1], h[every, pivot] = h[every, pivot], h[every, k + 1]
        column = h[every, :, k + 1].copy()
        h[every, :, k + 1] = h[every, :, pivot]
        h[every, :, pivot] = column
        inverse = np.array([pow(v, -1, q) if v else 0 for v, q in zip(h[:, k + 1, k].tolist(), p.tolist())], np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % m
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, None, k + 1] % m[:, :, None]) % m[:, :, None]
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % m[:, :, None]).sum(2)) % m
    poly = np.zeros((len(p), d + 1, d + 1), np.int64)  # of the leading minors
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((len(p), d + 1), np.int64)
        new[:, 1:] = poly[:, k - 1, :-1]
        new = (new - h[:, k - 1, k - 1, None] * poly[:, k - 1]) % m
        below = np.ones(len(p), np.int64)
        for i in range(k - 2, -1, -1):
            below = below * h[:, i + 1, i] % p
            new = (new - (h[:, i, k - 1] * below % p)[:, None] * poly[:, i]) % m
        poly[:, k] = new
    return poly[:, d]


def _remainders(group: pd.DataFrame) -> pd.DataFrame:
    """The coefficient, between -product / 2 and product / 2, with the given remainders."""
    value, product = 0, 1
    for q, r in zip(group["prime"].tolist(), group["remainder"].tolist()):
        value += (r - value) * pow(product, -1, q) % q * product
        product *= q
    value %= product
    return pd.DataFrame({"power": [int(group["power"].iloc[0])], "coefficient": [str(value - product if 2 * value > product else value)]})


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - matrix), constant term first, of a
    symmetric matrix without negative eigenvalues.

    The coefficient of t**(d - k) is at most C(d, k) * (trace / d)**k, which
    tells how many primes are enough.  Tasks find the polynomial modulo some
    primes each; the remainders of one coefficient meet in one group.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(math.comb(d, k) * (trace ** k) // (d ** k) + 1 for k in range(d + 1))
    primes = primes_below(1 << 31, 2 * bound)
    step = max(1, min(16, (1 << 21) // max(1, d * d)))

    def compute(batches):
        for batch in batches:
            own = batch.column(0).to_numpy()
            for a in range(0, len(own), step):
                found = polynomials_modulo(matrix, own[a: a + step])
                yield batch_of({"prime": np.repeat(own[a: a + step], d + 1), "power": np.tile(np.arange(d + 1, dtype=np.int32), len(found)), "remainder": found.ravel()})

    table = spark.createDataFrame(pd.DataFrame({"prime": primes}), "prime long").repartition(min(len(primes), spark.sparkContext.defaultParallelism))
    residues = table.mapInArrow(compute, "prime long, power int, remainder long")
    found = residues.groupBy("power").applyInPandas(_remainders, "power int, coefficient string").collect()
    return [int(r["coefficient"]) for r in sorted(found)]


def roots_above(polynomial: list[int], at: int, bits: int) -> int:
    """How many roots, each as often as it occurs, lie above at / 2**bits: the
    changes of sign of the polynomial moved there, which count exactly where
    all roots are real."""
    d = len(polynomial) - 1
    c = [v << (bits * (d - k)) for k, v in enumerate(polynomial)]  # of the variable times 2**bits
    for i in range(d):
        carry = c[d]
        for k in range(d - 1, i - 1, -1):
            carry = c[k] = c[k] + at * carry
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _value(polynomial: list[int], at: int, bits: int) -> int:
    """Of 2**(bits * degree) times the polynomial at at / 2**bits."""
    out, power = 0, 0
    for v in reversed(polynomial):
        out = out * at + (v << power)
        power += bits
    return out


def largest_roots(polynomial: list[int], many: int) -> list[tuple[int, int, int]]:
    """(root * 2**bits, bits, roots before it) of the ``many`` largest roots of
    a polynomial whose roots are all real and none negative, from the largest.

    Counts isolate an interval for each; a simple root is then narrowed by the
    sign of the value alone, others by counts, to _ROOT_BITS relative bits.
    Roots that stay together to that width share their value.
    """
    d = len(polynomial) - 1
    top = max(0, -polynomial[d - 1]).bit_length() if d else 0  # the sum of all roots bounds each
    out = []
    for k in range(1, min(many, d) + 1):
        low, high, bits = -1, 1 << top, 0  # the k-th largest root lies in (low, high] / 2**bits
        above_low, above_high = d, 0
        while high - low > 1 or 0 < high.bit_length() < _ROOT_BITS:
            if high - low == 1:
                low, high, bits = low * 2, high * 2, bits + 1
            middle = (low + high) // 2
            if above_low - above_high == 1:
                # One simple root: its side is that of the sign.
                value = _value(polynomial, middle, bits)
                over = value != 0 and (value > 0) == (above_low % 2 == 0)
                above = above_low if over else above_high
            else:
                above = roots_above(polynomial, middle, bits)
            if above >= k:
                low, above_low = middle, above
            else:
                high, above_high = middle, above
        out.append((max(0, high), bits, above_high))
    return out


def _solve(lower: list, rhs: list[list[int]], bits: int) -> list[list[int]]:
    """Solutions for the right-hand sides of a factored matrix, as fixed-point numbers."""
    steps, upper = lower
    d = len(upper)
    out = []
    for v in rhs:
        v = list(v)
        for k, (pivot, factors) in enumerate(steps):
            v[k], v[pivot] = v[pivot], v[k]
            head = v[k]
            for i, f in enumerate(factors, k + 1):
                v[i] -= f * head >> bits
        for k in range(d - 1, -1, -1):
            rest = v[k] - (sum(map(int.__mul__, upper[k][k + 1:], v[k + 1:])) >> bits)
            v[k] = (rest << bits) // upper[k][k]
        out.append(v)
    return out


def _factor(rows: list[list[int]], bits: int) -> tuple[list, list[list[int]]]:
    """Elimination with row exchanges in fixed point; a zero pivot becomes the least unit."""
    rows, steps = [list(r) for r in rows], []
    d = len(rows)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(rows[i][k]))
        rows[k], rows[pivot] = rows[pivot], rows[k]
        if rows[k][k] == 0:
            rows[k][k] = 1
        head, factors = rows[k], []
        for i in range(k + 1, d):
            f = (rows[i][k] << bits) // head[k]
            factors.append(f)
            if f:
                rows[i] = rows[i][: k + 1] + [a - (f * b >> bits) for a, b in zip(rows[i][k + 1:], head[k + 1:])]
        steps.append((pivot, factors))
    return steps, rows


def _orthonormal(vectors: list[list[int]], bits: int) -> list[list[int]]:
    out: list[list[int]] = []
    for v in vectors:
        for _ in range(2):
            for u in out:
                dot = sum(map(int.__mul__, u, v)) >> bits
                v = [a - (dot * b >> bits) for a, b in zip(v, u)]
        size = math.isqrt(sum(a * a for a in v))
        out.append([(a << bits) // size for a in v] if size else v)
    return out


def eigenvectors(matrix: list[list[int]], root: int, bits: int, many: int) -> np.ndarray:
    """``many`` orthonormal vectors of the null space of matrix - root / 2**bits,
    by inverse iteration in fixed point with more bits than the root has."""
    d = len(matrix)
    size = max(1, max(abs(v) for row in matrix for v in row).bit_length())
    work = 2 * (_ROOT_BITS + 64)
    shift = work - size  # the matrix with entries of about one
    scaled = [[(v << shift) if shift >= 0 else v >> -shift for v in row] for row in matrix]
    move = shift - bits
    own = root << move if move >= 0 else root >> -move
    for i in range(d):
        scaled[i][i] -= own
    factored = _factor(scaled, work)
    rng = np.random.default_rng(7)
    vectors = [[int(v) << (work - 30) for v in rng.integers(-(1 << 29), 1 << 29, d)] for _ in range(many)]
    for _ in range(3):
        vectors = _orthonormal(vectors, work)
        solved = _solve(factored, vectors, work)
        # To length about one again, before the exact norm.
        vectors = []
        for v in solved:
            over = max(map(abs, v)).bit_length() - work
            vectors.append([a >> over if over > 0 else a << -over for a in v])
    return np.array([[a / (1 << work) for a in v] for v in _orthonormal(vectors, work)])


def principal_components(spark: SparkSession, n: int, matrix: list[list[int]], many: int = COMPONENTS) -> list[tuple[float, float, np.ndarray]]:
    """(eigenvalue, explained share, unit vector) of the largest eigenvalues of
    the covariance matrix / n**2, from exact integers."""
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not matrix:
        return []
    found = largest_roots(characteristic_polynomial(spark, matrix), many)
    out: list[tuple[float, float, np.ndarray]] = []
    for k, (root, bits, before) in enumerate(found):
        if k and (root, bits) == found[k - 1][:2]:
            continue  # its vectors came with those of the first of equal roots
        many_equal = sum((r, b) == (root, bits) for r, b, _ in found)
        value = root / (n * n << bits) if root else 0.0
        for v in eigenvectors(matrix, root, bits, many_equal):
            out.append((value, root / (trace << bits) if trace else 0.0, v))
    return out


def whiten(rows: DataFrame, columns: list[str], vector: str, many: int = COMPONENTS) -> DataFrame:
    """``columns`` of each usable row with n, deviation (decimal), component
    from 1, whitened, explained and identity_error, one row per component.

    The fit list is each distinct integer vector once.  Rows without a usable
    vector are left out (``integer_vectors``); repeated rows get equal rows.
    There are as many components as dimensions at most.  A component whose
    eigenvalue is zero (too few distinct vectors) has null ``whitened``, and
    identity_error is over the others, null without any.  The driver holds the
    scatter, its polynomial and the components: sizes of the dimension.
    """
    spark = rows.sparkSession
    usable = integer_vectors(rows.select(*columns, vector), vector)
    fit = stored(usable.select("ll_x").distinct(), "vectors")
    n, sums, matrix = scatter(fit)
    parts = principal_components(spark, n, matrix, many)
    scored = _project(usable, columns, n, sums, parts)
    error = _identity_error(_project(fit, [], n, sums, parts), parts)
    each = F.explode(F.expr(f"sequence(1, {len(parts)})")) if parts else F.explode(F.array().cast("array<int>"))
    wide = scored.withColumn("component", each)
    at = F.col("component") - 1
    share = F.array(*[F.lit(float(p[1])) for p in parts]) if parts else F.array().cast("array<double>")
    return wide.select(*columns, "component", F.lit(n).cast("long").alias("n"), F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.get("whitened", at).alias("whitened"),
                       F.get(share, at).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _project(rows: DataFrame, columns: list[str], n: int, sums: list[int], parts: list) -> DataFrame:
    """``columns`` with deviation (text of the exact sum of (n x - S)**2) and whitened (an array)."""
    picked = rows.select("ll_x", *columns)
    basis = np.array([p[2] / (n * math.sqrt(p[0])) if p[0] > 0 else np.full(len(sums), np.nan) for p in parts]).reshape(len(parts), len(sums))
    zero = np.array([not p[0] > 0 for p in parts], bool)
    s = np.array(sums, dtype=object)
    most = max(map(abs, sums), default=0)

    def compute(batches):
        for batch in batches:
            whole = _matrix(batch.column(0))
            for a in range(0, len(whole), 4096):
                x = whole[a: a + 4096]
                largest = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + most
                exact = x * n - s.astype(np.int64) if largest < _FULL else x.astype(object) * n - s
                squares = (exact * exact).sum(1) if largest * largest * max(1, x.shape[1]) < _FULL else (exact.astype(object) ** 2).sum(1)
                white = exact.astype(np.float64) @ basis.T if len(parts) else np.zeros((len(x), 0))
                values = pa.array(white.ravel(), mask=np.tile(zero, len(x)))
                yield batch_of({c: batch.column(k + 1).slice(a, len(x)) for k, c in enumerate(columns)} | {
                    "deviation": pa.array([str(v) for v in squares.tolist()] if x.size else ["0"] * len(x)),
                    "whitened": pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(parts), values)})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[1:])
    return picked.mapInArrow(compute, f"{kinds}deviation string, whitened array<double>")


def _identity_error(fit: DataFrame, parts: list) -> float | None:
    """Largest absolute entry of the covariance of the fit list's whitened
    values minus the identity; covariances are centred as they are added up."""
    used = [k for k, p in enumerate(parts) if p[0] > 0]
    if not used:
        return None
    pairs = [(i, j) for i in used for j in used if i <= j]
    entry: list[Column] = [F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c_{i}_{j}") for i, j in pairs]
    found = fit.agg(*entry).first()
    return reduce(max, [abs(v - (i == j)) for (i, j), v in zip(pairs, found)])


def whitening_query(embeddings: DataFrame) -> DataFrame:
    """Every usable row of ``embeddings`` and component up to 4: vec_id,
    component, n, deviation (null where it is beyond long), whitened,
    explained, identity_error."""
    rows = whiten(embeddings, ["vec_id"], "embedding")
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
