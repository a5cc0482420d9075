"""Secret scan in SQL expressions: fixed patterns and a battery of randomness tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import stored

#: Kind, pattern, group whose length counts, least length.
PATTERNS = [
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Every text with a passing match also matches this cheaper pattern.
_NEEDED = {"assign": r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""", "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}"}
TOKEN, TOKEN_LENGTH = r"[A-Za-z0-9+/_-]{20,}={0,2}", 20

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Alphabets from small to large: name, pattern of whole tokens, symbols, and the chance that two
#: characters of an ordinary (not random) string over it are equal: letters of prose repeat with
#: about 0.066, numerals with 0.1.
ENCODINGS = [
    ("hex", "[0-9a-f]*", _DIGITS + _LOWER[:6], 0.1), ("hex_upper", "[0-9A-F]*", _DIGITS + _LOWER[:6].upper(), 0.1),
    ("lower", "[a-z]*", _LOWER, 0.066), ("upper", "[A-Z]*", _LOWER.upper(), 0.066),
    ("base32", "[A-Z2-7]*", _LOWER.upper() + "234567", 0.066), ("base36", "[a-z0-9]*", _LOWER + _DIGITS, 0.066),
    ("base62", "[A-Za-z0-9]*", _LOWER.upper() + _LOWER + _DIGITS, 0.06),
    ("base64", "[A-Za-z0-9+/]*", _LOWER.upper() + _LOWER + _DIGITS + "+/", 0.06),
    ("base64url", "[A-Za-z0-9_-]*", _LOWER.upper() + _LOWER + _DIGITS + "-_", 0.06),
    ("mixed", ".*", _LOWER.upper() + _LOWER + _DIGITS + "+/-_", 0.06),
]
#: Lower ends of the length bands within which false discoveries are controlled.
BANDS = [20, 24, 32, 48, 64]
_STEPS, _BINS = 20, 400
_BLOCK = 512


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def match_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, end, token>> of the leftmost matches that do not
    overlap, in code points, without those whose group is shorter than ``least``.

    Splitting at the pattern gives the pieces between the matches; starts are
    running sums of their lengths, added up in blocks so that a text with very
    many matches costs little more than its length.
    """
    p = _sql(pattern)
    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.expr(f"regexp_extract_all(ll_text, {p}, 0)").alias("found"),
                    F.expr(f"regexp_extract_all(ll_text, {p}, {group})").alias("part"))

    def starts(x: Column) -> Column:
        moved = F.transform(x["found"], lambda m, i: F.length(m) + F.length(F.get(x["pieces"], i)))
        return F.transform(F.array(moved), lambda adv: _spans(x, adv, least))[0]

    return F.transform(F.array(both), starts)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _spans(x: Column, adv: Column, least: int) -> Column:
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(adv) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(adv, b * _BLOCK + 1, F.lit(_BLOCK))))

    def span(sums: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            start = _total(F.slice(sums, F.lit(1), block)) + _total(F.slice(adv, block * _BLOCK + 1, i % _BLOCK)) + F.length(F.get(x["pieces"], i))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("token"), F.length(F.get(x["part"], i)).alias("n"))
        return F.filter(F.transform(x["found"], one), lambda s: s["n"] >= least)

    return F.when(F.size(adv) > 0, F.transform(F.array(blocks), span)[0]).otherwise(F.filter(F.transform(x["found"], lambda m: F.struct(
        F.lit(0).alias("start"), F.lit(0).alias("end"), m.alias("token"), F.lit(0).alias("n"))), lambda s: F.lit(False)))


def _phi(z: str) -> str:
    """SQL of the normal distribution function: the rational approximation of
    Abramowitz and Stegun 26.2.17 (error below 1e-7), floored for logarithms."""
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-{z} * {z} / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"greatest(1e-20, CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END)"


def test_tokens(tokens: DataFrame) -> DataFrame:
    """Adds to rows with ``token``: encoding, n, p_random and p_ordinary.

    The smallest fitting alphabet of k symbols is the encoding.  Three tests
    ask whether the symbols are uniform draws: chi-squared of the counts (exact
    mean and variance for short strings), runs above and below the middle of
    the alphabet, and lag-one serial correlation of the symbol numbers;
    p_random is the Bonferroni combination.  Sums are doubles, so that a token
    may have any length; its characters are split once.  p_ordinary is the chance that an
    ordinary string of the same length has a chi-squared as low as this one.
    """
    name, symbols, repeat = F.lit(None).cast("string"), F.lit(""), F.lit(0.0)
    body = F.regexp_replace("token", "=+$", "")
    for label, pattern, alphabet, chance in reversed(ENCODINGS):
        fits = body.rlike(f"^{pattern}$")
        name, symbols, repeat = F.when(fits, label).otherwise(name), F.when(fits, alphabet).otherwise(symbols), F.when(fits, chance).otherwise(repeat)
    rows = tokens.withColumns({"encoding": name, "ll_alphabet": symbols, "ll_repeat": repeat, "ll_body": body})
    rows = rows.withColumns({"n": F.length("ll_body").cast("double"), "ll_k": F.length("ll_alphabet").cast("double"),
                             "ll_s": F.expr("transform(filter(split(ll_body, ''), c -> c <> ''), c -> instr(ll_alphabet, c))")})
    rows = rows.withColumns({
        "ll_squares": F.expr("aggregate(sequence(1, length(ll_alphabet)), 0D, (a, j) -> a + pow(size(filter(ll_s, s -> s = j)), 2))"),
        "ll_high": F.expr("aggregate(ll_s, 0D, (a, s) -> a + IF(s > ll_k / 2, 1, 0))"),
        "ll_runs": F.expr("aggregate(sequence(2, size(ll_s)), 1D, (a, i) -> a + IF((ll_s[i - 1] > ll_k / 2) = (ll_s[i - 2] > ll_k / 2), 0, 1))"),
        "ll_mean": F.expr("aggregate(ll_s, 0D, (a, s) -> a + s) / n")})
    rows = rows.withColumns({
        "ll_chi": F.expr("ll_k / n * ll_squares - n"),
        "ll_serial": F.expr("aggregate(sequence(2, size(ll_s)), 0D, (a, i) -> a + (ll_s[i - 1] - ll_mean) * (ll_s[i - 2] - ll_mean)) / greatest(1e-9, aggregate(ll_s, 0D, (a, s) -> a + (s - ll_mean) * (s - ll_mean)))"),
        "ll_even": F.expr("2 * ll_high * (n - ll_high)")})
    rows = rows.withColumns({
        "ll_z1": F.expr("(ll_chi - (ll_k - 1)) / sqrt(2 * (ll_k - 1) * (n - 1) / n)"),
        "ll_z2": F.expr("CASE WHEN ll_even = 0 THEN 40D ELSE abs(ll_runs - 1 - ll_even / n) / sqrt(greatest(1e-9, ll_even * (ll_even - n) / (n * n * (n - 1D)))) END"),
        "ll_z3": F.expr("abs(ll_serial + 1D / n) * sqrt(n)"),
        "ll_z0": F.expr("(ll_chi - (ll_k * (1 + (n - 1) * ll_repeat) - n)) / sqrt(2 * (ll_k - 1) * (n - 1) / n + 4 * n * (ll_k * ll_repeat - 1))")})
    rows = rows.withColumn("p_random", F.expr(f"least(1D, 3 * least({_phi('(-ll_z1)')}, 2 * {_phi('(-ll_z2)')}, 2 * {_phi('(-ll_z3)')}))"))
    return rows.withColumns({"p_ordinary": F.expr(_phi("ll_z0")), "n": F.col("n").cast("int")}).drop(*[c for c in rows.columns if c.startswith("ll_")])


def discovery_limits(tests: DataFrame, rate: float = 0.05) -> dict[int, float]:
    """Per length band the largest p_ordinary that keeps the expected share of
    ordinary strings among the discoveries below ``rate`` (step-up procedure).
    p values are counted in fixed bins of 1/20 decade, never sorted."""
    bin_no = F.least(F.lit(_BINS), F.floor(-F.log10("p_ordinary") * _STEPS)).cast("int")
    counts: dict[int, dict[int, int]] = {}
    for r in tests.groupBy("band", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["band"], {})[r["bin"]] = r["n"]
    limits = {}
    for band, bins in counts.items():
        total, seen, limits[band] = sum(bins.values()), 0, 0.0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            upper = 10 ** (-b / _STEPS)
            if upper <= rate * seen / total:
                limits[band] = upper
    return limits


def scan(docs: DataFrame, key: str = "doc_id", min_random: float = 0.01, rate: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: key, base and added spans.

    Columns: ``base`` array<struct<start, kind_no, end>> of the fixed patterns
    and ``added`` of tokens that pass the battery and the discovery limit of
    their length band and do not overlap a base span.  Null text is empty.
    Texts are read once; spans without text are stored, tested and joined to
    nothing: each row keeps its own arrays.
    """
    rows = docs.select(F.col(key).alias("ll_key"), F.coalesce("text", F.lit("")).alias("ll_text"))
    text, none = F.col("ll_text"), F.expr("cast(array() as array<struct<start: int, end: int, token: string, n: int>>)")
    found = {kind: F.when(text.rlike(_NEEDED[kind]), match_spans(text, pattern, group, least)).otherwise(none) for kind, pattern, group, least in PATTERNS}
    found["token"] = F.when(text.rlike(TOKEN), match_spans(text, TOKEN, 0, TOKEN_LENGTH)).otherwise(none)
    spans = rows.select("ll_key", *[v.alias(k) for k, v in found.items()])
    numbered = [_numbered(kind, no) for no, (kind, *_) in enumerate(PATTERNS)]
    spans = spans.select("ll_key", F.array_sort(F.concat(*numbered)).alias("base"), "token")
    free = F.filter("token", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    spans = stored(spans.select("ll_key", "base", free.alias("token")), "spans")
    # An own number per row: the stored files do not change, so neither do the numbers.
    spans = stored(spans.withColumn("row_no", F.monotonically_increasing_id()), "spans")
    tokens = spans.select("row_no", F.explode("token").alias("t")).select("row_no", "t.start", "t.end", "t.token")
    band = F.lit(BANDS[0])
    for low in BANDS[1:]:
        band = F.when(F.col("n") >= low, low).otherwise(band)
    tested = stored(test_tokens(tokens).withColumn("band", band).drop("token"), "tests")
    limits = discovery_limits(tested, rate)
    limit = F.lit(-1.0)
    for low, most in limits.items():
        limit = F.when(F.col("band") == low, most).otherwise(limit)
    kept = tested.where((F.col("p_random") >= min_random) & (F.col("p_ordinary") <= limit))
    added = kept.groupBy("row_no").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(len(PATTERNS)).alias("kind_no"), "end"))).alias("added"))
    empty = F.expr("cast(array() as array<struct<start: int, kind_no: int, end: int>>)")
    return spans.join(added, "row_no", "left").select(F.col("ll_key").alias(key), "base", F.coalesce("added", empty).alias("added"))


def _numbered(kind: str, no: int) -> Column:
    return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("kind_no"), s["end"].alias("end")))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(p[0]) for p in PATTERNS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"], s["end"])), ",")


def secret_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.
    Repeated rows get equal results; null and empty texts have no spans."""
    rows = scan(docs)
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind_no = {no})) as bigint)").alias(f"n_{kind}") for no, (kind, *_) in enumerate(PATTERNS)]
    return rows.select("doc_id", *counts, F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                       span_text(F.array_sort(F.concat("base", "added"))).alias("spans"))
