"""Line deduplication across documents within one edit, in SQL expressions.

A line equal to, or one edit (a character put in, left out or replaced) away
from, a line that comes earlier is removed; earlier means by doc_id (null
first), then by text hash, then by line number.  Lines shorter than
``min_chars`` stay.

Deleting every single character of every line would cost the square of the
corpus' line lengths, so the deletion neighbourhood is emitted in three steps,
each of which only sees the lines that share something with another line:

1. Halves: lines within one edit have their first or their last q characters
   in common, q about half the length (the edit is in one half, the other is
   whole).  Only keys that different lines share go on.
2. Blocks: a line of length n is one of class n (the shorter or equal partner)
   and of class n - 1 (the longer partner).  For a class c it is cut into blocks
   of c / 2 (at most 256) characters; each key is the line without one block.
   Partners share the key of the block that holds the edit.
3. Characters: inside a shared block every single deletion is a key.  Partners
   of equal length share the remainder at the same place, a longer partner's
   remainder is the shorter partner's block.  Equal keys mean one edit; the
   edit distance is verified on the texts all the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranks import ordered_rank
from .frames import stored

MIN_CHARS, BLOCK = 20, 256
#: Bits of the fixed-size filters.
FILTER_BITS = 1 << 22


def _blocks(c: str) -> tuple[str, str]:
    """SQL of block length and number of blocks of class ``c``."""
    size = f"IF({c} < {2 * BLOCK}, cast(ceil({c} / 2) as int), {BLOCK})"
    return size, f"cast(ceil({c} / ({size})) as int)"


def _class_keys(c: str) -> str:
    """array<struct<key, c, i>>: the line without block i, for class ``c``."""
    size, many = _blocks(c)
    tail = f"greatest(0, {c} - (i + 1) * ({size}))"
    return (f"transform(sequence(0, {many} - 1), i -> struct(xxhash64({c}, i, left(line, i * ({size})), right(line, {tail})) as key, {c} as c, i as i))")


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, th, pos, line) of every line that takes part."""
    lines = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return lines.where((F.length("line") >= min_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _hashes() -> list[Column]:
    """Two hashes of a line: equal lines have both in common."""
    return [F.expr("xxhash64(line)").alias("h1"), F.expr("xxhash64(1, line)").alias("h2")]


def half_keys() -> Column:
    """First and last q characters, q = 8 floor(n / 16).  The longer partner of
    a pair also takes the q of the shorter one, where that differs."""
    def pair(q: str) -> str:
        return f"xxhash64(1, {q}, left(line, {q})), xxhash64(2, {q}, right(line, {q}))"
    q = "cast(length(line) div 16 * 8 as int)"
    return F.expr(f"IF(length(line) % 16 = 0, array({pair(q)}, {pair(f'({q} - 8)')}), array({pair(q)}))")


def bit_field(keys: DataFrame, key: str) -> Column:
    """Fixed-size bit field of a long column, as the one value of a subquery:
    says which lines may be among the keys, so that the others never move."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    word = (F.floor(place / 64)).cast("int")
    words = keys.groupBy(word.alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("bits"))
    every = keys.sparkSession.range(FILTER_BITS // 64).select(F.col("id").cast("int").alias("w"))
    dense = every.join(words, "w", "left").agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("l"))
    return stored(dense.select(F.col("l.bits").alias("field")), "field").select("field").scalar()


def may_hold(field: Column, key: Column) -> Column:
    at = F.floor(F.pmod(key, F.lit(FILTER_BITS)) / 64).cast("int")
    return F.getbit(F.get(field, at), F.pmod(key, F.lit(64)).cast("int")) == 1


def removed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, th, positions) of the lines to remove, one row per document with any."""
    lines = line_occurrences(docs, min_chars)
    seen = stored(lines.select("id", "th", "pos", *_hashes(), half_keys().alias("keys")), "lines")
    distinct = stored(seen.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "pos")).alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    # Keys that different lines share; equal lines are summed up before the shuffle.
    by_key = seen.select("h1", F.explode("keys").alias("key"))
    shared = stored(by_key.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key"), "shared")
    field = bit_field(shared, "key")
    maybe = seen.select("h1", "h2", F.explode("keys").alias("key")).where(may_hold(field, F.col("key")))
    suspects = maybe.join(shared, "key", "left_semi").select("h1", "h2").distinct()
    # Suspects are numbered in the order of their first occurrences; their text comes from there.
    places = stored(ordered_rank(suspects.join(distinct, ["h1", "h2"]), ["first"], out="no").select("h1", "h2", "first", "no"), "places")
    own = lines.select("id", "th", "pos", "line", *_hashes()[:1]).where(may_hold(bit_field(places, "h1"), F.col("h1"))).drop("h1")
    at = (F.col("id").eqNullSafe(F.col("first.id"))) & (F.col("th") == F.col("first.th")) & (F.col("pos") == F.col("first.pos"))
    # A row that repeats the first one gives the same line again.
    texts = stored(own.join(places.select("first", "no"), at).select("no", "line").dropDuplicates(["no"]), "texts")
    near = places.join(near_lines(texts), "no", "left_semi").select("h1", "h2", F.lit(True).alias("near"))
    # Occurrences of lines that are not unique, or have an earlier near line.
    verdict = distinct.join(near, ["h1", "h2"], "left").where("n > 1 or near")
    verdict = stored(verdict.select(F.col("h1").alias("v1"), F.col("h2").alias("v2"), "first", F.coalesce("near", F.lit(False)).alias("near")), "verdict")
    field = bit_field(verdict, "v1")
    hit = seen.select("id", "th", "pos", "h1", "h2").where(may_hold(field, F.col("h1"))).join(verdict, (F.col("h1") == F.col("v1")) & (F.col("h2") == F.col("v2")))
    gone = hit.where(F.col("near") | ~F.struct("id", "th", "pos").eqNullSafe(F.col("first")))
    return stored(gone.groupBy("id", "th").agg(F.collect_set("pos").alias("positions")), "gone")


def near_lines(texts: DataFrame) -> DataFrame:
    """(no) of the rows of (no, line) within one edit of a row of smaller number."""
    n = "length(line)"
    blocks = texts.select("no", "line", F.explode(F.expr(f"concat({_class_keys(n)}, {_class_keys(f'({n} - 1)')})")).alias("k")).select("no", "line", "k.key", "k.c", "k.i")
    shared = stored(blocks.groupBy("key").agg(F.min("no").alias("a"), F.max("no").alias("b")).where("a <> b").select("key"), "shared")
    size, _ = _blocks("c")
    body = blocks.join(shared, "key", "left_semi").withColumn("mid", F.expr(
        f"substr(line, i * ({size}) + 1, length(line) - i * ({size}) - greatest(0, c - (i + 1) * ({size})))"))
    # at >= 0: equal length, character deleted there; -1: the block itself; -2: deleted from the longer line.
    without = "transform(sequence(1, length(mid)), q -> struct(xxhash64(key, concat(left(mid, q - 1), substr(mid, q + 1))) as variant, {0} as at))"
    variants = F.expr(f"""IF(length(line) = c, concat(array(struct(xxhash64(key, mid) as variant, -1 as at)), {without.format("q")}), {without.format("-2")})""")
    rows = body.where("length(mid) > 0").select("no", F.explode(variants).alias("v")).select("no", "v.variant", "v.at")
    # Only different lines meet here: a variant has at most one row for each place and character.
    least = rows.groupBy("variant", "at").agg(F.min("no").alias("m"), F.count(F.lit(1)).alias("k"))
    least = stored(least.where("k > 1 or at < 0"), "variants")
    same = rows.where("at > 0").join(least.where("at > 0"), ["variant", "at"]).select("no", "m")
    whole, longer = (least.where(f"at = {k}").select("variant", "m") for k in (-1, -2))
    shorter = rows.where("at = -2").join(whole, "variant").select("no", "m")
    taller = rows.where("at = -1").join(longer, "variant").select("no", "m")
    best = same.union(shorter).union(taller).where("m < no").groupBy("no").agg(F.min("m").alias("m"))
    pairs = best.join(texts.withColumnRenamed("line", "own"), "no").join(texts.select(F.col("no").alias("m"), F.col("line").alias("other")), "m")
    return pairs.where(F.levenshtein("own", "other", 1) >= 0).select("no")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with ll_lines and ll_removed (counts) and ``text``
    without the removed lines.  Rows that share doc_id and text are the same
    document: their lines do not count as copies of each other.  Null text
    stays null with zero counts; other columns are untouched."""
    names = docs.columns
    gone = removed_lines(docs.select("doc_id", "text"), min_chars)
    rows = docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)])
    text, ident = F.col(f"in_{names.index('text')}"), F.col(f"in_{names.index('doc_id')}")
    rows = rows.join(gone, ident.eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("th")), "left")
    lines = F.split(text, "\n", -1)
    flags = F.map_from_arrays(F.col("positions"), F.transform("positions", lambda p: F.lit(True)))
    left = F.filter(F.transform(lines, lambda line, i: F.when(flags[i].isNull(), line)), lambda line: line.isNotNull())
    out = {c: F.col(f"in_{k}") for k, c in enumerate(names)}
    out["text"] = F.when(F.col("positions").isNull(), text).otherwise(F.array_join(left, "\n"))
    return rows.select(*[v.alias(k) for k, v in out.items()], F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("ll_lines"),
                       F.coalesce(F.when(F.col("positions").isNotNull(), F.size("positions")), F.lit(0)).cast("long").alias("ll_removed"))


def lines_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n_lines, n_removed, text."""
    return dedup_lines(docs.select("doc_id", "text")).select("doc_id", F.col("ll_lines").alias("n_lines"), F.col("ll_removed").alias("n_removed"), "text")


def lines_stage(docs: DataFrame) -> DataFrame:
    """Documents with their text deduplicated (n_chars, where there is such a
    column, follows it).  A document that loses lines and has no word left is a
    copy as a whole and goes; null, empty and blank documents stay."""
    rows = dedup_lines(docs)
    kept = rows.where((F.col("ll_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("ll_removed") > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


LINES_SQL = rf"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
occ AS (
  SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM raw),
part AS (
  SELECT * FROM occ WHERE length(line) >= {MIN_CHARS} AND regexp_matches(line, '[^\x20\x09-\x0D]')),
uniq AS (
  SELECT line, min(struct_pack(doc_id := doc_id, pos := pos)) AS first, count(*) AS n, length(line) AS len FROM part GROUP BY line),
halves AS (
  SELECT line, first, len, c, CAST(ceil(c / 2) AS BIGINT) AS h FROM (SELECT *, len AS c FROM uniq UNION ALL SELECT *, len - 1 AS c FROM uniq)),
keyed AS (
  SELECT line, first, len, c, 'p' || left(line, h) AS k FROM halves UNION ALL
  SELECT line, first, len, c, 's' || right(line, c - h) AS k FROM halves),
near AS (
  SELECT a.line, min(b.first) AS early FROM keyed a JOIN keyed b ON a.c = b.c AND a.k = b.k AND a.line <> b.line
  WHERE abs(a.len - b.len) <= 1 AND b.first < a.first AND len(list_filter(range(0, greatest(a.len, b.len)), lambda q: left(a.line, q) = left(b.line, q)
        AND substr(a.line, q + 1 + CASE WHEN a.len >= b.len THEN 1 ELSE 0 END) = substr(b.line, q + 1 + CASE WHEN b.len >= a.len THEN 1 ELSE 0 END))) > 0
  GROUP BY a.line),
gone AS (
  SELECT p.doc_id, p.pos FROM part p JOIN uniq u USING (line) LEFT JOIN near n USING (line)
  WHERE n.early IS NOT NULL OR struct_pack(doc_id := p.doc_id, pos := p.pos) <> u.first),
kept AS (
  SELECT o.doc_id, string_agg(o.line, chr(10) ORDER BY o.pos) AS text FROM occ o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.pos = g.pos
  WHERE g.pos IS NULL GROUP BY o.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN counts c ON d.doc_id = c.doc_id
"""
