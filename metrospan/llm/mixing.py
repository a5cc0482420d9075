"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.draws import uniform
from ..operators.ranks import ordered_rank
from .frames import stored

#: Fixed values of the mix: weights by rank of the source, share of all words, most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def fill(sources: DataFrame, budget: float, most: float = MOST) -> tuple[float, float]:
    """(words, weight) left to share once every source above ``most`` times its
    size has been set to that: rounds of one aggregate each over the sources
    (source_size, weight); a source set stays set, and the rounds end when no
    source is above."""
    cap, share_words, share_weight = F.col("source_size") * most, budget, None
    while True:
        weight = F.col("weight")
        over = F.lit(False) if share_weight is None else F.lit(share_words) * weight / F.lit(share_weight) >= cap
        r = sources.agg(F.sum(F.when(over, cap).otherwise(0.0)).alias("set"), F.sum(F.when(~over, weight)).alias("weight")).first()
        if r["weight"] is None:
            return 0.0, 1.0
        words, left = budget - (r["set"] or 0.0), float(r["weight"])
        if (words, left) == (share_words, share_weight):
            return words, left
        share_words, share_weight = words, left


def mix_sources(docs: DataFrame, columns: list[str], text: Column, source: Column, key: Column, seed: int = 0) -> DataFrame:
    """``columns`` with size, source_size, target, rate, copies of every row.

    Sources are ranked by code point, null last, and weigh 5, 2, 1 in turn.
    Rate is target over source size; a document has floor(rate) copies and one
    more with the probability of the fraction, drawn from a hash of the seed
    and the key, so that reruns agree and repeated rows get equal copies.  A
    source of no words has target, rate and copies 0.

    One pass counts words; from there on only (source, size, columns) move, and
    the sizes of a source are added up before they are shuffled.
    """
    sized = stored(docs.select(words_in(text).alias("ll_size"), source.alias("ll_source"), uniform(seed, key.cast("string")).alias("ll_draw"), *columns), "sized")
    sources = sized.groupBy("ll_source").agg(F.sum("ll_size").alias("source_size"))
    ranked = stored(ordered_rank(sources, [F.col("ll_source").asc_nulls_last()], out="ll_rank"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.col("ll_rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight)
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    words, left = fill(ranked, SHARE * total)
    target = F.least(F.lit(words) * F.col("weight") / F.lit(left), F.col("source_size") * MOST)
    targets = ranked.select(F.col("ll_source").alias("ll_name"), "source_size", target.alias("target"))
    rows = sized.join(targets, F.col("ll_source").eqNullSafe(F.col("ll_name")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + (F.col("ll_draw") < rate - F.floor(rate)).cast("long")
    return rows.select(*columns, F.col("ll_size").alias("size"), "source_size", "target", rate.alias("rate"), copies.alias("copies"))


def mixing_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, size, source_size, target, taken."""
    rows = mix_sources(docs, ["doc_id"], F.col("text"), F.col("source"), F.col("doc_id"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


MIXING_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap FROM sources),
ordered AS (
  SELECT *, sum(cap) OVER before AS caps, sum(weight) OVER (ORDER BY cap / weight DESC, source DESC NULLS FIRST) AS weights_left,
         (SELECT 1.5::DOUBLE * sum(source_size) FROM sources) AS budget
  FROM weighed WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT min(struct_pack(ratio := cap / weight, words := budget - coalesce(caps, 0), share := weights_left)) AS s
  FROM ordered WHERE (budget - coalesce(caps, 0)) / weights_left < cap / weight),
targets AS (
  SELECT source, source_size, least(coalesce((SELECT s.words * weight / s.share FROM level), cap), cap) AS target FROM weighed),
drawn AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         (CAST('0x' || substr(md5('0|' || CAST(s.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
