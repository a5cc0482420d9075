"""The corpus pipeline: every stage on a hostile table, all stages on given tables."""
import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrospan.llm import decontaminate, frames, quality_rules, simhash
from test_text_operators import SCHEMA, hostile, prose

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return frames.stored(spark.createDataFrame(hostile(), SCHEMA), "hostile")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_hostile_rows(spark, docs, name, stage):
    got = stage(spark, docs, SF)
    assert got.columns[: len(docs.columns)] == docs.columns and (name == "mixing" or got.schema.names == docs.schema.names)
    n = got.count()
    assert n > 0 and stage(spark, docs.limit(0), SF).count() == 0
    if name != "mixing":
        assert n <= docs.count()


def test_stage_keeps_columns_and_rows(spark, docs):
    rows = docs.collect()
    kept = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    prints = [(r["doc_id"], brute.fingerprint(r["text"])) for r in rows]
    stay = [r["doc_id"] for r, c in zip(rows, brute.near_groups(prints)) if r["doc_id"] == c]
    assert sorted(map(str, (r["doc_id"] for r in kept["near_duplicates"]))) == sorted(map(str, stay))
    want = {d: t for d, (t, gone) in brute.dedup([(r["doc_id"], r["text"]) for r in rows]).items() if not gone or brute.words(t)}
    assert {r["doc_id"]: r["text"] for r in kept["line_dedup"]} == want
    assert all(r["ll_text"].startswith("clash") for r in kept["line_dedup"])
    assert {r["doc_id"] for r in kept["quality_rules"]} <= {r["doc_id"] for r in rows if not brute.rules(r["text"])[-1]}
    assert len(kept["decontamination"]) == len(rows)


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    before = frames.read(spark, SF, "documents")
    labels = frames.read(spark, SF, "labels")
    good = quality_rules.quality_query(before, labels).where("kept").select("doc_id")
    assert got.select("doc_id").distinct().join(good, "doc_id", "left_anti").count() == 0
    items = [tuple(r) for r in frames.read(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert not brute.leaks([tuple(r) for r in got.select("doc_id", "text").distinct().collect()], items)
    texts = [(r["doc_id"], r["text"]) for r in got.select("doc_id", "text").distinct().collect()]
    prints = [(d, brute.fingerprint(t)) for d, t in texts]
    assert all(c == d for (d, _), c in zip(prints, brute.near_groups(prints)))
    assert got.groupBy("doc_id").agg(F.max("copy").alias("m"), F.count("*").alias("n")).where("m <> n or n > 2").count() == 0


def _shingles(text, size=5):
    w = brute.words(text.lower())
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}


def test_near_copies_of_five_word_shingles_go(spark):
    base = prose(4001, 120).split()
    copies = [base] + [base[:at] + ["changed"] + base[at + 1:] for at in (0, 30, 60, 90, 119)] + [base[:40] + ["put", "in"] + base[40:]]
    groups = [copies, [w[::-1] for w in (base, base[:-2])], [base[:60] + prose(4003, 60).split()]]
    rows = [(10 * g + k, " ".join(w)) for g, group in enumerate(groups) for k, w in enumerate(group)]
    got = simhash.simhash_stage(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {d: _shingles(t) for d, t in rows}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    kept = sorted(r["doc_id"] for r in got.collect())
    assert kept == [0, 10, 20] and all(any(near(d, k) for k in kept) for d in sets)
    bits = [brute.fingerprint(t) for _, t in rows]
    assert sum((bits[0] ^ b).bit_count() > 2 for b in bits[1:7]) > 2


def test_near_copies_of_given_documents(spark):
    docs = frames.read(spark, SF, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if r["text"]]
    kept = {r["doc_id"] for r in simhash.simhash_stage(docs).select("doc_id").collect()}
    sets = [(d, s) for d, t in rows if d in kept and (s := _shingles(t))]
    held = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            held.setdefault(x, []).append(k)
    close = {(a, b) for at in held.values() for a in at for b in at if a < b}
    assert not [(sets[a][0], sets[b][0]) for a, b in close if len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1])]


def test_rows_without_id_are_judged_one_by_one(spark):
    a, b, c = (prose(k, 60) for k in (5001, 5003, 5005))
    rows = [(None, a), (None, a), (None, b), (7, b), (9, c), (3, a[::-1]), (9, a[::-1])]
    got = simhash.simhash_stage(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, a), (7, b), (9, c), (3, a[::-1])]))


def test_contaminated_rows_without_id_go(spark):
    item = "the red fox sat on the low wall and looked at the moon"
    rows = [(None, f"so {item} again"), (None, "nothing of it"), (1, item), (1, "other text of one"), (2, "clean")]
    got = decontaminate.decontamination_stage(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, rows[1:2] + rows[3:]))
