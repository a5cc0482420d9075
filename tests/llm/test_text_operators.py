"""The text operators against plain Python on a small, hostile table and on the smallest given tables."""
import hashlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from metrospan.llm import QUERIES, ORACLES, decontaminate, frames, importance, lang_id, line_dedup, mixing, quality_rules, secret_scan, simhash, url_filter, warc
import corpus_pipeline
import oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ll_text string, id long, copy string"


def prose(seed, n):
    rng = random.Random(seed)
    vowels = "aeiou" if seed % 2 else "öüäaei"
    return " ".join("".join(rng.choice("bcdfghklmnprst") + rng.choice(vowels) for _ in range(rng.randint(1, 3))) for _ in range(n))


def hostile():
    long = prose(3, 8_000)
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "", 4), (4, "x", "de", "a", 1), (5, "AKIA" + "Q" * 14, None, "b", 18),
        (6, long, "en", "a", None), (7, long, "en", "a", None), (8, long[:-3] + "zzz", "de", "c", None), (None, "null id", "en", "a", 7),
        (9, "password: token: abcdefghijklmnop", "en", None, 1), (10, "PassWord = 'abcdefghijkl' é password=short", "fr", "a", 1),
        (11, "deadbeefdeadbeef00 0123456789abcdef", "fr", "a", 1), (12, "A\u00e9\u2028B\x85C\x1cD " * 30, "fr", "z", 1),
        (13, "one two three one two three one two\nsame line here\n\nsame line here", "en", "z", 1),
        (14, "!!! ??? 123", "es", "z", 1), (15, "k9J2mQx7VbN4pL8sT1wZ6yR3cF5hG0dA9uE2iO7", None, "z", 1),
    ]
    rows += [(100 + k, prose(k, 20 + 3 * k), ["en", "de"][k % 2], f"s{k % 7}", None) for k in range(30)]
    base = "the first line of this text is long enough"
    rows += [(200 + k, f"{base[:k]}{base[k + 1:]}\n{prose(900 + k, 12)}\n{base}", "en", "s1", None) for k in range(1, 25, 3)]
    return [(*r, f"clash {k}", k, None) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return frames.stored(spark.createDataFrame(hostile(), SCHEMA), "hostile")


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1]) for r in hostile()]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + k, k % 2, 0) for k in range(30)] + [(100, 0, 1), (None, 1, 0), (101, None, None)], "doc_id long, quality int, toxic int")


def test_counts_match(spark, docs, labels, rows):
    got = {r["doc_id"]: r for r in quality_rules.quality_query(docs, labels).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        r = got[doc]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.rules(text), doc
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1


def test_classifier_held_out(spark):
    docs, labels = frames.read(spark, "/root/testdata/sf0.01", "documents"), frames.read(spark, "/root/testdata/sf0.01", "labels")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality_rules.quality_model(docs.where(fold == 0), labels)
    got = quality_rules.score_texts(docs.where(fold == 1), ["doc_id"], F.col("text"), model).withColumnRenamed("quality", "p").join(labels, "doc_id")
    right = got.where("not base_failed").select(F.avg(((F.col("p") >= 0.5) == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def test_classifier_without_answers(spark, docs, labels):
    for some in (labels.limit(0), labels.where("quality = 1")):
        got = quality_rules.quality_query(docs, some)
        assert got.where("kept <> (not base_failed)").count() == 0


def test_secret_base_spans(docs, rows):
    got = {r["doc_id"]: r for r in secret_scan.secret_query(docs).collect()}
    for doc, text in rows:
        spans = brute.base_spans(text)
        assert got[doc]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), (doc, spans, got[doc]["spans"])
        assert [s for s in got[doc]["spans"].split(",") if s and not s.startswith("random")] == spans
        assert (got[doc]["n_assign"], got[doc]["n_access"], got[doc]["n_hex"]) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))


def test_randomness_battery(spark):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(40)]
    prose = "thereportoftheseniorassistantmentionedthatthestatementsentearlierneededattention" * 2
    plain = [prose[k: k + 24 + k % 16] for k in range(40)] + ["zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in enumerate(keys + plain)], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secret_query(docs).collect()}
    found = [k for k, s in got.items() if s]
    assert sum(k < len(keys) for k in found) >= 36 and not [k for k in found if k >= len(keys)]
    assert got[found[0]] == f"random:7:{7 + 40}"


def test_many_matches(spark):
    text = "é" + " x ".join("AKIA" + "Z" * (14 + k % 3) for k in range(1500))
    got = secret_scan.secret_query(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["spans"] == ",".join(brute.base_spans(text)) and got["n_access"] == 1500


def test_fingerprints_and_components(docs, rows):
    got = simhash.simhash_query(docs).collect()
    prints = [(d, brute.fingerprint(t)) for d, t in rows]
    assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(d), f"{f:016x}") for d, f in prints)
    want = brute.near_groups(prints)
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for (d, _), c in zip(prints, want)}


@pytest.mark.parametrize("cell", [2, 32])
def test_links_against_all_pairs(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(cell)
    centres = [rng.getrandbits(64) for _ in range(20)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(15)} | {0, 1 << 63, (1 << 64) - 1, 3, 7}
    rows = [(k, p) for k, p in enumerate(sorted(prints))]
    df = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in rows], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(df).collect()}
    assert got == dict(enumerate(brute.near_groups(rows)))


def test_lines(spark, docs, rows):
    got = {r["doc_id"]: r for r in line_dedup.lines_query(docs).collect()}
    want = brute.dedup(rows)
    assert {d: (r["text"], r["n_removed"]) for d, r in got.items()} == want
    assert got[1]["n_lines"] == 0 and got[2]["n_lines"] == 1


def test_long_lines_within_one_edit(spark):
    long = prose(5, 4000)
    n = len(long)
    texts = [long, long[: n // 3] + "X" + long[n // 3:], long[: n // 2] + long[n // 2 + 1:], long[:700] + "Y" + long[701:], long[1:], long + "Z", long[:300] + "QQ" + long[302:], long[::-1]]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.lines_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.dedup(rows)


def test_repeated_document_rows_are_one(spark):
    df = spark.createDataFrame([(1, "a line that is long enough to count\nshort")] * 2 + [(2, "a line that is long enough to count")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_removed"]) for r in line_dedup.lines_query(df).collect())
    assert got == [(1, 0), (1, 0), (2, 1)]


def test_mixing(docs):
    got = {r["doc_id"]: r for r in mixing.mixing_query(docs).collect()}
    want = brute.mixing([(r[0], r[3], r[1]) for r in hostile()])
    for d, (size, source, target) in want.items():
        r = got[d]
        assert (r["size"], r["source_size"]) == (size, source) and abs(r["target"] - target) < 1e-6 and 0 <= r["taken"] <= 2 * size


def test_mixing_reaches_targets_and_repeats(spark):
    docs = frames.read(spark, "/root/testdata/sf0.01", "documents")
    one = mixing.mix_sources(docs, ["doc_id", "source"], F.col("text"), F.col("source"), F.col("doc_id")).cache()
    for r in one.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("t"), F.first("target").alias("w")).collect():
        assert abs(r["t"] - r["w"]) < 0.35 * r["w"]
    again = mixing.mix_sources(docs.repartition(5), ["doc_id", "source"], F.col("text"), F.col("source"), F.col("doc_id"))
    assert one.select("doc_id", "copies").exceptAll(again.select("doc_id", "copies")).count() == 0


def test_language_held_out(spark):
    docs = frames.read(spark, "/root/testdata/sf0.01", "documents")
    got = lang_id.language_query(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and n_scored >= 20")
    assert held.count() > 150 and held.where("lang_pred = lang").count() >= 0.97 * held.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, docs):
    got = {r["doc_id"]: r for r in lang_id.language_query(docs).collect()}
    assert len(got) == len(hostile())
    for doc, text in [(r[0], r[1]) for r in hostile()]:
        letters = any(c.isalpha() for c in text or "")
        assert (got[doc]["lang_pred"] == "und") == (not letters)
        if doc is not None:
            assert got[doc]["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2)
    nothing = lang_id.language_query(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


def test_model_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("abab abba baab", "x"), ("acca caac", "y")], "text string, lang string")
    for smoothing in ("kneser-ney", "witten-bell"):
        counts = lang_id.gram_counts(df, F.col("text"), F.col("lang"), 3, True)
        assert counts.agg(F.sum("n")).first()[0] == 15 + 10
        model = lang_id.build_models(lang_id.gram_weights(counts, 3, smoothing, 0.0), 3)
        import numpy as np
        a = ord("a")
        codes = np.arange(1 << 12, dtype=np.uint64) | np.uint64(a << 12 | ord("b") << 24)
        total = np.exp(model.log_probabilities(codes).astype(float)).sum(0)
        assert np.allclose(total, 1, atol=1e-3)


def test_long_text_codes_equal_whole_text():
    import numpy as np
    import pyarrow as pa
    from metrospan.llm import charlm
    text = prose(8, 3000) + "  !! " + prose(9, 50)
    for letters in (True, False):
        whole = charlm.gram_codes([text], 4, letters)[0]
        parts = np.concatenate([c for _, c, _ in charlm.gram_pieces(pa.array([text]), 4, letters, 1000)])
        assert (whole == parts).all()


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en", "http://a.example.com/en/", "http://com/", "http://notcom/", "http://x.net/es/a", "http://net/fr/",
            "http://x.net/en/a", "ftp://Ünï.Com/ß?", "http://a.com?x=/en/", "http://a.com#/en/", "x://y://z.com/a", "http://www.example.com/en/1\n2", "http://" + "a" * 5000 + ".com/"]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "http://b.com/q"), (3, "http://")]
    rows += [(100 + k, f"http://h{k}.com/page/{k}") for k in range(80)] + [(300 + k, f"http://h{k}.net/es/{k}") for k in range(80)] + [(500, "http://h.org/page/7"), (501, "http://h.org/es/7")]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"]): r for r in got}
    for page, url in rows:
        host, path, rule, verdict = brute.url_parts(url)
        assert (by[page]["host"], by[page]["path"], by[page]["rule"]) == (host, path, rule), url
        assert by[page]["verdict"] in ("allow", "block") and verdict in (None, by[page]["verdict"])
    assert by[500]["verdict"] == "allow" and by[501]["verdict"] == "block"


def test_warc(spark):
    big = "é" * 60
    inside = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    pages = [(5, "u", big), (3, "u\r\nX: y", big), (4, None, big), (6, "u", "x" * 99), (7, "u", "x" * 99), (8, "u", None), (9, "u", ""), (10, "u", inside * 3), (11, "u", "WARC/1.0\r\n"),
             (None, "u", big), (3, "again", big), (12, "u", "a\r\n\r\nWARC/1.0\r\n\r\n\r\n"), (13, "u", "y" * 100)]
    got = warc.warc_query(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute.warc([(a, c) for a, _, c in pages])))


def test_warc_chain(spark, tmp_path):
    import pyarrow as pa
    table = pa.table({"offset": [0, 5, 10, 12, 20, 30], "next": [10, 12, 20, 25, 30, 44]})
    assert warc._reachable(table)["offset"].to_pylist() == [0, 10, 20, 30]
    assert warc._reachable(table.slice(1)).num_rows == 0 and warc._reachable(table.slice(0, 0)).num_rows == 0


def test_resampling(spark):
    docs, labels = frames.read(spark, "/root/testdata/sf0.01", "documents"), frames.read(spark, "/root/testdata/sf0.01", "labels")
    got = importance.resample_query(docs, labels).collect()
    assert sum(r["sampled"] for r in got) == 500
    least = min(r["gumbel_key"] for r in got if r["sampled"])
    assert all((r["gumbel_key"] >= least) == r["sampled"] for r in got)
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    share = lambda q: (s := [r["sampled"] for r in got if quality.get(r["doc_id"]) == q]) and sum(s) / len(s)
    assert share(1) > 0.5 > 0.1 > share(0)


def test_kth_largest(spark):
    values = [0, -1, 5, 5, 7, -(1 << 63), (1 << 63) - 1, -300, 1 << 40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 3, 4, 5, 8, 9):
        assert importance.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, "v", 0) is None


def test_leaks(spark, docs):
    items = [(1, "A train travels 120 km in 2 hours, and Maria pays 15 dollars for the ticket to the old harbour."), (2, "too short"), (3, None), (None, "an item that has no identifier at all here"),
             (4, "the red fox sat on the low wall and looked at the moon"), (5, "the red fox sat on the low wall and looked at the moon")]
    texts = [(1, "Intro. A train travels 120 km in 2 hours, and Maria pays 15 dollars for the ticket to the old harbour. End"),
             (2, "so A train travels 340 miles in 5 days, and Peter pays 99 euros for the ticket to the old harbour and more"),
             (3, "a train was late and we paid for the ticket to the old harbour"), (4, None), (5, ""), (None, items[0][1]), (6, "THE RED FOX, sat on the low wall and looked at the moon!"),
             (7, "A train travels 7 km in 7 hours, and Maria pays 15 dollars for the ticket to the old harbour. " * 2), (7, "x")]
    frame = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, win int")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 4), (7, 1)}
    assert not got[1, 1]["reparameterised"] and got[2, 1]["reparameterised"] and got[7, 1]["reparameterised"] and got[1, 1]["coverage"] == 1


def test_inconsistent_slots(spark):
    item = "when Anna has 5 apples and Anna gives 5 apples to Ben then Anna counts 5 apples less than 5"
    docs = [(1, item.replace("Anna", "Eve").replace("5", "9")), (2, "when Eve has 1 apples and Tom gives 2 apples to Ben then Ann counts 3 apples less than 4")]
    frames_ = [spark.createDataFrame(r, s) for r, s in ((docs, "doc_id long, text string"), ([(1, item)], "item_id long, text string"))]
    assert [r["doc_id"] for r in decontaminate.contaminated(*frames_).collect()] == [1]


def test_leaks_in_given_tables(spark):
    docs, items = frames.read(spark, "/root/testdata/sf0.01", "documents"), frames.read(spark, "/root/testdata/sf0.01", "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == brute.leaks([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    problem, n = oracle.compare(oracle.connect(SF), QUERIES[name](spark, SF), ORACLES[name])
    assert problem is None and n > 0


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame([], SCHEMA)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    for df in (lang_id.language_query(docs), quality_rules.quality_query(docs, labels), secret_scan.secret_query(docs), decontaminate.contaminated(docs, items), importance.resample_query(docs, labels),
               url_filter.judge_urls(pages), warc.warc_query(pages), simhash.simhash_query(docs), line_dedup.lines_query(docs), mixing.mixing_query(docs)):
        assert df.count() == 0


def test_warc_long_urls(spark, tmp_path):
    pages = [(1, "http://a/x", "one"), (2, "data:" + "u" * 150_000, "two"), (3, "http://a/WARC/1.0", "WARC/1.0\r\n" * 30_000), (4, "http://b", "four")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    got = warc.warc_query(df).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute.warc([(a, c) for a, _, c in pages])))
    path = warc.write_archives(df, str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*"))
    for crc in (tmp_path / "w").glob(".part-*"):
        crc.unlink()
    part.write_bytes(part.read_bytes() + b"left over")
    with pytest.raises(Exception, match="records end at byte"):
        warc.read_archives(spark, path).collect()


def found_leaks(spark, texts, items):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}


def test_leaks_of_dense_and_short_items(spark):
    items = ["Compute 12 + 34 + 56 + 78 + 90 exactly.", "Is seven prime?", "Add 1, 2, 3, 4 and 5, then take 6, 7, 8 and 9 from the total of all", "42"]
    texts = [f"Before it. {items[0]} And after it.", "so is SEVEN prime", "we add 10, 20, 30, 40 and 50, then take 60, 70, 80 and 90 from the total of all of them",
             "Compute 12 + 34 + 56 + 78 + 91 exactly.", "seven is prime", "it is 42, they say", "the answer?\n42\nas they say", "One. 42! Two", " ".join(map(str, range(100, 3000)))]
    assert found_leaks(spark, texts, items) == {(0, 0), (1, 1), (2, 2), (6, 3), (7, 3)}


def test_one_word_items_need_a_line_or_sentence(spark):
    texts = [f"text number {k} says yes or no" for k in range(5)] + ["Yes", "Do you? Yes. I do", "yes\nand more", "say Yes\nnow"]
    assert found_leaks(spark, texts, ["Yes", "Very good"]) == {(5, 0), (6, 0), (7, 0)}


def test_leaks_with_text_ids(spark):
    item = "the red fox sat on the low wall and looked at the moon"
    docs = spark.createDataFrame([("a-1", f"so {item} again"), ("b", "nothing"), (None, item)], "doc_id string, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame([("x9", item)], "item_id string, text string")).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [("a-1", "x9")]


def test_pages_of_very_unequal_size(spark, tmp_path):
    pages = [(k, f"http://a/{k}", "p" * (10 if k % 9 else 3_000_000) + str(k)) for k in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = warc.write_archives(df, str(tmp_path / "w"))
    assert max(p.stat().st_size for p in (tmp_path / "w").glob("part-*")) <= 2 * warc.ARCHIVE_BYTES
    assert {(r["page_id"], r["payload_bytes"]) for r in warc.read_archives(spark, path).collect()} == {(k, len(h)) for k, _, h in pages}
    assert warc.warc_query(df.limit(0)).collect() == []


def test_resampling_takes_the_exact_share(spark):
    docs = spark.createDataFrame([(k, prose(k, 20), None, 1.0) for k in range(1000)] + [(5, prose(5, 20), "clash", 2.0), (None, None, None, None), (7000, "", None, 0.0)],
                                 "doc_id long, text string, ll_text string, log_weight double")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for share, want in ((0.0004, 1), (0.5, 502), (0.0, 0), (1.0, 1003)):
        got = importance.resample_query(docs, labels, share=share).where("sampled").count()
        assert want <= got <= want + 1  # repeated rows are sampled together


def test_importance_against_brute_force(spark):
    docs = spark.createDataFrame([(k, prose(k % 3 + 1, 6 + k)) for k in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample_query(docs, labels).collect()}
    want = brute.log_weights([tuple(r) for r in docs.collect()], {k for k in range(12) if k % 2})
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want), (got, want)


def test_leaks_with_names_that_open_sentences_or_change_case(spark):
    items = ["Tom has 5 apples. Tom buys 3 more. Tom gives 2 to Ann.", "Yesterday Maria walked to the harbour, and Maria saw a ship"]
    texts = [items[0].replace("Tom", "Eve"), items[0].upper(), items[0].lower(), items[1].upper(), items[1].lower(), items[1].replace("Maria", "Berta"),
             "yesterday we walked to the harbour"]
    assert found_leaks(spark, texts, items) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}
    assert found_leaks(spark, items, [t.lower() for t in items]) == {(0, 0), (1, 1)}


def test_only_window_sizes_of_the_items_are_made(spark):
    import pyarrow as pa
    items = spark.createDataFrame([(1, "the red fox sat on the low wall"), (2, "Is seven prime?")], "item_id long, text string")
    found, _ = decontaminate.benchmark_windows(items)
    assert {(r["id"], r["size"]) for r in found.collect()} == {(1, 5), (2, 3)}
    text = "plain words without names or numbers " * 50
    data, offsets = frames.text_buffers(pa.array([text, text]))
    made = [size for h, *_, size in decontaminate.template_windows(data, offsets, [5]) for _ in h]
    assert made == [5] * 2 * (300 - 4)


def test_words_of_any_length_hash_alike():
    import numpy as np
    words = ["a" * n for n in (1, 7, 8, 9, 16, 63, 64, 65, 200)] + ["ab", "ba", "a" * 64 + "b", "a" * 8 + "b"]
    text = (" ".join(words) + " " + " ".join(words).upper()).encode()
    data = np.frombuffer(text, np.uint8)
    values, _, number, _, _, inside = decontaminate.word_kinds(data, np.array([0, len(text)]))
    assert (values[: len(words)] == values[len(words):]).all() and len(set(values.tolist())) == len(words)
    spaced = np.frombuffer(b"One.       Two       three 1.5 .5 5a 2,", np.uint8)
    _, _, number, _, capital, inside = decontaminate.word_kinds(spaced, np.array([0, len(spaced)]))
    assert inside.tolist() == [False, False, True, True, False, True, True]  # a point before it opens a sentence
    assert number.tolist() == [False, False, False, True, True, False, True]
