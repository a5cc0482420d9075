import pytest
from pyspark.sql import functions as F

from frames_help import rows
from metrospan.functions import rules as R
from metrospan.functions.units import to_si, to_si_status
from metrospan.operators import contracts as C
from metrospan.operators import joins as J


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize("text,ok", [("0.5", True), (" .5 ", True), ("5e-1", True), ("1.", True), ("0", False), ("-1", False),
                                     ("0.5 um", False), ("True", False), ("1,5", False), ("1_0", False), ("nan", False), ("", False), (None, False)])
def test_decimal_text(spark, text, ok):
    assert one(spark, R.is_decimal_text(F.lit(text).cast("string"))) is ok


@pytest.mark.parametrize("value,text", [(65.0, "65"), (10.5, "10.5"), (0.0001, "0.0001"), (1.25e-5, "1.25e-05"), (1234567.0, "1.23457e+06"),
                                        (100000.0, "100000"), (0.0, "0"), (-2.5, "-2.5"), (23.030000000000001, "23.03")])
def test_general_number(spark, value, text):
    assert one(spark, R.general_number(F.lit(value))) == text == f"{value:g}"


def test_condition_key(spark):
    assert one(spark, R.condition_key(F.lit(65.0), F.lit(12.5), F.lit("mass_pct"))) == "65C_G12.5_mass_pct"


@pytest.mark.parametrize("name,kind,field,want", [
    ("R03_C2_T07_Top.TIF", "trench", "run_id", "R03"), ("r123_c2_t7_bot.tiff", "trench", "run_id", "R123"),
    ("R03_C2_T07_Top.TIF", "trench", "slot", 7), ("CAL_65.5C_G10_Glass_30min.tif", "flat", "t_min", 30.0),
    ("CAL_65.5C_G10_Glass_30min.tif", "flat", "substrate", "glass"), ("REF_S1.tif", "REF", "session_id", "S1"),
    ("dark_S 2.tiff", "DARK", "session_id", "S 2"), ("R3_C2_T7_top.tif", None, "run_id", None), ("x.png", None, "kind", None)])
def test_capture_names(spark, name, kind, field, want):
    got = one(spark, R.parse_capture_name(F.lit(name)))
    assert got["kind"] == kind and got[field] == want


def test_paths_dates_tolerance(spark):
    paths = {"a/b.tif": True, "/a": False, "../a": False, "a/../b": False, "a..b/c": True, "C:\\x": False}
    for p, ok in paths.items():
        assert one(spark, R.is_contained_path(F.lit(p))) is ok
    assert one(spark, R.is_iso_date(F.lit("2024-02-30"))) is False
    # The tolerance follows the second value only.
    assert one(spark, R.within(F.lit(1.0), F.lit(101.0), 1.0, 0.0)) is True
    assert one(spark, R.within(F.lit(101.0), F.lit(1.0), 1.0, 0.0)) is False


def test_units(spark):
    d = spark.createDataFrame([(1.0, "um"), (2.0, "h"), (25.0, "C"), (-300.0, "C"), (1.0, "furlong"), (float("nan"), "m")], "v double, u string")
    got = [(r.si, r.s) for r in d.select(to_si("v", "u").alias("si"), to_si_status("v", "u").alias("s")).collect()]
    assert got == [(1e-6, "ok"), (7200.0, "ok"), (298.15, "ok"), (None, "below_absolute_zero"), (None, "unknown_unit"), (None, "nonfinite")]


def test_row_rules_and_raise(spark):
    d = spark.createDataFrame([("a", 1.0), ("b", float("inf")), ("c", None)], "k string, v double")
    r = C.row_rules(d, {"finite": ("v", ~R.is_finite("v"))}, "k")
    assert rows(r, "rule", "n_bad", "example") == [("finite", 2, "b")]
    with pytest.raises(C.ContractViolation, match="finite"):
        C.raise_on_violation(r)
    with pytest.raises(C.ContractViolation, match="missing columns"):
        C.require_columns(d, ["k", "z"])
    with pytest.raises(C.ContractViolation, match="empty"):
        C.require_columns(d.limit(0), ["k"])


def test_unique_dependency_required(spark):
    d = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, g int")
    assert rows(C.unique_rule(d, ["k"]), "n_bad") == [(2,)]
    e = spark.createDataFrame([("i", "x"), ("i", "y"), ("j", "x")], "k string, g string")
    assert rows(C.functional_dependency(e, "k", "g"), "n_bad", "example") == [(1, "i")]
    c = C.required_categories(spark.createDataFrame([(1, "glass"), (1, "glass"), (2, "pdms")], "g int, s string"), ["g"], "s", ["glass", "pdms"])
    assert rows(c, "g", "missing", "repeated") == [(1, "pdms", "glass"), (2, "glass", "")]


def test_exactly_one_and_optional(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    d = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "k string, v int")
    j = J.exactly_one(f, d, ["k"], ["v"])
    assert rows(j, "id", "match_status") == [(1, "ok"), (2, "ambiguous"), (3, "missing"), (4, "no_key")]
    o = J.optional_match(f, d, "k", "k", ["v"])
    assert rows(o, "id", "label_status") == [(1, "ok"), (2, "ambiguous_label"), (3, "missing_label"), (4, "unlabelled")]


def test_stale_leakage_circularity(spark):
    a = spark.createDataFrame([("x", 1.0, None), ("y", 2.0, "h"), ("z", 3.0, "h")], "k string, v double, h string")
    b = spark.createDataFrame([("x", 1.0 + 1e-13, None), ("y", 2.1, "H")], "k string, v double, h string")
    s = J.stale_rows(a, b, "k", ["h"], ["v"])
    assert rows(s, "k", "status", "fields") == [("x", "ok", ""), ("y", "stale", "h,v"), ("z", "not_current", "")]
    d = spark.createDataFrame([("i", "s1", "train"), ("j", "s1", "test"), ("k", "s2", "test")], "image string, specimen string, role string")
    assert rows(J.leakage_audit(d, ["image", "specimen"], "role"), "key", "n_leaked", "example") == [("image", 0, None), ("specimen", 1, "s1")]
    cal = spark.createDataFrame([("p1|p2",), ("p3",)], "ids string")
    ev = spark.createDataFrame([("p2", "q"), ("r", None)], "top string, bot string")
    assert rows(J.shared_ids(cal, "ids", ev, ["top", "bot"]), "id") == [("p2",)]


def test_acquisition_faults(spark):
    good = dict(session_id="S", exposure_ms=1.0, gain=1.0, illumination_id="L", magnification=20.0, bit_depth=12, auto_exposure="FALSE",
                gamma=1.0, white_balance="fixed", color_channel="mono")
    for change, fault in [({}, None), ({"gain": -1.0}, "invalid_gain"), ({"gamma": 2.2}, "gamma_not_one"), ({"auto_exposure": "1"}, "auto_exposure_on"),
                          ({"bit_depth": 10}, "bit_depth"), ({"illumination_id": " "}, "missing_illumination_id"), ({"white_balance": "auto"}, "white_balance_not_fixed")]:
        row = spark.createDataFrame([{**good, **change}])
        bad = [k for k, v in row.select(*[v.alias(k) for k, v in R.acquisition_faults().items()]).first().asDict().items() if v]
        assert bad == ([fault] if fault else [])


def test_capture_names_of_long_ids_keep_every_digit(spark, tmp_path):
    import __spark_entry__ as entry
    import oracle
    spark.createDataFrame([(7, "http://a/fr/x", ""), (9999, "http://a/fr/y", ""), (12345, "http://a/fr/z", ""), (123456, "http://a/de/z", "")],
                          "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet" if t != "pages" else next((tmp_path / "pages").glob("*.parquet")))
    df = entry.queries()["parse_names"](spark, str(tmp_path))
    assert {r.page_id: r.run_id for r in df.collect()} == {7: "R07", 9999: "R9999", 12345: "R12345", 123456: None}
    assert oracle.compare(oracle.connect(str(tmp_path)), df, entry.oracle_sql()["parse_names"]) == (None, 4)


def test_capture_patterns_run_once_a_row(spark):
    names = ["R07_C1_T3_top.tif", "CAL_20C_G10_glass_5min.tif", "REF_S1.tif", "other", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = R.with_capture_name(df, F.col("n"), "f").select("n", "f.*")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("_(top|bot)") == 2  # the match and the replacement
    want = df.select("n", R.parse_capture_name(F.col("n")).alias("f")).select("n", "f.*")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def test_role_fields_of_any_type_agree(spark):
    from metrospan.operators.joins import role_lookup
    facts = spark.createDataFrame([("F1", 10.0, "Red", 1.0), ("F1", 11.0, "red", 1.0), ("F1", 10.0, None, 1.0), ("F2", 10.0, "red", 1.0), ("F1", 10.0, "RED", 2.0)],
                                  "ref string, gain double, colour string, cut double")
    registry = spark.createDataFrame([("F1", "REF", 10.0, "red", "1")], "id string, kind string, gain double, colour string, cut string")
    out = role_lookup(facts, registry, {"ref": "REF"}, "id", "kind", ["gain", "colour", "cut"])
    assert sorted((r["gain"], r["colour"] or "", r["cut"], r["ref_status"]) for r in out.collect()) == [
        (10.0, "", 1.0, "field_mismatch"), (10.0, "RED", 2.0, "field_mismatch"), (10.0, "Red", 1.0, "ok"), (10.0, "red", 1.0, "missing"), (11.0, "red", 1.0, "field_mismatch")]
