"""Sources, contract rules and filters on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import (acquisition_faults, condition_key, is_contained_path, is_decimal_text, is_finite,
                               is_integer_valued, is_iso_date, parse_capture_name, same_field, within)
from ..functions.units import to_si, to_si_status
from ..operators import contracts as C
from ..operators import models as M
from ..operators.scalars import one_row
from ..operators.provenance import changed_files, file_fingerprints
from ..sources.sinks import scratch_path, write_once
from ..sources.tables import contracted, json_fields, read_strict_csv
from .registry import query, rnd, sr, table


@query("scan_contract", """
SELECT c_custkey::VARCHAR AS c_custkey, c_nationkey::VARCHAR AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def scan_contract(spark, sf):
    return contracted(table(spark, sf, "customer"), {
        "c_custkey": "string", "c_nationkey": "string", "c_acctbal": "double", "c_mktsegment": "string"})


@query("csv_roundtrip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_acctbal FROM customer")
def csv_roundtrip(spark, sf):
    from pyspark.sql import types as T
    path = write_once(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"),
                      scratch_path(spark, "strict-csv"), "csv", header=True)
    return read_strict_csv(spark, path, {"c_acctbal": T.DoubleType()})


@query("json_contract", """
WITH t AS (SELECT CASE WHEN value > 100 THEN left(props, length(props) - 1) || ', "k": 1}'
                       WHEN value < 2 THEN left(props, length(props) - 1) ELSE props END AS p FROM events),
s AS (SELECT p, CASE WHEN NOT json_valid(p) THEN 'malformed'
                     WHEN len(json_keys(p)) > len(list_distinct(json_keys(p))) THEN 'repeated_key' ELSE 'ok' END AS status FROM t)
SELECT status, count(*) AS n, CAST(sum(CASE WHEN status = 'ok' THEN (p->>'k')::BIGINT END) AS BIGINT) AS sum_k
FROM s GROUP BY status""")
def json_contract(spark, sf):
    cut = F.expr("left(props, length(props) - 1)")
    text = (F.when(F.col("value") > 100, F.concat(cut, F.lit(', "k": 1}'))).when(F.col("value") < 2, cut)
            .otherwise(F.col("props")))
    good, bad = json_fields(table(spark, sf, "events").select(text.alias("p")), "p", {"k": "bigint"})
    ok = good.agg(F.lit("ok").alias("status"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"))
    rejected = bad.groupBy(F.col("json_status").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.lit(None).cast("bigint").alias("sum_k"))
    return ok.unionByName(rejected)


@query("path_rule", """
WITH t AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages),
v AS (SELECT page_id, CASE WHEN p LIKE '%.html' THEN '/' || p WHEN p LIKE '%ref=x' THEN '../' || p
                           WHEN p LIKE '%#top' THEN replace(p, '/en/', '/../') ELSE p END AS path FROM t)
SELECT page_id, path, NOT (path LIKE '/%' OR list_contains(string_split(path, '/'), '..')) AS contained FROM v""")
def path_rule(spark, sf):
    p = F.regexp_replace("url", r"^https?://", "")
    path = (F.when(p.endswith(".html"), F.concat(F.lit("/"), p)).when(p.endswith("ref=x"), F.concat(F.lit("../"), p))
            .when(p.endswith("#top"), F.replace(p, F.lit("/en/"), F.lit("/../"))).otherwise(p))
    return table(spark, sf, "pages").select("page_id", path.alias("path")).withColumn(
        "contained", is_contained_path("path"))


@query("file_fingerprints")
def fingerprints(spark, sf):
    f = file_fingerprints(spark, sf, "*.parquet")
    return f.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@query("provenance_verify")
def provenance_verify(spark, sf):
    recorded = file_fingerprints(spark, sf, "*.parquet")
    edited = recorded.withColumn("sha256", F.when(F.col("path").endswith("nation.parquet"), F.lit("0")).otherwise(F.col("sha256")))
    changed = changed_files(edited, file_fingerprints(spark, sf, "*.parquet"))
    return changed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "status")


@query("rule_missing", """
WITH t AS (SELECT doc_id, text, CASE WHEN lang = 'es' THEN '  ' ELSE lang END AS lang,
                  CASE WHEN n_chars < 400 THEN NULL ELSE source END AS source FROM documents)
SELECT 'missing_' || c AS rule, c AS "column", CAST(count(*) FILTER (v IS NULL OR trim(v) = '') AS BIGINT) AS n_bad,
       min(doc_id::VARCHAR) FILTER (v IS NULL OR trim(v) = '') AS example
FROM (SELECT doc_id, 'text' AS c, text AS v FROM t UNION ALL SELECT doc_id, 'lang', lang FROM t
      UNION ALL SELECT doc_id, 'source', source FROM t) GROUP BY c""")
def rule_missing(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("lang") == "es", "  ").otherwise(F.col("lang")).alias("lang"),
        F.when(F.col("n_chars") >= 400, F.col("source")).alias("source"))
    return C.missing_rule(d, ["text", "lang", "source"], "doc_id")


@query("rule_unique", """
SELECT 'unique' AS rule, 'l_orderkey+l_linenumber' AS "column", count(*) FILTER (n > 1) AS n_bad,
       min(l_orderkey || '|' || l_linenumber) FILTER (n > 1) AS example
FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
UNION ALL
SELECT 'unique', 'o_orderkey', count(*) FILTER (n > 1), min(o_orderkey::VARCHAR) FILTER (n > 1)
FROM (SELECT o_orderkey, count(*) AS n FROM orders GROUP BY ALL)""")
def rule_unique(spark, sf):
    return C.combine(C.unique_rule(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"]),
                     C.unique_rule(table(spark, sf, "orders"), ["o_orderkey"]))


@query("rule_domain", """
SELECT 'known_flag' AS rule, 'l_returnflag' AS "column", count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS n_bad,
       min(l_orderkey::VARCHAR) FILTER (l_returnflag NOT IN ('A', 'N')) AS example FROM lineitem
UNION ALL SELECT 'known_status', 'l_linestatus', count(*) FILTER (l_linestatus NOT IN ('O', 'F')),
       min(l_orderkey::VARCHAR) FILTER (l_linestatus NOT IN ('O', 'F')) FROM lineitem
UNION ALL SELECT 'constant', 'o_orderstatus', greatest(count(DISTINCT o_orderstatus) - 1, 0), max(o_orderstatus) FROM orders""")
def rule_domain(spark, sf):
    rows = C.row_rules(table(spark, sf, "lineitem"), {
        "known_flag": ("l_returnflag", ~F.col("l_returnflag").isin("A", "N")),
        "known_status": ("l_linestatus", ~F.col("l_linestatus").isin("O", "F"))}, "l_orderkey")
    return C.combine(rows, C.constant_rule(table(spark, sf, "orders"), "o_orderstatus"))


@query("rule_range", """
SELECT r.rule, r.col AS "column", count(*) FILTER (r.bad) AS n_bad, min(k) FILTER (r.bad) AS example FROM (
  SELECT l_orderkey::VARCHAR AS k, unnest([
    {'rule': 'discount_range', 'col': 'l_discount', 'bad': NOT (l_discount BETWEEN 0.01 AND 0.09)},
    {'rule': 'tax_positive', 'col': 'l_tax', 'bad': NOT (l_tax > 0)},
    {'rule': 'finite_price', 'col': 'l_extendedprice', 'bad': l_extendedprice IS NULL OR isnan(l_extendedprice) OR isinf(l_extendedprice)},
    {'rule': 'integer_quantity', 'col': 'l_quantity', 'bad': l_quantity <> floor(l_quantity)},
    {'rule': 'integer_price', 'col': 'l_extendedprice', 'bad': l_extendedprice <> floor(l_extendedprice)}]) AS r FROM lineitem)
GROUP BY r.rule, r.col""")
def rule_range(spark, sf):
    return C.row_rules(table(spark, sf, "lineitem"), {
        "discount_range": ("l_discount", ~F.col("l_discount").between(0.01, 0.09)),
        "tax_positive": ("l_tax", ~(F.col("l_tax") > 0)),
        "finite_price": ("l_extendedprice", ~is_finite("l_extendedprice")),
        "integer_quantity": ("l_quantity", ~is_integer_valued("l_quantity")),
        "integer_price": ("l_extendedprice", ~is_integer_valued("l_extendedprice"))}, "l_orderkey")


@query("rule_acquisition", """
WITH a AS (SELECT o_orderkey::VARCHAR AS k, o_totalprice / 1000 AS exposure_ms,
  CASE o_orderstatus WHEN 'F' THEN 'False' WHEN 'O' THEN '0' ELSE 'true' END AS auto_exposure,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 2.2 ELSE 1.0 END AS gamma,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 10 ELSE 12 END AS bit_depth,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'infrared' ELSE 'mono' END AS color_channel,
  CASE WHEN o_totalprice < 5000 THEN '' ELSE 'L1' END AS illumination_id,
  CASE WHEN o_totalprice > 490000 THEN -1.0 ELSE 1.0 END AS gain FROM orders)
SELECT r.rule, r.col AS "column", count(*) FILTER (r.bad) AS n_bad, min(k) FILTER (r.bad) AS example FROM (
  SELECT k, unnest([
    {'rule': 'auto_exposure_on', 'col': 'acquisition', 'bad': lower(auto_exposure) NOT IN ('false', '0')},
    {'rule': 'gamma_not_one', 'col': 'acquisition', 'bad': gamma <> 1},
    {'rule': 'bit_depth', 'col': 'acquisition', 'bad': bit_depth NOT IN (8, 12, 16)},
    {'rule': 'color_channel', 'col': 'acquisition', 'bad': color_channel NOT IN ('mono', 'red', 'green', 'blue')},
    {'rule': 'missing_illumination_id', 'col': 'acquisition', 'bad': illumination_id = ''},
    {'rule': 'invalid_gain', 'col': 'acquisition', 'bad': gain <= 0}]) AS r FROM a)
GROUP BY r.rule, r.col HAVING count(*) FILTER (r.bad) > 0""")
def rule_acquisition(spark, sf):
    pick = lambda c, m, d: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in m.items()], F.lit(d))
    p = F.col("o_totalprice")
    a = table(spark, sf, "orders").select(
        "o_orderkey", F.lit("S1").alias("session_id"), (p / 1000).alias("exposure_ms"),
        F.when(p > 490000, -1.0).otherwise(1.0).alias("gain"),
        F.when(p < 5000, "").otherwise("L1").alias("illumination_id"), F.lit(20.0).alias("magnification"),
        pick("o_orderpriority", {"2-HIGH": 10}, 12).alias("bit_depth"),
        pick("o_orderstatus", {"F": "False", "O": "0"}, "true").alias("auto_exposure"),
        pick("o_orderpriority", {"1-URGENT": 2.2}, 1.0).alias("gamma"), F.lit("fixed").alias("white_balance"),
        pick("o_orderpriority", {"5-LOW": "infrared"}, "mono").alias("color_channel"))
    rules = {k: ("acquisition", v) for k, v in acquisition_faults().items()}
    return C.row_rules(a, rules, "o_orderkey").where("n_bad > 0")


@query("rule_identity", """
WITH t AS (SELECT l_orderkey, l_quantity * 30 + CASE WHEN l_tax = 0.08 THEN 0.001 ELSE 0 END AS len, l_quantity * 30.0 AS want FROM lineitem)
SELECT 'length_identity' AS rule, 'L=AR*w' AS "column", count(*) FILTER (abs(len - want) > 1e-8 + 1e-6 * abs(want)) AS n_bad,
       min(l_orderkey::VARCHAR) FILTER (abs(len - want) > 1e-8 + 1e-6 * abs(want)) AS example FROM t""")
def rule_identity(spark, sf):
    length = F.col("l_quantity") * 30 + F.when(F.col("l_tax") == 0.08, 0.001).otherwise(0.0)
    ok = within(length, F.col("l_quantity") * 30.0, 1e-6)
    return C.row_rules(table(spark, sf, "lineitem"), {"length_identity": ("L=AR*w", ~ok)}, "l_orderkey")


@query("rule_functional_dep", """
SELECT 'one_group_per_key' AS rule, 'o_custkey->o_orderstatus' AS "column", count(*) FILTER (n > 1) AS n_bad,
       min(o_custkey::VARCHAR) FILTER (n > 1) AS example
FROM (SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1)
UNION ALL SELECT 'one_group_per_key', 'o_orderkey->o_custkey', count(*) FILTER (n > 1), min(o_orderkey::VARCHAR) FILTER (n > 1)
FROM (SELECT o_orderkey, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1)""")
def rule_functional_dep(spark, sf):
    o = table(spark, sf, "orders")
    return C.combine(C.functional_dependency(o, "o_custkey", "o_orderstatus"),
                     C.functional_dependency(o, "o_orderkey", "o_custkey"))


@query("rule_decimal_text", r"""
WITH t AS (SELECT p_type, CASE p_type WHEN 'PROMO' THEN p_retailprice || ' um' WHEN 'SMALL' THEN p_size || 'e-1'
    WHEN 'LARGE' THEN '-' || p_size WHEN 'MEDIUM' THEN '  .' || p_size || ' ' WHEN 'ECONOMY' THEN 'True' ELSE p_retailprice::VARCHAR END AS s FROM part)
SELECT p_type, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_bad FROM (
  SELECT p_type, coalesce(regexp_full_match(trim(s), '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?')
         AND try_cast(trim(s) AS DOUBLE) > 0, false) AS ok FROM t) GROUP BY 1""")
def rule_decimal_text(spark, sf):
    price, size = F.col("p_retailprice").cast("string"), F.col("p_size").cast("string")
    s = (F.when(F.col("p_type") == "PROMO", F.concat(price, F.lit(" um")))
         .when(F.col("p_type") == "SMALL", F.concat(size, F.lit("e-1")))
         .when(F.col("p_type") == "LARGE", F.concat(F.lit("-"), size))
         .when(F.col("p_type") == "MEDIUM", F.concat(F.lit("  ."), size, F.lit(" ")))
         .when(F.col("p_type") == "ECONOMY", "True").otherwise(price))
    ok = is_decimal_text(s)
    return table(spark, sf, "part").groupBy("p_type").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_bad"))


@query("rule_closeness", f"""
SELECT 'closeness' AS rule, 'p_retailprice' AS "column", count(*) FILTER (abs(p - m) > 0.01 * m) AS n_bad,
       {sr('max(abs(p - m) / m)', 9)} AS max_relative
FROM (SELECT p_retailprice AS p, (SELECT arg_min(p_retailprice, p_partkey) FROM part) AS m FROM part)
UNION ALL SELECT 'closeness', 'p_retailprice', count(*) FILTER (abs(p_retailprice - 950) > 0.06 * 950),
       {sr('max(abs(p_retailprice - 950) / 950)', 9)} FROM part""")
def rule_closeness(spark, sf):
    p = table(spark, sf, "part")
    first = one_row(p.agg(F.min_by("p_retailprice", "p_partkey").alias("v")))["v"]
    both = C.combine(C.closeness_rule(p, "p_retailprice", first, 0.01), C.closeness_rule(p, "p_retailprice", 950.0, 0.06))
    return both.withColumn("max_relative", rnd("max_relative", 9))


@query("include_exclude", """
WITH t AS (SELECT d.doc_id, CASE quality WHEN 1 THEN 'True' WHEN 0 THEN '0' END AS inc, CASE toxic WHEN 1 THEN 'toxic' END AS reason
           FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN inc IS NULL THEN 'include_text' WHEN inc = '0' AND reason IS NULL THEN 'exclusion_reason' WHEN inc = 'True' THEN 'included' ELSE 'excluded' END AS part FROM t""")
def include_exclude(spark, sf):
    t = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, "True").when(F.col("quality") == 0, "0").alias("inc"),
        F.when(F.col("toxic") == 1, "toxic").alias("reason"))
    return t.select("doc_id", C.inclusion("inc", "reason").alias("part"))


@query("parse_names", r"""
WITH t AS (SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 'r' || lpad(page_id::VARCHAR, 4, '0') || '_C' || length(url) || '_T7_Top.TIF'
    WHEN url LIKE '%/en/%' THEN 'CAL_65.5C_G' || length(url) || '_GLASS_10min.tiff'
    WHEN url LIKE '%/de/%' THEN 'dark_S' || page_id || '.tif' ELSE url END AS name FROM pages)
SELECT page_id, CASE WHEN name LIKE 'r%Top.TIF' THEN 'trench' WHEN name LIKE 'CAL%' THEN 'flat' WHEN name LIKE 'dark%' THEN 'DARK' END AS kind,
  CASE WHEN name LIKE 'r%Top.TIF' THEN 'R' || CASE WHEN page_id < 10 THEN '0' ELSE '' END || page_id END AS run_id,
  CASE WHEN name LIKE 'r%Top.TIF' THEN regexp_extract(name, '_C([0-9]+)', 1)::INT END AS chip,
  CASE WHEN name LIKE 'r%Top.TIF' THEN 7 END AS slot, CASE WHEN name LIKE 'r%Top.TIF' THEN 'top' END AS pos,
  CASE WHEN name LIKE 'CAL%' THEN 65.5::DOUBLE END AS "T_C", CASE WHEN name LIKE 'CAL%' THEN regexp_extract(name, '_G([0-9]+)', 1)::DOUBLE END AS gly_pct,
  CASE WHEN name LIKE 'CAL%' THEN 'glass' END AS substrate, CASE WHEN name LIKE 'CAL%' THEN 10.0::DOUBLE END AS t_min,
  CASE WHEN name LIKE 'dark%' THEN 'S' || page_id END AS session_id FROM t""")
def parse_names(spark, sf):
    url, pid = F.col("url"), F.col("page_id").cast("string")
    n = F.length("url").cast("string")
    run = F.when(F.length(pid) > 4, pid).otherwise(F.lpad(pid, 4, "0"))  # padding alone would cut longer ids
    name = (F.when(url.contains("/fr/"), F.concat(F.lit("r"), run, F.lit("_C"), n, F.lit("_T7_Top.TIF")))
            .when(url.contains("/en/"), F.concat(F.lit("CAL_65.5C_G"), n, F.lit("_GLASS_10min.tiff")))
            .when(url.contains("/de/"), F.concat(F.lit("dark_S"), pid, F.lit(".tif"))).otherwise(url))
    return table(spark, sf, "pages").select("page_id", parse_capture_name(name).alias("f")).select("page_id", "f.*")


@query("field_agreement", """
WITH t AS (SELECT l_returnflag, l_quantity AS declared, CASE l_returnflag WHEN 'A' THEN lpad(l_quantity::INT::VARCHAR, 3, '0')
    WHEN 'N' THEN l_quantity::INT || 'x' ELSE CASE WHEN l_tax > 0.04 THEN (l_quantity + 1)::INT::VARCHAR ELSE l_quantity::INT || '.00' END END AS parsed FROM lineitem)
SELECT l_returnflag, count(*) FILTER (coalesce(try_cast(parsed AS DOUBLE) = declared, false)) AS n_agree,
       count(*) FILTER (NOT coalesce(try_cast(parsed AS DOUBLE) = declared, false)) AS n_disagree FROM t GROUP BY 1""")
def field_agreement(spark, sf):
    q = F.col("l_quantity").cast("int").cast("string")
    parsed = (F.when(F.col("l_returnflag") == "A", F.lpad(q, 3, "0")).when(F.col("l_returnflag") == "N", F.concat(q, F.lit("x")))
              .when(F.col("l_tax") > 0.04, (F.col("l_quantity") + 1).cast("int").cast("string"))
              .otherwise(F.concat(q, F.lit(".00"))))
    ok = same_field(parsed, "l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(ok).alias("n_agree"), F.count_if(~ok).alias("n_disagree"))


@query("condition_key", """
SELECT printf('%g', l_quantity + l_tax) || 'C_G' || printf('%g', l_discount * l_tax / 8) || '_mass_pct' AS condition_id, count(*) AS n
FROM lineitem GROUP BY 1""")
def condition_key_query(spark, sf):
    key = condition_key(F.col("l_quantity") + F.col("l_tax"), F.col("l_discount") * F.col("l_tax") / 8, F.lit("mass_pct"))
    return table(spark, sf, "lineitem").groupBy(key.alias("condition_id")).agg(F.count(F.lit(1)).alias("n"))


@query("rule_date", """
WITH t AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 'O' THEN strftime(o_orderdate, '%Y') || '-13-' || strftime(o_orderdate, '%d') ELSE o_orderpriority END AS d FROM orders)
SELECT 'iso_date' AS rule, 'date' AS "column", count(*) FILTER (try_cast(d AS TIMESTAMP) IS NULL) AS n_bad,
       min(o_orderkey::VARCHAR) FILTER (try_cast(d AS TIMESTAMP) IS NULL) AS example FROM t""")
def rule_date(spark, sf):
    d = (F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
         .when(F.col("o_orderstatus") == "O", F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("-13-"), F.date_format("o_orderdate", "dd")))
         .otherwise(F.col("o_orderpriority")))
    return C.row_rules(table(spark, sf, "orders").withColumn("d", d), {"iso_date": ("date", ~is_iso_date("d"))}, "o_orderkey")


@query("domain_refusal", """
SELECT 'outside_' || c AS rule, c AS "column", count(*) FILTER (NOT v BETWEEN lo AND hi) AS n_bad, min(k) FILTER (NOT v BETWEEN lo AND hi) AS example FROM (
  SELECT l_orderkey::VARCHAR AS k, 'l_quantity' AS c, l_quantity AS v, 5 AS lo, 45 AS hi FROM lineitem
  UNION ALL SELECT l_orderkey::VARCHAR, 'l_extendedprice', l_extendedprice, 2000, 90000 FROM lineitem
  UNION ALL SELECT l_orderkey::VARCHAR, 'l_tax', l_tax, 0, 1 FROM lineitem) GROUP BY c""")
def domain_refusal(spark, sf):
    return C.bounds_refusal(table(spark, sf, "lineitem"), {
        "l_quantity": (5.0, 45.0), "l_extendedprice": (2000.0, 90000.0), "l_tax": (0.0, 1.0)}, "l_orderkey")


@query("range_flags", """
WITH r AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, min(o_custkey) AS c, max(o_custkey) AS d FROM orders
           WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')
SELECT o_orderkey, o_totalprice < a OR o_totalprice > b OR o_custkey < c OR o_custkey > d AS outside_training_feature_range FROM orders, r""")
def range_flags(spark, sf):
    o = table(spark, sf, "orders")
    train = o.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    cols = ["o_totalprice", "o_custkey"]
    return C.flag_outside(o, C.training_ranges(train, cols), cols, "outside_training_feature_range").select(
        "o_orderkey", "outside_training_feature_range")


@query("prediction_role", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'training_reprediction' ELSE 'unverified_final_inference' END AS prediction_role FROM documents""")
def prediction_role(spark, sf):
    return M.prediction_role(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("missing_levels", """
SELECT l_partkey, count(*) FILTER (NOT seen) AS n_missing, coalesce(string_agg(lvl, '|' ORDER BY lvl) FILTER (NOT seen), '') AS missing FROM (
  SELECT l_partkey, lvl, bool_or(l_quantity = lvl::DOUBLE) AS seen FROM lineitem, (VALUES ('10.0'), ('20.0'), ('30.0'), ('40.0')) v(lvl) GROUP BY ALL)
GROUP BY 1""")
def missing_levels(spark, sf):
    return C.missing_levels(table(spark, sf, "lineitem"), ["l_partkey"], "l_quantity", [10.0, 20.0, 30.0, 40.0])


@query("flag_gate", """
SELECT l_orderkey, bool_or(l_discount > 0.09 OR l_tax > 0.07) AS flagged, count(*) AS n_rows FROM lineitem GROUP BY 1""")
def flag_gate(spark, sf):
    flags = C.flags_text({"discount": F.col("l_discount") > 0.09, "tax": F.col("l_tax") > 0.07})
    return C.flag_gate(table(spark, sf, "lineitem").withColumn("flags", flags), ["l_orderkey"], "flags")


@query("missing_required", """
SELECT l_orderkey, coalesce(string_agg(f, '|' ORDER BY o) FILTER (n = 0), '') AS missing, coalesce(string_agg(f, '|' ORDER BY o) FILTER (n > 1), '') AS repeated FROM (
  SELECT l_orderkey, f, o, count(*) FILTER (l_returnflag = f) AS n FROM lineitem, (VALUES ('R', 1), ('A', 2), ('N', 3)) v(f, o) GROUP BY ALL) GROUP BY 1""")
def missing_required(spark, sf):
    return C.required_categories(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag", ["R", "A", "N"])


@query("to_si", f"""
WITH t AS (SELECT event_type, value - 300 AS v, CASE event_type WHEN 'view' THEN 'C' WHEN 'click' THEN 'um' WHEN 'error' THEN 'h'
    WHEN 'purchase' THEN 'mPa_s' ELSE 'furlong' END AS unit FROM events),
s AS (SELECT unit, CASE unit WHEN 'C' THEN CASE WHEN v > -273.15 THEN v + 273.15 END WHEN 'um' THEN v * 1e-6 WHEN 'h' THEN v * 3600
    WHEN 'mPa_s' THEN v * 1e-3 END AS si, CASE unit WHEN 'furlong' THEN 'unknown_unit' WHEN 'C' THEN CASE WHEN v > -273.15 THEN 'ok' ELSE 'below_absolute_zero' END
    ELSE 'ok' END AS status FROM t)
SELECT unit, status, count(*) AS n, {sr('avg(si)', 9)} AS mean_si, {sr('max(si)', 9)} AS max_si FROM s GROUP BY 1, 2""")
def to_si_query(spark, sf):
    kind = F.col("event_type")
    unit = (F.when(kind == "view", "C").when(kind == "click", "um").when(kind == "error", "h")
            .when(kind == "purchase", "mPa_s").otherwise("furlong"))
    e = table(spark, sf, "events").select((F.col("value") - 300).alias("v"), unit.alias("unit"))
    e = e.withColumns({"si": to_si("v", "unit"), "status": to_si_status("v", "unit")})
    return e.groupBy("unit", "status").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.avg("si"), 9).alias("mean_si"), rnd(F.max("si"), 9).alias("max_si"))


@query("study_counts", """
SELECT count(DISTINCT o_orderstatus) AS conditions, count(DISTINCT o_custkey) AS runs, count(DISTINCT (o_orderstatus, o_orderpriority)) AS run_replicates,
       count(*) AS images, count(*) FILTER (o_orderpriority = '1-URGENT') AS top_images, count(*) FILTER (o_orderpriority = '5-LOW') AS bot_images,
       count(DISTINCT o_orderkey) AS rois FROM orders""")
def study_counts(spark, sf):
    from .study import count_manifest
    o = table(spark, sf, "orders").select(
        F.lit("trench").alias("kind"), F.col("o_orderstatus").alias("condition_id"), F.col("o_custkey").alias("run_id"),
        F.col("o_orderpriority").alias("rep"), F.lit(1).alias("chip"), F.col("o_orderkey").alias("trench_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "top").when(F.col("o_orderpriority") == "5-LOW", "bot").alias("pos"),
        F.lit(None).cast("string").alias("measurement_id"), F.col("o_orderkey").alias("matched_region_id"))
    return count_manifest(o).select("conditions", "runs", "run_replicates", "images", "top_images", "bot_images", "rois")
