"""Checked joins, provenance and table comparison on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from ..operators import joins as J
from ..operators import metrics as X
from ..operators import provenance as P
from ..operators.ranks import id_list_chunks
from ..operators.scalars import one_row
from .registry import query, rnd, rounded, sr, table


@query("dual_lookup", """
WITH reg AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN 'REF' WHEN n_regionkey < 4 THEN 'DARK' ELSE 'OTHER' END AS kind, n_regionkey AS r, n_nationkey % 6 = 2 AS twice FROM nation),
f AS (SELECT c_custkey, c_nationkey AS ref_id, 30 - c_nationkey AS dark_id, length(c_mktsegment) - 8 AS r FROM customer)
SELECT c_custkey,
  CASE WHEN a.kind IS NULL THEN 'missing' WHEN a.twice THEN 'ambiguous' WHEN a.kind <> 'REF' THEN 'wrong_kind' WHEN a.r <> f.r THEN 'field_mismatch' ELSE 'ok' END AS ref_id_status,
  CASE WHEN b.kind IS NULL THEN 'missing' WHEN b.twice THEN 'ambiguous' WHEN b.kind <> 'DARK' THEN 'wrong_kind' WHEN b.r <> f.r THEN 'field_mismatch' ELSE 'ok' END AS dark_id_status
FROM f LEFT JOIN reg a ON a.id = ref_id LEFT JOIN reg b ON b.id = dark_id""")
def dual_lookup(spark, sf):
    r = F.col("n_regionkey")
    reg = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("id"), F.when(r < 2, "REF").when(r < 4, "DARK").otherwise("OTHER").alias("kind"), r.alias("session"))
    reg = reg.unionByName(reg.where("id % 6 = 2"))
    facts = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("ref_id"), (30 - F.col("c_nationkey")).alias("dark_id"),
        (F.length("c_mktsegment") - 8).cast("string").alias("session"))
    return J.role_lookup(facts, reg, {"ref_id": "REF", "dark_id": "DARK"}, "id", "kind", ["session"]).select(
        "c_custkey", "ref_id_status", "dark_id_status")


@query("exactly_one_join", """
WITH dim AS (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT * FROM customer WHERE c_acctbal < 0 AND c_mktsegment <> 'BUILDING')
, k AS (SELECT c_custkey, count(*) AS n, min(c_nationkey) AS c_nationkey FROM dim GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN k.c_nationkey END AS c_nationkey,
       CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS match_status
FROM orders LEFT JOIN k ON o_custkey = c_custkey""")
def exactly_one_join(spark, sf):
    c = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'")
    dim = c.unionByName(c.where("c_acctbal < 0")).withColumnRenamed("c_custkey", "o_custkey")
    return J.exactly_one(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"], ["c_nationkey"]).drop("o_custkey")


@query("label_join", """
SELECT d.doc_id, quality, CASE WHEN n_chars < 300 THEN 'unlabelled' WHEN quality IS NULL THEN 'missing_label' ELSE 'ok' END AS label_status
FROM documents d LEFT JOIN labels l ON n_chars >= 300 AND d.doc_id = l.doc_id""")
def label_join(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 300, F.col("doc_id")).alias("label_id"))
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("measurement_id"), "quality")
    return J.optional_match(d, labels, "label_id", "measurement_id", ["quality"]).drop("label_id")


@query("calibration_join", f"""
WITH c AS (SELECT l_linenumber * 10.0 AS gly, l_returnflag AS f, avg(l_quantity) AS q FROM lineitem GROUP BY ALL),
v AS (SELECT l_linenumber * 10.0 AS gly, l_returnflag AS f, 0.001 + avg(l_discount) / 100 AS eta FROM lineitem WHERE l_linenumber < 7 GROUP BY ALL)
SELECT CAST(c.gly AS DOUBLE) AS gly_pct, c.f AS cond, {sr('q', 8)} AS q, {sr('eta', 10)} AS eta, CASE WHEN eta IS NULL THEN 'missing' ELSE 'ok' END AS match_status
FROM c LEFT JOIN v ON c.gly = v.gly AND c.f = v.f""")
def calibration_join(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"gly_pct": F.col("l_linenumber") * F.lit(10.0), "cond": F.col("l_returnflag")})
    cond = li.groupBy("gly_pct", "cond").agg(F.avg("l_quantity").alias("q"))
    visc = li.where("l_linenumber < 7").groupBy("gly_pct", "cond").agg((F.avg("l_discount") / 100 + 0.001).alias("eta"))
    return rounded(J.exactly_one(cond, visc, ["gly_pct", "cond"], ["eta"]), {"q": 8, "eta": 10})


_PAIRED = """
WITH oof AS (SELECT l_orderkey AS a, l_linenumber AS b, min(l_extendedprice) / 1000 AS label, min(l_quantity) * 2.1 AS pred FROM lineitem GROUP BY ALL HAVING count(*) = 1),
man AS (SELECT l_orderkey AS a, l_linenumber AS b, min(l_extendedprice) / 1000 + min(l_tax) AS m FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL HAVING count(*) = 1),
sides AS (SELECT * FROM (SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS n FROM lineitem GROUP BY ALL)
  FULL JOIN (SELECT l_orderkey AS a, l_linenumber AS b, count(*) AS m FROM lineitem WHERE l_tax > 0.02 GROUP BY ALL) USING (a, b)),
j AS (SELECT label, pred, m FROM oof JOIN man USING (a, b)),
u AS (SELECT 'model' AS source, label AS y, pred AS p FROM j UNION ALL SELECT 'manual', label, m FROM j)
"""


@query("manual_comparison", _PAIRED + f"""
SELECT source, count(*) AS n_paired, {sr('sqrt(avg((p - y) * (p - y)))', 7)} AS rmse, {sr('stddev_samp(100 * (p - y) / y)', 5)} AS relative_1sigma_pct,
  (SELECT count(*) FILTER (coalesce(n, 0) > 1 OR coalesce(m, 0) > 1) FROM sides) AS n_repeated, (SELECT count(*) FILTER (m IS NULL) FROM sides) AS n_left_only,
  (SELECT CASE WHEN count(*) FILTER (coalesce(n, 0) > 1 OR coalesce(m, 0) > 1) > 0 THEN 'REPEATED_KEYS' ELSE 'OK' END FROM sides) AS comparison_status
FROM u GROUP BY 1""")
def manual_comparison(spark, sf):
    li = table(spark, sf, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    oof = li.select(*key, (F.col("l_extendedprice") / 1000).alias("label"), (F.col("l_quantity") * 2.1).alias("pred"))
    manual = li.where("l_tax > 0.02").select(*key, (F.col("l_extendedprice") / 1000 + F.col("l_tax")).alias("manual"))
    j, status = J.one_to_one(oof, manual, key)
    both = j.select(F.inline(F.array(
        F.struct(F.lit("model").alias("source"), F.col("label").alias("y"), F.col("pred").alias("p")),
        F.struct(F.lit("manual").alias("source"), F.col("label").alias("y"), F.col("manual").alias("p")))))
    m = X.regression_metrics(both, "y", "p", ["source"])
    s = one_row(status)
    return m.select("source", F.col("n_measurements").alias("n_paired"), rnd("rmse", 7).alias("rmse"), rnd("relative_1sigma_pct", 5).alias("relative_1sigma_pct"),
                    s["n_repeated"].alias("n_repeated"), s["n_left_only"].alias("n_left_only"), s["status"].alias("comparison_status"))


@query("stale_rows", """
WITH g AS (SELECT c_custkey, CASE c_nationkey WHEN 3 THEN c_acctbal * (1 + 1e-12) WHEN 5 THEN c_acctbal + 1 WHEN 6 THEN NULL ELSE c_acctbal END AS c_acctbal,
    CASE c_nationkey WHEN 5 THEN upper(c_name) WHEN 7 THEN upper(c_name) ELSE c_name END AS c_name FROM customer WHERE c_mktsegment <> 'BUILDING'),
c AS (SELECT c_custkey, c_acctbal, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY'),
j AS (SELECT coalesce(g.c_custkey, c.c_custkey) AS c_custkey, g.c_custkey IS NULL AS ng, c.c_custkey IS NULL AS nc,
    CASE WHEN g.c_name <> c.c_name THEN 'c_name' END AS d1,
    CASE WHEN g.c_acctbal IS NULL OR abs(g.c_acctbal - c.c_acctbal) > 1e-12 + 1e-9 * abs(c.c_acctbal) THEN 'c_acctbal' END AS d2
    FROM g FULL JOIN c ON g.c_custkey = c.c_custkey)
SELECT c_custkey, CASE WHEN ng THEN 'not_exported' WHEN nc THEN 'not_current' WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN 'stale' ELSE 'ok' END AS status,
       CASE WHEN ng OR nc THEN '' ELSE concat_ws(',', d1, d2) END AS fields FROM j""")
def stale_rows(spark, sf):
    c, n = table(spark, sf, "customer"), F.col("c_nationkey")
    bal = F.col("c_acctbal")
    given = c.where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", F.when(n == 3, bal * (1 + 1e-12)).when(n == 5, bal + 1).when(n == 6, F.lit(None)).otherwise(bal).alias("c_acctbal"),
        F.when(n.isin(5, 7), F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"))
    return J.stale_rows(given, c.where("c_mktsegment <> 'MACHINERY'"), "c_custkey", ["c_name"], ["c_acctbal"])


@query("circularity", """
SELECT DISTINCT l_suppkey::VARCHAR AS id FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 3)""")
def circularity(spark, sf):
    used = id_list_chunks(table(spark, sf, "supplier").where("s_nationkey < 3"), ["s_nationkey"], "s_suppkey", chunk=10)
    return J.shared_ids(used, "ids", table(spark, sf, "lineitem"), ["l_suppkey"])


@query("leakage_audit", """
WITH o AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'test' ELSE 'train' END AS role FROM orders),
l AS (SELECT 'o_custkey' AS key, o_custkey::VARCHAR AS value, role FROM o UNION ALL SELECT 'o_orderkey', o_orderkey::VARCHAR, role FROM o
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, role FROM o UNION ALL SELECT 'o_orderstatus', o_orderstatus, role FROM o)
SELECT key, count(*) AS n_values, count(*) FILTER (n > 1) AS n_leaked, min(value) FILTER (n > 1) AS example
FROM (SELECT key, value, count(DISTINCT role) AS n FROM l GROUP BY 1, 2) GROUP BY key""")
def leakage_audit(spark, sf):
    o = table(spark, sf, "orders").withColumn("role", F.when(F.col("o_orderstatus") == "F", "test").otherwise("train"))
    return J.leakage_audit(o, ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"], "role")


@query("id_list", """
WITH r AS (SELECT user_id, event_id::VARCHAR AS e, (row_number() OVER (PARTITION BY user_id ORDER BY event_id::VARCHAR) - 1) // 20 AS c FROM events)
SELECT user_id, c AS chunk_no, count(*) AS n_ids, string_agg(e, '|' ORDER BY e) AS ids FROM r GROUP BY 1, 2""")
def id_list(spark, sf):
    return id_list_chunks(table(spark, sf, "events"), ["user_id"], "event_id", chunk=20)


_DEPS = """
WITH m AS (SELECT doc_id::VARCHAR AS i, 'text/' || source AS p, sha256(source) AS h, CASE WHEN lang = 'es' THEN '' ELSE 'ref/' || lang END AS rp,
                  CASE WHEN lang = 'fr' THEN sha256(source) ELSE sha256(lang) END AS rh FROM documents),
d AS (SELECT i, p AS path, 'image_pixels' AS role, 'numerical_input' AS usage, h AS sha FROM m UNION ALL SELECT i, rp, 'reference', 'evidence_only', rh FROM m WHERE rp <> '')
"""


def _deps(spark, sf):
    lang, src = F.col("lang"), F.col("source")
    m = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("i"), F.concat(F.lit("text/"), src).alias("p"), F.sha2(src, 256).alias("h"),
        F.when(lang == "es", "").otherwise(F.concat(F.lit("ref/"), lang)).alias("rp"),
        F.sha2(F.when(lang == "fr", src).otherwise(lang), 256).alias("rh"))
    return P.dependencies(m, "i", {"image_pixels": ("p", "h", "numerical_input"), "reference": ("rp", "rh", "evidence_only")})


@query("provenance", _DEPS + """
SELECT path, role, usage, min(sha) AS sha256, count(DISTINCT i) AS n_images, min(i) AS first_image, max(i) AS last_image, min(sha) <> max(sha) AS conflict
FROM d GROUP BY 1, 2, 3""")
def provenance(spark, sf):
    return P.provenance(_deps(spark, sf))


@query("provenance_consumers", _DEPS + """
, r AS (SELECT path, role, i, (row_number() OVER (PARTITION BY path, role ORDER BY i) - 1) // 50 AS c FROM (SELECT DISTINCT path, role, i FROM d))
SELECT path, role, c AS chunk_no, count(*) AS n_ids, string_agg(i, '|' ORDER BY i) AS ids FROM r GROUP BY 1, 2, 3""")
def provenance_consumers(spark, sf):
    return P.consumers(_deps(spark, sf), chunk=50)


@query("content_duplicates", """
SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_key, max(doc_id) AS last_key FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return P.duplicate_content(d, "doc_id", "digest")


# --- comparison of two versions -------------------------------------------------

_VERSIONS = """
WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_custkey FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN lower(o_orderstatus) ELSE o_orderstatus END AS o_orderstatus,
    CASE o_orderpriority WHEN '2-HIGH' THEN o_totalprice * (1 + 1e-10) WHEN '5-LOW' THEN o_totalprice * 1.001 WHEN '3-MEDIUM' THEN NULL ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN o_custkey + 1 ELSE o_custkey END AS o_custkey FROM orders),
j AS (SELECT a.o_orderkey, a.o_orderstatus AS s1, b.o_orderstatus AS s2, a.o_totalprice AS p1, b.o_totalprice AS p2, a.o_custkey AS c1, b.o_custkey AS c2
      FROM a JOIN b USING (o_orderkey)),
l AS (SELECT o_orderkey, 'o_orderstatus' AS col, 'exact_text' AS mode, s1 AS x, s2 AS y, NULL::DOUBLE AS u, NULL::DOUBLE AS v, s1 <> s2 AS bad FROM j
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'numeric_tolerance', p1::VARCHAR, p2::VARCHAR, p1, p2, p2 IS NULL OR abs(p2 - p1) > 1e-10 + 1e-8 * abs(p1) FROM j
  UNION ALL SELECT o_orderkey, 'o_custkey', 'exact_discrete', c1::VARCHAR, c2::VARCHAR, c1, c2, c1 <> c2 FROM j)
"""


def _versions(spark, sf):
    o, pr = table(spark, sf, "orders"), F.col("o_orderpriority")
    p = F.col("o_totalprice")
    a = o.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    b = o.select(
        "o_orderkey", F.when(pr == "1-URGENT", F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(pr == "2-HIGH", p * (1 + 1e-10)).when(pr == "5-LOW", p * 1.001).when(pr == "3-MEDIUM", F.lit(None)).otherwise(p).alias("o_totalprice"),
        F.when((pr == "1-URGENT") & (F.col("o_orderstatus") == "F"), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return a, b, dict(key=["o_orderkey"], exact=["o_orderstatus"], numeric=["o_totalprice"], discrete=["o_custkey"])


@query("table_diff", _VERSIONS + f"""
SELECT col AS "column", mode, count(*) AS rows, count(*) FILTER (x IS NULL) AS missing_before, count(*) FILTER (y IS NULL) AS missing_after,
  bool_and((x IS NULL) = (y IS NULL)) AS missing_mask_equal, count(*) FILTER (bad) AS different_rows, {sr('max(abs(v - u))', 6)} AS max_abs_error,
  {sr('max(abs(v - u) / abs(nullif(u, 0)))', 10)} AS max_rel_error, count(*) FILTER (u = 0 AND v <> 0) AS unbounded_relative_error_count,
  count(*) FILTER (bad) = 0 AS within_policy FROM l GROUP BY 1, 2""")
def table_diff(spark, sf):
    a, b, spec = _versions(spark, sf)
    return rounded(D.table_diff(a, b, **spec), {"max_abs_error": 6, "max_rel_error": 10})


@query("table_diff_examples", _VERSIONS + """
SELECT col AS "column", o_orderkey, r AS example, x AS before FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY col ORDER BY o_orderkey) AS INTEGER) AS r FROM l WHERE bad) WHERE r <= 3""")
def table_diff_examples(spark, sf):
    a, b, spec = _versions(spark, sf)
    return D.diff_examples(a, b, **spec).drop("after")


@query("table_diff_status")
def table_diff_status(spark, sf):
    a, b, spec = _versions(spark, sf)
    rows = [D.artifact_status(a, b, **spec), D.artifact_status(a, a, **spec), D.artifact_status(a, None, **spec),
            D.artifact_status(a, a.where("o_orderstatus = 'F'"), **spec), D.artifact_status(a, a.withColumn("extra", F.lit(1)), **spec)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("run_summary")
def run_summary(spark, sf):
    return D.run_summary(table_diff_status(spark, sf))


@query("json_cell_diff", """
WITH t AS (SELECT event_id, '{"k": ' || (props->>'k') || ', "v": ' || value || '}' AS a,
  CASE event_type WHEN 'view' THEN '{"v":' || value || ',  "k":' || (props->>'k') || '}' WHEN 'click' THEN '{"k": ' || (props->>'k') || ', "v": ' || (value + 1) || '}'
    WHEN 'error' THEN '{"k": ' || (props->>'k') || ', "k": 1}' WHEN 'signup' THEN '{"k": ' || (props->>'k') || '.0, "v": ' || value || '}'
    ELSE '{"k": ' || (props->>'k') || ', "v": ' || value || '}' END AS b, event_type FROM events)
SELECT CASE WHEN event_type = 'click' THEN 'different' WHEN event_type = 'error' THEN 'invalid_json' WHEN event_type = 'purchase' THEN 'identical_text'
            ELSE 'equal_after_normalisation' END AS status, count(*) AS n FROM t GROUP BY 1""")
def json_cell_diff(spark, sf):
    k, v, kind = F.get_json_object("props", "$.k"), F.col("value").cast("string"), F.col("event_type")

    def obj(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    a = obj('{"k": ', k, ', "v": ', v, "}")
    b = (F.when(kind == "view", obj('{"v":', v, ',  "k":', k, "}"))
         .when(kind == "click", obj('{"k": ', k, ', "v": ', (F.col("value") + 1).cast("string"), "}"))
         .when(kind == "error", obj('{"k": ', k, ', "k": 1}'))
         .when(kind == "signup", obj('{"k": ', k, '.0, "v": ', v, "}")).otherwise(a))
    return D.json_cell_diff(table(spark, sf, "events").select(a.alias("a"), b.alias("b")), "a", "b")


@query("inventory_diff", """
WITH a AS (SELECT url, md5(html) AS h FROM pages WHERE url NOT LIKE '%.org%'), b AS (SELECT url, CASE WHEN url LIKE '%/de/%' THEN 'x' ELSE md5(html) END AS h FROM pages WHERE url NOT LIKE '%.com%'),
g AS (SELECT url, min(h) AS h FROM a GROUP BY 1), k AS (SELECT url, min(h) AS h FROM b GROUP BY 1)
SELECT coalesce(g.url, k.url) AS url, CASE WHEN k.url IS NULL THEN 'only_before' WHEN g.url IS NULL THEN 'only_after' WHEN g.h = k.h THEN 'equal' ELSE 'changed' END AS status
FROM g FULL JOIN k ON g.url = k.url""")
def inventory_diff(spark, sf):
    p = table(spark, sf, "pages").select("url", F.md5(F.col("html").cast("binary")).alias("h"))
    after = p.where(~F.col("url").contains(".com")).withColumn(
        "h", F.when(F.col("url").contains("/de/"), "x").otherwise(F.col("h")))
    return D.inventory_diff(p.where(~F.col("url").contains(".org")), after, "url", "h")
