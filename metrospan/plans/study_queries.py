"""The manifest job on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import condition_key
from .registry import query, table
from .study import manifest

_SQL = """
WITH o AS (SELECT o.*, c.c_nationkey AS n, c.c_mktsegment AS seg, left(o_orderpriority, 1)::INT AS slot, CASE o_orderstatus WHEN 'F' THEN 'top' ELSE 'bot' END AS pos FROM orders o JOIN customer c ON o_custkey = c_custkey),
inc AS (SELECT * FROM o WHERE o_orderkey % 89 <> 0 OR o_orderkey % 97 = 0),
d AS (SELECT floor(o_totalprice / 5) AS h, count(*) AS copies FROM inc GROUP BY 1),
pth AS (SELECT o_custkey AS pc, slot AS ps, CASE WHEN o_orderstatus = 'P' AND slot = 3 THEN 'top' ELSE pos END AS pp, count(*) AS paths FROM inc GROUP BY ALL),
f AS (SELECT o_orderkey, [
  CASE WHEN o_orderkey % 97 = 0 THEN 'include_text' END,
  CASE WHEN o_orderkey % 97 = 1 THEN 'exclusion_reason' END,
  CASE WHEN o_orderkey % 83 = 0 THEN 'image_id_text' END,
  CASE WHEN paths > 1 THEN 'path_repeated' END,
  CASE WHEN o_orderkey % 79 = 0 THEN 'missing_fields' END,
  CASE WHEN o_totalprice > 490000 THEN 'acquisition' END,
  CASE WHEN o_totalprice > 490000 THEN 'ref_frame' END,
  CASE WHEN n >= 20 OR o_totalprice > 490000 THEN 'dark_frame' END,
  CASE WHEN n = 11 AND o_totalprice <= 490000 THEN 'ref_frame_name' END,
  CASE WHEN o_orderkey % 73 = 0 THEN 'pixel_scale' END,
  CASE WHEN o_orderkey % 71 = 0 THEN 'roi_mode' END,
  CASE WHEN o_orderstatus = 'P' AND slot = 3 THEN 'name_fields' END,
  CASE WHEN seg = 'BUILDING' THEN 'run_join' END,
  CASE WHEN slot = 5 THEN 'layout_join' END,
  CASE WHEN seg = 'MACHINERY' THEN 'run_fields' END,
  CASE WHEN seg <> 'BUILDING' AND n = 7 THEN 'run_values' END,
  CASE WHEN slot = 4 THEN 'layout_values' END,
  CASE WHEN seg <> 'BUILDING' AND o_totalprice < 10000 THEN 'condition_id' END,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice > 400000 THEN 'label_join' END,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice < 20000 THEN 'label_registration' END,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice <= 400000 AND slot = 5 THEN 'label_values' END,
  CASE WHEN copies > 1 THEN 'duplicate_content' END] AS l FROM inc JOIN d ON floor(o_totalprice / 5) = h
  JOIN pth ON pc = o_custkey AND ps = slot AND pp = CASE WHEN o_orderstatus = 'P' AND slot = 3 THEN 'top' ELSE pos END)
SELECT CASE WHEN o_orderkey % 83 = 0 THEN 'a b' ELSE '' END || o_orderkey::VARCHAR AS image_id, 'R' || CASE WHEN o_custkey < 10 THEN '0' ELSE '' END || o_custkey || '_C1_T' || slot AS trench_id,
  array_to_string(list_filter(l, lambda x: x IS NOT NULL), ';') AS faults FROM f JOIN o USING (o_orderkey)"""


@query("manifest", _SQL)
def manifest_query(spark, sf):
    nation_key = F.col("c_nationkey")
    customers = table(spark, sf, "customer").withColumn(
        "run_key", condition_key(F.lit(20.0) + nation_key, F.lit(10.0) * (nation_key % 5), F.lit("mass_pct")))
    o = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    n, seg, price = F.col("c_nationkey"), F.col("c_mktsegment"), F.col("o_totalprice")
    num, key = F.col("o_custkey").cast("string"), F.col("o_orderkey")
    run = F.concat(F.lit("R"), F.when(F.length(num) >= 2, num).otherwise(F.lpad(num, 2, "0")))
    slot = F.substring("o_orderpriority", 1, 1).cast("int")
    pos = F.when(F.col("o_orderstatus") == "F", "top").otherwise("bot")
    shown = F.when((F.col("o_orderstatus") == "P") & (slot == 3), "top").otherwise(pos)
    session = F.concat(F.lit("S"), n.cast("string"))
    fixed = {"exposure_ms": F.lit(10.0), "gain": F.lit(1.0), "illumination_id": F.lit("L1"), "magnification": F.lit(20.0),
             "bit_depth": F.lit(12), "gamma": F.lit(1.0), "white_balance": F.lit("fixed"), "color_channel": F.lit("mono")}
    images = o.select(
        F.concat(F.when(key % 83 == 0, "a b").otherwise(""), key.cast("string")).alias("image_id"),
        F.when(key % 97 == 0, "maybe").when((key % 89 == 0) | (key % 97 == 1), "0").otherwise("True").alias("include"),
        F.when(key % 89 == 0, "scratch").alias("exclusion_reason"), F.when(key % 71 == 0, "free").otherwise("auto").alias("roi_mode"),
        F.concat(F.lit("raw/"), run, F.lit("_C1_T"), slot.cast("string"), F.lit("_"), shown, F.lit(".tif")).alias("path"),
        F.lit("trench").alias("kind"), run.alias("run_id"), F.lit(1).alias("chip"), slot.alias("slot"), pos.alias("pos"),
        F.when(price < 10000, "unknown").otherwise(F.col("run_key")).alias("condition_id"),
        F.when(seg == "MACHINERY", "other").otherwise(seg).alias("batch_id"), F.when(key % 79 != 0, num).alias("specimen_id"),
        F.concat(F.lit("region-"), F.col("o_orderkey").cast("string")).alias("matched_region_id"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("M"), F.col("o_orderkey").cast("string"))).alias("measurement_id"),
        F.when(key % 73 == 0, "0.5 um").otherwise("0.5").alias("um_per_px"), F.lit("SYNTHETIC").alias("scale_source"), F.lit("SYNTHETIC").alias("origin"),
        F.lit("x+").alias("orientation"), F.concat(F.lit("REF"), n.cast("string")).alias("ref_id"),
        F.concat(F.lit("DARK"), n.cast("string")).alias("dark_id"), session.alias("session_id"),
        F.when(price > 490000, "true").otherwise("False").alias("auto_exposure"), *[c.alias(k) for k, c in fixed.items()],
        F.sha2(F.floor(price / 5).cast("string"), 256).alias("content_sha256"))
    labels = o.where((F.col("o_orderstatus") == "F") & (price <= 400000)).select(
        F.concat(F.lit("M"), F.col("o_orderkey").cast("string")).alias("measurement_id"), run.alias("run_id"), F.lit(1).alias("chip"),
        (slot + F.when(price < 20000, 1).otherwise(0)).alias("slot"), pos.alias("pos"),
        F.concat(F.lit("region-"), F.col("o_orderkey").cast("string")).alias("matched_region_id"), (price / 1000).alias("thickness_nm"),
        F.lit(1.0).alias("thickness_sd_nm"), F.lit(3).alias("n_sites"), F.lit(34.0).alias("z_lo_um"), F.lit(66.0).alias("z_hi_um"),
        F.lit("validated_region_average").alias("match_basis"))
    runs = table(spark, sf, "customer").where(seg != "BUILDING")
    rnum = F.col("c_custkey").cast("string")
    runs = runs.select(
        F.concat(F.lit("R"), F.when(F.length(rnum) >= 2, rnum).otherwise(F.lpad(rnum, 2, "0"))).alias("run_id"),
        (F.lit(20.0) + n).alias("T_C"), (F.lit(10.0) * (n % 5)).alias("gly_pct"), F.lit("mass_pct").alias("gly_basis"), F.when(n == 7, 0).otherwise(1).alias("rep"),
        F.lit("2024-01-01").alias("date"), session.alias("session_id"), F.lit(1).alias("cycles"), F.lit(1.0).alias("dep_time_h"), seg.alias("batch_id"))
    part = table(spark, sf, "part").where("p_size < 5").groupBy(F.col("p_size").alias("slot")).agg(F.lit(9.0).alias("AR"))
    layout = part.select("slot", "AR", F.when(F.col("slot") == 4, 271.0).otherwise(270.0).alias("L_um"), F.lit(30.0).alias("w_um"), F.lit(30.0).alias("h_um"), F.lit(4).alias("faces"),
                         *[F.lit("pdms").alias(c) for c in ("left_material", "right_material", "floor_material", "ceiling_material")])
    nation = table(spark, sf, "nation")
    nk = F.col("n_nationkey").cast("string")
    frame = lambda kind: [F.concat(F.lit(kind), nk).alias("frame_id"), F.concat(F.lit(f"raw/{kind}_S"), F.when((nk == "11") & (F.lit(kind) == "REF"), "99").otherwise(nk), F.lit(".tif")).alias("path"),
                          F.lit(kind).alias("kind"), F.concat(F.lit("S"), nk).alias("session_id"), F.lit("false").alias("auto_exposure"),
                          *[c.alias(k) for k, c in fixed.items()]]
    frames = nation.select(*frame("REF")).unionByName(nation.where("n_nationkey < 20").select(*frame("DARK")))
    m, _ = manifest(images, runs, layout, frames, labels, "SYNTHETIC", ("SYNTHETIC",))
    return m.select("image_id", "trench_id", "faults")
