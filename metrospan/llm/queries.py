"""Registered queries of the operators and the SQL that some can be checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, fill_middle, importance, lang_id, line_dedup, mixing, quality_rules, secret_scan, simhash, substring_dedup,
               url_filter, warc, whitening)
from .frames import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": lambda spark, sf: lang_id.language_query(read(spark, sf, "documents")),
    "op2_quality_rules": lambda spark, sf: quality_rules.quality_query(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op3_secret_scan": lambda spark, sf: secret_scan.secret_query(read(spark, sf, "documents")),
    "op4_decontamination": lambda spark, sf: decontaminate.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark")),
    "op5_importance_resampling": lambda spark, sf: importance.resample_query(read(spark, sf, "documents"), read(spark, sf, "labels")),
    "op6_url_filter": lambda spark, sf: url_filter.judge_urls(read(spark, sf, "pages")),
    "op7_warc": lambda spark, sf: warc.warc_query(read(spark, sf, "pages")),
    "op8_simhash": lambda spark, sf: simhash.simhash_query(read(spark, sf, "documents")),
    "op9_line_dedup": lambda spark, sf: line_dedup.lines_query(read(spark, sf, "documents")),
    "op10_mixing": lambda spark, sf: mixing.mixing_query(read(spark, sf, "documents")),
    "op11_whitening": lambda spark, sf: whitening.whitening_query(read(spark, sf, "embeddings")),
    "op12_fill_middle": lambda spark, sf: fill_middle.fill_middle_query(read(spark, sf, "documents")),
    "op13_suffix_dedup": lambda spark, sf: substring_dedup.substring_query(read(spark, sf, "documents")),
}

ORACLES: dict[str, str] = {"op7_warc": warc.WARC_SQL, "op9_line_dedup": line_dedup.LINES_SQL, "op10_mixing": mixing.MIXING_SQL,
                            "op12_fill_middle": fill_middle.FILL_MIDDLE_SQL}
