"""The corpus pipeline: from raw documents to a mix of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from metrospan.llm.decontaminate import decontamination_stage
from metrospan.llm.frames import read
from metrospan.llm.line_dedup import lines_stage
from metrospan.llm.mixing import mix_sources
from metrospan.llm.quality_rules import quality_stage
from metrospan.llm.simhash import simhash_stage
from metrospan.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_stage(docs, read(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines_stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_stage(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination_stage(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; ``copy`` numbers the
    copies from 1 where the documents have no column of that name."""
    names = docs.columns
    rows = docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)])
    at = {c: F.col(f"in_{k}") for k, c in enumerate(names)}
    mixed = mix_sources(rows, rows.columns, at["text"], at["source"], at["doc_id"])
    out = mixed.where("copies > 0").withColumn("ll_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    extra = [] if "copy" in names else [F.col("ll_copy").alias("copy")]
    return out.select(*[v.alias(c) for c, v in at.items()], *extra)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: The classifier of the first stage and the fingerprints of the third are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for no, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{no}_{name}")
        docs = spark.read.parquet(f"{folder}/{no}_{name}")
    return docs
