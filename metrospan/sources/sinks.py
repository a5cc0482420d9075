"""Sinks that never overwrite."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.contracts import ContractViolation


def _is_new(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return True
    if not fs.getFileStatus(hadoop).isDirectory() or len(fs.listStatus(hadoop)):
        raise FileExistsError(f"output must be new or empty: {path}")
    return False


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (), **options) -> str:
    """Write to a new or empty folder; an existing result is never touched."""
    mode = "errorifexists" if _is_new(df.sparkSession, path) else "append"
    writer = df.write.mode(mode).format(fmt).options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_report(df: DataFrame, path: str) -> str:
    """One-row JSON report; a non-finite number is refused."""
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    if doubles:
        bad = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(c) == float("inf")) for c in doubles])
        if not df.where(bad).isEmpty():
            raise ContractViolation("report holds a non-finite number")
    return write_once(df.coalesce(1), path, "json")


def _digest(df: DataFrame) -> dict:
    """Row count and an order-free digest of all values."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).cast("string").alias("digest")).first()
    return {"rows": r["rows"], "digest": r["digest"] or "0"}


def write_bundle(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None) -> str:
    """Several tables as one result: the description, with the count and the
    digest of every table, is written last and makes the result whole."""
    for name, df in tables.items():
        write_once(df, f"{path}/{name}", partition_by=(partition_by or {}).get(name, ()))
    spark = next(iter(tables.values())).sparkSession
    rows = [(n, *_digest(spark.read.schema(df.schema).parquet(f"{path}/{n}")).values()) for n, df in tables.items()]
    write_once(spark.createDataFrame(rows, "name string, rows long, digest string").coalesce(1), f"{path}/bundle", "json")
    return path


def read_bundle(spark: SparkSession, path: str, schemas: dict | None = None) -> dict[str, DataFrame]:
    """The tables of a whole result; one that was not finished, or was changed
    since, is refused."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bundle/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        raise ContractViolation(f"not a whole result: {path}")
    out = {}
    for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/bundle").collect():
        reader = spark.read.schema(schemas[r["name"]]) if schemas else spark.read
        out[r["name"]] = reader.parquet(f"{path}/{r['name']}")
        if _digest(out[r["name"]]) != {"rows": r["rows"], "digest": r["digest"]}:
            raise ContractViolation(f"{r['name']} differs from what was written: {path}")
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    from ..session import shared_folder
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def save_models(models: DataFrame, metadata: DataFrame, path: str) -> str:
    """Coefficient rows and a one-row description (role, columns, ranges)."""
    write_once(models, f"{path}/models")
    write_once(metadata, f"{path}/metadata", "json")
    return path


def load_models(spark: SparkSession, path: str, role: str) -> tuple[DataFrame, DataFrame]:
    """Saved coefficients; a model saved for another role is refused."""
    meta = spark.read.json(f"{path}/metadata")
    found = meta.select("role").first()["role"]
    if found != role:
        raise ContractViolation(f"model role is {found}, need {role}")
    return spark.read.parquet(f"{path}/models"), meta
