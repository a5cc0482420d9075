"""Which bytes a result depends on, and whether they still are the same."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..functions.digests import RunningSha256
from ..session import durable, shared_folder
from .contracts import ContractViolation
from .ranks import id_list_chunks

#: Endings that Spark's line reader would decompress.
_PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"
_PIECE = 1 << 16


def dependencies(manifest: DataFrame, image: str, roles: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Long table (path, role, usage, sha256, image) of used dependencies.

    ``roles`` maps a role to (path column, digest column, usage); blank paths
    are no dependency.
    """
    entries = F.array(*[
        F.struct(F.col(p).cast("string").alias("path"), F.lit(role).alias("role"), F.lit(usage).alias("usage"),
                 F.col(d).cast("string").alias("sha256"))
        for role, (p, d, usage) in roles.items()])
    long = manifest.select(F.col(image).cast("string").alias("image_id"), F.inline(entries))
    return long.where(F.col("path").isNotNull() & ~F.col("path").rlike(r"^\s*$"))


def provenance(deps: DataFrame) -> DataFrame:
    """One row per (path, role): digest, consumers, and digest conflicts."""
    per_consumer = deps.groupBy("path", "role", "usage", "image_id").agg(
        F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi"))
    return per_consumer.groupBy("path", "role", "usage").agg(
        F.min("_lo").alias("sha256"), F.count(F.lit(1)).alias("n_images"),
        F.min("image_id").alias("first_image"), F.max("image_id").alias("last_image"),
        (F.min("_lo") != F.max("_hi")).alias("conflict"))


def consumers(deps: DataFrame, chunk: int = 1000) -> DataFrame:
    """Sorted consumer ids per (path, role), in chunks of bounded size."""
    return id_list_chunks(deps, ["path", "role"], "image_id", chunk)


def file_fingerprints(spark, paths, glob: str | None = None, whole: int = 64 << 20, block: int = 256 << 20) -> DataFrame:
    """SHA-256 of the bytes of every file below the given paths.

    Files up to ``whole`` bytes are one row each.  Longer ones are read in
    splits and hashed ``block`` bytes a task: the digest of a file is one chain,
    so the running state of every file goes from block to block, all files in
    step.  Longer files with the ending of a compressed one stay one row each.
    """
    def read(fmt, **options):
        reader = spark.read.format(fmt).options(recursiveFileLookup="true", **options)
        return (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)

    # On file metadata alone, so that the other files are not opened.
    is_long = (F.col("_metadata.file_size") > whole) & ~F.col("_metadata.file_name").rlike(_PACKED)
    short = read("binaryFile").where(~is_long).select("path", "length", F.sha2("content", 256).alias("sha256"))
    listed = read("binaryFile").where(is_long).select("path", "length", F.col("_metadata.file_path").alias("_uri"))
    many = listed.agg(F.count(F.lit(1)).alias("files"), F.max("length").alias("longest")).first()
    if not many["files"]:
        return short
    # One number a file: every task below hashes a block of one file.
    files = durable(listed.withColumn("_no", F.row_number().over(W.orderBy("_uri")) - 1))
    lines = read("text", lineSep="\n").where(is_long).select(
        F.col("_metadata.file_path").alias("_uri"), F.col("_metadata.file_block_start").alias("at"),
        F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("data"))
    copy = f"{shared_folder(spark)}/bytes-{uuid.uuid4().hex}"
    pieces = lines.mapInArrow(_pieces, "_uri string, at long, seq long, data binary")
    pieces = pieces.withColumn("step", F.floor(F.col("at") / block).cast("int"))
    # Small row groups: a reader holds one of them at a time.
    pieces.write.partitionBy("step").options(**{"compression": "none", "parquet.block.size": 16 << 20}).parquet(copy)
    pieces = spark.read.schema("_uri string, at long, seq long, data binary, step int").parquet(copy)
    state = durable(_first_states(files, pieces.groupBy("_uri").agg(F.sum(F.length("data")).alias("_got"))))
    for step in range(-(-many["longest"] // block)):
        part = pieces.where(F.col("step") == step).join(F.broadcast(state), "_uri")
        part = part.repartitionById(many["files"], F.col("_no").cast("int")).sortWithinPartitions("at", "seq")
        after = part.select("_uri", "state", "left", "data").mapInArrow(_hash_block, "_uri string, _state binary, _left long")
        state = durable(state.join(F.broadcast(after), "_uri", "left").select(
            "_uri", "_no", "path", "length", F.coalesce("_state", "state").alias("state"), F.coalesce("_left", "left").alias("left")))
    done = F.when(F.col("left") == 0, _hex_digest("state")).otherwise(F.raise_error(F.concat(F.lit("file changed while it was read: "), "path")))
    return short.unionByName(state.select("path", "length", done.alias("sha256")))


def _first_states(files: DataFrame, read: DataFrame) -> DataFrame:
    """State before the first line and bytes still to hash.  The line reader
    ends every line, the last one too, and drops a byte order mark at the start
    of a file: the lengths tell."""
    mark = b"\xef\xbb\xbf"
    plain, marked = RunningSha256(), RunningSha256()
    marked.update(mark)
    extra = F.coalesce("_got", F.lit(0)) - F.col("length")
    had_mark = extra < -1
    fault = F.raise_error(F.concat(F.lit("file changed while it was read: "), "path"))
    return files.join(read, "_uri", "left").select(
        "_uri", "_no", "path", "length",
        F.when(extra.isin(0, 1), F.lit(plain.state)).when(extra.isin(-3, -2), F.lit(marked.state)).otherwise(fault.cast("binary")).alias("state"),
        (F.col("length") - F.when(had_mark, len(mark)).otherwise(0)).alias("left"))


def _pieces(batches):
    """Lines of each split of a file joined to pieces, in order."""
    key, seq, held, size = None, 0, [], 0

    def piece():
        return pa.RecordBatch.from_pydict({"_uri": [key[0]], "at": pa.array([key[1]], pa.int64()), "seq": pa.array([seq], pa.int64()),
                                           "data": pa.array([b"".join(held)], pa.binary())})

    for batch in batches:
        if not batch.num_rows:
            continue
        uri, at, data = batch.column("_uri").dictionary_encode(), batch.column("at").to_numpy(), batch.column("data")
        code = uri.indices.to_numpy()
        change = np.flatnonzero((code[1:] != code[:-1]) | (at[1:] != at[:-1])) + 1
        offsets = np.frombuffer(data.buffers()[1], np.int32, len(data) + 1, data.offset * 4)
        for lo, hi in zip([0, *change], [*change, len(data)]):
            now = (uri.dictionary[code[lo]].as_py(), int(at[lo]))
            if held and (now != key or size >= _PIECE):
                yield piece()
                seq, held, size = seq + 1, [], 0
            key = now
            joined = data.buffers()[2][offsets[lo]:offsets[hi]].to_pybytes()  # neighbours in one buffer
            for start in range(0, len(joined), _PIECE):
                if size >= _PIECE:
                    yield piece()
                    seq, held, size = seq + 1, [], 0
                held.append(joined[start:start + _PIECE])
                size += len(held[-1])
    if held:
        yield piece()


def _hash_block(batches):
    """The pieces of one block of one file, hashed on from its state."""
    uri = running = left = None
    for batch in batches:
        for i in range(batch.num_rows):
            if running is None:
                uri, left = batch.column("_uri")[i].as_py(), batch.column("left")[i].as_py()
                running = RunningSha256(batch.column("state")[i].as_py())
            data = batch.column("data")[i].as_py()[:left]  # not the line end that the file lacks
            running.update(data)
            left -= len(data)
    if running is not None:
        yield pa.RecordBatch.from_pydict({"_uri": [uri], "_state": pa.array([running.state], pa.binary()), "_left": pa.array([left], pa.int64())})


@F.udf(T.StringType())
def _hex_digest(state):
    return RunningSha256(bytes(state)).hexdigest()


def changed_files(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Recorded files whose bytes changed or that vanished."""
    now = current.select("path", F.col("sha256").alias("_now"))
    j = recorded.join(now, "path", "left")
    return j.where(~F.col("sha256").eqNullSafe(F.col("_now"))).select(
        "path", F.when(F.col("_now").isNull(), "missing").otherwise("changed").alias("status"))


def verify(recorded: DataFrame, current: DataFrame) -> None:
    """Raise with the number of changed and missing files and an example of each."""
    bad = changed_files(recorded, current).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("e")).orderBy("status").collect()
    if bad:
        raise ContractViolation("stale dependency files: " + ", ".join(f"{r['n']} {r['status']}, e.g. {r['e']}" for r in bad))


def duplicate_content(df: DataFrame, key: str, digest: str) -> DataFrame:
    """Digests shared by more than one row, with the copy count."""
    return (df.groupBy(digest).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"),
                                   F.max(key).alias("last_key")).where("copies > 1"))


def pixel_digest(pixels: DataFrame, image: str) -> DataFrame:
    """Hash of shape, pixel type and pixels, as a digest of row digests: a list
    holds one pixel row, then one digest for each row of an image."""
    values = F.transform(F.sort_array(F.collect_list(F.struct("x", "value"))), lambda p: p["value"].cast("string"))
    per_row = pixels.groupBy(image, "y").agg(F.max("x").alias("_x"), F.sha2(F.array_join(values, ","), 256).alias("_row"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("y", "_row"))), lambda p: p["_row"])
    shape = F.concat_ws("x", F.max("y") + 1, F.max("_x") + 1)
    return per_row.groupBy(image).agg(
        F.sha2(F.concat_ws(",", shape, F.lit(dict(pixels.dtypes)["value"]), F.array_join(rows, ",")), 256).alias("content_sha256"))
