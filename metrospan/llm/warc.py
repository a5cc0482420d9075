"""WARC archives: writing, and reading with verified record boundaries."""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import shared_folder
from .frames import batch_of, stored

#: Fixed values of the format.
VERSION, END = "WARC/1.0\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of an archive that the writer aims at; a reading task holds one archive.
ARCHIVE_BYTES = 32 << 20
#: Upper ends of the record sizes that are written together, and the most bytes of an archive of several records.
RECORD_CLASSES, MOST_BYTES = [1 << 16, 1 << 20, 1 << 24], 1 << 30

SCHEMA = ("archive string, offset long, next long, record_id string, page_id long, record_type string, payload_bytes long, "
          "payload_digest string, refers_to long, verified boolean")
CANDIDATES = SCHEMA + ", archive_bytes long"


def write_archives(pages: DataFrame, path: str, least_bytes: int = 100) -> str:
    """One record per row of (page_id, url, html), as text files under ``path``.

    Of equal payloads of ``least_bytes`` or more, the smallest page_id is a
    response (rows that repeat it are responses too), the others are revisits:
    a block of HTTP headers without the payload.  Null html is an empty
    payload; a null page_id is never the smallest; line ends in a URL are
    percent-encoded.  Only digests are shuffled to find equal payloads.
    Records of like size are written together, so that an archive holds
    MOST_BYTES at most, or one record.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    light = rows.select("page_id", "digest", "bytes")
    first = light.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Written, so that the planner knows its size before it decides how to join the pages.
    repeated = stored(first.where("n > 1 and first is not null").select("digest", "first"), "repeated")
    # Records of a class have a least upper size, which bounds an archive of so many of them.
    length = F.col("bytes") + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + 700
    group = F.lit(len(RECORD_CLASSES))
    for k in reversed(range(len(RECORD_CLASSES))):
        group = F.when(length <= RECORD_CLASSES[k], k).otherwise(group)
    found = {r["g"]: r["mean"] for r in rows.groupBy(group.alias("g")).agg(F.avg(length).alias("mean")).collect()} or {0: 1.0}
    rows = rows.join(repeated, "digest", "left")
    revisit = F.coalesce(F.col("bytes") >= least_bytes, F.lit(False)) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = "\r\n"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    record = F.concat(
        F.lit(VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(line),
        F.lit("WARC-Record-ID: <urn:page:"), number, F.lit(">" + line), F.lit(f"WARC-Date: {DATE}{line}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), uri, F.lit(line)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit(line),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{line}WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">" + line))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block)
    records = rows.select(record.alias("value"), group.alias("g"))
    for g, mean in sorted(found.items()):
        each = int(min(ARCHIVE_BYTES / mean, MOST_BYTES / RECORD_CLASSES[g])) if g < len(RECORD_CLASSES) else 1
        records.where(F.col("g") == g).select("value").write.mode("append").option("lineSep", END).option("maxRecordsPerFile", max(1, each)).text(path)
    return path


_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def _block(content: bytes, head: int, fields: dict) -> dict | None:
    """What follows the header that ends at ``head``; None without a length or
    if the record's end is not where its length says."""
    length = fields.get(b"content-length", (b"",))[0]
    if not length.isdigit():
        return None
    start, end = head + 4, head + 4 + int(length)
    if content[end: end + 4] != END.encode():
        return None
    split = content.find(b"\r\n\r\n", start, end)
    inner = {k.lower(): v for k, v in _FIELD.findall(content[start: split])} if split >= 0 else {}
    payload = memoryview(content)[split + 4: end] if split >= 0 else memoryview(content)[start:end]
    said = inner.get(b"content-length", b"")
    return {"next": end + 4, "bytes": len(payload), "own": hashlib.sha256(payload).hexdigest(), "said": int(said) if said.isdigit() else None}


def _records(content: bytes) -> list[dict]:
    """Every place that reads like a whole record.  Places before one header
    end share what follows it and its fields, the last of each name, as far as
    they start before them."""
    rows, head, fields, block = [], -1, {}, None
    for m in re.finditer(re.escape(VERSION.encode()), content):
        at = m.start()
        if head < at:
            head = content.find(b"\r\n\r\n", at)
            if head < 0:
                break
            first = at + len(VERSION)
            fields = {f[1].lower(): (f[2], first + f.start()) for f in _FIELD.finditer(content[first:head])}
            block = _block(content, head, fields)
        if block is None:
            continue
        field = lambda k: v[0] if (v := fields.get(k, (b"", -1)))[1] >= at else b""
        if not field(b"content-length"):
            continue
        kind = field(b"warc-type").decode("ascii", "replace")
        digest = field(b"warc-payload-digest").decode("ascii", "replace").removeprefix("sha256:")
        if kind == "revisit":
            size, right = block["said"], True
        else:
            size, right, digest = block["bytes"], digest in ("", block["own"]), block["own"]
        number = lambda x: int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", x)) else None
        rows.append({"offset": at, "next": block["next"], "record_id": field(b"warc-record-id").decode("utf-8", "replace"), "page_id": number(field(b"warc-record-id")),
                     "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number(field(b"warc-refers-to")), "verified": right})
    return rows


def _candidates(batches):
    names = [f.split()[0] for f in CANDIDATES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in CANDIDATES.split(", ")]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = content.as_py() or b""
            rows = _records(content) or ([{"offset": -1, "next": -1}] if content else [])  # an archive without records is known by its length
            fixed = {"archive": path, "archive_bytes": len(content)}
            yield pa.RecordBatch.from_arrays([pa.array([(r | fixed).get(n) for r in rows], t) for n, t in zip(names, types)], names=names)


def candidate_records(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives that reads like a whole record, with the
    offset of its successor; payloads may hold such places too."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_candidates, CANDIDATES)


def _reachable(table: pa.Table) -> pa.Table:
    """Records of one archive that its start reaches, by pointer jumping: the
    marks of reached records move along the pointers, the pointers double."""
    table = table.sort_by("offset")
    offset = table["offset"].to_numpy()
    at = np.searchsorted(offset, table["next"].to_numpy())
    n = len(offset)
    jump = np.append(np.where((at < n) & (offset[np.minimum(at, n - 1)] == table["next"].to_numpy()), at, n), n)
    reached = np.append(offset == 0, False)
    for _ in range(max(1, n.bit_length())):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    reached[n] = False
    return table.filter(pa.array(reached[:n]))


def _whole(table: pa.Table) -> pa.Table:
    """The records of one archive; an error if they do not end where it ends."""
    found, size = _reachable(table), table["archive_bytes"][0].as_py()
    end = found["next"][-1].as_py() if found.num_rows else 0
    if end != size:
        raise ValueError(f"{table['archive'][0]}: records end at byte {end} of {size}")
    return found.drop_columns(["archive_bytes"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives under ``path``: candidates that the boundary
    chain from the start of their file reaches.  A group is the candidates of
    one archive, without payloads; its size is bounded by that of an archive.
    An archive whose chain ends before its last byte is an error."""
    return candidate_records(spark, path).groupBy("archive").applyInArrow(_whole, SCHEMA)


def warc_query(pages: DataFrame) -> DataFrame:
    """Every row of ``pages`` written to archives and read back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
