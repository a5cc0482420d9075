"""Removal of byte strings that occur earlier in the corpus, with suffix arrays of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shuffle_width
from .frames import batch_of, steps, stored, text_buffers
from .induced import common_prefixes, suffix_array
from .words import RAW, _power, mix, span_hashes

#: Bytes of a string that must not repeat, and of the anchors inside it.
LENGTH, ANCHOR = 100, 32
_WINDOW = LENGTH - ANCHOR + 1
#: Two equal strings that share an anchor also share this many bytes beside it, on its left or on its right.
_BESIDE = _WINDOW // 2
#: Bytes of one shard's text; passages of one anchor in one shard (more are dealt over several shards).
SHARD_BYTES, SHARD_PASSAGES = 2 << 20, 16384
_PIECE = 1 << 18
_U = np.uint64
_PLACE = _U((1 << 22) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of ``width`` values, from running minima of fixed blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, ~_U(0))
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1: width - 1 + n])


def passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Passages of the rows data[bounds[i]:bounds[i + 1]]: hash of the anchor,
    hash of the bytes, row, start (in ``data``), strings, anchor's offset.

    Every string of LENGTH bytes has an anchor, the ANCHOR bytes of least hash
    in it (the leftmost of equal ones).  A passage is a longest run of strings
    with one anchor.  Equal strings have their anchor at the same place, so
    that they lie in passages with equal anchors, at the same distance from it.
    """
    a, n = int(bounds[0]), int(bounds[-1] - bounds[0])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.view(np.uint64), none.view(np.uint64), none, none, none, none
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(RAW[data[a: a + n]] * up[:n], out=sums[1:])
    grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    least = (_sliding_least(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), _WINDOW) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = row[: n - LENGTH + 1] == row[LENGTH - 1:]
    changes = np.flatnonzero((least[1:] != least[:-1]) | (row[1: len(least)] != row[: len(least) - 1])) + 1
    first, last = np.append(0, changes), np.append(changes, len(least)) - 1
    # The strings of one row lie together, before those that run into the next row.
    first, last = first[whole[first]], last[whole[first]]
    fits = np.append(np.cumsum(whole), 0)
    last = first + fits[last] - fits[first]
    end = last + LENGTH
    own = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    return grams[least[first]], own, row[first], first + a, last - first + 1, least[first] - first


def _pieces(offsets: np.ndarray):
    """(first row, bounds) of ranges of rows; a long row comes in several
    pieces that overlap, so that every string lies in just one of them."""
    for a, b in steps(offsets, _PIECE):
        start, end = int(offsets[a]), int(offsets[b])
        if b - a > 1 or end - start <= 4 * _PIECE:
            yield a, offsets[a: b + 1]
        else:
            for at in range(start, end - LENGTH + 1, _PIECE):
                yield a, np.array([at, min(end, at + _PIECE + LENGTH - 1)])


def _kinds(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def passage_rows(docs: DataFrame) -> DataFrame:
    """(anchor, own, doc_id, tie, at, strings, inner) of every passage of (text, doc_id, tie)."""
    def compute(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, bounds in _pieces(offsets):
                anchor, own, row, start, many, inner = passages(data, bounds)
                row = row + a
                yield batch_of({"anchor": anchor.view(np.int64), "own": own.view(np.int64), "doc_id": batch.column(1).take(pa.array(row)), "tie": batch.column(2).take(pa.array(row)),
                                "at": (start - offsets[row]).astype(np.int32), "strings": many.astype(np.int16), "inner": inner.astype(np.int16)})
    return docs.select("text", "doc_id", "tie").mapInArrow(compute, f"anchor long, own long, doc_id {_kinds(docs)}, tie long, at int, strings short, inner short")


def _changes(column) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a, b = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def _judge(batches):
    """Of passages in order (anchor, own, document, place): those after the
    first of their bytes (kind 0), and first ones whose anchor has other bytes
    too (kind 1).  What lies before and behind the partition is not seen: its
    first and last passages of a kind count as if they had such neighbours, so
    that the shards compare them."""
    names = ["anchor", "own", "doc_id", "tie", "at", "strings", "inner"]
    held = None  # the last first passage and whether it is known to have neighbours
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch.select(names)])
        near = True
        if held is not None:
            table, near = pa.concat_tables([held[0], table]), held[1]
        anchor, own = table["anchor"].to_numpy(), table["own"].to_numpy()
        fresh = np.append(True, (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1]))
        moved = np.append(True, fresh[1:] | _changes(table["doc_id"]) | _changes(table["tie"]) | _changes(table["at"]))
        first = np.flatnonzero(fresh)
        before = np.append(near, anchor[first[1:]] == anchor[first[:-1]])
        after = np.append(before[1:], False)
        # Repeated rows equal the row before; the first of a kind may come again behind others only in the next batch.
        leader = first[np.cumsum(fresh) - 1]
        kind = np.where(fresh, np.where(np.repeat(before | after, np.diff(np.append(first, len(anchor)))), 1, 2), 0)
        kind[~moved & (leader == np.maximum.accumulate(np.where(moved, np.arange(len(anchor)), 0)))] = 2
        kind[first[-1]] = 2
        held = table.slice(int(first[-1]), 1), bool(before[-1])
        yield _picked(table, kind)
    if held is not None:
        yield _picked(held[0], np.array([1]))


def _picked(table: pa.Table, kind: np.ndarray) -> pa.RecordBatch:
    rows = np.flatnonzero(kind < 2)
    return table.take(pa.array(rows)).append_column("kind", pa.array(kind[rows].astype(np.int8))).combine_chunks().to_batches()[0] if len(rows) else \
        pa.RecordBatch.from_pylist([], schema=table.schema.append(pa.field("kind", pa.int8())))


def flagged_passages(docs: DataFrame) -> DataFrame:
    """Stored passages with ``kind`` (see ``_judge``).  One range sort brings
    equal passages together; it orders by document and place as well, so that
    a passage of very many documents spans many partitions."""
    rows = passage_rows(docs)
    order = ["anchor", "own", F.col("doc_id").asc_nulls_last(), "tie", "at"]
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(_judge, rows.schema.add("kind", "byte")), "passages")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["own_id"]) & (a["tie"] == b["own_tie"])


def shard_texts(docs: DataFrame, contested: DataFrame, shard_bytes: int = SHARD_BYTES, most: int = SHARD_PASSAGES) -> DataFrame:
    """(shard, anchor, split, doc_id, tie, at, strings, inner, body) of contested passages.

    Passages of one anchor go to one shard; those of an anchor with more than
    ``most`` are ``split`` over several, by document.  Shards are as many as
    make ``shard_bytes`` on average.
    """
    total = contested.agg(F.sum(F.col("strings") + F.lit(LENGTH - 1))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    hot = stored(contested.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "split")
    dealt = contested.join(hot, "anchor", "left").withColumn("split", F.col("n").isNotNull())
    salt = F.when(F.col("split"), F.pmod(F.xxhash64("doc_id", "tie"), F.ceil(F.col("n") / most))).otherwise(0)
    entry = F.struct(F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int").alias("shard"), "anchor", "split", "at", "strings", "inner")
    lists = dealt.groupBy(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie")).agg(F.collect_list(entry).alias("entries"))
    both = docs.join(lists, _same_document(docs, lists)).select("text", "doc_id", "tie", "entries")
    names = ["shard", "anchor", "split", "at", "strings", "inner"]

    def cut(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            entries = batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(entries).to_numpy(zero_copy_only=False))
            flat = pa.RecordBatch.from_struct_array(entries.flatten())
            at = flat.column(3).to_numpy() + offsets[row]
            end = at + flat.column(4).to_numpy() + LENGTH - 1
            for a in range(0, len(row), 4096):
                b = min(len(row), a + 4096)
                own = pa.array(row[a:b])
                yield batch_of({n: flat.column(k).slice(a, b - a) for k, n in enumerate(names)} | {"doc_id": batch.column(1).take(own), "tie": batch.column(2).take(own),
                               "body": pa.array([data[x:y].tobytes() for x, y in zip(at[a:b].tolist(), end[a:b].tolist())], pa.binary())})
    texts = both.mapInArrow(cut, f"shard int, anchor long, split boolean, at int, strings short, inner short, doc_id {_kinds(docs)}, tie long, body binary")
    # Sorting costs far more than its bytes suggest, so the number of tasks is not left to their size.
    return texts.repartition(int(min(shards, 8 * shuffle_width(docs.sparkSession))), "shard")


def _hopeful(anchor: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Whether another passage of the anchor has the same _BESIDE bytes on its left, or on its right."""
    out = np.zeros(len(anchor), bool)
    at = start + inner
    for a, b in ((at - _BESIDE, at), (at + ANCHOR, at + ANCHOR + _BESIDE)):
        rows = np.flatnonzero((a >= start) & (b <= end))
        key = span_hashes(data, a[rows], b[rows]) ^ mix(anchor[rows].view(np.uint64))
        _, number, many = np.unique(key, return_inverse=True, return_counts=True)
        out[rows] |= many[number] > 1
    return out


def _shard(table: pa.Table) -> pa.Table:
    """One shard: spans of strings that occur earlier in it, and, of split
    anchors, the digests of those that do not.  Passages are laid out by
    document and place, so that the first of equal suffixes is the earliest."""
    kinds = pa.schema([("doc_id", table.schema.field("doc_id").type), ("tie", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("window", pa.binary())])
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("tie", "ascending"), ("at", "ascending")], null_placement="at_end")).combine_chunks()
    table = table.filter(pa.array(np.append(True, _changes(table["doc_id"]) | _changes(table["tie"]) | _changes(table["at"]))))
    for hopeful in (True, False):  # first without the passages that cannot share a string, then the rest
        data, end = _laid_out(table["body"])
        start = np.append(0, end[:-1] + 1)
        if hopeful:
            keep = _hopeful(table["anchor"].to_numpy(), data, start, end, table["inner"].to_numpy().astype(np.int64))
            table = table.filter(pa.array(keep | table["split"].to_numpy()))
    if not table.num_rows:
        return kinds.empty_table()
    text = data.astype(np.int64) + 2
    text[end] = 1
    text = np.append(text, 0)
    order = suffix_array(text)
    shared = common_prefixes(text, order)
    room = np.zeros(len(text), np.int64)
    room[:-1] = np.repeat(end, end - start + 1) - np.arange(len(text) - 1)
    string = room[order] >= LENGTH
    opens = ~string | (shared[order] < LENGTH)
    opens[1:] |= ~string[:-1]
    opens[0] = True
    opens, places = np.flatnonzero(opens[string]), order[string]
    least = np.repeat(np.minimum.reduceat(places, opens), np.diff(np.append(opens, len(places))))
    again = np.zeros(len(text), bool)
    again[places[places != least]] = True
    # Runs of repeated strings of one passage; the byte behind a passage is never in one.
    step = np.diff(np.append(0, again.astype(np.int8)))
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = np.searchsorted(end, a)
    place = table["at"].to_numpy() - start
    spans = {"row": row, "start": a + place[row], "end": b - 1 + LENGTH + place[row], "window": pa.nulls(len(a), pa.binary())}
    firsts = np.unique(least)
    of = np.searchsorted(end, firsts)
    firsts, of = firsts[table["split"].to_numpy()[of]], of[table["split"].to_numpy()[of]]
    raw = data.tobytes()
    digests = pa.array([hashlib.blake2b(raw[p: p + LENGTH], digest_size=16).digest() for p in firsts.tolist()], pa.binary())
    seeds = {"row": of, "start": firsts + place[of], "end": firsts + LENGTH + place[of], "window": digests}
    out = pa.concat_tables([pa.table(x) for x in (spans, seeds)])
    own = table.take(out["row"])
    return pa.table({"doc_id": own["doc_id"], "tie": own["tie"], "start": out["start"], "end": out["end"], "window": out["window"]}).cast(kinds)


def _laid_out(bodies: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bodies, each with one byte behind it, and the places of those bytes."""
    parts = bodies.to_pylist()
    data = np.frombuffer(b"\0".join(parts) + b"\0" if parts else b"", np.uint8)
    return data, np.cumsum(np.array([len(p) + 1 for p in parts], np.int64)) - 1


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, start, end) of byte ranges of LENGTH bytes or more whose
    strings of LENGTH bytes all occur earlier; together they cover all such
    strings.  ``docs`` has text, doc_id and tie."""
    flagged = flagged_passages(docs)
    copies = flagged.where("kind = 0").select("doc_id", "tie", F.col("at").cast("long").alias("start"), (F.col("at") + F.col("strings") + F.lit(LENGTH - 1)).cast("long").alias("end"))
    texts = shard_texts(docs, flagged.where("kind = 1"))
    found = stored(texts.groupBy("shard").applyInArrow(_shard, f"doc_id {_kinds(docs)}, tie long, start long, end long, window binary"), "spans")
    spans = copies.union(found.where("window is null").drop("window"))
    # Strings of split anchors: the first of each shard against those of the others.
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "start")
    seeds = found.where("window is not null")
    first = seeds.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return spans.union(seeds.join(first, "window").where(~place.eqNullSafe(F.col("first"))).select("doc_id", "tie", "start", "end"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, spans (the removed byte
    ranges, in order), kept (the remaining bytes, as binary).

    A byte goes if a string of LENGTH bytes over it also starts earlier, in a
    document of smaller doc_id or further ahead in the same one.  All strings
    are judged on the input.  Null texts are empty.  Null ids come last.  Rows
    that repeat both id and text are one document and get equal results; rows
    that share only their id are ordered by a hash of their texts.

    Texts move twice, to cut the contested passages and to remove the spans;
    all else moves hashes.  Anchors cut texts into passages (``passages``); a
    range sort finds equal ones; only passages that share their anchor but not
    their bytes are compared by suffix arrays, in shards of bounded size.
    """
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    shared = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("tie", F.lit(0).cast("long") if shared else F.xxhash64("text"))
    spans = repeated_spans(rows)
    lists = spans.groupBy(F.col("doc_id").alias("own_id"), F.col("tie").alias("own_tie")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = rows.join(lists, _same_document(rows, lists), "left").select("text", "doc_id", "spans")

    def remove(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in steps(offsets):
                kept, cuts = [], []
                for k in range(a, b):
                    own, given = data[offsets[k]: offsets[k + 1]], batch.column(2)[k]
                    start, end = _merged(pa.RecordBatch.from_struct_array(given.values)) if given.is_valid else (np.zeros(0, np.int64),) * 2
                    pieces = zip(np.append(0, end).tolist(), np.append(start, len(own)).tolist())
                    kept.append(b"".join(own[x:y].tobytes() for x, y in pieces))
                    cuts.append([{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())])
                yield batch_of({"doc_id": batch.column(1).slice(a, b - a), "n_bytes": np.diff(offsets[a: b + 1]), "spans": pa.array(cuts, kind), "kept": pa.array(kept, pa.binary())})
    return both.mapInArrow(remove, f"doc_id {_kinds(rows)}, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")


def _merged(spans: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as maximal ranges in order."""
    start, end = spans.column(0).to_numpy(), spans.column(1).to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def substring_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = remove_repeats(docs)
    return rows.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
