"""SimHash near-duplicates with a popcount embedding."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, bit_field, field_bits, in_field, steps, stored, text_buffers
from .pairs_graph import components
from .words import LOWER, mix, span_hashes, windows, word_spans

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Bits of one segment of the embedding, and groups of segments that form the axes of the grid.
SEGMENT_BITS, GROUPS = 2, 6
#: The stage's own rule beside op8's bits: words of a shingle and the least Jaccard similarity of near copies.
STAGE_SHINGLE, STAGE_JACCARD = 5, 0.8
#: Rows of which one is counted to order shingles, and the count from which one is common.
COUNT_EVERY, COMMON = 8, 4
#: Rounds of comparing with some rows of a bucket before all remaining pairs, and rows drawn from a bucket in such a round.
STARS, CENTRES = 2, 12
#: Cells above this many fingerprints are joined through common neighbours instead of pairs.
CELL = 32


def _majority(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Per row the bits that are set in over half of its values (sorted by row)."""
    out = np.zeros(n, np.uint64)
    if not len(values):
        return out
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    many = np.diff(np.r_[first, len(rows)])
    for bit in range(64):
        ones = np.add.reduceat((values >> np.uint64(bit)) & np.uint64(1), first)
        out[rows[first]] |= (2 * ones.astype(np.int64) > many).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` with ``fingerprint`` (64 bits as a long) of every whole text."""
    picked = df.select(text.alias("ll_text"), *columns)

    def compute(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            out = np.zeros(batch.num_rows, np.uint64)
            raw = data.tobytes()
            for a, b in steps(offsets):
                values, rows = [], []
                for i in range(a, b):
                    found = raw[offsets[i]: offsets[i + 1]].lower().split()
                    if len(found) > SHINGLE:
                        own = [digest(b" ".join(w), SEED) for w in zip(found, found[1:], found[2:])]
                    else:
                        own = [digest(b" ".join(found), SEED)] if found else []
                    values.append(np.array(own, np.uint64))
                    rows.append(np.full(len(own), i - a))
                out[a:b] = _majority(np.concatenate(values), np.concatenate(rows), b - a)
            yield batch_of({c: batch.column(k + 1) for k, c in enumerate(columns)} | {"fingerprint": out.view(np.int64)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(compute, f"{kinds}, fingerprint long")


def embedding(fingerprint: Column, bits: int = SEGMENT_BITS) -> Column:
    """Bit counts of the segments; the Manhattan distance of two embeddings is
    at most the number of differing bits of the fingerprints."""
    return F.array(*[F.bit_count(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << bits) - 1))) for at in range(0, 64, bits)])


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)


def grid_cells(counts: Column, most: int = MOST_BITS, groups: int = GROUPS) -> Column:
    """Cells of an embedding: the segments form ``groups`` axes.  Two embeddings
    within ``most`` agree on all but ``most`` axes at least, so that each way to
    leave ``most`` axes out gives one cell (its number and the counts on the
    other axes), and every pair in range meets in at least one cell."""
    n = 64 // SEGMENT_BITS
    edges = [round(n * g / groups) for g in range(groups + 1)]
    cells = []
    for no, axes in enumerate(combinations(range(groups), groups - most)):
        cells.append(F.xxhash64(F.lit(no), *[F.slice(counts, edges[g] + 1, edges[g + 1] - edges[g]) for g in axes]))
    return F.array(*cells)


def near_links(prints: DataFrame) -> DataFrame:
    """(a, b) links of distinct fingerprints that differ in ``MOST_BITS`` = 2
    bits or fewer, enough of them to connect whatever is connected.

    ``prints`` has distinct ``fingerprint``.  Cells of up to ``CELL``
    fingerprints are joined with themselves under the Manhattan bound and then
    verified bit by bit.  In a fuller cell every member instead emits itself
    and its 64 one-bit neighbours: two members within two bits share one of
    those, and members that share one are within two bits, so linking each to
    the smallest loses no connection and never makes pairs of a group.
    """
    counts = prints.select("fingerprint", embedding(F.col("fingerprint")).alias("counts"))
    cells = stored(counts.select("fingerprint", F.explode(grid_cells(F.col("counts"))).alias("cell")), "cells")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(cells.join(sizes, "cell"), "shared")
    small = shared.where(F.col("n") <= CELL).select("cell", "fingerprint", embedding(F.col("fingerprint")).alias("counts"))
    left = small.select("cell", F.col("fingerprint").alias("a"), F.col("counts").alias("x"))
    right = small.select("cell", F.col("fingerprint").alias("b"), F.col("counts").alias("y"))
    close = (F.col("a") < F.col("b")) & (manhattan(F.col("x"), F.col("y")) <= MOST_BITS)
    pairs = left.join(right, "cell").where(close).select("a", "b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS)
    full = shared.where(F.col("n") > CELL).select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    around = full.select("fingerprint", F.explode(F.transform(flips, lambda m: m.bitwiseXOR(F.col("fingerprint")))).alias("near"))
    hubs = around.groupBy("near").agg(F.min("fingerprint").alias("a"), F.collect_set("fingerprint").alias("members")).where(F.size("members") > 1)
    # A one-bit neighbourhood has at most 65 members.
    stars = hubs.select("a", F.explode("members").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def near_components(prints: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of (doc_id, fingerprint).

    Equal fingerprints are one class with their smallest doc_id; classes are
    linked, and component_id is the smallest doc_id of the connected classes.
    Rows without a doc_id are linked like any other; a component without any
    doc_id has a null component_id.  Repeated rows share their component.
    """
    classes = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "classes")
    member = components(near_links(classes.select("fingerprint"))).select(F.col("node").alias("fingerprint"), "component")
    placed = stored(classes.join(member, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component")), "placed")
    ids = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    found = placed.join(ids, "component").select(F.col("fingerprint").alias("own"), "component_id")
    return prints.join(found, F.col("fingerprint") == F.col("own")).select("doc_id", "fingerprint", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, fingerprint, component_id) of every row of ``docs``."""
    return near_components(stored(fingerprints(docs, ["doc_id"], F.col("text")), "prints"))


def simhash_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, fingerprint as 16 hex digits, component_id.
    Null, empty and wordless texts have fingerprint zero."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int, common: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(hash, row, place in the row, number of the row) of the distinct shingles
    of a range of rows, by row, then those outside the bit field ``common``
    first, then by hash.  A text of fewer than ``size`` words is one shingle."""
    starts, ends, rows = word_spans(data, offsets)
    own = span_hashes(data, starts, ends, LOWER)
    n = len(offsets) - 1
    hashes, at = windows(own, rows, size)
    rows_of, words = rows[at], np.bincount(rows, minlength=n)
    first = np.cumsum(words) - words
    for k in range(1, size):  # short texts
        short = np.flatnonzero(words == k)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(k):
                total = total * np.uint64(0x9E3779B97F4A7C15) + own[first[short] + j]
            hashes, rows_of = np.r_[hashes, mix(total + np.uint64(k))], np.r_[rows_of, short]
    often = in_field(common, hashes) if common is not None else np.zeros(len(hashes), bool)
    order = np.lexsort((hashes, often, rows_of))
    hashes, rows_of = hashes[order], rows_of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows_of[1:] != rows_of[:-1])
    hashes, rows_of = hashes[new], rows_of[new]
    many = np.bincount(rows_of, minlength=n)
    return hashes, rows_of, np.arange(len(hashes)) - (np.cumsum(many) - many)[rows_of], many[rows_of]


def _needed(jaccard: float, n):
    """Least whole number of shingles that is ``jaccard`` times ``n``."""
    return np.ceil(jaccard * n - 1e-9).astype(np.int64)


def _all_shingles(rows: DataFrame, size: int) -> DataFrame:
    """(shingle) of each row of (text, row), distinct within the row."""
    def compute(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in steps(offsets):
                yield batch_of({"shingle": shingle_sets(data, offsets[a: b + 1], size)[0].view(np.int64)})
    return rows.select("text", "row").mapInArrow(compute, "shingle long")


def _prefixes(rows: DataFrame, size: int, jaccard: float, common: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
    """(shingle, row, place, n): of n ordered shingles of a row the first
    n - jaccard * n + 1.  Two rows in range share one of them, since all that
    they share cannot lie behind the prefixes of both."""
    sc = rows.sparkSession.sparkContext
    common, wanted = sc.broadcast(common), sc.broadcast(wanted)

    def compute(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            ids = batch.column(1).to_numpy()
            for a, b in steps(offsets):
                hashes, own, place, n = shingle_sets(data, offsets[a: b + 1], size, common.value)
                keep = place <= n - _needed(jaccard, n)
                if wanted.value is not None:
                    keep &= in_field(wanted.value, hashes)
                yield batch_of({"shingle": hashes[keep].view(np.int64), "row": ids[own[keep] + a], "place": place[keep].astype(np.int32), "n": n[keep].astype(np.int32)})
    return rows.select("text", "row").mapInArrow(compute, "shingle long, row long, place int, n int")


def _picked_shingles(batches, size: int, wanted: np.ndarray):
    """(hashes, where each row's begin and end, row numbers) of the rows whose key may be wanted."""
    for batch in batches:
        picked = batch.filter(pa.array(in_field(wanted, batch.column(2).to_numpy().view(np.uint64))))
        data, offsets = text_buffers(picked.column(0))
        for a, b in steps(offsets):
            hashes, own, _, _ = shingle_sets(data, offsets[a: b + 1], size)
            yield hashes, np.searchsorted(own, np.arange(b - a + 1)), picked.column(1).slice(a, b - a)


def _sets(rows: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(row, shingles) of the rows whose key may be wanted."""
    wanted = rows.sparkSession.sparkContext.broadcast(wanted)

    def compute(batches):
        for hashes, ends, ids in _picked_shingles(batches, size, wanted.value):
            yield batch_of({"row": ids, "shingles": pa.ListArray.from_arrays(ends.astype(np.int32), hashes.view(np.int64))})
    return rows.select("text", "row", F.xxhash64("row").alias("key")).mapInArrow(compute, "row long, shingles array<bigint>")


def _outline(hashes: np.ndarray) -> bytes:
    """How many of a row's distinct shingles fall in each of a power of two of
    buckets (two to four in a bucket on average); empty if a count is too large."""
    if len(hashes) < 8:
        return b""
    counts = np.bincount((mix(hashes) & np.uint64((1 << (len(hashes).bit_length() - 2)) - 1)).astype(np.int64), minlength=1 << (len(hashes).bit_length() - 2))
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _most_shared(x: bytes, y: bytes) -> float:
    """At most so many shingles are shared by rows with these outlines: the sum
    of the smaller counts.  Of two sizes, the larger outline is folded."""
    if not x or not y:
        return np.inf
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    size = min(len(a), len(b))
    return float(np.minimum(a.reshape(-1, size).sum(0), b.reshape(-1, size).sum(0)).sum())


def _rows_of(rows: DataFrame, pairs: DataFrame) -> np.ndarray:
    """Bit field of the rows in pairs."""
    ids = stored(pairs.select(F.explode(F.array("a_row", "b_row")).alias("row")).distinct().select(F.xxhash64("row").alias("key")), "ids")
    return bit_field(ids, "key", field_bits(ids.count()))


def _outlines(rows: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(row, outline) of the rows whose key may be wanted."""
    wanted = rows.sparkSession.sparkContext.broadcast(wanted)

    def compute(batches):
        for hashes, ends, ids in _picked_shingles(batches, size, wanted.value):
            yield batch_of({"row": ids, "outline": pa.array([_outline(hashes[x:y]) for x, y in zip(ends[:-1], ends[1:])], pa.binary())})
    return rows.select("text", "row", F.xxhash64("row").alias("key")).mapInArrow(compute, "row long, outline binary")


def _similar(rows: DataFrame, pairs: DataFrame, size: int, jaccard: float) -> DataFrame:
    """The labels (a, b) of those pairs (a_row, b_row, a, b) whose exact
    similarity is ``jaccard`` or more.  Outlines, a small part of the shingles'
    bytes, first rule out the pairs that cannot share enough; only the rows of
    the others send their shingles."""
    outlines = stored(_outlines(rows, size, _rows_of(rows, pairs)), "outlines")
    a, b = (outlines.select(F.col("row").alias(f"{k}_row"), F.col("outline").alias(x)) for k, x in (("a", "x"), ("b", "y")))

    def hopeful(batches):
        for batch in batches:
            most = np.array([_most_shared(x, y) for x, y in zip(batch.column(6).to_pylist(), batch.column(7).to_pylist())])
            n = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            yield batch.select([0, 1, 2, 3]).filter(pa.array(most >= jaccard / (1 + jaccard) * n - 1e-9))
    both = pairs.join(a, "a_row").join(b, "b_row").select("a_row", "b_row", "a", "b", "a_n", "b_n", "x", "y")
    likely = stored(both.mapInArrow(hopeful, "a_row long, b_row long, a long, b long"), "likely")
    sets = stored(_sets(rows, size, _rows_of(rows, likely)), "sets")
    both = likely.join(sets.select(F.col("row").alias("a_row"), F.col("shingles").alias("x")), "a_row")
    both = both.join(sets.select(F.col("row").alias("b_row"), F.col("shingles").alias("y")), "b_row")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared >= jaccard * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b").distinct()


def jaccard_labels(rows: DataFrame, placed: DataFrame, nodes: DataFrame, size: int, jaccard: float) -> DataFrame:
    """``placed`` (fingerprint, label) with the labels of all rows connected
    whose sets of ``size``-word shingles have a similarity of ``jaccard`` or more.

    ``rows`` (text, row) is stored, ``nodes`` (row, fingerprint) has one row of
    each distinct text.  Prefixes give every pair in range; counts of a part of
    the rows only order the shingles, so that common ones come last.  Rows of
    one label need no comparison: the rows of a bucket are first compared with
    CENTRES drawn ones, twice, and what buckets then still hold of several
    labels in pairs.
    """
    some = rows.where(F.pmod(F.xxhash64("row"), F.lit(COUNT_EVERY)) == 0)
    often = stored(_all_shingles(some, size).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).select("shingle"), "often")
    common = bit_field(often, "shingle", field_bits(often.count()))
    repeated = _prefixes(rows, size, jaccard, common).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = stored(repeated.select("shingle"), "repeated")
    own = _prefixes(rows, size, jaccard, common, bit_field(repeated, "shingle", field_bits(repeated.count())))
    # Copies of a text have one row in nodes, so that their shingles are not repeated here.
    entries = stored(own.join(nodes, "row").join(repeated, "shingle", "left_semi"), "entries")
    for turn in range(STARS + 1):
        now = entries.join(placed, "fingerprint").drop("fingerprint")
        drawn = [F.min(F.struct(F.xxhash64(F.lit(turn * CENTRES + k), "row").alias("h"), "row", "n", "place", "label")).alias(f"c{k}") for k in range(CENTRES if turn < STARS else 0)]
        open_ = now.groupBy("shingle").agg(*drawn, F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
        fields = ("row", "n", "place", "label")
        # The first shingle that two rows share has all others behind it in both.
        far = lambda a, b: (a("label") != b("label")) & (F.least(a("n") - a("place"), b("n") - b("place")) >= jaccard / (1 + jaccard) * (a("n") + b("n")) - 1e-9)
        if turn < STARS:
            centres = open_.select("shingle", F.array_distinct(F.array(*[F.struct(*[F.col(f"c{k}.{c}").alias(c) for c in fields]) for k in range(CENTRES)])).alias("centres"))
            met = now.join(centres, "shingle").withColumn("c", F.explode(F.filter("centres", lambda c: far(lambda f: c[f], F.col))))
            pairs = met.select(*[F.col(f"c.{c}").alias(f"a_{c}") for c in fields], *[F.col(c).alias(f"b_{c}") for c in fields])
        else:
            now = stored(now.join(open_.select("shingle"), "shingle", "left_semi"), "open")
            left, right = (now.select("shingle", *[F.col(c).alias(f"{k}_{c}") for c in fields]) for k in "ab")
            pairs = left.join(right, "shingle").where((F.col("a_row") < F.col("b_row")) & far(lambda f: F.col(f"a_{f}"), lambda f: F.col(f"b_{f}")))
        pairs = stored(pairs.select("a_row", "b_row", F.col("a_label").alias("a"), F.col("b_label").alias("b"), "a_n", "b_n").distinct(), "pairs")
        if not pairs.isEmpty():
            moved = components(_similar(rows, pairs, size, jaccard)).select(F.col("node").alias("label"), "component")
            placed = stored(placed.join(moved, "label", "left").select("fingerprint", F.coalesce("component", "label").alias("label")), "placed")
    return placed


def simhash_stage(docs: DataFrame, size: int = STAGE_SHINGLE, jaccard: float = STAGE_JACCARD) -> DataFrame:
    """One document of each component stays, that of the smallest doc_id.

    Rows are linked by op8's rule and by an exact similarity of ``jaccard`` or
    more of their sets of ``size``-word shingles.  Each row is judged by its own
    component: it stays if it has the component's smallest doc_id.  Of a
    component without any doc_id one row stays; repeated rows of the document
    that stays count as that document and stay with it.
    """
    names = docs.columns
    docs = stored(docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("row")), "numbered")
    rows = docs.select(F.col(f"in_{names.index('text')}").alias("text"), F.col(f"in_{names.index('doc_id')}").alias("doc_id"), "row")
    prints = stored(fingerprints(rows.withColumn("same", F.xxhash64("text")), ["doc_id", "row", "same"], F.col("text")), "prints")
    member = components(near_links(prints.select("fingerprint").distinct())).select(F.col("node").alias("fingerprint"), "component")
    nodes = stored(prints.groupBy("fingerprint", "same").agg(F.min("row").alias("row")).select("row", "fingerprint"), "nodes")
    placed = stored(nodes.select("fingerprint").distinct().join(member, "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("label")), "placed")
    placed = jaccard_labels(rows, placed, nodes, size, jaccard)
    found = stored(prints.join(placed, "fingerprint").select("row", "doc_id", "label"), "found")
    least = found.groupBy("label").agg(F.min("doc_id").alias("least"), F.min("row").alias("first"))
    stays = found.join(least, "label").where((F.col("doc_id") == F.col("least")) | (F.col("least").isNull() & (F.col("row") == F.col("first")))).select("row")
    return docs.join(stays, "row", "left_semi").select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)])
