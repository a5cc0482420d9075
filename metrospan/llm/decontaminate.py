"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, bit_field, in_field, steps, stored, text_buffers
from .words import _BASE, _power, mix, span_hashes, word_spans

#: Words of a window, least literal words of a template, least coverage and consistency.
WINDOW, LITERALS, COVERAGE, CONSISTENCY = 5, 3, 0.8, 0.8
#: Bits of the filter that keeps documents' windows off the shuffle: fixed, whatever the benchmark's size.
FILTER_BITS = 1 << 23
#: Unit words that count as a slot after a number.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers mg g kg lb lbs oz gram grams "
         "kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres gallon gallons cup cups s sec second seconds min minute "
         "minutes h hr hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees mph kmh").split()
_U = np.uint64
#: Placeholders: typed constants in place of word hashes.
_NUMBER, _NAME, _UNIT = (mix(np.array([k], np.uint64))[0] for k in (101, 102, 103))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORD_BYTES = _WORD.tobytes()
_LOWER_BYTES = bytes(range(256)).lower()
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n\"'("]] = True
#: Longest word hashed by its 8-byte pieces; longer ones by running sums over their bytes.
_PIECES = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _word_hashes(own: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word ``own[start:end]``, ASCII letters lower-cased."""
    low = np.frombuffer(own.tobytes().translate(_LOWER_BYTES) + bytes(8), np.uint8)
    eight = np.ndarray((len(own) + 1,), np.uint64, low, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _MASKS[np.minimum(size, 8)]) + size.astype(np.uint64) * _U(_BASE))
    for done in range(8, _PIECES, 8):
        more = np.flatnonzero((size > done) & (size <= _PIECES))
        if not len(more):
            break
        out[more] = mix(out[more] * _U(_BASE) + (eight[starts[more] + done] & _MASKS[np.minimum(size[more] - done, 8)]))
    long = np.flatnonzero(size > _PIECES)
    if len(long):
        out[long] = span_hashes(low, starts[long], ends[long])
    return out


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    return np.sort(_word_hashes(data, ends - [len(w) for w in words], ends))


_UNIT_HASHES = _hash_words(UNITS)


def _digit(x: np.ndarray) -> np.ndarray:
    return (x >= 48) & (x < 58)


def _upper(x: np.ndarray) -> np.ndarray:
    return (x >= 65) & (x < 91)


def _solid_before(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the last byte before each word that is not a space, or -1."""
    before = at - 1
    for _ in range(4):
        spaces = np.flatnonzero((own[np.maximum(before, 0)] == 32) & (before >= 0)) if len(at) else before
        if not len(spaces):
            return before
        before[spaces] -= 1
    solid = np.append(np.flatnonzero(own != 32), len(own))
    place = np.searchsorted(solid, at) - 1
    return np.where(place >= 0, solid[place], -1)


def word_kinds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(value hash, row, is number, is unit, is capitalised, is inside a
    sentence) of each word of a range of rows.

    Words are runs of letters, digits and bytes above ASCII, with points and
    commas between digits; a unit is a unit word after a number; a capitalised
    word has one leading capital, and may be a name wherever it stands.
    """
    own = data[offsets[0]: offsets[-1]]
    word = np.frombuffer(bytearray(own.tobytes().translate(_WORD_BYTES)), bool)
    points = np.flatnonzero((own == 46) | (own == 44))
    points = points[(points > 0) & (points < len(own) - 1)]
    word[points[_digit(own[points - 1]) & _digit(own[points + 1])]] = True
    starts, ends, rows = word_spans(data, offsets, ~word)
    at, to = starts - offsets[0], ends - offsets[0]
    values = _word_hashes(own, at, to)
    # A number begins with a digit (or a point between digits) and has no letter.
    number = own[at] < 58
    some = np.flatnonzero(number)
    if len(some):
        size = to[some] - at[some]
        first = np.cumsum(size) - size
        inner = own[np.arange(int(size.sum())) + np.repeat(at[some] - first, size)]
        number[some] = np.add.reduceat((inner >= 58).astype(np.int64), first) == 0
    capital = _upper(own[at]) & ((ends - starts < 2) | ~_upper(own[np.minimum(at + 1, len(own) - 1)])) if len(at) else np.zeros(0, bool)
    before = _solid_before(own, at)
    opens = (before < offsets[rows] - offsets[0]) | (at == 0)
    stop = _STOP[own[np.maximum(before, 0)]] if len(at) else opens
    unit = np.zeros(len(values), bool)
    if len(values) > 1:
        pos = np.minimum(np.searchsorted(_UNIT_HASHES, values[1:]), len(_UNIT_HASHES) - 1)
        unit[1:] = number[:-1] & (_UNIT_HASHES[pos] == values[1:]) & (rows[1:] == rows[:-1])
    return values, rows, number, unit, capital & ~number & ~unit, ~(opens | stop)


def _ranges(template: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each run of words ``template[start:end]``."""
    up, down = _power(len(template) + 1)
    sums = np.zeros(len(template) + 1, np.uint64)
    np.cumsum(template * up[: len(template)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) + mix(np.array([salt], np.uint64)))


def _slot_lists(start: np.ndarray, end: np.ndarray, values: np.ndarray, slot: np.ndarray, names: np.ndarray | None = None) -> pa.Array:
    """Per run of words the values of its slots, in order; ``names`` has bits of
    further slots of each run, by place."""
    size = end - start
    ends = np.cumsum(size)
    place = np.arange(int(size.sum())) - np.repeat(ends - size, size)
    index = np.repeat(start, size) + place
    mask = slot[index]
    if names is not None:
        mask = mask | (np.repeat(names, size) >> place & 1).astype(bool)
    many = np.concatenate([[0], np.cumsum(mask)])[np.concatenate([[0], ends])]
    return pa.ListArray.from_arrays(many.astype(np.int32), values[index][mask].view(np.int64))


def template_windows(data: np.ndarray, offsets: np.ndarray, sizes: list[int]):
    """Yields (window hash, row, word of the row, slot lists of picked windows, size)
    of all windows of ``sizes`` words, in every reading.

    Each capitalised word is read as a name and as a literal word.  A reading
    with ``LITERALS`` literal words or more is a template.  Windows of
    ``WINDOW`` words that hold fewer are widened to the right, and to the left,
    until they have so many, with all names, those inside sentences, or none.
    A window whose numbers and units alone leave too few is keyed by its own
    words as well, so that a copy is found word for word.
    """
    values, rows, number, unit, capital, inside = word_kinds(data, offsets)
    n = len(values)
    if not n:
        return
    first = np.searchsorted(rows, np.arange(len(offsets)))
    hard = number | unit
    plain = np.where(number, _NUMBER, np.where(unit, _UNIT, values))
    total = lambda x: np.concatenate([[0], np.cumsum(x)])
    hards = total(hard)
    for size in sizes:
        m = max(0, n - size + 1)
        at = np.flatnonzero(rows[:m] == rows[size - 1:])
        if not len(at):
            continue
        fixed = (hards[size:] - hards[: m])[at]
        if size >= LITERALS:
            sums, bits = np.zeros(m, np.uint64), np.zeros(m, np.uint8)
            for k in range(size):
                sums = sums * _U(_BASE) + plain[k: k + m]
                bits |= capital[k: k + m].astype(np.uint8) << k
            own = at[fixed <= size - LITERALS]
            yield mix(sums[own] + _U(size)), rows[own], own - first[rows[own]], lambda keep, o=own: _slot_lists(o[keep], o[keep] + size, values, hard), size
            # Readings with names differ from the plain one by their names alone.
            named = np.flatnonzero((bits[at] > 0) & (fixed < size - LITERALS + 1))
            some, spare = at[named], size - LITERALS - fixed[named]
            bits, sums = bits[some], sums[some]
            change = [(_NAME - plain[some + k]) * _U(pow(_BASE, size - 1 - k, 1 << 64)) for k in range(size)]
            for names in range(1, 1 << size):
                count = names.bit_count()
                if size - count < LITERALS:
                    continue
                i = np.flatnonzero((bits & names == names) & (spare >= count))
                if not len(i):
                    continue
                own, hashes = some[i], sums[i]
                for k in range(size):
                    if names >> k & 1:
                        hashes = hashes + change[k][i]
                yield mix(hashes + _U(size)), rows[own], own - first[rows[own]], lambda keep, o=own, m=names: _slot_lists(o[keep], o[keep] + size, values, hard, np.full(int(keep.sum()), m)), size
        dense = at[size - fixed < LITERALS]
        if len(dense):
            hashes = np.zeros(len(dense), np.uint64)
            for k in range(size):
                hashes = hashes * _U(_BASE) + values[dense + k]
            yield mix(hashes + _U(size) + mix(np.array([1], np.uint64))), rows[dense], dense - first[rows[dense]], lambda keep, o=dense: _slot_lists(o[keep], o[keep] + size, values, np.zeros(n, bool)), size
    if WINDOW not in sizes:
        return
    at = np.flatnonzero(rows[: max(0, n - WINDOW + 1)] == rows[WINDOW - 1:])
    open_words = total(hard | capital)
    at = at[open_words[at + WINDOW] - open_words[at] > WINDOW - LITERALS]  # the others hold enough words in every reading
    done = []
    for name in (np.zeros(n, bool), capital & inside, capital):
        if any((name == x).all() for x in done):
            continue
        done.append(name)
        slot = hard | name
        template, words = np.where(name, _NAME, plain), total(~slot)
        few = at[words[at + WINDOW] - words[at] < LITERALS]
        end = np.searchsorted(words, words[few] + LITERALS)
        start = np.searchsorted(words, words[few + WINDOW] - LITERALS, "right") - 1
        right, left = end <= first[rows[few] + 1], start >= first[rows[few]]
        for salt, own, s, e in ((2, few[right], few[right], end[right]), (3, few[left], start[left], few[left] + WINDOW)):
            if len(own):
                yield _ranges(template, s, e, salt), rows[own], own - first[rows[own]], lambda keep, s=s, e=e, slot=slot: _slot_lists(s[keep], e[keep], values, slot), WINDOW


def _rows(df: DataFrame) -> str:
    return f"id {df.schema['id'].dataType.simpleString()}, win long, pos int, slots array<bigint>"


def _alone(data: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """By word: whether the ``size`` words from there are a whole line or sentence."""
    _, rows, _, _, _, inside = word_kinds(data, offsets)
    opens = np.append(~inside, True)
    opens[:-1] |= np.append(True, rows[1:] != rows[:-1])[: len(rows)]
    at = np.arange(len(rows))
    return opens[:-1] & opens[np.minimum(at + size, len(rows))]


def _emit(ids, hashes, rows, pos, slots, keep, a):
    return batch_of({"id": ids.take(pa.array(rows[keep] + a)), "win": hashes[keep].view(np.int64), "pos": pos[keep].astype(np.int32), "slots": slots(keep)})


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, win, pos, slots, size) of the items' windows, and (id, n) their numbers.
    Items of equal text are one, with the smallest item_id; an item of fewer
    than ``WINDOW`` words is one window of its own length."""
    items = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("id"))

    def emit(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            ids = batch.column(1)
            for a, b in steps(offsets):
                part = offsets[a: b + 1]
                words = np.bincount(word_kinds(data, part)[1], minlength=b - a)
                for size in range(1, WINDOW + 1):
                    for hashes, rows, pos, slots, _ in template_windows(data, part, [size]):
                        keep = (words[rows] == size) | (words[rows] >= size) & (size == WINDOW)
                        yield _emit(ids, hashes, rows, pos, slots, keep, a).append_column("size", pa.array(np.full(int(keep.sum()), size, np.int32)))

    items = items.where("id is not null").select("text", "id")
    found = stored(items.mapInArrow(emit, _rows(items) + ", size int").distinct(), "items")
    return found, found.groupBy("id").agg(F.countDistinct("pos").alias("n"))


def window_filter(found: DataFrame) -> np.ndarray:
    """Fixed-size bit field of the benchmark's windows (one bit a window)."""
    return bit_field(found, "win", FILTER_BITS)


def document_windows(docs: DataFrame, ident: Column, text: Column, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(id, win, pos, slots) of the documents' windows that may be in the
    benchmark, whose windows have the ``sizes``."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def emit(batches):
        field = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            ids = batch.column(1)
            for a, b in steps(offsets):
                part = offsets[a: b + 1]
                for hashes, rows, pos, slots, size in template_windows(data, part, sizes):
                    keep = in_field(field, hashes)
                    if size < LITERALS and keep.any():
                        first = np.searchsorted(word_kinds(data, part)[1], np.arange(b - a + 1))
                        keep &= _alone(data, part, size)[first[rows] + pos]
                    if keep.any():
                        yield _emit(ids, hashes, rows, pos, slots, keep, a)

    rows = docs.select(text.alias("text"), ident.alias("id")).where("text is not null and id is not null")
    return rows.mapInArrow(emit, _rows(rows))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, reparameterised) of documents
    that hold a benchmark item, one row for each such pair.

    Windows of ``WINDOW`` canonical words are joined by hash.  Matches on one
    diagonal (document position less item position) must fill the item's slots
    consistently: each slot value of the item stands for one value of the
    document in at least ``consistency`` of its values.  A pair counts when the
    consistent diagonals cover at least ``coverage`` of the item's windows; it
    is re-parameterised when some slot has another value than in the item.
    An item of one or two words counts only where it is a whole line or
    sentence.  Ids of any type are kept as they are.  Documents with null id or
    text, and empty tables, give no rows; repeated rows give one.
    """
    items, sizes = benchmark_windows(benchmark)
    lengths = [r["size"] for r in items.select("size").distinct().collect()]  # WINDOW of them at most
    mine = document_windows(docs, F.col("doc_id"), F.col("text"), window_filter(items), sorted(lengths))
    item = items.select("win", F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    match = stored(mine.distinct().join(item, "win").select(F.col("id").alias("doc_id"), "item_id", "item_pos", (F.col("pos") - F.col("item_pos")).alias("diagonal"), "slots", "item_slots"), "matches")
    pairs = match.select("doc_id", "item_id", "diagonal", F.explode(F.arrays_zip("item_slots", "slots")).alias("s"))
    values = pairs.groupBy("doc_id", "item_id", "diagonal", F.col("s.item_slots").alias("v")).agg(
        F.min("s.slots").alias("low"), F.max("s.slots").alias("high"), F.max((F.col("s.slots") != F.col("s.item_slots")).cast("int")).alias("other"))
    slots = values.groupBy("doc_id", "item_id", "diagonal").agg(F.avg((F.col("low") == F.col("high")).cast("double")).alias("fits"), F.max("other").alias("other"))
    key = ["doc_id", "item_id", "diagonal"]
    kept = match.select(*key, "item_pos").distinct().join(slots, key, "left").where(F.coalesce("fits", F.lit(1.0)) >= consistency)
    share = kept.groupBy("doc_id", "item_id").agg(F.countDistinct("item_pos").alias("k"), F.avg(F.coalesce("fits", F.lit(1.0))).alias("consistency"),
                                                 (F.coalesce(F.max("other"), F.lit(0)) > 0).alias("reparameterised"))
    out = share.join(sizes.withColumnRenamed("id", "item_id"), "item_id").withColumn("coverage", F.col("k") / F.col("n"))
    return out.where(F.col("coverage") >= coverage).select("doc_id", "item_id", "coverage", "consistency", "reparameterised")


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, columns as they came.
    Each row is judged by its own text, with a doc_id or without."""
    names = docs.columns
    rows = stored(docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)], F.monotonically_increasing_id().alias("row")), "numbered")
    bad = contaminated(rows.select(F.col("row").alias("doc_id"), F.col(f"in_{names.index('text')}").alias("text")), benchmark).select(F.col("doc_id").alias("row")).distinct()
    return rows.join(bad, "row", "left_anti").select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)])
