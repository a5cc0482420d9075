"""Character n-gram language models, one per class, in sorted key arrays.

Counting runs in Spark over every text of the training rows: tasks sum the
n-grams of the highest order, all lower orders follow from those by grouping.
An n-gram is packed into one integer of 12 bits a character.  Every counted
n-gram has its probability, at any size of the table: no row is left out of
the counts and no n-gram out of the model, which therefore grows with the
number of different n-grams of the labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, steps, stored, text_buffers

BITS = 12
_letters: dict[str, np.ndarray] = {}


def _fold(points: np.ndarray) -> np.ndarray:
    """Character number below 4096: exact below U+0800, hashed above."""
    return np.where(points < 2048, points, 2048 + (points * 2654435761 >> 7) % 2048)


def letter_ids() -> np.ndarray:
    """Number of each code point: letters have their own, all others are 0."""
    if "letters" not in _letters:
        points = np.arange(0x110000)
        alpha = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
        _letters["letters"] = np.where(alpha, np.maximum(_fold(points), 1), 0).astype(np.uint16)
    return _letters["letters"]


def all_ids() -> np.ndarray:
    if "all" not in _letters:
        _letters["all"] = np.maximum(_fold(np.arange(0x110000)), 1).astype(np.uint16)
    return _letters["all"]


def gram_codes(texts: list[str], order: int, letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-gram ending at each character, and the row of the character.
    Contexts before the start of a text are blanks; runs of blanks are one."""
    texts = [t.lower() + "\n" for t in texts] if letters_only else [t + "\n" for t in texts]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    ids = (letter_ids() if letters_only else all_ids())[points].astype(np.uint64)
    if not letters_only:
        ids[np.cumsum([len(t) for t in texts]) - 1] = 0
    before = np.zeros(len(ids), np.uint64)
    before[1:] = np.where(rows[1:] == rows[:-1], ids[:-1], 0)
    keep = (ids > 0) | (before > 0)
    ids, rows = ids[keep], rows[keep]
    codes = ids.copy()
    for k in range(1, order):
        shifted = np.zeros(len(ids), np.uint64)
        if len(ids) > k:
            shifted[k:] = np.where(rows[k:] == rows[:-k], ids[:-k], 0)
        codes |= shifted << np.uint64(BITS * k)
    return codes, rows


def gram_pieces(column: pa.Array, order: int, letters_only: bool, limit: int = 1 << 18):
    """(row, codes, row of each code) for pieces of a string column.  Texts
    beyond ``limit`` bytes come in overlapping pieces, each character once."""
    _, offsets = text_buffers(column)
    for a, b in steps(offsets, limit):
        texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
        if b - a == 1 and len(texts[0]) > limit:
            for codes in _long_text(texts[0], order, letters_only, limit):
                yield a, codes, np.zeros(len(codes), np.int64)
        else:
            codes, rows = gram_codes(texts, order, letters_only)
            yield a, codes, rows


def _long_text(text: str, order: int, letters_only: bool, limit: int):
    """The codes of one text in pieces; the last characters of a piece are the context of the next."""
    table, last, tail = (letter_ids() if letters_only else all_ids()), 0, np.zeros(order - 1, np.uint64)
    for at in range(0, len(text), limit):
        piece = text[at: at + limit]
        ids = table[np.frombuffer((piece.lower() if letters_only else piece).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
        if at + limit >= len(text):
            ids = np.append(ids, np.uint64(0))
        before = np.concatenate([[np.uint64(last)], ids[:-1]])
        last = ids[-1]
        ids = np.concatenate([tail, ids[(ids > 0) | (before > 0)]])
        codes = np.zeros(len(ids) - order + 1, np.uint64)
        for k in range(order):
            codes |= ids[order - 1 - k: len(ids) - k] << np.uint64(BITS * k)
        tail = ids[len(ids) - order + 1:]
        yield codes


def gram_counts(df: DataFrame, text: Column, label: Column, order: int, letters_only: bool) -> DataFrame:
    """Count of every n-gram of the highest order per class (label, code, n)."""
    def count(batches):
        found: dict = {}
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(0)
            for name in dict.fromkeys(names):
                own = texts.filter(pa.array([x == name for x in names]))
                for _, codes, _ in gram_pieces(own, order, letters_only):
                    found.setdefault(name, []).append(np.unique(codes, return_counts=True))
                    if len(found[name]) >= 64:
                        found[name] = [_merge(found[name])]
        for name, parts in found.items():
            codes, counts = _merge(parts)
            yield batch_of({"label": pa.array([name] * len(codes), pa.string()), "code": codes.astype(np.int64), "n": counts.astype(np.int64)})

    rows = df.select(text.alias("text"), label.alias("label")).where("text is not null and label is not null")
    counted = rows.mapInArrow(count, "label string, code long, n long")
    return stored(counted.groupBy("label", "code").agg(F.sum("n").alias("n")), "grams")  # every order reads it again


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(where, weights=np.concatenate([p[1] for p in parts]), minlength=len(codes))
    return codes, counts.astype(np.int64)


def gram_weights(counts: DataFrame, order: int, smoothing: str, least: float = 0.0) -> DataFrame:
    """Own share of every counted n-gram in its context, (label, size, code, alpha).

    ``kneser-ney``: below the highest order, an n-gram counts the different
    characters seen before it; absolute discount n1 / (n1 + 2 n2) per class and
    order.  ``witten-bell``: plain counts at every order, and a context gives
    the lower order the share of its different continuations, so that the used
    length of context varies with what the context has shown.  n-grams of a
    share below ``least`` are left out; by default none is.
    """
    level, out = counts.withColumn("n", F.col("n").cast("double")), None
    for size in range(order, 0, -1):
        context = F.shiftright("code", BITS)
        if smoothing == "kneser-ney":
            drop = level.groupBy("label").agg((F.sum((F.col("n") == 1).cast("double"))).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
            drop = drop.select("label", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("drop"))
            # One row per class: the number of classes is that of the labels.
            share = F.greatest(F.col("n") - F.least(F.col("drop"), F.lit(0.95)), F.lit(0.0)) / F.col("total")
        else:
            share = F.col("n") / (F.col("total") + F.col("kinds"))
        totals = level.groupBy("label", context.alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).cast("double").alias("kinds"))
        rows = level.withColumn("context", context).join(totals, ["label", "context"])
        if smoothing == "kneser-ney":
            rows = rows.join(drop, "label")
        kept = rows.select("label", F.lit(size).alias("size"), "code", share.alias("alpha"))
        kept = kept.where(F.col("alpha") >= least) if least > 0 else kept
        out = kept if out is None else out.union(kept)
        shorter = F.col("code").bitwiseAND(F.lit((1 << BITS * (size - 1)) - 1))
        level = level.groupBy("label", shorter.alias("code")).agg((F.count(F.lit(1)) if smoothing == "kneser-ney" else F.sum("n")).cast("double").alias("n"))
    return out


@dataclass
class CharModels:
    """Interpolated log-probabilities of all classes for every stored n-gram."""
    labels: list[str]
    order: int
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    back: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = float(-np.log(1 << BITS))

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """[code, class]: the longest stored n-gram, with the weights of the
        contexts passed on the way down."""
        out = np.zeros((len(codes), len(self.labels)), np.float32)
        todo = np.arange(len(codes))
        for size in range(self.order, 0, -1):
            key = codes[todo] & np.uint64((1 << BITS * size) - 1)
            at, hit = find(self.keys[size], key)
            out[todo[hit]] += self.logs[size][at[hit]]
            todo, key = todo[~hit], key[~hit]
            at, hit = find(self.contexts[size], key >> np.uint64(BITS))
            out[todo[hit]] += self.back[size][at[hit]]
        out[todo] += np.float32(self.floor)
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in a sorted array and whether the key is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def build_models(weights: DataFrame, order: int) -> CharModels:
    """Collect the counted n-grams and interpolate them from the lowest order
    up.  The driver and every task hold all different n-grams, whatever their
    counts: their number grows with the vocabulary of the labelled texts, far
    slower than the texts."""
    table = weights.toArrow()
    labels = sorted(set(table["label"].to_pylist()))
    index = {x: i for i, x in enumerate(labels)}
    label = np.array([index[x] for x in table["label"].to_pylist()], np.int64)
    sizes, codes, alphas = table["size"].to_numpy(), table["code"].to_numpy().astype(np.uint64), table["alpha"].to_numpy()
    model = CharModels(labels, order)
    lower = np.full((0, len(labels)), 0.0)
    for size in range(1, order + 1):
        own = sizes == size
        keys, where = np.unique(codes[own], return_inverse=True)
        alpha = np.zeros((len(keys), len(labels)))
        alpha[where, label[own]] = alphas[own]
        context, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
        left = np.ones((len(context), len(labels)))
        np.subtract.at(left, at, alpha)
        left = np.clip(left, 1e-6, 1.0)
        if size == 1:
            below = np.full((len(keys), len(labels)), np.exp(model.floor))
        else:
            short = keys & np.uint64((1 << BITS * (size - 1)) - 1)
            model_low = CharModels(labels, size - 1, model.keys, model.logs, model.contexts, model.back)
            below = np.exp(model_low.log_probabilities(short).astype(np.float64))
        lower = alpha + left[at] * below
        model.keys[size], model.logs[size] = keys, np.log(lower).astype(np.float32)
        model.contexts[size], model.back[size] = context, np.log(left).astype(np.float32)
    return model
