"""Quality rules: counted text properties and a calibrated n-gram classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, smallest_hashes, steps, text_buffers
from .words import mix, row_sums, span_hashes, windows, word_spans

#: Buckets of each feature family: words and word pairs, characters (bytes) in threes and fours.
BUCKETS = 1 << 17
_SYMBOLS, _BLANKS = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


def _char_buckets(data: np.ndarray, size: int) -> np.ndarray:
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    code = np.full(n, size, np.uint32)
    for k in range(size):
        code = code * np.uint32(0x01000193) ^ data[k: k + n]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    return (code >> np.uint32(15)).astype(np.int64)


def _word_buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(47)).astype(np.int64)


def _families(data: np.ndarray, offsets: np.ndarray):
    """(bucket, row) arrays of the two families, for one range of rows."""
    starts, ends, rows = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    pairs, at = windows(hashes, rows, 2)
    words = np.r_[_word_buckets(mix(hashes)), _word_buckets(pairs)], np.r_[rows, rows[at]]
    own = data[offsets[0]: offsets[-1]]
    grams, owners = [], []
    for size in (3, 4):
        buckets = _char_buckets(own, size)
        row = np.searchsorted(offsets, np.arange(len(buckets)) + offsets[0], "right") - 1
        inside = np.arange(len(buckets)) + offsets[0] + size <= offsets[row + 1]
        grams.append(buckets[inside])
        owners.append(row[inside])
    return words, (np.concatenate(grams), np.concatenate(owners))


def fit_classifier(rows: DataFrame, epochs: int = 150, penalty: float = 1e-5) -> dict:
    """Logistic regression on (text, good) rows; the caller bounds their number.

    Features are the shares of hashed n-grams within each family.  One task
    fits the weights on four fifths of the rows with full-batch Adam steps and
    a logistic calibration on the last fifth, and returns them.  Without both
    answers among the rows the model says the share of good rows for all texts.
    """
    def fit(batches):
        parts, good = [], []
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in steps(offsets):
                for family, (bucket, row) in enumerate(_families(data, offsets[a: b + 1])):
                    key, n = np.unique(row.astype(np.int64) * BUCKETS + bucket, return_counts=True)
                    doc = key // BUCKETS
                    share = n / np.bincount(doc, n, b - a)[doc]
                    parts.append((doc + len(good) + a, key % BUCKETS + family * BUCKETS, share.astype(np.float32)))
            good += batch.column(1).to_pylist()
        y = np.array(good, float)
        weights, slope, offset = np.zeros(2 * BUCKETS, np.float32), 1.0, 0.0
        if 0 < y.sum() < len(y):
            doc, feature, share = (np.concatenate([p[k] for p in parts]) for k in range(3))
            scale = (1 / np.sqrt(np.bincount(feature, share.astype(float) ** 2, 2 * BUCKETS) / len(y) + 1e-8)).clip(0, 200).astype(np.float32)
            value = share * scale[feature]
            learn = np.arange(len(y)) % 5 != 0
            use = learn[doc]
            d, f, v = doc[use], feature[use], value[use]
            w, bias, m1, m2, b1, b2 = np.zeros(2 * BUCKETS), 0.0, 0.0, 0.0, 0.0, 0.0
            balance = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * learn
            for t in range(1, epochs + 1):
                z = bias + np.bincount(d, w[f] * v, len(y))
                r = (1 / (1 + np.exp(-z.clip(-30, 30))) - y) * balance / learn.sum()
                g, gb = np.bincount(f, r[d] * v, 2 * BUCKETS) + penalty * w, r.sum()
                m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
                b1, b2 = 0.9 * b1 + 0.1 * gb, 0.99 * b2 + 0.01 * gb * gb
                fix1, fix2 = 1 - 0.9 ** t, 1 - 0.99 ** t
                w -= 0.02 * (m1 / fix1) / (np.sqrt(m2 / fix2) + 1e-7)
                bias -= 0.02 * (b1 / fix1) / (np.sqrt(b2 / fix2) + 1e-7)
            z = bias + np.bincount(doc, w[feature] * value, len(y))
            slope, offset = _calibrate(z[~learn], y[~learn])
            weights = (w * scale * slope).astype(np.float32)
            offset += bias * slope
        elif len(y):
            share = (y.sum() + 0.5) / (len(y) + 1)
            offset = float(np.log(share / (1 - share)))
        yield batch_of({"weights": pa.array([weights.tobytes()], pa.binary()), "bias": np.array([offset]), "n": np.array([len(y)])})

    found = rows.select("text", "good").repartition(1).sortWithinPartitions("text", "good").mapInArrow(fit, "weights binary, bias double, n long").first()
    if found is None:
        return {"weights": np.zeros(2 * BUCKETS, np.float32), "bias": 0.0, "n": 0}
    return {"weights": np.frombuffer(bytes(found["weights"]), np.float32), "bias": found["bias"], "n": found["n"]}


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve from scores to the share of good rows, with smoothed targets."""
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    slope, offset = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-(offset + slope * z).clip(-30, 30)))
        g0, g1, w = (t - p).sum(), ((t - p) * z).sum() - 0.01 * (slope - 1), p * (1 - p) + 1e-6
        a, b, c = w.sum(), (w * z).sum(), (w * z * z).sum() + 0.01
        d = a * c - b * b + 1e-9
        offset += float(np.clip((c * g0 - b * g1) / d, -2, 2))
        slope = max(0.05, slope + float(np.clip((a * g1 - b * g0) / d, -1, 1)))
    return slope, offset


def _repeats(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in the row."""
    grams, at = windows(hashes, rows, 3)
    key = mix(grams ^ (rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    covered = np.zeros(len(hashes) + 2, bool)
    for k in range(3):
        covered[at[same] + k] = True
    return np.bincount(rows[covered[: len(hashes)]], minlength=n)


def score_texts(df: DataFrame, columns: list[str], text: Column, model: dict, min_words: int = 50, max_repeat_percent: int = 50,
                min_quality: float = 0.5) -> DataFrame:
    """``columns`` with the counted properties, base_failed, quality (calibrated
    probability of a good text) and kept.  A null or wordless text has zero
    counts, fails the base rule and has the quality of the model's bias."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        weights, bias = shared.value["weights"], shared.value["bias"]
        trained = weights.any()
        for batch in batches:
            n = batch.num_rows
            data, offsets = text_buffers(batch.column(0))
            raw = data.tobytes() if n else b""
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            out = {k: np.zeros(n, np.int64) for k in names}
            z = np.full(n, bias)
            for i in range(n):
                b = raw[offsets[i]: offsets[i + 1]]
                out["n_symbols"][i] = len(b) - len(b.translate(None, _SYMBOLS))
                solid = b.translate(None, _BLANKS)
                # Every code point has one byte that is not a continuation byte.
                out["word_chars"][i] = len(solid) if solid.isascii() else len(solid.decode("utf-8", "replace"))
                lines = [x for x in b.split(b"\n") if x.strip(_BLANKS)]
                out["n_dup_lines"][i] = len(lines) - len(set(lines))
            for a, b in steps(offsets):
                own = offsets[a: b + 1]
                starts, ends, rows = word_spans(data, own)
                hashes = span_hashes(data, starts, ends)
                out["n_words"][a:b] = np.bincount(rows, minlength=b - a)
                out["n_repeat_words"][a:b] = _repeats(hashes, rows, b - a)
                if trained:
                    pairs, at = windows(hashes, rows, 2)
                    total = row_sums(weights[_word_buckets(mix(hashes))], rows, b - a) + row_sums(weights[_word_buckets(pairs)], rows[at], b - a)
                    count = out["n_words"][a:b] + np.bincount(rows[at], minlength=b - a)
                    z[a:b] += total / np.maximum(count, 1)
                    total, count = np.zeros(b - a), np.zeros(b - a)
                    for size in (3, 4):
                        sums = np.concatenate([[0.0], np.cumsum(weights[BUCKETS + _char_buckets(data[own[0]: own[-1]], size)], dtype=np.float64)])
                        first = own[:-1] - own[0]
                        many = np.maximum(np.diff(own) - size + 1, 0)
                        first = np.minimum(first, len(sums) - 1)
                        total += sums[np.minimum(first + many, len(sums) - 1)] - sums[first]
                        count += many
                    z[a:b] += total / np.maximum(count, 1)
            out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat_percent * out["n_words"])
            out["quality"] = 1 / (1 + np.exp(-z.clip(-30, 30)))
            out["kept"] = ~out["base_failed"] & (out["quality"] >= min_quality)
            yield batch_of({c: batch.column(k + 1) for k, c in enumerate(columns)} | out)

    picked = df.select(text.alias("ll_text"), *columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(score, f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, quality double, kept boolean")


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = 2000) -> DataFrame:
    """(text, good) of at most ``rows`` labelled documents, by smallest hash of
    the id.  An id with several labels counts as good if all of them are."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    chosen = smallest_hashes(known, "doc_id", rows)
    # At most ``rows`` rows of two columns.
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "good")


def quality_model(docs: DataFrame, labels: DataFrame, rows: int = 2000) -> dict:
    return fit_classifier(labelled_sample(docs, labels, rows))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, counts, base_failed, kept, quality.  A
    row's result depends on its text alone; repeated rows get equal results."""
    counts = score_texts(docs, ["doc_id"], F.col("text"), quality_model(docs, labels))
    return counts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def quality_stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns they came with."""
    names = docs.columns
    scored = score_texts(docs.select(*[F.col(c).alias(f"in_{k}") for k, c in enumerate(names)]), [f"in_{k}" for k in range(len(names))],
                         F.col(f"in_{names.index('text')}"), quality_model(docs, labels))
    return scored.where("kept").select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(names)])
