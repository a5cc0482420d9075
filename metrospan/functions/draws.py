"""Reproducible random numbers from a text hash, equal on every engine and
independent of how rows are partitioned."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from .rules import col


def uniform(seed: int, *keys) -> Column:
    """Uniform in (0, 1) decided by the seed and the keys alone."""
    text = F.concat_ws("|", F.lit(str(seed)), *[_text(k) for k in keys])
    word = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double")
    return (word + 0.5) / F.lit(4294967296.0)


def normal(seed: int, *keys) -> Column:
    """Standard normal by Box-Muller from two independent uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(uniform(seed, *keys, "a")))
    return radius * F.cos(F.lit(2 * math.pi) * uniform(seed, *keys, "b"))


def _text(key) -> Column:
    return (F.lit(key) if isinstance(key, (str, int)) else col(key)).cast("string")


# --- the same numbers for many rows at once ----------------------------------------

# The sines and rotations of MD5 (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]


def _first_words(words: list) -> np.ndarray:
    """First word of the MD5 of one-block messages, given as 16 words each an
    array or the number all messages share.  Later steps do not change it."""
    n = max(np.size(w) for w in words)
    a, b, c, d = (np.full(n, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            k = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if np.ndim(words[k]):
            np.add(f, words[k], out=f), np.add(f, np.uint32(_SINES[i]), out=f)
        else:
            np.add(f, np.uint32((_SINES[i] + int(words[k])) % 2 ** 32), out=f)
        np.left_shift(f, np.uint32(_TURNS[i]), out=t), np.right_shift(f, np.uint32(32 - _TURNS[i]), out=f)
        np.bitwise_or(f, t, out=f), np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return b + np.uint32(0x67452301)


class DrawBatch:
    """Draws of a batch of key texts, in order of the length of the texts
    (``order``): one message per row, of a text before and one after the key."""

    def __init__(self, texts: pa.Array):
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        self.order = np.argsort(lengths, kind="stable")
        self.parts, at = [], 0
        for n in np.unique(lengths):
            own = texts.take(pa.array(self.order[at: at + int((lengths == n).sum())]))
            data = np.frombuffer(own.buffers()[2] or b"", np.uint8, len(own) * n)
            self.parts.append((at, at + len(own), data.reshape(len(own), n)))
            at += len(own)
        self.n = at

    def uniform(self, before: str, after: str) -> np.ndarray:
        head, tail = (np.frombuffer(v.encode(), np.uint8) for v in (before, after))
        block, last, short = np.zeros((self.n, 64), np.uint8), 0, 0
        out, p = np.empty(self.n), len(head)
        for start, stop, data in self.parts:
            q = p + data.shape[1]
            end = q + len(tail)
            if end > 55:  # more than one block
                out[start:stop] = [int(hashlib.md5(head.tobytes() + row.tobytes() + tail.tobytes()).hexdigest()[:8], 16) for row in data]
                continue
            rows = block[start:stop]
            rows[:, :p], rows[:, p:q], rows[:, q:end], rows[:, end] = head, data, tail, 0x80
            rows[:, 56], rows[:, 57] = 8 * end % 256, 8 * end // 256
            last, short = end // 4, stop
        if short:
            whole = block[:short].view("<u4")
            words = [np.ascontiguousarray(whole[:, i]) if i <= last or i == 14 else 0 for i in range(16)]
            out[:short] = _first_words(words).byteswap()
        return (out + 0.5) / 4294967296.0

    def noise(self, before: str, after: str = "") -> np.ndarray:
        """Standard normals, as :func:`normal` of the same seed and keys."""
        return np.sqrt(-2.0 * np.log(self.uniform(before, after + "a"))) * np.cos(2 * math.pi * self.uniform(before, after + "b"))


def key_text(*keys) -> Column:
    """The keys as they stand in the hashed text, with the mark that follows."""
    return F.concat_ws("|", *[_text(k) for k in keys], F.lit(""))


def normals(seed: int, keys: list, tags: list) -> Column:
    """Array of ``normal(seed, *keys, tag)`` for each tag, a batch of rows at a time."""
    @F.arrow_udf("array<double>")
    def drawn(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.float64()))
        batch = DrawBatch(texts)
        out = np.empty((batch.n, len(tags)))
        for j, tag in enumerate(tags):
            out[batch.order, j] = batch.noise(f"{seed}|", f"{tag}|")
        ends = np.arange(0, out.size + 1, len(tags), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))
    return drawn(key_text(*keys))
