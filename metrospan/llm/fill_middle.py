"""Fill-in-the-middle rewriting of texts, with cuts found word by word in UTF-8."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .frames import batch_of, steps, text_buffers

#: Sentinels of the parts, seed of the draws, percentages of rewritten texts and of suffix-first ones among them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, REWRITTEN, SUFFIX_FIRST = 42, 50, 80

_U = np.uint64
_HIGH, _LOW7 = _U(0x8080808080808080), _U(0x7F7F7F7F7F7F7F7F)
_ONES = _U(0x0101010101010101)


def _every(byte: int) -> np.uint64:
    return _U(byte) * _ONES


def pack(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``data[offsets[i]:offsets[i + 1]]`` as little-endian 64-bit
    words, each row from a word of its own and followed by a blank at least;
    with the first word of each row (and the end)."""
    lengths = np.diff(offsets)
    first = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths // 8 + 1, out=first[1:])
    padded = np.full(int(first[-1]) * 8, 0x20, np.uint8)
    for at, a, n in zip((first[:-1] * 8).tolist(), offsets[:-1].tolist(), lengths.tolist()):
        padded[at: at + n] = data[a: a + n]
    return padded.view("<u8"), first


def blank_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is 0x20 or in 0x09 to 0x0D.  Each sum
    stays inside its byte, since the byte's own high bit is taken away first."""
    low = words & _LOW7
    differs = (low ^ _every(0x20)) + _LOW7
    control = (low + _every(0x80 - 0x09)) & ~(low + _every(0x80 - 0x0E))
    return (~differs | control) & ~words & _HIGH


def unit_ends(words: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The high bit of every byte that ends a unit: a byte outside blanks
    before a blank (what follows a row is blank), and the last byte of a row
    that ends in blanks."""
    blank = blank_bytes(words)
    after = blank >> _U(8)
    after[:-1] |= blank[1:] << _U(56)
    after[-1:] |= _U(1) << _U(63)
    ends = ~blank & after & _HIGH
    last = first[:-1] * 8 + lengths - 1
    rows = np.flatnonzero(lengths > 0)
    word, bit = last[rows] >> 3, _U(8) * (last[rows] & 7).astype(np.uint64) + _U(7)
    np.bitwise_or.at(ends, word, (blank[word] >> bit & _U(1)) << bit)
    return ends


def counts_before(marks: np.ndarray) -> np.ndarray:
    """How many marks lie before each word (and before the end)."""
    out = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(np.bitwise_count(marks), out=out[1:])
    return out


def select(marks: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Byte positions of the marks of number ``rank`` (from 1): the word by a
    search in the running counts, the byte by clearing lower marks."""
    word = np.searchsorted(before, rank, "left") - 1
    rest, left = marks[word].copy(), rank - before[word]
    for _ in range(7):
        rest = np.where(left > 1, rest & (rest - _U(1)), rest)
        left = left - 1
    lowest = rest & (~rest + _U(1))
    return word * 8 + (np.bitwise_count(lowest - _U(1)) >> 3)


def rank(marks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks lie before the byte positions ``at``."""
    inside = (_U(1) << (_U(8) * (at & 7).astype(np.uint64))) - _U(1)
    word = at >> 3
    return before[word] + np.bitwise_count(np.append(marks, _U(0))[word] & inside)


def draws(doc_id) -> list[int]:
    """Four unsigned 32-bit draws of a document; a null id reads as the empty text."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k: k + 8], 16) for k in range(0, 32, 8)]


def assemble(text: bytes, form: str, a: int, b: int) -> bytes:
    """The text with its parts [0, a), [a, b) and [b, end) in the order of ``form``."""
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if form == "psm":
        return p + text[:a] + s + text[b:] + m + text[a:b]
    return s + text[b:] + p + text[:a] + m + text[a:b] if form == "spm" else text


def restore(output: bytes, form: str) -> bytes:
    """The text that ``assemble`` was given, read from the output alone."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE.encode())
    one, two = head[3:].split((SUFFIX if form == "psm" else PREFIX).encode())
    return one + middle + two if form == "psm" else two + middle + one


def _cuts(data: np.ndarray, offsets: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row: units, both cuts as bytes of the row, and as code points."""
    words, first = pack(data, offsets)
    lengths = np.diff(offsets)
    ends = unit_ends(words, first, lengths)
    before = counts_before(ends)
    base = before[first[:-1]]
    n = before[first[1:]] - base
    pair = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    starts = ~(words & ~(words << _U(1))) & _HIGH  # bytes that begin a code point
    points = counts_before(starts)
    cuts, chars = [], []
    for k in range(2):
        at = first[:-1] * 8
        some = np.flatnonzero(pair[:, k] > 0)
        at[some] = select(ends, before, base[some] + pair[some, k]) + 1
        cuts.append(at - first[:-1] * 8)
        chars.append(rank(starts, points, at) - points[first[:-1]])
    return n, *cuts, *chars


def fill_middle(df: DataFrame, columns: list[str], text: Column, doc_id: Column) -> DataFrame:
    """``columns`` of ``df`` with n, form, prefix_chars, middle_chars, output
    (the rewritten text) and restored (the text read back from it).

    A unit is a run without blanks together with the blanks before it, or the
    blanks at the end of a text.  Two draws of the document cut its units in
    three, two more choose the form: ``plain`` (the text as it is, also where
    it is empty or holds a sentinel), ``psm`` or ``spm``.  Null texts are
    empty; repeated rows get equal results; a text of any length is one row.
    """
    picked = df.select(text.alias("ll_text"), doc_id.alias("ll_id"), *columns)

    def compute(batches):
        marks = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            ids = batch.column(1).to_pylist()
            for a, b in steps(offsets):
                drawn = np.array([draws(i) for i in ids[a:b]], np.int64)
                n, one, two, one_chars, two_chars = _cuts(data, offsets[a: b + 1], drawn)
                rows = []
                for k in range(b - a):
                    whole = data[offsets[a + k]: offsets[a + k + 1]].tobytes()
                    plain = not whole or drawn[k, 2] % 100 >= REWRITTEN or any(m in whole for m in marks)
                    form = "plain" if plain else "spm" if drawn[k, 3] % 100 < SUFFIX_FIRST else "psm"
                    out = assemble(whole, form, int(one[k]), int(two[k]))
                    rows.append((form, None if plain else int(one_chars[k]), None if plain else int(two_chars[k] - one_chars[k]), out, restore(out, form)))
                form, prefix, middle, out, back = zip(*rows)
                yield batch_of({c: batch.column(k + 2).slice(a, b - a) for k, c in enumerate(columns)} | {
                    "n": n, "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()),
                    "output": pa.array(out, pa.binary()).cast(pa.string()), "restored": pa.array(back, pa.binary()).cast(pa.string())})

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in picked.schema.fields[2:])
    return picked.mapInArrow(compute, f"{kinds}n long, form string, prefix_chars long, middle_chars long, output string, restored string")


def fill_middle_query(docs: DataFrame) -> DataFrame:
    """Every row of ``docs``: doc_id, n, form, prefix_chars, middle_chars and
    the digests of the rewritten and of the restored text."""
    rows = fill_middle(docs, ["doc_id"], F.col("text"), F.col("doc_id"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


FILL_MIDDLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
x AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
