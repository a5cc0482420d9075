"""Suffix arrays by induced sorting, and permuted common prefixes, of one shard's text."""

from __future__ import annotations

import numpy as np

#: Alphabets of at most this many symbols are induced bucket by bucket as arrays, larger ones suffix by suffix.
BUCKETS = 1024


def _classify(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one, and the leftmost smaller positions."""
    n = len(text)
    step = np.sign(np.diff(text))
    place = np.where(step != 0, np.arange(n - 1), n - 1)  # the next position whose symbol changes
    place = np.minimum.accumulate(place[::-1])[::-1]
    smaller = np.ones(n, bool)  # the sentinel
    smaller[:-1] = np.append(step, 1)[place] > 0
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1


def _spread(targets: np.ndarray, symbols: np.ndarray, room: list, lists: list) -> None:
    """Append positions to the lists of their symbols, in order."""
    order = np.argsort(symbols, kind="stable")
    symbols, targets = symbols[order], targets[order]
    cut = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])) if len(symbols) else []
    for a, b in zip(cut, [*cut[1:], len(symbols)]):
        lists[symbols[a]].append(targets[a:b])


def _chain(text: np.ndarray, fits: np.ndarray, c: int, pieces: list) -> np.ndarray:
    """The pieces of bucket ``c`` and what they induce in their own bucket, round by round."""
    piece = np.concatenate(pieces) if pieces else np.zeros(0, np.int64)
    out = [piece]
    while len(piece):
        piece = piece[piece > 0] - 1
        piece = piece[(text[piece] == c) & fits[piece]]
        out.append(piece)
    return np.concatenate(out)


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, size: int) -> np.ndarray:
    """All suffixes from the ordered leftmost smaller ones ``heads``: larger
    suffixes forward, then smaller ones backward, a whole bucket at a time."""
    larger = ~smaller
    seeds = np.split(heads, np.cumsum(np.bincount(text[heads], minlength=size))[:-1])
    waiting: list[list] = [[] for _ in range(size)]
    upper = []
    for c in range(size):
        own = _chain(text, larger, c, waiting[c])
        upper.append(own)
        seen = np.concatenate([own, seeds[c]])
        seen = seen[seen > 0] - 1
        seen = seen[larger[seen] & (text[seen] > c)]
        _spread(seen, text[seen], size, waiting)
    waiting = [[] for _ in range(size)]
    parts: list = [None] * size
    for c in range(size - 1, -1, -1):  # lists run from right to left here
        own = _chain(text, smaller, c, waiting[c])
        parts[c] = np.concatenate([upper[c], own[::-1]])
        seen = np.concatenate([own, upper[c][::-1]])
        seen = seen[seen > 0] - 1
        seen = seen[smaller[seen] & (text[seen] < c)]
        _spread(seen, text[seen], size, waiting)
    parts[0] = np.array([len(text) - 1])  # the sentinel alone
    return np.concatenate(parts)


def _induce_single(text: np.ndarray, smaller: np.ndarray, heads: np.ndarray, size: int) -> np.ndarray:
    """As ``_induce_buckets``, suffix by suffix: for alphabets of very many symbols."""
    t, s, n = text.tolist(), smaller.tolist(), len(text)
    ends = np.cumsum(np.bincount(text, minlength=size))
    sa = [-1] * n
    tail = ends.tolist()
    for i in heads[::-1].tolist():
        c = t[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = np.append(0, ends[:-1]).tolist()
    for k in range(n):
        i = sa[k] - 1
        if i >= 0 and not s[i]:
            c = t[i]
            sa[head[c]] = i
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        i = sa[k] - 1
        if i >= 0 and s[i]:
            c = t[i]
            tail[c] -= 1
            sa[tail[c]] = i
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _names(text: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Numbers of the leftmost-smaller substrings (from one to the next such
    position): equal ones share a number, numbers follow ``order``."""
    size = np.append(np.diff(at), 0) + 1  # the sentinel's own has length one
    length = np.zeros(len(text), np.int64)
    length[at] = size
    a, b = order[:-1], order[1:]
    equal = length[a] == length[b]
    live = np.flatnonzero(equal)
    k = 0
    while len(live):
        same = text[a[live] + k] == text[b[live] + k]
        equal[live[~same]] = False
        k += 1
        live = live[same & (length[a[live]] > k)]
    number = np.zeros(len(text), np.int64)
    number[order] = np.cumsum(np.append(0, ~equal))
    return number[at]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order.  The last symbol
    must be 0 and the only one.

    Suffixes are larger or smaller than their successor; the leftmost smaller
    substrings are ordered by one induction, numbered, and the text of their
    numbers is sorted by the same function unless all numbers differ; a second
    induction from their order gives all suffixes.  Every step is linear.
    """
    if len(text) < 3:
        return np.arange(len(text))[::-1].copy()
    size = int(text.max()) + 1
    smaller, at = _classify(text)
    induce = _induce_buckets if size <= BUCKETS else _induce_single
    heads = at[np.argsort(text[at], kind="stable")]
    first = induce(text, smaller, heads, size)
    chosen = np.zeros(len(text), bool)
    chosen[at] = True
    order = first[chosen[first]]
    names = _names(text, at, order)
    if names.max() + 1 < len(at):
        order = at[suffix_array(names)]
    return induce(text, smaller, order, size)


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position the length of the common prefix of its suffix and the
    one before it in ``order`` (0 for the first), in text order.

    Where the symbols before both suffixes agree, the value is one less than
    that of the position before; only the others are compared symbol by symbol.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[order[1:]], before[order[0]] = order[:-1], -1
    place = np.arange(n)
    start = (before <= 0) | (place == 0)
    inner = np.flatnonzero(~start)
    start[inner] = text[inner - 1] != text[before[inner] - 1]
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(start & (before >= 0))
    k = 0
    while len(live):
        live = live[np.maximum(live, before[live]) + k < n]
        live = live[text[live + k] == text[before[live] + k]]
        k += 1
        out[live] = k
    from_ = np.maximum.accumulate(np.where(start, place, 0))
    return out[from_] - (place - from_)
