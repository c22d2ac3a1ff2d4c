"""Suffix arrays by induced sorting, and their permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right
neighbour. Leftmost-S (LMS) substrings are sorted and named; if names repeat,
the string of names is sorted by recursion; from the order of the LMS suffixes
one pass over the buckets induces the L suffixes and a second one the S
suffixes. For bytes a bucket is induced as a whole, in numpy, and again while
suffixes fall into the bucket itself; strings of names have too many buckets
for that and are induced suffix by suffix.
"""

from __future__ import annotations

import numpy as np


def classify(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their right neighbour; the text ends with its unique smallest symbol."""
    step = np.diff(text.astype(np.int64))
    turns = np.flatnonzero(step)
    types = np.ones(len(text), bool)
    types[:-1] = np.repeat(step[turns] > 0, np.diff(np.r_[-1, turns]))
    return types


def _names(text: np.ndarray, types: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, compared by symbol, then type (L before S)."""
    symbols = text.astype(np.int64) * 2 + types + 1
    bits = int(symbols.max()).bit_length()
    per = max(1, 62 // bits)
    symbols = np.r_[symbols, np.zeros(per, np.int64)]
    lengths = np.r_[np.diff(lms) + 1, 1]

    def words(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for t in range(per):
            out = (out << bits) | np.where(left > t, symbols[np.minimum(at + t, len(symbols) - 1)], 0)
        return out

    names = np.unique(words(lms, lengths), return_inverse=True)[1]
    done = per
    while True:
        going = np.flatnonzero(lengths > done)  # substrings are prefix-free: a name is finished for all or none
        if not len(going):
            return names
        word = np.unique(words(lms[going] + done, lengths[going] - done), return_inverse=True)[1]
        finer = names * np.int64(len(names) + 1)
        finer[going] += word
        names = np.unique(finer, return_inverse=True)[1]
        done += per


def _induce_bytes(text: np.ndarray, types: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted LMS suffixes, a bucket at a time."""
    top = int(text.max()) + 1
    first = text[order]
    starts = np.searchsorted(first, np.arange(top + 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(top)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(top)]

    def deal(found: np.ndarray, lists: list[list[np.ndarray]], wanted: bool, own: int) -> np.ndarray:
        """Sends the left neighbours of a wanted type to their buckets; returns those of the bucket itself."""
        left = found[found > 0] - 1
        left = left[types[left] == wanted]
        if not len(left):
            return left
        symbol = text[left]
        same = symbol == own
        mine = left[same]
        if len(mine) < len(left):
            rest, symbol = left[~same], symbol[~same]
            at = np.argsort(symbol, kind="stable")
            rest, symbol = rest[at], symbol[at]
            cuts = np.flatnonzero(np.diff(symbol)) + 1
            for part, s in zip(np.split(rest, cuts), symbol[np.r_[0, cuts]].tolist()):
                lists[s].append(part)
        return mine

    for c in range(top):
        at = 0
        while at < len(larger[c]):
            mine = deal(larger[c][at], larger, False, c)
            # what falls into the own bucket comes after all that is already there
            if len(mine):
                larger[c].append(mine)
            at += 1
        mine = deal(order[starts[c] : starts[c + 1]], larger, False, c)
        assert not len(mine)
    found = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in larger]
    for c in range(top - 1, -1, -1):
        at = 0
        while at < len(smaller[c]):
            mine = deal(smaller[c][at], smaller, True, c)
            if len(mine):
                smaller[c].append(mine)
            at += 1
        mine = deal(found[c][::-1], smaller, True, c)
        assert not len(mine)
    out = []
    for c in range(top):
        out.append(found[c])
        if c == 0:
            out.append(order[:1])  # the last suffix; nothing induces it
        elif smaller[c]:
            out.append(np.concatenate(smaller[c])[::-1])
    return np.concatenate(out)


def _induce_names(text: np.ndarray, types: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The suffix array from the sorted LMS suffixes, a suffix at a time."""
    counts = np.bincount(text)
    ends = np.cumsum(counts)
    heads, tails = (ends - counts).tolist(), ends.tolist()
    symbols, small = text.tolist(), types.tolist()
    found = [-1] * len(symbols)
    for j in reversed(order.tolist()):
        c = symbols[j]
        tails[c] -= 1
        found[tails[c]] = j
    for j in found:  # sees what the loop itself puts further right
        if j > 0 and not small[j - 1]:
            c = symbols[j - 1]
            found[heads[c]] = j - 1
            heads[c] += 1
    tails = ends.tolist()
    for i in range(len(found) - 1, -1, -1):
        j = found[i]
        if j > 0 and small[j - 1]:
            c = symbols[j - 1]
            tails[c] -= 1
            found[tails[c]] = j - 1
    return np.array(found, np.int64)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of a string whose last symbol is 0 and occurs nowhere else."""
    if len(text) < 2:
        return np.arange(len(text))
    types = classify(text)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    names = _names(text, types, lms)
    if len(names) and int(names.max()) + 1 == len(names):
        order = lms[np.argsort(names)]
    else:
        order = lms[suffix_array(names)]
    return (_induce_bytes if text.dtype == np.uint8 else _induce_names)(text, types, order)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For every suffix, what it shares with its predecessor in the suffix array, up to at least `most`.

    A suffix whose left neighbour equals that of its predecessor shares one
    symbol less than the suffix to its left; only the others are compared.
    Shared lengths beyond `most` may be given as any number not below it.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    fresh = (before <= 0) | (at == 0)
    rest = np.flatnonzero(~fresh)
    fresh[rest] = text[rest - 1] != text[before[rest] - 1]
    # a comparison may have stopped at `limit`; within that many suffixes the rule needs a new one
    starts = np.flatnonzero(fresh)
    limit = 2 * most
    gaps = np.diff(np.r_[starts, n])
    more = [np.arange(s + most, s + g, most) for s, g in zip(starts[gaps > most].tolist(), gaps[gaps > most].tolist())]
    starts = np.sort(np.concatenate([starts, *more])) if more else starts
    padded = np.r_[text, np.zeros(limit + 16, text.dtype)]
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)
    shared = np.zeros(len(starts), np.int64)
    live = np.flatnonzero(before[starts] >= 0)
    a, b = starts[live], before[starts[live]]
    done = 0
    while len(live) and done < limit:
        same = (wide[np.minimum(a + done, n + limit)] == wide[np.minimum(b + done, n + limit)])
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        shared[live] += run
        keep = run == 8
        live, a, b = live[keep], a[keep], b[keep]
        done += 8
    which = np.searchsorted(starts, at, side="right") - 1
    return np.maximum(shared[which] - (at - starts[which]), 0)
