"""Suffix arrays of many short texts at once by induced sorting, and permuted common prefixes.

Texts lie one after another in a flat array; each is a lane. Suffixes are classified as smaller or
larger than their right neighbour, leftmost-smaller substrings are sorted by inducing and named, the
strings of names are sorted by the same routine, and the order of all suffixes is induced from them.
Inducing is sequential within a lane; a numpy step takes one slot of every lane.
"""

from __future__ import annotations

import numpy as np


def _induce(sa: np.ndarray, key: np.ndarray, goes: np.ndarray, pointer: np.ndarray, first: np.ndarray, size: np.ndarray, forward: bool) -> None:
    """Scan the lanes' slots in step; a suffix whose predecessor qualifies puts it into its bucket.

    ``first`` and ``size`` are sorted by falling size; ``pointer`` holds the next slot of each bucket.
    """
    alive = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")
    last = first + size - 1
    for step, lanes in enumerate(alive.tolist()):
        slot = first[:lanes] + step if forward else last[:lanes] - step
        suffix = sa[slot]
        suffix = suffix[goes[suffix]] - 1  # an empty slot holds the dummy at the end, which never goes
        k = key[suffix]
        place = pointer[k]
        pointer[k] = place + 1 if forward else place - 1
        sa[place] = suffix


def suffix_arrays(text: np.ndarray, first: np.ndarray, size: np.ndarray, letters: int) -> np.ndarray:
    """Sorted suffixes, lane after lane, as places in ``text``.

    ``text`` holds numbers below ``letters``; every lane ends with a 0 that it has nowhere else.
    """
    n, lanes = len(text), len(first)
    lane = np.repeat(np.arange(lanes, dtype=np.int64), size)
    key = lane * letters + text
    # Types: a suffix is smaller if the next different letter is larger.
    turn = np.zeros(n, np.int8)
    turn[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    end = first + size - 1
    turn[end] = 1
    place = np.arange(n)
    following = np.minimum.accumulate(np.where(turn != 0, place, n)[::-1])[::-1]
    smaller = turn[following] > 0
    leftmost = np.zeros(n, bool)
    leftmost[1:] = smaller[1:] & ~smaller[:-1]
    leftmost[first] = False
    inner = np.ones(n, bool)
    inner[first] = False
    before = np.zeros(n, bool)
    before[1:] = smaller[:-1]
    to_larger = np.append(inner & ~before, False)
    to_smaller = np.append(inner & before, False)
    counts = np.bincount(key, minlength=lanes * letters)
    tails = np.cumsum(counts) - 1
    heads = tails - counts + 1
    order = np.argsort(-size, kind="stable")
    f, s = first[order], size[order]

    def induced(sorted_marks: np.ndarray) -> np.ndarray:
        """From leftmost-smaller suffixes in (their best known) order to all suffixes."""
        sa = np.full(n, n, np.int64)
        k = key[sorted_marks]
        by = np.argsort(k, kind="stable")
        k = k[by]
        behind = np.searchsorted(k, k, "right") - 1 - np.arange(len(k))
        sa[tails[k] - behind] = sorted_marks[by]
        _induce(sa, key, to_larger, heads.copy(), f, s, True)
        _induce(sa, key, to_smaller, tails.copy(), f, s, False)
        # The end mark is the least suffix of its lane; only its own slot comes first.
        sa[first] = end
        return sa

    marks = np.flatnonzero(leftmost)
    sa = induced(marks)
    ranked = sa[leftmost[sa]]
    if not len(ranked):  # every lane is an end mark alone
        return sa
    rank_lane = lane[ranked]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = (rank_lane[1:] != rank_lane[:-1]) | ~_equal_substrings(text, smaller, leftmost, ranked[:-1], ranked[1:])
    name = np.cumsum(fresh) - 1
    lane_first = np.searchsorted(rank_lane, np.arange(lanes))
    name -= name[np.minimum(lane_first, len(name) - 1)][rank_lane]
    named = np.zeros(n, np.int64)
    named[ranked] = name
    reduced = named[marks]
    mark_lane = lane[marks]
    many = np.bincount(mark_lane, minlength=lanes)
    most = np.full(lanes, -1)
    np.maximum.at(most, rank_lane, name)
    unclear = most + 1 < many  # lanes in which a name repeats
    if unclear.any():
        pick = unclear[mark_lane]
        sub_size = many[unclear]
        sub_first = np.cumsum(sub_size) - sub_size
        sub = suffix_arrays(reduced[pick], sub_first, sub_size, int(reduced[pick].max()) + 1)
        better = marks[pick][sub]
        ranked = ranked.copy()
        ranked[unclear[rank_lane]] = better
    return induced(ranked)


def _equal_substrings(text: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether leftmost-smaller substrings (up to the next such place, included) are equal."""
    equal = np.ones(len(a), bool)
    at = np.arange(len(a))
    n = len(text)
    step = 0
    while len(at):
        x, y = a[at] + step, b[at] + step
        inside = (x < n) & (y < n)
        same = inside.copy()
        xi, yi = x[inside], y[inside]
        same[inside] = (text[xi] == text[yi]) & (smaller[xi] == smaller[yi])
        if step:
            ends_x, ends_y = np.zeros(len(at), bool), np.zeros(len(at), bool)
            ends_x[inside], ends_y[inside] = leftmost[xi], leftmost[yi]
            same &= ends_x == ends_y
            equal[at[~same]] = False
            at = at[same & ~ends_x]
        else:
            equal[at[~same]] = False
            at = at[same]
        step += 1
    return equal


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place, how many letters its suffix shares with the one before it in its lane's array.

    Where the letters before both agree, the value is one less than the value at the place before, so
    letters are compared at the other places only. Lanes' end marks stop every comparison, as two
    suffixes of a lane reach its end at different steps.
    """
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[sa[1:]] = sa[:-1]
    previous[sa[first]] = -1  # a lane's first suffix has none
    place = np.arange(n)
    known = previous >= 0
    reducible = np.zeros(n, bool)
    i = np.flatnonzero(known & (place > 0) & (previous > 0))
    reducible[i] = text[i - 1] == text[previous[i] - 1]
    reducible[first] = False
    starts = np.zeros(n, bool)
    starts[first] = True
    i = np.flatnonzero(reducible)
    reducible[i[starts[previous[i]]]] = False
    # A place after one without predecessor can't be derived from it.
    reducible[1:] &= known[:-1]
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(known & ~reducible)
    length = 0
    while len(at):
        x, y = at + length, previous[at] + length
        inside = (x < n) & (y < n)
        same = inside
        same[inside] = text[x[inside]] == text[y[inside]]
        out[at[~same]] = length
        at = at[same]
        length += 1
    source = np.maximum.accumulate(np.where(reducible, 0, place))
    return np.where(reducible, out[source] - (place - source), out)
