"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as smaller or larger than their successor; the leftmost-smaller substrings are named in order
and sorted by recursion over their names. Over bytes, all suffixes are then induced bucket by bucket, each bucket's
entries at once; over names, whose alphabet is large, by sorting what precedes the next leftmost-smaller suffix.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the end counts as smallest."""
    n = len(t)
    rises = np.zeros(n, dtype=np.int8)
    rises[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1].astype(np.int64))
    rises[-1] = -1
    last = np.where(rises[::-1] != 0, np.arange(n), 0)
    return rises[::-1][np.maximum.accumulate(last)][::-1] > 0


def _leftmost(s: np.ndarray) -> np.ndarray:
    """Places of smaller suffixes whose predecessor is larger."""
    return np.flatnonzero(s[1:] & ~s[:-1]) + 1


def _places(key: np.ndarray) -> np.ndarray:
    """For each key the place of the first of its equals in order, which leaves room for telling equals apart."""
    order = np.argsort(key)
    sorted_ = key[order]
    places = np.arange(len(key))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], sorted_[1:] != sorted_[:-1])), places, 0))
    rank = np.empty(len(key), dtype=np.int64)
    rank[order] = first
    return rank


def _parted(rank: np.ndarray, open_: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tells equals apart, in place: the members `open_` of groups, all of them there, by a key below 2**32. Returns who are equal still."""
    if not len(open_):
        return open_
    joint = (rank[open_].astype(np.uint64) << np.uint64(32)) | key
    order = np.argsort(joint)
    joint = joint[order]
    places = np.arange(len(order))
    group = joint >> np.uint64(32)
    head = np.maximum.accumulate(np.where(np.concatenate(([True], group[1:] != group[:-1])), places, 0))
    first = np.maximum.accumulate(np.where(np.concatenate(([True], joint[1:] != joint[:-1])), places, 0))
    rank[open_[order]] += first - head
    equal = joint[1:] == joint[:-1]
    return open_[order[np.concatenate((equal, [False])) | np.concatenate(([False], equal))]]


def _word(t: np.ndarray, at: np.ndarray, ends: np.ndarray, width: int, bits: int) -> np.ndarray:
    """`width` symbols from `at` as one number; after `ends` (the last of a substring) the largest symbol, after the text 0."""
    key = np.zeros(len(at), dtype=np.uint64)
    most, n = np.uint64((1 << bits) - 1), len(t)
    for k in range(width):
        p = at + k
        symbol = t[np.minimum(p, n - 1)].astype(np.uint64)
        symbol[p >= n] = 0
        symbol[(p > ends) & (ends < n)] = most
        key = (key << np.uint64(bits)) | symbol
    return key


def _crowded(rank: np.ndarray) -> np.ndarray:
    return np.bincount(rank, minlength=1)[rank] > 1


def _substring_ranks(t: np.ndarray, begins: np.ndarray, ends: np.ndarray, bits: int, rounds: int | None = None) -> tuple[np.ndarray, int]:
    """Ranks of the substrings t[begins..ends], each taken to be followed by the largest symbol; and how many symbols were compared."""
    rank = _places(_word(t, begins, ends, 64 // bits, bits))
    done, width, step = 64 // bits, 32 // bits, 1
    open_ = np.flatnonzero(_crowded(rank))
    while rounds is None or step < rounds:
        open_ = open_[begins[open_] + done <= ends[open_] + 1]
        if not len(open_):
            break
        open_ = _parted(rank, open_, _word(t, begins[open_] + done, ends[open_], width, bits))
        done += width
        step += 1
    return rank, done


def _doubled(rank: np.ndarray, length: int) -> np.ndarray:
    """Final ranks by doubling, from ranks whose ties agree in `length` symbols."""
    n = len(rank)
    open_ = np.flatnonzero(_crowded(rank))
    while len(open_):
        after = np.where(open_ + length < n, rank[np.minimum(open_ + length, n - 1)] + 1, 0)
        open_ = _parted(rank, open_, after.astype(np.uint64))
        length *= 2
    return rank


def _sorted_names(t: np.ndarray) -> np.ndarray:
    """Suffix array of an array of names from 1 on."""
    n = len(t)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    if np.bincount(t).max() == 1:
        return np.argsort(t)
    s = _types(t)
    lms = _leftmost(s)
    following = np.full(n, n, dtype=np.int64)  # the next leftmost-smaller place after each
    lms_rank = np.zeros(n + 1, dtype=np.uint64)
    if len(lms):
        k = np.searchsorted(lms, np.arange(n), "right")
        following = np.where(k < len(lms), lms[np.minimum(k, len(lms) - 1)], n)
        ranks, _ = _substring_ranks(t, lms, following[lms], 32)
        lms_rank[lms[_sorted_names(ranks + 1)]] = np.arange(1, len(lms) + 1)
    everything = np.arange(n)
    rank, compared = _substring_ranks(t, everything, following, 32, rounds=64)
    # Those that agree up to the next such suffix are told apart by its rank; other ties are longer than what was compared.
    ended = np.flatnonzero(_crowded(rank) & (everything + compared > following + 1))
    _parted(rank, ended, lms_rank[following[ended]])
    return np.argsort(_doubled(rank, compared))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of bytes below 255."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = _types(t)
    lms = _leftmost(s)
    if len(lms):
        ends = np.concatenate((lms[1:], [n]))
        names, _ = _substring_ranks(t, lms, ends, 8)
        lms = lms[_sorted_names(names + 1)]
    buckets = np.bincount(t, minlength=256)
    used = np.flatnonzero(buckets)

    def spread(places: np.ndarray, smaller: bool, own: int, into: list[list[np.ndarray]]) -> np.ndarray:
        """Deals the predecessors of the asked type into their buckets, in order; returns those of the own bucket."""
        before = places[places > 0] - 1
        before = before[s[before] == smaller]
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        before, counts = before[order], np.bincount(symbol, minlength=256)
        at, same = 0, before[:0]
        for c in np.flatnonzero(counts):
            part = before[at : at + counts[c]]
            at += counts[c]
            if c == own:
                same = part
            else:
                into[c].append(part)
        return same

    seeds: list[np.ndarray] = [lms[:0]] * 256
    if len(lms):
        symbol = t[lms]
        order = np.argsort(symbol, kind="stable")
        cut = np.concatenate(([0], np.cumsum(np.bincount(symbol, minlength=256))))
        for c in np.unique(symbol):
            seeds[c] = lms[order][cut[c] : cut[c + 1]]
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[t[n - 1]].append(np.array([n - 1]))
    whole: list[np.ndarray] = [lms[:0]] * 256
    for c in used:
        wave = np.concatenate(larger[c]) if larger[c] else lms[:0]
        parts = []
        while len(wave):
            parts.append(wave)
            wave = spread(wave, False, c, larger)
        whole[c] = np.concatenate(parts) if parts else lms[:0]
        spread(seeds[c], False, c, larger)
    out: list[np.ndarray] = []
    for c in used[::-1]:
        wave = np.concatenate(smaller[c]) if smaller[c] else lms[:0]
        parts = []
        while len(wave):
            parts.append(wave)
            wave = spread(wave, True, c, smaller)
        spread(whole[c][::-1], True, c, smaller)
        out += [*parts, whole[c][::-1]]
    return np.concatenate(out)[::-1]


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Permuted common prefixes: for each place, how far its suffix agrees with the one before it in order.

    Only places that don't follow from their left neighbour are compared, eight bytes at a time; from there the length
    falls by one with each place.
    """
    n = len(t)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    places = np.arange(n)
    left, left_before = t[np.maximum(places - 1, 0)], t[np.maximum(before - 1, 0)]
    fresh = (places == 0) | (before <= 0) | (left != left_before)
    a = places[fresh & (before >= 0)]
    b = before[a]
    padded = np.concatenate((t, np.zeros(16, np.uint8)))
    words = np.ndarray((n + 8,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = np.zeros(n, dtype=np.int64)
    open_ = np.arange(len(a))
    at = 0
    found = np.zeros(len(a), dtype=np.int64)
    while len(open_):
        limit = n - np.maximum(a[open_], b[open_]) - at  # bytes left of the shorter one
        x = words[np.minimum(a[open_] + at, n)] ^ words[np.minimum(b[open_] + at, n)]
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
        same = np.minimum(same, limit)
        found[open_] += same
        open_ = open_[(same == 8) & (limit > 8)]
        at += 8
    length[a] = found
    source = np.maximum.accumulate(np.where(fresh, places, 0))
    return np.maximum(length[source] - (places - source), 0)
