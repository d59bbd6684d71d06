"""Suffix order and longest-previous-factor arrays in numpy, for texts that fit a task."""

from __future__ import annotations

import numpy as np

FIRST = 8


def head_keys(text: np.ndarray) -> np.ndarray:
    """The first eight bytes of every suffix as a big-endian word; zeros follow the text."""
    wide = np.append(text, np.zeros(FIRST, np.uint8)).astype(np.uint64)
    key = np.zeros(len(text), np.uint64)
    for k in range(FIRST):
        key |= wide[k : k + len(text)] << np.uint64(8 * (FIRST - 1 - k))
    return key


def prefix_ranks(text: np.ndarray, depth: int, places: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the suffixes at `places` (without: of all) by their first `depth` bytes (8 or more), equal ranks for equal ones.

    Prefix doubling by overlapping parts, as many a turn as there is room for their ranks and a place in one word (below 64 KB
    three: 6, 8, 23, 67, 200 bytes). A turn sorts only suffixes that are still tied, and of these only those that the places
    still tied among themselves lead to. Zeros are read beyond the end.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    bits = n.bit_length()
    first, ways = (64 - bits) // FIRST, 64 // bits - 1
    if ways < 2:
        bits, first, ways = 32, FIRST, 2
    depths = [depth]
    while depths[0] > first:
        depths.insert(0, max(first, -(-depths[0] // ways)))
    steps = [[min(k * a, b - a) for k in range(-(-b // a))] for a, b in zip(depths, depths[1:])]
    # How far behind a place lie the suffixes that a turn and those after it read.
    reach = [{0}]
    for step in steps[:0:-1]:
        reach.insert(0, {a + b for a in reach[0] for b in step})
    key, order = _sorted(head_keys(text) >> np.uint64(8 * (FIRST - first)), bits)
    # The place of the first of equals in suffix order, from 1; 0 beyond the end.
    rank = np.zeros(n + depth, np.int64)
    rank[order] = _first_of_equals(key) + 1
    inside = slice(0, n) if places is None else places
    for step, far in zip(steps, reach):
        open_ = np.zeros(n, bool)
        open_[inside] = _tied(rank[inside], n)
        needed = np.zeros(n, bool)
        for k in far:
            needed[k:] |= open_[: n - k] if k < n else False
        at = np.flatnonzero(needed)
        at = at[_tied(rank[at], n)]
        if not len(at):
            break
        key = rank[at].astype(np.uint64)
        for k in step[1:]:
            key = (key << np.uint64(bits)) | rank[at + k].astype(np.uint64)
        key, by = _sorted(key, bits)
        at = at[by]
        # Suffixes of one group stay between the groups around it.
        old = rank[at]
        rank[at] = old + _first_of_equals(key) - _first_of_equals(old)
    return rank[inside] - 1


def _sorted(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, their places); places below 2 ** bits are sorted with the keys where a word has room for both, as
    numpy sorts words several times faster than places by words."""
    if bits == 32:
        order = np.argsort(key)
        return key[order], order
    both = np.sort((key << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def _first_of_equals(x: np.ndarray) -> np.ndarray:
    """For each place of a sorted array, the first place with its value."""
    return np.maximum.accumulate(np.where(np.append(True, x[1:] != x[:-1]), np.arange(len(x)), 0))


def _tied(rank: np.ndarray, most: int) -> np.ndarray:
    """Which ranks, 0 to `most`, occur twice or more."""
    return (np.bincount(rank, minlength=most + 1) > 1)[rank]


def _pair(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One word that sorts by both; numpy sorts such words several times faster than by two keys."""
    return (high.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier place with a smaller value, or -1; by pointer jumping."""
    at = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((at >= 0) & (values[np.maximum(at, 0)] > values))
    while len(open_):
        at[open_] = at[at[open_]]
        still = at[open_]
        open_ = open_[(still >= 0) & (values[np.maximum(still, 0)] > values[open_])]
    return at


def has_other(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in the order of their positions, where the longest previous factor reaches the depth of the ranks, and
    where the longest factor that begins later does.

    In suffix order (rank, then position) the longest match with an earlier position is that with the previous or the
    next smaller position. Within equal ranks positions rise, so the previous smaller one is the neighbour before, and the
    next smaller one has another rank; from the other end it is the neighbour behind.
    """
    order = np.sort(_pair(rank, np.arange(len(rank), dtype=np.uint64)))
    ranks, order = order >> np.uint64(32), (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = ranks[1:] == ranks[:-1]
    earlier, later = np.zeros(len(rank), bool), np.zeros(len(rank), bool)
    earlier[order[1:]], later[order[:-1]] = same, same
    return earlier, later


def longest_previous_factors(text: np.ndarray, depth: int) -> np.ndarray:
    """LPF values cut off at `depth`: the longest match of each suffix with one that begins earlier."""
    n = len(text)
    rank = prefix_ranks(text, depth)
    order = np.argsort(_pair(rank, np.arange(n)))
    before = nearest_smaller(order)
    after = n - 1 - nearest_smaller(order[::-1])[::-1]
    out = np.zeros(n, np.int64)
    for near in (before, np.where(after < n, after, -1)):
        has = np.flatnonzero(near >= 0)
        a, b = order[has], order[near[has]]
        length, open_ = np.zeros(len(has), np.int64), np.arange(len(has))
        while len(open_):
            x, y = a[open_] + length[open_], b[open_] + length[open_]
            fine = (np.maximum(x, y) < n) & (length[open_] < depth)
            open_ = open_[fine]
            open_ = open_[text[x[fine]] == text[y[fine]]]
            length[open_] += 1
        out[a] = np.maximum(out[a], length)
    return out
