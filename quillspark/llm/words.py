"""Hashes of words straight from the UTF-8 bytes of many texts; nothing outlives a call."""

from __future__ import annotations

import numpy as np
import xxhash

from quillspark.llm.common import finish

BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of more bytes than this are hashed one by one.
LONG = 256
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def byte_mask(values) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(values)] = True
    return mask


#: ASCII letters and digits and all bytes beyond ASCII; whatever else separates words.
ALNUM = byte_mask([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd base to the powers 0..n-1, and its inverse's, modulo 2**64."""

    def chain(x: int) -> np.ndarray:
        out = np.full(n, x, np.uint64)
        out[:1] = 1
        return np.cumprod(out, dtype=np.uint64)

    return chain(BASE), chain(pow(BASE, -1, 1 << 64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of bytes starts..ends for each word, eight bytes a step; it depends on these bytes alone."""
    size = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    wide = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    h = finish(size.astype(np.uint64) + np.uint64(seed * BASE % (1 << 64)))
    long = np.flatnonzero(size > LONG)
    active = np.flatnonzero(size <= LONG) if len(long) else slice(None)
    at, left = starts[active], size[active]
    own = h[active]
    while len(own):
        own = finish((own ^ (wide[at] & _FIRST[np.minimum(left, 8)])) * np.uint64(BASE))
        h[active] = own
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        active = more if isinstance(active, slice) else active[more]
        at, left, own = at[more] + 8, left[more] - 8, own[more]
    for k in long.tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return h


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest runs of True that no text's edge cuts."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    return np.flatnonzero(inside & (edge[:-1] | ~before)), np.flatnonzero(inside & (edge[1:] | ~after)) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray = ALNUM, seed: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word after lower-casing A-Z, text of each word)."""
    starts, ends = spans(letters[data], offsets)
    return word_hashes(LOWER[data], starts, ends, seed), np.searchsorted(offsets, starts, "right") - 1
