"""Words of whole texts as 64-bit values, made for a batch at a time with array operations."""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 24


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit (finaliser of splitmix64, a published generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)
_POWERS = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(255, _BASE, np.uint64))])


def byte_classes(separators: bytes) -> np.ndarray:
    """For each byte its lower-cased value, or 0 for a separator. Bytes over 127 are letters of longer characters;
    NUL, where it is no separator, takes a value that lower-casing has freed."""
    classes = np.arange(256, dtype=np.uint8)
    classes[65:91] += 32
    classes[0] = 65
    classes[list(separators)] = 0
    return classes


#: Words of all but white space.
SPACED = byte_classes(b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words of digits, Latin letters and whatever is not ASCII.
ALPHANUMERIC = byte_classes(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def word_values(flat: np.ndarray, offsets: np.ndarray, classes: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The words of texts that lie end to end: (values, bounds); text i has values[bounds[i]:bounds[i + 1]]. With
    `prefix` only so many first bytes of a word decide its value."""
    values, bounds, first = [], [np.zeros(1, np.int64)], 0
    total = 0
    while first < len(offsets) - 1:
        # Whole texts, about one chunk at a time; one text may be longer than a chunk.
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + _CHUNK, "right")) - 1)
        own, own_bounds = _words(flat[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], classes, prefix)
        values.append(own)
        bounds.append(own_bounds[1:] + total)
        total, first = total + len(own), last
    return (np.concatenate(values) if values else np.empty(0, np.uint64)), np.concatenate(bounds)


def _words(flat: np.ndarray, offsets: np.ndarray, classes: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    lower = classes[flat]
    inside = np.zeros(len(flat) + 1, bool)
    inside[1:] = lower != 0
    begins = inside[1:] & ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(flat))]
    begins[cuts] = inside[1:][cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside[1:])
    # Word bytes without separators; first byte of each word in that list.
    heads = np.searchsorted(at, starts)
    lengths = np.diff(np.append(heads, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(heads, lengths)
    powers = _POWERS[np.minimum(place, 255)]
    far = place > 255
    if far.any():
        powers[far] = _far_powers(place[far])
    if prefix:
        powers = np.where(place < prefix, powers, np.uint64(0))
        lengths = np.minimum(lengths, prefix)
    sums = np.add.reduceat(_BYTE[lower[at]] * powers, heads)
    values = _mix(sums + lengths.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    return values, np.searchsorted(starts, offsets)


def _far_powers(place: np.ndarray) -> np.ndarray:
    """Powers of the base beyond the table, by squaring."""
    out, base, e = np.ones(len(place), np.uint64), _BASE, place.astype(np.uint64)
    while e.any():
        out = np.where(e & np.uint64(1), out * base, out)
        with np.errstate(over="ignore"):
            base = np.uint64((int(base) * int(base)) & 0xFFFFFFFFFFFFFFFF)
        e = e >> np.uint64(1)
    return out


def gram_values(values: np.ndarray, n: int) -> np.ndarray:
    """Value of the n words from each position on; the last n - 1 positions have none."""
    count = len(values) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += values[k:k + count] * _POWERS[k + 1]
    return _mix(total ^ np.uint64(n))
