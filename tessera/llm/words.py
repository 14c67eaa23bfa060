"""Words of many texts at once: boundaries and 64-bit hashes by numpy over Arrow's UTF-8 buffer.

A word is a maximal run of ASCII letters, digits and non-ASCII characters other than Latin-1
signs, general and CJK punctuation. Hashes depend on the word's bytes alone, so they agree
between executors and runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
_RNG = np.random.default_rng(20250101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
for _c in b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
    _WORD[_c] = True
_WORD[128:] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads each bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK + 1024)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INV, np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """``first[i]:first[i + 1]`` are the words of text ``i``; start and end are bytes in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    heads: tuple[np.ndarray, ...] = ()

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _mask(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    for lead, seconds, width in ((0xC2, None, 2), (0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3)):
        at = np.flatnonzero(data == lead)
        if len(at):
            at = at[at + width <= len(data)]
            if seconds:
                at = at[np.isin(data[at + 1], seconds)]
            for k in range(width):
                mask[at + k] = False
    return mask


def _segments(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(mask)
    while lo < n:
        hi = min(n, lo + CHUNK)
        while hi < n and mask[hi - 1]:
            gap = np.flatnonzero(~mask[hi : hi + CHUNK])
            hi = hi + int(gap[0]) + 1 if len(gap) else min(n, hi + CHUNK)
        yield lo, hi
        lo = hi


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Hashes of the bytes ``data[start[k]:end[k]]``; runs are in order and lie where ``inside`` holds."""
    hashes = []
    for lo, hi in _segments(inside):
        a, b = np.searchsorted(start, (lo, hi))
        if a == b:
            continue
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        hashes.append(mix((total[e] - total[s]) * down[s]))
    return np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; for each of ``prefixes`` also the hash of so many first bytes, 0 for words no longer than that."""
    data, offsets = data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)
    mask = _mask(data)
    before = np.empty_like(mask)
    after = np.empty_like(mask)
    if len(mask):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = mask[:-1], mask[1:]
        edge = offsets[:-1][offsets[:-1] < len(data)]
        before[edge] = False
        edge = offsets[1:][offsets[1:] > 0] - 1
        after[edge] = False
    start, end = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    hashes, heads = [], [[] for _ in prefixes]
    for lo, hi in _segments(mask):
        a, b = np.searchsorted(start, (lo, hi))
        if a == b:
            continue
        up, down = _powers(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = start[a:b] - lo, end[a:b] - lo
        hashes.append(mix((total[e] - total[s]) * down[s]))
        for k, length in enumerate(prefixes):
            head = mix((total[np.minimum(e, s + length)] - total[s]) * down[s] + np.uint64(0x5851F42D4C957F2D))
            head[e - s <= length] = 0
            heads[k].append(head)
    none = np.empty(0, np.uint64)
    return Words(
        data, offsets, np.concatenate(hashes) if hashes else none, start, end, np.searchsorted(start, offsets).astype(np.int64),
        tuple(np.concatenate(h) if h else none for h in heads),
    )


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls; ``data[offsets[i]:offsets[i + 1]]`` is value ``i``."""
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def chunked(column: pa.Array, lower: bool = True, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, data, offsets) of runs of rows with about ``limit`` bytes; a longer text is a run by itself."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        column = pc.utf8_lower(column)
    data, offsets = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data, offsets[lo : hi + 1]
        lo = hi


def words_of(texts: list[str], prefixes: tuple[int, ...] = ()) -> Words:
    """Words of a few texts at once, lower-cased."""
    column = pc.utf8_lower(pc.fill_null(pa.array(texts, pa.large_string()), ""))
    return words(*buffers(column), prefixes=prefixes)
