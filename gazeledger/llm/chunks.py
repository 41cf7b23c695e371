"""Content-defined chunk borders: a gear rolling hash over bytes, in numpy over many texts at once."""

from __future__ import annotations

import numpy as np

WINDOW = 16
LIMIT = 65536 // 16
SHORTEST, LONGEST = 10, 256


def _gear() -> np.ndarray:
    """One 16-bit number per byte value, from a multiplicative rule."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD1B54A32D192ED03)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.uint16)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """``h[i] = 2 * h[i - 1] + gear[data[i]]`` modulo 2**16: the sum of the last 16 bytes' gears, shifted by their age.

    Sums over 2, 4, 8 and 16 bytes are put together from two halves each.
    """
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        more = h.copy()
        more[reach:] += h[:-reach] << np.uint16(reach)
        h, reach = more, 2 * reach
    return h


def borders(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk of several texts in a row, and the text it belongs to; a chunk ends where the next begins.

    A border follows a byte whose hash is below ``LIMIT``, unless another such byte lies fewer than ``SHORTEST`` bytes
    before: a rule of the 26 bytes before the border alone, so equal passages get equal borders wherever they stand.
    Only stretches without any border for ``LONGEST`` bytes are cut by count. Characters stay whole: a border inside
    one moves to its end.
    """
    sizes = np.diff(offsets)
    inner = (data & 0xC0) == 0x80  # bytes within a character
    h = gear_hashes(data) if len(data) else np.zeros(0, np.uint16)
    low = np.flatnonzero(h < LIMIT)
    owner = np.searchsorted(offsets, low, side="right") - 1
    whole = low - offsets[owner] >= WINDOW - 1
    low, owner = low[whole], owner[whole]
    far = np.ones(len(low), bool)
    far[1:] = (np.diff(low) >= SHORTEST) | (np.diff(owner) > 0)
    low, owner = low[far], owner[far]
    after = low + 1
    for _ in range(3):  # on to the next character
        after += np.append(inner, False)[after]
    inside = after < offsets[owner + 1]
    starts = np.concatenate([offsets[:-1][sizes > 0], after[inside]])
    owners = np.concatenate([np.flatnonzero(sizes > 0), owner[inside]])
    order = np.argsort(starts, kind="stable")
    starts, owners = starts[order], owners[order]
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    parts = np.maximum(1, -(-(ends - starts) // LONGEST))
    if len(parts) and parts.max() > 1:
        first = np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + (np.arange(parts.sum()) - first) * LONGEST
        owners = np.repeat(owners, parts)
        for _ in range(3):
            starts = starts - inner[starts]
    return starts, owners
