"""Word shingles of texts as 64-bit hashes, and HyperMinHash registers over them, in numpy over Arrow buffers."""

from __future__ import annotations

import math

import numpy as np

from gazeledger.llm.common import mix, span_hashes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ROWS = 5
MANTISSA_BITS = 10
EMPTY = 0xFFFF
_PLACES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of several texts in a row, and the offset of every text's first word."""
    text = LOWER[data]
    inside = ~SEPARATOR[text]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return span_hashes(text, starts, ends), np.searchsorted(starts, offsets)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles (not distinct), and offsets per text. A text with fewer words has its whole
    sequence as one shingle, a text without words none."""
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    per_text = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(per_text)])
    m = len(words)
    if not m:
        return np.zeros(0, np.uint64), out_at
    reach = np.minimum(np.repeat(at[1:], counts) - np.arange(m), size)  # words from here to the end of the text
    first = np.zeros(m, bool)
    first[at[:-1][counts > 0]] = True
    keep = (reach == size) | first
    total = mix(reach.astype(np.uint64) + np.uint64(1))
    for j in range(size):
        place = np.uint64(_PLACES[j % len(_PLACES)] + 2 * (j // len(_PLACES)))
        part = np.zeros(m, np.uint64)
        part[: m - j] = words[j:] * place
        part[reach <= j] = 0
        total += part
    return mix(total[keep]), out_at


def distinct_sets(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands that miss a pair of similarity ``threshold`` with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def registers(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """HyperMinHash registers, ``texts x bands x rows`` of uint16.

    Every band hashes the shingles anew and deals them into ``rows`` buckets. A bucket keeps its least value, compressed
    to the number of leading zeros (6 bits) and the ``MANTISSA_BITS`` bits after the leading one; empty buckets are
    ``EMPTY``. Equal sets have equal registers, and a register of two sets is equal with a chance near their similarity.
    """
    texts = len(offsets) - 1
    out = np.full((texts, bands, rows), EMPTY, np.uint16)
    filled = np.flatnonzero(np.diff(offsets) > 0)
    top = np.uint64(2**56 - 1)
    step = 1 << 15  # values that stay in the processor's cache
    group = 0
    while group < len(filled):
        stop = max(group + 1, int(np.searchsorted(offsets[filled], offsets[filled[group]] + step)))
        stop = min(stop, len(filled))
        own = filled[group:stop]
        lo, hi = offsets[own[0]], offsets[own[-1] + 1]
        values, starts = hashes[lo:hi], offsets[own] - lo
        for b in range(bands):
            g = mix(values, 0x9E3779B97F4A7C15 * (b + 1) % 2**64)
            bucket = ((g >> np.uint64(56)) * np.uint64(rows)) >> np.uint64(8)
            g &= top
            for r in range(rows):
                least = np.minimum.reduceat(np.where(bucket == np.uint64(r), g, top), starts)
                out[own, b, r] = _compressed(least, top)
        group = stop
    return out


def _compressed(values: np.ndarray, empty: np.uint64) -> np.ndarray:
    exact = np.minimum(values, np.uint64(2**56 - 2)).astype(np.float64)
    fraction, exponent = np.frexp(np.maximum(exact, 1.0))
    zeros = (56 - exponent).astype(np.uint16)
    mantissa = np.minimum(((fraction - 0.5) * 2 ** (MANTISSA_BITS + 1)).astype(np.uint16), 2**MANTISSA_BITS - 1)
    return np.where(values == empty, np.uint16(EMPTY), (zeros << MANTISSA_BITS) | mantissa).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    total = np.zeros(regs.shape[:2], np.uint64)
    for r in range(regs.shape[2]):
        total = mix(total + regs[:, :, r].astype(np.uint64) + np.uint64(1), _PLACES[r % len(_PLACES)])
    return mix(total + np.arange(regs.shape[1], dtype=np.uint64))


def estimate(equal: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Similarity from the number of equal and of filled registers, less the equalities that chance gives.

    Two different values agree in leading zeros with a chance of 1/3 and then in the mantissa with one of
    2**-MANTISSA_BITS.
    """
    chance = 2.0**-MANTISSA_BITS / 3
    return np.clip((equal / np.maximum(filled, 1) - chance) / (1 - chance), 0.0, 1.0)
