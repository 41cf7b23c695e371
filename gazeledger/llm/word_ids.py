"""Token ids of texts by a table of their distinct chunks; what operators 10 and 12 share.

A text is cut into chunks that the tokenizer never joins across. Every distinct chunk is segmented once, its ids stand in
one growing array, and the ids of a text are gathered by position from there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa

from gazeledger.llm.common import text_blocks

TABLE_CHUNKS, TABLE_IDS = 250_000, 4_000_000


class ChunkTable:
    """``segment`` gives the ids of new chunks. From ``chunks`` entries on, chunks that stand once in a block are forgotten
    after it; at twice as many, or beyond ``ids``, the table starts anew. Its size so depends on the bounds and one block."""

    def __init__(self, segment: Callable[[list[str]], Sequence[Sequence[int]]], chunks: int = TABLE_CHUNKS, ids: int = TABLE_IDS):
        self.segment, self.max_chunks, self.max_ids = segment, chunks, ids
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(1 << 12, np.int64)

    def _add(self, chunks: list[str]) -> None:
        got = self.segment(chunks)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        first, more = len(self.places), int(sizes.sum())
        if self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used, 2 * more), np.uint32)])
        if first + len(chunks) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(first, 2 * len(chunks)), np.int64)])
        at = self.used
        for ids in got:
            self.flat[at : at + len(ids)] = ids
            at += len(ids)
        self.begin[first + 1 : first + 1 + len(chunks)] = self.used + np.cumsum(sizes)
        self.used = at
        self.places.update(zip(chunks, range(first, first + len(chunks)), strict=True))

    def ids(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks that begin at ``starts`` (the first at 0) and end at the next, and the id count before each."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if len(self.places) > 2 * self.max_chunks or self.used > self.max_ids:
            self._clear()
        ends = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()
        distinct, indices = chunks.dictionary.to_pylist(), chunks.indices.to_numpy()
        where = np.fromiter(map(self.places.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(where < 0)
        once = np.bincount(indices, minlength=len(distinct))[new] == 1
        kept = [distinct[i] for i in new[~once].tolist()]
        passing = [distinct[i] for i in new[once].tolist()]
        where[new[~once]] = len(self.places) + np.arange(len(kept))
        where[new[once]] = len(self.places) + len(kept) + np.arange(len(passing))
        if kept:
            self._add(kept)
        mark = self.used
        if passing:
            self._add(passing)
        which = where[indices]
        begin = self.begin[which]
        counts = self.begin[which + 1] - begin
        before = np.zeros(len(which) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        at = np.repeat((begin - before[:-1]).astype(np.int32), counts)
        at += np.arange(len(at), dtype=np.int32)
        ids = self.flat[at]
        if len(self.places) > self.max_chunks:
            for chunk in passing:
                del self.places[chunk]
            self.used = mark
        return ids, before


def chunk_blocks(
    column: pa.Array, table: ChunkTable, cut: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int,
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, last row + 1, ids, id offset of every row)`` over blocks of rows of about ``limit`` bytes.

    ``cut`` takes the bytes and text offsets of a block and returns the bytes to segment, the sorted chunk starts in them
    (no chunk crosses a text) and the text offsets in them.
    """
    for first, last, data, offsets in text_blocks(column, limit):
        data, starts, offsets = cut(data, offsets)
        ids, before = table.ids(data, starts)
        yield first, last, ids, before[np.searchsorted(starts, offsets)]


def starts_of(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the marks and of the first byte of every text that is not empty."""
    marks[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(marks)
