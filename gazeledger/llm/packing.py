"""Packing (operator 10): power-of-two decomposition of token sequences.

Every document becomes its token ids plus an end id, cut from the front into pieces whose lengths are the binary digits
of its token count: as many pieces of the longest sequence length as fit, then falling powers of two. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; pieces of equal length form one bucket
and are numbered in a row, bucket after bucket.

NULL and empty texts consist of the end id alone (one piece of length 1). Repeated rows and NULL ids are packed row by
row; equal texts give equal pieces, in sequences of their own. Texts of any length are read whole, a longer one than a
block as a block of its own. An empty table gives an empty result. Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gazeledger.llm.common import lists, materialise, text_column
from gazeledger.llm.word_ids import ChunkTable, chunk_blocks, starts_of

SEQUENCE_TOKENS = 2048
END_ID = 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, slot bigint"
BLOCK_BYTES, TABLE_CHUNKS, TABLE_IDS = 2 << 20, 100_000, 1_500_000  # bound what an idle worker keeps
_LETTERS = re.compile(r"[a-zà-öø-ÿ]+")
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BLANK, _LETTER, _OTHER, _WIDE = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _BLANK
_KIND[(_LOWER >= 97) & (_LOWER <= 122)] = _LETTER
_KIND[128:] = _WIDE
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids of whole texts through the ``tokenizers`` library, with the ids of chunks kept between batches.

    The vocabulary drops white space, lower-cases, and never joins a letter with white space or punctuation, so the ids of
    a text are those of its chunks in a row (see ``_chunks``). Only chunks that the table does not hold are segmented; runs
    of letters go to the library many at a time and are told apart by the word-end mark of their last token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.table = ChunkTable(self.segment, TABLE_CHUNKS, TABLE_IDS)

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> list[list[int]]:
        groups = [runs[lo : lo + 512] for lo in range(0, len(runs), 512)]
        out: list[list[int]] = []
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups]), strict=True):
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist() if ids else []
            if len(cuts) == len(group):
                out += [ids[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                out += self._encoded(group)
        return out

    def segment(self, chunks: list[str]) -> list[list[int]]:
        plain = [bool(_LETTERS.fullmatch(c)) for c in chunks]
        runs = iter(self._runs([c for c, p in zip(chunks, plain, strict=True) if p]))
        rest = [c for c, p in zip(chunks, plain, strict=True) if not p]
        others = iter([ids for lo in range(0, len(rest), 4096) for ids in self._encoded(rest[lo : lo + 4096])])
        return [next(runs) if p else next(others) for p in plain]

    def blocks(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, last row + 1, ids, id offset of every row)`` over the rows of a column without NULLs."""
        return chunk_blocks(column, self.table, _chunks, BLOCK_BYTES)


def _chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space and with A-Z in lower case, cut at white space and behind runs of Latin letters
    that ASCII punctuation or a digit follows."""
    kind = _KIND[data]
    letter = kind == _LETTER
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    marks = np.zeros(len(data), bool)
    marks[1:] = (kind[:-1] == _BLANK) | (letter[:-1] & (kind[1:] == _OTHER))
    keep = kind != _BLANK
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    offsets = before[offsets]
    return _LOWER[data[keep]], starts_of(marks[keep], offsets), offsets


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def piece_lengths(tokens: np.ndarray, longest: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """Index into ``tokens`` and length of every piece: ``longest`` (a power of two) as often as it fits, then the set bits
    of the rest, largest first."""
    powers = longest >> np.arange(longest.bit_length())
    times = (tokens[:, None] // powers) & 1
    times[:, 0] = tokens // longest
    return np.repeat(np.arange(len(tokens)), times.sum(axis=1)), np.repeat(np.tile(powers, len(tokens)), times.ravel())


def pieces(
    docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE_TOKENS, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
) -> DataFrame:
    """One row per piece: the columns of ``PIECES`` and, if wanted, the token ids. ``part`` and ``slot`` number the pieces
    of one length within a task."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, used = encoder(tokenizer_path), TaskContext.get().partitionId(), dict.fromkeys(
            (longest >> b for b in range(longest.bit_length())), 0)
        for batch in batches:
            for lo, hi, tokens, offsets in enc.blocks(text_column(batch, "text")):
                size = np.diff(offsets) + 1
                ends = np.cumsum(size)
                ids = np.empty(int(ends[-1]), "<u4")
                ids[ends - 1] = end_id
                own = np.ones(len(ids), bool)
                own[ends - 1] = False
                ids[own] = tokens
                doc, length = piece_lengths(size, longest)
                after = np.cumsum(length)
                view = memoryview(ids).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip((after - length).tolist(), after.tolist(), strict=True)]
                slot = np.empty(len(length), np.int64)
                for kind in used:
                    same = np.flatnonzero(length == kind)
                    slot[same] = used[kind] + np.arange(len(same))
                    used[kind] += len(same)
                arrays = [
                    batch.column(0).take(pa.array(lo + doc)), pa.array(after - length - (ends - size)[doc]), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(size[doc]), pa.array(np.full(len(doc), part), pa.int32()), pa.array(slot)]
                if with_ids:
                    arrays.append(lists(ids.astype(np.int32), np.append(0, after), pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def pack(docs: DataFrame, tokenizer_path: str, longest: int = SEQUENCE_TOKENS, with_ids: bool = True, **names) -> DataFrame:
    """Pieces with ``sequence_id`` (dense, sequences of one length in a row) and ``offset`` (always 0).

    The pieces are written once to the shared folder, so numbers stay the same whatever executor reads them again. The
    numbering needs one count per task and length, not a sort of the pieces.
    """
    cut = materialise(pieces(docs, tokenizer_path, longest, with_ids=with_ids, **names), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select(
        "length", F.coalesce(F.sum("n").over(shorter), F.lit(0)).alias("base"))
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(buckets), "length").select(
        "length", "part", (F.col("base") + F.col("before")).alias("first"))
    return cut.join(first, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("slot")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), *(["ids"] if with_ids else []))
