"""SentencePiece encoding and decoding (operator 12): a table of distinct marked words.

SentencePiece turns every blank into a marker and puts one in front of the text. When no piece of the model has a marker
behind another character, no merge joins a run of markers to what stands before it, so a text falls into marked words (a
run of markers with the characters up to the next one) that are segmented independently of each other. Each distinct
marked word of a block is segmented once by the library and kept for later blocks; the ids of a text are joined back by
position. The table is local to a worker and bounded: a table of the whole corpus would have to shuffle every word of
every text to and fro (several times the input) to bring the ids back.

A model whose pieces do cross markers, or whose normaliser changes text, is refused by ``SentencePieces``; ``whole=True``
encodes text by text then.

NULL texts count as empty; an empty text is the begin and end id alone. Texts of any length are read whole. Repeated rows
and rows with a NULL id are encoded each; an empty table gives an empty result. Only the two named columns are read, so
other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import text_blocks, text_column
from gazeledger.llm.word_ids import ChunkTable, chunk_blocks, starts_of

MARK = "▁"
BLOCK_BYTES = 4 << 20
# texts that show whether the model keeps blanks, line ends, composed and decomposed letters and ligatures as they are
_KEPT = ["a  b ", "  a", "a\tb\r\n c", "ﬁ é é ① 　 A"]
_LOADED: dict[str, SentencePieces] = {}


class SentencePieces:
    """One model with the table of the marked words that this worker has met."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.words_apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in names) and all(
            self.model.decode(self.model.encode(t)) == t for t in _KEPT)
        self.begin_id, self.end_id = self.model.bos_id(), self.model.eos_id()
        self.table = ChunkTable(self._segment)

    def _segment(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, each written with blanks; the library puts the first marker back itself."""
        got = self.model.encode([w[1:] for w in words], num_threads=1)
        if " " in words:  # a marker alone: the library would take it for an empty text
            got[words.index(" ")] = self.model.encode("a ")[len(self.model.encode("a")):]
        return got

    def blocks(self, column: pa.Array, whole: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(first row, last row + 1, ids, id offset of every row)``, without begin and end ids, of a column without NULLs."""
        if whole:
            for first, last, _, _ in text_blocks(column, BLOCK_BYTES):
                got = self.model.encode(column.slice(first, last - first).to_pylist(), num_threads=1)
                sizes = np.fromiter(map(len, got), np.int64, len(got))
                yield first, last, np.array([i for ids in got for i in ids], np.uint32), np.append(0, np.cumsum(sizes))
            return
        if not self.words_apart:
            raise ValueError("pieces of this model cross markers or its normaliser changes text: encode whole texts")
        marked = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(
            pa.scalar(" ", column.type), pc.replace_substring(column, MARK, " "), pa.scalar("", column.type)))
        yield from chunk_blocks(marked, self.table, _marked_words, BLOCK_BYTES)


def _marked_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blank = data == 32
    marks = np.zeros(len(data), bool)
    np.logical_and(blank[1:], ~blank[:-1], out=marks[1:])
    return data, starts_of(marks, offsets), offsets


def loaded(path: str) -> SentencePieces:
    if path not in _LOADED:
        _LOADED[path] = SentencePieces(path)
    return _LOADED[path]


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False, whole: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids`` (begin id, pieces, end id) of every row: ARRAY<INT>, or the ids as little-endian unsigned 32-bit
    integers in a BINARY if ``packed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model_path)
        for batch in batches:
            for first, last, tokens, offsets in pieces.blocks(text_column(batch, "text"), whole):
                ends = np.cumsum(np.diff(offsets) + 2)
                begins = np.append(0, ends[:-1])
                ids = np.empty(int(ends[-1]), "<u4")
                inner = np.ones(len(ids), bool)
                for at, value in ((begins, pieces.begin_id), (ends - 1, pieces.end_id)):
                    ids[at] = value
                    inner[at] = False
                ids[inner] = tokens
                bounds = np.append(0, ends).astype(np.int32)
                if packed:
                    values = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)])
                else:
                    values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), values], ["doc_id", "ids"])

    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, f"doc_id bigint, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` with the ``text`` of its ``ids`` (either form) by the library's ``decode``; NULL ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(model_path).model
        for batch in batches:
            ids = batch.column(1)
            if pa.types.is_binary(ids.type):
                texts = [model.decode(np.frombuffer(x.as_buffer(), "<u4").tolist()) if x.is_valid else "" for x in ids]
            else:
                texts = [model.decode(x.as_py()) if x.is_valid else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    kind = encoded.schema["ids"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id bigint, ids {kind}, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and digests of packed ids and decoded texts."""
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
