"""Quality classification (operator 2): nearest-neighbour voting over latent-semantic vectors.

Terms of a text are four-grams of character classes and two levels of repetition (words that repeat the word before,
words seen before), counted over the whole text, so noise looks alike in every language. Fitting takes at most
``SAMPLE`` labelled rows, chosen by a hash of the id and of each id one text (the first by hash), weighs their terms (log count times inverse document frequency)
and keeps the ``DIMENSIONS`` strongest singular directions. The labelled vectors (at most SAMPLE x DIMENSIONS doubles)
go to every task; each block of documents is compared with all of them by exact cosine products, and the
``NEIGHBOURS`` nearest vote with the power ``SHARPNESS`` of their similarity.

NULL texts count as empty. A text with no similar neighbour, an empty one for instance, gets the share of good labels as
its score; without any label that is 0.5. Equal similarities are taken in the order of the sample. Repeated labels of an
id are averaged (one half counts as good), NULL labels are ignored. Repeated rows are scored each. Only the named
columns are read; ``keep_good`` keeps all columns of its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import span_hashes, text_blocks, text_column

SAMPLE = 2000
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 9, 8
SCORES = "doc_id bigint, held_out boolean, score double, predicted int"
_LEVELS = 8
TERMS = 7**4 + 2 * _LEVELS


def _classes() -> np.ndarray:
    """Digit, upper, lower, space, other white space, punctuation, beyond ASCII and control characters."""
    kinds = np.full(256, 6, np.int64)
    for k, chars in enumerate(["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " ", "\t\n\v\f\r"]):
        kinds[list(chars.encode())] = k
    kinds[[c for c in range(33, 127) if kinds[c] == 6]] = 5
    return kinds


CLASS = _classes()
SPACE = (CLASS == 3) | (CLASS == 4)


def terms(data: np.ndarray) -> np.ndarray:
    """Term counts of one text given as UTF-8 bytes."""
    out = np.zeros(TERMS, np.float32)
    kinds = CLASS[data]
    if len(kinds) >= 4:
        grams = ((kinds[:-3] * 7 + kinds[1:-2]) * 7 + kinds[2:-1]) * 7 + kinds[3:]
        out[: 7**4] = np.bincount(grams, minlength=7**4)
    edges = np.diff(np.concatenate([[1], SPACE[data].astype(np.int8), [1]]))
    words = span_hashes(data, np.flatnonzero(edges == -1), np.flatnonzero(edges == 1))
    n = len(words)
    if n:
        again, seen = np.count_nonzero(words[1:] == words[:-1]), n - len(np.unique(words))
        out[7**4 + min(_LEVELS * again // n, _LEVELS - 1)] = n
        out[7**4 + _LEVELS + min(_LEVELS * seen // n, _LEVELS - 1)] = n
    return out


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 1e-9, length, 1.0)


@dataclass
class Model:
    weights: np.ndarray  # per term
    directions: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled rows x dimensions, unit length
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return _unit(_unit(np.log1p(counts) * self.weights) @ self.directions)

    def score(self, counts: np.ndarray) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        near = self.embed(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        top = np.argsort(-near, axis=1, kind="stable")[:, :k]
        votes = np.maximum(np.take_along_axis(near, top, 1), 0.0) ** SHARPNESS
        total = votes.sum(1)
        return np.clip(np.where(total > 1e-12, (votes * self.labels[top]).sum(1) / np.maximum(total, 1e-12), prior), 0.0, 1.0)


def latent_model(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = 12) -> Model:
    """Leading singular directions by subspace iteration from a fixed start; beside the counts it holds one matrix of their
    size in single precision."""
    weights = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1
    rows = np.log1p(counts)
    rows *= weights.astype(np.float32)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    rows /= np.where(length > 1e-9, length, 1).astype(np.float32)
    width = min(dimensions + 16, *rows.shape)
    basis = np.random.default_rng(1).normal(size=(rows.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0] if width else basis
    _, values, turn = np.linalg.svd((rows @ basis).astype(np.float64), full_matrices=False)
    keep = values[:dimensions] > 1e-4
    directions = basis.astype(np.float64) @ turn[:dimensions][keep].T
    del rows
    model = Model(weights, directions, np.zeros((0, directions.shape[1])), labels.astype(np.float64))
    parts = [model.embed(counts[i : i + 256]) for i in range(0, len(counts), 256)]
    model.vectors = np.concatenate(parts) if parts else model.vectors
    return model


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Learn from labelled rows where ``learn``, a condition on the id column, holds."""
    chosen = (
        labels.where(learn & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label_col) >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(text_column(batch, "text")):
                rows = [terms(data[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(rows, pa.binary())],
                    ["id", "label", "counts"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    one = own.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    rows = one.select(F.col("id").cast("bigint"), "label", F.col("one.text").alias("text")).mapInArrow(
        count, "id bigint, label double, counts binary").collect()
    rows.sort(key=lambda r: (r["id"], r["counts"]))
    counts, marks = np.zeros((len(rows), TERMS), np.float32), np.array([r["label"] for r in rows])
    for i in range(len(rows) - 1, -1, -1):
        counts[i] = np.frombuffer(rows.pop()["counts"], np.float32)
    return latent_model(counts, marks)


def score(
    docs: DataFrame, model: Model, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Score and prediction of every document."""
    return _scored(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))).alias("held_out"),
            F.col(text_col).alias("text")),
        model, "text", SCORES, ["doc_id", "held_out"])


def _scored(own: DataFrame, model: Model, text_col: str, schema, keep: list[str], least: float | None = None) -> DataFrame:
    """With ``least``, rows that reach it, with the columns ``keep`` only; else all with their score and prediction."""
    broadcast = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_model = broadcast.value
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(text_column(batch, text_col)):
                for first in range(0, hi - lo, 512):
                    some = offsets[first : first + 513]
                    counts = np.array([terms(data[a:b]) for a, b in zip(some[:-1], some[1:], strict=True)])
                    scores = own_model.score(counts)
                    part = batch.slice(lo + first, len(scores)).select(keep)
                    if least is not None:
                        yield part.filter(pa.array(scores >= least))
                    else:
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())],
                            [*keep, "score", "predicted"])

    return own.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, with all their columns."""
    return _scored(docs, model, text_col, docs.schema, docs.columns, least)
