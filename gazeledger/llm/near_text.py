"""MinHash near-duplicates (operator 9): HyperMinHash registers, banded, estimated and verified on full sets.

1. One pass per text: distinct word shingles, a 128-bit key of the set, and registers (leading zeros plus mantissa bits
   per bucket) in as many bands as make a missed pair as rare as ``MISS``.
2. Texts with equal sets are one class, represented by its smallest id.
3. Representatives that agree on all registers of a band share a bucket. Small buckets give pairs, each checked once:
   sizes, then the collision-corrected estimate, then the sets. Large buckets are cut into blocks of a bounded number of
   shingles; each pair of blocks is one group, in which pairs are taken by falling estimate and those already connected
   are passed over, so a group gives a spanning forest and never all of its pairs.
4. Connected components of the links; every document gets the smallest id it reaches.

Similarity is |A n B| / |A u B| over distinct shingles of lower-cased (A-Z) words; a text with fewer words than a shingle
has its whole sequence as one. NULL, empty and white-space texts have no shingles and link with nothing. Rows that repeat
an id with other texts count as one document with the links of all. Rows with a NULL id link with nothing: their component
is NULL and they are kept. Very long texts are read whole. Empty tables give empty results. Only the two named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import keep_ids, lists, materialise, mix, text_blocks, text_column
from gazeledger.llm.components import components
from gazeledger.llm.shingles import EMPTY, ROWS, band_keys, bands_for, distinct_sets, estimate, registers, shingle_hashes

MISS = 1e-6
SMALL_BUCKET = 32
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1_000_000
DEVIATIONS = 4.5  # by which an estimate may lie too low
SIGNATURE = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, registers binary"


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes per set."""
    sums = [(mix(s, 11).sum(dtype=np.uint64), mix(s, 29).sum(dtype=np.uint64), len(s)) for s in sets]
    one, two, n = (np.array(x, np.uint64) for x in zip(*sums, strict=True)) if sums else (np.zeros(0, np.uint64),) * 3
    return mix(one + n).view(np.int64), mix(two + n).view(np.int64)


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def signatures(own: DataFrame, size: int, bands: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(text_column(batch, "text")):
                hashes, at = shingle_hashes(data, offsets, size)
                sets = distinct_sets(hashes, at)
                regs = registers(hashes, at, bands)
                k1, k2 = set_keys(sets)
                flat = band_keys(regs).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2),
                    lists(flat, np.arange(hi - lo + 1) * bands, pa.int64()), pa.array([r.tobytes() for r in regs], pa.binary()),
                ], [c.split()[0] for c in SIGNATURE.split(", ")])

    return own.mapInArrow(sign, SIGNATURE)


def full_sets(own: DataFrame, size: int) -> DataFrame:
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(text_column(batch, "text")):
                sets = distinct_sets(*shingle_hashes(data, offsets, size))
                k1, k2 = set_keys(sets)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(k1), pa.array(k2), lists(flat, np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype=np.int64)]), pa.int64())],
                    ["doc_id", "k1", "k2", "shingles"])

    return own.mapInArrow(collect, "doc_id bigint, k1 bigint, k2 bigint, shingles array<bigint>")


def least_estimate(percent: int, bands: int) -> float:
    t = percent / 100
    return t - DEVIATIONS * (t * (1 - t) / (bands * ROWS)) ** 0.5


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of register rows; broadcasting as numpy does."""
    filled = (a != EMPTY) | (b != EMPTY)
    return estimate(((a == b) & filled).sum(-1), filled.sum(-1))


def _register_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def likely_pairs(pairs: DataFrame, least: float) -> DataFrame:
    """Of ``a, b, ra, rb`` the pairs whose registers may belong to similar sets."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = estimates(_register_rows(batch.column(2)), _register_rows(batch.column(3))) >= least
                yield batch.select(["a", "b"]).filter(pa.array(found))

    return pairs.select("a", "b", "ra", "rb").mapInArrow(test, "a bigint, b bigint")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def spanning_links(ids: np.ndarray, side: np.ndarray, regs: np.ndarray, sets: list[np.ndarray], percent: int, least: float) -> list[tuple[int, int]]:
    """Links that connect whatever is similar in a group. ``side`` is 0 or 1; with both present only pairs across count."""
    sizes = np.array([len(s) for s in sets])
    left = np.flatnonzero(side == 0)
    across = bool((side == 1).any())
    right = np.flatnonzero(side == 1) if across else left
    if not len(left):
        return []
    rows, columns, scores = [], [], []
    step = max(1, 4_000_000 // max(1, len(right) * regs.shape[1]))
    for first in range(0, len(left), step):
        some = left[first : first + step]
        found = estimates(regs[some][:, None, :], regs[right][None, :, :])
        a, b = sizes[some][:, None], sizes[right][None, :]
        fits = (found >= least) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        if not across:
            fits &= some[:, None] < right[None, :]
        x, y = np.nonzero(fits)
        rows.append(some[x])
        columns.append(right[y])
        scores.append(found[x, y])
    x, y = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(-np.concatenate(scores), kind="stable")
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in zip(x[order].tolist(), y[order].tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            n = shared(sets[i], sets[j])
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                root[p] = q
                links.append((int(ids[i]), int(ids[j])))
    return links


def block_links(rows: DataFrame, percent: int, least: float) -> DataFrame:
    """``rows``: key, i, j, side, doc_id, registers, shingles, with the rows of a group next to each other."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group = None

        def done() -> pa.RecordBatch:
            ids, side, regs, sets = zip(*held, strict=True)
            found = spanning_links(np.array(ids), np.array(side), np.array(regs), list(sets), percent, least)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, side, ids = (batch.column(c).to_pylist() for c in range(5))
            regs = _register_rows(batch.column(5))
            offsets = batch.column(6).offsets.to_numpy()
            values = batch.column(6).values.to_numpy().view(np.uint64)  # sets are sorted as unsigned numbers
            for n in range(batch.num_rows):
                now = (key[n], i[n], j[n])
                if now != group and held:
                    yield done()
                    held = []
                group = now
                held.append((ids[n], side[n], regs[n], values[offsets[n] : offsets[n + 1]]))
        if held:
            yield done()

    return rows.select("key", "i", "j", "side", "doc_id", "registers", "shingles").mapInArrow(link, "a bigint, b bigint")


def links_between(own: DataFrame, reps: DataFrame, size: int, percent: int, bands: int) -> DataFrame:
    """Links that connect all similar representatives (``reps``: rows of ``SIGNATURE``)."""
    least = least_estimate(percent, bands)
    members = reps.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).where("n > 1")
    buckets = materialise(members.join(buckets, "key"), "buckets")

    small = buckets.where(F.col("n") <= SMALL_BUCKET).select("key", "doc_id", "n_shingles")
    other = small.select("key", F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"))
    pairs = small.join(other, "key").where(
        (F.col("doc_id") < F.col("b"))
        & (100 * F.least("n_shingles", "nb") >= percent * F.greatest("n_shingles", "nb"))
    ).select(F.col("doc_id").alias("a"), "b").distinct()
    signs = reps.select("doc_id", "registers")
    pairs = pairs.join(signs.toDF("a", "ra"), "a").join(signs.toDF("b", "rb"), "b")
    pairs = materialise(likely_pairs(pairs, least), "pairs")

    large = buckets.where(F.col("n") > SMALL_BUCKET)
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(large.select("doc_id")).distinct()
    wanted = materialise(wanted, "wanted")
    sets = keep_ids(full_sets(keep_ids(own, wanted, "doc_id"), size).where(F.size("shingles") > 0), wanted, "doc_id")
    sets = materialise(sets.join(reps.select("doc_id", "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi"), "sets").select("doc_id", "shingles")

    both = F.size(F.array_intersect("sa", "sb"))
    verified = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select(
        "a", "b", both.alias("n"), (F.size("sa") + F.size("sb")).alias("total"),
    ).where(100 * F.col("n") >= percent * (F.col("total") - F.col("n"))).select("a", "b")

    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    placed = large.select("key", "doc_id", blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    grouped = placed.select("key", "doc_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "doc_id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    grouped = grouped.join(sets, "doc_id").join(signs, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return verified.union(block_links(grouped, percent, least))


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; documents link at a similarity of ``percent`` / 100."""
    own = _own(docs, id_col, text_col)
    bands = bands_for(percent / 100, miss=MISS)
    signed = materialise(signatures(own, size, bands), "signatures")
    filled = signed.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    mapped = materialise(filled.select("doc_id", "k1", "k2").distinct().join(classes, ["k1", "k2"]), "classes")
    first = mapped.where("doc_id = rep").select("doc_id", "k1", "k2")
    reps = materialise(filled.join(first, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"]), "representatives")
    split = mapped.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
    ties = mapped.join(split.select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links_between(own, reps, size, percent, bands).union(ties))
    labelled = mapped.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(found.toDF("rep", "component"), "rep", "left")
    component = labelled.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles").join(component, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
