"""Embedding near-duplicates (operator 8): a navigable small-world graph per shard, every vector asked of every shard.

1. Equal vectors become one, with a weight, so copies of any number cost one query.
2. Distinct vectors are dealt into shards by a hash (at least ``SHARDS``, of about ``SHARD_VALUES`` components at most); each shard's
   graph is built by one task and written to the shared folder. The task also asks ``AUDIT_QUERIES`` made-up vectors, each
   a member turned by a random angle within the bound; none is in the graph and each has a true link. The shard's first
   beam doubles until ``RECALL`` of them find all links that exact products find, whatever the number of shards.
3. Two shards (or one with itself) meet in one group, and each asks the other's graph, in blocks. A query whose beam holds
   links to its end is asked again with a wider one; beyond ``WIDEST``, or a quarter of the shard, exact products cost less.
   In every block an audit compares every ``AUDIT``-th query with exact products; if it misses a link, the beam doubles for
   the whole block.
4. What the search finds is verified by cosines in double precision. A link that either end's search finds counts at both
   ends, once. Queries of exact products are walked in slices, so a crowd of near copies that fills a shard needs no list of
   its pairs. A group returns the number of links per vector and, per connected part of its links, one star, never the links
   themselves; components are united over all groups.

Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing; so do rows with a NULL id,
whose component is NULL. Vectors of different length never link. Rows that repeat an id and a vector count once; an id
with several vectors is one node with one row per input row. Empty tables give empty results. Only the two named columns
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.llm.common import materialise
from gazeledger.llm.components import components
from gazeledger.llm.hnsw import LINKS, TOP_LINKS, Graph

SHARDS, SHARD_VALUES = 8, 3_200_000  # 50 000 vectors of 64 components
QUERY_ROWS = 4096
BEAM, WIDEST = 24, 192
AUDIT = 64
AUDIT_QUERIES, RECALL = 1024, 0.998
SLACK = 1e-4  # of single precision
PAIR_TASKS = 20_000
SLICE = 2**21  # products of a slice
INDEX = "shard bigint, ids binary, hashes binary, weights binary, vectors binary, width int, layers array<binary>, beam bigint"
FOUND = "a bigint, h bigint, links bigint, b bigint"


@dataclass
class Shard:
    ids: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    exact: np.ndarray
    graph: Graph
    beam: int


def build_shard(key: tuple, rows: pa.Table, least: float) -> pa.Table:
    """The shard's members in the graph's order, their vectors (in the narrowest form that keeps them), the graph's layers
    and its first beam."""
    order = Graph.order(rows.num_rows)
    ids, hashes, weights = (rows.column(c).to_numpy()[order] for c in ("rep", "h", "weight"))
    given = matrix(rows.column("v"))[order]
    exact = unit(given)
    with np.errstate(over="ignore"):
        narrow = given.astype(np.float32)
    stored = narrow if np.array_equal(narrow.astype(np.float64), given) else given
    graph = Graph.build(exact.astype(np.float32))
    return pa.table({
        "shard": [key[0].as_py()], "ids": [ids.tobytes()], "hashes": [hashes.tobytes()], "weights": [weights.tobytes()],
        "vectors": [stored.tobytes()], "width": pa.array([stored.itemsize], pa.int32()),
        "layers": pa.array([[x.tobytes() for x in graph.layers]], pa.list_(pa.binary())),
        "beam": [audited_beam(graph, exact, least)[0]]})


def open_shard(row: dict) -> Shard:
    ids, hashes, weights = (np.frombuffer(row[c], np.int64) for c in ("ids", "hashes", "weights"))
    stored = np.frombuffer(row["vectors"], np.float32 if row["width"] == 4 else np.float64)
    exact = unit(stored.reshape(len(ids), -1).astype(np.float64))
    layers = [np.frombuffer(x, np.int32).reshape(-1, LINKS if n == 0 else TOP_LINKS) for n, x in enumerate(row["layers"])]
    return Shard(ids, hashes, weights, exact, Graph(exact.astype(np.float32), layers), row["beam"])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def made_up(exact: np.ndarray, least: float, count: int) -> np.ndarray:
    """Unit vectors whose cosine with some member lies between ``least`` and 1."""
    rng = np.random.default_rng(2)
    near = exact[rng.integers(len(exact), size=count)]
    cosine = np.minimum(rng.uniform(least, 1, (count, 1)) + 2 * SLACK, 1)
    side = rng.normal(size=near.shape)
    side -= (side * near).sum(1, keepdims=True) * near
    length = np.linalg.norm(side, axis=1, keepdims=True)
    turned = cosine * near + np.sqrt(1 - cosine**2) * side / np.where(length > 1e-9, length, 1)
    return turned / np.linalg.norm(turned, axis=1, keepdims=True)


def audited_beam(graph: Graph, exact: np.ndarray, least: float, beam: int = BEAM) -> tuple[int, float]:
    """The first beam, and the share of made-up queries that find all their links with it."""
    asked = made_up(exact, least, AUDIT_QUERIES).astype(np.float32)
    while beams(beam, len(exact)):
        missed = 0
        for lo in range(0, len(asked), 64):
            some = asked[lo : lo + 64]
            lost = some @ graph.vectors.T >= least + SLACK
            q, m, rest = asked_links(graph, some, least, beam)
            lost[q, m] = False
            lost[rest] = False
            missed += int(lost.any(1).sum())
        if missed <= (1 - RECALL) * len(asked):
            return beam, 1 - missed / len(asked)
        beam *= 2
    return beam, 1.0


def beams(beam: int, size: int) -> bool:
    """Whether a search with this beam costs less than exact products over ``size`` members."""
    return beam <= WIDEST and 4 * beam < size


def asked_links(graph: Graph, asked: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query and member numbers of the pairs found from this beam on, in single precision and with ``SLACK``, and the
    queries that have more links than beams hold."""
    pairs_q, pairs_m = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    waiting, own = np.arange(len(asked)), beam
    while len(waiting) and beams(own, len(graph.vectors)):
        ids, near = graph.search(asked[waiting], own)
        full = near[:, -1] >= least - SLACK
        q, c = np.nonzero((near >= least - SLACK) & ~full[:, None])
        pairs_q.append(waiting[q])
        pairs_m.append(ids[q, c])
        waiting, own = waiting[full], 2 * own
    return np.concatenate(pairs_q), np.concatenate(pairs_m), waiting


def reach(a: np.ndarray, b: np.ndarray, q: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have a cosine of at least ``least``; the same whichever row comes first."""
    parts = [np.einsum("ij,ij->i", a[q[lo : lo + 65536]], b[m[lo : lo + 65536]]) >= least for lo in range(0, len(q), 65536)]
    return np.concatenate([np.zeros(0, bool), *parts])


def block_links(graph: Graph, exact: np.ndarray, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified pairs of a block of queries, and its queries that need exact products; beams widen until the audit passes."""
    asked = queries.astype(np.float32)
    truth = (asked[::AUDIT] @ graph.vectors.T) >= least + SLACK
    while True:
        q, m, rest = asked_links(graph, asked, least, beam)
        seen = np.zeros(truth.shape, bool)
        mine = q % AUDIT == 0
        seen[q[mine] // AUDIT, m[mine]] = True
        seen[rest[rest % AUDIT == 0] // AUDIT] = True
        if not (truth & ~seen).any():
            break
        beam *= 2
    good = reach(queries, exact, q, m, least)
    return q[good], m[good], rest


def exact_links(exact: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs, in slices of queries: products in single precision, those near the bound in double precision."""
    members = exact.astype(np.float32)
    step = max(1, SLICE // max(len(exact), 1))
    for lo in range(0, len(queries), step):
        some = queries[lo : lo + step]
        near = some.astype(np.float32) @ members.T
        linked = near >= least + SLACK
        q, m = np.nonzero((near >= least - SLACK) & ~linked)
        linked[q, m] = reach(some, exact, q, m, least)
        q, m = np.nonzero(linked)
        yield q + lo, m


def united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of nodes after the parts of ``a`` and ``b`` have become one, pair by pair."""
    a, b = label[a], label[b]
    apart = a != b
    a, b = a[apart], b[apart]
    root = np.arange(len(label))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root[label]


def shard_links(left: Shard, right: Shard, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weights added) and component of every member: those of ``left``, then, if it is another, those of ``right``."""
    alone = left is right
    sizes = [len(left.ids), len(right.ids)]
    weights = left.weights if alone else np.concatenate([left.weights, right.weights])
    links, label = np.zeros(len(weights), np.int64), np.arange(len(weights))
    sides = [(left, right, 0, 0)] if alone else [(left, right, 0, sizes[0]), (right, left, sizes[0], 0)]
    whole = np.zeros(len(weights), bool)  # members whose links exact products tell
    codes = [np.zeros(0, np.int64)]
    for asking, asked, first, other in sides:
        for lo in range(0, len(asking.ids), QUERY_ROWS):
            q, m, rest = block_links(asked.graph, asked.exact, asking.exact[lo : lo + QUERY_ROWS], least, asked.beam)
            a, b = q + lo + first, m + other
            codes.append(np.minimum(a, b) * len(weights) + np.maximum(a, b))
            whole[rest + lo + first] = True
    a, b = np.divmod(np.unique(np.concatenate(codes)), max(len(weights), 1))
    sparse = (a != b) & ~whole[a] & ~whole[b]
    a, b = a[sparse], b[sparse]
    np.add.at(links, a, weights[b])
    np.add.at(links, b, weights[a])
    label = united(label, a, b)
    for asking, asked, first, other in sides:
        rest = np.nonzero(whole[first : first + len(asking.ids)])[0]
        for q, m in exact_links(asked.exact, asking.exact[rest], least):
            a, b = rest[q] + first, m + other
            a, b = a[a != b], b[a != b]
            np.add.at(links, a, weights[b])
            outer = ~whole[b]  # the others count this link themselves
            np.add.at(links, b[outer], weights[a[outer]])
            label = united(label, a, b)
    return links, label


def ask_shards(index: pa.Table, lo: int, hi: int, least: float) -> pa.Table:
    opened = {row["shard"]: open_shard(row) for row in index.to_pylist()}
    if lo not in opened or hi not in opened:
        return pa.table({c.split()[0]: pa.array([], pa.int64()) for c in FOUND.split(", ")})
    parts = [opened[lo]] if lo == hi else [opened[lo], opened[hi]]
    links, label = shard_links(parts[0], parts[-1], least)
    ids, hashes = (np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "hashes"))
    least_id = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least_id, label, ids)
    some = links > 0
    return pa.table({"a": ids[some], "h": hashes[some], "links": links[some], "b": least_id[label[some]]})


def near_vectors(vectors: DataFrame, least: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    own = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = own.where("vec_id is not null and v is not null").where(finite)
    classes = usable.distinct().groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    classes = materialise(classes.withColumn("h", F.xxhash64("v")), "vectors")
    values = classes.agg(F.sum(F.size("v").cast("bigint"))).first()[0] or 0
    shards = max(SHARDS, -(-values // SHARD_VALUES))
    length = F.size("v").cast("bigint") * shards  # vectors of one length share shards
    dealt = classes.withColumn("shard", length + F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)))

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        return build_shard(key, rows, least)

    index = materialise(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(build, INDEX), "graphs")
    first = F.col("shard") - F.pmod("shard", F.lit(shards))
    pairs = index.withColumn("other", F.explode(F.sequence(first, first + (shards - 1)))).withColumns({
        "lo": F.least("shard", "other"), "hi": F.greatest("shard", "other")})

    def ask(key: tuple, rows: pa.Table) -> pa.Table:
        return ask_shards(rows, key[0].as_py(), key[1].as_py(), least)

    groups = min(shards * (shards + 1) // 2, PAIR_TASKS)
    found = materialise(
        pairs.repartition(groups, "lo", "hi").groupBy("lo", "hi").applyInArrow(ask, FOUND), "found")
    links = found.groupBy(F.col("a").alias("rep"), "h").agg(F.sum("links").alias("links"))
    members = materialise(usable.distinct().join(classes, "v").select("vec_id", "h", "rep", "weight"), "members")
    split = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("vec_id")
    ties = members.join(split, "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    labels = components(found.select("a", "b").union(ties)).toDF("rep", "component")
    result = members.join(links, ["rep", "h"], "left").join(labels, "rep", "left").select(
        "vec_id", "h", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    rows = own.select("vec_id", F.when(F.coalesce(finite, F.lit(False)), F.xxhash64("v")).alias("h"))
    joined = rows.join(result, ["vec_id", "h"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
