import numpy as np
import pyarrow as pa

from gazeledger.llm import catalog, embeddings
from gazeledger.llm.hnsw import Graph

SCHEMA = "vec_id bigint, embedding array<float>, label int, h string"


def brute_force(rows, least=0.9):
    """{id: [links per vector of the id]}, {id: component}"""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i, tuple(v)] = np.array(v, np.float32).astype(np.float64)
    keys = list(good)
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = dict.fromkeys(keys, 0)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            x, y = good[a], good[b]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                links[a] += 1
                links[b] += 1
                p, q = find(a[0]), find(b[0])
                root[max(p, q)] = min(p, q)
    return links, {i: find(i) for i in root}


def check(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    got = embeddings.near_vectors(df.repartition(3)).collect()
    links, component = brute_force(rows)
    want = sorted(((i, links.get((i, tuple(v)), 0) if v is not None else 0, component.get(i)) for i, v in rows), key=repr)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == want
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)


def found_links(graph, exact, queries, least, beam=embeddings.BEAM):
    q, m, rest = embeddings.block_links(graph, exact, queries, least, beam)
    whole = [(rest[a], b) for a, b in embeddings.exact_links(exact, queries[rest], least)]
    return np.concatenate([q, *(a for a, _ in whole)]), np.concatenate([m, *(b for _, b in whole)])


def shard(x, first=0):
    x = x[Graph.order(len(x))]
    n = np.arange(first, first + len(x))
    return embeddings.Shard(n, n, 1 + n % 3, x, Graph.build(x.astype(np.float32)), embeddings.BEAM)


def test_links_count_at_both_ends_whichever_finds_them():
    rng = np.random.default_rng(11)
    x = rng.normal(size=(5000, 16))
    x[:1500] = x[0] + 0.05 * rng.normal(size=(1500, 16))  # a crowd: exact products at either end
    x[1500:2500] = x[1500 + np.arange(1000) // 5 * 5] + 0.08 * rng.normal(size=(1000, 16))
    x = embeddings.unit(x)[rng.permutation(5000)]
    for left, right in ((shard(x), None), (shard(x[:2000]), shard(x[2000:], 2000))):
        links, label = embeddings.shard_links(left, right or left, 0.9)
        parts = [left] if right is None else [left, right]
        vectors, weights = np.concatenate([p.exact for p in parts]), np.concatenate([p.weights for p in parts])
        near = vectors @ vectors.T >= 0.9
        if right is not None:  # only links between the two
            near[:2000, :2000] = near[2000:, 2000:] = False
        np.fill_diagonal(near, False)
        assert np.array_equal(links, near @ weights)
        for a, b in np.argwhere(near)[::97]:
            assert label[a] == label[b]


def test_one_end_that_finds_nothing_takes_the_links_of_the_other():
    rng = np.random.default_rng(12)
    a = embeddings.unit(rng.normal(size=(2000, 32)))
    b = embeddings.unit(a + 0.05 * rng.normal(size=a.shape))
    left, right = shard(a), shard(b, 2000)
    real = embeddings.block_links

    def one_sided(graph, exact, queries, least, beam):
        q, m, rest = real(graph, exact, queries, least, beam)
        return (q[:0], m[:0], rest) if graph is left.graph else (q, m, rest)

    embeddings.block_links = one_sided
    try:
        links, _ = embeddings.shard_links(left, right, 0.9)
    finally:
        embeddings.block_links = real
    near = left.exact @ right.exact.T >= 0.9
    assert near.sum() > 1900
    assert np.array_equal(links, np.concatenate([near @ right.weights, near.T @ left.weights]))


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for size, spread in ((1, 0), (70, 0.02), (5, 0.08), (40, 0.05), (3, 0.3)) * 2:
        centre = rng.normal(size=8)
        rows += [(centre + spread * rng.normal(size=8)).astype(np.float32).tolist() for _ in range(size)]
    rows += rng.normal(size=(300, 8)).astype(np.float32).tolist()
    rows += [rows[1]] * 30
    numbered = [(int(i), v) for i, v in zip(rng.permutation(len(rows)) * 3, rows, strict=True)]
    nan, inf = float("nan"), float("inf")
    numbered += [(5000, None), (5001, []), (5002, [0.0] * 8), (5003, [nan] + [1.0] * 7), (5004, [inf] + [1.0] * 7), (5005, [None] + [1.0] * 7),
                 (None, rows[1]), (5006, rows[1][:4]), (5007, rows[1][:4]), (5008, [1e30] * 8), (5009, [1e-30] * 8), numbered[2], (numbered[0][0], rows[80])]
    check(spark, numbered)


def test_graph_recall():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 32))
    x[3000:3400] = x[0] + 0.1 * rng.normal(size=(400, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[Graph.order(6000)]
    graph = Graph.build(x.astype(np.float32))
    near = x[::20] @ x.T
    truth = np.argsort(-near, 1)[:, :10]
    ids, _ = graph.search(x[::20].astype(np.float32), 64)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids[:, :10], truth, strict=True)])
    assert recall > 0.9
    q, m = found_links(graph, x, x[::20], 0.9)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(near >= 0.9), strict=True)}
    assert {(int(a), int(b)) for a, b in zip(q, m, strict=True)} <= want
    assert len(q) >= 0.99 * len(want)


def test_audit_has_links_where_queries_have_few():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = Graph.build(x.astype(np.float32))
    graph.layers[0] = np.ascontiguousarray(graph.layers[0][:, :4])  # a graph that loses links
    queries = embeddings.made_up(x, 0.9, 600)
    queries[:: embeddings.AUDIT] = -queries[:: embeddings.AUDIT]  # the positions that blocks audit have no link
    true = {(int(a), int(b)) for a, b in zip(*np.nonzero(queries @ x.T >= 0.9), strict=True)}

    def share(beam):
        found = {(int(a), int(b)) for a, b in zip(*found_links(graph, x, queries, 0.9, beam), strict=True)}
        assert found <= true
        return len(found) / len(true)

    assert len(true) > 500 and share(embeddings.BEAM) < 0.95
    beam, recall = embeddings.audited_beam(graph, x, 0.9)
    assert beam > embeddings.BEAM and recall >= embeddings.RECALL and share(beam) > 0.98

    table = pa.table({"rep": np.arange(6000), "h": np.arange(6000), "weight": np.ones(6000, np.int64), "v": list(x)})
    built = embeddings.build_shard((pa.scalar(0),), table, 0.9).to_pylist()[0]
    assert built["beam"] == embeddings.audited_beam(Graph.build(x[Graph.order(6000)].astype(np.float32)), x[Graph.order(6000)], 0.9)[0]


def test_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    links, component = brute_force(rows)
    got = catalog.op8_embeddings(spark, "/root/testdata/sf0.01").collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (n, component[i]) for (i, _), n in links.items()}


def test_empty_table(spark):
    assert embeddings.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
