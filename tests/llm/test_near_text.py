import random
import re

import numpy as np
import pytest

from gazeledger.llm import catalog, near_text, shingles
from gazeledger.llm.components import components

LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_force(rows, size, percent):
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}, sets


def cases(seed=3):
    rng = random.Random(seed)
    words = [f"W{n}é" for n in range(3000)]
    rows = []

    def add(text):
        rows.append((len(rows) * 7 % 1009, text))

    for copies, length, share in ((2, 40, 0.02), (90, 120, 0.03), (60, 60, 0.06), (5, 9, 0.0), (8, 400, 0.01), (3, 2, 0.0), (20, 12, 0.1)):
        base = rng.choices(words, k=length)
        for _ in range(copies):
            add(rng.choice([" ", "\t", "\x0b\n"]).join(w if rng.random() > share else rng.choice(words) for w in base))
    for _ in range(60):
        add(" ".join(rng.choices(words, k=rng.randint(1, 80))))
    for text in ("", " \n", "one", "ONE", "one two", "one two three", "ONE two three", "x" * 50_000, "a b\x0cc d", "a b c\x1cd"):
        add(text)
    add(None)
    return rows


def test_shingles_match_python():
    import pyarrow as pa

    from gazeledger.llm.common import text_blocks

    texts = [t or "" for _, t in cases()]
    for size in (1, 3, 5):
        found, seen = [], {}
        for _, _, data, offsets in text_blocks(pa.array(texts), 3000):
            found += shingles.distinct_sets(*shingles.shingle_hashes(data, offsets, size))
        for own, text in zip(found, texts, strict=True):
            want = shingle_set(text, size)
            assert len(own) == len(want), text
            for other, old in seen.items():
                assert len(np.intersect1d(own, old)) == len(want & other)
            if len(seen) < 30:
                seen[want] = own


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(near_text, "BLOCK_ROWS", 16)
    rows = cases()
    extra = [(None, rows[3][1], 1, 1), (rows[0][0], rows[0][1], 1, 1), (rows[200][0], rows[100][1], 1, 1)]
    df = spark.createDataFrame([(i, t, 1, 1) for i, t in rows] + extra, "doc_id bigint, text string, n_shingles int, key int")
    got = near_text.near_duplicates(df.repartition(5), size, percent).collect()
    want, sets = brute_force(rows + [(i, t) for i, t, *_ in extra], size, percent)
    assert sorted(((r["doc_id"], r["n_shingles"]) for r in got), key=repr) == sorted(((i, len(s)) for i, s in sets), key=repr)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want, _ = brute_force(rows, 3, 85)
    got = {r["doc_id"]: r["component_id"] for r in catalog.op9_near_text(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_estimate_is_close():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = pool[:3000], pool[600:3600]
    regs = shingles.registers(np.concatenate([a, b]), np.array([0, 3000, 6000]), 200)
    assert abs(near_text.estimates(regs[0].ravel(), regs[1].ravel()) - 2400 / 3600) < 0.06


def test_empty_table(spark):
    assert near_text.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(1, 200)] + [(300, 302), (302, 301), (301, 300), (7, 7), (None, 3)] + [(500, 500 + i) for i in range(1, 60)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {300: 300, 301: 300, 302: 300} | {i: 500 for i in range(500, 560)}
    assert components(df.limit(0)).count() == 0
