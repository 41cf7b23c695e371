import random
import re
from pathlib import Path

import duckdb

from gazeledger.llm import catalog, decontaminate

SF = "/root/testdata/sf0.01"


def shingle_set(text, width):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_force(docs, items, percent=80):
    out = {}
    for i, t in docs:
        for k, item in items:
            w = len(re.findall(r"[^\W_]+", (item or "").lower()))
            if not w or i is None:
                continue
            wanted = shingle_set(item, min(5, w))
            n = len(wanted & shingle_set(t, min(5, w)))
            if 100 * n >= percent * len(wanted):
                out[i, k] = max(out.get((i, k), 0), n / len(wanted))
    return out


def test_containment_matches_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"w{n}é" for n in range(400)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 6, 12, 40, 90])))) for k in range(60)]
    items += [(60, None), (61, " ?! "), (1, "another text, with an id seen before and more"), (None, "an item without a name that is long")]
    docs = []
    for i in range(120):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 300)))]
        for _ in range(rng.randint(0, 3)):
            own = (rng.choice(items)[1] or "").split(" ")
            cut = rng.choice([0, 0, len(own) // 10, len(own) // 4])
            parts.append(rng.choice([" ", "\n", "### "]).join(own[cut:]).upper())
        rng.shuffle(parts)
        docs.append((i, " -- ".join(parts)))
    docs += [(500, None), (501, ""), (None, docs[3][1]), docs[5], (502, "an item without a name that is long " + "x " * 300_000)]
    got = decontaminate.contained_items(
        spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id bigint, text string, h int, item_id int").repartition(3),
        spark.createDataFrame([(k, t, 1) for k, t in items], "item_id bigint, text string, doc_id int")).collect()
    want = brute_force(docs, items)
    assert {(r["doc_id"], r["item_id"]): r["containment"] for r in got} == want
    assert len(got) == len(want) > 60


def test_given_tables_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{Path(SF, t)}.parquet'")
    cur = con.execute(decontaminate.oracle())
    names = [d[0] for d in cur.description]
    want = sorted(cur.fetchall())
    got = catalog.op3_decontaminate(spark, SF)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == want and want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = {r["doc_id"] for r in decontaminate.clean(docs, got).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {w[0] for w in want}


def test_native_plan(spark):
    plan = catalog.op3_decontaminate(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words that are here now")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "some words that are here now")], "item_id bigint, text string")
    assert decontaminate.contained_items(docs, items).count() == 1
    assert decontaminate.contained_items(docs.limit(0), items).count() == 0
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
