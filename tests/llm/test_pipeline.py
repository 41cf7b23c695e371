import numpy as np
from pyspark.sql import functions as F
from test_decontaminate import brute_force as containment
from test_near_text import brute_force as near
from test_packing import ids_of
from test_secrets import base, entropy

import __spark_entry__ as entry_module
import corpus_pipeline
from gazeledger.llm import quality

SF = "/root/testdata/sf0.001"


def redacted(text):
    fixed = base(text)
    spans = sorted(fixed + [e for e in entropy(text) if not any(b[0] <= e[0] and b[2] >= e[2] for b in fixed)])
    out, at = [], 0
    merged = []
    for a, _, b in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)

    good = stages["good_quality"](spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    scores = model.score(np.array([quality.terms(np.frombuffer(r["text"].encode(), np.uint8)) for r in rows.values()]))
    want = {i for i, s in zip(rows, scores, strict=True) if s >= 0.5}
    assert good.columns == columns and {r["doc_id"] for r in good.collect()} == want and len(want) < len(rows)

    distinct = stages["near_distinct"](spark, good, SF)
    component, _ = near([(i, rows[i]["text"]) for i in sorted(want)], 5, 80)
    want = {i for i, c in component.items() if i == c}
    assert distinct.columns == columns and sorted(r["doc_id"] for r in distinct.collect()) == sorted(want)

    clean = stages["uncontaminated"](spark, distinct, SF)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want -= {i for i, _ in containment([(i, rows[i]["text"]) for i in want], items)}
    assert clean.columns == columns and sorted(r["doc_id"] for r in clean.collect()) == sorted(want)

    masked = stages["without_secrets"](spark, clean, SF)
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert masked.columns == columns and texts == {i: redacted(rows[i]["text"]) for i in want}
    assert masked.where("n_chars <> char_length(text)").count() == 0

    result = corpus_pipeline.run(spark, SF)
    total = result.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in total} == {i: len(ids_of(t)) for i, t in texts.items()}


def test_edge_cases(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text, "en", "s", 3, 9), (1, text, "en", "s", 3, 9), (2, text.upper(), None, None, None, 9), (None, text, "en", "s", 1, 9), (3, None, "en", "s", 1, 9), (4, "", "en", "s", 1, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int")
    out = corpus_pipeline.near_distinct(spark, df, SF)
    assert out.columns == df.columns and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 1), (False, 3), (False, 4)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), SF).count() == 0, name
        assert stage(spark, df, SF).columns == df.columns, name
    assert corpus_pipeline.packed(spark, df, SF).count() >= len(rows)


def test_rows_without_ids_are_judged(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy(F.length("text").desc()).first()["text"]
    words = [f"w{n}" for n in range(60)]
    near, far = " ".join(words[:-1] + ["x"]), " ".join(w + "q" for w in words)
    rows = [(7, " ".join(words)), (None, " ".join(words)), (None, near), (None, far), (None, far), (None, "before it " + item + " behind it"), (None, None), (None, ""), (None, " ")]
    df = spark.createDataFrame([(i, t, n, "r", 1) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, _place int, row string, place int")
    distinct = corpus_pipeline.near_distinct(spark, df, SF)
    kept = {r["_place"] for r in distinct.collect()}
    assert distinct.columns == df.columns
    assert kept - {3, 4} == {0, 5, 6, 7, 8} and len(kept & {3, 4}) == 1
    clean = corpus_pipeline.uncontaminated(spark, df, SF)
    assert clean.columns == df.columns and {r["_place"] for r in clean.collect()} == set(range(9)) - {5}


def test_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
