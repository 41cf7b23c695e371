import random

import numpy as np
import zstandard
from pyspark.sql import functions as F

from gazeledger.llm import catalog, language, quality

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    got = {r["doc_id"]: r for r in catalog.op1_language(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_is_the_smallest_encoding(spark):
    rng = random.Random(1)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["uno", "due", "tre"]}
    train = [(i, lang, " ".join(rng.choices(w, k=200))) for lang, w in words.items() for i in range(9)]
    docs = spark.createDataFrame(train, "doc_id int, lang string, text string")
    dictionaries = language.fit(docs, F.lit(True))
    cases = [(1, "Beta GAMMA alpha beta alpha beta gamma", 5), (2, "tre due uno TRE uno due due tre uno!", 5), (3, None, 5), (4, "12 34 #", 5), (5, "", 5), (None, "uno uno tre due uno tre tre", 5), (7, "alpha beta " * 9000, 5), (2, "tre due uno TRE uno due due tre uno!", 5)]
    df = spark.createDataFrame(cases, "doc_id int, text string, lang_pred int")
    rows = language.identify(df, dictionaries).collect()
    assert len(rows) == len(cases)
    for r, (i, text, _) in zip(sorted(rows, key=lambda r: repr(r["doc_id"])), sorted(cases, key=lambda c: repr(c[0])), strict=True):
        plain = language.normal(text)
        if not plain:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        sizes = {}
        for lang, content in dictionaries.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            c = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes[lang] = sum(len(c.compress(plain[k : k + language.BLOCK])) for k in range(0, len(plain), language.BLOCK))
        assert sizes[r["lang_pred"]] <= min(sizes.values()) + len(plain) // language.BLOCK + 1, i
        assert r["lang_pred"] == ("xx" if b"alpha" in plain else "yy")


def test_copies_do_not_crowd_out_a_language(spark):
    rng = random.Random(8)
    rows = [("xx", " ".join(rng.choices(["alpha", "beta", "gamma"], k=30)) + f" x{'abcdefghij'[i % 10] * (i // 10 + 1)}") for i in range(200)]
    rows += [("yy", " ".join(rng.choices(["uno", "due", "tre"], k=30)) + f" y{'abcdefghij'[i % 10] * (i // 10 + 1)}") for i in range(200)]
    plain = language.fit(spark.createDataFrame(rows, "lang string, text string"), F.lit(True), texts=20)
    copied = language.fit(spark.createDataFrame(rows + rows[:1] * 500 + rows[250:251] * 900, "lang string, text string"), F.lit(True), texts=20)
    assert {k: sorted(v.split()) for k, v in plain.items()} == {k: sorted(v.split()) for k, v in copied.items()}
    assert {len(v) for v in plain.values()} == {language.DICTIONARY_BYTES}
    few = language.fit(spark.createDataFrame(rows + [("zz", "solo")], "lang string, text string"), F.lit(True))
    assert few["xx"] == language.fit(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))["xx"] and b"solo" in few["zz"]


def test_languages_have_no_cap(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(f"l{i}", (letters[i % 20] * 3 + letters[i // 20] * 3 + " ") * 5) for i in range(230)]
    assert len(language.fit(spark.createDataFrame(rows, "lang string, text string"), F.lit(True))) == 230


def test_letters():
    assert language.normal("² ½ ① Ⅷ 12_3 \u0301") == b""
    assert language.normal("हिन्दी भाषा, ภาษาไทย e\u0301!") == "हिन्दी भाषा ภาษาไทย e\u0301".encode()


def test_language_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, lang string, text string")
    assert language.fit(empty, F.lit(True)) == {}
    assert language.identify(empty, {}).count() == 0
    one = spark.createDataFrame([(1, "x", "words")], "doc_id bigint, lang string, text string")
    assert language.identify(one, {}).first()["lang_pred"] == "und"


def test_quality_on_held_out_rows(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in catalog.op2_quality(spark, SF).collect()}
    assert len(got) == 1000
    held = [i for i in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i] for i in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def _sample():
    good = [("the quick Fox. Ends here", 1), ("a small Dog, sat there", 1), ("plain words in a Line.", 1)]
    return good + [("NO!! NO!! NO!! NO!!", 0), ("x### y### z### q###", 0), ("on on on on on on on", 0)]


def test_votes_match_brute_force():
    rows = _sample()
    counts = np.array([quality.terms(np.frombuffer(t.encode(), np.uint8)) for t, _ in rows])
    model = quality.latent_model(counts, np.array([y for _, y in rows]))
    asked = np.array([quality.terms(np.frombuffer(t.encode(), np.uint8)) for t in ("GO!! GO!! GO!!", "some calm Words. Here", "")])
    scores = model.score(asked)
    for vector, s in zip(model.embed(asked), scores, strict=True):
        near = sorted(((float(vector @ v), y) for v, (_, y) in zip(model.vectors, rows, strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 0) ** quality.SHARPNESS for c, _ in near]
        want = sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) > 1e-12 else 0.5
        assert abs(want - s) < 1e-9
    assert scores[0] < 0.5 < scores[1] and scores[2] == 0.5


def test_quality_edge_cases(spark):
    rows = [(i, t, 0) for i, (t, _) in enumerate(_sample())]
    docs = spark.createDataFrame(rows + [(50, None, 0), (51, "", 0), (None, "calm words here", 0), (52, "Long text. " * 200_000, 0), (52, "a", 0)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, y, None) for i, (_, y) in enumerate(_sample())] + [(0, None, None), (1, 1, None)], "doc_id bigint, quality int, text string")
    model = quality.fit(docs, labels, F.lit(True))
    assert len(model.labels) == 6
    got = quality.score(docs, model)
    assert got.count() == 11 and got.where("score is null").count() == 0
    assert quality.keep_good(docs, model).columns == docs.columns
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {(r["score"], r["predicted"]) for r in quality.score(docs, none).collect()} == {(0.5, 1)}
    assert quality.score(docs.limit(0), model).count() == 0 and quality.keep_good(docs.limit(0), model).count() == 0


def test_quality_takes_one_text_of_a_repeated_id(spark):
    rows = [(i, t) for i, (t, _) in enumerate(_sample())]
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(_sample())], "doc_id bigint, quality int")
    once = spark.createDataFrame(rows, "doc_id bigint, text string")
    often = spark.createDataFrame(rows + [rows[0]] * 300 + [(1, rows[1][1] + " more"), (1, None)], "doc_id bigint, text string").repartition(3)
    got, want = quality.fit(often, labels, F.lit(True)), quality.fit(once, labels, F.lit(True))
    assert got.vectors.shape[0] == got.labels.shape[0] == len(rows) and (got.labels == want.labels).all()
    repeated = quality.fit(once.union(once.where("doc_id = 0")), labels, F.lit(True))
    assert np.array_equal(repeated.vectors, want.vectors)
    assert quality.fit(often, labels, F.lit(True), sample=2).vectors.shape[0] == 2
