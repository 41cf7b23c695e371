import random

import numpy as np

from gazeledger.llm import chunks, repeats


def cut(text):
    data = np.frombuffer(text.encode(), np.uint8)
    starts, _ = chunks.borders(data, np.array([0, len(data)]))
    ends = np.append(starts[1:], len(data))[: len(starts)]
    return [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)]


def slow_borders(data):
    """Byte by byte, for one text."""
    h, low, out = 0, [], [0] if data else []
    for i, b in enumerate(data):
        h = (2 * h + int(chunks.GEAR[b])) % 65536
        if h < chunks.LIMIT and i >= chunks.WINDOW - 1:
            k = i + 1
            while k < len(data) and data[k] & 0xC0 == 0x80:
                k += 1
            if (not low or i - low[-1] >= chunks.SHORTEST) and k < len(data):
                out.append(k)
            low.append(i)
    full = []
    for a, b in zip(out, [*out[1:], len(data)][: len(out)], strict=True):
        for k in range(a, b, chunks.LONGEST):
            while k > a and data[k] & 0xC0 == 0x80:
                k -= 1
            full.append(k)
    return full


def words(rng, n):
    return " ".join("".join(rng.choices(["th", "er", "é", "on", "漢", "ing", "a", "st"], k=rng.randint(1, 4))) for _ in range(n))


def test_borders_match_the_rolling_hash():
    rng = random.Random(2)
    texts = ["", "a", "b" * 2000, "漢" * 700, "ab" * 900, *(words(rng, n) for n in (3, 50, 400, 2000))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    starts, owners = chunks.borders(data, offsets)
    for i, t in enumerate(texts):
        assert (starts[owners == i] - offsets[i]).tolist() == slow_borders(t.encode()), i
        assert "".join(c.decode() for c in cut(t)) == t


def test_insertions_move_few_borders():
    rng = random.Random(3)
    text = words(rng, 3000)
    old, new = cut(text), cut(text[:5000] + "xyz inserted " + text[5000:])
    assert len(set(old) - set(new)) <= 3


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(4)
    common = "A short line that stands in very many of the documents here."
    rows, planted = [], {}
    passages = [words(rng, rng.randint(51, 90)) for _ in range(40)]
    for i in range(200):
        parts = [words(rng, rng.randint(20, 150)) for _ in range(3)]
        if i < 120:
            p = passages[i % 40]
            parts.insert(rng.randint(0, 3), p)
            planted[i * 3] = p
        if i >= 120 and rng.random() < 0.8:
            parts.insert(rng.randint(0, len(parts)), common)
        rows.append((i * 3, rng.choice([" ", "\n"]).join(parts), 1, "k"))
    rows += [(900, None, 1, "k"), (901, "", 1, "k"), (None, rows[0][1], 1, "k"), (903, "one " * 100_000, 1, "k"), rows[130]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, start int, digest string")
    got = repeats.repeated_passages(df.repartition(3)).collect()
    text = {i: t for i, t, *_ in rows if i is not None}
    assert {r["doc_id"] for r in got} == set(planted)
    for r in got:
        found = text[r["doc_id"]][r["start"] : r["end"]]
        # its ends may go on into words that only some of the holders share
        assert found[40:-40] in planted[r["doc_id"]] and found[40:-40] in text[r["source_doc_id"]] and len(found) >= repeats.MIN_CHARS
        assert r["source_doc_id"] == r["doc_id"] % 120 and r["kept"] == (r["doc_id"] < 120)
    clean = {r["doc_id"]: r for r in repeats.without_repeats(df, repeats.repeated_passages(df)).collect()}
    gone = {r["doc_id"]: (r["start"], r["end"]) for r in got if not r["kept"]}
    for i, t in text.items():
        a, b = gone.get(i, (0, 0))
        assert clean[i]["text"] == (t if t is None else t[:a] + t[b:]) and clean[i]["digest"] == "k"


def test_partial_quotes_leave_one_copy_of_everything(spark):
    rng = random.Random(6)
    article, before, after = words(rng, 160), words(rng, 60), words(rng, 60)
    first, second = article[: len(article) // 2], article[len(article) // 2 :]
    text = {3: f"{before} {first}", 5: article, 9: f"{after} {article}", 12: second, 15: "x"}
    df = spark.createDataFrame(list(text.items()), "doc_id bigint, text string").repartition(2)
    got = sorted(tuple(r) for r in repeats.repeated_passages(df).collect())
    for (doc, a, b, source, kept), following in zip(got, [*got[1:], (None, 0)], strict=True):
        assert kept == (source == doc) and a < b and (following[0] != doc or b <= following[1])
        assert text[doc][a:b] in text[source]
        # the source keeps it
        assert any(d == source and k and text[doc][a:b] in text[d][s:e] for d, s, e, _, k in got)
    assert {(doc, source) for doc, _, _, source, _ in got} == {(3, 3), (5, 3), (5, 5), (9, 3), (9, 5), (12, 5)}
    clean = {r["doc_id"]: r["text"] for r in repeats.without_repeats(df, repeats.repeated_passages(df)).collect()}
    assert clean[3] == text[3] and clean[15] == "x"
    # all of the article is left, split over documents 3 and 5, and no long part of it is left twice
    assert article[-400:] in clean[5] and len(clean[5]) < len(second) + 130
    assert len(clean[9]) < len(after) + 130 and len(clean[12]) < 130
    again = spark.createDataFrame(list(clean.items()), "doc_id bigint, text string")
    assert repeats.repeated_passages(again).count() == 0
    for k in range(0, len(article) - 40):
        assert any(article[k : k + 20] in t for t in clean.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    found = repeats.repeated_passages(empty)
    assert found.count() == 0 and repeats.without_repeats(empty, found).count() == 0
