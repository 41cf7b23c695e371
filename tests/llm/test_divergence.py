import random
import re
import string
from collections import Counter, defaultdict

from gazeledger.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, least=3, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = [(lang, source, [w.translate(LOWER) for w in TERM.findall(text)]) for text, lang, source in docs]
    out = []
    for lang in {d[1] for d in docs}:
        seen, n, all_n = Counter(), defaultdict(Counter), Counter()
        sources = {s for x, s, _ in words if x == lang}
        for x, s, w in words:
            if x == lang:
                seen.update(set(w))
                n[s].update(w)
                all_n.update(w)
        kept = [t for t, c in seen.items() if c >= least]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(n[s]) for s in sources}, shares(all_n)
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


def rows_of(spark, rows, **settings):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, term int, held string").repartition(3)
    return sorted(tuple(r) for r in divergence.divergence(docs, **settings).select("lang", "source", "part", "item", "value", "rank").collect())


def test_matches_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "The", "café", "CAFÉ", "x1y", "naïve", "漢字", "𝒳", "[a]", "o`b", "z", "É", "ß"]
    rows = []
    for i in range(120):
        text = " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 12)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "é", None])))
    rows += [("copied text of the group", "en", "a")] * 60 + [("copied text of the group", "en", "b")] * 3
    rows += [(None, "fr", "only"), ("", "fr", "other"), ("12 34 []", "fr", "third"), ("once", "it", "x"), ("long words " * 20_000, "en", "c")]
    assert rows_of(spark, rows) == brute(rows)
    few = rows_of(spark, rows, top=2)
    assert few == brute(rows, top=2) and max(r[5] for r in few if r[2] == "term") == 2


def test_terms_of_many_sources_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_A_TASK", 2)
    rows = [(f"same words w{i % 3} here{i}", "en", f"s{i % 7}") for i in range(40)]
    assert rows_of(spark, rows) == brute(rows)


def test_empty_and_tiny_tables(spark):
    assert rows_of(spark, []) == []
    assert rows_of(spark, [("one word", "en", "a")]) == []
    assert rows_of(spark, [("one", "en", "a"), (None, None, None), ("two", "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
