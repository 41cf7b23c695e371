import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from gazeledger.llm import html_pages, main_text
from gazeledger.llm.html_dom import Page

SCHEMA = "page_id bigint, url string, html string, text int"


@pytest.fixture(scope="module")
def model():
    return main_text.train()


def test_decoding_is_the_best_consistent_labelling():
    rng = random.Random(3)
    for _ in range(60):
        parent = [-1] + [rng.randrange(i) for i in range(1, rng.randint(2, 8))]
        odds = np.array([rng.uniform(-2, 2) for _ in parent])
        legal = [k for k in itertools.product([0, 1], repeat=len(parent)) if all(p < 0 or k[p] or not k[i] for i, p in enumerate(parent))]
        best = max(float(odds @ np.array(k)) for k in legal)
        kept = main_text.keep(parent, odds)
        assert tuple(kept.astype(int)) in legal and abs(float(odds @ kept) - best) < 1e-9


def test_held_out_made_up_pages(model):
    wrong = total = 0
    for source in html_pages.pages(120, seed=99):
        page = Page(source)
        truth = [html_pages.MARK in t for t in page.text]
        page.text = [t.replace(html_pages.MARK, "") for t in page.text]
        kept = main_text.keep(page.parent, model.margin(main_text.features(page)))
        wrong += sum(1 for t, a, b in zip(page.text, truth, kept, strict=True) if t and a != b)
        total += sum(map(bool, page.text))
    assert wrong / total < 0.04


def article_of(source):
    inside = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1].replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r for r in main_text.main_text(pages, model).collect()}
    assert got.keys() == want.keys()
    assert [i for i in want if got[i]["text"] != want[i]] == []
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_edge_cases(spark, model):
    long = "<article>" + "<p>Some words, that go on. " * 30_000 + "</article>"
    body = "<nav><a href=/>Home</a></nav><article><h1>A &lt;b&gt; &#233;</h1><p>One&nbsp;two,\n three <b>fo</b>ur five six seven.<br>Eight nine.</article><div class=comments><p>I think so too.</p></div>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (3, "u", "< 3 <p", 1), (4, "u", body, 1), (4, "u", body, 1), (None, "u", "<script>", 1), (5, "u", long, 1),
            (6, "u", "<a href=\"x" * 300, 1), (7, "u", "<!-- open", 1), (8, "u", "<div>" * 3000 + "deep", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = main_text.main_text(df, model).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == by[2] == by[7] == by[None] == ""
    assert by[4] == "A <b> é\n\nOne two, three four five six seven. Eight nine."
    assert by[5].count("\n\n") == 29_999
    assert main_text.main_text(df.limit(0), model).count() == 0


@pytest.mark.parametrize(("inside", "text"), [
    ("two <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> end", "two x=12 end"),
    ("one<button>B</button>two", "one two"),
    ("see <video><source src=a>no player here</video> now", "see no player here now"),
    ("a <object>drawn <b>by</b> hand</object> b", "a drawn by hand b"),
    ("a<svg><text>no</text></svg>b", "ab"),
    ("open <svg> stays", "open stays"),
])
def test_no_text_of_a_block_is_lost(inside, text):
    assert [t for t in Page(f"<article><p>{inside}</p></article>").text if t] == [text]


def closes_by_walking(source):
    """The open elements at every text, by a plain walk over the stack."""
    from gazeledger.llm.html_dom import ENDS_ITEM

    stack, seen = [], []
    for closing, name, text in re.findall(r"<(/?)(\w+)>|([^<]+)", source):
        if text:
            seen.append([*stack])
        elif closing:
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name):]
        else:
            if stack and stack[-1] == "p":
                stack.pop()
            ended, bound = ENDS_ITEM.get(name, ((), ()))
            if ended:
                for at in range(len(stack) - 1, -1, -1):
                    if stack[at] in bound:
                        break
                    if stack[at] in ended:
                        del stack[at:]
            stack.append(name)
    return seen


def test_nesting_equals_a_plain_walk():
    rng = random.Random(5)
    for _ in range(400):
        parts = [rng.choice(["<{}>", "<{}>", "</{}>", "t"]).format(rng.choice("p div ul li table tr td th dl dt dd tbody".split())) for _ in range(40)]
        source = re.sub("t(?=t)", "", "".join(f"{p} " if p == "t" else p for p in parts)).replace("t t ", "t ")
        page, got = Page(source), []
        for i, text in enumerate(page.text):
            if text:
                above, at = [], page.parent[i]
                while at > 0:
                    above.append(page.tag[at])
                    at = page.parent[at]
                got.append(above[::-1])
        want = closes_by_walking(source)
        # neighbouring runs of text without a boundary between them are one leaf
        assert [k for k, _ in itertools.groupby(got)] == [k for k, _ in itertools.groupby(want)]


@pytest.mark.parametrize("source", [
    "<svg>x" * 60_000, "<div>" * 40_000 + "</b></ul>" * 40_000, "<div>" * 40_000 + "<li>x" * 40_000, "<td><div>" * 40_000,
    "<button>" * 60_000, "<p>" * 80_000, "<iframe a='" * 50_000,
])
def test_reading_takes_linear_time(source):
    start = time.process_time()
    Page(source)
    assert time.process_time() - start < 5
