"""Main text of web pages (operator 7): boosted trees over DOM nodes, decoded from the root down.

Every block element and every run of text is a node. Features: depth, characters, words and link share of the subtree,
share of the parent's and the page's text, place among the siblings, tag group, attribute tokens of the node and its
ancestors. The trees, trained on ``html_pages`` (``TRAINING_PAGES`` made-up pages), give the odds that a node holds main
text. Decoding maximises the sum of these log-odds over the page under one rule: below a dropped node nothing is kept;
so an ancestor and its descendants never contradict each other. Kept runs of text are the blocks.

Character references are decoded, white space (line breaks too) becomes one space, blocks are joined by an empty line in
page order. Formulas and the text inside media elements belong to their block; form controls, scripts, styles, drawings and
what browsers never show (templates, frames, annotations of formulas) have no text. NULL and empty pages, and pages without main text, give the empty text. Pages of any length are read whole,
in time in proportion to their length.
Repeated rows and rows with NULL ids give one row each. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazeledger.llm import boosting, html_pages
from gazeledger.llm.html_dom import Page

TRAINING_PAGES = 700
RESULT = "page_id bigint, url string, text string, n_chars bigint"
TAG_GROUPS = {
    1: "nav menu", 2: "header", 3: "footer", 4: "aside", 5: "form fieldset", 6: "article", 7: "main", 8: "section",
    9: "p", 10: "h1", 11: "h2 h3 h4 h5 h6", 12: "li dt dd", 13: "ul ol dl", 14: "table tbody thead tfoot tr td th", 15: "dialog",
    16: "blockquote pre figure figcaption", 17: "#",
}
GROUP = {tag: g for g, tags in TAG_GROUPS.items() for tag in tags.split()}
# attribute tokens: what they say about a node
TOKENS = {
    "away": "nav navbar menu header masthead top footer bottom copyright sidebar side aside widget related recommended ad ads advert adsense "
            "banner sponsored sponsor promo cookie notice consent alert popup modal gdpr overlay social share tags breadcrumb breadcrumbs "
            "toolbar pagination pager newsletter subscribe login signup search form dialog navigation contentinfo complementary",
    "talk": "comment comments reply replies response responses discussion disqus respond",
    "main": "article post entry story content main text body",
}
SAYS = {token: kind for kind, tokens in TOKENS.items() for token in tokens.split()}
ENDINGS = frozenset(".,;:?!")


def features(page: Page) -> np.ndarray:
    """One row per node; children follow their parents."""
    n = len(page.tag)
    parent = np.array(page.parent)
    chars, links, words, stops, runs = (np.zeros(n) for _ in range(5))
    for i, text in enumerate(page.text):
        if text:
            chars[i], links[i], words[i], runs[i] = len(text), page.links[i], text.count(" ") + 1, 1
            stops[i] = text.count(".") + text.count(",")
    group = np.array([GROUP.get(t, 0) for t in page.tag])
    elements, fields, paragraphs = (group != 17).astype(float), np.array(page.fields, float), (group == 9).astype(float)
    own_runs = np.bincount(parent[1:], weights=(group == 17)[1:], minlength=n) if n > 1 else np.zeros(n)
    subtree = [chars, links, words, stops, runs, elements, fields, paragraphs]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for column in subtree:
            column[p] += column[i]
    depth, place, said = np.zeros(n), np.zeros(n), np.zeros((n, 3))
    above, hidden, in_group = np.zeros((n, 3)), np.array(page.hidden, float), np.zeros((n, 3))
    children = np.zeros(n)
    before, start = np.zeros(n), 0.0
    kinds = {"away": 0, "talk": 1, "main": 2}
    for i in range(n):
        for token in page.tokens[i]:
            kind = SAYS.get(token)
            if kind:
                said[i, kinds[kind]] += 1
        before[i] = start
        start += chars[i] if group[i] == 17 else 0
        if i:
            p = parent[i]
            depth[i] = depth[p] + 1
            place[i] = children[p]
            children[p] += 1
            above[i] = above[p] + said[p]
            hidden[i] = max(hidden[i], hidden[p])
            g = group[p]
            in_group[i] = in_group[p] + (1 <= g <= 5 or g == 15, 6 <= g <= 7, 12 <= g <= 14)
    up = np.maximum(parent, 0)
    page_chars = max(chars[0], 1.0)
    return np.stack([
        depth, np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), stops / np.maximum(words, 1), np.log1p(runs),
        chars / np.maximum(elements + 1, 1), np.log1p(fields), np.log1p(paragraphs), chars / np.maximum(chars[up], 1), chars / page_chars,
        before / page_chars, (before + chars) / page_chars, place, children[up], children, own_runs, group, group[up],
        said[:, 0], said[:, 1], said[:, 2], above[:, 0], above[:, 1], above[:, 2], in_group[:, 0], in_group[:, 1], in_group[:, 2],
        hidden, np.log1p(chars[up]), links[up] / np.maximum(chars[up], 1), np.full(n, np.log1p(chars[0])), words / np.maximum(runs, 1),
    ], 1)


def keep(parent: list[int], odds: np.ndarray) -> np.ndarray:
    """Nodes kept by the best labelling in which nothing below a dropped node is kept."""
    gain = odds.copy()  # of keeping a node, over dropping its whole subtree
    for i in range(len(parent) - 1, 0, -1):
        if gain[i] > 0:
            gain[parent[i]] += gain[i]
    kept = gain > 0
    for i in range(1, len(parent)):
        kept[i] &= kept[parent[i]]
    return kept


def train(count: int = TRAINING_PAGES, seed: int = 7) -> boosting.Boosted:
    rows, target = [], []
    for source in html_pages.pages(count, seed):
        page = Page(source)
        main = np.array([html_pages.MARK in t for t in page.text], float)
        page.text = [t.replace(html_pages.MARK, "") for t in page.text]
        for i in range(len(main) - 1, 0, -1):
            main[page.parent[i]] = max(main[page.parent[i]], main[i])
        rows.append(features(page))
        target.append(main)
    return boosting.fit(np.concatenate(rows), np.concatenate(target))


def extract(sources: list[str], model: boosting.Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    rows = [features(p) for p in pages]
    odds = model.margin(np.concatenate(rows))
    out, first = [], 0
    for page, own in zip(pages, rows, strict=True):
        kept = keep(page.parent, odds[first : first + len(own)])
        first += len(own)
        out.append("\n\n".join(t for t, k in zip(page.text, kept, strict=True) if t and k))
    return out


def main_text(pages: DataFrame, model: boosting.Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = extract([h or "" for h in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return own.mapInArrow(run, RESULT)
