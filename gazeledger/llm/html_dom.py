"""A small tolerant reading of HTML for text extraction: block elements and the runs of text between their boundaries."""

from __future__ import annotations

import bisect
import html
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split())
# formulas are text of their block
FORMULA = frozenset(
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts none mtable mtr mtd semantics".split())
# what stands inside these is shown where the medium is not; it is text like any other
MEDIA = frozenset("audio canvas object video".split())
CONTROLS = frozenset("button datalist select".split())
# elements without text of their own; an unclosed one of the first group hides the rest of the page
RAW = frozenset("script style title textarea".split())
SKIPPED = RAW | CONTROLS | frozenset("template noscript iframe svg annotation annotation-xml".split())
ENDS_ITEM = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_TAG = re.compile(
    r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z))""",
    re.S)
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in SKIPPED}
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+|[A-Z]+[a-z]*")


class Page:
    """Nodes in page order: an element is ``(parent, tag, attribute tokens, hidden)``; a leaf has tag ``#`` and its text.

    ``links`` counts a leaf's characters inside links, ``fields`` an element's own form fields and images.
    """

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["html"]
        self.tokens: list[list[str]] = [[]]
        self.hidden: list[bool] = [False]
        self.text: list[str] = [""]
        self.links: list[int] = [0]
        self.fields: list[int] = [0]
        self._open = [0]
        self._depths: dict[str, list[int]] = {}  # of the open elements with a name, from the root down
        self._never_closed: set[str] = set()
        self._run: list[str] = []
        self._linked = 0
        self._link_at: int | None = None
        self._read(source)

    def _add(self, tag: str, tokens: list[str], hidden: bool, text: str = "", links: int = 0) -> int:
        self.parent.append(self._open[-1])
        for column, value in zip((self.tag, self.tokens, self.hidden, self.text, self.links, self.fields), (tag, tokens, hidden, text, links, 0), strict=True):
            column.append(value)
        return len(self.tag) - 1

    def _flush(self) -> None:
        if self._run:
            text = " ".join("".join(self._run).split())
            if text:
                self._add("#", [], False, text, min(self._linked, len(text)))
            self._run, self._linked = [], 0

    def _text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            self._run.append(piece)
            if self._link_at is not None:
                self._linked += len(piece)

    def _shut(self, depth: int) -> None:
        for node in self._open[depth:]:
            self._depths[self.tag[node]].pop()
        del self._open[depth:]
        if self._link_at is not None and len(self._open) < self._link_at:
            self._link_at = None

    def _end_items(self, ended: set[str], bound: set[str]) -> None:
        """Close the outermost open element with a name in ``ended`` above the last one with a name in ``bound``."""
        last = max((self._depths[name][-1] for name in bound if self._depths.get(name)), default=0)
        above = []
        for name in ended:
            depths = self._depths.get(name, [])
            at = bisect.bisect_right(depths, last)
            above += depths[at : at + 1]
        if above:
            self._shut(min(above))

    def _read(self, source: str) -> None:
        at = 0
        while True:
            m = _TAG.search(source, at)
            if m is None:
                break
            self._text(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:  # comment or declaration
                continue
            name, closing, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if name in SKIPPED:
                if closing:
                    continue
                self.fields[self._open[-1]] += name not in RAW
                if name in CONTROLS:
                    self._run.append(" ")
                end = None if name in self._never_closed else _CLOSE[name].search(source, at)
                if end:
                    at = end.end()
                elif name in RAW:
                    at = len(source)
                else:  # its content stands in the page like any other; one search tells for all that follow
                    self._never_closed.add(name)
                continue
            if name in MEDIA:
                self._run.append(" ")
                self.fields[self._open[-1]] += not closing
                continue
            if name in INLINE or name in VOID or name in FORMULA:
                if name == "br":
                    self._run.append(" ")
                elif name == "hr":
                    self._flush()
                elif name == "a":
                    self._link_at = None if closing else len(self._open)
                elif name in ("input", "img", "label") and not closing:
                    self.fields[self._open[-1]] += 1
                continue
            self._flush()
            if closing:
                if self._depths.get(name):
                    self._shut(self._depths[name][-1])
                continue
            if name in ("html", "body"):
                continue
            if self.tag[self._open[-1]] == "p":
                self._shut(len(self._open) - 1)
            if name in ENDS_ITEM:
                self._end_items(*ENDS_ITEM[name])
            tokens, hidden = [], False
            if rest and rest != "/":
                for a in _ATTRIBUTE.finditer(rest):
                    kind, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                    if kind == "hidden" or kind == "aria-hidden" and value.lower() == "true":
                        hidden = True
                    elif kind == "style":
                        hidden |= "display:none" in value.replace(" ", "").lower()
                    elif kind != "aria-hidden":
                        tokens += [t.lower() for t in _TOKEN.findall(value)]
            self._depths.setdefault(name, []).append(len(self._open))
            self._open.append(self._add(name, tokens, hidden))
        self._text(source[at:])
        self._flush()
