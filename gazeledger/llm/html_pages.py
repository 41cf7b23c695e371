"""Made-up pages with known main text, on which the extraction model is trained.

Layouts, class names and faults vary at random: semantic or plain tags, speaking or meaningless attributes, unclosed
elements, notices, adverts, side bars, forms and reader comments, some of them as long as an article. A block of main
text starts with ``MARK``.
"""

from __future__ import annotations

import random

MARK = "\ue000"
_SYLLABLES = "an be ci do en fa ga ho in ka le mo na or pe qui ra so te un va wi xe ya zu é ñ th ing er".split()


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.12:
                out[i] += r.choice(".,")
        noise = r.choice(["", "", "", "", "***", " |", "!!"])
        return (" ".join(x + (noise if r.random() < 0.8 else "") for x in out)).capitalize() + r.choice([".", ".", ".", "", "?"])

    def one(self, *choices: str) -> str:
        return self.rng.choice(choices)

    def maybe(self, p: float) -> bool:
        return self.rng.random() < p

    def attributes(self, *names: str) -> str:
        """Speaking names, or names that say nothing."""
        if self.maybe(0.25):
            return self.one("", f' class="c{self.rng.randint(1, 99)}"', f" id=x{self.rng.randint(1, 99)}")
        name = self.one(*names)
        name += self.one("", "", "-1", "-wrap", "_box", "-inner", "Area")
        return self.one(f' class="{name}"', f' id="{name}"', f" class='{name} c{self.rng.randint(1, 9)}'", f" class={name}")

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(self.rng.randint(low, high))]
        return self.one("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>")

    def prose(self, main: bool, low: int, high: int) -> str:
        mark = MARK if main else ""
        out = []
        for _ in range(self.rng.randint(low, high)):
            text = self.words(*self.one((1, 4), (1, 12), (10, 40), (20, 120), (40, 300)))
            if self.maybe(0.02):
                text = f"{text} " * self.rng.randint(5, 60)
            kind = self.rng.random()
            if kind < 0.72:
                out.append(f"<p>{mark}{text}" + ("" if self.maybe(0.15) else "</p>"))
            elif kind < 0.8:
                out.append(f"<p><b>{mark}{text}<br>")
            elif kind < 0.86:
                out.append(f"<h{self.rng.randint(2, 4)}>{mark}{self.words(1, 8)}</h2>" if self.maybe(0.1) else f"<h2>{mark}{self.words(1, 8)}</h2>")
            elif kind < 0.91:
                out.append("<ul>" + "".join(f"<li>{mark}{self.words(2, 20)}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote>{mark}{text}</blockquote>")
            elif kind < 0.96:
                out.append(f"<pre>{mark}{text}</pre>")
            elif kind < 0.98:
                out.append(f"<table><tr><td>{mark}{self.words(1, 5)}</td><td>{mark}{self.words(1, 5)}</td></tr></table>")
            else:
                out.append(f"<div>{mark}{text} <a href='/x'>{self.words(1, 3)}</a> {self.words(1, 9)}</div>")
        return "".join(out)

    def box(self, tags: tuple[str, ...], names: tuple[str, ...], inside: str) -> str:
        tag = self.one(*tags)
        return f"<{tag}{self.attributes(*names) if tag in ('div', 'section', 'ul') or self.maybe(0.4) else ''}>{inside}</{tag}>"

    def nav(self) -> str:
        return self.box(("nav", "nav", "div"), ("nav", "menu", "navbar", "breadcrumb", "toolbar"), self.links(2, 10))

    def head(self) -> str:
        return self.box(("header", "div"), ("header", "masthead", "top", "site-header"), self.one(f"<h1>{self.words(1, 3)}</h1>", f"<p>{self.words(1, 6)}</p>", self.words(1, 6)) + (self.nav() if self.maybe(0.5) else ""))

    def advert(self) -> str:
        return self.box(("div", "div", "section"), ("ad", "ads", "advert", "banner", "sponsored", "promo", "adsense"), self.one(self.words(2, 30), f"<p>{self.words(4, 40)}</p>", self.links(1, 3)))

    def notice(self) -> str:
        return self.box(("div", "section", "dialog"), ("cookie-notice", "notice", "consent", "alert", "popup", "gdpr"), f"<p>{self.words(6, 50)}</p>" + self.one("", "<button>OK</button>", self.links(1, 2)))

    def side(self) -> str:
        return self.box(("aside", "aside", "div"), ("sidebar", "side", "widget", "related", "right-col"), self.one(self.links(2, 8), f"<h3>{self.words(1, 3)}</h3>" + self.prose(False, 1, 3), f"<h3>{self.words(1, 3)}</h3>" + self.links(2, 6)))

    def form(self) -> str:
        return self.box(("form", "form", "div"), ("newsletter", "subscribe", "login", "search", "form"), f"<label>{self.words(1, 4)}</label><input name=q>" + self.one("", f"<p>{self.words(3, 20)}</p>") + "<button>Go</button>")

    def share(self) -> str:
        return self.box(("div", "ul"), ("share", "social", "tags", "meta-links"), self.links(2, 5))

    def comments(self) -> str:
        inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(
            self.box(("div", "li", "article"), ("comment", "reply", "comment-body"), self.one("", f"<b>{self.words(1, 2)}</b> ") + self.prose(False, 1, 2))
            for _ in range(self.rng.randint(1, 5)))
        return self.box(("section", "div", "div"), ("comments", "comment-list", "responses", "discussion", "disqus"), inside)

    def foot(self) -> str:
        return self.box(("footer", "footer", "div"), ("footer", "copyright", "site-footer", "bottom"), self.one(f"&copy; {self.words(1, 4)} &middot; {self.words(2, 20)}", f"<p>{self.words(2, 30)}</p>", self.links(2, 6) + self.words(1, 8)))

    def article(self) -> str:
        title = f"<h1>{MARK}{self.words(1, 12)}</h1>" if self.maybe(0.8) else ""
        if title and self.maybe(0.15):
            title = f"<header>{title}</header>"
        parts = [self.prose(True, 1, 3) for _ in range(self.rng.randint(1, 5))]
        for extra in (self.advert, self.share, self.side, self.form, self.notice):
            if self.maybe(0.12):
                parts.insert(self.rng.randint(0, len(parts)), extra())
        if self.maybe(0.1):
            parts.append(self.comments())
        body = title + "".join(parts)
        if self.maybe(0.3):
            body = f"<div{self.attributes('content', 'body', 'text', 'entry-content', 'article-body')}>{body}</div>"
        return self.box(("article", "article", "article", "div", "div", "section", "main"), ("article", "post", "entry", "story", "content", "main-text"), body) if self.maybe(0.93) else body

    def page(self) -> str:
        empty = self.maybe(0.06)
        main = "" if empty else self.article()
        if self.maybe(0.35):
            main = self.box(("main", "div", "div"), ("content", "main", "page", "container", "wrap", "layout"), main + (self.side() if self.maybe(0.3) else "") + (self.comments() if self.maybe(0.25) else ""))
        before = [f() for f, p in ((self.head, 0.5), (self.nav, 0.7), (self.notice, 0.2), (self.advert, 0.5), (self.side, 0.15)) if self.maybe(p)]
        after = [f() for f, p in ((self.side, 0.3), (self.comments, 0.25), (self.form, 0.2), (self.advert, 0.2), (self.notice, 0.1), (self.foot, 0.8)) if self.maybe(p)]
        self.rng.shuffle(before)
        out = f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t='<p>x</p>';</script></head><body>"
        out += "".join(before) + main + "".join(after)
        return out + ("" if self.maybe(0.15) else "</body></html>")


def pages(count: int, seed: int = 7) -> list[str]:
    maker = Maker(seed)
    return [maker.page() for _ in range(count)]
