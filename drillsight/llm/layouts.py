"""Pages with known main text, drawn from sampled blocks: what the extractor is trained on.

A drawn page puts texts of the given pages into a layout: menus, header, side bars, notices,
adverts, forms, comments and footer around (or inside) an article, under names that such
parts go by.  Every part carries the attribute :data:`MARK`, ``1`` for main text and ``0`` for
the rest, so the label of each node is known by construction.  Draws are seeded.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from html import escape

MARK = "data-main"

# Names under which parts of pages go, as words of class and id.
ARTICLE = ["article", "post", "entry", "story", "article-body", "entry-content", "post-content", "main-content", "text", "content", "body-copy", "prose", "news"]
NEUTRAL = ["wrapper", "container", "page", "site", "inner", "row", "column", "layout", "grid", "section", "block", "outer", "center"]
MENU = ["nav", "menu", "navbar", "navigation", "breadcrumbs", "tabs", "toc", "pagination", "pager", "links", "topnav"]
HEADER = ["header", "masthead", "site-header", "logo", "brand", "banner", "tagline", "topbar"]
TITLE = ["entry-header", "post-header", "article-header", "story-header", "headline", "title"]
FOOTER = ["footer", "site-footer", "copyright", "legal", "bottom", "credits", "colophon", "imprint"]
SIDE = ["sidebar", "related", "widget", "popular", "recommended", "trending", "tags", "archive", "recent", "rail", "see-also", "teaser", "aside"]
NOTICE = ["cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "subscribe", "newsletter", "privacy", "disclaimer"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adbox", "commercial"]
FORM = ["form", "search", "login", "contact-form", "register", "feedback", "poll", "signup"]
COMMENT = ["comments", "comment-list", "discussion", "responses", "replies", "disqus", "reviews", "reader-comments"]
SHARE = ["share", "social", "follow", "sharing", "toolbar", "buttons"]

Parts = list[str]


class Layouts:
    """Draws pages from long and short texts."""

    def __init__(self, long: list[str], short: list[str], seed: int = 1) -> None:
        self.draw = random.Random(seed)
        self.long = long or ["This sentence stands for the text of a page, as none was given."]
        self.short = short or ["More", "About us", "Home", "Contact"]

    def chance(self, share: float) -> bool:
        return self.draw.random() < share

    def some(self, make: Callable[[], str], least: int, most: int) -> Parts:
        return [make() for _ in range(self.draw.randint(least, most))]

    def sentence(self, most: int = 300) -> str:
        return escape(self.draw.choice(self.long)[: self.draw.randint(30, most)])

    def words(self) -> str:
        source = self.draw.choice(self.short) if self.chance(0.6) else self.draw.choice(self.long)
        return escape(" ".join(source.split()[: self.draw.randint(1, 5)])[:60])

    def element(self, tag: str, names: list[str] | None, inside: Parts, main: bool | None = None) -> str:
        """``inside`` in a tag whose class or id may hold one of ``names``."""
        out = f"<{tag}"
        if names and (tag in ("div", "section", "ul", "ol") or self.chance(0.8)):
            name = self.draw.choice(names)
            name = self.draw.choice([name, name, name, f"{name}-{self.draw.randint(1, 9)}", f"js-{name}", f"c_{name} box", f"{name} {self.draw.choice(NEUTRAL)}"])
            out += f' {self.draw.choice(["class", "class", "id"])}="{name}"'
        if main is not None:
            out += f' {MARK}="{int(main)}"'
        return f"{out}>{self.draw.choice(['', chr(10)]).join(inside)}</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.draw.randint(1, 999)}">{self.words()}</a>'

    def paragraph(self) -> str:
        text = self.sentence(900) if self.chance(0.8) else self.words()
        if self.chance(0.15):
            text = f"<{(t := self.draw.choice(['b', 'em', 'strong', 'span']))}>{text}</{t}>"
        if self.chance(0.1):
            text += f" {self.link()} {self.sentence(80)}"
        return f"<p>{text}</p>" if self.chance(0.85) else f"<p>{text}<br>"

    def list_of(self, make: Callable[[], str], least: int, most: int, tag: str = "ul") -> str:
        return self.element(tag, None, [f"<li>{x}</li>" for x in self.some(make, least, most)])

    # The article.

    def body(self) -> Parts:
        kind = self.draw.random()
        if kind < 0.08:  # text divided by breaks or plain div elements
            made = self.some(lambda: f"<div>{self.sentence(600)}</div>", 1, 10)
            return made if self.chance(0.5) else [f"<div>{'<br><br>'.join(self.some(lambda: self.sentence(600), 1, 6))}</div>"]
        out = self.some(self.paragraph, 1, 14 if kind < 0.65 else 2)
        extra = [
            lambda: f"<{(h := self.draw.choice(['h2', 'h3', 'h4']))}>{self.words()}</{h}>",
            lambda: f"<blockquote>{self.draw.choice([self.sentence(200), self.paragraph()])}</blockquote>",
            lambda: self.list_of(lambda: self.sentence(120), 2, 6, self.draw.choice(["ul", "ol"])),
            lambda: f"<pre>{self.sentence(200)}</pre>",
            lambda: "<table>" + "".join(f"<tr><td>{self.words()}</td><td>{self.words()}</td></tr>" for _ in range(self.draw.randint(2, 5))) + "</table>",
            lambda: f'<figure><img src="x.png"><figcaption>{self.sentence(80)}</figcaption></figure>',
        ]
        for _ in range(self.draw.choice([0, 0, 0, 1, 2, 3])):
            out.insert(self.draw.randint(0, len(out)), self.draw.choice(extra)())
        for _ in range(self.draw.choice([0, 0, 0, 0, 1, 2])):  # strangers inside the article
            out.insert(self.draw.randint(0, len(out)), self.draw.choice([self.advert, self.share, self.related, self.newsletter, self.advert])())
        return out

    def article(self) -> str:
        title = f"<h1>{self.draw.choice([self.words, lambda: self.sentence(70)])()}</h1>"
        if self.chance(0.3):
            title = self.element(self.draw.choice(["header", "header", "div"]), TITLE, [title])
        inside = ([title] if self.chance(0.75) else []) + self.body()
        if self.chance(0.15):
            inside.append(self.element("footer", FOOTER if self.chance(0.5) else None, [self.list_of(self.link, 1, 4)], False))
        if self.chance(0.12):
            inside.append(self.comments())
        tag, names = self.draw.choice(
            [("article", None), ("article", None), ("article", ARTICLE), ("main", None), ("main", ARTICLE), ("div", ARTICLE), ("div", ARTICLE), ("section", ARTICLE), ("div", None)]
        )
        out = self.element(tag, names, inside, True)
        if self.chance(0.2):
            out = self.element(*self.draw.choice([("main", None), ("div", ARTICLE), ("section", None)]), [out])
        return out

    # The rest.

    def menu(self) -> str:
        inside = [self.list_of(self.link, 3, 12)] if self.chance(0.8) else self.some(self.link, 3, 12)
        tag, names = self.draw.choice([("nav", None), ("nav", MENU), ("div", MENU), ("ul", MENU)])
        return self.element(tag, names, inside if tag != "ul" else [f"<li>{self.link()}</li>" for _ in range(6)], False)

    def header(self) -> str:
        inside = self.some(lambda: self.draw.choice([f"<h1>{self.words()}</h1>", f"<p>{self.sentence(90)}</p>", f"<div>{self.words()}</div>", self.link()]), 1, 3)
        if self.chance(0.4):
            inside.append(self.menu())
        return self.element(*self.draw.choice([("header", None), ("header", HEADER), ("div", HEADER)]), inside, False)

    def footer(self) -> str:
        inside = self.some(lambda: self.draw.choice([f"<p>&copy; {self.sentence(150)}</p>", f"&copy; {self.words()} &middot; {self.sentence(120)}", self.list_of(self.link, 2, 8), f"<div>{self.words()}</div>"]), 1, 3)
        return self.element(*self.draw.choice([("footer", None), ("footer", FOOTER), ("div", FOOTER)]), inside, False)

    def related(self) -> str:
        inside = [f"<h3>{self.words()}</h3>"] if self.chance(0.6) else []
        inside += [self.list_of(self.link, 2, 8)] if self.chance(0.6) else self.some(lambda: f"<div>{self.link()}<p>{self.sentence(160)}</p></div>", 1, 5)
        return self.element(*self.draw.choice([("aside", None), ("aside", SIDE), ("div", SIDE), ("section", SIDE)]), inside, False)

    def notice(self) -> str:
        inside = [f"<p>{self.sentence(250)}</p>" if self.chance(0.7) else self.sentence(250)]
        inside += [f"<button>{self.words()}</button>"] if self.chance(0.5) else []
        return self.element(self.draw.choice(["div", "section", "aside"]), NOTICE, inside, False)

    def advert(self) -> str:
        inside = self.some(lambda: self.draw.choice([self.sentence(200), f"<p>{self.sentence(200)}</p>", self.link(), "<img src='x'>" + self.words()]), 1, 2)
        return self.element(self.draw.choice(["div", "div", "aside", "section"]), ADVERT, inside, False).replace("<div data", '<div class="ad" data', 1)

    def form(self) -> str:
        fields = "".join(f"<label>{self.words()}</label><input name='a'>" for _ in range(self.draw.randint(1, 5)))
        inside = [f"<p>{self.sentence(100)}</p>"] if self.chance(0.5) else []
        inside.append(f"{fields}<button>{self.words()}</button>")
        return self.element(*self.draw.choice([("form", None), ("form", FORM)]), inside, False)

    def newsletter(self) -> str:
        return self.form() if self.chance(0.4) else self.notice()

    def share(self) -> str:
        return self.element(self.draw.choice(["div", "ul"]), SHARE, [f"<li>{self.link()}</li>" for _ in range(self.draw.randint(2, 5))], False)

    def comments(self) -> str:
        one = lambda: self.element(self.draw.choice(["div", "div", "div", "li", "li", "li", "article"]), ["comment", "reply", "response", "review"], [f"<b>{self.words()}</b>"] * self.chance(0.6) + self.some(lambda: f"<p>{self.sentence(400)}</p>", 1, 2))
        inside = [f"<h3>{self.words()}</h3>"] if self.chance(0.6) else []
        inside += self.some(one, 1, 8)
        if self.chance(0.3):
            inside.append(self.form())
        return self.element(self.draw.choice(["div", "section", "ol", "ul"]), COMMENT, inside, False)

    def page(self) -> str:
        """One page; the mark of each part tells its label."""
        much = self.draw.choice([0.3, 1.0, 1.0])  # how much stands around the article
        before = [x() for x in (self.notice, self.header, self.menu, self.advert, self.menu) if self.chance(0.45 * much)]
        middle = [] if len(before) > 1 and self.chance(0.04) else [self.article()]
        if self.chance(0.45 * much):
            middle.insert(self.draw.randint(0, len(middle)), self.related())
        if self.chance(0.25 * much):
            middle.append(self.comments())
        after = [x() for x in (self.related, self.form, self.share, self.advert, self.footer, self.notice) if self.chance(0.35 * much)]
        if self.chance(0.4):
            middle = [self.element(self.draw.choice(["div", "div", "section", "main"]), NEUTRAL, middle)]
        whole = [*before, *middle, *after]
        while self.chance(0.35):
            whole = [self.element("div", NEUTRAL, whole)]
        if self.chance(0.04):
            whole = [self.element("form", None, ["<input name='state'>", *whole])]
        return f'<html><head><title>{self.words()}</title></head><body {MARK}="0">{chr(10).join(whole)}</body></html>'
