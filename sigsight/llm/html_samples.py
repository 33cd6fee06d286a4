"""Composed pages with known main text, to train the block labeller.

A page is a random choice of common layouts: where the article stands, which
menus, notices, adverts, sidebars, forms and comments surround it, how they are
marked (by element, class, id or not at all), how deep they are wrapped, and how
tidy the markup is.  Articles hold headings, lists, definition lists, quotes,
tables, figures with captions, code and scripts, or are several in a row.  Words
are drawn from random letters, anew for every page, so that no language's
spelling is learned.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from html import escape, unescape

# Fixed lists: names that pages commonly give to these parts.
MENU = "nav navbar menu navigation topnav breadcrumb breadcrumbs mainmenu toolbar tabs skip pagination pager".split()
HEADER = "header masthead top topbar banner branding logo sitehead hero".split()
FOOTER = "footer foot bottom copyright legal colophon siteinfo".split()
SIDE = "sidebar side aside related widget rail recommended popular trending toc archive tags".split()
NOTICE = "notice cookie cookies consent alert gdpr newsletter subscribe popup modal paywall warning message".split()
ADVERT = "ad ads advert advertisement sponsor sponsored promo promotion adbox banner".split()
COMMENTS = "comments comment discussion replies responses reply disqus thread".split()
SHARE = "share social sharing buttons follow".split()
CONTENT = "content article post entry story main body text page prose".split()
WRAPPERS = "wrapper container row columns col grid inner outer layout region block section-1 js-app".split()
MENU_WORDS = "home about contact login register search blog news products help terms privacy more menu".split()
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "àçéíîñöøüßżабвгдежиклмнопрстуαβγδεικλμνοπρσאבגדהמשابتدرسلم日本語中文学生한국"


class _Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.kept: set[str] = set()
        # A page's script: mostly plain letters, some others, in proportions of its own.
        weights = [rng.random() ** 2 * (1 if c.isascii() else rng.choice([0, 0, 0.3])) for c in LETTERS]
        self.words = ["".join(rng.choices(LETTERS, weights, k=rng.randint(1, 11))) for _ in range(150)]
        self.tidy = rng.random() < 0.7
        self.marked = rng.random() < 0.85
        self.lines = rng.random() < 0.3

    def sentence(self, least: int = 3, most: int = 20) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(least, most))
        kind = self.rng.random()
        if kind < 0.04:
            words = [w.upper() for w in words]
        elif kind < 0.08:
            words = [str(self.rng.randrange(10 ** self.rng.randint(1, 6))) if self.rng.random() < 0.5 else w for w in words]
        elif kind < 0.14:
            signs = self.rng.choices("!?#$%&*+-/:;=@^_|~()[]{}<>\"'", k=self.rng.randint(1, 4))
            words = [w + self.rng.choice(["", ",", escape("".join(signs))]) for w in words]
        elif kind < 0.17:
            words = self.rng.choices(words[: self.rng.randint(1, 3)], k=len(words))
        return " ".join(words).capitalize() + self.rng.choice([".", ".", ".", "!", "?", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.choice([1, 1, 2, 3, 4, 6, 10])))

    def phrase(self, most: int = 3) -> str:
        own = self.rng.random() < 0.5
        words = self.rng.choices(MENU_WORDS if own else self.words, k=self.rng.randint(1, most))
        return " ".join(words).capitalize()

    def box(self, names: list[str], inner: str, element: str | None = None) -> str:
        """The inner markup in an element of that meaning, or a div or section named so."""
        if element and self.rng.random() < 0.5:
            return f"<{element}>{inner}</{element}>"
        name = self.rng.choice(names)
        if self.rng.random() < 0.4:
            name = self.rng.choice([f"site-{name}", f"{name}-box", f"{name} wide", f"main-{name}", f"{name}_1"])
        tag = self.rng.choice(["div", "div", "section", element or "div"])
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{name}">{inner}</{tag}>'

    def keep(self, text: str) -> str:
        self.kept.add(" ".join(unescape(text).split()))
        return text

    def link(self) -> str:
        return f'<a href="/{self.rng.choice(self.words)}">{self.phrase()}</a>'

    def menu(self) -> str:
        links = [self.link() for _ in range(self.rng.randint(2, 9))]
        inner = "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>" if self.rng.random() < 0.7 else " | ".join(links)
        return self.box(MENU, inner, "nav")

    def header(self) -> str:
        title = self.rng.choice(["<h1>{}</h1>", "<div>{}</div>", "<p>{}</p>", '<a href="/">{}</a>']).format(self.phrase())
        return self.box(HEADER, title + (self.menu() if self.rng.random() < 0.5 else self.sentence(2, 8)), "header")

    def advert(self) -> str:
        text = self.sentence(2, 14)
        return self.box(ADVERT, self.rng.choice([text, f"<p>{text}</p>", f'<a href="/x">{text}</a>']), "aside")

    def notice(self) -> str:
        text = self.sentence(4, 18) + (f" <button>{self.phrase()}</button>" if self.rng.random() < 0.5 else "")
        return self.box(NOTICE, self.rng.choice([text, f"<p>{text}</p>"]))

    def form(self) -> str:
        inner = "".join(f"<label>{self.phrase()}</label><input>" for _ in range(self.rng.randint(1, 3)))
        return f"<form>{self.sentence(2, 6) if self.rng.random() < 0.5 else ''}{inner}<button>{self.phrase(2)}</button></form>"

    def side(self) -> str:
        kind = self.rng.random()
        if kind < 0.5:
            inner = f"<h3>{self.phrase()}</h3><ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(self.rng.randint(2, 6))) + "</ul>"
        else:
            inner = f"<h4>{self.phrase()}</h4>" + "".join(f"<p>{self.sentence()}</p>" for _ in range(self.rng.randint(1, 3)))
        return self.box(SIDE, inner, "aside")

    def comments(self) -> str:
        one = lambda: self.box(["comment", "reply"], self.rng.choice(["<b>{}</b><p>{}</p>", "<p>{} {}</p>", "<cite>{}</cite> {}"])
                               .format(self.phrase(2), self.prose()), "article" if self.rng.random() < 0.2 else None)
        inner = f"<h3>{self.rng.choice(['Comments', 'Replies', self.phrase()])}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 5)))
        return self.box(COMMENTS, inner + (self.form() if self.rng.random() < 0.4 else ""))

    def share(self) -> str:
        return self.box(SHARE, " ".join(self.link() for _ in range(self.rng.randint(2, 4))))

    def footer(self) -> str:
        parts = [f"&copy; {self.phrase()}.example.com &middot; {self.sentence(3, 16)}", self.sentence(3, 12), self.menu(), f"<p>{self.prose()}</p>"]
        return self.box(FOOTER, "".join(self.rng.sample(parts, self.rng.randint(1, 3))), "footer")

    def paragraph(self) -> str:
        text, kind = self.prose(), self.rng.random()
        if kind < 0.1:
            a, b, tag = self.sentence(), self.sentence(), self.rng.choice(["b", "em", "i", "strong", "span"])
            self.keep(f"{a} {b}")
            return f"<p>{a} <{tag}>{b}{f'</{tag}>' if self.tidy else ''}</p>"
        if kind < 0.2:
            words = text.split(" ")
            self.keep(text)
            k = self.rng.randrange(len(words))
            words[k] = f'<a href="/{k}">{words[k]}</a>'
            return "<p>" + " ".join(words) + "</p>"
        self.keep(text)
        if self.tidy or self.rng.random() < 0.5:
            return f"<p>{text}</p>"
        return self.rng.choice([f"<p>{text}", f"<p><span>{text}</p>", f"<div><p>{text}</div>", f"<p><em><strong>{text}<br></p>"])

    def part(self) -> str:
        kind = self.rng.random()
        if kind < 0.8:
            return self.paragraph()
        if kind < 0.88:
            return f"<h2>{self.keep(self.phrase(6))}</h2>" + self.paragraph()
        if kind < 0.91:
            tag, end = self.rng.choice(["ul", "ol"]), "</li>" if self.tidy else ""
            return f"<{tag}>" + "".join(f"<li>{self.keep(self.sentence())}{end}" for _ in range(self.rng.randint(2, 5))) + f"</{tag}>"
        if kind < 0.93:
            return f"<blockquote>{self.keep(self.prose())}</blockquote>"
        if kind < 0.945:
            return "<dl>" + "".join(f"<dt>{self.keep(self.phrase(4))}<dd>{self.keep(self.sentence())}" for _ in range(3)) + "</dl>"
        if kind < 0.96:
            return f'<figure><img src="/x.jpg" alt="{self.phrase()}"><figcaption>{self.keep(self.sentence(3, 12))}</figcaption></figure>'
        if kind < 0.975:
            lines = [" ".join([*self.rng.choices(self.words, k=3), self.rng.choice(["= 1;", "()", "{ }"])]) for _ in range(self.rng.randint(1, 4))]
            self.keep("\n".join(lines))
            return "<pre><code>" + "\n".join(lines) + "</code></pre>"
        if kind < 0.985:
            return f"<script>track('{self.phrase()}', \"<p>{self.phrase()}</p>\");</script><style>.x{{color:red}}</style>" + self.paragraph()
        return "<table>" + "".join(f"<tr><td>{self.keep(self.sentence(2, 4))}</td></tr>" for _ in range(2)) + "</table>"

    def article(self) -> str:
        title = f"<h1>{self.keep(self.sentence(2, 10))}</h1>" if self.rng.random() < 0.8 else ""
        parts = [self.part() for _ in range(self.rng.choice([1, 1, 2, 3, 4, 6, 9]))]
        extra: list[Callable[[], str]] = [self.advert, self.share, self.notice, self.form]
        for make in extra:
            if self.rng.random() < 0.12:
                parts.insert(self.rng.randint(0, len(parts)), make())
        inner = title + "".join(parts)
        kind = self.rng.random()
        if kind < 0.06:
            # Several in a row.
            rest = "".join(f"<article><h2>{self.keep(self.phrase(6))}</h2>{self.paragraph()}</article>" for _ in range(self.rng.randint(1, 3)))
            return f"<main><article>{inner}</article>{rest}</main>"
        if kind < 0.45:
            return f"<article>{inner}</article>"
        if kind < 0.6:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return self.box(CONTENT, inner)
        return f"<div>{inner}</div>"

    def html(self) -> str:
        chance = self.rng.random
        above = [f() for f, p in ((self.header, 0.5), (self.menu, 0.6), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.15)) if chance() < p]
        if chance() < 0.3:
            self.rng.shuffle(above)
        left = [self.side()] if chance() < 0.2 else []
        below = [f() for f, p in ((self.share, 0.2), (self.advert, 0.3), (self.comments, 0.35), (self.side, 0.35), (self.form, 0.15),
                                  (self.notice, 0.15), (self.footer, 0.75)) if chance() < p]
        middle = self.article()
        if chance() < 0.05:
            # A table for the layout.
            middle = f"<table><tr>{''.join(f'<td>{x}</td>' for x in [*left, middle])}</tr></table>"
            left = []
        elif chance() < 0.25:
            middle = f"<div class=\"{self.rng.choice(WRAPPERS)}\">{''.join(left)}{middle}</div>"
            left = []
        for _ in range(self.rng.choice([0, 0, 0, 1, 2, 4, 8, 20])):
            middle = f'<div class="{self.rng.choice(WRAPPERS)}">{middle}</div>' if chance() < 0.7 else f"<div>{middle}</div>"
        body = "".join([*above, *left, middle, *below])
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><script>var t = 1;</script></head><body>{body}</body></html>"


def sample_pages(n: int, seed: int = 3) -> Iterator[tuple[str, set[str]]]:
    """(html, texts of the article's blocks) of ``n`` composed pages; texts that also stand outside it count as its own."""
    rng = random.Random(seed)
    for _ in range(n):
        page = _Page(rng)
        yield page.html(), page.kept
