"""Fits the trees of ``pages`` on generated pages: ``python -m tessel.llm.pages_train``.

The pages are drawn from a grammar of layouts. Elements of the article carry a mark that
the features don't read, and runs of its text that stand directly in the body an invisible
character; an element belongs if it or anything below it is marked.
"""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np

from tessel.llm import pages, trees
from tessel.llm.dom import Page

MARK = ' data-y="1"'
BARE_MARK = "\u2063"
SYLLABLES = "an be co der el fi ga hu in jo ka lo mi no or pa qui ra se to un ve wi xo ya zu ent ing ion ous".split()


class Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        w = self.words(low, high).split(" ")
        if len(w) > 8 and self.r.random() < 0.5:
            w[len(w) // 2] += ","
        return " ".join(w).capitalize() + self.r.choice(".....!?")

    def prose(self, low: int = 1, high: int = 9) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.15:
            out = out.replace(" ", f' <a href="/{self.word()}">{self.word()}</a> ', 1)
        if self.r.random() < 0.1:
            out = f"<b>{out}" + "</b>" * (self.r.random() < 0.5)
        if self.r.random() < 0.1:
            out += "<br>"
        return out + (" &amp; " + self.word() if self.r.random() < 0.1 else "")

    def css(self, *names: str) -> str:
        """A class or id attribute from one of the names, or none."""
        name = self.r.choice(names)
        if not name:
            return ""
        if self.r.random() < 0.3:
            name += self.r.choice(["-", "_", " "]) + self.r.choice(["box", "wrap", "inner", "1", "main", self.word()])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 4)}</a></li>' for _ in range(self.r.randint(low, high))) + "</ul>"

    # What does not belong.
    def menu(self) -> str:
        body = self.links(3, 10) if self.r.random() < 0.8 else " ".join(f'<a href="/">{self.word()}</a>' for _ in range(6))
        return self.r.choice([f"<nav{self.css('', '', 'menu', 'nav')}>{body}</nav>", f"<div{self.css('menu', 'nav', 'navbar', 'breadcrumb')}>{body}</div>"])

    def header(self) -> str:
        inner = self.r.choice([f"<h1>{self.words(1, 4)}</h1>", f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.words(2, 8)}</p>"]) + (self.menu() if self.r.random() < 0.4 else "")
        return self.r.choice([f"<header>{inner}</header>", f"<div{self.css('header', 'masthead', 'topbar', 'logo')}>{inner}</div>"])

    def footer(self) -> str:
        inner = f"&copy; {self.word()} &middot; {self.sentence()} " * self.r.randint(1, 2) + (self.links(2, 6) if self.r.random() < 0.3 else "")
        inner = f"<p>{inner}</p>" if self.r.random() < 0.4 else inner
        return self.r.choice([f"<footer{self.css('', '', 'footer')}>{inner}</footer>", f"<div{self.css('footer', 'copyright', 'legal')}>{inner}</div>"])

    def advert(self) -> str:
        inner = f"{self.prose(1, 4)}" if self.r.random() < 0.7 else f"<p>{self.prose(1, 4)}</p>"
        return f"<{(t := self.r.choice(['div', 'div', 'aside', 'section']))}{self.css('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner')}>{inner}</{t}>"

    def side(self) -> str:
        inner = self.r.choice([f"<h3>{self.words(1, 4)}</h3>", f"<h3>{self.words(1, 4)}</h3>", ""]) + self.r.choice([self.links(2, 8), f"<p>{self.prose(1, 4)}</p>", self.words(2, 6), self.prose(1, 3)])
        return self.r.choice([f"<aside{self.css('', 'sidebar', 'related')}>{inner}</aside>", f"<div{self.css('sidebar', 'related', 'widget', 'popular')}>{inner}</div>"])

    def notice(self) -> str:
        t = self.r.choice(["div", "section", "p", "dialog"])
        inner = self.prose(1, 3) + (f"<button>{self.word()}</button>" if self.r.random() < 0.5 and t != "p" else "")
        return f"<{t}{self.css('cookie', 'notice', 'consent', 'newsletter', 'alert', 'subscribe', 'popup')}>{inner}</{t}>"

    def form(self) -> str:
        return f"<form{self.css('', 'search', 'login', 'contact')}><label>{self.words(1, 3)}</label><input name=q>{self.r.choice(['', f'<p>{self.sentence()}</p>'])}<button>{self.word()}</button></form>"

    def comments(self) -> str:
        name = self.r.choice(["comment", "reply", "comment-body"])
        one = lambda: self.r.choice([f'<div class="{name}"><b>{self.word()}</b><p>{self.prose(1, 5)}</p></div>', f'<li class="{name}"><p>{self.prose(1, 5)}</p></li>', f'<article class="{name}"><p>{self.prose(1, 5)}</p></article>'])
        t = self.r.choice(["div", "section", "ol"])
        return f"<{t}{self.css('comments', 'discussion', 'responses comments', 'reader-comments')}>" + f"<h2>{self.words(1, 3)}</h2>" * (t != "ol") + "".join(one() for _ in range(self.r.randint(1, 6))) + f"</{t}>"

    def share(self) -> str:
        inner = " ".join(f'<a href="#">{self.word()}</a>' for _ in range(4)) if self.r.random() < 0.6 else self.words(1, 5)
        return f"<div{self.css('share', 'social', 'follow')}>{inner}</div>"

    def junk(self) -> str:
        return self.r.choice([self.menu, self.advert, self.side, self.notice, self.form, self.share])()

    def inline_junk(self) -> str:
        t = self.r.choice(["p", "div", "section"])
        return f"<{t}{self.css('ad', 'advert', 'notice', 'share', 'sponsored', 'newsletter', 'related')}>{self.prose(1, 2)}</{t}>"

    # What belongs.
    def block(self) -> str:
        x = self.r.random()
        if x < 0.74:
            return f"<p{MARK}{self.css('', '', '', '', 'text')}>{self.prose()}" + "</p>" * (self.r.random() < 0.9)
        if x < 0.82:
            return f"<h2{MARK}>{self.words(2, 7)}</h2>"
        if x < 0.88:
            return f"<ul{MARK}>" + "".join(f"<li{MARK}>{self.sentence()}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if x < 0.91:
            return f"<blockquote{MARK}><p{MARK}>{self.prose(1, 3)}</p></blockquote>"
        if x < 0.94:
            return f"<table{MARK}>" + "".join(f"<tr{MARK}><td{MARK}>{self.word()}</td><td{MARK}>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(2, 5))) + "</table>"
        if x < 0.97:
            return f"<div{MARK}>{self.prose()}</div>"
        return f"<p{MARK}>{self.words(1, 5)}</p>"

    def bare(self) -> str:
        """A run of the article's text outside of any element."""
        return self.r.choice(["", "<br>", "<hr>"]) + BARE_MARK + self.prose(1, 6)

    def article(self, bare: bool = False) -> str:
        title = f"<h1{MARK}>{self.words(1, 12) if self.r.random() < 0.8 else self.word()[:3]}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.15:
            title = f"<header{MARK}>{title}</header>"
        parts = [self.bare() if bare and self.r.random() < 0.7 else self.block() for _ in range(self.r.choice([1, 1, 2, 3, 4, 6, 8, 12, 16, 24]))]
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2, 3])):
            parts.insert(self.r.randint(0, len(parts)), self.r.choice([self.advert, self.share, self.notice, self.side, self.form, self.inline_junk])())
        inner = title + "".join(parts)
        if bare:
            return inner
        if self.r.random() < 0.25:
            inner = f"<div{MARK}{self.css('', 'content', 'body', 'entry', 'text')}>{inner}</div>"
        if self.r.random() < 0.12:
            inner += self.comments()
        if self.r.random() < 0.12:  # nothing around it
            return inner
        t, attr = self.r.choice([("article", ""), ("div", ""), ("article", ""), ("article", self.css("", "post", "story")), ("main", ""), ("div", self.css("content", "article", "post", "entry", "story", "main")), ("section", self.css("content", "article", "post"))])
        return f"<{t}{MARK}{attr}>{inner}" + f"</{t}>" * (self.r.random() < 0.97)

    def page(self) -> str:
        some = lambda p, f: [f()] if self.r.random() < p else []
        top = [*some(0.5, self.header), *some(0.8, self.menu), *some(0.4, self.advert), *some(0.2, self.notice)]
        if self.r.random() < 0.3:
            self.r.shuffle(top)
        end = [*some(0.25, self.side), *some(0.25, self.comments), *some(0.15, self.advert), *some(0.1, self.form), *some(0.85, self.footer)]
        bare = self.r.random() < 0.12
        mid = [*some(0.1, self.side), self.article(bare)]
        if self.r.random() < 0.06:
            top, end = [], []
        if self.r.random() < 0.15:  # loose words around the article
            loose = self.r.choice([lambda: self.words(1, 4), lambda: f'<a href="/">{self.words(1, 3)}</a> | <a href="/">{self.word()}</a>', lambda: f"&copy; {self.words(1, 5)}"])()
            (top if self.r.random() < 0.5 else end).append(loose)
        wrapped = not bare and self.r.random() < 0.3
        body = "".join(top) + (f"<div{MARK}{self.css('', 'wrap', 'container')}>" + "".join(mid) + "</div>" if wrapped else "".join(mid)) + "".join(end)
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{body}" + "</body></html>" * (self.r.random() < 0.9)


def labelled(source: str) -> tuple[np.ndarray, np.ndarray]:
    page = Page(source)
    below = [MARK.strip() in n.attrs for n in page.nodes]
    for k, text in page.blocks:
        below[k] |= BARE_MARK in text
    for k in range(len(below) - 1, 0, -1):
        below[page.nodes[k].parent] |= below[k]
    judged, x = pages.node_features(page)
    return x, np.array([below[k] for k in judged], dtype=np.float64)


def gold(source: str) -> str:
    page = Page(source)
    return "\n".join(t for k, t in page.blocks if MARK.strip() in page.nodes[k].attrs or BARE_MARK in t)


def main(count: int = 6000) -> None:
    found = [labelled(Writer(k).page()) for k in range(count)]
    fitted = trees.fit(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]), trees=80, depth=5)
    fitted.save(Path(__file__).parent / "models" / "pages.json")


if __name__ == "__main__":
    main()
