"""Labelled training pages: made up layouts whose elements say whether they hold content.

Elements carry ``data-y``: 1 on the article and what leads to it, 0 elsewhere. Layouts vary
in their elements, their class names and in how much text stands in either part, so that a
model has to weigh them against each other.
"""

from __future__ import annotations

import random

#: Names that web pages give to their parts.
CONTENT_NAMES = "content main article post entry story body text article-body post-content entry-content main-content page-content story-body".split()
OTHER_NAMES = {
    "ad": "ad ads advert advertisement sponsor sponsored promo banner ad-slot ad-box adsbox".split(),
    "side": "sidebar side aside widget related recommended popular trending more-stories toc".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal newsletter subscribe signup paywall".split(),
    "comments": "comments comment reader-comments replies reply discussion responses comment-list user-comments".split(),
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs topnav pagination tabs".split(),
    "head": "header masthead topbar site-header page-header logo branding hero".split(),
    "foot": "footer foot site-footer bottom copyright legal colophon".split(),
    "form": "form search login contact search-form register".split(),
    "share": "share social sharing follow tags meta-links".split(),
}
NAME_ENDS = ["", "", "", "-bar", "-box", "-wrap", "-wrapper", "-list", "-area", "-block", "_inner", "-container", " clearfix"]
TAGS = {"ad": "div aside section", "side": "aside div section", "notice": "div section aside", "comments": "section div", "menu": "nav div ul", "head": "header div", "foot": "footer div", "form": "form div", "share": "div ul"}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.plain = False  # text without punctuation, of few words over and over

    def words(self, n: int) -> str:
        r = self.rng
        if self.plain:
            some = ["".join(r.choice("abcdefghilmnoprstuvéñ") for _ in range(5)) for _ in range(2)]
            return " ".join(r.choice(some) for _ in range(n))
        out = []
        for i in range(n):
            w = "".join(r.choice("abcdefghilmnoprstuvéñ") for _ in range(r.randint(2, 9)))
            out.append((w.capitalize() if r.random() < 0.12 else w) + (r.choice(".,,.;?") if r.random() < 0.16 else ""))
        return " ".join(out)

    def inline(self, n: int) -> str:
        r = self.rng
        text = self.words(n)
        if n > 12 and r.random() < 0.35:
            tag = r.choice(["a href='/x'", "b", "em", "strong", "i"])
            text += f" <{tag}>{self.words(r.randint(1, 4))}</{tag.split()[0]}> {self.words(r.randint(1, 8))}"
        return text

    def article(self) -> str:
        r = self.rng
        parts = []
        if r.random() < 0.7:
            head = f"<h1 data-y=1>{self.words(r.randint(3, 12))}</h1>"
            parts.append(f"<header data-y=1>{head}</header>" if r.random() < 0.1 else head)
        lines = r.random() < 0.12  # an article of many short paragraphs
        for _ in range(r.choice([20, 50, 250]) if lines else r.choice([1, 2, 3, 5, 8, 12])):
            kind = r.random() * (0.75 if lines else 1)
            n = r.randint(1, 6) if lines else r.choice([3, 8, 15, 40, 80, 120])
            if kind < 0.74:
                parts.append(f"<p data-y=1>{self.inline(n)}</p>")
            elif kind < 0.82:
                parts.append(f"<h2 data-y=1>{self.words(r.randint(2, 7))}</h2>")
            elif kind < 0.88:
                items = "".join(f"<li data-y=1>{self.inline(r.randint(2, 25))}</li>" for _ in range(r.randint(2, 6)))
                parts.append(f"<ul data-y=1>{items}</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote data-y=1><p data-y=1>{self.words(n)}</p></blockquote>")
            elif kind < 0.96:
                cells = "".join(f"<tr data-y=1><td data-y=1>{self.words(2)}</td><td data-y=1>{self.words(3)}</td></tr>" for _ in range(3))
                parts.append(f"<table data-y=1><tbody data-y=1>{cells}</tbody></table>")
            else:
                parts.append(self.other(r.choice(["ad", "side", "share"])))
        return "".join(parts)

    def other(self, kind: str) -> str:
        r = self.rng
        tag = r.choice(TAGS[kind].split())
        name = r.choice(OTHER_NAMES[kind]) + r.choice(NAME_ENDS)
        mark = f' {r.choice(["class", "class", "id"])}="{name}"' if tag == "div" or tag == "section" or r.random() < 0.4 else ""
        link = lambda n: f'<a href="/{r.randint(1, 99)}">{self.words(n)}</a>'
        if kind in ("menu", "share"):
            inner = "".join(f"<li data-y=0>{link(r.randint(1, 3))}</li>" for _ in range(r.randint(2, 9)))
            inner = inner if tag == "ul" else f"<ul data-y=0>{inner}</ul>"
        elif kind == "comments":
            each = lambda: f'<div class="{r.choice(["comment", "reply", "c", "item"])}" data-y=0><p data-y=0>{self.words(r.choice([4, 15, 40, 70]))}</p></div>'
            inner = (f"<h3 data-y=0>{self.words(2)}</h3>" if r.random() < 0.6 else "") + "".join(each() for _ in range(r.randint(1, 6)))
            if r.random() < 0.3:
                inner = "".join(f"<p data-y=0>{self.words(r.choice([6, 20, 50]))}</p>" for _ in range(r.randint(1, 4)))
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name=q><button data-y=0>{self.words(1)}</button>" + (f"<p data-y=0>{self.words(9)}</p>" if r.random() < 0.4 else "")
        elif kind == "foot":
            inner = f"&copy; {self.words(r.choice([2, 6, 25]))}" + (f" {link(2)} {link(1)}" if r.random() < 0.5 else "") + (f"<p data-y=0>{self.words(r.choice([5, 30]))}</p>" if r.random() < 0.5 else "")
        elif kind == "head":
            inner = r.choice([self.words(2), f"<h1 data-y=0>{self.words(2)}</h1>", link(2)]) + (self.other("menu") if r.random() < 0.4 else "")
        else:
            inner = r.choice([self.words(r.choice([3, 12, 30, 60])), f"<p data-y=0>{self.words(r.choice([4, 15, 45]))}</p>", f"<h3 data-y=0>{self.words(2)}</h3><ul data-y=0>" + "".join(f"<li data-y=0>{link(4)}</li>" for _ in range(4)) + "</ul>"])
        return f"<{tag}{mark} data-y=0>{inner}</{tag}>"

    def page(self) -> str:
        r = self.rng
        pick = lambda kinds, p: "".join(self.other(k) for k in kinds if r.random() < p)
        if r.random() < 0.04:
            text = self.words(r.choice([3, 20, 90]))
            return r.choice([text, f"<body data-y=1>{text}</body>", f"<body data-y=1>{self.article()}</body>"])
        before = pick(["notice", "head", "menu", "ad", "form"], 0.5)
        after = pick(["share", "comments", "side", "ad", "form", "notice", "foot"], 0.5)
        self.plain = r.random() < 0.15
        inner = self.article()
        self.plain = False
        form = r.random()
        if form < 0.45:
            core = f"<article data-y=1>{inner}</article>"
        elif form < 0.6:
            core = f"<main data-y=1>{inner}</main>"
        elif form < 0.9:
            core = f'<div {r.choice(["class", "id"])}="{r.choice(CONTENT_NAMES)}{r.choice(NAME_ENDS)}" data-y=1>{inner}</div>'
        else:
            core = f"<div data-y=1>{inner}</div>"
        if r.random() < 0.25:
            core = core.replace("</article>", pick(["comments", "share", "ad", "form"], 0.5) + "</article>")
        if r.random() < 0.35:
            side = self.other("side") if r.random() < 0.5 else ""
            core = f'<{(t := r.choice(["main", "div", "section"]))} data-y=1>{core}{side}</{t}>'
        return f"<html data-y=1><head><title>{self.words(4)}</title></head><body data-y=1>{before}{core}{after}</body></html>"


def labelled_pages(count: int = 600, seed: int = 7) -> list[str]:
    """``count`` pages with their labels in ``data-y``."""
    writer = _Writer(random.Random(seed))
    return [writer.page() for _ in range(count)]
