"""Labelled pages to learn extraction from, made by rule from a seed.

Every page mixes ways in which sites mark up the same things, at random: where the article sits, what it
consists of, and the menus, headers, footers, sidebars, notices, adverts, forms and comments around and
inside it. ``data-main="1"`` marks the article and ``data-main="0"`` what in it is not the article's; a mark
holds for everything inside until another one. Words are random syllables, so that nothing is learnt from
the wording.
"""

from __future__ import annotations

import random

# --- fixed values: class words by which sites name parts of a page ------------------------------
NAMES = {
    "menu": "nav navbar navigation menu topnav submenu breadcrumb breadcrumbs toc pagination pager links",
    "header": "header masthead logo branding top banner topbar tagline",
    "footer": "footer foot colophon copyright legal bottom imprint",
    "side": "sidebar side aside widget rail related recommended popular trending tags teaser more",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall privacy message",
    "form": "form search login contact signin register poll",
    "comments": "comment comments reply replies respond discussion disqus reviews guestbook",
    "share": "share social sharing follow buttons print",
    "main": "article content post entry story body main text page news blog hentry",
}
# -------------------------------------------------------------------------------------------------
NAMES = {kind: words.split() for kind, words in NAMES.items()}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu zan mer tol rin ast".split()


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        return " ".join(
            self.words(1, 12).capitalize() + r.choice(["", ", " + self.words(1, 8)]) + r.choice([".", ".", ".", "?", "!"])
            for _ in range(r.randint(low, high))
        )

    def named(self, kind: str, odds: float = 0.8) -> str:
        """An attribute that names the part, a meaningless one, or none."""
        r = self.r
        if r.random() > odds:
            return r.choice(["", "", f' class="{self.words(1, 1)}"'])
        word = r.choice(NAMES[kind])
        word = r.choice([word, word, f"site-{word}", f"{word}-box", f"{word} {self.words(1, 1)}", f"main{word.capitalize()}", word.upper()])
        if kind == "menu" and r.random() < 0.1:
            return ' role="navigation"'
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def links(self, low: int, high: int) -> list[str]:
        return [f'<a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' for _ in range(self.r.randint(low, high))]

    def listed(self, items: list[str]) -> str:
        r = self.r
        close = r.choice(["</li>", "</li>", ""])
        return f"<ul>{''.join(f'<li>{i}{close}' for i in items)}</ul>" if r.random() < 0.7 else r.choice([" | ", " ", " &middot; "]).join(items)

    # Parts that are not the article's.
    def menu(self) -> str:
        tag, kind = self.r.choice([("nav", 0.4), ("nav", 0.4), ("div", 0.9), ("ul", 0.9), ("section", 1.0)])
        body = self.listed(self.links(2, 12))
        return f"<{tag}{self.named('menu', kind)}>{body}</{tag}>"

    def header(self) -> str:
        tag, odds = self.r.choice([("header", 0.4), ("div", 1.0)])
        name = self.r.choice(["h1", "h2", "p", "div"])
        body = f"<{name}>{self.words(1, 4)}</{name}>" + self.r.choice(["", f"<p>{self.sentences(1, 1)}</p>", self.menu()])
        return f"<{tag}{self.named('header', odds)}>{body}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag, odds = r.choice([("footer", 0.4), ("footer", 0.4), ("div", 1.0)])
        line = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f"Copyright {r.randint(1999, 2030)} {self.words(1, 4)}", self.sentences(1, 4)])
        body = r.choice([line, f"<p>{line}</p>", self.listed(self.links(2, 8)) + f"<p>{line}</p>"])
        return f"<{tag}{self.named('footer', odds)}>{body}</{tag}>"

    def box(self, kind: str) -> str:
        """A part of the kind, with sentences, links or a form in it."""
        r = self.r
        tag, odds = {
            "side": r.choice([("aside", 0.5), ("div", 1.0)]), "form": r.choice([("form", 0.3), ("div", 1.0)]),
        }.get(kind, (r.choice(["div", "div", "section", "p"]), 1.0))
        prose = self.sentences(1, r.choice([1, 2, 6]))
        form = f"<label>{self.words(1, 3)}</label><input type=text><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>"
        title = r.choice(["", "", f"<h3>{self.words(1, 4)}</h3>"]) if tag != "p" else ""
        body = {
            "side": r.choice([self.listed(self.links(2, 8)), f"<p>{prose}</p>", self.listed([self.sentences(1, 1) for _ in range(3)])]),
            "ad": r.choice([prose, prose, f"<p>{prose}</p>" if tag != "p" else prose, f'<a href="/">{prose}</a>']),
            "notice": prose + r.choice(["", f" <button>{self.words(1, 2)}</button>", f' <a href="/">{self.words(1, 2)}</a>']),
            "form": r.choice(["", f"<p>{prose}</p>", prose]) + form,
            "share": " ".join(self.links(2, 6)),
        }[kind]
        return f"<{tag}{self.named(kind, odds)}>{title}{body}</{tag}>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(["article", "div", "li", "li"])
        one = "".join(
            f"<{tag}{self.named('comments', 0.8)}>{r.choice(['', f'<h4>{self.words(1, 2)}</h4>', f'<b>{self.words(1, 2)}</b> '])}"
            f"{r.choice(['<p>{}</p>', '<div>{}</div>', '{}']).format(self.sentences(1, 6))}</{tag}>"
            for _ in range(r.randint(1, 5))
        )
        one = f"<ol>{one}</ol>" if tag == "li" else one
        outer = r.choice(["section", "div", "div"])
        return f"<{outer}{self.named('comments', 1.0)}><h3>{self.words(1, 3)}</h3>{one}{self.box('form') if r.random() < 0.3 else ''}</{outer}>"

    def other(self) -> str:
        kind = self.r.choice(["menu", "side", "ad", "notice", "form", "share", "ad"])
        return self.menu() if kind == "menu" else self.box(kind)

    # Parts of the article.
    def block(self) -> str:
        r = self.r
        rich = f'{self.sentences(1, 3)} <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a> {self.sentences(1, 3)}'
        kind = r.random()
        if kind < 0.6:
            text = r.choice([self.sentences(1, 1), self.sentences(1, 8), self.sentences(2, 16), rich, f"<b>{self.sentences(1, 3)}<br>", self.words(1, 6)])
            return f"<p{self.named('main', 0.05)}>{text}{r.choice(['</p>', '</p>', ''])}"
        return r.choice([
            f"<h2>{self.words(1, 8)}</h2>", f"<h3>{self.words(1, 6)}</h3>", f"<blockquote><p>{self.sentences(1, 4)}</p></blockquote>",
            "<ul>" + "".join(f"<li>{self.sentences(1, 2)}</li>" for _ in range(r.randint(1, 6))) + "</ul>",
            "<ol>" + "".join(f"<li>{self.words(1, 9)}" for _ in range(r.randint(1, 6))) + "</ol>",
            "<table>" + "".join(f"<tr><td>{self.words(1, 3)}<td>{r.randint(1, 999)}</tr>" for _ in range(r.randint(1, 5))) + "</table>",
            f"<pre><code>{self.words(3, 30)}</code></pre>", f"<figure><img src=x><figcaption>{self.sentences(1, 1)}</figcaption></figure>",
            f"<div>{self.sentences(1, 6)}</div>", f"{self.sentences(1, 4)}<br><br>", f"<dl><dt>{self.words(1, 3)}<dd>{self.sentences(1, 2)}</dl>",
            f"<section><h2>{self.words(1, 6)}</h2><p>{self.sentences(1, 6)}</p></section>", f"<div><p>{self.sentences(1, 5)}</p><p>{self.sentences(1, 5)}</p></div>",
        ])

    def article(self) -> str:
        r = self.r
        title = f"<h1>{self.words(1, 12)}</h1>"
        title = r.choice([title, title, "", f"<header>{title}</header>", f"<header>{title}<p>{self.sentences(1, 1)}</p></header>"])
        parts = [self.block() for _ in range(r.choice([1, 2, 4, 8, 16, 30]))]
        for _ in range(r.choice([0, 0, 1, 2])):
            odd = r.choice([self.other, self.other, self.comments])()
            parts.insert(r.randint(0, len(parts)), odd.replace(">", ' data-main="0">', 1))
        body = title + "".join(parts)
        open_, close = r.choice([
            ("<article{}>", "</article>"), ("<article{}>", "</article>"), ("<main{}>", "</main>"), ("<div{}>", "</div>"), ("<section{}>", "</section>"),
            ("<main><article{}>", "</article></main>"), ("<table><tr><td{}>", "</td></tr></table>"), ('<div role="main"{}>', "</div>"),
        ])
        odds = 0.9 if open_ in ("<div{}>", "<section{}>") else 0.4
        return open_.format(self.named("main", odds) + ' data-main="1"') + body + close

    def page(self) -> str:
        r = self.r
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(1, 8)}</title><style>p{{}}</style><script>var t="</p>";</script></head>'
        if r.random() < 0.06:  # nothing but an article, hardly marked up
            return r.choice(["", head]) + f'<body data-main="1">{"".join(self.block() for _ in range(r.randint(1, 8)))}'
        before = [f for f in (self.header, self.menu, self.other, self.other) if r.random() < 0.55]
        after = [f for f in (self.other, self.comments, self.other) if r.random() < 0.4] + [f for f in (self.footer,) if r.random() < 0.85]
        r.shuffle(before)
        body = "".join(f() for f in before) + "<!-- ad -->" + self.article() + "".join(f() for f in after)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<div{self.named('main', 0.4)}>{body}</div>"
        return head + "<body>" + body + r.choice(["</body></html>", ""])


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    return [Writer(seed * 1_000_003 + k).page() for k in range(count)]
