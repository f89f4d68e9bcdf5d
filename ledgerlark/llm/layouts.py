"""Labelled pages in layouts drawn at random: texts of an article among menus, headers, notices, adverts, forms, sidebars, comments and footers.

Texts of the article begin with MARK, all others don't."""

from __future__ import annotations

import html
import random

MARK = ""
#: Sentences for tables without any prose.
PROSE = (
    "The river rose in the night, and by morning the lower road was under water.",
    "Nobody in the village had seen such a summer, though the old ones spoke of another.",
    "She kept the letters in a tin box, tied with a ribbon that had once been blue.",
    "Costs fell by a third over the decade, largely because the work moved closer to the mines.",
)
# How pages name their parts: tag, and words of which one or two become its class or id.
NAMES = {
    "article": (["article", "main", "div", "section"], ["article", "content", "post", "entry", "story", "main", "body", "text"]),
    "header": (["header", "div"], ["header", "masthead", "top", "banner", "site", "branding"]),
    "nav": (["nav", "div", "ul"], ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "links", "topbar"]),
    "aside": (["aside", "div"], ["sidebar", "widget", "related", "aside", "rail", "trending", "popular", "recommended", "more"]),
    "ad": (["div", "aside", "section"], ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "banner"]),
    "notice": (["div", "section", "aside"], ["notice", "cookie", "consent", "alert", "gdpr", "banner", "popup", "modal", "message", "overlay"]),
    "form": (["form", "div"], ["form", "newsletter", "subscribe", "search", "signup", "login", "register", "contact"]),
    "comments": (["section", "div", "ol"], ["comments", "comment", "discussion", "replies", "reply", "responses", "respond", "thread", "disqus"]),
    "footer": (["footer", "div"], ["footer", "bottom", "copyright", "legal", "colophon", "site"]),
    "share": (["div", "ul"], ["share", "social", "tags", "meta", "tools", "buttons"]),
}
WORDS = "Home About News World Sport Contact Archive Shop Help Blog Team Events Media Careers Search Login Terms Privacy".split()


class Page:
    """Builds one page; all draws come from rng."""

    def __init__(self, texts: list[str], rng: random.Random):
        self.texts, self.rng = texts, rng
        self.named = rng.random()  # some sites name everything, others hardly anything

    def words(self, lo: int, hi: int) -> str:
        """A stretch of some text, words as they are."""
        all_ = self.rng.choice(self.texts).split()
        n = self.rng.randint(lo, hi)
        at = self.rng.randrange(max(1, len(all_) - n))
        return html.escape(" ".join(all_[at : at + n]), quote=False)

    def element(self, kind: str, inside: str, plain: bool = False) -> str:
        """`inside` in an element of the kind. Its tag or its names tell the kind, unless it is plain."""
        r = self.rng
        tags, words = NAMES[kind]
        tag = "div" if plain else r.choice(tags)
        telling = tag in ("nav", "header", "footer", "aside", "form", "article", "main")
        picked = r.sample(words, r.choice((1, 1, 2))) if not plain and (not telling or self.named > 0.4) else []
        name = "" if not picked else f' {r.choice(("class", "class", "id"))}="{r.choice((" ", "-", "_")).join(picked)}"'
        if not picked and r.random() < 0.3:
            name = f' class="{r.choice(("row", "col", "wrap", "inner", "box", "c1"))}"'
        return f"<{tag}{name}>{inside}</{tag}>"

    def menu(self, lo: int = 3, hi: int = 9) -> str:
        r = self.rng
        items = [f'<a href="/{k}">{r.choice((r.choice(WORDS), self.words(1, 3)))}</a>' for k in range(r.randint(lo, hi))]
        style = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if style < 0.6 else r.choice((" | ", " ", " · ")).join(items) if style < 0.8 else "".join(f"<div>{x}</div>" for x in items)

    def prose(self) -> str:
        """Blocks of the article."""
        r, out = self.rng, []
        cuts = r.choice((0, 0.1, 0.3))
        for _ in range(r.choice((1, 2, 4, 6, 9, 14))):
            text = MARK + (html.escape(r.choice(self.texts), quote=False) if r.random() < 0.5 else self.words(1, 60) + r.choice((".", ".", "!", "?", ":", "")))
            kind = r.random()
            if kind < 0.72:
                out.append(f"<p>{text}</p>")
            elif kind < 0.78:
                out.append(f"<p><b>{text}<br>{MARK}{self.words(3, 30)}.<p>")
            elif kind < 0.83:
                out.append(f"<{r.choice(('h2', 'h3', 'h4'))}>{MARK}{self.words(1, 7)}</h2>")
            elif kind < 0.88:
                out.append("<ul>" + "".join(f"<li>{MARK}{self.words(1, 14)}" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}<td>{MARK}{r.randint(0, 9999)}" for _ in range(r.randint(2, 4))) + "</table>")
            else:
                out.append(f'<p>{MARK}{self.words(2, 12)} <a href="/x">{self.words(1, 4)}</a> {self.words(2, 25)}.</p>')
            if r.random() < cuts:
                out.append(self.box(r.choice(("ad", "ad", "ad", "aside", "form", "share"))))
        return "".join(out)

    def heading(self, text: str) -> str:
        tag = self.rng.choice(("h2", "h3", "h4", "p", "div"))
        return f"<{tag}>{text}</{tag}>"

    def box(self, kind: str) -> str:
        """A part that is no article."""
        r = self.rng
        if kind == "nav":
            inside = self.menu()
        elif kind == "header":
            inside = f"<{r.choice(('h1', 'p', 'div', 'span'))}>{self.words(1, 5)}</h1>" + (self.menu(2, 5) if r.random() < 0.5 else f"<p>{self.words(2, 12)}</p>")
        elif kind == "form":
            inside = f"<label>{self.words(1, 5)}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(0, 4)}</textarea><button>{self.words(1, 3)}</button><p>{self.words(3, 25)}.</p>"
        elif kind == "comments":
            inside = self.heading(f"{r.choice(('', r.randint(1, 99)))} {self.words(1, 2)}") + "".join(r.choice(("<div class=comment><b>{}</b><p>{}.</p></div>", "<p>{}: {}</p>", "<li><cite>{}</cite> <p>{}!</p>")).format(self.words(1, 2), self.words(3, 60)) for _ in range(r.randint(1, 6)))
        elif kind == "footer":
            inside = r.choice(("&copy; {} {}", "&copy; {} &middot; {}.", "<p>{}</p><p>{}</p>", "<ul><li>{}</li><li>{}</li></ul>")).format(self.words(1, 4), self.words(2, 25)) + (self.menu(2, 5) if r.random() < 0.4 else "")
        elif kind == "aside":
            inside = self.heading(self.words(1, 4)) + (self.menu() if r.random() < 0.6 else "".join(f"<p>{self.words(3, 30)}.</p>" for _ in range(r.randint(1, 3))))
        elif kind == "share":
            inside = self.menu(2, 5)
        else:
            text = self.words(2, 40) + r.choice((".", "", "!"))
            inside = r.choice((text, f"<p>{text}</p>", f'<a href="/out">{text}</a>', f"<p>{text}</p><button>{self.words(1, 2)}</button>"))
        return self.element(kind, inside)

    def build(self) -> str:
        r = self.rng
        much = r.choice((0, 0.3, 0.5, 0.7))
        before = [k for k in ("notice", "header", "nav", "ad", "form", "aside", "nav") if r.random() < much]
        after = [k for k in ("share", "ad", "comments", "aside", "form", "notice", "footer") if r.random() < much]
        title = self.words(2, 10)
        head = f"<{r.choice(('h1', 'h1', 'h2'))}>{MARK}{title}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.2:
            head = f"<header>{head}</header>"
        inner = [k for k in after if k in ("comments", "share", "ad", "form") and r.random() < 0.3]
        prose = self.prose() if r.random() > 0.08 else r.choice(("{}", "<p>{}</p>", "<div>{}</div>")).format(MARK + self.words(1, 6))
        main = head + prose + "".join(map(self.box, inner))
        if self.named > 0.06:
            main = self.element("article", main, plain=self.named < 0.12)
        body = "".join(map(self.box, before)) + main + "".join(self.box(k) for k in after if k not in inner)
        if r.random() < 0.3:
            body = f'<div id="{r.choice(("page", "wrapper", "container", "root"))}">{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style></head><body>{body}" + r.choice(("</body></html>", ""))


def page(texts: list[str], seed: int) -> str:
    return Page(texts, random.Random(seed)).build()
