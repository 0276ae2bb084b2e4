"""Main-text extraction: gradient-boosted trees over DOM-node features, hierarchical decoding.

Every page becomes a tree of block elements and text runs (``html_tree``).  Each
node gets features: its tag, what the tokens of its class, id and role and those of
its ancestors say (weights learned from the training nodes, see ``TokenWeights``),
depth, text and link density of its subtree, likeness to the page's title, and
statistics of its siblings.  Gradient-boosted trees give the log odds that the node
holds main text.  The decoder then picks, by dynamic programming over the tree, the
most likely set of nodes among those without contradiction: under a node without main
text nothing has any, and a node with main text has a child with some.  The chosen
runs, in page order, are the text.

The trees are fitted here, on nodes of at most ``SAMPLE`` pages of any length, together
no longer than ``SAMPLE_CHARS`` (if each is longer, the shortest): pages whose markup
names their article (an ``article`` or ``main`` element) are the truth, as they are
and set anew in made-up page layouts, so that the model does not hang on a single tag
or name.  The layouts wrap the article in named, foreign, meaningless or no names, in
sections and tables, with its headline in a header or alone, with lists, tables, code,
quotes and figures, among menus, side bars, notices, adverts, forms and comments
around and inside it.  Without any such page the model is fitted on the layouts alone,
filled with invented words.

Defined results: null or empty html, or a page without main text, gives an empty
text; rows that repeat are extracted each for itself.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlens.llm.common import hash_sample, importable, written
from viewlens.llm.gradient_boosting import BoostedTrees
from viewlens.llm.html_tree import Node, parse

# Pages that the trees are fitted on, their characters in all, and layouts made of each.
SAMPLE, SAMPLE_CHARS, LAYOUTS = 150, 4_500_000, 8
TREES, DEPTH = 100, 5
# Ids drawn for each page of the sample; some pages are empty.
DRAWN = 8
SEED = 11
# Pages whose nodes the trees are applied to at a time.
PAGES = 100

TAGS = ("#text", "article", "main", "section", "div", "p", "h1", "h2", "li", "ul", "nav", "header", "footer", "aside",
        "form", "table", "td", "blockquote", "pre", "body", "figure", "label")
GROUPS = {"h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "ol": "ul", "dl": "ul", "dt": "li", "dd": "li", "menu": "nav",
          "tr": "table", "tbody": "table", "thead": "table", "th": "td", "fieldset": "form", "select": "form",
          "dialog": "aside", "figcaption": "figure", "#page": "body", "html": "body", "button": "label", "option": "label",
          "legend": "label", "caption": "figure", "details": "section", "summary": "h2"}
CONTAINERS = ("article", "main", "nav", "header", "footer", "aside", "form")


class TokenWeights:
    """Log odds that a node whose class, id or role has a token holds main text, learned from labelled nodes.

    A token that was not met takes what is known of its first letters, ``PREFIX`` and
    three fifths of them at least; one of which nothing is known weighs nothing.
    """

    PREFIX, SHARE, PRIOR = 4, 0.6, 2.0

    def __init__(self, pages: list[list[Node]] = (), truth: list[np.ndarray] = ()):
        seen: dict[str, list[float]] = {}
        total = [1.0, 1.0]
        for nodes, y in zip(pages, truth):
            for x, holds in zip(nodes, y.tolist()):
                total[int(holds)] += 1
                for token in set(x.tokens):
                    for k in range(min(self.PREFIX, len(token)), len(token) + 1):
                        seen.setdefault(token[:k], [0.0, 0.0])[int(holds)] += 1
        rate = total[1] / sum(total)
        self.weight = {t: math.log((main + self.PRIOR * rate) / (other + self.PRIOR * (1 - rate))) - math.log(rate / (1 - rate))
                       for t, (other, main) in seen.items()}

    def of(self, token: str) -> float:
        for k in range(len(token), max(min(self.PREFIX, len(token)), math.ceil(self.SHARE * len(token))) - 1, -1):
            if (w := self.weight.get(token[:k])) is not None:
                return w
        return 0.0


def features(nodes: list[Node], weights: TokenWeights) -> np.ndarray:
    """One row per node."""
    n = len(nodes)
    chars, links, runs, marks, longest = ([0] * n for _ in range(5))
    before = [0] * n  # characters of the page before the node
    title = nodes[0].text.lower()
    total = 0
    for i, x in enumerate(nodes):
        before[i] = total
        if x.tag == "#text":
            chars[i] = longest[i] = len(x.text)
            links[i], runs[i] = x.link_chars, 1
            marks[i] = x.text.count(".") + x.text.count(",")
            total += len(x.text)
    size = [1] * n
    for i in range(n - 1, 0, -1):
        p = nodes[i].parent
        chars[p] += chars[i]
        links[p] += links[i]
        runs[p] += runs[i]
        marks[p] += marks[i]
        size[p] += size[i]
        longest[p] = max(longest[p], longest[i])
    # where the page's longest runs lie: headlines come before them, comments after
    most = max(longest[0], 1)
    long = [i for i, x in enumerate(nodes) if x.tag == "#text" and 2 * longest[i] >= most] or [0]
    inside = [(0,) * len(CONTAINERS)] * n
    # what a node's names say, and the least and the greatest of what its ancestors' do
    own = [0.0 if x.tag in ("html", "body") else max(map(weights.of, x.tokens), key=abs, default=0.0) for x in nodes]
    said = [(0.0, 0.0)] * n
    kinds = [(x.tag, x.tokens) for x in nodes]
    place: dict[int, tuple[list, dict]] = {}
    out = []
    for i, x in enumerate(nodes):
        tag = GROUPS.get(x.tag, x.tag)
        above = inside[x.parent] if i else inside[0]
        inside[i] = tuple(a or tag == c for a, c in zip(above, CONTAINERS)) if tag in CONTAINERS else above
        up = said[x.parent] if i else (0.0, 0.0)
        said[i] = (min(up[0], own[i]), max(up[1], own[i]))
        parent = x.parent if i else 0
        family = nodes[parent].children if i else [0]
        if parent not in place:
            alike: dict = {}
            for c in family:
                alike[kinds[c]] = alike.get(kinds[c], 0) + 1
            place[parent] = (family, alike)
        k = bisect_left(family, i)
        left = family[k - 1] if k else -1
        right = family[k + 1] if k + 1 < len(family) else -1
        holder = nodes[i].parent if x.tag == "#text" and i else i  # the element that a run stands in
        titled = 0.0
        if title and 0 < chars[i] <= 300:
            text = (x.text if x.tag == "#text" else "".join(nodes[c].text for c in x.children)).lower()
            if text:
                titled = (2.0 if text == title else 1.0 if len(text) > 2 and (text in title or title in text) else 0.0)
        out.append((
            TAGS.index(tag) if tag in TAGS else len(TAGS), *inside[i], own[i], *up, own[left] if left >= 0 else 0.0,
            own[right] if right >= 0 else 0.0, kinds[left] == kinds[i], kinds[right] == kinds[i], x.depth,
            math.log1p(chars[i]), links[i] / (chars[i] + 1), chars[i] / size[i], marks[i] / (chars[i] + 1),
            chars[i] / (total + 1), chars[i] / (chars[parent] + 1), math.log1p(chars[parent]),
            links[parent] / (chars[parent] + 1), runs[i], before[i] / (total + 1), len(family), k / len(family),
            math.log1p(chars[left] if left >= 0 else 0), math.log1p(chars[right] if right >= 0 else 0), longest[i] / most, longest[parent] / most,
            float(i < long[0]), float(i > long[-1]), place[parent][1].get(kinds[i], 1) / len(family),
            marks[parent] / (chars[parent] + 1), chars[parent] / size[parent], titled,
            _place(nodes, parent), _place(nodes, nodes[parent].parent if parent else 0), _place(nodes, holder)))
    x = np.array(out, np.float64)
    hot = x[:, :1] == np.arange(len(TAGS) + 1)  # one column per tag; those of its ancestors stay numbers
    return np.hstack([hot, x[:, 1:]])


def _place(nodes: list[Node], i: int) -> int:
    tag = GROUPS.get(nodes[i].tag, nodes[i].tag)
    return TAGS.index(tag) if tag in TAGS else len(TAGS)


def decode(nodes: list[Node], odds: np.ndarray) -> list[int]:
    """The text runs of the most likely choice without contradictions."""
    yes = np.minimum(odds, 0) - np.log1p(np.exp(-np.abs(odds)))  # log p and log (1 - p)
    no = (yes - odds).tolist()
    yes = yes.tolist()
    without = no[:]                # best total of the subtree if the node holds no main text
    for i in range(len(nodes) - 1, 0, -1):
        without[nodes[i].parent] += without[i]
    with_text = [0.0] * len(nodes)  # best total if it does
    gain = [-math.inf] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.tag == "#text":
            with_text[i] = yes[i]
        elif x.children:
            gains = [gain[c] for c in x.children]
            most = max(gains)
            base = sum([without[c] for c in x.children])
            # all children that gain; if none does, the one that loses least
            with_text[i] = yes[i] + base + (sum([g for g in gains if g > 0]) if most > 0 else most)
        else:
            with_text[i] = -math.inf
        gain[i] = with_text[i] - without[i]
    chosen, todo = [], [0] if gain[0] > 0 else []
    while todo:
        i = todo.pop()
        x = nodes[i]
        if x.tag == "#text":
            chosen.append(i)
        elif x.children:
            best = max(x.children, key=gain.__getitem__)
            todo += [c for c in x.children if gain[c] > 0 or c == best]
    return sorted(chosen)


@dataclass
class Model:
    """What is fitted: what names say, and the trees."""
    weights: TokenWeights
    trees: BoostedTrees

    def log_odds(self, pages: list[list[Node]]) -> np.ndarray:
        return self.trees.log_odds(np.concatenate([features(nodes, self.weights) for nodes in pages]))


def extract(sources: list[str | None], model: Model) -> list[str]:
    """The main texts of some pages."""
    pages = [parse(s or "") for s in sources]
    odds = model.log_odds(pages) if pages else []
    out, at = [], 0
    for nodes in pages:
        chosen = decode(nodes, odds[at:at + len(nodes)])
        out.append("\n".join([nodes[i].text for i in chosen]))
        at += len(nodes)
    return out


# ------------------------------------------------------------------ training pages
def named_article(nodes: list[Node]) -> list[int]:
    """Runs inside the page's article or main element that no furniture element inside it holds.

    Of a header inside the article its headings count.
    """
    state = ["out"] * len(nodes)
    for i, x in enumerate(nodes[1:], 1):
        s = state[x.parent]
        if s == "in" and x.tag in ("nav", "aside", "footer", "form"):
            s = "cut"
        elif s == "in" and x.tag == "header":
            s = "head"
        elif s == "head" and x.tag in ("h1", "h2", "h3"):
            s = "in"
        elif s == "out" and x.tag in ("article", "main"):
            s = "in"
        state[i] = s
    return [i for i, x in enumerate(nodes) if x.tag == "#text" and state[i] == "in"]


def _holders(nodes: list[Node], runs: list[int]) -> np.ndarray:
    """1 for nodes whose subtree holds one of the runs."""
    y = np.zeros(len(nodes))
    for i in runs:
        while i >= 0 and not y[i]:
            y[i] = 1
            i = nodes[i].parent
    return y


SECRET = "\ue000"  # marks main text in made-up pages; taken out before features are computed

# Names that page authors give to parts of a page, in some languages; the made-up pages use them.
NAMES = {
    "main": "article content post entry story text body main prose inhalt artikel beitrag contenu corps contenido cuerpo "
            "articolo testo conteudo inhoud artykul post-body entry-content article-text article__body page-content",
    "menu": "menu nav navigation navbar breadcrumb breadcrumbs pagination topbar menue hauptmenue menu-principal toolbar "
            "share social tags masthead links kategorien rubriques categorias",
    "advert": "ad ads advert advertisement ad-banner sponsored sponsor promo promotion werbung anzeige publicite "
              "publicidad anuncio reklame adsense banner-ad teaser",
    "notice": "cookie cookies notice consent gdpr privacy alert newsletter popup overlay modal banner hinweis avis aviso "
              "toast paywall subscribe signup",
    "side": "sidebar side aside widget related recommended popular trending more rail seitenleiste verwandt weitere "
            "lateral similaires relacionados meistgelesen",
    "comments": "comments comment-list comment responses replies discussion disqus feedback reviews reactions kommentare "
                "kommentarer commentaires comentarios commenti reacties leserkommentare opinions guestbook",
    "foot": "footer foot site-footer copyright legal imprint impressum fusszeile pied-de-page pie colophon credits",
    "head": "header head site-header top masthead logo brand kopf kopfzeile entete cabecera",
}
NAMES = {k: v.split() for k, v in NAMES.items()}


# How pages are named: tellingly, partly, without meaning, or not at all.
STYLES = ("named", "named", "named", "mixed", "meaningless", "none")


class Layouts:
    """Made-up pages around given paragraphs, whose main runs are known."""

    def __init__(self, rng: random.Random, phrases: list[str], styles: tuple[str, ...] = ("named",)):
        self.rng, self.styles = rng, styles
        self.phrases = phrases or ["Lorem ipsum dolor sit amet, consectetur.", "Sed do eiusmod tempor."]
        self.style = styles[0]

    def words(self, least: int, most: int) -> str:
        text = " ".join(self.rng.choice(self.phrases) for _ in range(3)).replace("<", " ").replace("&", " ").split()
        n = self.rng.randint(least, most)
        start = self.rng.randrange(max(1, len(text) - n))
        return " ".join(text[start:start + n]) or "more"

    def name(self, kind: str) -> str:
        """An attribute: a telling name, a meaningless one or none, as the page's author likes it."""
        rng = self.rng
        style = rng.choice(["named", "none"]) if self.style == "mixed" else self.style
        if style == "none":
            return ""
        telling = rng.choice(NAMES[kind])
        other = "".join(rng.choice("bcdfghjkmnpqrstvwxz") + rng.choice("aeiouy") for _ in range(rng.randint(2, 4)))
        value = other if style == "meaningless" else rng.choice([telling, telling, f"{other} {telling}", f"{telling}-{other}"])
        return f' {rng.choice(["class", "class", "id"])}="{value}"'

    def named(self, kind: str, *tags: str) -> tuple[str, str]:
        tag = self.rng.choice(tags)
        return f"<{tag}{self.name(kind)}>", f"</{tag}>"

    def items(self, least: int, most: int, one) -> str:
        return "".join(one() for _ in range(self.rng.randint(least, most)))

    def menu(self) -> str:
        start, end = self.named("menu", "nav", "nav", "div", "header", "ul")
        link = lambda: f'<a href="/x">{self.words(1, 3)}</a>'
        most = self.rng.choice([6, 6, 9, 40])
        if "<ul" in start:
            return start + self.items(2, most, lambda: f"<li>{link()}</li>") + end
        between = self.rng.choice([" | ", " ", " &gt; ", ""])
        return start + self.rng.choice([
            "<ul>" + self.items(2, most, lambda: f"<li>{link()}</li>") + "</ul>", self.items(2, most, lambda: link() + between),
            self.items(2, most, lambda: f"<div>{link()}</div>")]) + end

    def advert(self) -> str:
        start, end = self.named("advert", "div", "aside", "section")
        if 'class="' not in start and 'id="' not in start:  # without a name an advert is known by its links
            return f'<aside{start[4:] if start.startswith("<div") else ">"}<a href="/buy">{self.words(2, 12)}</a></aside>'
        return start + self.rng.choice(["", "<p>"]) + self.words(3, 40) + end

    def notice(self) -> str:
        start, end = self.named("notice", "div", "div", "section", "aside")
        return start + f"<p>{self.words(5, 40)}</p><button>{self.words(1, 2)}</button>" + end

    def side(self) -> str:
        start, end = self.named("side", "aside", "aside", "div")
        items = self.items(1, 5, lambda: self.rng.choice([f'<li><a href="/y">{self.words(2, 8)}</a></li>',
                                                          f"<li>{self.words(2, 8)}</li>"]))
        text = f"<p>{self.words(2, 6)}: {self.words(2, 20)}</p>" if start.startswith("<aside") else f"<ul>{items}</ul>"
        return (start + self.rng.choice(["", f"<h3>{self.words(1, 4)}</h3>"])
                + self.rng.choice([f"<ul>{items}</ul>", text]) + end)

    def form(self) -> str:
        return (self.rng.choice(["<form>", '<form action="/s">', '<form class="search">']) +
                f"<label>{self.words(1, 4)}</label><input><p>{self.words(2, 12)}</p><button>Go</button></form>")

    def comments(self) -> str:
        """Some remarks of the same form, each by someone, mostly under a heading."""
        rng = self.rng
        start, end = self.named("comments", "div", "section", "div", "ol", "ul")
        own = self.name("comments")
        tag = "li" if start[1:3] in ("ol", "ul") else rng.choice(["div", "article", "section"])
        by = rng.choice(["<b>{}</b>", "<span>{}</span>", "<strong>{}:</strong>", "<div>{}</div>", "<p>{}</p>", "<h4>{}</h4>"])
        if rng.random() < 0.25 and self.style == "named":
            own, by = "", ""
        one = lambda: f"<{tag}{own}>{by.format(self.words(1, 3))}<p>{self.words(3, 45)}</p></{tag}>"
        if self.style == "named" and "=" in start and rng.random() < 0.3:
            one = lambda: f"<p>{self.words(3, 45)}</p>"
        heading = rng.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)} ({rng.randint(1, 99)})</h2>"])
        items = self.items(1 if "=" in start else 2, 5, one)
        if tag == "li":
            around = self.name("comments")
            return f"<section{around}>{heading}{start}{items}{end}</section>" if "=" in around else start + items + end
        return start + heading + items + end

    def foot(self) -> str:
        start, end = self.named("foot", "footer", "footer", "footer", "div")
        return start + self.rng.choice(["&copy; ", "<p>&copy; ", "&copy; 2020 "]) + self.words(1, 25) + end

    def head(self) -> str:
        start, end = self.named("head", "header", "header", "div")
        return start + self.rng.choice(["<h1>", "<p>", "<div>", '<a href="/">', '<h2><a href="/">']) + self.words(1, 4) + end

    def some(self, *makers) -> str:
        return "".join(m() for m in makers if self.rng.random() < 0.4)

    def blocks(self, texts: list[str]) -> list[str]:
        """The article's blocks: paragraphs, and now and then another kind that takes several texts."""
        rng, out, k = self.rng, [], 0
        mark = lambda t, tag: f"<{tag}>{SECRET}{t}</{tag}>"
        paragraph = rng.choice(["p", "p", "p", "p", "div"])
        while k < len(texts):
            kind = rng.choices(["p", "h2", "list", "quote", "table", "pre", "figure", "dl"], [24, 2, 2, 1, 1, 1, 1, 1])[0]
            own, k = texts[k], k + 1
            if kind == "h2":
                out.append(mark(self.words(1, 7), rng.choice(["h2", "h3"])))
                out.append(mark(own, paragraph))
            elif kind == "list":
                tag = rng.choice(["ul", "ol"])
                out.append(f"<{tag}>" + self.items(2, 6, lambda: mark(self.words(1, 18), "li")) + mark(own, "li") + f"</{tag}>")
            elif kind == "quote":
                out.append(f"<blockquote>{rng.choice([mark(own, 'p'), SECRET + own])}</blockquote>")
            elif kind == "table":
                width = rng.randint(2, 3)
                row = lambda tag: "<tr>" + "".join(mark(self.words(1, 4), tag) for _ in range(width)) + "</tr>"
                out.append("<table>" + rng.choice(["", row("th")]) + self.items(1, 4, lambda: row("td")) + "</table>")
                out.append(mark(own, paragraph))
            elif kind == "pre":
                code = self.words(3, 25)
                out.append(f"<pre>{rng.choice([SECRET + code, '<code>' + SECRET + code + '</code>'])}</pre>")
                out.append(mark(own, paragraph))
            elif kind == "figure":
                out.append(f'<figure><img src="i.png">{mark(self.words(2, 14), "figcaption")}</figure>' + mark(own, paragraph))
            elif kind == "dl":
                out.append("<dl>" + self.items(1, 3, lambda: mark(self.words(1, 3), "dt") + mark(self.words(3, 15), "dd"))
                           + "</dl>" + mark(own, paragraph))
            else:
                out.append(mark(own, paragraph))
        return out

    def page(self, texts: list[str]) -> str:
        """A page around the given texts; without any, one of menus, side bars and the like alone."""
        rng = self.rng
        self.style = rng.choice(self.styles)
        if not texts:
            parts = "".join(rng.choice([self.menu, self.menu, self.side, self.advert, self.form, self.notice])()
                            for _ in range(rng.randint(1, 5)))
            return (f"<html><head><title>{self.words(1, 4)}</title></head><body>" + self.some(self.notice, self.head)
                    + self.menu() + parts + rng.choice([self.foot(), ""]) + "</body></html>")
        if len(texts[0]) < 120 and rng.random() < 0.7:
            headline, texts = texts[0], texts[1:] or [self.words(20, 60)]
        else:
            headline = self.words(1, 9) if rng.random() < 0.75 else ""
        title = rng.choice([headline, headline, f"{headline} - {self.words(1, 3)}", self.words(1, 6)]) or "x"
        body = self.blocks(texts)
        if headline:
            one = f"<{(tag := rng.choice(['h1', 'h1', 'h1', 'h2']))}>{SECRET}{headline}</{tag}>"
            body.insert(0, rng.choice([one, one, f"<header>{one}</header>", f"<div{self.name('head')}>{one}</div>"]))
        for k in range(len(body) - 1, 0, -1):
            if rng.random() < 0.1:
                aside = lambda: f"<aside><p>{self.words(2, 20)}</p></aside>"
                kinds = [self.advert, self.side, self.form, self.notice] if self.style == "named" else [aside, self.form]
                body.insert(k, rng.choice(kinds)())
        inside = self.some(self.comments, self.foot) if rng.random() < 0.3 and self.style == "named" else ""
        text = "".join(body)
        wrap = rng.choice(["article", "article", "main", "both", "div", "div", "deep", "section", "bare", "table"])
        name = self.name("main")
        article = {
            "article": f"<article{name}>{text}{inside}</article>", "main": f"<main{name}>{text}{inside}</main>",
            "both": f"<main><article{name}>{text}{inside}</article></main>", "div": f"<div{name}>{text}{inside}</div>",
            "deep": f"<div{self.name('main')}><div><div{name}>{text}</div>{inside}</div></div>",
            "section": f"<section{name}>{text}{inside}</section>", "bare": text + inside,
            "table": f"<table><tr><td>{self.menu()}</td><td{name}>{text}</td>"
                     + rng.choice(["", f"<td>{self.side()}</td>"]) + "</tr></table>"}[wrap]
        around = [self.some(self.advert, self.side), article,
                  self.some(self.side, self.comments, self.form, self.advert, self.menu)]
        middle = "".join(around)
        if rng.random() < 0.4:
            middle = f"<div{self.name('main') if rng.random() < 0.3 else ''}>{middle}</div>"
        return (f"<html><head><title>{title}</title></head><body>" + self.some(self.notice, self.head)
                + rng.choice([self.menu(), self.menu(), ""]) + middle + rng.choice([self.foot(), self.foot(), ""])
                + "</body></html>")


def fit(sources: list[str]) -> Model:
    """What names say and the trees, from the given pages and layouts made of their articles."""
    rng = random.Random(SEED)
    pages, truth, articles = [], [], []
    for source in sources:
        nodes = parse(source)
        runs = named_article(nodes)
        if runs:
            pages.append(nodes)
            truth.append(_holders(nodes, runs))
            articles.append([nodes[i].text for i in runs])
    phrases = [t for a in articles for t in a] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
                                                   "Sed do eiusmod tempor incididunt ut labore et dolore magna."]
    layouts = Layouts(rng, phrases, STYLES)
    made = [layouts.page([]) for _ in range(max(10, len(articles) // 3))]
    for blocks in articles or [[layouts.words(3, 60) for _ in range(5)] for _ in range(SAMPLE)]:
        for _ in range(LAYOUTS):
            some = blocks if rng.random() < 0.5 else rng.sample(phrases, min(len(phrases), rng.randint(1, 8)))
            clean = [b.replace("&", " ").replace("<", " ").replace(">", " ").strip() or "text" for b in some]
            made.append(layouts.page(clean))
    rng.shuffle(made)
    for source in made:
        nodes = parse(source)
        runs = [i for i, x in enumerate(nodes) if x.tag == "#text" and SECRET in x.text]
        for x in nodes:
            x.text = x.text.replace(SECRET, "")
        pages.append(nodes)
        truth.append(_holders(nodes, runs))
    # a page's names are weighed by the other half of the pages, else the trees would trust them too much
    halves = [TokenWeights(pages[k::2], truth[k::2]) for k in (1, 0)]
    rows = [features(nodes, halves[k % 2]) for k, nodes in enumerate(pages)]
    return Model(TokenWeights(pages, truth), BoostedTrees(trees=TREES, depth=DEPTH, rate=0.2, columns=0.5).fit(
        np.concatenate(rows), np.concatenate(truth)))


def training_pages(rows: DataFrame) -> list[str]:
    """The pages that the trees are fitted on: those with the least id hashes, as far as they fit.

    Ids are drawn without reading the pages, more than are needed because pages may be
    empty; the pages of these are then read once.  Of rows that repeat an id the
    shortest page counts.
    """
    ids = rows.select("page_id").distinct()
    # a bounded number of ids, so they may be broadcast
    drawn = F.broadcast(hash_sample(ids, "page_id", DRAWN * SAMPLE).toDF("of_page"))
    html = F.struct(F.length("html").alias("chars"), "html")
    found = written(rows.join(drawn, F.col("page_id").eqNullSafe(F.col("of_page"))).where(F.length("html") > 0)
                    .groupBy("page_id").agg(F.min(html).alias("page"))
                    .select(F.xxhash64("page_id").alias("place"), "page_id", "page.chars", "page.html"), "training-pages")
    chosen, left = [], SAMPLE_CHARS
    sizes = found.select("place", "page_id", "chars").orderBy("place", "page_id").limit(SAMPLE).collect()
    for _, page_id, chars in sizes:
        if chars <= left:
            chosen.append(page_id)
            left -= chars
    if sizes and not chosen:
        chosen = [min(sizes, key=lambda x: x.chars).page_id]
    mine = F.col("page_id").isin([c for c in chosen if c is not None])
    mine = mine | F.col("page_id").isNull() if None in chosen else mine
    return [r.html for r in found.where(mine).orderBy("place", "page_id").select("html").collect()]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    importable(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    model = fit(training_pages(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            html = b["html"].tolist()
            text = [t for k in range(0, len(html), PAGES) for t in extract(html[k:k + PAGES], model)]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
