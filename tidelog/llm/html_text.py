"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is flattened into blocks at block-level tags; inline tags don't break a block. End tags that HTML implies are
understood, and reading is linear in the page. A block's features are its own word count and link density and those of its
neighbours, and what its place in the page says: inside an article, inside a menu, advert, form, notice or the like, a
heading, a list item. The tree is trained on a small table of labelled blocks, of pages that are made by rule.
"""

from __future__ import annotations

import html as charrefs
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.tables import pick
from tidelog.llm.words import slices

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)
      | <[!?/a-z][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
#: Elements that are left out with all they hold. Without an end tag, scripts and styles go on to the page's end; of the
#: others just the tag is left out.
_RAW = frozenset("script style noscript template svg title iframe canvas".split())
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd map mark object picture q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr math annotation annotation-xml maction menclose merror mfenced mfrac mi
    mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext
    mtr munder munderover none semantics""".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of MathML that close themselves.
_FOREIGN = frozenset("math mi mn mo mprescripts mspace mtext none".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed values of HTML: what ends an open paragraph; which elements end one of their group, up to which others.
_ENDS_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    header hgroup hr li dd dt main menu nav ol p pre search section summary table ul""".split()
)
_GROUP = {"p": "p", "li": "li", "dd": "dd", "dt": "dd", "td": "td", "th": "td", "tr": "tr", "option": "option", "thead": "tbody", "tbody": "tbody", "tfoot": "tbody"}
_WITHIN = {"button": "p", "td": "p", "th": "p", "caption": "p", "ul": "li", "ol": "li", "menu": "li", "dl": "dd", "select": "option", "datalist": "option", "table": "p li dd td tr tbody", "tr": "td", "object": "p"}
_ASIDE_TAGS = frozenset("nav footer aside form button select option textarea label dialog menu fieldset legend datalist".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
_AD_WORDS = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored adsense".split())
_ASIDE_WORDS = _AD_WORDS | frozenset(
    """promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer comment comments commentlist
    disqus reply replies respond share sharing social cookie cookies consent gdpr notice notices alert warning popup modal
    overlay newsletter subscribe subscription signup related recommended recommendations trending widget widgets pagination
    pager toolbar disclaimer skip masthead topbar teaser""".split()
)
_ARTICLE_WORDS = frozenset("article articlebody story post entry".split())
#: A class with one of these words speaks of what the element goes with, not of what it is.
_ABOUT = frozenset("has with without no not free above below after before".split())
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "aside", "heading", "item", "page_article")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    aside: bool
    heading: bool
    item: bool


@dataclass(slots=True)
class _Open:
    """An open element and what is known of the text in it. inline: it doesn't break a block."""

    name: str
    article: bool = False
    aside: bool = False
    heading: bool = False
    item: bool = False
    inline: bool = False
    base: int = 0  # place of the nearest element that isn't inline


class _Page:
    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.stack = [_Open("")]
        self.named: dict[str, list[int]] = {}  # places of the open elements of a name
        self.grouped: dict[str, list[int]] = {}  # places of a group's open elements; 0 hides those before
        self.parts: list[str] = []
        self.linked = 0
        self.anchor = 0  # place of the element that holds the open anchor, plus 1

    def close_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, text.count(" ") + 1, self.linked, top.article, top.aside, top.heading, top.item))
        self.parts.clear()
        self.linked = 0

    def open(self, name: str, attrs: str) -> None:
        inline = name in _INLINE
        if not inline:
            self.close_block()
            if name in _ENDS_P:
                self.end_group("p")
            if name in _GROUP and name != "p":
                self.end_group(_GROUP[name])
        if name in _VOID:
            return
        top = self.stack[-1]
        new = _place(name, attrs, top, inline)
        if inline and new.aside and not top.aside:  # what is hidden or an advert isn't part of the block around it
            self.close_block()
        if name == "a":
            self.anchor = top.base + 1 if re.search(r"(?:^|\s)href\s*=", attrs, re.I) else 0
            return
        at = len(self.stack)
        new.base = top.base if inline else at
        self.stack.append(new)
        self.named.setdefault(name, []).append(at)
        if not inline:
            for group in _WITHIN.get(name, "").split():
                self.grouped.setdefault(group, []).append(0)
            if name in _GROUP:
                self.grouped.setdefault(_GROUP[name], []).append(at)

    def end(self, name: str) -> None:
        if name == "a":
            self.anchor = 0
            return
        places = self.named.get(name)
        inline = name in _INLINE
        if not inline:
            self.close_block()
        # An inline element's end doesn't reach past the element that holds it.
        if places and (not inline or places[-1] > self.stack[-1].base):
            self.pop_to(places[-1])

    def end_group(self, group: str) -> None:
        places = self.grouped.get(group)
        if places and places[-1]:
            self.pop_to(places[-1])

    def pop_to(self, at: int) -> None:
        if self.stack[-1].aside and not self.stack[at - 1].aside:
            self.close_block()
        while len(self.stack) > at:
            last = self.stack.pop()
            self.named[last.name].pop()
            if not last.inline:
                for group in _WITHIN.get(last.name, "").split():
                    self.grouped[group].pop()
                if last.name in _GROUP:
                    self.grouped[_GROUP[last.name]].pop()
        if self.anchor > len(self.stack):
            self.anchor = 0


def _names(value: str) -> Iterator[set[str]]:
    """Words of each class or id."""
    for token in value.split():
        yield set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token).lower()))


def _place(name: str, attrs: str, above: _Open, inline: bool) -> _Open:
    new = _Open(name, above.article, above.aside, above.heading or name in _HEADINGS, above.item or name in ("li", "dd", "dt"), inline)
    told: list[set[str]] = []
    role = ""
    for key, a, b, c in _ATTR.findall(attrs) if attrs and not attrs.isspace() else ():
        key, value = key.lower(), a or b or c
        if key == "role":
            role = value.lower()
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            new.aside = True
        elif key in ("class", "id", "itemprop"):
            told += _names(value)
    if inline:
        new.aside |= any(words & _AD_WORDS and not words & _ABOUT for words in told)
        return new
    aside = any(words & _ASIDE_WORDS and not words & _ABOUT for words in told)
    outside = name not in ("html", "body", "article", "main")  # whose classes speak of the page, not of a part
    if name in ("article", "main") or role in ("main", "article") or (not aside and any(words & _ARTICLE_WORDS for words in told)):
        new.article = True
    if name in _ASIDE_TAGS or role in _ASIDE_ROLES or (outside and aside):
        new.aside = True
    if (name == "header" or (outside and any("header" in words for words in told))) and not new.article:
        new.aside = True
    return new


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; scripts, styles, comments and markup are gone, character references decoded."""
    p, at = _Page(), 0
    unclosed: set[str] = set()

    def text(piece: str) -> None:
        if piece:
            piece = charrefs.unescape(piece) if "&" in piece else piece
            p.parts.append(piece)
            if p.anchor:
                p.linked += len(piece.split())

    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _RAW and not m["end"]:
            p.parts.append(" ")
            if name == "svg" and m["attrs"].endswith("/"):  # in HTML only foreign elements close themselves
                continue
            end = None if name in unclosed else _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:
                unclosed.add(name)
        elif m["end"]:
            p.end(name)
        elif name in _FOREIGN and m["attrs"].endswith("/"):
            continue
        else:
            p.open(name, m["attrs"])
    text(page[at:])
    p.close_block()
    return p.blocks


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found], float)
    before, after = np.arange(n) - 1, np.arange(n) + 1
    pad = lambda x, i: np.where((i >= 0) & (i < n), x[np.clip(i, 0, max(n - 1, 0))], 0) if n else x
    flags = np.array([(b.article, b.aside, b.heading, b.item, any(x.article for x in found)) for b in found[:1]] * n, float).reshape(n, 5)
    for i, b in enumerate(found):
        flags[i, :4] = b.article, b.aside, b.heading, b.item
    return np.column_stack([words, links, pad(words, before), pad(links, before), pad(words, after), pad(links, after), flags])


class Tree:
    """A decision tree by Gini impurity; equal splits go to the earlier feature and lower value."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 8):
        self.feature, self.value, self.left, self.right, self.share = [], [], [], [], []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.feature)
        for part in (self.feature, self.left, self.right):
            part.append(-1)
        self.value.append(0.0)
        self.share.append(float(y.mean()))
        best = (len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        if depth and 0 < y.mean() < 1:
            for f in range(x.shape[1]):
                levels = np.unique(x[:, f])
                levels = levels[:: -(-len(levels) // 64)]
                for v in (levels[1:] + levels[:-1]) / 2:
                    low = x[:, f] <= v
                    a, b = y[low], y[~low]
                    if min(len(a), len(b)) >= least:
                        cost = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                        if cost < best[0] - 1e-9:
                            best = (cost, f, v)
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            self.feature[me], self.value[me] = best[1], best[2]
            self.left[me] = self._grow(x[low], y[low], depth - 1, least)
            self.right[me] = self._grow(x[~low], y[~low], depth - 1, least)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for i, row in enumerate(x):
            k = 0
            while self.feature[k] >= 0:
                k = self.left[k] if row[self.feature[k]] <= self.value[k] else self.right[k]
            out[i] = self.share[k]
        return out


_W = "the river town held its yearly fair on the old bridge and many people came to see it".split()


def _page(rng: random.Random) -> str:
    """A labelled page: its blocks open with + (main text) or - (anything else)."""

    def words(low: int, high: int) -> str:
        return " ".join(rng.choice(_W) for _ in range(rng.randint(low, high)))

    def size() -> tuple[int, int]:
        return rng.choice([(1, 3), (4, 15), (16, 60), (16, 60), (60, 200)])

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/">{words(low, high)}</a>'

    def menu(n: int) -> str:
        return "<ul>" + "".join(f"<li>-{link()}</li>" if rng.random() < 0.5 else f'<li><a href="/">-{words(1, 4)}</a></li>' for _ in range(n)) + "</ul>"

    def other() -> str:
        kind = rng.choice(["ad", "notice", "share", "comments", "related", "newsletter"])
        inner = {"ad": f"-{words(*size())}", "notice": f"<p>-{words(*size())}</p>", "share": f"-{words(1, 4)} -{link()}", "comments": f"<h3>-{words(1, 3)}</h3><p>-{words(*size())}</p><p>-{words(*size())}</p>", "related": f"<h3>-{words(1, 3)}</h3>{menu(3)}", "newsletter": f"<form><p>-{words(*size())}</p><label>-{words(1, 2)}</label></form>"}[kind]
        return rng.choice([f'<div class="{kind}">{inner}</div>', f"<aside>{inner}</aside>"])

    def body(plain: bool) -> str:
        out = [f"<h1>+{words(2, 12)}</h1>"]
        for _ in range(rng.randint(2, 7)):
            kind = rng.random()
            if kind < 0.6:
                out.append(f"<p>+{words(*size()) if not plain else words(14, 120)}</p>")
            elif kind < 0.7:
                out.append(f"<p>+{words(10, 40)} {link()} {words(5, 40)}</p>")
            elif kind < 0.8:
                out.append(f"<h2>+{words(1, 6)}</h2><p>+{words(14, 120)}</p>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>+{words(3, 30)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif not plain:
                out.append(other() if kind < 0.96 else f"<p>+{link(1, 6)}</p>")
        return "".join(out)

    plain = rng.random() < 0.3  # no element says what it is
    if plain:
        top = "".join(f"<div>-{link()}</div>" for _ in range(rng.randint(2, 6)))
        end = f"<div>-{link()} {link()}</div>" + "".join(f"<div>-{words(1, 5)}</div>" for _ in range(rng.randint(0, 3)))
        return f"{top}<div>{body(True)}</div>{end}" if rng.random() < 0.8 else body(True)
    top = rng.choice([f"<nav>{menu(rng.randint(2, 8))}</nav>", f"<header><div>-{words(1, 3)}</div><p>-{words(2, 20)}</p></header>", f'<div id="menu">{menu(3)}</div>'])
    shell = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', '<div role="main">{}</div>'])
    end = rng.choice([f"<footer>-{words(2, 60)} {link()}</footer>", f'<div id="footer"><p>-{words(2, 60)}</p></div>'])
    return top + other() * rng.randint(0, 1) + shell.format(body(False)) + other() * rng.randint(0, 2) + end


def training_table(pages: int = 160, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features of the blocks of some labelled pages, and whether each block is main text."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        found = blocks(_page(rng))
        ys += [b.text.startswith("+") for b in found]
        xs.append(features(found))
    return np.concatenate(xs), np.array(ys, float)


@cache
def default_tree() -> Tree:
    """The tree that is trained on the table; operators train it once, on the driver."""
    return Tree(*training_table())


def main_text(page: str, tree: Tree | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    share = (tree or default_tree()).predict(features(found))
    return " ".join(b.text for b, s in zip(found, share, strict=True) if s >= 0.5)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Null and empty pages, and pages of markup only, have an empty text;
    null ids and urls stay null; repeated rows give a row each; an empty table gives none; other columns are ignored."""

    tree = default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch, "html"):
                text = [main_text(h.as_py() or "", tree) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    d = pick(pages, page_id=id_col, url=url_col, html=html_col)
    kind = dict(d.dtypes)
    return d.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
