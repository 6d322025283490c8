"""HTML extraction: boosted trees over DOM nodes, decoded along the tree.

A page becomes block-level nodes and runs of text (dom.py). Gradient-boosted trees (boosting.py) tell for
each node from its tag, attribute tokens (hashed; their log odds of main text are learned from pages that the trees are not fitted to), depth, text density, links and siblings whether its subtree holds
main text; decoding picks the likeliest set of kept nodes in which a kept node's parent is kept, so
that no article stands in a dropped menu. The text of the kept runs, in page order, joined by one space, is the result.

Tokens and trees are fitted to PAGES pages that are made up here, with known main text: layouts with
menus, headers, footers, sidebars, adverts, notices, forms, comments and share bars, in many spellings of
tags and attributes. No page of the input is learned from.

Defined results. A null or empty html gives the empty text; so does a page without main text. Broken
markup is read as far as it goes. Of scripts, styles, titles, text areas, frames, templates, noscript and select no text is taken;
without an end tag, one that isn't a script or style ends with its parent. Repeated rows give repeated rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boosting, dom
from .common import released, small

#: Made-up pages that the trees are fitted to.
PAGES = 800
#: Marks main text in made-up pages; no other text of theirs has it.
MARK = "⁣"
SYLLABLES = "an the re on ti er is ou le de en ma no si ra to vi lo un ar qui est und der".split()


#: How often a made-up page's parts are told by their tags rather than by attributes, by family of layouts; None: as each part has it.
FAMILIES = {"tags": 1.0, "attributes": 0.0, "mixed": None}


class Maker:
    """Makes up pages of some families of layouts."""

    def __init__(self, seed: int, families: tuple[str, ...] = tuple(FAMILIES)) -> None:
        self.r = random.Random(seed)
        self.families, self.share = families, None

    def by_tag(self, share: float) -> bool:
        """Whether a part is told by its tag."""
        return self.r.random() < (share if self.share is None else self.share)

    def words(self, low: int, high: int) -> str:
        r = self.r
        each = ("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return " ".join(w + r.choice(".,!?;:") if r.random() < 0.08 else w for w in each)

    def label(self, low: int = 1, high: int = 3) -> str:
        """A few words with or without a mark."""
        return self.words(low, high).capitalize() + self.r.choice(["", "", "", "", ".", ".", ",", "!", "?", ":", " &raquo;"])

    def sentence(self, low: int = 3, high: int = 25) -> str:
        return self.words(low, high).capitalize() + self.r.choice(".....!?")

    def attr(self, *names: str) -> str:
        r = self.r
        if r.random() < 0.12:
            return ""
        name = r.choice(names)
        style = r.choice(["{}", "{}", "site-{}", "{}-wrap", "{}_box", "main-{}" if "main" in names else "block-{}"])
        return f' {r.choice(["class", "class", "id"])}="{style.format(name)}"'

    def main(self, text: str) -> str:
        return MARK + text

    def paragraph(self) -> str:
        r = self.r
        kind = r.random()
        text = " ".join(self.sentence() for _ in range(1 if kind < 0.2 else r.randint(1, 9)))
        if r.random() < 0.15:
            text = self.words(1, 3).capitalize() + "."
        if r.random() < 0.25:
            cut = text.split(" ")
            i = r.randrange(len(cut))
            cut[i] = r.choice(['<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>"]).format(cut[i])
            text = " ".join(cut)
        return f"<p>{MARK}{text}" + ("</p>" if r.random() < 0.9 else "")

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.main(self.words(2, 12).capitalize())}</h1>"] if r.random() < 0.85 else []
        if r.random() < 0.3:
            out.append(f"<p><b>{self.main(self.sentence())}<br>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 13])):
            k = r.random()
            if k < 0.72:
                out.append(self.paragraph())
            elif k < 0.78:
                out.append(f"<h2>{self.main(self.words(1, 6).capitalize())}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.main(self.sentence(2, 15))}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>{self.main(self.sentence())}</blockquote>")
            elif k < 0.92:
                out.append("<table>" + "".join(f"<tr><td>{self.main(self.words(1, 3))}</td><td>{self.main(self.words(1, 3))}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.95:
                out.append(f"<div{self.attr('ad', 'advert', 'banner', 'sponsored', 'promo')}>{self.sentence()}</div>")
            elif k < 0.975:
                out.append(f"<div{self.attr('share', 'sharing', 'social', 'follow', 'related', 'newsletter', 'author-bio', 'toolbar')}>{self.words(2, 8)} <a href=\"#\">{self.words(1, 2)}</a></div>")
            else:
                out.append(f"<figure><img src=\"i.png\"><figcaption>{self.main(self.words(3, 9))}</figcaption></figure>")
        return "".join(out)

    def links(self, low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.label()}</a></li>' for i in range(self.r.randint(low, high))) + "</ul>"

    def menu(self) -> str:
        r = self.r
        tag, name = ("nav", "") if self.by_tag(0.5) else r.choice([("div", "x"), ("ul", "x")])
        body = self.links(3, 9) if r.random() < 0.7 else " | ".join(f'<a href="/">{self.label(1, 2)}</a>' for _ in range(r.randint(3, 8)))
        return f"<{tag}{self.attr('nav', 'menu', 'navbar', 'breadcrumb', 'breadcrumbs', 'navigation', 'pager', 'pagination', 'toc', 'tabs', 'links', 'skip') if name else ''}>{body}</{tag}>"

    def header(self) -> str:
        r = self.r
        inner = r.choice(["", f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.words(2, 8)}</p>", f"<div>{self.words(1, 5)}</div>"])
        return f"<header>{inner}{self.menu() if r.random() < 0.6 else ''}{'' if inner else self.words(1, 4)}</header>" if self.by_tag(0.6) else f"<div{self.attr('header', 'masthead', 'topbar', 'brand', 'logo', 'site-title')}>{inner}{self.words(1, 6)}</div>"

    def footer(self) -> str:
        r = self.r
        inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.words(2, 6)}</p>", self.links(2, 6), f"<p>{self.sentence(6, 30)}</p><p>{self.sentence()}</p>", self.sentence(4, 40)])
        return f"<footer>{inner}</footer>" if self.by_tag(0.7) else f"<div{self.attr('footer', 'copyright', 'legal', 'bottom', 'foot')}>{inner}</div>"

    def side(self) -> str:
        r = self.r
        inner = f"<h3>{self.label()}</h3>" + (self.links(2, 8) if r.random() < 0.6 else f"<p>{self.sentence()}</p>" * r.randint(1, 3))
        return f"<aside>{inner}</aside>" if self.by_tag(0.5) else f"<div{self.attr('sidebar', 'side', 'rail', 'related', 'widget', 'recommended', 'popular', 'trending', 'archive', 'tags', 'more')}>{inner}</div>"

    def notice(self) -> str:
        r = self.r
        return f"<div{self.attr('cookie', 'cookies', 'notice', 'consent', 'gdpr', 'alert', 'newsletter', 'subscribe', 'signup', 'popup', 'modal', 'overlay', 'paywall', 'toast')}>{r.choice(['', '<p>'])}{self.sentence(4, 30)} <button>{self.label(1, 2)}</button></div>"

    def advert(self) -> str:
        r = self.r
        return f"<!-- {self.words(1, 2)} --><div{self.attr('ad', 'ads', 'advert', 'advertisement', 'adbox', 'banner', 'sponsor', 'sponsored', 'promo', 'promotion', 'affiliate')}>{' '.join(self.sentence(2, 14) for _ in range(r.randint(1, 4)))}</div>"

    def form(self) -> str:
        return f"<form action=\"/\"><label>{self.label()}</label><input name=\"q\"><button>{self.label(1, 2)}</button>{self.r.choice(['', '<p>' + self.sentence() + '</p>'])}</form>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(["div", "li", "article", "section"])
        each = "".join(f"<{tag}{self.attr('comment', 'reply', 'comment-body', 'response', 'thread') if r.random() < 0.8 else ''}><p>{' '.join(self.sentence() for _ in range(r.randint(1, 4)))}</p></{tag}>" for _ in range(r.randint(1, 6)))
        return f"<{r.choice(['div', 'section', 'section'])} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comments-area', 'discussion', 'responses', 'reader-comments', 'feedback', 'respond', 'disqus-thread'])}\"><h3>{self.words(1, 2)}</h3>{each}{self.form() if r.random() < 0.4 else ''}</section>"

    def page(self) -> str:
        r = self.r
        self.share = FAMILIES[r.choice(self.families)]
        body = self.article()
        named = [("div", ("content", "article", "post", "entry-content", "main", "story", "prose", "article-text", "document")), ("section", ("content", "post", "article", "entry"))]
        tag, names = r.choice([("article", ()), ("article", ()), ("article", ()), ("main", ())]) if self.by_tag(0.7) else r.choice(named)
        body = f"<{tag}{self.attr(*names) if names else ''}>{body}</{tag}>"
        if r.random() < 0.3:
            body = f"<{r.choice(['main', 'div'])}{self.attr('main', 'container', 'page', 'wrapper') if r.random() < 0.6 else ''}>{body}</div></main>"
        before = [f for f, p in ((self.notice, 0.2), (self.header, 0.4), (self.menu, 0.75), (self.advert, 0.5), (self.form, 0.1), (self.side, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.comments, 0.3), (self.side, 0.3), (self.advert, 0.2), (self.menu, 0.1), (self.notice, 0.15), (self.form, 0.1), (self.footer, 0.85)) if r.random() < p]
        r.shuffle(before)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 8)}</title><script>var t=\"</p>\";</script></head><body{r.choice(['', '', self.attr('home', 'single', 'page')])}>{''.join(f() for f in before)}{body}{''.join(f() for f in after)}</body></html>"


@dataclass
class Model:
    """What attribute words tell, and the trees."""

    told: np.ndarray
    trees: boosting.Trees


def labelled(maker: Maker, pages: int) -> list[tuple[list[dom.Node], np.ndarray]]:
    """Made-up pages: nodes, and whether each holds main text."""
    out = []
    for _ in range(pages):
        nodes = dom.parse(maker.page())
        main = np.array([MARK in x.text for x in nodes])
        for x in nodes:
            x.text = x.text.replace(MARK, "")
        for i in range(len(nodes) - 1, 0, -1):
            main[nodes[i].parent] |= main[i]
        out.append((nodes, main))
    return out


def log_odds(pages: list[tuple[list[dom.Node], np.ndarray]], least: int = 3) -> np.ndarray:
    """Of each bucket of attribute words, the smoothed log odds that a node with it holds main text, against all nodes'; 0 for those seen less often than `least`."""
    seen = np.zeros((2, dom.BUCKETS))
    for nodes, main in pages:
        for x, m in zip(nodes, main, strict=True):
            if x.tokens:
                seen[int(m), list(x.tokens)] += 1
    base = np.log((seen[1].sum() + 1) / (seen[0].sum() + 1))
    return np.where(seen.sum(0) >= least, np.log((seen[1] + 0.5) / (seen[0] + 0.5)) - base, 0.0)


def fit(maker: Maker, pages: int) -> Model:
    """Attribute words learned from half of the pages, trees from the other half."""
    made = labelled(maker, pages)
    told, rest = log_odds(made[: pages // 2]), made[pages // 2 :]
    return Model(told, boosting.fit(np.concatenate([dom.features(n, told) for n, _ in rest]), np.concatenate([m for _, m in rest]).astype(float)))


@functools.cache
def model(pages: int = PAGES, seed: int = 11) -> Model:
    """Fitted to made-up pages of all families."""
    return fit(Maker(seed), pages)


def extract(pages: list[str], fitted: Model) -> list[str]:
    """The main text of each page."""
    parsed = [dom.parse(p) for p in pages]
    if not parsed:
        return []
    margin = fitted.trees.margin(np.concatenate([dom.features(n, fitted.told) for n in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = dom.decode(nodes, margin[at : at + len(nodes)])
        out.append(" ".join(x.text for x, k in zip(nodes, kept, strict=True) if k and x.text))
        at += len(nodes)
    return out


def html_extract(pages: DataFrame, fitted: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page (page_id, url, html)."""
    cast = pages.sparkSession.sparkContext.broadcast(fitted or model())  # some thousands of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in small(batch, 256):
                texts = extract([x or "" for x in b.column(2).to_pylist()], cast.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(released(run), "page_id long, url string, text string, n_chars long")
