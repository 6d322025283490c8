"""A small HTML reader: block-level nodes, runs of text in them, and features of every node."""

from __future__ import annotations

import functools
import html
import re
import zlib
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())
#: Elements with tags inside, without text of the page. Those of svg, math and object are read as any other's.
DROPPED = frozenset("template noscript select".split())
BLOCK = frozenset(
    "html body address article aside blockquote button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup"
    " li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption label legend".split()
)
#: An opening tag ends these open elements, as far as the nearest of the others.
ENDS = {
    **{t: (("p",), ()) for t in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup main menu nav ol p pre section table ul".split()},
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
}
#: What p is not ended across.
SCOPE = frozenset("html body table td th button article aside section div main blockquote form li footer header nav".split())
#: A comment, a declaration, or a tag: name and attributes, with quoted values that may hold >; a tag of quotes that don't match ends at its first >.
#: A tag's parts are bounded in number, so that no page is gone through again for each of its tags.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"<]*\"|'[^'<]*'){0,2000}+|[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAGS = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "div", "p", "li", "ul", "table", "h1", "h2", "blockquote", "figure", "#text", "body", "button")
ALIKE = {"ol": "ul", "dl": "ul", "menu": "nav", "dd": "li", "dt": "li", "td": "table", "th": "table", "tr": "table", "tbody": "table", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "pre": "blockquote", "figcaption": "figure", "label": "form", "fieldset": "form", "legend": "form", "dialog": "aside"}
#: Attribute words are known by a hash; what they tell is learned (html_extract).
BUCKETS = 1 << 12
#: What an opening tag does not end elements across: its own list, or else SCOPE (without what it ends).
BARRIERS = {t: frozenset(stop) | frozenset(x for x in SCOPE if x not in ends and (not stop or x != "li")) for t, (ends, stop) in ENDS.items()}


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: tuple[int, ...] = ()  # buckets of its attribute words
    text: str = ""  # of a #text node
    linked: int = 0  # characters in links
    children: list[int] = field(default_factory=list)
    tags: int = 0  # elements below, inline ones included


def tokens(attributes: str) -> tuple[int, ...]:
    """The buckets of the words of class, id, role, itemprop and aria-label."""
    return tuple(sorted({zlib.crc32(w.lower().encode()) % BUCKETS for m in ATTRIBUTE.finditer(attributes) for w in WORD.findall(m[2] or m[3] or m[4] or "")}))


def parse(page: str) -> list[Node]:
    """The page's block-level elements and runs of text (tag #text, white space collapsed), parents before children, in page order."""
    nodes = [Node("body", -1, 0)]
    open_: list[tuple[str, int]] = []  # elements, and the node each made (or the node it is in); with ~ where text is dropped
    places: dict[str, list[int]] = {}  # where in open_ the elements of each name are, and all block-level ones (*)
    run: list[str] = []
    linked = 0

    def here() -> int:
        return open_[-1][1] if open_ else 0

    def last(tag: str) -> int:
        """The place of the innermost open element of that name, or -1."""
        at = places.get(tag)
        return at[-1] if at else -1

    def push(tag: str, node: int) -> None:
        for k in (tag, "*") if tag in BLOCK else (tag,):
            places.setdefault(k, []).append(len(open_))
        open_.append((tag, node))

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            parent = here()
            nodes.append(Node("#text", parent, nodes[parent].depth + 1, text=text, linked=min(linked, len(text))))
            nodes[parent].children.append(len(nodes) - 1)
        run.clear()
        linked = 0

    def close(i: int) -> None:
        """Ends the elements from place i on."""
        if last("*") >= i:
            flush()
        for tag, _ in reversed(open_[i:]):
            places[tag].pop()
            if tag in BLOCK:
                places["*"].pop()
        del open_[i:]

    @functools.cache
    def ending(tag: str) -> int:
        """Where the last end tag of that name begins, or -1."""
        return max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\s*>", page, re.I)), default=-1)

    at, size = 0, len(page)
    final = page.rfind(">")  # behind it there are no tags
    endless: set[str] = set()  # raw elements of which no end tag comes any more
    while at < size:
        m = TOKEN.search(page, at) if at <= final else None
        text = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        dropped = bool(open_) and open_[-1][0][0] == "~"
        if text and not dropped:
            run.append(text)
            if last("a") >= 0:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            i = max(last(tag), last(f"~{tag}"))
            if i >= 0 and (tag in BLOCK or last("*") <= i):
                close(i)
            continue
        if not dropped:
            nodes[here()].tags += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at) if tag not in endless else None
            if end or tag in ("script", "style"):
                at = end.end() if end else size
                continue
            endless.add(tag)
        if dropped or tag in RAW or tag in DROPPED:
            # dropped up to its end tag or its parent's; where neither comes, only the tag is
            if tag not in VOID and not m[3].endswith("/") and (dropped or open_ or at <= ending(tag)):
                push(f"~{tag}", here())
            continue
        if tag == "br" or tag == "hr":
            run.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                nodes[0].tokens = tokens(m[3])
            continue
        if tag in BLOCK:
            if tag in ENDS:
                barrier = max(map(last, BARRIERS[tag]))
                while (i := max(map(last, ENDS[tag][0]))) > barrier:
                    close(i)
            flush()
            parent = here()
            nodes.append(Node(tag, parent, nodes[parent].depth + 1, tokens(m[3])))
            nodes[parent].children.append(len(nodes) - 1)
            push(tag, len(nodes) - 1)
        else:
            push(tag, here())
    flush()
    return nodes


#: Of a node's attribute words: the least and the greatest of what they tell; the same of all above it.
OWN = ("own_least", "own_greatest", "above_least", "above_greatest")
#: Names of the features, in order (for readers; the model goes by position).
NAMES = [*(f"is_{t}" for t in TAGS), *OWN, *(f"above_{t}" for t in TAGS[:8]), *"depth chars share link_density tags_per_char paragraphs items children words_per_run sentence_marks place siblings same_siblings before_chars after_chars own_text parent_chars parent_link_density short".split()]


def features(nodes: list[Node], told: np.ndarray) -> np.ndarray:
    """A row for each node. told: for each bucket of attribute words, how much it speaks for main text (0: nothing)."""
    n = len(nodes)
    texts = [x.text for x in nodes]
    sums = [
        [len(t) for t in texts],
        [x.linked if x.text else 0 for x in nodes],
        [bool(t) for t in texts],
        [x.tags + 1 for x in nodes],
        [x.tag == "p" for x in nodes],
        [x.tag == "li" for x in nodes],
        [sum(map(t.count, ".!?;:")) if t else 0 for t in texts],
    ]
    parents = [x.parent for x in nodes]
    for a in sums:  # of all that is below
        for i in range(n - 1, 0, -1):
            a[parents[i]] += a[i]
    chars, linked, runs, tags, paragraphs, items, marks = np.array(sums, float)
    out = np.zeros((n, len(NAMES)))
    k, h = len(TAGS), len(OWN)
    tag_at = {t: j for j, t in enumerate(TAGS)}
    place, siblings, same, before, after = ([0.0] * n for _ in range(5))
    size = sums[0]
    for x in nodes:
        c = x.children
        count: dict[str, int] = {}
        for j in c:
            count[nodes[j].tag] = count.get(nodes[j].tag, 0) + 1
        for q, j in enumerate(c):
            place[j], siblings[j], same[j] = q / max(len(c) - 1, 1), len(c), count[nodes[j].tag]
            before[j] = size[c[q - 1]] if q else 0
            after[j] = size[c[q + 1]] if q + 1 < len(c) else 0
    parent = np.array([max(x.parent, 0) for x in nodes])
    tag = np.full(n, -1)
    says = told.tolist()
    least, greatest, above_least, above_greatest = ([0.0] * n for _ in range(4))
    above = [0] * n  # a bit for each of the first eight tags
    bit = [0] * n
    for i, x in enumerate(nodes):
        t = tag_at.get(ALIKE.get(x.tag, x.tag), -1)
        tag[i] = t
        if 0 <= t < 8:
            bit[i] = 1 << t
        if x.tokens:
            what = [says[j] for j in x.tokens]
            least[i], greatest[i] = min(0.0, *what), max(0.0, *what)
        if (p := x.parent) >= 0:
            above_least[i], above_greatest[i] = min(least[p], above_least[p]), max(greatest[p], above_greatest[p])
            above[i] = bit[p] | above[p]
    known = np.flatnonzero(tag >= 0)
    out[known, tag[known]] = 1
    out[:, k : k + h] = np.array([least, greatest, above_least, above_greatest]).T
    out[:, k + h : k + h + 8] = (np.array(above)[:, None] >> np.arange(8)) & 1
    density = linked / np.maximum(chars, 1)
    rest = [[x.depth for x in nodes], np.log1p(chars), chars / max(chars[0], 1), density, tags / np.maximum(chars, 1), paragraphs, items, [len(x.children) for x in nodes], chars / np.maximum(runs, 1), marks / np.maximum(chars, 1) * 100, place, siblings, same, np.log1p(before), np.log1p(after), [bool(x.text) for x in nodes], np.log1p(chars[parent]), density[parent], chars < 60]
    out[:, k + h + 8 :] = np.stack([np.asarray(r, float) for r in rest], 1)
    return out


def decode(nodes: list[Node], margin: np.ndarray) -> np.ndarray:
    """Kept flags of most likelihood under the rule that a kept node's parent is kept."""
    n = len(nodes)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    # gain of keeping a node (with the best below it) over dropping it whole
    gain = yes - no
    for i in range(n - 1, 0, -1):
        gain[nodes[i].parent] += max(gain[i], 0.0)
    kept = np.zeros(n, bool)
    kept[0] = gain[0] > 0
    for i in range(1, n):
        kept[i] = kept[nodes[i].parent] and gain[i] > 0
    return kept
