"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree of elements and text leaves. Each node gets
features of its own and of its subtree: text and link density, tag and
attribute tokens, depth, place among its siblings and in the page, and what its
ancestors are. An element that holds the headline and a good part of the page
says nothing against what is in it, whatever it is called (a body of class
``has-sidebar``, a form around the whole page); names that state something
(``no-sidebar``, ``ad-free``) are no noise; what follows a heading like "3
Comments" in its parent is seen as such without any name. Boosted trees give each node a chance of holding main text. The
decoding is hierarchical: a node that is dropped drops all below it, so the
choice is the best consistent labelling of the whole tree, found bottom-up,
and no text can be kept under a dropped ancestor.

The tables have no labelled pages, so the trees are fitted on pages that a
seeded generator makes (``training_page``): many layouts of articles with
menus, headers, footers, sidebars, notices, adverts, forms and comments. Their
number is fixed, so fitting costs the same for any corpus.

Output: character references decoded, white space inside a block one space,
blocks in page order joined by one line feed. Edge cases: null, empty and
broken html give what text they hold, or an empty string; repeated rows each
give a row; an empty table gives an empty result; other columns are ignored. Pages of any length are
parsed whole, in linear time; where keeping and dropping a node are equally likely it is dropped.
"""

from __future__ import annotations

import functools
import html as htmllib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, table

# Element names by their role in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("script style noscript template svg iframe head title textarea select button canvas audio video".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option optgroup legend summary".split())
SAME_CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
BAD_TOKENS = frozenset(
    "ad ads advert advertisement adbox banner sponsor sponsored promo promoted nav navbar navigation menu breadcrumb breadcrumbs footer foot bottom header masthead topbar sidebar side aside widget related recommend recommended share sharing social follow subscribe subscription newsletter signup login popup modal overlay cookie cookies consent notice gdpr alert comment comments disqus reply replies discussion respond form search tags pagination pager copyright legal toolbar skip outbrain taboola".split()
)
GOOD_TOKENS = frozenset("article articlebody body content entry main post story text prose blog page paragraph lead chapter".split())

#: Parts that make a name speak about the page or a state instead of saying what the element is: ``no-sidebar``, ``ad-free``, ``comments-open``.
STATE_FIRST = frozenset("no not non has have with without is hide show enable disable".split())
STATE_LAST = frozenset("on off open opened closed enable enabled disabled free active visible hidden".split())
#: Short lines that head a thread of comments, with or without their number.
COMMENT_HEAD = re.compile(
    r"\W*(?:\d+\s+(?:comments?|replies|responses?|kommentare?|antworten|comentarios?|respuestas?|commentaires?|réponses?)"
    r"|(?:(?:reader|user|leser)\s*)?(?:comments?|kommentare|comentarios|commentaires)(?:\s*\(?\d+\)?)?|leave a (?:reply|comment)|join the (?:discussion|conversation))\W*",
    re.I,
)
_TITLE = re.compile(r"<title(?=[\s>])[^>]{0,1000}>", re.I)
_TITLE_END = re.compile(r"</title", re.I)

#: What may stand in a head; any other tag, and text, ends it where its end tag is left out (fixed values).
IN_HEAD = frozenset("base basefont bgsound link meta title script style noscript template".split())
#: Elements that are skipped whole where their end tag is there (fixed values).
SKIPPED = frozenset("noscript template svg iframe".split())

# attributes: white space, names, and = with a quoted or plain value; what has matched is never tried again
_IN_TAG = r"(?>[\s/]+|[^\s/>=]+|=\s*+(?>\"[^\"]*\"|'[^']*'|[^\s>]*))*+"
_TOKEN = re.compile(
    rf"<(script|style|textarea|title)(?=[\s/>]){_IN_TAG}>.*?(?:</\1\s*>|\Z)"  # 1: raw text elements, whole
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_IN_TAG})>"  # 2-4: tags
    r"|<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</?[a-zA-Z][^>]*(?:>|\Z)",  # comments and broken tags
    re.S | re.I,
)
_ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
_ATTRS = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_READ = frozenset(("class", "id", "role", "itemprop", "aria-label"))
_NAMED = re.compile(r"class|id|role|itemprop|aria-label|hidden|style", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_STOPS = re.compile(r"[.,!?;]")
_UP = {t: 1 << i for i, t in enumerate(("nav", "header", "footer", "aside", "form", "article", "main", "a", "#silent"))}
_P_STOPS = ("button", "table", "td", "article", "section", "div", "li", "body")
_NONE: frozenset = frozenset()


class Page:
    """The nodes of a page in page order, which is the tree's preorder, as parallel lists."""

    __slots__ = ("tag", "parent", "text", "block", "tokens", "above", "own", "chars", "stops", "depth", "bad", "good", "end", "title")

    def __init__(self) -> None:
        self.tag: list[str] = []
        self.parent: list[int] = []
        self.text: list[str] = []
        self.block: list[int] = []
        self.tokens: list[frozenset] = []
        self.above: list[int] = []  # bits of ``_UP``, of the node and its ancestors
        self.own: list[int] = []  # bits of the node alone
        self.chars: list[int] = []
        self.stops: list[int] = []
        self.depth: list[int] = []
        self.bad: list[int] = []  # attribute tokens of the node
        self.good: list[int] = []
        self.end: list[int] = []  # one more than the last node below
        self.title = ""

    def add(self, tag: str, parent: int, text: str, block: int, tokens: frozenset, bits: int, chars: int = 0, stops: int = 0) -> None:
        self.tag.append(tag)
        self.parent.append(parent)
        self.text.append(text)
        self.block.append(block)
        self.tokens.append(tokens)
        top = parent < 0
        self.above.append(bits if top else bits | self.above[parent])
        self.own.append(bits)
        self.chars.append(chars)
        self.stops.append(stops)
        self.depth.append(0 if top else self.depth[parent] + 1)
        self.bad.append(len(tokens & BAD_TOKENS) if tokens else 0)
        self.good.append(len(tokens & GOOD_TOKENS) if tokens else 0)
        self.end.append(len(self.tag))


def _attributes(attrs: str) -> tuple[frozenset, bool]:
    words, hidden = [], False
    for k, a, b, c in _ATTRS.findall(attrs):
        name = k.lower()
        if name in _READ:
            words.append(a or b or c)
        elif name == "hidden" or (name == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
            hidden = True
    return frozenset(part for name in " ".join(words).split() for part in _parts(name)), hidden


def _parts(name: str) -> list[str]:
    """The words of a name, without noise words where it states something about the page (``no-sidebar``) or heads the article (``post-header``)."""
    parts = [w.lower() for w in _SPLIT.split(name) if w]
    if len(parts) > 1:
        if parts[0] in STATE_FIRST or parts[-1] in STATE_LAST:
            return [w for w in parts if w not in BAD_TOKENS]
        if "header" in parts and not GOOD_TOKENS.isdisjoint(parts):
            return [w for w in parts if w != "header"]
    return parts


def parse(page: str) -> Page:
    """Elements and text leaves (tag ``#text``); a leaf has the number of its block.

    The time is linear in the page: ``where`` has the places of the open elements
    of each tag in the stack, so end tags and implied ends are found at once.
    """
    out = Page()
    if (named := _TITLE.search(page)) and (closed := _TITLE_END.search(page, named.end())):
        out.title = " ".join(htmllib.unescape(page[named.end() : closed.start()]).split())
    tags, end, add = out.tag, out.end, out.add
    stack: list[int] = []
    where: dict[str, list[int]] = {}
    unended: set[str] = set()
    block, pos = 0, 0

    def nearest(names: Iterable[str]) -> int:
        return max((where[t][-1] for t in names if where.get(t)), default=-1)

    def pop(to: int) -> None:
        """Close all elements from place ``to`` of the stack on."""
        while len(stack) > to:
            node = stack.pop()
            where[tags[node]].pop()
            end[node] = len(tags)

    def leave_head() -> None:
        if stack and tags[stack[-1]] == "head":
            pop(len(stack) - 1)

    def leaf(raw: str) -> None:
        text = htmllib.unescape(raw) if "&" in raw else raw
        t = text.strip()
        if t:
            leave_head()
        add("#text", stack[-1] if stack else -1, text, block, _NONE, 0, len(t), len(_STOPS.findall(t)) if t else 0)

    while m := _TOKEN.search(page, pos):
        start = m.start()
        if start > pos:
            leaf(page[pos:start])
        pos = m.end()
        tag = m[3]
        if tag is None:
            if m[1]:
                block += m[1].lower() in BLOCK
            continue
        tag = tag.lower()
        if m[2]:
            if where.get(tag):
                pop(where[tag][-1])
            block += tag in BLOCK
            continue
        attrs = m[4]
        if tag in SKIPPED and tag not in unended:
            if tag == "svg" and attrs.endswith("/"):
                continue
            last = _ENDS[tag].search(page, pos)
            if last:
                pos = last.end()
                continue
            unended.add(tag)
        if tag not in IN_HEAD:
            leave_head()
        if tag in CLOSES_P and where.get("p") and where["p"][-1] > nearest(_P_STOPS):
            pop(where["p"][-1])
        if tag in SAME_CLOSES:
            same = nearest(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,))
            if same > nearest(SAME_CLOSES[tag]):
                pop(same)
        block += tag in BLOCK
        tokens, bits = _NONE, _UP.get(tag, 0)
        if attrs and _NAMED.search(attrs):
            tokens, hidden = _attributes(attrs)
            if hidden:
                bits |= _UP["#silent"]
        if tag in SILENT:
            bits |= _UP["#silent"]
        at = stack[-1] if stack else -1
        add(tag, at, "", block, tokens, bits)
        if tag == "br":
            add("#text", at, " ", block, _NONE, 0)
        elif tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            where.setdefault(tag, []).append(len(stack))
            stack.append(len(tags) - 1)
    if pos < len(page):
        leaf(page[pos:])
    pop(0)
    return out


# ------------------------------------------------------------ features

_TAGS = ("#text", "p", "div", "li", "a", "h1", "h2", "h3", "td", "span", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "table", "blockquote", "figure")
_TAG_AT = {t: i for i, t in enumerate(_TAGS)}
#: Elements whose tag speaks against what is below them, unless they hold the article itself.
_NOISE = frozenset("nav header footer aside form".split())


def _mark(page: Page, first: int, chars: np.ndarray, zone: np.ndarray, titled: np.ndarray) -> None:
    """Mark what follows a comments' heading in its parent (as +1 where it begins and -1 behind it), and text that is the page's title."""
    title, parent, end, kept_to = page.title, page.parent, page.end, 0
    for k, t in enumerate(page.text):
        if not t or k < kept_to or len(t) > 4 * len(title) + 80:
            continue
        t = t.strip()
        if not t:
            continue
        if len(t) > 3 and title and (t == title or len(t) > 12 and (title.startswith(t) or t.startswith(title))):
            titled[first + k] = 1
        if len(t) < 60 and COMMENT_HEAD.fullmatch(t):
            top = k
            while parent[top] >= 0 and chars[first + parent[top]] == chars[first + k]:
                top = parent[top]
            up = parent[top]
            kept_to = end[up] if up >= 0 else len(page.tag)  # zones of one page do not overlap
            zone[first + top] += 1
            if first + kept_to < len(zone):
                zone[first + kept_to] -= 1


def features(pages: list[Page]) -> np.ndarray:
    """A row of features for each node of all pages, in order.

    Nodes are in preorder, so a subtree is a range and its sums are differences
    of running sums.
    """
    sizes = [len(p.tag) for p in pages]
    n = sum(sizes)
    if not n:
        return np.zeros((0, 1))
    first = np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
    parent = np.concatenate([np.array(p.parent, dtype=np.int64) for p in pages if p.tag])
    root = parent < 0
    up = np.where(root, np.arange(n), parent + first)
    tag = np.array([_TAG_AT.get(t, -1) for p in pages for t in p.tag])
    chars, stops, above = (np.array([v for p in pages for v in getattr(p, name)], dtype=np.int64) for name in ("chars", "stops", "above"))
    depth, bad, good, end, own_bits = (np.array([v for p in pages for v in getattr(p, name)], dtype=np.int64) for name in ("depth", "bad", "good", "end", "own"))
    end = end + first

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x)])
        return total[end] - total[:-1]

    def around(x: np.ndarray) -> np.ndarray:
        """Sums of ``x`` over a node and its ancestors: a node counts from its place to its end."""
        change = np.zeros(n + 1)
        change[:n] += x
        np.subtract.at(change, end, x)
        return np.cumsum(change)[:n]

    is_text = tag == 0
    seen = np.cumsum(chars) - chars
    seen = seen - seen[first]
    own = chars.astype(float)
    chars = below(own)
    links = below(own * ((above & _UP["a"]) > 0))
    stops, tags, pars = below(stops), below(~is_text), below(tag == 1)
    heads = below((tag >= 5) & (tag <= 7))
    total = np.maximum(1.0, np.bincount(first, own, minlength=n)[first])
    # what holds the headline and a good part of the page is no noise, whatever its tag and attributes say: they speak of the page
    anchors = below(tag == 5)
    headless = np.bincount(first, tag == 5, minlength=n)[first] == 0
    outer = ~is_text & (np.where(headless, chars >= 0.6 * total, (anchors > 0) & (chars >= 0.3 * total)) | (depth < 2) & (chars >= 0.3 * total))
    minor = ~outer
    quote = tag == _TAG_AT["blockquote"]  # a quotation may be named for what it quotes: a reply, a comment
    bad, good = bad * (minor & ~quote), good.astype(float)
    bad_up, good_up = around(bad), around(good)
    bits = [around(((own_bits >> i) & 1) * minor) > 0 if name in _NOISE else (above >> i) & 1 for i, name in enumerate(_UP)]
    zone, titled = np.zeros(n), np.zeros(n)
    for k, p in zip(np.cumsum([0, *sizes[:-1]]), pages, strict=True):
        _mark(p, k, chars, zone, titled)
    zone, titled = np.cumsum(zone) > 0, below(titled)
    # siblings: nodes with one parent; roots of a page are siblings too
    key = np.where(root, n + first, up)
    by = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
    counts = np.diff(np.r_[starts, n])
    group = np.empty(n, dtype=np.int64)
    group[by] = np.repeat(np.arange(len(starts)), counts)
    nth = np.empty(n)
    nth[by] = np.arange(n) - np.repeat(starts, counts)
    m = counts[group]
    among = np.bincount(group, chars)[group]
    prev, nxt = np.zeros(n), np.zeros(n)
    same = key[by][1:] == key[by][:-1]
    prev[by[1:][same]] = chars[by[:-1][same]]
    nxt[by[:-1][same]] = chars[by[1:][same]]
    _, kind, often = np.unique(group * 64 + tag + 1, return_inverse=True, return_counts=True)
    return np.stack([
        tag, *bits[:8], zone, np.minimum(titled, 2), anchors > 0, outer, nth / np.maximum(1, m - 1), chars / np.maximum(1, among), often[kind] / m, depth, chars / total, links / np.maximum(1, chars),
        stops / np.maximum(1, chars), chars / (tags + 1), bad, good, bad_up, good_up, seen / total, links[up] / np.maximum(1, chars[up]), chars[up] / (tags[up] + 1), heads,
        *np.log1p([among / m, prev, nxt, m, chars, tags, pars, chars[up], pars[up], end - np.arange(n)]),
    ], axis=1)


# ------------------------------------------------------------ boosted trees


class Boosted:
    """Boosted regression trees on logistic loss, with histogram splits."""

    def __init__(self, trees: int = 30, depth: int = 4, rate: float = 0.3, bins: int = 16):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, threshold, value by heap position

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        f = np.zeros(len(y))
        inner = 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p) + 1e-6
            feat, thr, val = np.full(inner, -1), np.zeros(inner), np.zeros(2 * inner + 1)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                if len(rows) < 20:
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-3, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, j]
                    gl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 1) | (hs - hl < 1)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
                if best[1] >= 0:
                    feat[node], thr[node] = best[1], edges[best[1]][best[2]]
                    right = x[rows, best[1]] > thr[node]
                    at[rows] = 2 * node + 1 + right
            for leaf in np.unique(at):
                rows = at == leaf
                val[leaf] = self.rate * g[rows].sum() / (h[rows].sum() + 1)
            self.model.append((feat, thr, val))
            f += val[at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.zeros(len(x))
        every = np.arange(len(x))
        for feat, thr, val in self.model:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inside = at < len(feat)
                j = np.where(inside, feat[np.minimum(at, len(feat) - 1)], -1)
                go = j >= 0
                right = x[every, np.maximum(j, 0)] > thr[np.minimum(at, len(feat) - 1)]
                at = np.where(go, 2 * at + 1 + right, at)
            f += val[at]
        return f


def decode(parents: list[int], logit: np.ndarray) -> list[bool]:
    """The likeliest labelling in which all that is below a dropped node is dropped."""
    n = len(parents)
    best_keep = (-np.logaddexp(0, -logit)).tolist()  # log p, then of the subtree
    all_drop = (-np.logaddexp(0, logit)).tolist()  # log (1 - p), then of the subtree
    for k in range(n - 1, -1, -1):
        p = parents[k]
        if p >= 0:
            all_drop[p] += all_drop[k]
            best_keep[p] += max(best_keep[k], all_drop[k])
    out = [False] * n
    for k in range(n):
        p = parents[k]
        out[k] = (p < 0 or out[p]) and best_keep[k] > all_drop[k]
    return out


def kept_text(page: Page, keep: list[bool]) -> str:
    lines: list[str] = []
    held: list[str] = []
    last = -1
    for tag, text, block, k in zip(page.tag, page.text, page.block, keep, strict=True):
        if k and tag == "#text":
            if block != last and held:
                lines.append(" ".join("".join(held).split()))
                held = []
            last = block
            held.append(text)
    lines.append(" ".join("".join(held).split()))
    return "\n".join(x for x in lines if x)


# ------------------------------------------------------------ training pages


def training_page(rng: random.Random, odd: bool = True) -> str:
    """A page whose main text sits in elements with the attribute ``data-main``.

    ``odd`` pages may have no element around the main text, wrappers and bodies named for noise,
    forms around everything, headlines in headers, and comments that no name tells.
    """
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def words(lo: int, hi: int) -> str:
        w = [rng.choice(vocabulary) for _ in range(rng.randint(lo, hi))]
        marks = rng.choice([",", ",", ".", " |", "!!", ""])
        return " ".join(x + (marks if rng.random() < 0.08 else "." if rng.random() < 0.06 else "") for x in w).capitalize()

    def link(lo: int = 1, hi: int = 3) -> str:
        return f'<a href="/{rng.choice(vocabulary)}">{words(lo, hi)}</a>'

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 10)))
        return rng.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="{rng.choice(["menu", "navbar", "main-nav", "topmenu"])}"><ul>{items}</ul></div>', f'<ul id="nav">{items}</ul>', f'<div role="navigation">{"".join(link() for _ in range(6))}</div>'])

    def advert() -> str:
        name = rng.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-box", "adsbox"])
        return rng.choice([f'<div class="{name}">{words(4, 30)}</div>', f'<aside class="{name}">{words(4, 20)}</aside>', f'<div id="{name}"><p>{words(5, 40)}</p>{link()}</div>'])

    def notice() -> str:
        return f'<div class="{rng.choice(["cookie-notice", "cookie-consent", "notice", "alert", "newsletter", "subscribe", "gdpr", "popup"])}"><p>{words(5, 30)}</p><button>{words(1, 2)}</button></div>'

    def side() -> str:
        body = "".join(rng.choice([f"<h3>{words(1, 4)}</h3>", f"<p>{words(5, 30)}</p>", f"<ul><li>{link(2, 6)}</li><li>{link(2, 6)}</li></ul>"]) for _ in range(rng.randint(1, 5)))
        return rng.choice([f"<aside>{body}</aside>", f'<div class="sidebar">{body}</div>', f'<div id="sidebar" class="widget">{body}</div>', f'<section class="related">{body}</section>'])

    def form() -> str:
        return f'<form action="/s"><label>{words(1, 4)}</label><input name="q"><p>{words(3, 14)}</p><button>{words(1, 2)}</button></form>'

    def comments() -> str:
        n = rng.randint(1, 8)
        if odd and rng.random() < 0.4:  # no name tells them: a heading and what follows it
            count = f"{n} " if rng.random() < 0.6 else ""
            said = rng.choice(["Comments", "comments", "Comments:", "replies", "Kommentare", "comentarios", "commentaires"] if count else ["Comments", f"Comments ({n})", "Kommentare", "Comentarios", "Commentaires", "Leave a reply"])
            head = rng.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>", "<p><b>{}</b></p>", "<div>{}</div>"]).format(count + said)
            one = rng.choice(["<p>{}</p>", "<div>{}</div>", "<div><b>" + words(1, 2) + "</b><p>{}</p></div>", "<li>{}</li>"])
            body = head + "".join(one.format(words(3, 60)) for _ in range(n))
            return rng.choice(["<div>{}</div>", "<section>{}</section>", "{}"]).format(body)
        item = lambda: rng.choice([f'<div class="comment"><b>{words(1, 2)}</b><p>{words(4, 60)}</p></div>', f'<li class="comment-item"><p>{words(4, 50)}</p></li>', f'<article class="comment"><p>{words(4, 60)}</p></article>', f'<div class="reply"><p>{words(4, 60)}</p></div>'])
        body = "".join(item() for _ in range(n))
        return rng.choice([f'<section id="comments"><h2>{words(1, 3)}</h2>{body}</section>', f'<div class="comments">{body}</div>', f'<div id="disqus_thread"><ol class="comment-list">{body}</ol></div>', f'<div class="comments"><h3>{n} Comments</h3>{body}</div>'])

    def main_block() -> str:
        r = rng.random()
        text = words(1, 120) if rng.random() < 0.8 else words(1, 6)
        if odd and rng.random() < 0.06:  # a word of noise on an element that is none
            tag, name = rng.choice(["blockquote", "blockquote", "p", "h2", "figure", "table", "ul", "pre"]), rng.choice(["reply", "alert", "notice", "share", "promo", "related", "follow", "comment", "side", "banner"])
            inner = {"ul": f"<li>{text}</li>", "table": f"<tr><td>{words(1, 9)}</td><td>{words(1, 9)}</td></tr>"}.get(tag, text)
            return f'<{tag} class="{name}">{inner}</{tag}>'
        if r < 0.55:
            return f"<p>{text}</p>"
        if r < 0.63:
            return f"<p><b>{text}<br>"
        if r < 0.70:
            return f"<p>{words(3, 40)} {link()} <em>{words(1, 5)}</em> {words(1, 30)}</p>"
        if r < 0.78:
            return f"<h2>{words(1, 8)}</h2>"
        if r < 0.84:
            return "<ul>" + "".join(f"<li>{words(1, 20)}</li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if r < 0.88:
            return f"<blockquote><p>{words(4, 40)}</p></blockquote>"
        if r < 0.92:
            return "<table>" + "".join(f"<tr><td>{words(1, 4)}</td><td>{words(1, 8)}</td></tr>" for _ in range(rng.randint(1, 5))) + "</table>"
        if r < 0.95:
            return f"<pre>{words(3, 30)}</pre>"
        if r < 0.97:
            return f"<div>{words(3, 60)}</div>"
        return f"<figure><img src='x.png'><figcaption>{words(2, 12)}</figcaption></figure>"

    title = words(1, 12)
    bare = odd and rng.random() < 0.12  # no element around the main text, perhaps nothing but divisions
    plain = bare and rng.random() < 0.6
    head1 = f"<div>{title}</div>" if plain else f"<h2>{title}</h2>" if odd and rng.random() < 0.05 else f"<h1>{title}</h1>"
    if odd and not plain and rng.random() < 0.3:
        line = rng.choice(["", f"<p>{words(1, 6)}</p>", f"<span>{words(1, 4)}</span>"])
        head1 = rng.choice(["<header>{}</header>", '<div class="article-header">{}</div>', '<div class="post-header">{}</div>', '<header class="entry-header">{}</header>', '<div class="header">{}</div>', "<div>{}</div>", "<hgroup>{}</hgroup>"]).format(head1 + line)
    parts = [head1] + [f"<div>{words(5, 90)}</div>" if plain else main_block() for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14, 30]))]
    noise = [advert, notice, side, form, lambda: f'<div class="{rng.choice(["share", "social", "tags", "related"])}">{link()} {link()}</div>']

    def marked(html: str) -> str:
        return re.sub(r"<([a-z0-9]+)", r"<\1 data-noise", html, count=1) if html.startswith("<") else html

    def marked_all(html: str) -> str:
        """Every outermost element marked, for noise that has no element around it."""
        return f"<span data-noise>{html}</span>" if not html.startswith(("<div", "<section", "<aside", "<form")) else marked(html)

    inside = list(parts)
    if not bare and rng.random() < 0.3:
        inside.insert(rng.randint(1, len(inside)), f"<!--x-->{marked(rng.choice(noise)())}")
    body = "".join(inside)
    if not bare and rng.random() < 0.15:
        body += "</b>" * 3 + marked_all(comments())
    if bare:
        article = "".join(re.sub(r"<([a-z0-9]+)", r"<\1 data-main", x, count=1) for x in parts)
    else:
        wrap = rng.choice(["article", "article", "article", "main", 'div class="content"', 'div class="post"', 'div id="main"', 'div class="entry-content"', 'div class="story-body"', 'div id="content"', "section", "div"])
        article = f"<{wrap} data-main>{body}</{wrap.split()[0]}>"
    states = ["has-sidebar", "no-sidebar", "comments-open", "search-enabled", "with-footer", "banner-on", "ad-free", "has-comments", "notice", "main has-comments", "sidebar", "promo", "header-fixed", "content with-menu"]
    if not bare and rng.random() < 0.3:
        article = f'<div class="{rng.choice(["wrapper", "container", "page", "row", "main"])}">{article}{side() if rng.random() < 0.4 else ""}</div>'
    if odd and not bare and rng.random() < 0.2:
        article = rng.choice([f'<div class="{rng.choice(states)}">{{}}</div>', "<form>{}</form>", "<aside>{}</aside>", "<div>{}</div>", "<header>{}</header>"]).format(article)
    head = f"<header><a href='/'>{words(1, 3)}</a>{menu() if rng.random() < 0.5 else ''}</header>" if rng.random() < 0.4 else ""
    foot = rng.choice([f"<footer>&copy; {words(1, 3)} &middot; {words(2, 20)}</footer>", f'<div class="footer"><p>{words(2, 30)}</p>{link()}</div>', f'<div id="footer">{menu()}<p>{words(2, 12)}</p></div>', f"<footer><p>{words(2, 30)}</p></footer>"])
    before = "".join(f() for f in rng.sample([menu, advert, notice, form, side], rng.randint(0, 3)))
    after = "".join(f() for f in rng.sample([comments, advert, side, form, notice], rng.randint(0, 3)))
    body = f"{head}{before}{article}{after}{foot}"
    if odd and rng.random() < 0.15:
        body = f'<form method="post" action="./page.aspx">{body}</form>'
    named = f' class="{rng.choice(states)} {rng.choice(states)}"' if odd and rng.random() < 0.3 else ""
    shown = rng.choice([title, title, f"{title} | {words(1, 3)}", words(1, 9)])
    return f"<!DOCTYPE html><html><head><title>{shown}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{named}>{body}</body></html>"


def training_rows(pages: int, seed: int, odd: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of generated pages, of which a share is ``odd``."""
    rng = random.Random(seed)
    parsed, labels = [], []
    for _ in range(pages):
        # marks move into an attribute that the parser reads, and out of the tokens again
        html = training_page(rng, rng.random() < odd).replace(" data-main", " itemprop='zzmain'").replace(" data-noise", " itemprop='zznoise'")
        page = parse(html)
        y = np.zeros(len(page.tag))
        for k, tokens in enumerate(page.tokens):
            p = page.parent[k]
            y[k] = 1.0 if "zzmain" in tokens else 0.0 if "zznoise" in tokens else y[p] if p >= 0 else 0.0
            if tokens:
                page.tokens[k] = tokens - {"zzmain", "zznoise"}
        for k in range(len(y) - 1, -1, -1):  # what stands above main text is kept as well
            if y[k] and page.parent[k] >= 0:
                y[page.parent[k]] = 1.0
        y[(np.array(page.above) & _UP["#silent"]) > 0] = 0.0
        parsed.append(page)
        labels.append(y)
    return features(parsed), np.concatenate(labels)


@functools.lru_cache(maxsize=1)
def fitted(pages: int = 500, seed: int = 5) -> Boosted:
    return Boosted().fit(*training_rows(pages, seed))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    """The main text of each page."""
    parsed = [parse(p or "") for p in pages]
    logits = model.raw(features(parsed)) if any(p.tag for p in parsed) else np.zeros(0)
    out, at = [], 0
    for p in parsed:
        n = len(p.tag)
        logit = np.where(np.array(p.above, dtype=np.int64) & _UP["#silent"], -30.0, logits[at : at + n])
        at += n
        out.append(kept_text(p, decode(p.parent, logit)))
    return out


def extract_pages(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    bounded_batches(pages.sparkSession, 128)
    trees = model or fitted()
    schema = T.StructType([*pages.select("page_id", "url").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = extract(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", pages["html"].cast("string").alias("_html")).mapInArrow(run, schema)


def op6_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
