"""HTML main-text extraction with a linear-chain conditional random field.

A page becomes the sequence of its DOM leaf blocks: runs of text between block-level tags, each with its
chain of ancestors. Features are the ancestors' tags and attribute words and the block's text (length,
links, punctuation, place). The CRF has two labels, content and boilerplate; it is trained on the driver on
a bounded number of labelled pages (`n_pages`, a parameter) by gradient ascent on the conditional
likelihood, and every page is decoded by Viterbi in an Arrow function, without a shuffle.

No table labels its pages, so the labelled ones come from `labelled_pages`: page layouts written here
(semantic tags, class-named and bare div layouts, notices, adverts and asides inside articles, reader
comments, forms) around invented text, with each block's label known. Pass `pages` to train on others.

Defined results: null, empty or text-free html gives the empty text; scripts, styles, heads, form controls
and comments never count as text; a null id or url is passed through; repeated rows are each extracted;
extra columns are ignored; an empty table gives an empty result; ties in decoding go to content.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: HTML's element classes, fixed by its standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SCRIPT = frozenset("script style".split())
ONCE = frozenset("textarea title iframe select button".split())  # hidden too, and never inside their own kind
NESTED = frozenset("noscript template svg object math".split())
FOREIGN = frozenset("svg math".split())  # the only ones that a slash before > closes
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
DEPTH = 512  # browsers flatten what is nested deeper

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>?|</(?![a-zA-Z])[^>]*>?", re.S)
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
GAP, ATTRIBUTE, EQUALS, BARE = re.compile(r"[\s/]*"), re.compile(r"=?[^\s/>=]*"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*")
HEAD_END = re.compile(r"</head\s*>|<body\b", re.I)
WORDS = re.compile(r"[a-z]+")
NAMING = frozenset(("class", "id", "role"))
SENTENCE = re.compile(r"[.!?…][\"'”’)]*$")

CONTENT, OTHER = 0, 1


def _attributes(page: str, at: int) -> tuple[list[str], bool, int]:
    """Values of the naming attributes, whether a slash closes the tag, and its end, for a tag whose name ends at `at`.

    Quotes count only where a value begins, as in HTML. A quote that is never closed is a plain character.
    """
    found, n = [], len(page)
    while True:
        at = GAP.match(page, at).end()
        if at >= n or page[at] == ">":
            return found, page[at - 1] == "/", min(at + 1, n)
        m = ATTRIBUTE.match(page, at)
        name, at = m[0].lower(), m.end()
        if not (m := EQUALS.match(page, at)):
            continue
        at = m.end()
        quote = page[at : at + 1]
        end = page.find(quote, at + 1) if quote in ("'", '"') else -1
        if end >= 0:
            value, at = page[at + 1 : end], end + 1
        else:
            m = BARE.match(page, at)
            value, at = m[0], m.end()
        if name in NAMING:
            found.append(value)


class _Ends:
    """Where elements that hide their content begin and end; each name is looked for once a page."""

    def __init__(self, page: str):
        self.page, self.known = page, {}

    def _next(self, name: str, closing: bool, at: int) -> tuple[int, int] | None:
        if (name, closing) not in self.known:
            tag = re.compile(rf"<{'/' if closing else ''}{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)
            spans = [m.span() for m in tag.finditer(self.page)]
            self.known[name, closing] = [a for a, _ in spans], spans
        starts, spans = self.known[name, closing]
        k = bisect_left(starts, at)
        return spans[k] if k < len(spans) else None

    def after(self, name: str, at: int) -> int | None:
        """The end of the hidden content that begins at `at`; None for an element that nothing closes."""
        end = self._next(name, True, at)
        if end is None:
            return len(self.page) if name in SCRIPT else None
        if name in ONCE and (again := self._next(name, False, at)) and again < end:
            return None
        return end[1]


def leaf_blocks(page: str) -> list[tuple[str, list[tuple[str, frozenset]], int]]:
    """(text, ancestors as (tag, attribute words), characters inside links) of each leaf block in page order.

    One pass, linear in the page. Script and style run to their end tag or the page's end; other hidden elements
    that nothing closes hide nothing.
    """
    out, stack, parts, links, linked, at = [], [], [], 0, 0, 0
    ends, headed = _Ends(page), False

    def text(upto):
        nonlocal linked
        if upto > at:
            part = html.unescape(page[at:upto])
            parts.append(part)
            linked += len(part) * (links > 0)

    def flush():
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, [x for x in stack if x[0] not in INLINE], min(linked, len(text))))
        parts, linked = [], 0

    look = 0
    while (start := page.find("<", look)) >= 0:
        tag = NAME.match(page, start)
        if not tag:
            other = COMMENT.match(page, start)
            look = other.end() if other else start + 1
            if other:
                text(start)
                at = look
            continue
        text(start)
        values, slash, at = _attributes(page, tag.end())
        look, name = at, tag[2].lower()
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
            continue
        if name == "head":
            if not headed and (end := HEAD_END.search(page, at)):
                at = look = end.end() if end[0][1] == "/" else end.start()
            headed = True  # a page has one head
            continue
        if name in SCRIPT or name in ONCE or name in NESTED:
            end = None if name in FOREIGN and slash else ends.after(name, at)
            at = look = at if end is None else end
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
            while stack and stack[-1][0] in INLINE:
                stack.pop()
            if stack and (stack[-1][0] == "p" or name in ("li", "td", "tr", "dd", "dt", "option") and stack[-1][0] == name):
                stack.pop()
        links += name == "a"
        if name not in VOID and len(stack) < DEPTH:
            stack.append((name, frozenset(w for x in values for w in WORDS.findall(x.lower()))))
    text(len(page))
    flush()
    return out


def features(blocks: list) -> list[list[str]]:
    """The names of each block's features."""
    out, title_seen, before = [], False, None
    for i, (text, above, linked) in enumerate(blocks):
        tags, n = [t for t, _ in above], text.count(" ") + 1
        f = {"bias", f"own:{tags[-1] if tags else ''}", f"place:{min(4, 5 * i // len(blocks))}"}
        f |= {f"tag:{t}" for t in tags} | {f"word:{w}" for _, ws in above for w in ws}
        f.add(f"words:{sum(n > x for x in (2, 5, 10, 20, 40, 80))}")
        share = linked / len(text)
        f.add(f"links:{sum(share > x for x in (0.0, 0.3, 0.7))}")
        f.add(f"ends:{bool(SENTENCE.search(text))}")
        f.add(f"commas:{min(2, text.count(','))}")
        if "©" in text:
            f.add("copyright")
        f.add(f"titled:{title_seen}")
        title_seen = title_seen or "h1" in tags
        f.add(f"sibling:{before is not None and before == above[:-1]}")
        before = above[:-1]
        out.append(sorted(f))
    return out


# Labelled pages

_SYLLABLES = "an be co da el fi go ha in jo ka le mi no or pa qu re sa ti un ve wo xi yo za th er st on".split()


class _Page:
    """One labelled page: markup with the labels of its leaf blocks, in order."""

    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []

    def words(self, low: int, high: int, end: str = "") -> str:
        r = self.rng
        w = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) + ("," if r.random() < 0.06 else "") for _ in range(r.randint(low, high))]
        return " ".join(w).capitalize().rstrip(",") + end

    def raw(self, s: str) -> None:
        self.parts.append(s)

    def block(self, markup: str, label: int) -> None:
        self.parts.append(markup)
        self.labels.append(label)

    def wrap(self, kinds: list[str], fill) -> None:
        """fill() inside an element; kinds like 'nav' or 'div.menu'."""
        tag, _, word = self.rng.choice(kinds).partition(".")
        name = self.rng.choice(['class="{}"', 'id="{}"', 'class="{} box"', 'class="site-{}"']).format(word) if word else ""
        self.raw(f"<{tag} {name}>" if name else f"<{tag}>")
        fill()
        self.raw(f"</{tag}>")

    def items(self, link: bool = True) -> None:
        self.raw("<ul>")
        for _ in range(self.rng.randint(2, 7)):
            w = self.words(1, 4)
            self.block(f'<li><a href="/x">{w}</a></li>' if link else f"<li>{w}</li>", OTHER)
        self.raw("</ul>")

    def lines(self, low: int, high: int, most: int, tag: str = "p") -> None:
        for _ in range(self.rng.randint(1, most)):
            w = self.words(low, high, self.rng.choice([".", ".", "", "!"]))
            self.block(f"<{tag}>{w}</{tag}>" if tag else w, OTHER)

    def boilerplate(self, kind: str) -> None:
        r = self.rng
        if kind == "nav":
            self.wrap(["nav", "nav", "div.menu", "div.nav", "div.navbar", "ul.breadcrumb", "div.navigation"], self.items)
        elif kind == "header":
            self.wrap(["header", "div.header", "div.masthead", "div.topbar"], lambda: (self.lines(1, 8, 2, r.choice(["p", "div", "h2"])), self.items()))
        elif kind == "footer":
            c = r.choice(["&copy; ", "&copy; 2020 ", "", "Copyright "])
            def fill():
                self.block(r.choice(["<p>{}</p>", "{}"]).format(c + self.words(3, 25, r.choice([".", ""]))), OTHER)
                if r.random() < 0.4:
                    self.items()
            self.wrap(["footer", "footer", "footer", "div.footer", "div.copyright", "div.legal"], fill)
        elif kind == "ad":
            self.wrap(["div.ad", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.promo", "div.sponsored", "ins.ad", "aside.ad"], lambda: self.lines(2, 40, 2, r.choice(["", "p"])) if r.random() < 0.5 else self.block(self.words(2, 40, "."), OTHER))
        elif kind == "side":
            self.wrap(["aside", "aside", "div.sidebar", "div.widget", "div.related", "section.related", "aside.sidebar"], lambda: (self.lines(2, 30, 3), self.items() if r.random() < 0.6 else None))
        elif kind == "notice":
            self.wrap(["div.cookie", "div.notice", "div.consent", "div.alert", "div.popup", "div.newsletter", "div.subscribe", "section.notice", "div.gdpr", "div.share"], lambda: self.lines(3, 30, 2, r.choice(["p", ""]) or "p"))
        elif kind == "form":
            self.wrap(["form", "form.search", "form.login", "form.contact"], lambda: (self.lines(1, 12, 2, "p"), self.raw('<input name="q"><button>Go</button>')))
        elif kind == "comments":
            def fill():
                if r.random() < 0.5:
                    self.block("<h3>Comments</h3>", OTHER)
                for _ in range(r.randint(1, 5)):
                    self.wrap(["div.comment", "li.comment", "article.comment", "div.reply", "p", "div"], lambda: self.block(self.words(3, 60, "."), OTHER))
            self.wrap(["section.comments", "div.comments", "section.discussion", "div.responses", "ol.comments", "div.replies"], fill)

    def article(self) -> None:
        r = self.rng
        named = r.random() < 0.85
        tags = ["article", "article", "article", "main", "main.content", "div.content", "div.article", "div.post", "div.entry", "section.story", "div.main"] if named else ["div", "section"]
        def fill():
            if r.random() < 0.8:
                self.block(f"<h1>{self.words(2, 12)}</h1>", CONTENT)
            for _ in range(r.randint(1, 12)):
                x = r.random()
                if x < 0.72:
                    w = self.words(*r.choice([(1, 6), (5, 30), (20, 90), (60, 200)]), r.choice([".", ".", ".", ""]))
                    self.block(r.choice(["<p>{}</p>", "<p>{}</p>", "<p><b>{}<br><p>", "<div>{}</div>", "<p>{}"]).format(w), CONTENT)
                elif x < 0.80:
                    self.block(f"<h{r.randint(2, 4)}>{self.words(1, 8)}</h2>", CONTENT)
                elif x < 0.86:
                    self.raw("<ul>")
                    for _ in range(r.randint(1, 5)):
                        self.block(f"<li>{self.words(1, 25, r.choice(['.', '']))}</li>", CONTENT)
                    self.raw("</ul>")
                elif x < 0.90:
                    self.block(f"<{r.choice(['blockquote', 'pre', 'figcaption', 'td'])}>{self.words(2, 30)}</div>", CONTENT)
                elif x < 0.93:
                    self.block(f'<p>{self.words(3, 20)} <a href="/y">{self.words(1, 5)}</a> {self.words(3, 30, ".")}</p>', CONTENT)
                else:
                    self.boilerplate(r.choice(["ad", "side", "notice", "form"]))
            if r.random() < 0.25:
                self.boilerplate("comments")
        self.wrap(tags, fill)

    def make(self) -> tuple[str, list[int]]:
        r = self.rng
        self.raw("<!DOCTYPE html><html><head><title>x</title><style>p{}</style></head><body>")
        for kind, p in (("notice", 0.3), ("header", 0.4), ("nav", 0.8), ("ad", 0.5), ("form", 0.2), ("side", 0.25)):
            if r.random() < p:
                self.boilerplate(kind)
        self.article()
        for kind, p in (("comments", 0.3), ("side", 0.4), ("ad", 0.3), ("form", 0.2), ("nav", 0.2), ("notice", 0.2), ("footer", 0.85)):
            if r.random() < p:
                self.boilerplate(kind)
        self.raw("</body></html>")
        return "".join(self.parts), self.labels


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[int]]]:
    """n pages as (html, labels of the leaf blocks)."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        page, labels = _Page(rng).make()
        if len(leaf_blocks(page)) == len(labels):
            out.append((page, labels))
    return out


# The model


class Crf:
    """Two labels; weights[f, y] of feature f, and a 2x2 table of transitions."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        return np.array([self.weights[[self.names[f] for f in fs if f in self.names]].sum(0) for fs in feats]).reshape(-1, 2)

    def viterbi(self, feats: list[list[str]]) -> list[int]:
        (a, b), (c, d) = self.moves.tolist()
        back, x, y = [], 0.0, 0.0
        for i, (u, v) in enumerate(self.scores(feats).tolist()):
            if i:
                back.append((x + a < y + c, x + b < y + d))
                x, y = max(x + a, y + c), max(x + b, y + d)
            x, y = x + u, y + v
        path = [CONTENT if x >= y else OTHER]
        for pair in reversed(back):
            path.append(int(pair[path[-1]]))
        return path[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> Crf:
    """Maximum conditional likelihood by Adam; forward-backward runs over all pages at once, padded to the longest."""
    feats, names = [features(leaf_blocks(p)) for p, _ in pages], {}
    for fs in feats:
        for f in fs:
            for x in f:
                names.setdefault(x, len(names))
    n, longest = len(pages), max(map(len, feats))
    gold, live = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    at, of = [], []
    for i, (fs, (_, labels)) in enumerate(zip(feats, pages)):
        gold[i, : len(labels)], live[i, : len(labels)] = labels, True
        for j, f in enumerate(fs):
            at += [i * longest + j] * len(f)
            of += [names[x] for x in f]
    at, of = np.array(at), np.array(of)
    theta = np.zeros((len(names) + 2, 2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    true = np.zeros((n, longest, 2))
    true[np.arange(n)[:, None], np.arange(longest), gold] = live
    pairs = np.einsum("ita,itb->ab", true[:, :-1], true[:, 1:])
    for step in range(1, rounds + 1):
        w, moves = theta[:-2], theta[-2:]
        emit = np.stack([np.bincount(at, w[of, y], n * longest).reshape(n, longest) for y in (0, 1)], 2)
        fwd, bwd = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        fwd[:, 0] = emit[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.logaddexp.reduce(fwd[:, t - 1, :, None] + moves, 1) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            nxt = np.logaddexp.reduce(moves + (emit[:, t + 1] + bwd[:, t + 1])[:, None], 2)
            bwd[:, t] = np.where(live[:, t + 1, None], nxt, 0.0)
        total = np.logaddexp.reduce(fwd + bwd, 2)
        one = np.exp(fwd + bwd - total[..., None]) * live[..., None]
        two = np.exp(fwd[:, :-1, :, None] + moves + (emit + bwd)[:, 1:, None, :] - total[:, 1:, None, None]) * live[:, 1:, None, None]
        miss = (true - one).reshape(-1, 2)
        grad = np.vstack([np.stack([np.bincount(of, miss[at, y], len(names)) for y in (0, 1)], 1), pairs - two.sum((0, 1))]) / n - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(names, theta[:-2], theta[-2:])


@lru_cache(maxsize=4)
def default_model(n_pages: int = 300, seed: int = 7) -> Crf:
    return train(labelled_pages(n_pages, seed))


def main_text(page: str | None, model: Crf) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    return "\n".join(b[0] for b, y in zip(blocks, model.viterbi(features(blocks))) if y == CONTENT)


def extract(pages: DataFrame, model: Crf | None = None, n_pages: int = 300) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model(n_pages))  # a few hundred features

    def run(batches):
        model = shared.value
        for b in batches:
            texts = [main_text(x, model) for x in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
