"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text between block boundaries, each with a hidden label, content or not. A node's
potential is a linear function of what is seen of it: tag, class, id and role words, length, punctuation, share of linked text, place on
the page. A potential on each parent-child pair says which labels go together for this kind of child. The exact marginals of
all labels come from sum-product message passing, once up from the leaves and once down from the root, for all pages of a
block at a time, level by level. The text runs whose marginal is at least a half are the text of the page.

The model is trained on labelled pages, HTML in which the attribute MARK names what is content ("1") and what is not ("0") from
an element downwards; the gradient is the difference of labels and marginals. `labelled_pages` writes such pages: layouts drawn
from a seed, with meaningless words, some without any telling name. LABELLED pages, at most, are learned from; the weights are
2**WIDTH numbers whatever the input, and go to the workers with the function.

Pages are parsed by Python's own HTML tokenizer in the tasks, a few megabytes of source at a time. Unclosed and stray tags are
accepted: a block start closes an open paragraph, items and cells close their like, an end tag without its start closes nothing. Character
references are decoded, white space in a block becomes one space, blocks are joined by a line feed in page order. Scripts, styles, embedded
objects, form controls, the head and comments have no text at all. Text is only ever left out by label; nothing is cut.

A null or empty page has an empty text. Nesting of any depth is handled without recursion. Null ids, repeated rows and other columns make
no difference: a row in gives a row out.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "data-main"
WIDTH = 14
LABELLED = 600
ROUNDS = 150
#: Characters of source whose pages are labelled at a time.
SOURCE_CHARS = 2_000_000

#: Elements of HTML by what they do to text.
SILENT = frozenset("script style noscript template head title iframe object embed svg math canvas audio video select textarea "
                   "button datalist input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q "
                   "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
KEEPS_OPEN = frozenset("ul ol dl table".split())

_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STOP = re.compile(r"[.!?,;:…。]")


class Page(HTMLParser):
    """The nodes of a page in document order: parents before children, -1 above the root."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.names, self.marks = [-1], [""], [()], [None]
        self.texts: list[str | None] = [None]
        self.linked = [0]
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: dict[str, int] = {}
        self.silent = self.links = 0
        self.run: list[str] = []
        self.run_linked = 0
        self.run_names: list[str] = []
        self.feed(source)
        self.close()
        self._end_run()

    def _node(self, tag: str, names: tuple[str, ...], mark: str | None = None, text: str | None = None, linked: int = 0) -> int:
        self.parent.append(self.stack[-1][1])
        self.tag.append(tag)
        self.names.append(names)
        self.marks.append(mark)
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1

    def _end_run(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            if text:
                self._node("#text", tuple(self.run_names), None, text, self.run_linked)
            self.run, self.run_linked, self.run_names = [], 0, []

    def _pop(self) -> None:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"

    def _close_to(self, depth: int) -> None:
        """Close what is open above the first `depth` elements."""
        if any(tag not in INLINE for tag, _ in self.stack[depth:]):
            self._end_run()
        while len(self.stack) > depth:
            self._pop()

    def _above(self, tags: tuple[str, ...], stop: frozenset[str] | None) -> int | None:
        """Place of the last open one of `tags`, not looking beyond `stop` (None: beyond inline elements)."""
        if not any(self.open.get(t) for t in tags):
            return None
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in tags:
                return i
            if (tag not in INLINE) if stop is None else (tag in stop):
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            if tag in INLINE:
                self.run.append(" ")
            else:
                self._end_run()
            return
        found = dict(attrs)
        names = tuple(n.lower() for key in ("class", "id", "role", "itemprop", "aria-label") for n in _NAMES.findall(found.get(key) or ""))
        if tag in INLINE:
            self.run_names += names
            node = self.stack[-1][1]
        else:
            if (at := self._above(("p",), None)) is not None:
                self._close_to(at)
            while tag in CLOSES and (at := self._above(CLOSES[tag], KEEPS_OPEN)) is not None:
                self._close_to(at)
            self._end_run()
            node = self._node(tag, names, found.get(MARK))
        self.stack.append((tag, node))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        at = self._above((tag,), None if tag in INLINE else frozenset())
        if at is not None:
            self._close_to(at)
        elif tag not in INLINE:
            self._end_run()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.run.append(data)
            if self.links:
                self.run_linked += len(data)


def _feature(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << WIDTH) - 1)


class _Features(dict):
    def __missing__(self, name: str) -> int:
        self[name] = _feature(name)
        return self[name]


def _grade(x: int) -> int:
    return min(x.bit_length(), 14)


def features(page: Page, known: dict[str, int]) -> list[list[int]]:
    """Hashed features of each node."""
    n = len(page.parent)
    chars, links, stops, runs = ([0] * n for _ in range(4))
    for i in range(n - 1, 0, -1):
        text = page.texts[i]
        if text is not None:
            chars[i], links[i], stops[i], runs[i] = len(text), min(page.linked[i], len(text)), len(_STOP.findall(text)), 1
        up = page.parent[i]
        for values in (chars, links, stops, runs):
            values[up] += values[i]
    whole, before, out = max(1, chars[0]), 0, []
    for i in range(n):
        tag, up = page.tag[i], page.parent[i]
        share = -1 if not chars[i] else int(4 * links[i] / chars[i] + 0.5)
        names = ["bias", f"t {tag}", f"p {page.tag[up] if up >= 0 else ''} {tag}", f"share {tag == '#text'} {share}",
                 f"at {tag == '#text'} {4 * before // whole}"]
        if tag == "#text":
            text = page.texts[i]
            names += [f"chars {_grade(chars[i])}", f"stops {_grade(stops[i])}", f"end {text[-1] in '.!?…'}",
                      f"long {_grade(chars[i])} {share > 0}", f"sign {any(s in text for s in '©®|»›')}", f"most {8 * chars[i] // whole}"]
            before += chars[i]
        else:
            names += [f"below {_grade(chars[i])}", f"most below {4 * chars[i] // whole}", f"runs {_grade(runs[i])}",
                      f"mean {_grade(chars[i] // max(1, runs[i]))}", f"stops below {_grade(stops[i] * 8 // max(1, runs[i]))}"]
        names += [f"c {x}" for x in set(page.names[i])]
        out.append([known[x] for x in names])
    return out


class Forest:
    """The nodes of many pages in one sequence, with what a level-by-level pass needs."""

    def __init__(self, pages: Iterable[Page]):
        known = _Features()
        parent, kind, owner, feature, node, level = [], [], [], [], [], []
        for k, page in enumerate(pages):
            base = len(parent)
            depth = [0] * len(page.parent)
            for i, row in enumerate(features(page, known)):
                up = page.parent[i]
                if up >= 0:
                    depth[i] = depth[up] + 1
                parent.append(base + up if up >= 0 else -1)
                kind.append(known[f"edge {page.tag[i]}"])
                feature += row
                node += [base + i] * len(row)
            level += depth
            owner += [k] * len(depth)
        self.parent, self.kind, self.owner = np.array(parent, np.int64), np.array(kind, np.int64), np.array(owner, np.int64)
        self.feature, self.node = np.array(feature, np.int64), np.array(node, np.int64)
        level = np.array(level, np.int64)
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)

    def potentials(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(node potentials of both labels, pair potentials [node, parent's label, label])."""
        own = np.zeros((len(self.parent), 2))
        own[:, 1] = np.bincount(self.node, weights[self.feature], len(self.parent))
        return own, pairs[self.kind] + pairs[_feature("edge")]


def marginals(forest: Forest, own: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals of each label, and of each (parent's label, label) pair, by messages up and down the trees."""
    up = own.copy()
    message = np.zeros_like(own)
    for level in forest.levels[:0:-1]:
        message[level] = np.logaddexp.reduce(pair[level] + up[level][:, None, :], axis=2)
        np.add.at(up, forest.parent[level], message[level])
    down = np.zeros_like(own)
    both = np.zeros((len(own), 2, 2))
    for level in forest.levels[1:]:
        at = forest.parent[level]
        outside = up[at] + down[at] - message[level]
        joint = pair[level] + outside[:, :, None] + up[level][:, None, :]
        down[level] = np.logaddexp.reduce(pair[level] + outside[:, :, None], axis=1)
        both[level] = joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None]
    belief = up + down
    one = np.exp(belief - np.logaddexp.reduce(belief, axis=1)[:, None])
    both = np.exp(both)
    if len(forest.levels):
        both[forest.levels[0]] = 0
    return one, both


def labels(page: Page) -> list[int]:
    """What the marks say of each node: the nearest mark above it, and for those above all marks nothing is content."""
    out = []
    for i, up in enumerate(page.parent):
        mark = page.marks[i]
        out.append(int(mark == "1") if mark is not None else out[up] if up >= 0 else 0)
    return out


def learn(sources: list[str], rounds: int = ROUNDS, penalty: float = 1e-5, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pair potentials) by gradient steps on the likelihood of the labels of marked pages."""
    pages = [Page(s) for s in sources]
    forest, y = Forest(pages), np.array([v for p in pages for v in labels(p)], np.int64)
    size, n = 1 << WIDTH, max(1, len(y))
    weights, pairs = np.zeros(size), np.zeros((size, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((len(y), 2, 2))
    seen[child, y[forest.parent[child]], y[child]] = 1
    steps = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, pairs)]
    for k in range(1, rounds + 1):
        one, both = marginals(forest, *forest.potentials(weights, pairs))
        missing = seen - both
        slope = [np.bincount(forest.feature, (y - one[:, 1])[forest.node], size), np.zeros_like(pairs)]
        np.add.at(slope[1], forest.kind[child], missing[child])
        slope[1][_feature("edge")] += missing[child].sum(axis=0)
        for p, g, (m, v) in zip((weights, pairs), slope, steps):
            g = g / n - penalty * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return weights, pairs


def main_texts(sources: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    pages = [Page(s or "") for s in sources]
    forest = Forest(pages)
    one, _ = marginals(forest, *forest.potentials(*model))
    out, base = [], 0
    for page in pages:
        out.append("\n".join(t for i, t in enumerate(page.texts) if t is not None and one[base + i, 1] >= 0.5))
        base += len(page.parent)
    return out


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], html: str = "html", text: str = "text") -> DataFrame:
    """The columns of pages but `html`, and `text`; an input column of that name is replaced."""
    rest = [c for c in pages.columns if c not in (html, text)]
    plan = pages.select(*rest, F.col(html).cast("string").alias(html))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plan.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(len(rest))), 0).to_numpy(zero_copy_only=False)
            start, held = 0, 0
            for i in range(batch.num_rows):
                held += sizes[i]
                if held >= SOURCE_CHARS or i == batch.num_rows - 1:
                    part = batch.slice(start, i + 1 - start)
                    made = main_texts(part.column(len(rest)).to_pylist(), model)
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.string())], [*rest, text])
                    start, held = i + 1, 0

    return plan.mapInArrow(run, f"{shape}, `{text}` string" if rest else f"`{text}` string")


# Labelled pages: layouts of our own with meaningless words.

_SYLLABLES = "ba ko ri tu me sa lo ven dir pol gan tes mi hur ja ne qui os ar el".split()
_TELLING = {
    "head": "header top masthead branding site-header page-head topbar logo hero-bar",
    "menu": "nav menu navbar navigation main-menu topnav breadcrumbs links tabs pager pagination toc skip",
    "notice": "cookie cookies consent gdpr notice alert banner popup modal privacy newsletter subscribe signup paywall message warning overlay",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adsbox dfp commercial affiliate banner-ad",
    "side": "sidebar side rail widget aside related trending popular recent more-stories recommended teaser secondary tags",
    "form": "form search login contact signup-form searchbox feedback",
    "talk": "comments comment discussion replies responses thread respond reactions reader-comments disqus feedback-list",
    "foot": "footer bottom colophon copyright legal site-footer credits imprint foot",
    "main": "content article post entry story main article-body post-content entry-content text body-text page-content prose main-content",
    "share": "share social sharing follow tools buttons actions",
}
_TELLING = {k: v.split() for k, v in _TELLING.items()}


class _Writer:
    """Draws one labelled page."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.telling = rng.random() < 0.75  # else names say nothing
        self.semantic = rng.random() < 0.6  # elements such as nav and article

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            s = self.words(1, 18).capitalize()
            if r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s + r.choice([".", ".", ".", "!", "?"]))
        return " ".join(out)

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.words(1, 1)}">{self.words(low, high)}</a>'

    def box(self, kind: str, inner: str, main: int | None = 0, tags: tuple[str, ...] = ("div",)) -> str:
        r = self.rng
        tag = r.choice(tags) if self.semantic else "div"
        name = r.choice(_TELLING[kind]) if self.telling else self.words(1, 1)
        attr = r.choice([f' class="{name}"', f' id="{name}"', f' class="{self.words(1, 1)} {name}"', f' class="{name}-{self.words(1, 1)}"'])
        if tag != "div" and r.random() < 0.7 or not self.telling and r.random() < 0.5:
            attr = ""
        mark = "" if main is None else f' {MARK}="{main}"'
        return f"<{tag}{attr}{mark}>{inner}</{tag}>"

    def link_list(self, low: int = 2, high: int = 8) -> str:
        r = self.rng
        items = [self.link() for _ in range(r.randint(low, high))]
        shape = r.randint(0, 2)
        if shape == 0:
            return "<ul>" + "".join(f"<li>{i}{r.choice(['', '</li>'])}" for i in items) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(items) if shape == 1 else "".join(f"<p>{i}</p>" for i in items)

    def junk(self) -> str:
        """Something that is not content, as it stands among or beside it."""
        r = self.rng
        kind = r.choice(["advert", "notice", "share", "side", "form"])
        if kind == "form":
            return self.box("form", self.form(), 0, ("form", "div", "section"))
        inner = r.choice([self.sentences(1, 3), f"<p>{self.sentences(1, 3)}</p>", self.link_list(1, 4),
                          f"<h3>{self.words(1, 3)}</h3>{self.link_list(2, 6)}", f"{self.sentences(1, 1)} {self.link()}"])
        return self.box(kind, inner, 0, ("aside", "div", "section") if kind == "side" else ("div", "aside") if kind == "advert" else ("div", "section"))

    def form(self) -> str:
        r = self.rng
        return (f'<form action="/s" {MARK}="0"><p>{self.words(1, 6)}</p><label>{self.words(1, 3)}</label><input type="text">'
                + r.choice(["", f"<select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select>"])
                + f"{r.choice(['', self.sentences(1, 2)])}<button>{self.words(1, 2)}</button></form>")

    def paragraph(self) -> str:
        r = self.rng
        text = self.sentences(1, r.choice([1, 2, 4, 8]))
        if r.random() < 0.25:
            cut = text.find(" ") + 1
            text = text[:cut] + r.choice([self.link(1, 3), f"<b>{self.words(1, 3)}</b>", f"<em>{self.words(1, 5)}</em>", "&amp; &quot;"]) + " " + text[cut:]
        if r.random() < 0.06:
            return f"<p><b>{text}<br>"
        return f"<p>{text}" + r.choice(["</p>", "</p>", "</p>", "</p>\n", ""])

    def body(self) -> str:
        r = self.rng
        out = []
        for _ in range(r.choice([1, 2, 4, 8, 14])):
            k = r.random()
            if k < 0.7:
                out.append(self.paragraph())
            elif k < 0.78:
                out.append(f"<h{(n := r.randint(2, 4))}>{self.words(1, 8)}</h{n}>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.sentences(1, 1) if r.random() < 0.6 else self.words(1, 6)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>")
            elif k < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.94:
                out.append(f"<figure><img src='x'><figcaption>{self.sentences(1, 1)}</figcaption></figure>")
            elif k < 0.96:
                out.append(f"<pre>{self.words(4, 12)}\n  {self.words(2, 8)}</pre>")
            else:
                out.append(self.junk())
        if r.random() < 0.12:  # lines without paragraphs
            out = ["<br>".join(self.sentences(1, 4) for _ in range(r.randint(2, 6)))]
        return "".join(out)

    def article(self) -> str:
        r = self.rng
        title = f"<h1>{self.words(1, 12).capitalize()}{r.choice(['', '.'])}</h1>"
        inner = r.choice([title, f"<header>{title}</header>", title]) + self.body() if r.random() < 0.85 else self.body()
        if r.random() < 0.3:
            inner = inner + self.junk()
        if r.random() < 0.2:
            inner += self.talk()
        tags = ("article", "main", "section", "article")
        whole = self.box("main", inner, 1, tags)
        if r.random() < 0.4:
            whole = self.box("main", whole, r.choice([1, 1, None]), ("main", "div", "section"))
        if r.random() < 0.3:
            whole = f"<div>{whole}</div>"
        return whole

    def talk(self) -> str:
        r = self.rng
        one = "".join(self.box("talk", r.choice([f"<b>{self.words(1, 2)}</b>", f"<p>{self.link(1, 2)}</p>", f"<span>{self.words(1, 2)}</span> "])
                               + r.choice([self.paragraph(), self.sentences(1, 5), f"<p>{self.sentences(1, 4)}</p>"]), None, ("div", "li", "article"))
                      for _ in range(r.randint(1, 6)))
        telling, self.telling = self.telling, True  # without names, readers' comments cannot be told from articles
        out = self.box("talk", f"<h3>{self.words(1, 3)}</h3>{one}{r.choice(['', self.form()])}", 0, ("section", "div", "aside"))
        self.telling = telling
        return out

    def page(self) -> str:
        r = self.rng
        parts = []
        if r.random() < 0.5:
            parts.append(self.box("head", r.choice([self.words(1, 3), f"<h2>{self.words(1, 4)}</h2>{self.sentences(1, 1)}", f"<p>{self.words(1, 4)}</p>"])
                                  + r.choice(["", self.link_list(), self.form()]), 0, ("header", "div")))
        if r.random() < 0.8:
            parts.append(self.box("menu", self.link_list(3, 9), 0, ("nav", "nav", "div")))
        parts += [self.junk() for _ in range(r.choice([0, 0, 1, 1, 2]))]
        middle = [self.article()] + [self.junk() for _ in range(r.choice([0, 0, 1, 2, 3]))]
        if r.random() < 0.2:
            middle.reverse()
        if r.random() < 0.4:
            middle.insert(middle.index(max(middle, key=len)) + 1, self.talk())
        parts.append("<!-- " + self.words(1, 3) + " -->")
        if r.random() < 0.06:
            parts.append(f"<table><tr><td>{self.box('menu', self.link_list(), 0)}</td><td>{''.join(middle)}</td></tr></table>")
        else:
            parts.append(f"<div>{''.join(middle)}</div>" if r.random() < 0.3 else "".join(middle))
        if r.random() < 0.85:
            inner = r.choice([f"&copy; {self.words(1, 3)} &middot; {self.sentences(1, 3)}", f"<p>&copy; {r.randint(2000, 2030)} {self.words(1, 4)}</p>{self.link_list()}",
                              f"<p>{self.sentences(1, 4)}</p>", self.link_list()])
            parts.append(self.box("foot", inner, 0, ("footer", "footer", "div")))
        head = f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>"
        script = r.choice(["", f"<script>var t = '<p>{self.words(1, 4)}</p>';</script>"])
        return head + script + "".join(parts) + r.choice(["</body></html>", "</body></html>", ""])


def labelled_pages(count: int = LABELLED, seed: int = 7) -> list[str]:
    """Marked pages, the same for the same seed."""
    rng = random.Random(seed)
    return [_Writer(rng).page() for _ in range(count)]
