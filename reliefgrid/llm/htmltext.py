"""Main text of web pages by a tree-structured graphical model.

Block elements of a page and the runs of text in them are nodes of a tree. Every node is content
or not; features of a node and of the step from its parent give potentials. Sum-product messages
go up and down the tree once, which gives exact marginals, and runs of text that are likelier
content than not make up the text. Weights are trained by maximum likelihood on pages whose own
markup says which part is the article, with the telling tags hidden at random so that the
other signs are learned too.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.textbytes import slices

#: Pages that a model is fitted on, at most.
SAMPLE = 400
BUCKETS = 1 << 12

# Elements that HTML shows as blocks, reads raw, keeps in its head or leaves open; tags that end an open <svg>.
BLOCKS = frozenset("""html body article section main nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
    table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset details summary address hr
    title head option select label button legend center dialog menu""".split())
RAW = frozenset("script style noscript iframe textarea".split())
HEAD = frozenset("html head title base basefont bgsound link meta template noframes".split()) | RAW - {"iframe", "textarea"}
INLINE = frozenset("b big br code em embed i img nobr s small span strong strike sub sup tt u var ruby".split())
ISLANDS = frozenset("foreignobject desc title".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TELLING = frozenset("article main".split())
APART = frozenset("nav header footer aside form menu button select dialog".split())
_APART_WORDS = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|popup|modal|newsletter|subscribe|social|share|sharing|"
    r"comments?|disqus|respond|responses?|recommend\w*|sidebar|menu|nav\w*|breadcrumbs?|footer|header|masthead|pager|pagination|widget|login)(?:[^a-z]|$)")
# Names that articles use too: no label and no first weight, training alone weighs them.
_UNSURE_WORDS = re.compile(r"(?:^|[^a-z])(?:notice|related|side|search|tags?)(?:[^a-z]|$)")
_CONTENT_WORDS = re.compile(r"(?:^|[^a-z])(?:article|content|main|post|entry|story|body|text)(?:[^a-z]|$)")
# A quote opens a value only behind "="; one that nothing closes is a character like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?|[^>=])*+)>|<[!?][^>]*>",
    re.S | re.I)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in (*RAW, "title")}
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)


class Page:
    """The nodes of a page, parents before children; text of runs, signs of elements."""

    __slots__ = ("parent", "tag", "names", "text", "links", "depth")

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.text, self.links, self.depth = [-1], ["#page"], [""], [None], [0], [0]

    def add(self, parent: int, tag: str, names: str, text: str | None = None, links: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.links.append(links)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def parse(source: str) -> Page:
    """A forgiving reading: what is never closed ends with its parent, what was never opened is ignored.

    Scripts and other raw elements, <template>, <svg> and the page's <head> show no text.
    """
    page, stack = Page(), [0]
    # How many open elements have a tag.
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, in_link = 0, False
    # Open tags from the one that shows no text on; raw tags that are closed nowhere in the rest.
    hidden: list[str] = []
    endless: set[str] = set()

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                page.add(stack[-1], "#text", "", text, min(linked, len(text)))
        pieces, linked = [], 0

    def read(text: str) -> None:
        nonlocal linked
        if hidden == ["head"] and not text.isspace():
            hidden.clear()
        if not hidden:
            pieces.append(text)
            linked += len(text) if in_link else 0

    def skipped(tag: str, at: int) -> int | None:
        """The place behind the closing tag, if there is one."""
        if tag in endless:
            return None
        end = _CLOSE[tag].search(source, at)
        if end is None:
            endless.add(tag)
        return end and end.end()

    at = 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            read(source[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        shut = m[3].endswith("/")
        if m[1]:
            if tag in hidden:
                del hidden[len(hidden) - 1 - hidden[::-1].index(tag):]
                continue
            if hidden:
                # A closing tag of what is open around it ends a head or drawing that is still open.
                outer = opened[tag] > 0 if tag in BLOCKS else (tag in INLINE or tag == "a" and in_link)
                if hidden[0] == "template" or not outer:
                    continue
                hidden.clear()
        else:
            if hidden == ["head", "title"]:
                hidden.pop()
            if hidden == ["head"] and tag not in HEAD:
                hidden.clear()
            if hidden and hidden[0] == "svg" and not ISLANDS & set(hidden) and (tag in BLOCKS and tag not in ISLANDS or tag in INLINE):
                hidden.clear()
            if tag in RAW or tag == "title" and hidden == ["head"]:
                end = skipped(tag, at)
                if end is not None:
                    at = end if not (shut and "svg" in hidden) else at
                elif tag == "title":
                    hidden.append(tag)
                elif not shut:
                    at = len(source)
                continue
            if tag == "template" or (tag == "svg" and not shut) or (tag == "head" and not hidden):
                hidden.append(tag)
                continue
            if hidden:
                if hidden[0] == "svg" and not shut and tag not in EMPTY and (tag in BLOCKS or tag in INLINE or tag in ISLANDS or tag == "a"):
                    hidden.append(tag)
                continue
        if tag == "a":
            in_link = not m[1]
        if tag == "br":
            pieces.append(" ")
        if tag not in BLOCKS:
            continue
        if m[1]:
            if opened[tag]:
                flush()
                while (ended := page.tag[stack.pop()]) != tag:
                    opened[ended] -= 1
                opened[tag] -= 1
            continue
        flush()
        if page.tag[stack[-1]] == "p" or (tag in CLOSES and page.tag[stack[-1]] in CLOSES[tag]):
            opened[page.tag[stack.pop()]] -= 1
        names = " ".join(x.strip("\"'") for _, x in _NAMED.findall(m[3])).lower() if m[3] else ""
        node = page.add(stack[-1], tag, names)
        if tag not in EMPTY:
            stack.append(node)
            opened[tag] += 1
    if at < len(source):
        read(source[at:])
    flush()
    return page


def _bucket(sign: str) -> int:
    value = 2166136261
    for c in sign.encode():
        value = ((value ^ c) * 16777619) & 0xFFFFFFFF
    return (value ^ (value >> 15)) % BUCKETS


_CACHE: dict[str, int] = {}


def _number(sign: str) -> int:
    if sign not in _CACHE:
        if len(_CACHE) > 100_000:
            _CACHE.clear()
        _CACHE[sign] = _bucket(sign)
    return _CACHE[sign]


def signs(page: Page, hide: bool = False) -> list[list[int]]:
    """Feature numbers of every node; ``hide`` leaves the telling tags out."""
    out = []
    for i, tag in enumerate(page.tag):
        own = ["any:" + ("text" if tag == "#text" else "element")]
        if tag == "#text":
            text = page.text[i]
            size = len(text)
            own += [f"size:{size.bit_length()}", f"links:{4 * page.links[i] // size}", f"commas:{min(4, text.count(',') + text.count('.'))}",
                    f"ends:{text[-1] in '.!?…»”'}", f"in:{page.tag[page.parent[i]]}"]
        else:
            if not (hide and (tag in TELLING or tag in APART)):
                own.append(f"tag:{tag}")
                if tag in APART:
                    own.append("apart")
            if page.names[i]:
                own += [f"name:{x}" for x in page.names[i].split()]
                if _APART_WORDS.search(page.names[i]):
                    own.append("apart-name")
                elif _CONTENT_WORDS.search(page.names[i]):
                    own.append("content-name")
                if _UNSURE_WORDS.search(page.names[i]):
                    own.append("unsure-name")
        out.append([_number(x) for x in own])
    return out


def _apart(page: Page, i: int) -> bool:
    return page.tag[i] in APART or bool(page.names[i] and _APART_WORDS.search(page.names[i]))


def marked(page: Page) -> list[int] | None:
    """Labels that the page's own markup gives its nodes; none if it names no article."""
    if not TELLING & set(page.tag):
        return None
    labels = [0] * len(page.tag)
    for i in range(1, len(labels)):
        inside = labels[page.parent[i]] == 1 or page.tag[i] in TELLING
        labels[i] = int(inside and not _apart(page, i))
    return labels


class Model:
    """Weights of signs and of the steps from parent to child, apart for text and elements."""

    def __init__(self) -> None:
        self.unary = np.zeros(BUCKETS)
        self.prior = np.zeros(BUCKETS)
        for sign, weight in (("apart", -3.0), ("apart-name", -3.0), ("content-name", 1.0), ("tag:article", 2.0), ("tag:main", 2.0)):
            self.prior[_bucket(sign)] = weight
        self.unary += self.prior
        self.step = np.zeros((2, 2, 2))
        # A child is at first thought to be what its parent is.
        self.step[:, 0, 0] = self.step[:, 1, 1] = 1.0


class Trees:
    """Nodes of several pages in one set of arrays."""

    def __init__(self, pages: list[Page], features: list[list[list[int]]]) -> None:
        sizes = [len(p.parent) for p in pages]
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.parent = np.concatenate([np.array(p.parent) + b for p, b in zip(pages, self.first)]) if pages else np.zeros(0, np.int64)
        self.depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, np.int64)
        self.kind = np.array([int(t == "#text") for p in pages for t in p.tag], np.int64)
        flat = [s for page in features for s in page]
        self.node = np.repeat(np.arange(len(flat)), [len(s) for s in flat]).astype(np.int64)
        self.sign = np.array([x for s in flat for x in s], np.int64)
        order = np.argsort(self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1) if len(order) else []


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def beliefs(model: Model, trees: Trees) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of nodes, and joint marginals of each node with its parent, by sum-product messages."""
    n = len(trees.parent)
    own = np.zeros((n, 2))
    own[:, 1] = np.bincount(trees.node, model.unary[trees.sign], n)
    step = model.step[trees.kind]
    up, sent = own.copy(), np.zeros((n, 2))
    for level in reversed(trees.levels[1:]):
        sent[level] = _log_sum(step[level] + up[level][:, None, :], 2)
        np.add.at(up, trees.parent[level], sent[level])
    down = np.zeros((n, 2))
    joint = np.zeros((n, 2, 2))
    for level in trees.levels[1:]:
        above = trees.parent[level]
        rest = up[above] + down[above] - sent[level]
        pair = rest[:, :, None] + step[level]
        down[level] = _log_sum(pair, 1)
        both = pair + up[level][:, None, :]
        both -= _log_sum(both.reshape(len(level), 4), 1)[:, None, None]
        joint[level] = np.exp(both)
    total = up + down
    return np.exp(total - _log_sum(total, 1)[:, None]), joint


def fit(sources: list[str], rounds: int = 60, seed: int = 13) -> Model:
    """Maximum likelihood by gradient steps on pages that name their article."""
    random = np.random.default_rng(seed)
    model = Model()
    pages = [(p, y) for p in map(parse, sources) if (y := marked(p)) is not None]
    if not pages:
        return model
    shown = Trees([p for p, _ in pages], [signs(p) for p, _ in pages])
    hidden = Trees([p for p, _ in pages], [signs(p, random.random() < 0.7) for p, _ in pages])
    labels = np.concatenate([np.array(y) for _, y in pages])
    speed = [np.full(BUCKETS, 1e-6), np.full((2, 2, 2), 1e-6)]
    for turn in range(rounds):
        trees = hidden if turn % 2 else shown
        marginal, joint = beliefs(model, trees)
        gap = labels - marginal[:, 1]
        unary = np.bincount(trees.sign, gap[trees.node], BUCKETS) / len(pages) - 0.02 * (model.unary - model.prior)
        inner = np.flatnonzero(trees.depth > 0)
        seen = np.zeros((2, 2, 2))
        np.add.at(seen, (trees.kind[inner], labels[trees.parent[inner]], labels[inner]), 1.0)
        meant = np.zeros((2, 2, 2))
        np.add.at(meant, trees.kind[inner], joint[inner])
        step = (seen - meant) / len(pages) - 0.01 * model.step
        for value, slope, fast in ((model.unary, unary, speed[0]), (model.step, step, speed[1])):
            fast += slope * slope
            value += 0.3 * slope / np.sqrt(fast)
    return model


def main_text(model: Model, sources: list[str]) -> list[str]:
    """The content blocks of each page in page order, joined by an empty line."""
    pages = [parse(s) for s in sources]
    trees = Trees(pages, [signs(p) for p in pages])
    content = beliefs(model, trees)[0][:, 1] > 0.5 if len(trees.parent) else np.zeros(0, bool)
    return ["\n\n".join(t for t, c in zip(p.text, content[b:]) if t is not None and c) for p, b in zip(pages, trees.first.tolist())]


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` pages that name their article, chosen by a hash of id and page.

    Repeated rows count once. The fit runs in one task over the sample; the driver gets the weights alone.
    """
    names = F.col(html_col).rlike("(?i)<(article|main)[ >]")
    rows = pages.where(names).select(F.xxhash64(id_col, html_col).alias("hash"), F.col(html_col).alias("html"))
    chosen = rows.select("hash").distinct().orderBy("hash").limit(sample)
    one = rows.join(chosen, "hash").groupBy("hash").agg(F.min("html").alias("html"))
    found = one.select("html").repartition(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([])


def _fitted(batches) -> Iterator[pa.RecordBatch]:
    """The model of all pages of a task, pickled."""
    model = fit(sorted(x for batch in batches for x in batch.column(0).to_pylist()))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _extract(batches, model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sources, n = batch.column(0), batch.num_columns
        for begin, end in slices(sources):
            texts = main_text(model.value, [x or "" for x in sources.slice(begin, end - begin).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(begin, end - begin) for i in range(1, n)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [*batch.schema.names[1:], "text", "n_chars"])


def extract(pages: DataFrame, model: Model, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep`` of every row, ``text`` and ``n_chars`` in code points.

    A null or empty page has an empty text. Repeated rows are returned each; further columns are
    ignored; an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    columns = pages.select(F.col(html_col).alias("_html"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[1:])
    return columns.mapInArrow(partial(_extract, model=shared), f"{schema}, text string, n_chars long")
