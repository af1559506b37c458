"""Main text of web pages: boosted trees score DOM nodes, a decoding over the tree keeps ancestors and descendants consistent."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerlode.functions.partitions import spread
from layerlode.llm.boosting import Boosted
from layerlode.llm.common import bounded_sample, small_batches, tidy

#: At most so many pages, in the order of a hash, are fitted on.
TRAIN_PAGES = 600
_PAGES = 200  # pages whose nodes are scored at once
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?]")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style noscript template svg iframe textarea title".split())
_INLINE = frozenset("a abbr b bdi bdo cite code dfn em font i kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_P, _KEEPS_P = frozenset(("p",)), frozenset("button td th li table".split())
#: Tags that an open one of the second set ends, down to one of the third.
_SIBLINGS = {t: (own, stop) for tags, own, stop in (("li", {"li"}, {"ul", "ol", "menu"}), ("dd dt", {"dd", "dt"}, {"dl"}), ("tr", {"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), ("td th", {"td", "th"}, {"tr", "table"}), ("option", {"option"}, {"select"})) for t in tags.split()}
#: Tags that say what they hold. They label the pages that are fitted on and are no features.
_CONTENT, _OTHER = frozenset(("article", "main")), frozenset("nav footer aside header form menu dialog".split())
_GROUPS = {t: k for k, tags in enumerate(("p", "a", "li ul ol dl dd dt", "h1 h2 h3 h4 h5 h6", "table tbody thead tr td th", "pre code blockquote", "b i em strong span small u font"), 1) for t in tags.split()}
FEATURES = ("own_chars", "chars", "words", "nodes", "density", "link_share", "mark_rate", "depth", "children", "place", "siblings", "before", "after", "sibling_mean", "share_of_parent", "share_of_page", "start", "attributes", "attributes_above", "word_length", *[f"tag_{k}" for k in range(8)])


@dataclass
class Dom:
    """Elements in document order. ``end``: the first one outside the subtree; texts: (element, its text)."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Dom:
    """The elements of a page of any length; end tags that HTML lets go are supplied, stray ones passed over.

    Comments, scripts, styles and the page's title hold no text. What follows the last ``>`` is text.
    """
    dom = Dom()
    tags, parents, depths, ends, texts = dom.tag, dom.parent, dom.depth, dom.end, dom.texts
    stack: list[int] = []
    where: dict[str, list[int]] = {}  # places of open elements in the stack, by tag: no search walks the stack

    def close(to: int) -> None:
        while len(stack) > to:
            at = stack.pop()
            ends[at] = len(tags)
            where[tags[at]].pop()

    def top(names: frozenset | set) -> int:
        return max((own[-1] for t in names if (own := where.get(t))), default=-1)

    def find(own: frozenset | set, stop: frozenset | set) -> int:
        k = top(own)
        return k if k > top(stop) else -1

    def add(tag: str, attributes: str) -> None:
        tags.append(tag)
        parents.append(stack[-1] if stack else -1)
        depths.append(len(stack))
        ends.append(len(tags))
        found: tuple[str, ...] = ()
        if "=" in attributes:
            found = tuple(x for m in _ATTRIBUTE.findall(attributes) for x in _TOKEN.findall("".join(m).lower()))
        dom.tokens.append(found)

    add("", "")
    stack.append(0)
    where[""] = [0]
    at, last = 0, page.rfind(">") + 1
    while at < last:
        m = _TAG.search(page, at, last)
        start = m.start() if m else last
        if start > at:
            texts.append((stack[-1], page[at:start]))
        if not m:
            at = last
            break
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            k = top({tag}) if tag not in _VOID else -1
            if k > 0:
                close(k)
            elif tag == "br":
                texts.append((stack[-1], "\n"))
            continue
        if tag in _ENDS_P and where.get("p"):
            k = find(_P, _KEEPS_P)
            if k > 0:
                close(k)
        elif tag in _SIBLINGS:
            k = find(*_SIBLINGS[tag])
            if k > 0:
                close(k)
        if tag == "br":
            texts.append((stack[-1], "\n"))
            continue
        add(tag, m.group(3))
        if tag in _VOID or m.group(3).endswith("/"):
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(page, at)
            at = stop.end() if stop else len(page)
            continue
        where.setdefault(tag, []).append(len(stack))
        stack.append(len(tags) - 1)
    if at < len(page):
        texts.append((stack[-1], page[at:]))
    close(0)
    return dom


@dataclass
class Nodes:
    """The elements of many pages end to end, as arrays."""

    doms: list[Dom]
    parent: np.ndarray
    end: np.ndarray
    depth: np.ndarray
    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _attribute_weight(tokens: tuple[str, ...], weights: dict[str, float]) -> float:
    return sum(weights.get(t, 0.0) for t in tokens)


def nodes_of(doms: list[Dom], weights: dict[str, float]) -> Nodes:
    sizes = np.array([len(d.tag) for d in doms], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    base = np.repeat(first[:-1], sizes)
    parent = np.array([x for d in doms for x in d.parent], dtype=np.int64)
    roots = parent < 0
    parent = np.where(roots, -1, parent + base)
    end = np.array([x for d in doms for x in d.end], dtype=np.int64) + base
    depth = np.array([x for d in doms for x in d.depth], dtype=np.int64)
    tags = [x for d in doms for x in d.tag]
    group = np.array([_GROUPS.get(t, 0) for t in tags], dtype=np.int64)
    own = np.zeros((n, 3))  # characters, words, punctuation marks
    for k, d in enumerate(doms):
        for i, text in d.texts:
            if not text.isspace():
                row = own[first[k] + i]
                row += (len(text), text.count(" ") + 1, len(_MARKS.findall(text)))
    link = group == 2
    inside = np.zeros(n + 1)
    np.add.at(inside, np.flatnonzero(link), 1)
    np.add.at(inside, end[link], -1)
    linked = (np.cumsum(inside)[:-1] > 0) * own[:, 0]
    sums = np.vstack([np.zeros(4), np.cumsum(np.column_stack([own, linked]), axis=0)])
    at = np.arange(n)
    below = sums[end] - sums[at]
    count = end - at
    page = np.repeat(np.arange(len(doms)), sizes)
    total = np.maximum(below[first[:-1][page], 0] if n else below[:, 0], 1)
    up = np.maximum(parent, 0)
    children = np.bincount(parent[~roots], minlength=n)
    # Siblings: children of one parent in document order.
    order = np.lexsort((at, parent))
    head = np.flatnonzero(np.diff(parent[order], prepend=-2))
    run = np.repeat(np.arange(len(head)), np.diff(head, append=n))
    place = np.empty(n)
    place[order] = np.arange(n) - head[run] if n else 0
    same_before = np.concatenate([[False], np.diff(parent[order]) == 0])
    chars = below[:, 0]
    before, after = np.zeros(n), np.zeros(n)
    before[order[same_before]] = chars[order[np.flatnonzero(same_before) - 1]]
    after[order[np.flatnonzero(same_before) - 1]] = chars[order[same_before]]
    siblings = np.where(roots, 1, children[up])
    sibling_mean = np.where(roots, chars, (below[up, 0] - own[up, 0]) / np.maximum(siblings, 1))
    attribute = np.array([_attribute_weight(t, weights) if t else 0.0 for d in doms for t in d.tokens])
    above = np.zeros(n + 1)
    np.add.at(above, at, attribute)
    np.add.at(above, end, -attribute)
    above = np.cumsum(above)[:-1]
    most = np.maximum(chars, 1)
    columns = [
        np.log1p(own[:, 0]), np.log1p(chars), np.log1p(below[:, 1]), np.log1p(count), chars / count, below[:, 3] / most, below[:, 2] / most, depth,
        np.log1p(children), place / np.maximum(siblings - 1, 1), np.log1p(siblings), np.log1p(before), np.log1p(after), np.log1p(np.maximum(sibling_mean, 0)),
        chars / np.maximum(below[up, 0], 1), chars / total, (sums[at, 0] - sums[first[:-1][page], 0]) / total, attribute, above, chars / np.maximum(below[:, 1], 1),
        *[group == k for k in range(8)],
    ]
    return Nodes(doms, parent, end, depth, np.column_stack(columns).astype(np.float64) if n else np.zeros((0, len(FEATURES))), own[:, 1], first)


def weak_labels(dom: Dom) -> np.ndarray | None:
    """1 in the content that a page's tags declare, 0 outside, -1 for its ancestors; null where no tag declares any."""
    n = len(dom.tag)
    held, other, mixed = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    for i, tag in enumerate(dom.tag):
        if tag in _CONTENT and not other[i] and not held[i]:
            held[i : dom.end[i]] = True
            j = dom.parent[i]
            while j >= 0 and not mixed[j]:
                mixed[j] = True
                j = dom.parent[j]
        elif tag in _OTHER and not other[i]:
            other[i : dom.end[i]] = True
    held &= ~other
    if not held.any():
        return None
    return np.where(held, 1, np.where(mixed & ~other, -1, 0))


@dataclass
class PageModel:
    weights: dict[str, float]
    trees: Boosted

    def log_odds(self, nodes: Nodes) -> np.ndarray:
        return self.trees.margin(nodes.features)


def fit_pages(pages: list[str]) -> PageModel | None:
    """Fit on the pages whose tags declare their content; null if there are none. Weights of attribute tokens are
    learnt on the even pages and the trees on the odd ones, so that the trees see weights as those of new pages."""
    known = [(d, y) for d in map(parse, pages) if (y := weak_labels(d)) is not None]
    if not known:
        return None
    halves = (known[::2], known[1::2] or known)
    seen = (Counter(), Counter())
    totals = [0, 0]
    for dom, y in halves[0]:
        for tokens, kind in zip(dom.tokens, y, strict=True):
            if kind >= 0:
                totals[kind] += 1
                seen[kind].update(set(tokens))
    weights = {}
    for token in seen[0].keys() | seen[1].keys():
        if seen[0][token] + seen[1][token] >= 3:
            weights[token] = float(np.log((seen[1][token] + 0.5) / (totals[1] + 1)) - np.log((seen[0][token] + 0.5) / (totals[0] + 1)))
    nodes = nodes_of([d for d, _ in halves[1]], weights)
    y = np.concatenate([y for _, y in halves[1]])
    rows = y >= 0
    return PageModel(weights, Boosted(trees=40, depth=3).fit(nodes.features[rows], y[rows].astype(float)))


def decode(nodes: Nodes, log_odds: np.ndarray) -> np.ndarray:
    """Which elements are content: whole subtrees, none in another, with the largest sum of log odds over their elements.

    An element counts ``1 + ln(1 + own words)`` times. A subtree is taken if its sum reaches that of the best choice
    among its descendants, so that a node is never content under a parent that was taken without it, nor left out below
    one that was taken.
    """
    gains = log_odds * (1 + np.log1p(nodes.words))
    sums = np.concatenate([[0.0], np.cumsum(gains)])
    whole = sums[nodes.end] - sums[:-1]
    if len(gains) and nodes.depth.max() > len(gains) // 8:
        return _decode_deep(nodes.parent.tolist(), whole.tolist())
    order = np.argsort(nodes.depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(nodes.depth[order])) + 1) if len(order) else []
    parts, take = np.zeros(len(gains)), np.zeros(len(gains), dtype=bool)
    for level in reversed(levels):
        take[level] = (whole[level] > 0) & (whole[level] >= parts[level] - 1e-9)
        best = np.where(take[level], whole[level], parts[level])
        inner = nodes.parent[level] >= 0
        np.add.at(parts, nodes.parent[level[inner]], best[inner])
    for level in levels[1:]:
        take[level] |= take[nodes.parent[level]]
    return take


def _decode_deep(parent: list[int], whole: list[float]) -> np.ndarray:
    """As ``decode`` an element at a time, for trees that have nearly as many levels as elements."""
    parts, take = [0.0] * len(whole), [False] * len(whole)
    for i in range(len(whole) - 1, -1, -1):
        take[i] = whole[i] > 0 and whole[i] >= parts[i] - 1e-9
        if parent[i] >= 0:
            parts[parent[i]] += whole[i] if take[i] else parts[i]
    for i, up in enumerate(parent):
        if up >= 0 and take[up]:
            take[i] = True
    return np.array(take, dtype=bool)


def text_of(dom: Dom, keep: np.ndarray) -> str:
    """The text of the kept elements: white space made one space, a line for each block, character references decoded."""
    lines: list[tuple[int, list[str]]] = []
    block: dict[int, int] = {}
    for i, text in dom.texts:
        if not keep[i]:
            continue
        at = block.get(i)
        if at is None:
            at, path = i, []
            while dom.tag[at] in _INLINE and at not in block:
                path.append(at)
                at = dom.parent[at]
            at = block[i] = block.get(at, at)
            block.update(dict.fromkeys(path, at))
        if text == "\n":
            lines.append((-1, []))
        elif lines and lines[-1][0] == at:
            lines[-1][1].append(text)
        else:
            lines.append((at, [text]))
    done = (_SPACE.sub(" ", unescape("".join(parts))).strip() for _, parts in lines)
    return "\n".join(x for x in done if x)


def fit_extraction(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> PageModel | None:
    """Fit on at most ``train_pages`` pages that declare their content, the first in the order of a hash of id and URL."""
    own = pages.where("lower(html) rlike '<(article|main)[ >]'").select(F.col("html").cast("string").alias("html"), F.xxhash64("page_id", "url", "html").alias("h"))
    total = own.select("h").distinct().count()
    single = bounded_sample(own.groupBy("h").agg(F.first("html").alias("html")), train_pages, F.col("h"), total)
    rows = single.select("h", "html").collect() if total else []
    return fit_pages([r["html"] for r in sorted(rows, key=lambda r: r["h"])])


_OUT = "url string, text string, n_nodes int, n_content int"


def extract_batch(model: PageModel, pages: list[str | None]) -> list[tuple[str | None, int | None, int | None]]:
    out: list[tuple[str | None, int | None, int | None]] = []
    for i in range(0, len(pages), _PAGES):
        own = pages[i : i + _PAGES]
        doms = [parse(p) for p in own if p is not None]
        nodes = nodes_of(doms, model.weights)
        keep = decode(nodes, model.log_odds(nodes))
        k = 0
        for page in own:
            if page is None:
                out.append((None, None, None))
                continue
            mine = keep[nodes.first[k] : nodes.first[k + 1]]
            out.append((text_of(doms[k], mine), len(mine) - 1, int(mine[1:].sum())))
            k += 1
    return out


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = extract_batch(model, batch.column(2).to_pylist())
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())],
                names=["page_id", "url", "text", "n_nodes", "n_content"],
            )

    return run


def extract_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """The main text of every page: page_id, url, text, n_nodes (elements) and n_content (elements kept). page_id keeps its type.

    Each element of a page has features of its subtree (text, density, links, punctuation), attribute tokens, depth,
    siblings and a coarse kind of tag. Boosted trees, fitted on at most ``train_pages`` pages whose ``article`` or
    ``main`` tags declare their content, give log odds that it is content; such tags themselves are no features.
    ``decode`` then takes whole subtrees.

    One row for each row. A null html has null text and counts, an empty one an empty text and 0 elements; text
    outside of any element belongs to the page. Without pages that declare their content every text is null. Pages
    of any length are read whole, repeated rows and null ids are rows like others, an empty table gives no rows, other
    columns aren't read.
    """
    small_batches(pages.sparkSession)
    narrow = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = fit_extraction(pages, train_pages)
    if model is None:
        return narrow.selectExpr("page_id", "url", "cast(null as string) as text", "cast(null as int) as n_nodes", "cast(null as int) as n_content")
    return spread(narrow).mapInArrow(tidy(_extract(pages.sparkSession.sparkContext.broadcast(model))), f"page_id {pages.schema['page_id'].dataType.simpleString()}, {_OUT}")
