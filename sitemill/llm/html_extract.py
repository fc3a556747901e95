"""Main text of web pages by gradient-boosted trees over DOM nodes and hierarchical decoding.

Each page is read once into block elements (nav, div, p, li, ...) with their text. Every element gets features
of its subtree (length, density, links, punctuation), its attributes and tag (words that mark content, boilerplate or either, its own and its ancestors'), its depth and its siblings. Boosted trees give each element the
chance that it belongs to the main text or holds it. Decoding picks the likeliest labels of the whole tree in
which nothing below a rejected element is taken, so ancestors and descendants never contradict each other.

The trees are fitted on SAMPLE_PAGES pages of the input (those with the smallest hash of their html, so reruns agree)
and on a few made-up layouts; labels come from semantic markup, and half of the pages are seen with that markup
hidden, so that density and siblings are learned too. All pages are then read whole.

Null or empty html gives an empty text. Text blocks are in page order, joined by a line break; white space in a
block is one space. Character references are decoded as browsers do. Rows are independent, so repeated page_ids
and urls, null keys and further columns do not matter."""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the input that the trees are fitted on.
SAMPLE_PAGES = 200
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32

# tags, as HTML defines them
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select",
    "button", "label", "summary", "table", "caption", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "head",
}
# an opening tag ends an open element of the second set, if none of the third lies between
_LISTS = {"ul", "ol", "menu", "dir"}
_CELLS = {"table"}
ENDS = {
    "li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, _CELLS), "td": ({"td", "th"}, _CELLS | {"tr"}), "th": ({"td", "th"}, _CELLS | {"tr"}), "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"option", "optgroup", "legend", "summary", "label", "button", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup", "html", "body", "head"}
# words in tags, classes, ids and roles that mark what is not the main text, and what is
BOILERPLATE = re.compile(
    r"(?:^|[-_ ])(?:nav|navigation|navbar|menu|header|masthead|footer|aside|sidebar|side|ad|ads|advert|advertisement|adverts|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|notice|notices|alert|"
    r"popup|modal|overlay|form|search|login|signup|subscribe|newsletter|comment|comments|disqus|reply|replies|respond|share|sharing|social|related|recommended|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|"
    r"copyright|contentinfo|complementary|dialog|hidden|button|select|option|fieldset)(?:$|[-_ ]|\d)",
)
# words that a part of the main text may have as well
EITHER = re.compile(r"(?:^|[-_ ])(?:legal|terms|disclaimer|tags|toc|note|notes|info|box|meta)(?:$|[-_ ]|\d)")
CONTENT = re.compile(r"(?:^|[-_ ])(?:article|main|content|post|entry|story|articlebody|body-text|text|prose)(?:$|[-_ ]|\d)")
# an attribute's name, and its value if there is one; quotes open a value only after =, elsewhere they are characters like others
_NAME, _VALUE = r"(?:=[^\s/>=]*+|[^\s/>=]++)", r"[ \t\n\r\f]*+=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>))"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_NAME}(?:{_VALUE})?+)*+)>")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ODD = re.compile(r"<(?:!--(?:.*?--!?>|.*)|[!?/][^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}


@dataclass
class Page:
    """Block elements in page order, with parents, marks and depth, and text blocks (owner, text, characters in links)."""

    tags: list[str]
    parents: list[int]
    bad: list[int]
    good: list[int]
    either: list[int]
    blocks: list[tuple[int, str, int]]


def _marks(tag: str, attributes: str) -> tuple[int, ...]:
    names = [tag]
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                names.append("hidden")
            elif name in ("class", "id", "role"):
                names.extend(value.split())
    return tuple(sum(bool(words.search(x)) for x in names) for words in (BOILERPLATE, CONTENT, EITHER))


def read_page(source: str | None) -> Page:
    """Reads a page in one pass over its tags."""
    page = Page(["html"], [-1], [0], [0], [0], [])
    if not source:
        return page
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block that holds their text
    open_tags: dict[str, int] = {}
    text: list[str] = []
    linked, links = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", references.unescape("".join(text))).strip(" \t\n\r\f\v")
            if joined:
                page.blocks.append((stack[-1][1], joined, min(linked, len(joined))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal links
        if any(stack[k][0] in BLOCK for k in range(depth, len(stack))):
            flush()
        while len(stack) > depth:
            tag, _ = stack.pop()
            open_tags[tag] -= 1
            if tag == "a":
                links -= 1

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            text.append(piece)
            if links > 0:
                linked += len(piece)

    at, size, tags = 0, len(source), _TAG
    while at < size:
        spot = source.find("<", at)
        if spot < 0:
            add(source[at:])
            break
        add(source[at:spot])
        found = tags.match(source, spot)
        if not found and tags is _TAG and (found := _LOOSE_TAG.match(source, spot)):
            tags = _LOOSE_TAG  # a value that is open at the end of the page: from here on tags end at the first >
        if not found:
            odd = _ODD.match(source, spot)
            if odd:
                at = odd.end()
            elif re.match(r"</?[a-zA-Z]", source[spot : spot + 3]):  # a tag that never ends
                break
            else:
                add("<")
                at = spot + 1
            continue
        at = found.end()
        tag = found[2].lower()
        if found[1]:
            if tag in ("html", "body"):
                continue  # what follows still belongs to the page
            if open_tags.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                close(depth)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(source, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr", "img", "input"):
                add(" " if tag != "wbr" else "")
            continue
        if tag in ENDS_P and open_tags.get("p"):
            depth = len(stack) - 1
            while stack[depth][0] != "p":
                depth -= 1
            close(depth)
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            depth, target = len(stack) - 1, 0
            while depth > 0 and stack[depth][0] not in barrier:
                if stack[depth][0] in ended:
                    target = depth
                depth -= 1
            if target:
                close(target)
        if tag in BLOCK:
            if tag == "html":
                continue
            flush()
            bad, good, either = _marks(tag, found[3])
            owner = len(page.tags)
            page.tags.append(tag)
            page.parents.append(stack[-1][1])
            page.bad.append(bad)
            page.good.append(good)
            page.either.append(either)
        else:
            owner = stack[-1][1]
            if tag == "a":
                links += 1
        stack.append((tag, owner))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    return page


_KINDS = {"p": 1, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "li": 3, "ul": 4, "ol": 4, "td": 5, "table": 5, "tr": 5, "pre": 6, "blockquote": 6}


def features(page: Page, hide: bool = False) -> np.ndarray:
    """A row of numbers for each element. hide: as if tags and attributes marked nothing."""
    n = len(page.tags)
    parents = np.array(page.parents)
    own = np.zeros((n, 5))  # characters, in links, text blocks, punctuation, long blocks
    for owner, text, linked in page.blocks:
        own[owner] += (len(text), linked, 1, text.count(".") + text.count(","), len(text) > 80)
    subtree = np.concatenate([own, np.ones((n, 1)), np.array([[t in ("p", "pre", "blockquote") for t in page.tags]]).T], 1)
    for k in range(n - 1, 0, -1):
        subtree[parents[k]] += subtree[k]
    depth, above_bad, above_good = np.zeros(n), np.zeros(n), np.zeros(n)
    bad, good, either = (np.zeros(n) if hide else np.array(x, float) for x in (page.bad, page.good, page.either))
    children, order = np.zeros(n), np.zeros(n)
    last: dict[int, int] = {}
    before, after = np.full(n, -1), np.full(n, -1)
    for k in range(1, n):
        p = parents[k]
        depth[k] = depth[p] + 1
        above_bad[k], above_good[k] = above_bad[p] + bad[p], above_good[p] + good[p]
        order[k] = children[p]
        children[p] += 1
        if p in last:
            before[k], after[last[p]] = last[p], k
        last[p] = k
    chars, links, blocks, points, long_, elements, paragraphs = subtree.T
    density = chars / elements
    siblings = children[parents]
    near = lambda at: np.where(at >= 0, np.log1p(density[at]), -1)
    kind = np.array([_KINDS.get(t, 0) for t in page.tags], float)
    up = np.where(parents >= 0, parents, 0)
    return np.stack([
        np.log1p(chars), links / np.maximum(chars, 1), np.log1p(density), chars / max(chars[0], 1), points / np.maximum(chars, 1), long_ / np.maximum(blocks, 1), paragraphs / elements, np.log1p(elements),
        depth, siblings, order / np.maximum(siblings, 1), near(before), near(after), chars[up] / max(chars[0], 1), links[up] / np.maximum(chars[up], 1), kind, np.minimum(bad, 3), np.minimum(good, 3), np.minimum(above_bad, 3), np.minimum(above_good, 3), np.minimum(either, 3),
    ], 1)


def weak_labels(page: Page) -> np.ndarray:
    """1 for elements that are marked as main text, lie in such, or hold such; 0 for the others."""
    n = len(page.tags)
    inside, label = np.zeros(n), np.zeros(n, int)
    for k in range(n):
        p = page.parents[k]
        state = inside[p] if p >= 0 else 0
        inside[k] = -1 if state < 0 or page.bad[k] else 1 if page.good[k] or state > 0 else 0
        label[k] = inside[k] > 0
    for k in range(n - 1, 0, -1):
        if label[k]:
            label[page.parents[k]] = 1
    label[0] = 1
    return label


@dataclass(frozen=True)
class Trees:
    """Regression trees of one depth as arrays: for each tree the features and bounds of its inner nodes, and its leaves."""

    bias: float
    which: np.ndarray
    bounds: np.ndarray
    leaves: np.ndarray

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.bias)
        each = np.arange(len(rows))
        for which, bounds, leaves in zip(self.which, self.bounds, self.leaves, strict=True):
            node = np.zeros(len(rows), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (rows[each, which[node]] > bounds[node])
            out += leaves[node - len(which)]
        return out


def fit_trees(rows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> Trees:
    """Logistic boosting with second-order leaf values over binned features."""
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias = math.log(share / (1 - share))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(len(rows), bias)
    inner = (1 << DEPTH) - 1
    all_which, all_bounds, all_leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = labels - p, p * (1 - p)
        which, bounds, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(rows), int)
        for k in range(inner):
            here = node == k
            if here.sum() < 2:
                node[here] = 2 * k + 1
                continue
            best = (1e-6, 0, np.inf, 0)
            total_g, total_h = g[here].sum(), h[here].sum()
            for f, c in enumerate(cuts):
                if len(c):
                    left_g = np.cumsum(np.bincount(binned[here, f], g[here], len(c) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[here, f], h[here], len(c) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, c[at], at)
            which[k], bounds[k] = best[1], best[2]
            node[here] = 2 * k + 1 + (rows[here, best[1]] > best[2])
        leaf = node - inner
        sums_g, sums_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        leaves = RATE * sums_g / (sums_h + 1)
        margin += leaves[leaf]
        all_which.append(which)
        all_bounds.append(bounds)
        all_leaves.append(leaves)
    return Trees(bias, np.array(all_which), np.array(all_bounds), np.array(all_leaves))


def decode(page: Page, margin: np.ndarray) -> np.ndarray:
    """The likeliest labels in which every taken element's ancestors are taken; the page itself always is."""
    n = len(page.tags)
    yes, no = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    for k in range(n - 1, 0, -1):
        p = page.parents[k]
        yes[p] += max(yes[k], no[k])
        no[p] += no[k]
    taken = np.zeros(n, bool)
    taken[0] = True
    for k in range(1, n):
        taken[k] = taken[page.parents[k]] and yes[k] > no[k]
    return taken


def _layouts() -> list[str]:
    """Made-up pages with the parts that a page may have, in several orders: around the article, and between its paragraphs too; articles of
    many paragraphs and of a few words, with parts of their own whose names may mean either."""
    rng = np.random.default_rng(7)

    def prose(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(rng.integers(low, high))).capitalize() + ("," if rng.random() < 0.2 else ".")

    def items(kind: str) -> str:
        if kind == "links":
            return "<ul>" + "".join(f"<li><a href='/{k}'>{prose(1, 3)}</a></li>" for k in range(rng.integers(3, 9))) + "</ul>"
        if kind == "words":
            return prose(2, 40)
        return "".join(f"<p>{prose(3, 14 if kind == 'text' else 110)}</p>" for _ in range(rng.integers(1, 4)))

    def wrapped(tag: str, name: str, inner: str) -> str:
        mark = f" {'id' if rng.random() < 0.3 else 'class'}={name}" if name else ""
        return f"<{tag}{mark}>{inner}</{tag}>"

    parts = [("nav", "", "links"), ("header", "", "text"), ("footer", "", "text"), ("aside", "", "links"), ("div", "sidebar", "links"), ("div", "ad-box", "text"), ("div", "cookie-notice", "text"), ("section", "comments", "text"), ("form", "", "text"), ("div", "related-posts", "links"), ("div", "menu", "links"), ("div", "newsletter", "text"), ("div", "legal", "text")]
    within = [("div", "ad", "words"), ("div", "ad", "text"), ("aside", "", "words"), ("aside", "", "long"), ("div", "comments", "long"), ("section", "comments", "long"), ("div", "notice", "words"), ("form", "", "text"), ("nav", "", "links"), ("div", "share", "links"), ("div", "related", "links"), ("figure", "advert", "words")]
    own = [("div", "legal", "text"), ("div", "note", "words"), ("section", "terms", "long"), ("blockquote", "", "text"), ("div", "info-box", "long"), ("div", "", "words")]
    pages = []
    for number in range(160):
        chosen = [parts[k] for k in rng.permutation(len(parts))[: rng.integers(1, 7)]]
        made = [wrapped(tag, name, items(kind)) for tag, name, kind in chosen]
        tag, name = [("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("section", "entry-content")][rng.integers(5)]
        short = number % 4 == 0
        pieces = [f"<h1>{prose(1, 3 if short else 9)}</h1>"] + [f"<p>{prose(1, 4) if short else prose(2, 120)}</p>" for _ in range(rng.integers(1, 3 if short else 9))]
        if rng.random() < 0.3:
            pieces.append("<ul>" + "".join(f"<li>{prose(4, 30)}</li>" for _ in range(4)) + "</ul>")
        for kinds, share in ((within, 0.6), (own, 0.4)):
            while rng.random() < share:
                kind = kinds[rng.integers(len(kinds))]
                pieces.insert(rng.integers(1, len(pieces) + 1), wrapped(kind[0], kind[1], items(kind[2])))
        spot = rng.integers(len(made) + 1)
        pages.append(f"<html><body>{''.join(made[:spot])}<{tag}{f' class={name}' if name else ''}>{''.join(pieces)}</{tag}>{''.join(made[spot:])}</body></html>")
    return pages


def fit(sample: list[str]) -> Trees:
    """Trees from the sampled pages and the made-up layouts, each seen with its marks and without."""
    rows, labels = [], []
    for k, source in enumerate([*sample, *_layouts()]):
        page = read_page(source)
        labels.append(weak_labels(page))
        rows.append(features(page))
        if k % 2 == 0:
            labels.append(labels[-1])
            rows.append(features(page, hide=True))
    return fit_trees(np.concatenate(rows), np.concatenate(labels))


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page; the trees see many pages' elements at once."""
    pages = [read_page(source) for source in sources]
    rows = [features(page) for page in pages]
    margins = np.split(trees.margin(np.concatenate(rows)), np.cumsum([len(x) for x in rows])[:-1]) if rows else []
    out = []
    for page, margin in zip(pages, margins, strict=True):
        taken = decode(page, margin)
        out.append("\n".join(text for owner, text, _ in page.blocks if taken[owner]))
    return out


def _extract(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = main_texts(part.column("html").to_pylist(), trees)
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    marked = pages.where("html IS NOT NULL").select("html", F.xxhash64("html").alias("mark"))
    # the hashes decide first, so that tasks send the driver numbers and only the chosen pages
    bound = marked.select("mark").distinct().orderBy("mark").limit(sample_pages).agg(F.max("mark")).first()[0]
    sample = marked.where(F.col("mark") <= F.lit(bound)).dropDuplicates(["mark"]).orderBy("mark").collect() if bound is not None else []
    trees = fit([row["html"] for row in sample])
    return pages.mapInArrow(_extract(trees), "page_id long, url string, text string, n_chars long")
