"""Main text of web pages by boosted trees over DOM nodes (operator 2).

Every block element gets features of its subtree (text and link density, sentence ends,
blocks), of its attributes' words, its depth, its siblings and its ancestors, and from them
a probability to belong to the article. Decoding is by tree: an element may belong only if
its parent does, and of all such choices the likeliest is taken, found bottom up. The text
blocks of the chosen elements are the result, in page order.

Cases: null, empty and textless pages give an empty text; unclosed and misplaced tags are
repaired as browsers do; a line break inside a block is white space; text that stands
directly in the body is judged like an element, run by run; a page of which nothing else than
such text would be left out whole keeps it; rows that repeat a page_id, or have
none, each get a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import columns, short_batches
from tessel.llm.dom import BARE, INLINE, VOID, Page, attributes
from tessel.llm.trees import BoostedTrees

TAG_GROUPS = [
    {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl", "menu"}, {"li", "dt", "dd"}, {"article"}, {"main"}, {"section"}, {"div"}, {"nav"}, {"header", "hgroup"}, {"footer"}, {"aside"},
    {"form", "fieldset", "button", "label", "input", "dialog"}, {"table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"figure", "figcaption"}, {"blockquote", "pre"},
]

WORD_GROUPS = [set(x.split()) for x in (
    "nav menu navbar navigation breadcrumb breadcrumbs toc pager pagination tabs",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "comment comments reply replies respond discussion disqus reader readers",
    "sidebar aside related widget rail recommended more popular trending",
    "cookie cookies consent notice alert popup modal newsletter subscribe signup gdpr overlay warning",
    "footer foot copyright legal colophon",
    "header head masthead logo topbar brand branding skip",
    "share sharing social follow print",
    "meta byline author date tags category",
    "form search login contact",
    "content article post entry story body text main page prose",
)]
BAD_WORDS = set().union(*WORD_GROUPS[:10])
BAD_TAGS = frozenset({"nav", "footer", "aside", "form", "dialog"})
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@functools.lru_cache(maxsize=20_000)
def attribute_flags(attrs: str) -> tuple[tuple[float, ...], bool]:
    """Which word groups its class, id and role have; whether it is hidden."""
    if not attrs.strip():
        return (0.0,) * len(WORD_GROUPS), False
    found = attributes(attrs)
    words = {w.lower() for k in ("class", "id", "role", "aria-label") for w in WORDS.findall(found.get(k, ""))}
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    return tuple(float(bool(words & g)) for g in WORD_GROUPS), hidden


_GROUP_OF = {tag: k for k, tags in enumerate(TAG_GROUPS) for tag in tags}


def node_features(page: Page) -> tuple[list[int], np.ndarray]:
    """The nodes that are to be judged, and their features."""
    nodes = page.nodes
    n = len(nodes)
    chars, links, stops, blocks, size = ([0] * n for _ in range(5))
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        chars[k] += node.chars
        links[k] += node.link_chars
        stops[k] += node.stops
        blocks[k] += node.blocks
        size[k] += 1
        if k:
            p = node.parent
            chars[p] += chars[k]
            links[p] += links[k]
            stops[p] += stops[k]
            blocks[p] += blocks[k]
            size[p] += size[k]
    total = max(1, chars[0])
    bad, good = [False] * n, [False] * n
    judged, rows = [], []
    alike: dict[int, Counter] = {}  # of each parent, its children by tag
    for k, node in enumerate(nodes):
        flags, hidden = attribute_flags(node.attrs)
        if k:
            bad[k] = bad[node.parent]
            good[k] = good[node.parent]
        up_bad, up_good = bad[k], good[k]
        bad[k] = bad[k] or node.tag in BAD_TAGS or hidden or any(flags[:10])
        good[k] = good[k] or node.tag in ("article", "main") or bool(flags[10])
        if node.tag in INLINE or node.tag in VOID or node.tag in BARE or not chars[k]:
            continue
        siblings = nodes[node.parent].children
        if node.parent not in alike:
            alike[node.parent] = Counter(nodes[c].tag for c in siblings)
        same = alike[node.parent][node.tag]
        c = chars[k]
        group = [0.0] * len(TAG_GROUPS)
        if (g := _GROUP_OF.get(node.tag)) is not None:
            group[g] = 1.0
        judged.append(k)
        rows.append(
            [math.log1p(c), links[k] / c, 100 * stops[k] / c, math.log1p(blocks[k]), c / max(1, blocks[k]), math.log1p(size[k]), c / size[k], node.depth, node.index, len(siblings), same / len(siblings), c / total, k / n, float(hidden), float(up_bad), float(up_good), *group, *flags]
        )
    return judged, np.array(rows, dtype=np.float64).reshape(len(judged), 16 + len(TAG_GROUPS) + len(WORD_GROUPS))


@functools.lru_cache(maxsize=1)
def model() -> BoostedTrees:
    return BoostedTrees.load(resources.files("tessel.llm").joinpath("models/pages.json").read_text())


def decode(page: Page, judged: list[int], margins: np.ndarray) -> set[int]:
    """The likeliest set of nodes in which every node's parent is, too; body and root always are."""
    n = len(page.nodes)
    inside, outside = np.zeros(n), np.zeros(n)
    inside[judged] = -np.logaddexp(0, -margins)
    outside[judged] = -np.logaddexp(0, margins)
    inside, outside = inside.tolist(), outside.tolist()
    for k in range(n - 1, 0, -1):  # children come after their parents
        best = inside[k] if page.nodes[k].tag in BARE else max(inside[k], outside[k])
        inside[page.nodes[k].parent] += best
        outside[page.nodes[k].parent] += outside[k]
    kept = {0}
    for k in range(1, n):
        if page.nodes[k].parent in kept and (page.nodes[k].tag in BARE or inside[k] >= outside[k]):
            kept.add(k)
    return kept


def texts(sources: list[str | None], trees: BoostedTrees | None = None) -> list[str]:
    trees = trees or model()
    pages = [Page(s) for s in sources]
    found = [node_features(p) for p in pages]
    width = 16 + len(TAG_GROUPS) + len(WORD_GROUPS)
    margins = trees.margin(np.concatenate([x for _, x in found] or [np.zeros((0, width))]))
    out, at = [], 0
    for page, (judged, _) in zip(pages, found):
        kept = decode(page, judged, margins[at : at + len(judged)])
        at += len(judged)
        blocks = [t for k, t in page.blocks if k in kept]
        out.append("\n".join(blocks or [t for k, t in page.blocks if page.nodes[k].tag == "#text"]))
    return out


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = texts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    short_batches(pages.sparkSession)
    rows = columns(pages, page_id="page_id", url="url", html="html")
    return rows.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
