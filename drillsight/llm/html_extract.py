"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy.

Every block-level element and every run of text (``dom.py``) is a node with features of its
subtree (text, tag and link density, punctuation), of its attribute tokens and those of
its ancestors, of its depth, and of its siblings.  Gradient-boosted trees (``boosting.py``) give the
chance that the node holds main text.  Choices are then made for all nodes of a page together:
the likeliest labelling in which what is below a dropped node is dropped, and an element that is
kept keeps some of its text.  That is exact, by one pass from the leaves up and one down.

The trees are trained on pages with known parts (``layouts.py``), whose texts are a bounded sample
of the blocks of the given pages: at most ``SAMPLED_PAGES`` pages and ``SAMPLED_BLOCKS`` distinct
blocks, cut to ``BLOCK_CHARS`` characters, reach the driver.  The sample teaches; every page is
extracted from its whole HTML.

Rules: a null page is an empty one and gives an empty text, as does a page without main
text.  Blocks come in page order, white space in a block is one space, blocks are joined by an
empty line.  Repeated rows are extracted each, with equal results; rows do not depend on each
other beyond the model, which does not change with the number of copies of a block.  A table
without pages gives no rows.  A null id is kept.  Other columns of the table are not read.  A
page is worked on as a whole in one task; memory follows the longest page.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drillsight.llm.boosting import Trees, fit_trees
from drillsight.llm.common import steps, table, whole_texts
from drillsight.llm.dom import TEXT, Tree, parse
from drillsight.llm.layouts import MARK, Layouts

SAMPLED_PAGES, SAMPLED_BLOCKS, BLOCK_CHARS = 400, 3_000, 900
#: Drawn pages the trees are fitted on.
DRAWN_PAGES = 1_200
#: Blocks of so many words and more are long.
LONG_WORDS = 8
#: Pages one step works on at once.
STEP_PAGES = 256

_KINDS = (("h1", "h2", "h3", "h4", "h5", "h6"), ("p",), ("li",), ("ul", "ol", "dl"), ("div", "section"), ("td", "th"), (TEXT,))
_STOPS = frozenset(".,;:!?")


@dataclass
class Nodes:
    """The nodes of several pages, one behind the other, in page order."""

    trees: list[Tree]

    def __post_init__(self) -> None:
        sizes = [len(t.tags) for t in self.trees]
        starts = np.cumsum([0, *sizes])
        self.root = np.repeat(starts[:-1], sizes)

        def column(name: str) -> np.ndarray:
            return np.array([x for t in self.trees for x in getattr(t, name)], np.int64)

        self.tags = [x for t in self.trees for x in t.tags]
        self.texts = [x for t in self.trees for x in t.texts]
        self.tokens = [x for t in self.trees for x in t.tokens]
        self.depth = column("depths")
        self.end = column("ends") + self.root
        parent = column("parents")
        self.parent = np.where(parent < 0, -1, parent + self.root)
        self.up = np.where(parent < 0, self.root, parent + self.root)
        self.counts = {c: column(c) for c in ("link_chars", "links", "inputs", "images", "inlines")}

    def below(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees, the node included."""
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[self.end] - total[:-1]


def _down(nodes: Nodes, own: np.ndarray, fold: np.ufunc) -> np.ndarray:
    """``own`` folded over a node's ancestors (without the node; 0 at the root)."""
    out = np.zeros(len(own))
    order = np.argsort(nodes.depth, kind="stable")
    ends = np.searchsorted(nodes.depth[order], np.arange(nodes.depth.max(initial=0) + 2))
    for level in range(1, len(ends) - 1):
        at = order[ends[level] : ends[level + 1]]
        up = nodes.parent[at]
        out[at] = fold(out[up], own[up])
    return out


def features(nodes: Nodes, odds: dict[str, float]) -> np.ndarray:
    """One row a node.  ``odds`` has the log-odds of attribute tokens and tags."""
    n = len(nodes.tags)
    chars = np.fromiter(map(len, nodes.texts), float, n)
    words = np.fromiter((x.count(" ") + 1 if x else 0 for x in nodes.texts), float, n)
    stops = np.fromiter((sum(map(x.count, _STOPS)) if x else 0 for x in nodes.texts), float, n)
    digits = np.fromiter((sum(map(str.isdigit, x)) if len(x) < 200 else 0 for x in nodes.texts), float, n)
    element = np.fromiter((t != TEXT for t in nodes.tags), float, n)
    paragraph = np.fromiter((t == "p" for t in nodes.tags), float, n)
    total, n_words = nodes.below(chars), nodes.below(words)
    sums = {c: nodes.below(v) for c, v in nodes.counts.items()}
    n_tags = nodes.below(element) + sums["inlines"] + sums["images"]
    linked = sums["link_chars"] / np.maximum(total, 1)

    known: dict[tuple[str, ...], tuple[float, float, float]] = {}
    scores = np.empty((n, 3))
    for k, tokens in enumerate(nodes.tokens):
        if tokens not in known:
            found = [odds.get(x, 0.0) for x in tokens] or [0.0]
            known[tokens] = min(found + [0.0]), max(found + [0.0]), sum(found)
        scores[k] = known[tokens]
    worst, best, whole = scores.T
    tokens_below = (nodes.below(whole) - whole) / np.maximum(nodes.below(element) - element, 1)

    up = nodes.up
    inner = nodes.parent >= 0
    siblings = np.bincount(up[inner], minlength=n)[up].astype(float)
    place = np.zeros(n)
    last: dict[int, int] = {}
    before = np.full(n, -1)
    for k, p in enumerate(nodes.parent.tolist()):
        if p in last and p >= 0:
            before[k] = last[p]
            place[k] = place[last[p]] + 1
        last[p] = k
    after = np.full(n, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    log_chars = np.log1p(total)

    def mean_of_siblings(values: np.ndarray) -> np.ndarray:
        return np.bincount(up[inner], values[inner], n)[up] / np.maximum(siblings, 1)

    tag_ids: dict[str, int] = {}
    tag_of = np.array([tag_ids.setdefault(t, len(tag_ids)) for t in nodes.tags])
    pair = up * len(tag_ids) + tag_of
    same, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    run_before = np.cumsum(chars) - chars
    columns = [
        log_chars,
        np.log1p(n_words),
        linked,
        np.log1p(total / (n_tags + 1)),
        nodes.below(stops) / np.maximum(n_words, 1),
        (total - n_words) / np.maximum(n_words, 1),
        nodes.below(digits) / np.maximum(total, 1),
        np.log1p(sums["links"]),
        np.log1p(sums["inputs"]),
        np.log1p(sums["images"]),
        np.log1p(nodes.below(paragraph)),
        nodes.depth.astype(float),
        worst,
        best,
        whole,
        _down(nodes, whole, np.add),
        _down(nodes, worst, np.minimum),
        _down(nodes, best, np.maximum),
        whole[up] * inner,
        tokens_below,
        np.log1p(siblings),
        place / np.maximum(siblings, 1),
        mean_of_siblings(log_chars),
        mean_of_siblings(linked),
        mean_of_siblings(whole),
        times[back] / np.maximum(siblings, 1),
        np.where(before >= 0, log_chars[before], -1),
        np.where(after >= 0, log_chars[after], -1),
        np.where(before >= 0, whole[before], 0),
        np.where(after >= 0, whole[after], 0),
        (run_before - run_before[nodes.root]) / np.maximum(total[nodes.root], 1),
        total / np.maximum(total[nodes.root], 1),
        total / np.maximum(total[up], 1),
    ]
    columns += [np.fromiter((t in kind for t in nodes.tags), float, n) for kind in _KINDS]
    return np.stack(columns, axis=1)


def decode(nodes: Nodes, chance: np.ndarray) -> np.ndarray:
    """The likeliest labels without contradictions: which nodes are kept."""
    p = np.clip(chance, 1e-6, 1 - 1e-6)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    parent, texts = nodes.parent.tolist(), nodes.texts
    n = len(yes)
    gain = [0.0] * n  # of the children that gain by being kept
    closest, choice = [-math.inf] * n, [-1] * n  # the child that loses least, if none gains
    dropped = no[:]  # the value of a subtree that is dropped whole
    better = [-math.inf] * n  # how much better it is kept
    for k in range(n - 1, -1, -1):
        if texts[k]:
            better[k] = yes[k] - no[k]
        elif closest[k] > -math.inf:
            better[k] = yes[k] - no[k] + (gain[k] if gain[k] > 0 else closest[k])
        up = parent[k]
        if up >= 0:
            dropped[up] += dropped[k]
            if better[k] > 0:
                gain[up] += better[k]
            if better[k] > closest[up]:
                closest[up], choice[up] = better[k], k
    kept = np.zeros(n, bool)
    for k, up in enumerate(parent):
        if up < 0:
            kept[k] = better[k] > 0
        elif kept[up]:
            kept[k] = better[k] > 0 or (choice[up] == k and gain[up] <= 0)
    return kept


@dataclass
class Model:
    odds: dict[str, float]
    trees: Trees

    def texts(self, trees: list[Tree]) -> list[str]:
        """The main text of each page."""
        nodes = Nodes(trees)
        kept = decode(nodes, self.trees.probability(features(nodes, self.odds)))
        out: list[list[str]] = [[] for _ in trees]
        page = np.cumsum(nodes.parent < 0) - 1
        for k in np.flatnonzero(kept).tolist():
            if nodes.texts[k]:
                out[page[k]].append(nodes.texts[k])
        return ["\n\n".join(x) for x in out]


def token_odds(nodes: Nodes, main: np.ndarray, use: np.ndarray, least: int = 3) -> dict[str, float]:
    """Smoothed log-odds of each token's nodes against those of all nodes, over the nodes in ``use``."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for k in np.flatnonzero(use).tolist():
        for token in nodes.tokens[k]:
            counts[token][int(main[k])] += 1
    base = (main[use].sum() + 1) / (use.sum() + 2)
    return {
        token: math.log((yes + base) / (no + 1 - base)) - math.log(base / (1 - base))
        for token, (no, yes) in counts.items()
        if no + yes >= least
    }


def fit(long: list[str], short: list[str], pages: int = DRAWN_PAGES, seed: int = 1) -> Model:
    """Train on drawn pages with the given texts."""
    draw = Layouts(long, short, seed)
    nodes = Nodes(trees := [parse(draw.page(), MARK) for _ in range(pages)])
    own = np.array([m == "1" and bool(x) for t in trees for m, x in zip(t.marks, t.texts, strict=True)], float)
    main = nodes.below(own) > 0
    shown = nodes.below(np.fromiter(map(len, nodes.texts), float, len(nodes.texts))) > 0
    # Each half of the pages sees the odds of tokens of the other half, else the trees would
    # trust rare tokens as if they were seen often.
    half = nodes.root < nodes.root[len(nodes.root) // 2]
    x = np.zeros(0)
    for use in (half, ~half):
        seen = features(nodes, token_odds(nodes, main, ~use))
        x = np.where(use[:, None], seen, x) if x.size else seen
    return Model(token_odds(nodes, main, main | True), fit_trees(x[shown], main[shown]))


def sampled_blocks(pages: DataFrame, key: Column, html: str = "html") -> tuple[list[str], list[str]]:
    """Distinct long and short blocks of a bounded sample of pages."""
    some = pages.select(F.xxhash64(key).alias("mark")).distinct().orderBy("mark").limit(SAMPLED_PAGES)
    chosen = pages.select(F.xxhash64(key).alias("mark"), F.col(html).alias("html")).join(F.broadcast(some), "mark", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            blocks = {x[:BLOCK_CHARS] for html in whole_texts(batch.column(1)) for x in parse(html).texts if x}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(blocks), pa.string())], ["block"])

    blocks = chosen.mapInArrow(run, "block string").distinct().orderBy(F.xxhash64("block"), "block").limit(SAMPLED_BLOCKS)
    found = [r["block"] for r in blocks.collect()]
    return [x for x in found if x.count(" ") >= LONG_WORDS], [x for x in found if x.count(" ") < LONG_WORDS]


def extract(pages: DataFrame, model: Model, *keep: str, html: str = "html") -> DataFrame:
    """``keep`` and ``text``: the main text of every page."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in steps(batches, len(keep)):
            for first in range(0, big.num_rows, STEP_PAGES):
                batch = big.slice(first, STEP_PAGES)
                texts = sent.value.texts([parse(x) for x in whole_texts(batch.column(len(keep)))])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    plain = pages.select(*keep, html)
    schema = T.StructType([*plain.schema.fields[:-1], T.StructField("text", T.StringType())])
    return plain.mapInArrow(run, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    pages = table(spark, folder, "pages")
    model = fit(*sampled_blocks(pages, F.col("page_id")))
    return extract(pages, model, "page_id", "url").withColumn("n_chars", F.char_length("text").cast("long"))
