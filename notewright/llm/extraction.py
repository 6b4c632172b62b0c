"""Main text of web pages by a tree-structured graphical model of their markup.

Every block element and every run of text of a page is a variable: part of the article or not. Its own
potential is a weighted sum of features of markup, class words, links, length and place; parent and child
are connected by potentials that depend on the kind of child. Sum-product messages go up the tree and down
again and give each variable's exact marginal; runs of text with a marginal above one half are the main text.

The weights maximise the likelihood of labelled pages. Its gradient is observed less expected counts, and the
expected ones come from the same messages. At most ``SAMPLE`` labelled pages are fitted on the driver; this
is the only bound. Pages are read whole, each in the task that read it, in pieces of bounded size; nothing
is shuffled.

Blocks are separated by one space, and white space inside a block (any that Unicode calls so, a no-break
space too, and line breaks) becomes one. Scripts, styles, hidden templates and drawings have no text.

Cases: a null page is empty; a page without markup is a run of text under the page itself; broken and
unclosed markup is read as a browser reads it; an empty result is an empty text, never null; very long and very deep
pages need memory in proportion to the page; repeated rows and equal texts give equal rows; an empty table
gives an empty result; further columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled_pages import NAMES, labelled_pages
from .markup import HEADINGS, Tree, parsed

SAMPLE = 300
PIECE_CHARS = 1 << 20
PENALTY = 1e-2
ROUNDS = 250

# --- fixed values: groups of element names that the model tells apart ---------------------------
PROSE = {"p", "blockquote", "pre", "figure", "figcaption", "ul", "ol", "li", "dl", "dt", "dd", *HEADINGS}
CELLS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"}
PLAIN = {"div", "section", "center", "span", "body", "#page", "frameset"}
APART = {"nav", "aside", "header", "footer", "form", "button", "select", "option", "label", "fieldset", "menu", "dialog", "address"}
# -------------------------------------------------------------------------------------------------
#: Kinds of child; each has a potential for every pair of states of parent and child.
KINDS = {tag: k for k, group in enumerate((["#text"], sorted(PROSE), sorted(CELLS), sorted(PLAIN), sorted(APART), ["article", "main"])) for tag in group}
N_KINDS = 7
TAGS = {tag: k for k, tag in enumerate(sorted(KINDS) + ["head", "#other"])}
WORDS = sorted({w for words in NAMES.values() for w in words} | {"hidden", "complementary", "contentinfo"})
WORD = {w: k for k, w in enumerate(WORDS)}
NUMBERS = 16
#: Own tag, parent's tag, class words, and numbers apart for elements and runs.
N_FEATURES = 2 * len(TAGS) + len(WORDS) + 2 * NUMBERS


@functools.lru_cache(maxsize=1 << 16)
def word_feature(word: str) -> tuple[int, ...]:
    """The known class word, or those of four letters and more that it begins or ends with."""
    if word in WORD:
        return (WORD[word],)
    return tuple(WORD[w] for w in WORDS if len(w) >= 4 and (word.startswith(w) or word.endswith(w)))


def levels_of(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth; a node's parent comes before it."""
    out = []
    level = np.flatnonzero(parent < 0)
    depth = np.zeros(len(parent), np.int64)
    for k, p in enumerate(parent.tolist()):
        if p >= 0:
            depth[k] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    edges = np.searchsorted(depth[order], np.arange(depth.max(initial=-1) + 2))
    return [order[a:b] for a, b in zip(edges[:-1], edges[1:])]


class Forest:
    """The nodes of many pages, and their features: indices of the ones that hold, and numbers."""

    def __init__(self, trees: list[Tree]) -> None:
        bases = np.r_[0, np.cumsum([len(t.tag) for t in trees])].astype(np.int64)
        self.bases = bases
        self.parent = np.concatenate([np.where((p := np.array(t.parent, np.int64)) < 0, -1, p + b) for t, b in zip(trees, bases)] or [np.zeros(0, np.int64)])
        tags = [tag for t in trees for tag in t.tag]
        n = len(tags)
        self.levels = levels_of(self.parent)
        self.kind = np.array([KINDS.get(t, N_KINDS - 1) for t in tags], np.int64)
        tag = np.array([TAGS.get(t, TAGS["#other"]) for t in tags], np.int64)
        self.is_run = run = np.array([t == "#text" for t in tags], bool)
        own = np.arange(n)
        above = np.where(self.parent >= 0, len(TAGS) + tag[self.parent], len(TAGS) + TAGS["#page"])
        pairs = [(k, 2 * len(TAGS) + f) for k, names in enumerate(x for t in trees for x in t.names) for w in names for f in word_feature(w)]
        more = np.array(pairs, np.int64).reshape(-1, 2)
        more = np.unique(more, axis=0) if len(more) else more
        self.rows = np.concatenate([own, own, more[:, 0]])
        self.columns = np.concatenate([tag, above, more[:, 1]])

        texts = [text for t in trees for text in t.text]
        chars = np.array([len(x) for x in texts], float)
        linked = np.array([x for t in trees for x in t.linked], float)
        stops = np.array([x.count(".") + x.count("?") + x.count("!") + x.count(",") for x in texts], float)
        spaces = np.array([x.count(" ") + 1 if x else 0 for x in texts], float)
        signs = np.array(["©" in x or "Copyright" in x for x in texts], float)
        runs = run.astype(float)
        page = np.repeat(np.arange(len(trees)), np.diff(bases))
        before = np.cumsum(chars) - chars
        for level in reversed(self.levels[1:]):  # sums over everything below
            for values in (chars, linked, stops, spaces, signs, runs):
                np.add.at(values, self.parent[level], values[level])
        whole = np.maximum(chars[bases[:-1]], 1)[page] if n else chars
        start = (before - before[bases[:-1]][page]) / whole if n else chars
        some = np.maximum(chars, 1)
        ends = np.array([bool(x) and x[-1] in ".!?…:;\"”»" for x in texts], float)
        numbers = np.stack([
            np.ones(n), linked / some, np.log1p(chars) / 5, chars / whole, (chars == 0), (linked > 0.7 * some) & (chars > 0),
            np.minimum(stops / np.maximum(spaces, 1), 1) * 3, signs > 0, np.log1p(chars / np.maximum(runs, 1)) / 5,
            np.log1p(runs) / 3, start, (start < 0.03), (start + chars / whole > 0.97), ends, (spaces < 4), chars / whole > 0.6,
        ], 1).astype(float) if n else np.zeros((0, NUMBERS))
        self.numbers = numbers
        self.first = 2 * len(TAGS) + len(WORDS) + np.where(run, NUMBERS, 0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        n = len(self.parent)
        out = np.bincount(self.rows, weights[self.columns], minlength=n)
        for k in range(NUMBERS):
            out += self.numbers[:, k] * weights[self.first + k]
        return out

    def counts(self, values: np.ndarray) -> np.ndarray:
        """The features of all nodes, each node weighted."""
        out = np.bincount(self.columns, values[self.rows], minlength=N_FEATURES)
        for k in range(NUMBERS):
            out += np.bincount(self.first + k, self.numbers[:, k] * values, minlength=N_FEATURES)
        return out


def marginals(forest: Forest, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product over all trees: P(node = 1), P(parent, child) per node with a parent, and log Z."""
    n, parent = len(forest.parent), forest.parent
    belief = np.zeros((n, 2))
    belief[:, 1] = forest.scores(weights)
    up = np.zeros((n, 2))
    tables = pair[forest.kind]  # node, parent's state, own state
    for level in reversed(forest.levels[1:]):
        up[level] = np.logaddexp.reduce(belief[level, None, :] + tables[level], axis=2)
        for s in (0, 1):
            belief[:, s] += np.bincount(parent[level], up[level, s], minlength=n)
    down = np.zeros((n, 2))
    both = np.zeros((n, 2, 2))
    total = 0.0
    for depth, level in enumerate(forest.levels):
        if depth:
            outer = belief[parent[level]] + down[parent[level]] - up[level]
            joint = outer[:, :, None] + tables[level] + belief[level, None, :]
            down[level] = np.logaddexp.reduce(outer[:, :, None] + tables[level], axis=1)
            both[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(-1, 4), axis=1)[:, None, None])
        else:
            total = float(np.logaddexp.reduce(belief[level], axis=1).sum())
    last = belief + down
    return 1 / (1 + np.exp(np.clip(last[:, 0] - last[:, 1], -500, 500))), both, total


def labels_of(trees: list[Tree]) -> np.ndarray:
    """1 where the nearest mark, the node's own or one above, says so."""
    out = []
    for t in trees:
        own: list[int] = []
        for p, main in zip(t.parent, t.main):
            own.append(int(main) if main in ("0", "1") else own[p] if p >= 0 else 0)
        out += own
    return np.array(out, np.int64)


Model = tuple[np.ndarray, np.ndarray]


def fitted(pages: list[str]) -> Model:
    """Weights of features and of pairs, by gradient steps with momentum and a step size for every weight."""
    trees = [parsed(p) for p in pages]
    forest, y = Forest(trees), labels_of(trees)
    child = np.flatnonzero(forest.parent >= 0)
    seen = forest.counts(y.astype(float))
    seen_pairs = np.zeros((N_KINDS, 2, 2))
    np.add.at(seen_pairs, (forest.kind[child], y[forest.parent[child]], y[child]), 1)
    size = N_FEATURES + seen_pairs.size
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    n = max(len(y), 1)
    for step in range(1, ROUNDS + 1):
        p, both, _ = marginals(forest, w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2))
        hoped = np.zeros((N_KINDS, 2, 2))
        np.add.at(hoped, forest.kind[child], both[child])
        slope = np.concatenate([seen - forest.counts(p), (seen_pairs - hoped).ravel()]) / n - PENALTY * w / n
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        w = w + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6) * min(1, 2 - 2 * step / ROUNDS + 0.02)
    return w[:N_FEATURES], w[N_FEATURES:].reshape(N_KINDS, 2, 2)


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    trees = [parsed(p) for p in pages]
    forest = Forest(trees)
    taken = (marginals(forest, *model)[0] > 0.5) & forest.is_run
    out = []
    for tree, first in zip(trees, forest.bases.tolist()):
        own = taken[first : first + len(tree.tag)]
        out.append(" ".join(tree.text[k] for k in np.flatnonzero(own).tolist()))
    return out


def _extract(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, pages = batch.columns[:-1], batch.column(batch.num_columns - 1)
            first, held, size = 0, [], 0
            for k in range(batch.num_rows):
                page = pages[k].as_py()
                held.append(page)
                size += len(page or "")
                if size >= PIECE_CHARS or k + 1 == batch.num_rows:
                    texts = main_texts(held, model)
                    cut = [c.slice(first, len(held)) for c in rest]
                    chars = pa.array([len(t) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([*cut, pa.array(texts, pa.string()), chars], names=names)
                    first, held, size = k + 1, [], 0

    return run


def model_of(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` rows of ``labelled`` (html with marks), those of the smallest hashes."""
    rows = labelled.where("html is not null").select("html").orderBy(F.xxhash64("html"), "html").limit(sample)
    return fitted([r.html for r in rows.collect()])


def main_text(pages: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html)."""
    model = model_of(labelled, sample)
    names = ["page_id", "url", "text", "n_chars"]
    return pages.select("page_id", "url", "html").mapInArrow(_extract(model, names), "page_id long, url string, text string, n_chars long")


def own_labelled_pages(spark: SparkSession, count: int = SAMPLE) -> DataFrame:
    return spark.createDataFrame([(p,) for p in labelled_pages(count)], "html string")


#: The expected texts of the given ``pages`` in SQL, from what their generator marks as article.
ARTICLES_SQL = r"""
WITH inner_html AS (
  SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
plain AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM inner_html),
texts AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM plain)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""
