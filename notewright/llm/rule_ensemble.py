"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees of depth ``DEPTH`` on a bounded sample of labelled rows give rules, the conjunctions along
their paths; a logistic regression with an L1 penalty keeps few of them; those are compiled into one
Spark column expression over the statistics, which scores every row.

``SAMPLE`` bounds the labelled rows that the fit on the driver sees (the smallest hashes of doc_id); labels
of held-out rows are never among them. Statistics are made of all whole texts in one pass and only they
are kept. Labels, language, source and doc_id are no inputs of the score.

Cases: null and empty texts have statistics of zero and get a score like any other; a null doc_id is not
held out; repeated labels count each; without labels of both kinds every score is the share of 1 (one
half without any); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .line_rules import text_statistics
from .shared import kept
from .texts import BLANKS, MARKS, Texts, pieces, words

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 32, 0.3
PENALTY, STEPS = 0.002, 400
LEAST_LEAF = 20

STATISTICS = (
    "n_words", "mean_word", "upper_share", "symbol_share", "digit_share", "mark_share", "wide_share", "distinct_share",
    "same_as_before", "repeat_share", "dup_line_share", "mean_line", "marked_words", "capital_words",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def statistics(texts: Texts) -> np.ndarray:
    """A row of STATISTICS for every text."""
    base = text_statistics(texts)
    found = words(texts)
    n = np.maximum(1, found.counts).astype(float)
    letters = np.maximum(1, base["word_chars"]).astype(float)
    codes, _ = found.encoded()
    owners = found.owners()
    pairs = np.unique(owners * (codes.max(initial=0) + 1) + codes) // (codes.max(initial=0) + 1)
    same = np.r_[False, (codes[1:] == codes[:-1]) & (owners[1:] == owners[:-1])][: len(codes)]
    count = lambda marks: np.bincount(owners[marks], minlength=len(texts))
    line_count = np.bincount(base["line_owner"], minlength=len(texts))
    text = texts.data
    per = lambda marks: texts.per_text(marks[text])
    marked = MARKS & ~BLANKS
    ends_marked = marked[text[found.ends - 1]] if len(found) else np.zeros(0, bool)
    capital = _UPPER[text[found.starts]] if len(found) else np.zeros(0, bool)
    return np.stack(
        [
            found.counts.astype(float), base["word_chars"] / n, per(_UPPER) / letters, base["n_symbols"] / letters,
            per(_DIGIT) / letters, per(marked) / letters, texts.per_text(text >= 0xC0) / letters,
            np.bincount(pairs, minlength=len(texts)) / n, count(same) / n, base["n_repeat_words"] / n,
            base["n_dup_lines"] / np.maximum(1, line_count), found.counts / np.maximum(1, line_count), count(ends_marked) / n,
            count(capital) / n,
        ],
        axis=1,
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in pieces(batch):
            values = statistics(texts)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(v) for v in values.T)], ["doc_id", *STATISTICS]
            )


Rule = tuple[tuple[int, bool, float], ...]  # conditions: statistic, whether above, threshold


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted trees for the logistic loss, from the root to every node, without repeats."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        level: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for depth in range(DEPTH + 1):
            below = []
            for rows, path in level:
                if path:
                    found[tuple(sorted(path))] = None
                best = (1e-9, None)
                total_g, total_h = g[rows].sum(), h[rows].sum()
                for f in range(x.shape[1]) if depth < DEPTH else []:
                    size = len(cuts[f]) + 1
                    sg = np.cumsum(np.bincount(bins[rows, f], g[rows], size))[:-1]
                    sh = np.cumsum(np.bincount(bins[rows, f], h[rows], size))[:-1]
                    c = np.cumsum(np.bincount(bins[rows, f], minlength=size))[:-1]
                    gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                    gain[(c < LEAST_LEAF) | (len(rows) - c < LEAST_LEAF)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (gain.max(), (f, int(gain.argmax())))
                if best[1] is None:
                    score[rows] += RATE * total_g / (total_h + 1)
                    continue
                f, cut = best[1]
                up = bins[rows, f] > cut
                for above in (False, True):
                    below.append((rows[up == above], (*path, (f, above, float(cuts[f][cut])))))
            level = below
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Intercept and weights of the logistic regression with penalty PENALTY on the absolute weights."""
    n, m = z.shape
    rate = 4 * n / (np.linalg.norm(z, 2) ** 2 + n)
    w, b = np.zeros(m), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    at_w, at_b, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        error = 1 / (1 + np.exp(-(z @ at_w + at_b))) - y
        new = at_w - rate * (z.T @ error) / n
        new = np.sign(new) * np.maximum(0, np.abs(new) - rate * PENALTY)
        new_b = at_b - rate * error.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w, at_b, t = new + (t - 1) / u * (new - w), new_b + (t - 1) / u * (new_b - b), u
        w, b = new, new_b
    return float(b), w


def fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept and weighted rules; for labels of one kind only an intercept."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if not 0 < y.sum() < len(y):
        return float(np.log(share / (1 - share))), []
    rules = tree_rules(x, y)
    if not rules:
        return float(np.log(share / (1 - share))), []
    b, w = lasso(np.stack([holds(r, x) for r in rules], 1).astype(float), y)
    return b, [(float(k), r) for k, r in zip(w, rules) if abs(k) > 1e-6]


def compiled(intercept: float, rules: list[tuple[float, Rule]]) -> Column:
    """The ensemble as a column over STATISTICS."""
    total = F.lit(intercept)
    for weight, rule in rules:
        condition = F.lit(True)
        for f, above, cut in rule:
            condition &= (F.col(STATISTICS[f]) > cut) if above else (F.col(STATISTICS[f]) <= cut)
        total = total + F.when(condition, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row doc_id, held_out and score."""
    measured = kept(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measure, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)))
    chosen = (
        labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
        .select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    )
    rows = measured.join(chosen, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "quality", *STATISTICS).limit(sample)
    seen = rows.select("quality", *STATISTICS).toPandas().to_numpy(float).reshape(-1, 1 + len(STATISTICS))
    model = fitted(seen[:, 1:], seen[:, 0])
    return measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), compiled(*model).alias("score"))
