"""Quality rules: statistics of whole documents, fixed base rules, and gradient-boosted trees over the statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches
from .sampling import held_out, labelled_sample
from .words import WordBlock, word_blocks

#: Most sample documents of a label, trees, their depth, bins of a statistic, and least documents of a leaf.
PER_CLASS, TREES, DEPTH, BINS, LEAF = 3000, 60, 4, 64, 10
#: Documents with less than this chance of quality are rejected.
REJECT = 0.3

#: Statistics in order. A 1 or -1: the chance of quality may only rise, or only fall, with the statistic.
STATISTICS = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "echo_share": -1,
    "top_share": -1,
    "distinct_share": 0,
    "upper_share": -1,
    "digit_share": 0,
    "mark_share": 0,
    "wide_share": 0,
    "words_per_line": 0,
}

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122) and c not in SYMBOLS)
CONTINUED, WIDE = bytes(range(128, 192)), bytes(range(192, 256))


@dataclass
class Counts:
    """Whole-number statistics of the texts of a block."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.n_repeat_words > 50 * self.n_words)


def repeated_words(block: WordBlock, size: int = 3) -> np.ndarray:
    """Words of each text that lie in a window of `size` words found at least twice in the text."""
    text = np.repeat(np.arange(len(block.counts)), block.counts)
    n = len(text) - size + 1
    if n <= 0:
        return np.zeros(len(block.counts), np.int64)
    # numbers of windows, longer by one word in each step; each stays below texts x words x words
    width = int(block.codes.max()) + 1
    window = text[:n]
    for at in range(size):
        window = np.unique(window * width + block.codes[at : at + n], return_inverse=True)[1]
    inside = text[:n] == text[size - 1 :]
    often = (np.bincount(window[inside], minlength=n) >= 2)[window] & inside
    covered = np.zeros(len(text), bool)
    for at in range(size):
        covered[at : at + n] |= often
    return np.bincount(text[covered], minlength=len(block.counts))


def count(block: WordBlock) -> Counts:
    held = {name: np.array([len(t) - len(t.translate(None, chars)) for t in block.texts], np.int64) for name, chars in (("space", SPACE), ("symbols", SYMBOLS), ("upper", UPPER), ("digits", DIGITS), ("marks", MARKS), ("continued", CONTINUED), ("wide", WIDE))}
    n, m = block.counts, len(block.counts)
    chars = np.array([len(t) for t in block.texts], np.int64) - held["continued"] - held["space"]
    lines, dups = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for i, t in enumerate(block.texts):
        worded = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines[i], dups[i] = len(worded), len(worded) - len(set(worded))
    repeats = repeated_words(block)
    text = np.repeat(np.arange(m), n)
    echo = np.bincount(text[1:][(block.codes[1:] == block.codes[:-1]) & (text[1:] == text[:-1])], minlength=m) if len(text) else np.zeros(m, np.int64)
    width = int(block.codes.max(initial=0)) + 1
    own, times = np.unique(text * width + block.codes, return_counts=True)
    top, distinct = np.zeros(m, np.int64), np.bincount(own // width, minlength=m)
    np.maximum.at(top, own // width, times)
    words, letters = np.maximum(n, 1), np.maximum(chars, 1)
    columns = {
        "log_words": np.log1p(n),
        "word_length": chars / words,
        "symbols_per_word": held["symbols"] / words,
        "dup_line_share": dups / np.maximum(lines, 1),
        "repeat_share": repeats / words,
        "echo_share": echo / words,
        "top_share": top / np.maximum(words, 20),  # short texts have a frequent word by chance
        "distinct_share": distinct / words,
        "upper_share": held["upper"] / letters,
        "digit_share": held["digits"] / letters,
        "mark_share": held["marks"] / letters,
        "wide_share": held["wide"] / letters,
        "words_per_line": n / np.maximum(lines, 1),
    }
    return Counts(n, chars, held["symbols"], dups, repeats, np.column_stack([columns[c] for c in STATISTICS]).astype(np.float64))


@dataclass
class TreeModel:
    """All trees as flat node arrays: a node sends rows with statistic <= threshold left, else right; a leaf points to itself."""

    start: float = 0.0
    roots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    statistic: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0

    def margins(self, x: np.ndarray) -> np.ndarray:
        if not len(self.roots):
            return np.full(len(x), self.start)
        at, rows = np.tile(self.roots, (len(x), 1)), np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.statistic[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def chances(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, monotone: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, leaf: int = LEAF, rate: float = 0.15, ridge: float = 1.0) -> TreeModel:
    """Gradient boosting of the logistic loss by second-order steps over binned statistics.

    A split on a constrained statistic counts only if the values of its sides lie in the asked order; their middle then bounds
    all leaves below either side, so the sum of trees is monotonic in the statistic.
    """
    share = float((weight * y).sum() / weight.sum())
    share = min(max(share, 1e-3), 1 - 1e-3)
    model = TreeModel(start=float(np.log(share / (1 - share))), depth=depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)])  # v <= cuts[b] where bin <= b
    nodes: list[list] = []  # statistic, threshold, left, right, value
    roots, margin = [], np.full(len(y), model.start)

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        total_g, total_h, found = g[rows].sum(), h[rows].sum(), (1e-6, None)
        worth = lambda v, a, b: -(a * v + 0.5 * (b + ridge) * v * v)
        none = worth(np.clip(-total_g / (total_h + ridge), low, high), total_g, total_h)
        for f in range(x.shape[1]):
            b, size = binned[rows, f], len(cuts[f]) + 1
            lg, lh, ln = (np.cumsum(np.bincount(b, weights=w, minlength=size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            lv, rv = np.clip(-lg / (lh + ridge), low, high), np.clip(-(total_g - lg) / (total_h - lh + ridge), low, high)
            gain = worth(lv, lg, lh) + worth(rv, total_g - lg, total_h - lh) - none
            gain[(ln < leaf) | (len(rows) - ln < leaf) | (monotone[f] * (rv - lv) < 0)] = -np.inf
            if len(gain) and gain.max() > found[0]:
                k = int(gain.argmax())
                found = float(gain[k]), (f, k, float(lv[k]), float(rv[k]))
        return found[1]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, deep: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))])
        split = best(rows, g, h, low, high) if deep else None
        if split is None:
            margin[rows] += nodes[at][4]
            return at
        f, k, lv, rv = split
        middle, sign = (lv + rv) / 2, monotone[f]
        goes = binned[rows, f] <= k
        under = grow(rows[goes], g, h, middle if sign < 0 else low, middle if sign > 0 else high, deep - 1)
        over = grow(rows[~goes], g, h, middle if sign > 0 else low, middle if sign < 0 else high, deep - 1)
        nodes[at][:4] = [f, float(cuts[f][k]), under, over]
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6), -np.inf, np.inf, depth))
    s, t, a, b, v = zip(*nodes, strict=True)
    model.roots, model.statistic, model.threshold, model.left, model.right, model.value = np.array(roots, np.int32), np.array(s, np.int32), np.array(t), np.array(a, np.int32), np.array(b, np.int32), np.array(v)
    return model


def fit_rules(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", per_class: int = PER_CLASS, text_col: str = "text", id_col: str = "doc_id") -> TreeModel:
    """Fit on at most per_class labelled documents of each label outside the held-out fold.

    Spark counts the statistics of the sample's whole texts; only they reach the driver, a few hundred bytes for each of at most
    twice per_class documents. Each label weighs as much as its share among the labels outside the held-out fold. Without both
    labels every text has the share of label 1 there, or 0.5, as its chance.
    """
    bounded_batches(docs.sparkSession)
    shares = {r[0]: r[1] for r in labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(label_col).count().collect()}
    prior = min(max(shares.get(1, 0) / sum(shares.values()), 1e-3), 1 - 1e-3) if shares else 0.5
    sample = labelled_sample(docs, labels, label_col, per_class=per_class, text_col=text_col, id_col=id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, [[row for block in word_blocks(batch.column("text")) for row in count(block).features.tolist()]]

    rows = sorted((r.label, r.statistics) for r in map_batches(sample, "statistics array<double>", run, ["label"]).collect())
    y = np.array([label for label, _ in rows], float)
    if not 0 < y.sum() < len(y):
        return TreeModel(start=float(np.log(prior / (1 - prior))))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return boost(np.array([x for _, x in rows]), y, weight, monotone=np.array(list(STATISTICS.values())))


def apply_rules(docs: DataFrame, model: TreeModel, *, text_col: str = "text", reject: float = REJECT, keep: list[str] | None = None) -> DataFrame:
    """Count and judge whole texts. Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept.

    Base rules fail texts of fewer than 50 words, and those where more than half of the words lie in three-word windows that the
    text holds twice or more. score is the trees' chance of quality; kept is false where the base rules fail or score < reject.
    Null, empty and blank texts have no words and fail; repeated rows are each judged; only the text goes into a score. `keep`
    names the input columns to return (all by default); an added column replaces an input column of its name. The broadcast
    model is bounded by its number of nodes. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [count(block) for block in word_blocks(batch.column(text_col))]
            whole = [np.concatenate([getattr(c, name) for c in found]) if found else np.zeros(0) for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
            score = np.concatenate([sent.value.chances(c.features) for c in found]) if found else np.zeros(0)
            failed = whole[5].astype(bool)
            yield batch, [*(c.astype(np.int64) for c in whole[:5]), failed, score, ~failed & (score >= reject)]

    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"
    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), added, run, keep)
