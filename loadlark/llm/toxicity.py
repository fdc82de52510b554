"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, spaced, texts
from .sampling import labelled_sample

#: Grades above 0; a toxic label is split into these by how many hostile terms its text holds.
GRADES = 3
#: Most documents of a label in the sample, most features, and the least documents that hold a feature.
PER_CLASS, FEATURES, SUPPORT = 3000, 4000, 8
#: Documents with at least this chance of a grade over 0 are rejected.
REJECT = 0.5


def word_counts(text: bytes) -> Counter[str]:
    """Counts of words (A-Z lowered), and of the first four and five characters of longer ones, marked by a dash."""
    words = Counter(spaced(text).decode("utf-8", "replace").split())
    stems: Counter[str] = Counter()
    for w, n in words.items():
        if len(w) > 4:
            stems[w[:4] + "-"] += n
            if len(w) > 5:
                stems[w[:5] + "-"] += n
    words.update(stems)
    return words


@dataclass
class SeverityModel:
    """One weight for each feature, shared by all thresholds: P(grade > k) = sigmoid(score - thresholds[k])."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: np.ndarray = field(default_factory=lambda: np.full(GRADES, 8.0) + np.arange(GRADES))

    def chances(self, text: bytes) -> np.ndarray:
        """P(grade > k) for each k."""
        counts = word_counts(text)
        score = sum(self.weights[f] * (1 + np.log(counts[f])) for f in sorted(self.weights.keys() & counts.keys()))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -500, 500)))


def _fit(rows: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_features: int, *, steps: int = 250, ridge: float = 0.002, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by full-batch gradient steps (Adam) on the penalised log likelihood."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    cols, vals = np.concatenate(rows).astype(np.int64), np.concatenate(values)
    n, k = len(rows), GRADES
    parameters = np.concatenate([np.zeros(n_features), [1.0], np.zeros(k - 1)])  # weights, first threshold, log gaps
    # both labels weigh the same, however rare one is
    toxic = grades > 0
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    m, v = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, steps + 1):
        w, first, gaps = parameters[:n_features], parameters[n_features], np.exp(parameters[n_features + 1 :])
        cuts = np.concatenate([[-np.inf], first + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
        score = np.bincount(at, weights=vals * w[cols], minlength=n)
        with np.errstate(over="ignore"):
            upper, lower = 1 / (1 + np.exp(score - cuts[grades + 1])), 1 / (1 + np.exp(score - cuts[grades]))
        chance = np.maximum(upper - lower, 1e-12)
        d_upper, d_lower = weight * upper * (1 - upper) / chance, weight * lower * (1 - lower) / chance
        d_cut = np.bincount(grades, weights=-d_upper, minlength=k + 1)[:k] + np.bincount(grades, weights=d_lower, minlength=k + 1)[1:]
        tail = np.cumsum(d_cut[::-1])[::-1]
        slope = np.concatenate([np.bincount(cols, weights=vals * (d_upper - d_lower)[at], minlength=n_features), [tail[0]], tail[1:] * gaps])
        slope[:n_features] += ridge * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        parameters = parameters - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return parameters[:n_features], parameters[n_features] + np.concatenate([[0], np.cumsum(np.exp(parameters[n_features + 1 :]))])


def fit_severity(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", per_class: int = PER_CLASS, features: int = FEATURES, support: int = SUPPORT, text_col: str = "text", id_col: str = "doc_id") -> SeverityModel:
    """Fit on a bounded sample of labelled documents outside the held-out fold.

    Labels are 0 or 1. Grade 0 is label 0; documents of label 1 are graded 1 to 3 by thirds of how many occurrences of hostile
    terms (features far more frequent under label 1) they hold. Features are counted over the sample by Spark; only the chosen
    ones and the sample's sparse rows over them reach the driver. Without both labels the model rejects nothing.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, labels, label_col, per_class=per_class, text_col=text_col, id_col=id_col)
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return SeverityModel()

    def held(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, [[list(word_counts(t)) for t in texts(batch.column("text"))]]

    terms = map_batches(sample, "terms array<string>", held, ["label"]).select("label", F.explode("terms").alias("term"))
    counts = terms.groupBy("term").agg(F.sum(F.col("label")).alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).where(F.col("toxic") + F.col("clean") >= support)
    odds = F.log((F.col("toxic") + 0.5) / (sizes[1] + 1)) - F.log((F.col("clean") + 0.5) / (sizes[0] + 1))
    counts = counts.withColumn("odds", odds).orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("toxic") + F.col("clean"))), "term").limit(features)
    chosen = counts.select("term", "odds", "toxic").collect()
    number = {r.term: i for i, r in enumerate(chosen)}
    hostile = {i for i, r in enumerate(chosen) if r.odds > 3}

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = []
            for t in texts(batch.column("text")):
                c = word_counts(t)
                found.append({number[f]: c[f] for f in number.keys() & c.keys()})
            order = [sorted(f) for f in found]
            yield batch, [order, [[f[i] for i in o] for f, o in zip(found, order, strict=True)]]

    known = map_batches(sample, "cols array<int>, counts array<int>", rows, ["label"]).collect()
    known.sort(key=lambda r: (r.label, r.cols, r.counts))
    occurrences = np.array([sum(n for i, n in zip(r.cols, r.counts, strict=True) if i in hostile) for r in known])
    label = np.array([r.label for r in known])
    cuts = np.quantile(occurrences[label == 1], [k / GRADES for k in range(1, GRADES)])
    grades = np.where(label == 1, 1 + np.searchsorted(cuts, occurrences, side="left"), 0)
    weights, thresholds = _fit([np.array(r.cols, np.int64) for r in known], [1 + np.log(np.array(r.counts, float)) for r in known], grades, len(number))
    return SeverityModel({f: float(weights[i]) for f, i in number.items()}, thresholds)


def grade_toxicity(docs: DataFrame, model: SeverityModel, *, text_col: str = "text", reject: float = REJECT, keep: list[str] | None = None) -> DataFrame:
    """Grade whole texts. Added: severity (the expected grade, 0 to 3), grade (the likeliest), score (chance of a grade over 0), predicted (1 where score >= reject, else 0).

    Null and empty texts have no features and get what the thresholds alone give, which is grade 0; repeated rows are each
    graded. `keep` names the input columns to return (all by default); an added column replaces an input column of its name.
    The model is bounded by its number of features. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            above = np.array([sent.value.chances(t) for t in texts(batch.column(text_col))]).reshape(-1, len(sent.value.thresholds))
            each = -np.diff(np.column_stack([np.ones(len(above)), above, np.zeros(len(above))]), axis=1)
            yield batch, [above.sum(axis=1), each.argmax(axis=1), above[:, 0], (above[:, 0] >= reject).astype(int)]

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), "severity double, grade int, score double, predicted int", run, keep)
