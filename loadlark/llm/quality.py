"""Text quality by votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, texts
from .sampling import held_out, labelled_sample

#: Hashed byte trigrams, latent dimensions, most sample documents of a label, voters, and bytes and documents of one block.
TERMS, RANK, PER_CLASS, VOTERS, BLOCK_BYTES, BLOCK_DOCS = 4096, 64, 2000, 15, 2 << 20, 256
#: Weight of the share of words that repeat the word before, next to a unit vector of trigrams.
REPEATS = 3.0
SPREAD = np.array([2654435761, 2246822519, 3266489917], np.uint32)


def trigram_counts(block: list[bytes]) -> np.ndarray:
    """Counts of hashed byte trigrams, one row per text; last the share of words that repeat the word before."""
    joined, lengths = np.frombuffer(b"".join(block), np.uint8), np.array([len(t) for t in block])
    counts = np.zeros((len(block), TERMS + 1), np.float32)
    if len(joined) > 2:
        b = joined.astype(np.uint32)
        code = (b[:-2] * SPREAD[0] + b[1:-1] * SPREAD[1] + b[2:] * SPREAD[2]) >> np.uint32(20)
        doc = np.repeat(np.arange(len(block)), lengths)
        inside = doc[2:] == doc[:-2]
        counts[:, :TERMS] = np.bincount((doc[:-2] * TERMS + code)[inside], minlength=len(block) * TERMS).reshape(len(block), TERMS)
    for i, t in enumerate(block):
        words = t.split()
        counts[i, TERMS] = sum(map(eq, words, islice(words, 1, None))) / max(12, len(words) - 1)  # a few words may repeat by chance
    return counts


def blocks(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts(column):
        held.append(t)
        size += len(t)
        if size >= BLOCK_BYTES or len(held) >= BLOCK_DOCS:
            yield held
            held, size = [], 0
    if held:
        yield held


@dataclass
class NeighbourModel:
    """Labelled unit vectors in the latent space, and what takes a text there."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts[:, :TERMS]) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return np.column_stack([x, REPEATS * counts[:, TERMS]]).astype(np.float32)

    def place(self, counts: np.ndarray) -> np.ndarray:
        v = self.weigh(counts) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of the votes for label 1. All cosines are computed; each voter's vote is weighted by its similarity."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self.place(counts) @ self.vectors.T
        k = min(VOTERS, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 4 * self.weights[near]
        total = votes.sum(axis=1)
        return np.where(total > 0, np.clip((votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), 0, 1), self.prior)


def fit_quality(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", per_class: int = PER_CLASS, rank: int = RANK, text_col: str = "text", id_col: str = "doc_id") -> NeighbourModel:
    """Place a bounded sample of labelled documents outside the held-out fold in a latent-semantic space.

    Trigram counts are taken by Spark; at most twice per_class rows of fixed length reach the driver, where a singular value
    decomposition gives the axes. Each label's votes are weighted to its share among the labels outside the held-out fold. With no
    labelled document every text gets the share of label 1 there, or 0.5.
    """
    bounded_batches(docs.sparkSession)
    shares = {r[0]: r[1] for r in labels.where(F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col))).groupBy(label_col).count().collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 0.5
    sample = labelled_sample(docs, labels, label_col, per_class=per_class, text_col=text_col, id_col=id_col)

    def count(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, [[np.minimum(row, 60_000).astype(np.float16).tobytes() for block in blocks(batch.column("text")) for row in trigram_counts(block)]]

    rows = map_batches(sample, "counts binary", count, ["label"]).collect()
    rows.sort(key=lambda r: (r.label, r.counts))
    label = np.array([r.label for r in rows], np.int64)
    if not len(rows):
        return NeighbourModel(np.ones(TERMS), np.zeros((TERMS + 1, rank), np.float32), np.zeros((0, rank), np.float32), label, np.zeros(0), prior)
    # weighted block by block into one array, so that the driver holds the sample once in each width
    counts = np.frombuffer(b"".join(r.counts for r in rows), np.float16).reshape(len(rows), TERMS + 1)
    del rows
    idf = np.log((1 + len(label)) / (1 + np.count_nonzero(counts[:, :TERMS], axis=0))).astype(np.float32) + 0.1
    model = NeighbourModel(idf, np.zeros((TERMS + 1, rank), np.float32), np.zeros((0, rank), np.float32), label, np.ones(len(label)), prior)
    x = np.empty(counts.shape, np.float32)
    for at in range(0, len(x), BLOCK_DOCS):
        x[at : at + BLOCK_DOCS] = model.weigh(counts[at : at + BLOCK_DOCS].astype(np.float32))
    del counts
    # randomised range finder with power steps; the seed makes the axes the same in every run
    basis = np.random.default_rng(7).standard_normal((len(x), rank + 10)).astype(np.float32)
    for _ in range(4):
        basis = x @ (x.T @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    model.axes = np.ascontiguousarray(np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T)
    model.vectors = x @ model.axes
    model.vectors /= np.maximum(np.linalg.norm(model.vectors, axis=1, keepdims=True), 1e-9)
    share = np.bincount(label, minlength=2) / len(label)
    model.weights = np.where(label == 1, prior / max(share[1], 1e-9), (1 - prior) / max(share[0], 1e-9))
    return model


def score_quality(docs: DataFrame, model: NeighbourModel, *, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None) -> DataFrame:
    """Score whole texts. Added: score (0 to 1, higher: label 1 likelier) and predicted (1 where score >= threshold, else 0).

    Only the text goes into a score. Null, empty and shorter than three-byte texts have no trigrams and get the share of label
    1 among the labels outside the held-out fold; repeated rows are each scored. `keep` names the input columns to return (all by default); an added
    column replaces an input column of its name. The broadcast model is bounded by its sample. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            scores = [sent.value.scores(trigram_counts(block)) for block in blocks(batch.column(text_col))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield batch, [score, (score >= threshold).astype(int)]

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), "score double, predicted int", run, keep)
