"""Whitening of embeddings: distributed covariance, float32 eigenvectors and their refinement in higher precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches, materialize

#: Entries become whole numbers: floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no exact whole number of 64 bits.
LARGEST = 2.0**56
#: Most rounds of refinement in double, and how close eigenvalues, relative to the largest, form a cluster.
ROUNDS, CLOSE = 12, 1e-4


def cluster_of(values: np.ndarray) -> np.ndarray:
    """A number for each eigenvalue, the same along chains of close ones."""
    order = np.argsort(-values)
    falls = np.concatenate([[0], values[order][:-1] - values[order][1:] > CLOSE * np.abs(values).max()])
    out = np.empty(len(values), np.int64)
    out[order] = np.cumsum(falls)
    return out


def refine_step(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One step of Ogita and Aishima in v's precision: better eigenvectors of v from near ones, eigenvalues, size of the correction.

    Four matrix products. Between eigenvalues of one cluster, and between those that the step can't tell apart, it only restores
    orthogonality; turning the vectors of a cluster is left to solve_clusters.
    """
    r = np.eye(len(v), dtype=v.dtype) - x.T @ x
    s = x.T @ v @ x
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    blur = 2 * (np.sqrt((off * off).sum()) + np.abs(values).max() * np.sqrt((r * r).sum()))
    gap, group = values[None, :] - values[:, None], cluster_of(values)
    apart = (np.abs(gap) > blur) & (group[:, None] != group[None, :])
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, float(np.abs(e).max())


def solve_clusters(v: np.ndarray, x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Turn the eigenvectors of each cluster of close eigenvalues by an eigenproblem of the cluster's own size.

    The cluster's mean is taken off first, so that what tells its members apart fills the digits of the small problem.
    """
    group, x = cluster_of(values), x.copy()
    for g in np.flatnonzero(np.bincount(group) > 1):
        at = np.flatnonzero(group == g)
        block = x[:, at]
        small = block.T @ (v @ block - values[at].mean() * block)
        size = float(np.abs(small).max())
        if size > 0:
            turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1]
            x[:, at] = block @ turn.astype(v.dtype)
    return x


def refined_eigh(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    Starts from eigenvectors in float32. Steps in double until they no longer get better, then two in extended precision, where
    the platform has it; clusters of close eigenvalues are solved apart between two steps. The largest entry of a vector is positive.
    The work is some matrix products of v's size: a second for 256 dimensions, two minutes for 1,024.
    """
    scale = float(np.abs(v).max(initial=0))
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    x = np.linalg.eigh((v / scale).astype(np.float32))[1]
    for kind, rounds in ((np.float64, ROUNDS), (np.longdouble, 1)):
        a, x = v.astype(kind) / kind(scale), x.astype(kind)
        size = np.inf
        for _ in range(rounds):
            x, values, last = refine_step(a, x)
            x = solve_clusters(a, x, values)
            if last <= 16 * np.finfo(kind).eps or last > size / 2:
                break
            size = last
        x, _, _ = refine_step(a, x)  # turning a cluster leaves rounding errors of its own
    values = (x * (a @ x)).sum(axis=0) / (x * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x * x).sum(axis=0))[order]
    x = x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(v))] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


def exact_vectors(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with a vector without null or non-finite entries: their places, and their vectors as whole numbers, for each length."""
    lengths = np.array([len(x) if x.is_valid else 0 for x in batch])
    for size in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == size)
        entries = batch.take(pa.array(at)).flatten().cast(pa.float64())
        c = entries.to_numpy(zero_copy_only=False).reshape(len(at), size)  # null becomes NaN
        ok = (np.abs(c) <= LARGEST).all(axis=1)
        if ok.any():
            yield at[ok], np.floor(SCALE * c[ok]).astype(np.int64) + SHIFT


@dataclass
class Whitening:
    """What the fit list says: n distinct vectors, their sums, the leading eigenvalues and vectors, the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    @property
    def base(self) -> np.ndarray:
        """The whole part of the mean; what is left is under 1 for each dimension."""
        return np.array([s // max(self.n, 1) for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % max(self.n, 1) for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / max(self.n, 1)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Projections over the square root of their eigenvalue; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, self.centred(x) @ self.axes / np.sqrt(self.values), np.nan)

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - S)^2, exactly: with x = base + y it is n^2 y.y - 2 n y.rest + rest.rest."""
        y, n = x - self.base, self.n
        most = int(np.abs(y).max(initial=0))
        if most * max(most, n) * max(1, y.shape[1]) >= 2**62:
            y, rest = y.astype(object), self.rest.astype(object)
        else:
            rest = self.rest
        constant = sum(r * r for r in self.rest.tolist())
        return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip((y * y).sum(axis=1), (y * rest).sum(axis=1), strict=True)]


def _summed(parts: DataFrame, kind: type) -> dict[int, np.ndarray]:
    """Rows (i, block) of every partition added up for each i, batch by batch."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, i = None, None
        for batch in batches:
            i = batch.column("i")[0].as_py()
            for x in batch.column("block"):
                row = np.frombuffer(x.as_py(), kind)
                total = row if total is None else total + row
        if total is not None:
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    return {r.i: np.frombuffer(r.block, kind) for r in parts.groupBy("i").applyInArrow(add, "i int, block binary").collect()}


def _products(fit: DataFrame, take, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of products of take(x) over the fit list. Each partition adds up a matrix and sends it row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            z = take(np.array([np.frombuffer(x.as_py(), np.int64) for x in batch.column("x")]).reshape(batch.num_rows, -1))
            total += z.sum(axis=0)
            products += z.T @ z
        rows = [total, *products]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size + 1), pa.int32()), "block": pa.array([r.tobytes() for r in rows], pa.binary())})

    got = _summed(fit.mapInArrow(run, "i int, block binary"), np.float64)
    return got.get(0, np.zeros(size)), np.array([got.get(i + 1, np.zeros(size)) for i in range(size)])


def fit_whitening(vectors: DataFrame, *, components: int = 16, vector_col: str = "embedding") -> Whitening:
    """Fit on each distinct vector of whole numbers once.

    Equal vectors meet by their bytes after each partition has dropped its own repeats, and the list is written once. Sums are
    whole numbers; covariances are sums of products of centred vectors. Only matrices of the vectors' length reach the driver.
    Vectors of another length than most (the longest, on a tie) take no part. Without vectors all is empty.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in exact_vectors(batch.column("v")):
                yield pa.RecordBatch.from_pydict({"x": pa.array([r.tobytes() for r in x], pa.binary())})

    rows = vectors.select(F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL")
    fit = materialize(rows.mapInArrow(whole, "x binary").distinct(), "vectors")
    sizes = [(r.n, r.bytes) for r in fit.groupBy(F.octet_length("x").alias("bytes")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not sizes:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    n, size = max(sizes)
    dims = size // 8
    fit = fit.where(F.octet_length("x") == size)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * dims, np.int64)  # high and low halves apart: neither overflows
        for batch in batches:
            x = np.array([np.frombuffer(r.as_py(), np.int64) for r in batch.column("x")]).reshape(batch.num_rows, dims)
            total += np.concatenate([(x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])
        yield pa.RecordBatch.from_pydict({"i": pa.array([0], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    total = _summed(fit.mapInArrow(halves, "i int, block binary"), np.int64)[0].tolist()
    model = Whitening(n, [(h << 32) + low for h, low in zip(total[:dims], total[dims:], strict=True)], np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    total, products = _products(fit, model.centred, dims)
    covariance = products / n - np.outer(total / n, total / n)  # the centred sums are rounding only
    values, axes = refined_eigh((covariance + covariance.T) / 2)
    k = min(components, dims)
    model.trace = float(np.trace(covariance))
    # variance within rounding of none is none
    model.values, model.axes = np.where(values[:k] > dims * 1e-13 * max(model.trace, 0), values[:k], 0.0), np.ascontiguousarray(axes[:, :k])
    total, products = _products(fit, lambda x: np.nan_to_num(model.whiten(x)), k)
    found = np.flatnonzero(model.values > 0)
    error = np.abs(products / n - np.outer(total / n, total / n) - np.eye(k))[np.ix_(found, found)]
    model.identity_error = float(error.max(initial=0))
    return model


def whiten(vectors: DataFrame, model: Whitening, *, vector_col: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """Whiten every vector without null or non-finite entries; other rows are dropped.

    Added: whitened array<double> (one entry for each component; null where the component has no variance) and deviation
    decimal(38,0) (sum over dimensions of (n x - S)^2, exact; null beyond 38 digits). Rows of an empty table: none. Empty
    vectors, vectors of another length than the model's, and entries beyond 2^56 are dropped as non-finite ones are. Repeated
    rows and ids are each whitened. `keep` names the input columns to return (all by default); an added column replaces an
    input column of its name. The model's size is that of a matrix of the vectors' length. No shuffle.
    """
    bounded_batches(vectors.sparkSession)
    keep = vectors.columns if keep is None else keep
    kept = [c for c in keep if c not in ("whitened", "deviation")]
    schema = T.StructType([*(vectors.schema[c] for c in kept), T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])
    arrow = to_arrow_schema(schema)
    sent = vectors.sparkSession.sparkContext.broadcast(model)
    dims = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at, x in exact_vectors(batch.column("__v")):
                if x.shape[1] == dims:
                    rows = batch.take(pa.array(at))
                    white = pa.array([[None if v != v else v for v in r] for r in m.whiten(x).tolist()], arrow.field("whitened").type)
                    far = pa.array([v if v < 10**38 else None for v in m.deviations(x)], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c).cast(arrow.field(c).type) for c in kept), white, far], schema=arrow)

    own = vectors.select(*kept, F.col(vector_col).cast("array<double>").alias("__v"))
    return own.where("__v IS NOT NULL").mapInArrow(run, schema)
