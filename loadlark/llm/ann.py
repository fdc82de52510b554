"""Approximate nearest neighbours: multiprobe p-stable hashing, candidates of all tables merged and reranked exactly."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Hash tables, hashes in a bucket's key, width of a hash's slots for unit vectors, buckets that a query visits in each table.
TABLES, HASHES, WIDTH, PROBES = 14, 4, 1.0, 30
#: Rows that one chunk builder holds, and scored pairs that a task holds before it keeps only the best.
CHUNK_ROWS, HELD_PAIRS = 20_000, 1 << 20
#: Queries with too few candidates that one pass compares with all rows, and queries that are scored against a chunk's rows at once.
BLOCK_QUERIES, SCORED_QUERIES = 2048, 512
CHUNK = "slot int, bucket long, ids binary, vectors binary"


class PStable:
    """Projections on Gaussian directions, cut into slots of equal width; the seed makes them the same in all tasks."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((dim, tables * hashes))
        self.offsets = rng.uniform(0, width, tables * hashes)
        self.tables, self.hashes, self.width = tables, hashes, width
        # every way to move each hash by one slot or none; a probe's order depends on the query
        self.moves = np.array(list(product((0, -1, 1), repeat=hashes)), np.int64)

    def slots(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (units @ self.directions + self.offsets) / self.width
        slot = np.floor(x)
        return slot.astype(np.int64).reshape(-1, self.tables, self.hashes), (x - slot).reshape(-1, self.tables, self.hashes)

    def key(self, slots: np.ndarray) -> np.ndarray:
        return ((slots + 4096) * (8192 ** np.arange(self.hashes))).sum(axis=-1)

    def probes(self, units: np.ndarray, n: int) -> np.ndarray:
        """Keys of n buckets for each vector and table, by estimated success: least squared distance to the borders crossed."""
        slot, inside = self.slots(units)
        down, up = self.moves == -1, self.moves == 1
        cost = inside**2 @ down.T + (1 - inside) ** 2 @ up.T
        chosen = np.argsort(cost, axis=-1, kind="stable")[..., :n]
        return self.key(slot[:, :, None, :] + self.moves[chosen])


def _vectors(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x, x / np.linalg.norm(x, axis=1, keepdims=True)


def _least_copies(ids: np.ndarray, x: np.ndarray, copies: int) -> np.ndarray:
    """Rows to keep: repeated rows once, and of equal vectors only the `copies` smallest ids can be among the nearest."""
    order = np.lexsort((ids, *x.T))
    new = np.ones(len(order), bool)
    new[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    once = new.copy()
    once[1:] |= ids[order[1:]] != ids[order[:-1]]
    order, new = order[once], new[once]
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < copies]


def _batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, ties to the smaller id; a candidate met several times counts once, with its best score."""
    order = np.lexsort((-s, v, q))
    q, v, s = q[order], v[order], s[order]
    again = np.zeros(len(q), bool)
    again[1:] = (q[1:] == q[:-1]) & (v[1:] == v[:-1])
    q, v, s = q[~again], v[~again], s[~again]
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0)) if len(q) else q
    near = np.arange(len(q)) - first < k
    return q[near], v[near], s[near]


def nearest(embeddings: DataFrame, *, every: int = 50, k: int = 5, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, probes: int = PROBES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest candidates of each query by cosine: query_id, rank (from 1), vec_id, score.

    Queries: rows whose id is divisible by `every`; candidates: all rows but the query's own. Every row is indexed in each
    table; each query visits `probes` buckets of each table in estimated success order, and all that lie there are scored with
    the original vectors in double precision. No bucket is capped: rows of one bucket are held in chunks, which a hot bucket
    has many of, and only identical vectors beyond the k + 1 smallest ids of a chunk, which can't be among the nearest, are
    left out. Repeated rows are dropped before the k best of a block are taken, so that they take no places.

    Vectors that are null, zero, hold null or non-finite components, or differ in length from the most common length take
    no part, nor do rows without id. Equal scores go to the smaller id; repeated rows are one candidate, and rows that share
    an id with other vectors too, by the best score of their vectors. A query with fewer
    candidates in its buckets than k is compared with all rows, in blocks of queries; an empty table gives no rows. Other
    columns are ignored.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    v = F.col("v")
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    dim = rows.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dim[0].d
    rows = rows.where(F.size(v) == dim)
    hashing = PStable(dim, tables, hashes, width)
    schema = pa.schema([("slot", pa.int32()), ("bucket", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary())])

    def chunks(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _batched(batches):
                ids = t.column("id").to_numpy()
                x, units = _vectors(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"))
                if not query:
                    kept = _least_copies(ids, x, k + 1)
                    ids, x, units = ids[kept], x[kept], units[kept]
                keys = hashing.probes(units, probes) if query else hashing.key(hashing.slots(units)[0])[:, :, None]
                for slot in range(tables):
                    flat = keys[:, slot].ravel()
                    owner = np.repeat(np.arange(len(ids)), keys.shape[2])
                    order = np.argsort(flat, kind="stable")
                    cut = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
                    groups = np.split(owner[order], cut[1:])
                    yield pa.RecordBatch.from_arrays([pa.array([slot] * len(groups), pa.int32()), pa.array(flat[order][cut]), pa.array([ids[g].tobytes() for g in groups], pa.binary()), pa.array([x[g].tobytes() for g in groups], pa.binary())], schema=schema)

        return run

    index = rows.mapInArrow(chunks(False), CHUNK)
    asked = rows.where(F.col("id") % every == 0).mapInArrow(chunks(True), CHUNK).select("slot", "bucket", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    pairs = index.join(asked.hint("shuffle_merge"), ["slot", "bucket"]).select("ids", "vectors", "q_ids", "q_vectors")
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def scored(blocks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n = 0
        for ids, x, q_ids, q in blocks:
            cosines = (q @ x.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(x, axis=1)
            cosines[q_ids[:, None] == ids] = -2
            by_id = np.argsort(ids, kind="stable")
            fresh = np.r_[True, np.diff(ids[by_id]) != 0]
            each = cosines if fresh.all() else np.maximum.reduceat(cosines[:, by_id], np.flatnonzero(fresh), axis=1)
            near = np.sort(each, axis=1)[:, -min(k, each.shape[1])][:, None] - 1e-9
            a, b = np.nonzero((cosines >= near) & (cosines > -2))
            # summed the same way whatever the block, so that equal vectors have equal scores
            exact = (q[a] * x[b]).sum(axis=1) / (np.sqrt((q[a] ** 2).sum(axis=1)) * np.sqrt((x[b] ** 2).sum(axis=1)))
            held.append((q_ids[a], ids[b], exact))
            n += len(a)
            if n >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)], schema=out)
                held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _best(*(np.concatenate(c) for c in zip(*held, strict=True)), k)], schema=out)

    def few_queries(ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Scores of one block take SCORED_QUERIES x CHUNK_ROWS doubles at most, 80 MB, however hot the bucket is."""
        for at in range(0, len(q_ids), SCORED_QUERIES):
            yield ids, x, q_ids[at : at + SCORED_QUERIES], q[at : at + SCORED_QUERIES]

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                for ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield from few_queries(np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, dim), np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dim))

        return scored(blocks())

    # each task returns at most k candidates of a query and flush; what is left to sort is small
    found = materialize(pairs.mapInArrow(in_buckets, "query_id long, vec_id long, score double"), "candidates")
    # queries whose buckets hold fewer than k candidates are compared with all rows, in blocks
    queries = rows.where(F.col("id") % every == 0).distinct()
    served = found.select("query_id", "vec_id").distinct().groupBy("query_id").count().where(F.col("count") >= k)
    lacking = materialize(queries.join(served, F.col("id") == F.col("query_id"), "left_anti"), "lacking")
    n_blocks = -(-lacking.count() // BLOCK_QUERIES)
    for block in range(n_blocks):
        asked = lacking.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).orderBy("id").collect()
        sent = spark.sparkContext.broadcast((np.array([r.id for r in asked], np.int64), np.array([r.v for r in asked], np.float64)))

        def all_rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def blocks():
                for batch in batches:
                    ids, x = batch.column("id").to_numpy(), _vectors(batch.column("v"))[0]
                    kept = _least_copies(ids, x, k + 1)
                    yield from few_queries(ids[kept], x[kept], *sent.value)

            return scored(blocks())

        if asked:
            found = found.unionByName(rows.mapInArrow(all_rows, "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.far")).alias("score"))
