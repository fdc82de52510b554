"""Benchmark decontamination by Wu-Manber search for the word windows of benchmark items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, map_batches, spaced, texts

#: Text bytes of benchmark items in one broadcast block of patterns.
BLOCK_BYTES = 2 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)
ADDED = "n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:long,words:long>>, contaminated boolean"


class WuManber:
    """Shift tables over blocks of 8 bytes (fewer for shorter patterns), suffix-hash buckets and direct comparison.

    Many cursors, each in its own stretch of the text, advance together by their shifts, so that numpy does each step for all.
    """

    def __init__(self, patterns: list[bytes], stretch: int = 1024):
        self.patterns, self.stretch = patterns, stretch
        self.m = m = min(map(len, patterns))
        self.block = b = min(8, m)
        self.mask = np.uint64((1 << 8 * b) - 1)
        self.bits = min(22, max(12, (len(patterns) * (m - b + 1)).bit_length() + 3))
        heads = np.frombuffer(b"".join(p[:m] + bytes(8) for p in patterns), np.uint8).reshape(len(patterns), m + 8)
        self.shift = np.full(1 << self.bits, m - b + 1, np.int64)
        for end in range(b, m + 1):
            values = np.ascontiguousarray(heads[:, end - b : end - b + 8]).view("<u8")[:, 0] & self.mask
            np.minimum.at(self.shift, self.hash(values), m - end)
        self.head = np.ascontiguousarray(heads[:, :8]).view("<u8")[:, 0] & self.mask
        suffix = self.hash(np.ascontiguousarray(heads[:, m - b : m - b + 8]).view("<u8")[:, 0] & self.mask)
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]

    def hash(self, values: np.ndarray) -> np.ndarray:
        return ((values * SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, text: bytes) -> Iterator[tuple[int, int]]:
        """Position and pattern number of each occurrence."""
        last = len(text) - self.m
        if last < 0:
            return
        words = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), 0, (1,))
        at = np.arange(0, last + 1, self.stretch)
        end = np.minimum(at + self.stretch, last + 1)
        found = []
        while len(at):
            h = self.hash(words[at + (self.m - self.block)] & self.mask)
            step = self.shift[h]
            if len(hit := np.flatnonzero(step == 0)):
                found.append((at[hit], h[hit]))
                step[hit] = 1
            at = at + step
            live = at < end
            if not live.all():
                at, end = at[live], end[live]
        if not found:
            return
        at, h = (np.concatenate(x) for x in zip(*found, strict=True))
        first, after = np.searchsorted(self.suffix, h), np.searchsorted(self.suffix, h, side="right")
        many = after - first
        at, slot = np.repeat(at, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - first, many)
        which = self.order[slot]
        same = (words[at] & self.mask) == self.head[which]
        for i, p in zip(at[same].tolist(), which[same].tolist(), strict=True):
            if text.startswith(self.patterns[p], i):
                yield i, p


def windows(item: bytes, window: int) -> set[bytes]:
    """The item's runs of `window` words, or all of a shorter item, each between spaces."""
    words = item.split()
    return {b" %b " % b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()


class Matcher:
    """Wu-Manber tables for a block of items, one for each power of two of the patterns' length, so that long patterns keep long shifts."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        owners = defaultdict(set)
        for name, text in items:
            for w in windows(text, window):
                owners[w].add(name)
        lengths = defaultdict(list)
        for w in sorted(owners):
            lengths[len(w).bit_length()].append(w)
        self.parts = [(WuManber(p), [(w.count(b" ") - 1, owners[w]) for w in p]) for p in lengths.values()]

    def occurrences(self, text: bytes) -> Iterator[tuple[int, int, set[str]]]:
        """Position of the space before, words and items of each occurring window."""
        for tables, about in self.parts:
            for at, p in tables.search(text):
                yield at, *about[p]


@lru_cache(maxsize=4)
def _matcher(key: str, items: Broadcast, window: int) -> Matcher:
    return Matcher(items.value, window)


def _mark(batch: pa.RecordBatch, text_col: str, blocks: list[Broadcast], key: str, window: int) -> list:
    docs = [spaced(t) for t in texts(batch.column(text_col))]
    joined = b"".join(docs)
    starts = np.cumsum([0, *map(len, docs)])
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    base = np.searchsorted(spaces, starts)  # spaces before each document
    n_words = np.diff(base) - 1
    spans, items = defaultdict(set), defaultdict(set)
    for k, block in enumerate(blocks):
        hits = list(_matcher(f"{key}/{k}", block, window).occurrences(joined))
        if hits:
            at = np.searchsorted(spaces, [x[0] for x in hits])
            doc = np.searchsorted(base, at, side="right") - 1
            for (_, n, names), w, d in zip(hits, (at - base[doc]).tolist(), doc.tolist(), strict=True):
                spans[d].add((w, n))
                items[d] |= names
    merged = []
    for d in range(len(docs)):
        runs: list[list[int]] = []
        for w, n in sorted(spans.get(d, ())):
            if runs and w <= runs[-1][0] + runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], w + n - runs[-1][0])
            else:
                runs.append([w, n])
        merged.append([{"start": w, "words": n} for w, n in runs])
    n_hit = [sum(r["words"] for r in runs) for runs in merged]
    names = [sorted(items.get(d, ())) for d in range(len(docs))]
    return [n_words, n_hit, [len(x) for x in names], names, merged, [n > 0 for n in n_hit]]


def pattern_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[Broadcast]:
    """The items, broadcast in blocks of about block_bytes of text; each block is collected by itself."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast([(r.item, spaced(r.text.encode())) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).collect()]) for k in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the words of each document that lie in a window of benchmark items.

    Words: A-Z lowered, runs of ASCII letters, digits and non-ASCII characters. A window: `window` consecutive words of an item,
    or all words of a shorter one. Added: n_words, n_hit (words in windows), n_items and items (sorted as strings), spans
    (merged runs of hit words) and contaminated.

    A null or empty text has no words and is never contaminated; a null or empty item has no windows; an item without id is
    left out; items that share an id are one; repeated document rows are each marked; an empty benchmark marks nothing. `keep` names the input columns to return (all by
    default); an added column replaces an input column of its name. No shuffle: each batch is searched where it is read.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    blocks = pattern_blocks(benchmark, item_col, item_text_col, block_bytes)
    key = f"{docs.sparkSession.sparkContext.applicationId}/{[b._jbroadcast.id() for b in blocks]}"
    docs = docs.select(*dict.fromkeys([*keep, text_col]))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, _mark(batch, text_col, blocks, key, window)

    return map_batches(docs, ADDED, run, keep)
