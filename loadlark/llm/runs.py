"""Periodic runs of words by an enhanced suffix array, and texts without the repeats."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, map_batches
from .words import word_blocks

#: Most words that are compared or listed at once.
CHUNK = 1 << 20


def matches(s: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols are equal from each a and b on, forwards (step 1) or backwards (-1). Sentinels end each comparison."""
    n, left, width = np.zeros(len(a), np.int64), np.arange(len(a)), 4
    while len(left):
        still = []
        for at in range(0, len(left), max(1, CHUNK // width)):
            o = left[at : at + max(1, CHUNK // width)]
            x, y = ((p[o] + step * n[o])[:, None] + step * np.arange(width) for p in (a, b))
            equal = s[np.clip(x, 0, len(s) - 1)] == s[np.clip(y, 0, len(s) - 1)]
            whole = equal.all(axis=1)
            n[o] += np.where(whole, width, equal.argmin(axis=1))
            still.append(o[whole])
        left, width = np.concatenate(still), min(2 * width, 1 << 16)
    return n


def suffix_order(s: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, by text first: prefix doubling that only touches groups not yet told apart."""
    n = len(s)
    key = text * (int(s.max(initial=0)) + 1) + s
    order = np.argsort(key)
    slots, sorted_key = np.arange(n), key[order]
    rank = np.empty(n, np.int64)
    h = 0
    while len(slots):
        fresh = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
        first = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = first
        alone = fresh & np.concatenate([fresh[1:], [True]])
        slots, first = slots[~alone], first[~alone]
        h = 2 * h or 1
        # a group's suffixes share h symbols, so none of them has met its text's sentinel yet
        places = order[slots]
        sorted_key = first * n + rank[np.minimum(places + h, n - 1)]
        by = np.argsort(sorted_key)
        order[slots], sorted_key = places[by], sorted_key[by]
    return order, rank


def common_prefixes(s: np.ndarray, text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in order; 0 between texts.

    Only where the symbols before both differ are symbols compared, which takes n log n steps at most for all places; each
    other value is one less than that of the place before.
    """
    n = len(s)
    before = np.zeros(n, np.int64)
    before[order[1:]] = order[:-1]
    place = np.arange(n)
    same = text[before] == text
    same[order[0]] = False
    own = ~(same & (s[place - 1] == s[before - 1]))
    own[0] = True
    at = np.flatnonzero(own & same & (s == s[before]))
    lcp = np.zeros(n, np.int64)
    lcp[at] = matches(s, at, before[at], 1)
    last = np.maximum.accumulate(np.where(own, place, 0))
    return (lcp[last] - (place - last))[order]


def nearest_smaller(v: np.ndarray, at: np.ndarray, *, strict: bool) -> np.ndarray:
    """For each place in `at`, the last place before it with a smaller (or, if not strict, no larger) value, by pointer jumping.

    v[0] is smaller than all values at `at`; every place whose value is at least the smallest of those at `at` is itself in `at`.
    """
    beyond = np.greater_equal if strict else np.greater
    p = np.arange(len(v)) - 1
    left = at[beyond(v[p[at]], v[at])]
    while len(left):
        p[left] = p[p[left]]
        left = left[beyond(v[p[left]], v[left])]
    return p[at]


def word_runs(codes: np.ndarray, counts: np.ndarray, *, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, length and smallest period of each run of at least min_length words and min_exponent (2 or more) periods.

    At each boundary within an LCP interval of depth d, each suffix i of the smaller side asks by the inverse array whether i+d
    or i-d lies on the other side: then both begin with the same d words and differ after them, so a square of period d starts
    at the smaller one and ends where its run ends. Squares are rotated to the left while the words agree; of the squares with
    one end, shorter periods come first and multiples within their run are merged into it. Rows by text, start, period.
    """
    none = np.zeros(0, np.int64)
    if not len(codes):
        return none, none, none, none
    # a sentinel 0 before the first text and after each
    ends = np.cumsum(counts + 1)
    s = np.zeros(len(codes) + len(counts) + 1, np.int64)
    text = np.concatenate([[0], np.repeat(np.arange(1, len(counts) + 1), counts + 1)])
    inside = np.ones(len(s), bool)
    inside[0], inside[ends] = False, False
    s[inside] = codes
    order, rank = suffix_order(s, text)
    lcp = np.concatenate([common_prefixes(s, text, order), [-1]])
    lcp[0] = -1
    # boundaries of depth d, their interval from lo to hi, and within it what lies left and right of them
    k = np.flatnonzero(lcp >= 1)
    lo = nearest_smaller(lcp, k, strict=True)
    back, flipped = lcp[::-1], len(lcp) - 1 - k
    hi = len(lcp) - 1 - nearest_smaller(back, flipped[::-1], strict=True)[::-1]
    child = len(lcp) - 1 - nearest_smaller(back, flipped[::-1], strict=False)[::-1]
    d = lcp[k]
    # the words of a period stand at min_exponent places of a run at least, and fit into the text as often
    kept = (hi - lo >= min_exponent) & (np.maximum(min_exponent * d, min_length) <= counts[text[order[k]] - 1])
    k, lo, child, d = k[kept], lo[kept], child[kept], d[kept]
    right = child - k <= k - lo
    own_lo, size = np.where(right, k, lo), np.where(right, child - k, k - lo)
    other_lo, other_hi = np.where(right, lo, k), np.where(right, k, child)
    squares: list[tuple[np.ndarray, np.ndarray]] = []
    upto = np.concatenate([[0], np.cumsum(size)])
    cut = 0
    while cut < len(k):
        to = max(cut + 1, int(np.searchsorted(upto, upto[cut] + CHUNK, side="right")) - 1)
        node = np.repeat(np.arange(cut, to), size[cut:to])
        i = order[np.arange(upto[to] - upto[cut]) - (upto[node] - upto[cut]) + own_lo[node]]
        for j, left in ((i + d[node], i), (i - d[node], i - d[node])):
            r = rank[np.clip(j, 0, len(s) - 1)]
            ok = (j >= 0) & (r >= other_lo[node]) & (r < other_hi[node])
            squares.append((left[ok], d[node][ok]))
        cut = to
    at, d = (np.concatenate([x[c] for x in squares]) if squares else none for c in (0, 1))
    # the run must reach back so far from the square
    need = np.maximum(min_exponent * d, min_length) - 2 * d
    far = at - need
    ok = (need <= 0) | ((far >= 0) & (s[np.maximum(far, 0)] == s[np.maximum(far + d, 0)]) & (s[np.maximum(far, 0)] > 0))
    at, d = at[ok], d[ok]
    by = np.lexsort((d, at + 2 * d))
    at, d = at[by], d[by]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(at):
        end = at + 2 * d
        fresh = np.concatenate([[True], end[1:] != end[:-1]])
        group = np.cumsum(fresh) - 1
        q, e = d[fresh], end[fresh]
        start = at[fresh] - matches(s, at[fresh] - 1, at[fresh] + q - 1, -1)
        found.append((start, e - start, q))
        again = ~fresh & ~((d % q[group] == 0) & (at >= start[group]))
        at, d = at[again], d[again]
    if not found:
        return none, none, none, none
    start, length, period = (np.concatenate([x[c] for x in found]) for c in range(3))
    ok = length >= np.maximum(min_exponent * period, min_length)
    start, length, period = start[ok], length[ok], period[ok]
    # a stretch found with two periods has the smaller one
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    by = np.lexsort((period, start))
    start, length, period = start[by], length[by], period[by]
    of = text[start] - 1
    return of, start - np.concatenate([[1], ends[:-1] + 1])[of], length, period


def find_runs(docs: DataFrame, *, text_col: str = "text", min_length: int = 6, min_exponent: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Runs of words in whole texts. Added: n_words, runs (start, length, period; by start, then period) and collapsed.

    A run is a stretch with smallest period p, of at least min_length words and min_exponent times p, that no neighbouring word
    extends keeping p. `collapsed` holds the words that no run contains after its first period, joined by one space. Null,
    empty and blank texts have no words, no runs and an empty `collapsed`; repeated rows are each searched; a text of any length
    is searched as a whole, in about 150 bytes a word of its worker. `keep` names the input columns to return (all by default);
    an added column replaces an input column of its name. No shuffle: a lost executor's texts are searched again.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n_words, runs, collapsed = [], [], []
            for block in word_blocks(batch.column(text_col)):
                of, start, length, period = word_runs(block.codes, block.counts, min_length=min_length, min_exponent=min_exponent)
                ends = block.ends
                base = ends - block.counts
                own: list[list] = [[] for _ in block.texts]
                for t, a, n, p in zip(of.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
                    own[t].append({"start": a, "length": n, "period": p})
                inside = np.zeros(len(block.words) + 1, np.int64)
                np.add.at(inside, base[of] + start + period, 1)
                np.add.at(inside, base[of] + start + length, -1)
                kept = np.cumsum(inside[:-1]) == 0
                for t, (a, b) in enumerate(zip(base.tolist(), ends.tolist(), strict=True)):
                    words = block.words[a:b]
                    collapsed.append(b" ".join(compress(words, kept[a:b].tolist()) if own[t] else words))
                n_words += block.counts.tolist()
                runs += own
            yield batch, [n_words, runs, pa.array(collapsed, pa.binary()).cast(pa.string())]

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", run, keep)
