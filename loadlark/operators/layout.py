"""Layout geometry: cells of lines, label-value pairs by position, template matches."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G
from .geometry import keys

PAGE_LINES, LINE_STEP, LINE_HEIGHT, CHAR_WIDTH = 8, 14, 10, 6


def cells(rows: DataFrame, id_col: str | list[str]) -> DataFrame:
    """Label and value cells of `label: value` lines with their boxes in whole units."""
    parts = rows.where(F.col("line").contains(": ")).withColumns({"label": F.substring_index("line", ": ", 1), "page": F.floor(F.col("line_no") / PAGE_LINES).cast("int"), "y0": (F.col("line_no") % PAGE_LINES) * LINE_STEP})
    label_end = F.length("label") * CHAR_WIDTH
    value = F.substring(F.col("line"), F.length("label") + 3, F.length("line"))
    box = lambda kind, text, x0: F.struct(F.lit(kind).alias("kind"), text.alias("text"), x0.cast("int").alias("x0"), (x0 + F.length(text) * CHAR_WIDTH).cast("int").alias("x1"))
    own = keys(id_col)
    return parts.select(*own, "page", "line_no", "y0", (F.col("y0") + LINE_HEIGHT).alias("y1"), F.explode(F.array(box("label", F.col("label"), F.lit(0)), box("value", value, label_end + 12))).alias("c")).select(*own, "page", "line_no", "y0", "y1", "c.*")


def label_values(rows: DataFrame, id_col: str | list[str]) -> DataFrame:
    """The best value of each label: to its right in the same row (gap up to 240), else below it (gap up to 80, overlapping in x).

    Cells meet by bands of their page, within their document's partition. Scores in percent: 92 beside, 84 below, less one for each
    40 units of gap. Documents that share an id are one: a label's line has one value, of equal ones the larger text.
    """
    items = rows.withColumn("item", F.col("line_no") * 2 + F.when(F.col("kind") == "value", 1).otherwise(0))
    pairs = G.met(items, id_col, F.col("kind") == "label", 0, 80, ("kind", "text"))
    a = F.col("a")
    score = lambda b: F.when(G.is_right(a, b), 92 - F.floor((b["x0"] - a["x1"]) / 40)).when(G.is_below(a, b), 84 - F.floor((b["y0"] - a["y1"]) / 40))
    scored = F.transform(F.filter("others", lambda b: b["kind"] == "value"), lambda b: F.struct(score(b).cast("int").alias("score"), (-b["item"]).alias("order"), a["text"].alias("label"), b["text"].alias("value")))
    best = pairs.select(*keys(id_col), F.col("a.item").alias("anchor"), F.array_max(F.filter(scored, lambda x: x["score"].isNotNull())).alias("b")).where("b IS NOT NULL")
    return best.groupBy(*keys(id_col), "anchor").agg(F.max("b").alias("b")).select(*keys(id_col), "b.label", "b.value", "b.score")


def lines_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The lines of an Arrow batch of lists of texts: each text's row, and each line's text, number there and content."""
    texts = pc.list_flatten(lists)
    split = pc.split_pattern(texts.fill_null(""), "\n")
    n = pc.list_value_length(split).to_numpy()
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
    return row, np.repeat(np.arange(len(texts)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), split.flatten()


def _pairs(of: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of an asked place and a place of its group; groups are consecutive."""
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(of)))
    n, first, at = np.repeat(sizes, sizes)[asked], np.repeat(starts, sizes)[asked], np.flatnonzero(asked)
    a = np.repeat(at, n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _parts(lines: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Which lines are `label: value`, and those lines' labels, values and their widths."""
    at = np.flatnonzero(pc.match_substring(lines, ": ").to_numpy(zero_copy_only=False))
    label, value = pc.extract_regex(lines.take(pa.array(at)), "(?s)^(?P<label>.*?): (?P<value>.*)$").flatten()
    return at, label, value, *(pc.utf8_length(p).to_numpy() * CHAR_WIDTH for p in (label, value))


def _neighbours(lists: pa.Array) -> pa.Array:
    """document_neighbours of one Arrow batch. Cells of equal boxes are one, which counts as often as it is there."""
    row, text, number, lines = lines_of(lists)
    at, _, _, w, v = _parts(lines)
    double = lambda x: np.repeat(x, 2)
    of, line, is_label = double(row[text[at]]), double(number[at]), np.arange(2 * len(at)) % 2 == 0
    x0 = np.where(is_label, 0, double(w) + 12)
    x1, times = np.where(is_label, double(w), x0 + double(v)), np.ones(len(of), int)
    if len(row) and (row[1:] == row[:-1]).any():
        order = np.lexsort([x1, x0, ~is_label, line, of])
        own = [k[order] for k in (of, line, is_label, x0, x1)]
        first = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in own])))[: len(order)]
        times = np.diff(np.append(first, len(order)))
        of, line, is_label, x0, x1 = (k[first] for k in own)
    a, b = _pairs(of * (line.max(initial=0) // PAGE_LINES + 1) + line // PAGE_LINES, is_label)
    other = (line[a] != line[b]) | ~is_label[b]
    a, b = a[other], b[other]

    up = (line[b] - line[a]) * LINE_STEP
    beside = LINE_HEIGHT - np.abs(up)
    beside = (beside > 0) & (beside * 100 >= LINE_HEIGHT * 35)
    gap, under = x0[b] - x1[a], up - LINE_HEIGHT
    holds = {
        "same_row": beside, "right": beside & (gap >= 0) & (gap <= 240), "below": (under >= 0) & (under <= 80) & (np.minimum(x1[a], x1[b]) > np.maximum(x0[a], x0[b])), "near": np.abs(up) <= 30,
        "within": (x0[b] >= x0[a] - 1) & (x1[b] <= x1[a] + 200) & (up >= -15) & (up <= 15),
    }
    labels = np.flatnonzero(is_label)
    fresh = np.append(True, (of[labels][1:] != of[labels][:-1]) | (line[labels][1:] != line[labels][:-1]))[: len(labels)]
    group, weight = np.zeros(len(of), int), times[a] * times[b]
    group[labels] = np.cumsum(fresh) - 1
    firsts = labels[fresh]
    counts = [pa.array(np.bincount(group[a][h], weights=weight[h], minlength=len(firsts)).astype(np.int64)) for h in holds.values()]
    found = pa.StructArray.from_arrays([pa.array(line[firsts], pa.int64()), *counts], ["line_no", *(f"n_{k}" for k in holds)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of[firsts], minlength=len(lists)))), pa.int32()), found)


def document_neighbours(texts: Column) -> Column:
    """For each line with a label, how many cells of a row's texts are in the label's row, to its right, below, near in y and within the box around it.

    Cells are those of `cells`, and the relations those of geometry (is_beside, is_right, is_below, is_near, is_within); pages of an Arrow
    batch are read at once. Texts of one row stand on the same pages, and their counts are added up by line.
    """
    return F.arrow_udf(_neighbours, "array<struct<line_no:bigint,n_same_row:bigint,n_right:bigint,n_below:bigint,n_near:bigint,n_within:bigint>>")(texts)


def _values(lists: pa.Array, wanted: list[str]) -> pa.Array:
    """document_values of one Arrow batch."""
    row, text, number, lines = lines_of(lists)
    at, labels, values, w, v = _parts(lines)
    text, number = text[at], number[at]
    y0, x0 = number % PAGE_LINES * LINE_STEP, w + 12
    asked = pc.is_in(labels, pa.array(wanted)).to_numpy(zero_copy_only=False)
    a, b = _pairs(text * (number.max(initial=0) // PAGE_LINES + 1) + number // PAGE_LINES, asked)

    overlap, gap, under = np.minimum(y0[a], y0[b]) + LINE_HEIGHT - np.maximum(y0[a], y0[b]), x0[b] - w[a], y0[b] - y0[a] - LINE_HEIGHT
    right = (overlap > 0) & (overlap * 100 >= LINE_HEIGHT * 35) & (gap >= 0) & (gap <= 240)
    below = (under >= 0) & (under <= 80) & (np.minimum(x0[b] + v[b], w[a]) > np.maximum(x0[b], 0))
    score = np.where(right, 92 - gap // 40, np.where(below, 84 - under // 40, -1))
    a, b, score = a[score >= 0], b[score >= 0], score[score >= 0]
    order = np.lexsort([number[b], -score, a])
    order = order[np.append(True, a[order][1:] != a[order][:-1])] if len(order) else order
    a, b, score = a[order], b[order], score[order]
    found = pa.StructArray.from_arrays([labels.take(pa.array(a)), values.take(pa.array(b)), pa.array(score, pa.int32())], ["label", "value", "score"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(row[text[a]], minlength=len(lists)))), pa.int32()), found)


def document_values(texts: Column, wanted: list[str]) -> Column:
    """label_values of some labels in each of a row's texts, as an array of label, value and score; pages of an Arrow batch are read at once."""
    return F.arrow_udf(lambda lists: _values(lists, wanted), "array<struct<label:string,value:string,score:int>>")(texts)


def match_templates(docs: DataFrame, id_col: str, templates: dict[str, list[str]]) -> DataFrame:
    """The template with the largest share of its terms in a document's text, then most terms, then the larger name.

    One projection without a shuffle: a text is searched once for each term, and the best of the few templates is the largest of an
    array. No template is named under half of its terms; a null text holds none.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    counted = [(name, len(terms), reduce(add, (F.contains(low, F.lit(t)).cast("int") for t in terms))) for name, terms in templates.items()]
    scored = F.array(*(F.struct(F.floor(hits * 100 / n).cast("int").alias("share"), hits.alias("hits"), F.lit(name).alias("template")) for name, n, hits in counted))
    best = docs.select(id_col, F.array_max(scored).alias("b"))
    return best.select(id_col, F.when(F.col("b.share") >= 50, F.col("b.template")).alias("template"), F.col("b.share").alias("share"))
