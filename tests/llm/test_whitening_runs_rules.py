"""Whitening, periodic runs and quality rules against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadlark.llm import queries as Q
from loadlark.llm.common import table
from loadlark.llm.rules import STATISTICS, apply_rules, boost, fit_rules
from loadlark.llm.runs import find_runs, word_runs
from loadlark.llm.whitening import fit_whitening, refined_eigh, whiten

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def brute_runs(words, min_length=6, min_exponent=4):
    """start, length, period of every maximal stretch, by looking at every period."""
    found, n = {}, len(words)
    for q in range(1, n // min_exponent + 1):
        j = 0
        while j < n - q:
            a = j
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - a >= q:
                found.setdefault((a, j - a + q), q)
            j += 1
    return sorted((a, length, q) for (a, length), q in found.items() if length >= max(min_length, min_exponent * q))


def runs_of(texts, **sizes):
    words = [w for t in texts for w in t]
    of, start, length, period = word_runs(np.array(words, np.int64), np.array([len(t) for t in texts], np.int64), **sizes)
    out = [[] for _ in texts]
    for t, a, n, p in zip(of, start, length, period, strict=True):
        out[t].append((int(a), int(n), int(p)))
    return out


@pytest.mark.parametrize("sizes", [{}, {"min_length": 2, "min_exponent": 2}, {"min_length": 5, "min_exponent": 3}])
def test_runs_are_those_of_every_period(sizes):
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k = rng.randint(1, 4)
            some = lambda most: [rng.randint(1, k) for _ in range(rng.randint(0, most))]  # noqa: B023, E731
            texts.append(some(6) + (some(5) * rng.randint(1, 12))[: rng.randint(0, 40)] + some(6))
        assert runs_of(texts, **sizes) == [brute_runs(t, sizes.get("min_length", 6), sizes.get("min_exponent", 4)) for t in texts]


def test_long_periodic_and_square_rich_texts_end_soon():
    assert runs_of([[1] * 300_000]) == [[(0, 300_000, 1)]]
    a, b = [1], [1, 2]
    while len(b) < 100_000:
        a, b = b, b + a
    assert runs_of([b]) == [[]]  # Fibonacci words hold no fourth power
    assert runs_of([b[:500]], min_length=2, min_exponent=2) == [brute_runs(b[:500], 2, 2)]


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = {r.doc_id: r for r in Q.op12_periodic_runs(spark, sf_dir).collect()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    longest = 0
    for d in docs:
        words = planted(d.doc_id, WORD.findall(d.text or ""))
        runs, r = brute_runs(words), rows[d.doc_id]
        dropped = {i for a, n, p in runs for i in range(a + p, a + n)}
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{a},{n},{p}\n" for a, n, p in sorted(runs, key=lambda x: (x[0], x[2]))))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in dropped))
        a, n, p = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert (r.start, r.length, r.period, r.exponent_milli) == (a, n, p, 1000 * n // p if runs else None)
        longest = max(longest, n or 0)
    assert longest > 50


def test_runs_of_odd_rows(spark):
    rows = [(None, "a a a a a a"), (1, None), (1, ""), (2, " \t\n"), (2, "é é é é é é b"), (2, "é é é é é é b"), (3, "x y  x y  x y  x y  z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"runs": F.lit("mine"), "n_words": F.lit("mine"), "period": F.lit(7)})
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.period) for r in find_runs(df).collect()), key=repr)
    assert got == sorted([(0, 6, [(0, 6, 1)], "a", 7), (1, 0, [], "", 7), (1, 0, [], "", 7), (2, 0, [], "", 7), (2, 7, [(0, 6, 1)], "é b", 7), (2, 7, [(0, 6, 1)], "é b", 7), (3, 9, [(0, 8, 2)], "x y  z", 7)], key=repr)
    assert find_runs(df.limit(0)).count() == 0


# Whitening


def exact_whitening(vectors):
    """n, sums, deviations and covariance over the distinct whole-number vectors, in fractions."""
    xs = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(xs))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
    return xs, n, sums, z.T @ z / n


def check_rows(rows, vectors, components):
    xs, n, sums, v = exact_whitening([v for _, v in vectors])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(vectors) * components
    for (vec_id, _), x in zip(vectors, xs, strict=True):
        z = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)])
        for c in range(components):
            r = by[vec_id, c + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
            assert abs(r.explained - values[c] / np.trace(v)) < 1e-10
            assert abs(abs(r.whitened) - abs(z @ axes[:, c] / np.sqrt(values[c]))) < 1e-7 and r.identity_error < 1e-9


def test_whitening_query_equals_brute_force(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in table(spark, sf_dir, "embeddings").collect()]
    check_rows(Q.op11_whitening(spark, sf_dir).collect(), vectors, 16)


def test_close_and_equal_eigenvalues_reach_double_precision():
    rng = np.random.default_rng(5)
    for values in ([9, 5, 5 * (1 + 1e-9), 5 * (1 - 1e-9), 5 * (1 + 3e-9), 1e-6, 0, 0], [4] * 8, [2.0**-k for k in range(8)], [1, 1 + 1e-6, 1 + 2e-6, 3, 3 + 1e-7, 8, 8, 9]):
        q = np.linalg.qr(rng.standard_normal((8, 8)))[0]
        v = (q * np.array(values, float)) @ q.T
        v = (v + v.T) / 2
        got, x = refined_eigh(v)
        want = np.sort(np.array(values, float))[::-1]
        assert np.abs(got - want).max() < 1e-14 * 9 and np.abs(x.T @ x - np.eye(8)).max() < 1e-15 * 8
        assert np.abs(v @ x - x * got).max() < 2e-15 * 9
    assert np.abs(np.linalg.eigh(v.astype(np.float32))[0] - np.sort(want)).max() > 1e-8  # what the start alone gives


def test_whitening_of_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    good = [(i % 7, rng.standard_normal(3).tolist()) for i in range(30)]
    odd = [(50, None), (51, [1.0, None, 2.0]), (52, [float("nan"), 0.0, 0.0]), (53, [float("inf"), 0.0, 0.0]), (54, []), (55, [1.0]), (None, [0.5, 0.25, 4.0])]
    rows = [*good, *good[:5], *odd]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"whitened": F.lit("mine"), "n": F.lit("mine")})
    model = fit_whitening(df, components=16)
    out = whiten(df, model).collect()
    assert len(out) == 36 and model.n == 31 and all(len(r.whitened) == 3 and r.n == "mine" for r in out)
    # constant dimensions have no direction; one vector alone has no variance; no vector no model
    flat = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    assert [r.whitened[1] for r in whiten(flat, fit_whitening(flat)).collect()] == [None] * 4
    one = fit_whitening(flat.limit(1))
    assert one.n == 1 and one.identity_error == 0 and whiten(flat.limit(1), one).first().deviation == 0
    none = fit_whitening(flat.limit(0))
    assert none.n == 0 and whiten(flat, none).count() == 0
    flat.limit(1).write.parquet(f"{tmp_path}/one/embeddings.parquet")
    flat.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert [(r.component, r.whitened, r.explained) for r in Q.op11_whitening(spark, f"{tmp_path}/one").collect()] == [(1, None, None), (2, None, None)]
    assert Q.op11_whitening(spark, f"{tmp_path}/none").count() == 0


def test_large_entries_keep_exact_deviations(spark):
    rows = [(0, [1e9, -3e12]), (1, [2.5, 7e14]), (2, [-1e15, 0.0]), (2, [-1e15, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = fit_whitening(df)
    xs, n, sums, _ = exact_whitening([v for _, v in rows])
    want = sorted(sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs)
    assert model.sums == sums and sorted(int(r.deviation) for r in whiten(df, model).collect()) == want


# Quality rules


def brute_counts(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] >= 2 for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_rules_query_equals_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_rules(docs, table(spark, sf_dir, "labels"))
    rows = {r.doc_id: r for r in Q.op13_quality_rules(spark, sf_dir).collect()}
    found = apply_rules(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        counts = brute_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert r.kept == (not r.base_failed and r.score >= 0.3)
        q = rows[r.doc_id]
        assert (q.kept, q.base_failed, q.score, q.n_repeat_words) == (r.kept, r.base_failed, r.score, r.n_repeat_words)


def test_rules_find_labelled_quality(spark, sf_dir):
    rows = Q.op13_quality_rules(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id").where("NOT base_failed").select("doc_id", "quality", "kept").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.kept for r in held if r.quality == 1)
    assert sum(not r.kept for r in held if r.quality == 0) >= 0.6 * sum(r.quality == 0 for r in held)


def test_trees_are_monotonic_and_walk_as_nodes_say():
    rng = np.random.default_rng(4)
    x = rng.random((600, 3))
    y = ((np.sin(9 * x[:, 0]) + x[:, 1] + 0.3 * rng.standard_normal(600)) > 0.7).astype(float)
    sign = np.array([0, 1, -1])
    model = boost(x, y, np.ones(600), monotone=sign, trees=30)
    for f in (1, 2):
        lines = np.repeat(rng.random((50, 3)), 101, axis=0)
        lines[:, f] = np.tile(np.linspace(0, 1, 101), 50)
        steps = np.diff(model.margins(lines).reshape(50, 101), axis=1)
        assert (steps * sign[f] >= -1e-12).all()
    free = np.diff(model.margins(np.column_stack([np.linspace(0, 1, 101), np.full((101, 2), 0.5)])))
    assert (free > 0).any() and (free < 0).any()
    for row in x[:40]:
        total = model.start
        for at in model.roots.tolist():
            while model.left[at] != at:
                at = int(model.left[at] if row[model.statistic[at]] <= model.threshold[at] else model.right[at])
            total += model.value[at]
        assert abs(total - model.margins(row[None])[0]) < 1e-9
    assert ((model.chances(x) >= 0.5) == y).mean() > 0.9


def test_rules_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, long), (1, None), (1, ""), (2, " \n\t\n "), (3, "a b c a b c " * 20), (3, "a b c a b c " * 20), (4, f"{long}\n{long}\nx"), (5, "#$ é\r\nq\nq \nq")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("mine"), "score": F.lit("mine"), "lang": F.lit("xx")})
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = fit_rules(df, labels)
    assert len(model.roots) == 0 and model.start == 0
    for r in apply_rules(df, model).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text) and r.score == 0.5 and r.lang == "xx"
        assert r.kept == (r.doc_id is None)
    assert apply_rules(df.limit(0), model).count() == 0
    assert len(STATISTICS) == 13
    # one label only: every text gets its share
    only = fit_rules(df, spark.createDataFrame([(4, 1), (3, 1)], "doc_id long, quality int"))
    assert len(only.roots) == 0 and only.start > 5
