"""Scores of the two classifiers, columns of the queries and edge cases against plain Python."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadlark.llm import queries as Q
from loadlark.llm.chat import format_chats
from loadlark.llm.common import materialize, table
from loadlark.llm.license import evaluate, scan_licenses, tagged_expressions
from loadlark.llm.quality import REPEATS, TERMS, VOTERS, fit_quality, score_quality, trigram_counts
from loadlark.llm.sampling import labelled_sample
from loadlark.llm.tokens import TextEncoder
from loadlark.llm.toxicity import _fit, fit_severity, grade_toxicity, word_counts


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def test_quality_is_brute_force_votes(spark, sf_dir, docs):
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    for r in score_quality(docs, model).collect()[:60]:
        counts = trigram_counts([(r.text or "").encode()])[0].astype(float)
        x = [math.log1p(c) * float(w) for c, w in zip(counts[:TERMS], model.idf, strict=True)]
        length = math.sqrt(sum(v * v for v in x)) or 1.0
        place = np.array([v / length for v in x] + [REPEATS * counts[TERMS]]) @ model.axes.astype(float)
        cosines = [float(place @ v) / (math.sqrt(float(place @ place)) or 1.0) for v in model.vectors.astype(float)]
        nearest = sorted(range(len(cosines)), key=lambda i: -cosines[i])[:VOTERS]
        votes = [(max(cosines[i], 0) ** 4 * model.weights[i], model.labels[i]) for i in nearest]
        total = sum(v for v, _ in votes)
        want = sum(v for v, label in votes if label == 1) / total if total > 0 else model.prior
        assert abs(r.score - want) < 1e-3 and r.predicted == (r.score >= 0.3)


def test_severity_is_the_expected_grade(spark, sf_dir, docs):
    model = fit_severity(docs, table(spark, sf_dir, "labels"))
    assert list(model.thresholds) == sorted(model.thresholds)
    for r in grade_toxicity(docs, model).collect():
        counts = word_counts((r.text or "").encode())
        score = math.fsum(model.weights[f] * (1 + math.log(n)) for f, n in counts.items() if f in model.weights)
        above = [1 / (1 + math.exp(min(500, max(-500, t - score)))) for t in model.thresholds]
        each = [a - b for a, b in zip([1.0, *above], [*above, 0.0], strict=True)]
        assert abs(r.severity - sum(k * p for k, p in enumerate(each))) < 1e-6 and abs(r.score - above[0]) < 1e-6
        assert abs(each[r.grade] - max(each)) < 1e-9


def test_ordinal_fit_is_at_the_likelihoods_peak():
    rng = np.random.default_rng(3)
    grades = np.array([0] * 30 + [1] * 10 + [2] * 10 + [3] * 10)
    cols = [np.arange(4) for _ in grades]
    vals = [rng.normal(size=4) + g * np.array([1, 0.5, 0, 0]) for g in grades]
    w, cuts = _fit(cols, vals, grades, 4, steps=6000, rate=0.01)

    def loss(w, cuts):
        total = 0.0
        for g, x in zip(grades, vals, strict=True):
            s = float(x @ w)
            upper = 1.0 if g == 3 else 1 / (1 + math.exp(s - cuts[g]))
            lower = 0.0 if g == 0 else 1 / (1 + math.exp(s - cuts[g - 1]))
            total -= math.log(upper - lower) * 0.5 / 30
        return total + 0.001 * float(w @ w)

    for i in range(4):
        step = np.eye(4)[i] * 1e-5
        assert abs(loss(w + step, cuts) - loss(w - step, cuts)) / 2e-5 < 1e-3
    for i in range(3):
        step = np.eye(3)[i] * 1e-5
        assert abs(loss(w, cuts + step) - loss(w, cuts - step)) / 2e-5 < 1e-3


def test_sample_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(i, f"other {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    both = [spark.createDataFrame(r, "doc_id long, text string").repartition(n) for r, n in ((rows, 1), (rows[::-1], 7))]
    one, two = (sorted(map(tuple, labelled_sample(d, labels, "quality", per_class=5).collect())) for d in both)
    assert one == two and one


def test_history_leaves_room_for_the_turn(spark):
    turn = lambda i, n: (1, i, "user" if i % 2 else "assistant", "x" * (4 * (n - 4)))
    rows = spark.createDataFrame([turn(i, n) for i, n in enumerate((454, 1754, 454, 1754, 3000, 20, 200, 1840))], "conv_id long, turn long, role string, text string")
    windows = format_chats(rows, budget=2048, history=512).orderBy("window").collect()
    assert sum(w.n_new for w in windows) == 8
    assert all(w.n_tokens <= 2048 or (w.n_new == 1 and w.n_repeated == 0) for w in windows)
    assert any(w.n_repeated for w in windows)


def test_identifiers_are_exact():
    assert evaluate(["CC-BY-ND-4.0"])[1] == {"cc-by-nd"} and evaluate(["MITRE"]) == (0.2, {"other"}) and evaluate(["MIT-0"]) == (1.0, {"mit"})
    assert evaluate(["BSD-3-Clause"])[1] == {"bsd"} and evaluate(["GPL-2.0-or-later"])[1] == {"gpl"} and evaluate(["CC-BY-3.0-AT"])[1] == {"cc-by"}
    long = "SPDX-License-Identifier: " + " AND ".join(["MIT"] * 200) + " AND GPL-3.0"
    assert evaluate(next(tagged_expressions(long))) == (0.3, {"mit", "gpl"})


def test_many_phrases_have_their_places(spark):
    text = " ".join(["cc by mit license"] * 500)
    row = scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_base, row.first_word, row.last_word, row.n_words) == (1000, 0, 1998, 2000)


def test_token_query_equals_the_library(spark, sf_dir, docs):
    tokenizer, at = TextEncoder(public_tokenizers.path("byte_bpe_50k.json")).tokenizer, 0
    got = {r.doc_id: r for r in Q.op2_token_files(spark, sf_dir).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_pack_query_covers_each_id_once(spark, sf_dir, docs):
    tokenizer = TextEncoder(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    want = {r.doc_id: np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in docs.collect()}
    pieces = Q.op9_pack(spark, sf_dir).collect()
    ends, windows = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = want[p.doc_id]
        assert p.start == ends[p.doc_id] and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        ends[p.doc_id] += p.length
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert ends == Counter({d: len(ids) for d, ids in want.items()})
    for spans in windows.values():
        spans.sort()
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 4096


def test_licence_and_nearest_queries_have_their_columns(spark, sf_dir):
    assert all(r.labels.split(",") == sorted(set(r.labels.split(","))) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in Q.op4_license_scan(spark, sf_dir).collect())
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(spark, sf_dir, "embeddings").collect() if r.embedding is not None}
    for r in Q.op6_nearest(spark, sf_dir).collect():
        a, b = vectors[r.query_id], vectors[r.vec_id]
        assert r.query_id % 50 == 0 and 1 <= r.rank <= 5 and abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12


def test_stages_keep_columns_with_clashing_names(spark, sf_dir, docs):
    extra = {"score": F.lit(0.7), "predicted": F.lit(9), "grade": F.lit("g"), "severity": F.lit("s"), "n_words": F.lit(-1), "items": F.lit("i"), "spans": F.lit("p"), "contaminated": F.lit("c"), "component_id": F.lit("k"), "text_hash": F.lit("h")}
    rows = materialize(docs.withColumns(extra), "clash")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns, name
        assert {tuple(r) for r in out.select(*extra).distinct().collect()} == {(0.7, 9, "g", "s", -1, "i", "p", "c", "k", "h")}, name


def test_encoder_takes_batches():
    encoder = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache=50)
    texts = ["", None, "a", "a b, c.", "\n\nx", "x  y", "Hello, wörld!\nnew line\n", "tab\there", "end ", " lead", "it's 12 o'clock", "日本"] * 3
    got = list(encoder.encode_all(pa.array(texts)))
    assert got == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert hashlib.md5(b"".join(got)).digest() == hashlib.md5(b"".join(encoder.encode_all(pa.array(texts, pa.large_string()).slice(0)))).digest()


def test_licence_phrases_and_names_have_their_own_freedom(spark):
    """A phrase reads as its own licence, not as another one of its label; names that are not listed don't read as the worst known."""
    texts = {"under the MIT License": 0.9, "SPDX-License-Identifier: MIT": 0.9, "SPDX-License-Identifier: MIT-0": 1.0, "spdx-license-identifier: AFL-3.0": 0.8, "SPDX-License-Identifier: MS-PL": 0.7, "SPDX-License-Identifier: NCSA": 0.9, "SPDX-License-Identifier: Sprocket-9": 0.2, "all rights reserved": 0.0, "spdx license identifier MIT": 0.0, "é SPDX-License-Identifier: CC-PDDC": 1.0}
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.score for r in scan_licenses(rows).collect()} == texts


def test_licence_query_equals_brute_force_in_its_base_columns(spark, sf_dir, docs):
    import re

    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r.doc_id: r for r in Q.op4_license_scan(spark, sf_dir).collect()}
    for d in docs.select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d.text or ""))
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r, at = rows[d.doc_id], [i for i, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places})))
