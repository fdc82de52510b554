"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loadlark.llm import queries as Q
from loadlark.llm.ann import nearest
from loadlark.llm.chat import format_chats, parse_chats
from loadlark.llm.common import scratch_path, table
from loadlark.llm.decontam import WuManber, decontaminate
from loadlark.llm.graph import components
from loadlark.llm.jaccard import near_duplicates
from loadlark.llm.license import evaluate, parse_expression, scan_licenses
from loadlark.llm.packing import OpenWindows, best_fit_decreasing, pack
from loadlark.llm.quality import fit_quality, score_quality
from loadlark.llm.tokenbin import read_tokens, write_tokens
from loadlark.llm.tokens import TextEncoder
from loadlark.llm.toxicity import fit_severity, grade_toxicity
from loadlark.llm.urlfilter import judge_urls
from tests.conftest import same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BYTES, WORDS = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
#: Nulls, empty and white-space texts, repeated rows, a very long text, odd characters; a clashing extra column.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "MIT License and cc BY é"), (5, "MIT License and cc BY é"), (6, "word " * 60_000), (None, "no id here at all"), (7, "x" * 200_000), (8, "a\u0000b\u0085c 　 d")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "q", 0.5, 9) for i, t in ODD], "doc_id long, text string, label string, score double, n_words int")


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    same_rows(Q.QUERIES[name](spark, sf_dir), duck.sql(Q.ORACLES[name]))


def test_wu_manber_finds_all():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5, 9, 40):
        text = bytes(rng.choice(list(b"ab "), 3000).tolist())
        patterns = sorted({text[i : i + size + int(rng.integers(0, 4))] for i in rng.integers(0, 2900, 20)})
        want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(text)) if text.startswith(p, i))
        assert sorted(WuManber(patterns, stretch=64).search(text)) == want


def test_decontaminate_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "mit license"), (1, "CC by"), (None, "a"), (2, None), (3, ""), (10, "word " * 12)], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r for r in decontaminate(odd, items, block_bytes=20).collect()}
    assert got[5, 6].n_hit == 4 and got[5, 6]["items"] == ["1"]
    assert got[6, 60_000].n_hit == 60_000 and not got[1, 0].contaminated and got[4, 1].n_hit == 0
    assert decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate(odd.limit(0), items).count() == 0


def test_encoder_is_exact():
    texts = [t or "" for _, t in ODD[:-2]] + ["a  b", " a ", "it's <|endoftext|> x", "ﬁ ΣΑΣ İ", "a\r\nb\n\n c", "123a b6 !!? 'll", "日本 語 😀"]
    for path in (BYTES, WORDS):
        encoder = TextEncoder(path, cache=4)
        for t in texts * 2:
            assert encoder.encode(t) == np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_token_files_round_trip(spark, odd):
    manifest = write_tokens(odd, scratch_path(spark, "t"), BYTES, end_id=0)
    encoder = TextEncoder(BYTES)
    rows = read_tokens(manifest).orderBy("start").collect()
    want = [(i, encoder.encode(t or "") + bytes(4)) for i, t in sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    assert [(r.doc_id, bytes(r.ids)) for r in rows] == want
    assert [r.start for r in rows] == np.cumsum([0, *(len(x) // 4 for _, x in want[:-1])]).tolist()
    some = read_tokens(manifest, wanted=[5, 7]).collect()
    assert sorted(r.doc_id for r in some) == [5, 5, 7]
    assert read_tokens(write_tokens(odd.limit(0), scratch_path(spark, "t"), BYTES, end_id=0)).count() == 0
    path = manifest.orderBy("shard").first().path.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[2] ^= 255
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="damaged|decompress"):
        read_tokens(manifest).collect()


def turns_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    return {k: [x[2:] for x in sorted(v)] for k, v in by.items()}


@pytest.mark.parametrize("budget,history", [(40, 0), (200, 60), (2048, 512)])
def test_chat_round_trip(spark, sf_dir, budget, history):
    tricky = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (-8, 0, "system", "s ###\\3 #### \\\\t"), (-8, 1, None, None), (-8, 2, "assistant", ""), (-8, None, "as: si", "x\ny: </turn>\n"), (-8, 2, "assistant", ""), (None, 1, "assistant", "é😀")]
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.createDataFrame(tricky, "conv_id long, turn long, role string, text string"))
    windows = format_chats(turns, budget=budget, history=history)
    shown = windows.collect()
    read = {(r.conv_id, r.window): r for r in parse_chats(windows).collect()}
    by = defaultdict(list)
    for w in sorted(shown, key=lambda w: w.window):
        by[w.conv_id].append(w)
        assert w.n_tokens <= budget or (w.n_new == 1 and w.n_repeated == 0)
        assert w.formatted.count("### ") == w.n_system + w.n_repeated + w.n_new
    for conv, turns in turns_of(turns.collect()).items():
        parts = [read[conv, w.window] for w in by[conv]]
        assert [(t.role, t.text) for p in parts for t in p.turns] == turns
        assert [t for p in parts for t in p.targets] == [t for role, t in turns if role == "assistant"]
        if turns[0][0] == "system" and len(by[conv]) > 1:
            assert all(w.n_system == 1 for w in by[conv][1:])
    assert format_chats(windows.limit(0).select(F.col("conv_id"), F.lit(1).alias("turn"), F.lit("a").alias("role"), F.lit("b").alias("text"))).count() == 0


def test_chat_query_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").collect()
    got = {r.conv_id: r for r in Q.op3_chat_format(spark, sf_dir).collect()}
    assert -7 in got
    for conv, turns in turns_of(rows).items():
        target = "".join(t for role, t in turns if role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(target), hashlib.sha256(target.encode()).hexdigest())


def test_licence_expressions():
    assert parse_expression("MIT or GPL-3.0 and Apache-2.0") == ["MIT", "GPL-3.0", "Apache-2.0", "and", "or"]
    assert parse_expression("(MIT OR GPL-2.0-only) AND ISC */") == ["MIT", "GPL-2.0-only", "or", "ISC", "and"]
    assert parse_expression("GPL-2.0 with Classpath-exception-2.0 or") == ["GPL-2.0", "Classpath-exception-2.0", "with"]
    assert parse_expression(") MIT") is None and parse_expression("") is None
    assert evaluate(["MIT", "GPL-3.0", "or"]) == (0.9, {"mit", "gpl"}) and evaluate(["MIT", "GPL-3.0", "and"])[0] == 0.3


def test_licences_equal_brute_force(spark, sf_dir, odd):
    base = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    extra = spark.createDataFrame([(900, "SPDX-License-Identifier: MIT OR Apache-2.0\nThe GNU general, public LICENSE; cc-by cc by"), (901, "Licensed under the Apache License")], "doc_id long, text string")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").union(extra).union(odd.select("doc_id", "text"))
    for r in scan_licenses(docs).collect():
        words = WORD.findall((r.text or "").translate(LOWER))
        joined = " " + " ".join(words) + " "
        at = sorted(joined.count(" ", 0, m.start()) for p in base for m in re.finditer(f"(?= {p} )", joined))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(at), at[0] if at else None, at[-1] if at else None)
        assert r.base_labels == sorted({v for p, v in base.items() if f" {p} " in joined}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
        if r.doc_id == 900:
            assert r.expressions == ["MIT Apache-2.0 or"] and r.labels == ["apache", "cc-by", "gpl", "mit"]


def test_urls_with_other_rules(spark):
    rules = spark.createDataFrame([("example.com", "/a", "block"), ("example.com", "/ab", "allow"), ("", "/never", "block"), ("b.example.com", "", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://Example.COM/abc?x", "https://x.example.com/a#f", "http://b.example.com", "http://myexample.com/a", "nothing", None, "http://q.org/never/x", "http://h?/a", "", "http://example.com/a"]
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(spark.createDataFrame([(u, "clash") for u in urls], "url string, rule string"), rules).collect()}
    assert got["http://Example.COM/abc?x"] == ("example.com", "/abc", "example.com/ab", "allow")
    assert got["https://x.example.com/a#f"][2:] == ("example.com/a", "block") and got["http://b.example.com"][2:] == ("b.example.com", "allow")
    assert got["http://myexample.com/a"][2:] == (None, "allow") and got["http://q.org/never/x"][3] == "block"
    assert got[None] == ("", "", None, "allow") and got["nothing"][:2] == ("", "") and got["http://h?/a"][:2] == ("h", "")
    assert judge_urls(spark.createDataFrame([("http://a.net/x",)], "url string"), rules.limit(0)).first().verdict == "allow"


def exact_nearest(rows, every, k):
    out = {}
    for q, x in rows.items():
        if q % every == 0:
            near = sorted((-float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), i) for i, y in rows.items() if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def test_nearest_recall_and_odd_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    want = exact_nearest({r.vec_id: np.array(r.embedding, float) for r in e.collect()}, 50, 5)
    got = defaultdict(list)
    for r in nearest(e).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sum(len(set(want[q]) & set(got[q])) for q in want) >= 0.9 * sum(map(len, want.values()))
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [-1.0, 0.0]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in nearest(odd, every=50).orderBy("rank").collect()] == [(1, 6), (2, 7), (3, 5)]
    assert nearest(odd.limit(0)).count() == 0


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.01"


def test_quality_held_out(spark, larger, odd):
    labels = table(spark, larger, "labels")
    rows = Q.op7_quality(spark, larger).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert sum(r.predicted == 1 for r in rows if r.quality == 1) >= 0.97 * sum(r.quality == 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    model = fit_quality(table(spark, larger, "documents"), labels.limit(0))
    assert [r.score for r in score_quality(odd, model).collect()] == [0.5] * len(ODD)


def test_toxicity_held_out(spark, odd):
    larger = "/root/testdata/sf0.1"  # smaller tables hold too few toxic documents to learn from
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    rows = Q.op10_toxicity(spark, larger).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == 1 for r in rows if r.toxic) >= 0.9 * sum(r.toxic for r in rows)
    assert sum(r.predicted == 0 for r in rows if not r.toxic) >= 0.98 * sum(not r.toxic for r in rows)
    model = fit_severity(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    graded = grade_toxicity(odd, model).collect()
    assert len(graded) == len(ODD) and all(0 <= r.severity <= 3 and r.grade == 0 for r in graded if not r.text)
    assert grade_toxicity(odd, fit_severity(docs, labels.limit(0))).where("predicted = 1").count() == 0


def classes(docs, words, percent):
    """Brute force: every pair of sets."""
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        k = min(words, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80), (1, 50)])
def test_near_duplicates_equal_brute_force(spark, words, percent, monkeypatch):
    import loadlark.llm.jaccard as J

    monkeypatch.setattr(J, "BLOCK_SHINGLES", 300)  # several blocks for one leader
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    docs = [(100 + i, None if i == 0 else "" if i == 1 else " ".join(f"v{j}" for j in rng.integers(0, 90, int(rng.integers(1, 9))))) for i in range(30)]
    for i in range(60):
        w = list(base)
        for at in rng.integers(0, 60, int(rng.integers(0, 4))):
            w[at] = f"n{rng.integers(0, 50)}"
        docs.append((i, " ".join(w[: int(rng.integers(50, 61))]).upper() if i % 7 == 0 else "\t".join(w)))
    docs.append((99, docs[-1][1]))
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words=words, percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == classes(docs, words, percent)


def test_near_duplicates_odd_rows(spark, odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {(r.doc_id, r.component_id) for r in rows} == {(i, i) for i, _ in ODD}
    assert near_duplicates(odd.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_open_windows_find_the_tightest():
    rng, tree, rooms = np.random.default_rng(1), OpenWindows(50), defaultdict(list)
    for w in range(300):
        room = int(rng.integers(1, 51))
        tree.put(room, w)
        rooms[room].append(w)
        length = int(rng.integers(1, 51))
        fits = [r for r in rooms if r >= length and rooms[r]]
        assert tree.take(length) == ((min(fits), rooms[min(fits)].pop()) if fits else None)


def test_packing_loses_nothing(spark, odd):
    assert best_fit_decreasing([], 8) == ([], 0) and best_fit_decreasing([0, 16, 3], 8) == ([(1, 0, 8, 0, 0), (1, 8, 8, 1, 0), (2, 0, 3, 2, 0)], 3)
    encoder, by, windows = TextEncoder(WORDS), defaultdict(list), defaultdict(list)
    for r in pack(odd, WORDS, end_id=2, capacity=64, block_tokens=1000).collect():
        by[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, texts in {i: [t or "" for j, t in ODD if j == i] for i, _ in ODD}.items():
        whole = b"".join(bytes(r.ids) for r in sorted(by[i], key=lambda r: (r.start, r.sequence_id)))
        want = encoder.encode(texts[0]) + np.array([2], "<u4").tobytes()
        assert len(whole) == len(want) * len(texts) and (len(texts) > 1 or whole == want)
    for rows in windows.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows[:-1])]).tolist() and sum(r.length for r in rows) <= 64
    assert pack(odd.limit(0), WORDS, end_id=2).count() == 0


def test_pipeline_stages(spark, larger):
    import corpus_pipeline as P

    docs = table(spark, larger, "documents")
    labels = {r.doc_id: r for r in table(spark, larger, "labels").collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, larger)
        assert out.columns == docs.columns
        from loadlark.llm.common import materialize

        docs = materialize(out, name)
        now = {r.doc_id: r.text for r in docs.collect()}
        gone = kept.keys() - now.keys()
        assert gone and all(now[i] == kept[i] for i in now)
        if name == "toxicity":
            assert sum(labels[i].toxic for i in gone if i in labels) >= 0.9 * sum(labels[i].toxic for i in labels)
        if name == "quality":
            assert sum(labels[i].quality for i in gone if i in labels) <= 0.05 * sum(labels[i].quality for i in labels)
        if name == "near_duplicates":
            first = {i: root for i, (_, root) in classes_of(kept).items()}
            assert now.keys() == {i for i in kept if first[i] == i}
        if name == "decontamination":
            items = [WORD.findall(r.text.translate(LOWER)) for r in table(spark, larger, "benchmark").collect()]
            runs = {" ".join(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
            hit = {i for i, t in kept.items() if any(f" {r} " in " " + " ".join(WORD.findall(t.translate(LOWER))) + " " for r in runs)}
            assert gone == hit
        kept = now
    assert {r.doc_id for r in P.STAGES[-1][1](spark, docs, larger).select("doc_id").distinct().collect()} == set(kept)


def classes_of(docs):
    """Like classes() for five words and 0.8, but only over pairs that share a shingle which few documents have."""
    sets, holders = {}, defaultdict(list)
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        k = min(5, len(w))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()
        for s in sets[i]:
            holders[s].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j in {j for t in s for j in holders[t] if j > i}:
            if find(i) != find(j) and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_licence_tags_on_one_line_and_long_expressions(spark):
    flat = "x SPDX-License-Identifier: MIT some words SPDX-License-Identifier: GPL-3.0-only end\nSPDX-License-Identifier: ISC OR spdx-license-identifier:MPL-2.0"
    long = "SPDX-License-Identifier: " + "MIT AND " * 2_000 + "GPL-2.0-only"
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame([(1, flat), (2, long), (3, "SPDX-License-Identifier:\nMIT")], "doc_id long, text string")).collect()}
    assert got[1].expressions == ["MIT", "GPL-3.0-only", "ISC", "MPL-2.0"] and got[1].labels == ["gpl", "isc", "mit", "mpl"] and got[1].score == 0.3
    assert got[2].expressions[0].count("MIT") == 2_000 and got[2].labels == ["gpl", "mit"] and got[2].score == 0.3
    assert got[3].expressions == [] and got[3].score == 0


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (np.array([1.0, 0.0, 0.0]) + 0.05 * rng.standard_normal(3)).tolist()) for i in range(40)]
    rows += [(100 + i, [-1.0, 0.5, 0.25]) for i in range(8)] + [(150, [-1.0, 0.5, 0.2501])]
    want = exact_nearest({i: np.array(x) for i, x in rows}, 50, 5)
    for repeats in (1, 2, 7):
        for width in (1.0, 1e-6):  # in so narrow slots only equal vectors meet, and queries are compared with all rows
            df = spark.createDataFrame([r for r in rows for _ in range(repeats)], "vec_id long, embedding array<double>").coalesce(1)
            got = defaultdict(list)
            for r in nearest(df, width=width).orderBy("query_id", "rank").collect():
                got[r.query_id].append(r.vec_id)
            assert got == want, (repeats, width)


def test_nearest_takes_the_best_vector_of_a_shared_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(3).tolist()) for i in range(30) for _ in range(3 if i % 4 == 0 else 1)]
    score = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)
    best = {i: max(score(x, y) for q, x in rows if q == 0 for j, y in rows if j == i) for i, _ in rows if i}
    want = sorted(best, key=lambda i: (-best[i], i))[:5]
    for width in (1.0, 1e-6):
        got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), width=width).orderBy("rank").collect()
        assert [r.vec_id for r in got] == want and np.allclose([r.score for r in got], [best[i] for i in want]), width


def test_quality_learns_nothing_from_held_out_labels(spark, larger):
    docs, labels = table(spark, larger, "documents"), table(spark, larger, "labels")
    held = [r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    altered = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 0).otherwise(F.col("quality")))
    a, b = fit_quality(docs, labels), fit_quality(docs, altered)
    assert a.prior == b.prior and np.array_equal(a.weights, b.weights)
    scores = [{(r.doc_id, r.text): r.score for r in score_quality(docs.limit(200), m).collect()} for m in (a, b)]
    assert scores[0] == scores[1]


def test_index_entries_name_their_sets_by_number():
    import pyarrow as pa

    from loadlark.llm import jaccard

    entries = pa.RecordBatch.from_pydict({"shingle": [1, 1, 2], "no": [5, 3, 7], "n": pa.array([4, 4, 4], pa.int32()), "place": pa.array([0, 0, 0], pa.int32())})
    assert [b.to_pylist() for b in jaccard._lists(50)(iter([entries]))] == [[{"leader_no": 3, "leader_n": 4, "no": 5, "n": 4}]]
