"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import format_chats, parse_chats
from .common import scratch_path, table
from .decontam import decontaminate
from .jaccard import near_duplicates
from .license import scan_licenses
from .packing import pack
from .quality import fit_quality, score_quality
from .rules import apply_rules, fit_rules
from .runs import find_runs
from .sampling import held_out
from .tokenbin import read_tokens, write_tokens
from .toxicity import fit_severity, grade_toxicity
from .urlfilter import judge_urls
from .whitening import fit_whitening, whiten


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item, and the digest of the items found."""
    marked = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written to seekable files in ascending order of the ids and read back from them."""
    manifest = write_tokens(table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_tokens(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and conversation -7, formatted, read back from the windows and digested."""
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    windows = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))
    joined = lambda column, f: F.array_join(F.transform(column, f), "")
    read = parse_chats(windows).select(
        "conv_id", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.struct("window", joined("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))).alias("turns"), F.array_join("targets", "").alias("targets")).alias("part"),
    )
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("part")).alias("parts"))
    turns, targets = joined("parts", lambda x: x["turns"]), joined("parts", lambda x: x["targets"])
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(targets).cast("long").alias("loss_chars"), F.sha2(targets, 256).alias("loss_sha256"), "formatted_chars")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and labels of licence phrases in every document, and how free the use is under all that was found."""
    found = scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


# The rules of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each page's url, and its verdict."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, keep=["page_id"])


OP5_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector by cosine."""
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of quality for every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of every document and the class of documents that it reaches by links of 85 % similarity."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, grade and verdict of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    graded = grade_toxicity(docs, fit_severity(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return graded.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "grade", "score", "predicted")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the leading components of the fit list, one row for each component. deviation is null beyond 64 bits."""
    vectors = table(spark, sf_dir, "embeddings")
    model = fit_whitening(vectors, components=16)
    share = [float(v) / model.trace if model.trace > 0 else None for v in model.values]
    rows = whiten(vectors, model, keep=["vec_id"]).select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, share)).cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.try_element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, of which one in ten, by the crc32 of its id, goes on repeating a stretch of its own words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("w"), F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # the words before a, then the stretch of p words as often as it takes
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int")))
    woven = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), F.lit(1), n), " ")
    chosen = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumns({"a": a.cast("int"), "p": p.cast("int")})
    return chosen.select("doc_id", F.when(n > 0, woven).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document and the digests of all runs and of the text without their repeats."""
    found = find_runs(with_planted_runs(table(spark, sf_dir, "documents")), min_length=6, min_exponent=4, keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.short")
    return rows.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of every document; the trees learn from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    judged = apply_rules(docs, fit_rules(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


#: Words of every document in DuckDB, A-Z lowered.
WORDS_SQL = r"""
words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
)"""

OP1_SQL = rf"""
WITH {WORDS_SQL}, item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT k FROM windows
), places AS (
  SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM words, lengths, unnest(range(1, len(w) - k + 2)) AS u(i)
), hits AS (SELECT r, i, p.k, item FROM places p JOIN windows v ON p.win = v.win AND p.k = v.k
), covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) AS u(j) GROUP BY r
), named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 4) - 1], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * o >= 85 * (x.n + y.n - o)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM least LEFT JOIN sizes USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_url_filter": op5_url_filter,
    "op6_nearest": op6_nearest,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_pack": op9_pack,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {
    "op1_decontaminate": OP1_SQL,
    "op5_url_filter": OP5_SQL,
    "op8_jaccard": OP8_SQL,
}
