"""Queries over the layout of rate confirmations and over document templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import layout as Y
from ..sources.views import table
from .events import TEXT_SQL, documents_by_id, documents_of_loads

# Terms of the templates.
TEMPLATES = {"menu": ["|", " | the"], "shout": ["!!", "the!!"], "symbols": ["%%%", "$$$", "***"], "prose": ["the ", ". ", "and "]}


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.label_values(Y.cells(X.lines(documents_of_loads(spark, sf_dir), "load_id", F.col("text")), "load_id"), "load_id")


def layout_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label of each document, how many cells are in its row, to its right, below, near in y and within the box around it."""
    return documents_by_id(spark, sf_dir).select("load_id", F.explode(Y.document_neighbours(F.col("texts"))).alias("n")).select("load_id", "n.*")


def template_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.match_templates(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", TEMPLATES)


QUERIES = {"label_values": label_values, "layout_neighbours": layout_neighbours, "template_match": template_match}
ORACLES = {
    "layout_neighbours": TEXT_SQL + """, parts AS (
  SELECT load_id, line_no, line_no // 8 AS page, (line_no % 8) * 14 AS y0, 6 * length(split_part(line, ': ', 1)) AS w, 6 * length(substr(line, length(split_part(line, ': ', 1)) + 3)) AS v FROM lines WHERE contains(line, ': ')
), cells AS (SELECT load_id, page, line_no, true AS label, 0 AS x0, w AS x1, y0, y0 + 10 AS y1 FROM parts UNION ALL SELECT load_id, page, line_no, false, w + 12, w + 12 + v, y0, y0 + 10 FROM parts
), pairs AS (
  SELECT a.load_id, a.line_no, (least(a.y1, b.y1) - greatest(a.y0, b.y0)) * 100 >= 350 AS beside, b.x0 - a.x1 AS gap, b.y0 - a.y1 BETWEEN 0 AND 80 AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AS below, abs(a.y0 - b.y0) <= 30 AS near,
         b.x0 >= a.x0 - 1 AND b.x1 <= a.x1 + 200 AND b.y0 >= a.y0 - 15 AND b.y1 <= a.y1 + 15 AS within
  FROM cells a LEFT JOIN cells b ON a.load_id = b.load_id AND a.page = b.page AND (a.line_no <> b.line_no OR NOT b.label) WHERE a.label)
SELECT load_id, line_no, count(*) FILTER (WHERE beside) AS n_same_row, count(*) FILTER (WHERE beside AND gap BETWEEN 0 AND 240) AS n_right, count(*) FILTER (WHERE below) AS n_below, count(*) FILTER (WHERE near) AS n_near, count(*) FILTER (WHERE within) AS n_within FROM pairs GROUP BY load_id, line_no""",
    "label_values": TEXT_SQL + """, parts AS (
  SELECT load_id, line_no, line_no // 8 AS page, (line_no % 8) * 14 AS y0, split_part(line, ': ', 1) AS label, substr(line, length(split_part(line, ': ', 1)) + 3) AS value FROM lines WHERE contains(line, ': ')
), pairs AS (
  SELECT a.load_id, a.line_no AS label_line, b.line_no AS value_line, a.label, b.value,
    CASE WHEN (least(b.y0, a.y0) + 10 - greatest(b.y0, a.y0)) * 100 >= 350 AND 6 * length(b.label) + 12 - 6 * length(a.label) BETWEEN 0 AND 240 THEN 92 - (6 * length(b.label) + 12 - 6 * length(a.label)) // 40
         WHEN b.y0 - a.y0 - 10 BETWEEN 0 AND 80 AND least(6 * length(b.label) + 12 + 6 * length(b.value), 6 * length(a.label)) > 6 * length(b.label) + 12 THEN 84 - (b.y0 - a.y0 - 10) // 40 END AS score
  FROM parts a JOIN parts b ON a.load_id = b.load_id AND a.page = b.page
)
SELECT load_id, label, value, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY load_id, label_line ORDER BY score DESC, value_line) AS place FROM pairs WHERE score IS NOT NULL) WHERE place = 1""",
    "template_match": "WITH t(template, term) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, terms in TEMPLATES.items() for b in terms) + """), h AS (SELECT doc_id, template, count(*) FILTER (WHERE contains(lower(text), term)) AS hits, count(*) AS terms FROM documents, t GROUP BY doc_id, template),
r AS (SELECT *, CAST(hits * 100 // terms AS INTEGER) AS share FROM h), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, hits DESC, template DESC) AS n FROM r) SELECT doc_id, CASE WHEN share >= 50 THEN template END AS template, share FROM b WHERE n = 1""",
}
