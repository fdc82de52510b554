"""Queries over pages and pasted texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import pages as G
from ..sources.views import table
from .events import TEXT_SQL, documents_of_loads, twins

FIELDS = {
    "load_number": ("header", "load number"), "pickup_location": ("pickup", "location"), "pickup_date": ("pickup", "date"), "delivery_location": ("delivery", "location"),
    "delivery_date": ("delivery", "date"), "total": ("rate", "total carrier rate"), "weight": ("terms", "weight"),
}


def document_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.classify_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.array_join("roles", ",").alias("roles"), "document_class", F.array_join("extract_pages", ",").alias("extract_pages"))


def pasted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate confirmations as pasted by hand: in every fourth one values stand below their labels."""
    text = F.when(F.col("load_id") % 4 == 0, F.replace(F.col("text"), F.lit(": "), F.lit(":\n"))).otherwise(F.col("text"))
    own = ["load_id", "twin"]
    read = G.pasted_fields(X.carry_section(X.lines(twins(documents_of_loads(spark, sf_dir)), own, text), own), own, FIELDS)
    # texts of one load id are read each by itself, then the larger value of a field counts
    return read.groupBy("load_id").agg(*(F.max(f).alias(f) for f in FIELDS))


QUERIES = {"document_classes": document_classes, "pasted_fields": pasted_fields}
ORACLES = {
    "document_classes": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, list_transform(range(0, (len(ls) - 1) // 20 + 1), lambda i: array_to_string(ls[i * 20 + 1:i * 20 + 20], chr(10))) AS ps FROM l),
r AS (SELECT doc_id, list_transform(ps, lambda t: CASE WHEN trim(t, ' ') = '' THEN 'empty' WHEN contains(lower(t), 'license') OR contains(lower(t), 'copyright') THEN 'terms' WHEN contains(t, '|') THEN 'table' WHEN contains(t, '@') THEN 'contact' ELSE 'body' END) AS rs FROM p),
f AS (SELECT *, list_contains(rs, 'terms') AS t, list_contains(rs, 'table') AS b, list_contains(rs, 'contact') AS c, list_contains(rs, 'body') OR list_contains(rs, 'table') AS core, len(list_filter(rs, lambda x: x <> 'empty')) = 0 AS e FROM r),
n AS (SELECT *, CASE WHEN e THEN 'EMPTY' WHEN t AND NOT core THEN 'SUPPLEMENTAL' WHEN b AND t THEN 'TABLE_WITH_TERMS' WHEN b THEN 'TABLE' WHEN c AND NOT core THEN 'CONTACT_SHEET' WHEN t THEN 'BODY_WITH_TERMS' ELSE 'BODY' END AS document_class FROM f)
SELECT doc_id, array_to_string(rs, ',') AS roles, document_class, CASE WHEN document_class IN ('EMPTY', 'SUPPLEMENTAL') THEN '' ELSE array_to_string(list_filter(list_transform(rs, lambda x, i: CASE WHEN x IN ('body', 'table') THEN i - 1 END), lambda x: x IS NOT NULL), ',') END AS extract_pages FROM n""",
    "pasted_fields": TEXT_SQL + ", parts AS (SELECT load_id, section, lower(split_part(line, ': ', 1)) AS label, substr(line, instr(line, ': ') + 2) AS value FROM sections WHERE contains(line, ': ')) SELECT load_id, " + ", ".join(f"max(value) FILTER (WHERE section = '{s}' AND label = '{n}') AS {f}" for f, (s, n) in FIELDS.items()) + " FROM parts GROUP BY load_id",
}
