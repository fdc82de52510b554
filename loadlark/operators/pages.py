"""Pages of documents: their roles, the class of the document, and fields of pasted `label: value` texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_LINES = 20


def page_texts(text: Column, size: int = PAGE_LINES) -> Column:
    """The pages of a text, each of so many lines; a null text is one empty page."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / size).cast("int")), lambda p: F.array_join(F.slice(lines, p * size + 1, F.lit(size)), "\n"))


def page_role(page: Column) -> Column:
    """empty, terms, table, contact or body: the first that fits."""
    low = F.lower(page)
    return F.when(F.trim(page) == "", "empty").when(low.contains("license") | low.contains("copyright"), "terms").when(page.contains("|"), "table").when(page.contains("@"), "contact").otherwise("body")


def classify_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Roles of each document's pages, its class by an ordered cascade over them, and the pages (from 0) to extract from.

    All of it is one projection over the row, without a shuffle.
    """
    rows = docs.withColumn("roles", F.transform(page_texts(F.col(text_col)), page_role))
    has = lambda role: F.array_contains("roles", role)
    core = has("body") | has("table")
    name = (
        F.when(F.forall("roles", lambda r: r == "empty"), "EMPTY").when(has("terms") & ~core, "SUPPLEMENTAL").when(has("table") & has("terms"), "TABLE_WITH_TERMS").when(has("table"), "TABLE")
        .when(has("contact") & ~core, "CONTACT_SHEET").when(has("terms"), "BODY_WITH_TERMS").otherwise("BODY")
    )
    pages = F.filter(F.transform("roles", lambda r, i: F.when(r.isin("body", "table"), i)), lambda i: i.isNotNull())
    return rows.withColumns({"document_class": name, "extract_pages": F.when(name.isin("EMPTY", "SUPPLEMENTAL"), F.array().cast("array<int>")).otherwise(pages)})


def pasted_fields(lines: DataFrame, id_col: str | list[str], fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per text with its named fields: name -> (section, label in lower case); the first line that states a field counts.

    lines: id, line_no, line, section. A label without a value takes the next line, unless that is a label itself.
    """
    order = Window.partitionBy(id_col).orderBy("line_no")
    label, rest = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.regexp_extract("line", "^[^:]*:(.*)$", 1))
    below = F.lead("line").over(order)
    value = F.when(rest != "", rest).when(~below.contains(":"), F.trim(below))
    stated = lines.withColumn("value", value).where(F.col("line").contains(":")).withColumn("label", label)
    pick = lambda s, n: F.min_by("value", F.when((F.col("section") == s) & (F.col("label") == n) & F.col("value").isNotNull(), F.col("line_no")))
    return stated.groupBy(*([id_col] if isinstance(id_col, str) else id_col)).agg(*(pick(s, n).alias(name) for name, (s, n) in fields.items()))
