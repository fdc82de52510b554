"""A bounded, deterministic sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, *, per_class: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """At most per_class documents of each label 0 and 1 outside the held-out fold: text and label.

    The smallest hashes of the ids choose, so the sample does not depend on the order of rows. Only the chosen ids, at most
    twice per_class, are broadcast; documents whose id repeats count once for each distinct text, within twice the bound.
    Null ids, labels and texts, and other labels, are left out.
    """
    # fmt: off
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).where("__id IS NOT NULL AND label IN (0, 1)").where(~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("label").alias("label"))
    chosen = [known.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for c in (0, 1)]
    # fmt: on
    ids = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(F.broadcast(ids), "__id")
    # equal texts count once, with their larger label; should ids repeat, the smallest hashes of the texts choose
    texts = rows.groupBy("text").agg(F.max("label").alias("label"))
    return materialize(texts.orderBy(F.xxhash64("text"), "text").limit(4 * per_class), f"sample-{label_col}")
