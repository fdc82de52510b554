"""Readers and writers of the formats that dispatch records come in."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json_list(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that each hold one JSON array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON object per line; blank and malformed lines are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_semicolon_csv(spark: SparkSession, path: str) -> DataFrame:
    """Load-board exports: semicolons, a header, all columns as text and trimmed."""
    rows = spark.read.option("sep", ";").option("header", True).option("encoding", "UTF-8").csv(path)
    return rows.select(*(F.trim(F.col(f"`{c}`")).alias(c.lstrip("\ufeff").strip()) for c in rows.columns))


def read_active(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """The files of a folder whose names end in _active.json."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*_active.json").json(folder)


def read_keyed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object of objects: one row per key."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string, struct<{schema}>>")).alias("key", "x")).select("key", "x.*")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources in their order, under the union of their columns."""
    out = sources[0].withColumn("source_no", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("source_no", F.lit(i)), allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows replaced by new ones of their key, other new ones added; of several new rows the last in order counts."""
    rows = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def children(cases: DataFrame, key: str, column: str) -> DataFrame:
    """An array column as a child table with its order."""
    return cases.select(F.col(key), F.posexplode(column).alias("position", "item"))


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it. A local session may go without: it gets a new one.

    On a cluster a missing setting is an error, as other machines could not see what is written to a folder of this one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[[^,]*(,[^,]*)?\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def cut(rows: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: a checkpoint by columns and compressed, of which readers take what they need."""
    path = f"{shared_dir(rows.sparkSession)}/cut-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checkpointed(spark: SparkSession) -> None:
    """Operators that cut lineage with checkpoints write them to the shared folder."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
