"""What the operators of this subpackage share: tables, scratch tables, bounded Arrow batches and byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.io import shared_dir

#: Rows and bytes of one Arrow batch handed to Python; they bound what a worker holds at once.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, however long single texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/loadlark-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: a lost executor costs no recomputation of what is written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, added: str | T.StructType, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple[pa.RecordBatch, list]]], keep: list[str]) -> DataFrame:
    """Append columns to the rows of df. fn yields each batch with the added columns' arrays, in the order of `added`.

    Only the columns in `keep` are returned; an added column replaces a kept one of its name.
    """
    fields = added if isinstance(added, T.StructType) else T._parse_datatype_string(added)
    kept = [c for c in keep if c not in fields.names]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, columns in fn(batches):
            new = [c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(len(kept) + i).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in kept), *new], schema=arrow)

    return df.mapInArrow(run, schema)


#: A-Z in lower case; ASCII letters and digits and all bytes over 0x7F are parts of words, all else is space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
#: A-Z in lower case; only ASCII white space separates words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    column = column.cast(pa.large_binary())
    data, offsets = memoryview(column.buffers()[2] or b""), np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(data[a:b])


def spaced(text: bytes) -> bytes:
    """` w1 w2 ... wn `, or one space for no words. Null texts' slots in Arrow may hold no bytes: they have no words."""
    words = text.translate(ALNUM).split()
    return b" %b " % b" ".join(words) if words else b" "
