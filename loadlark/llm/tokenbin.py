"""Token ids in seekable zstandard files: independent frames with checksums and a trailing seek table."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize
from .tokens import encoder

# Fixed values of the public seekable format: a skippable frame's and the seek table's magic numbers, and the checksum flag.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER, ENTRY = struct.Struct("<IBI"), struct.Struct("<III")
MANIFEST = "shard long, path string, n_docs long, n_ids long"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class SeekableWriter:
    """One frame per document, then a frame with the documents' ids, then the seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.compress, self.entries = out, zstandard.ZstdCompressor(level=level).compress, []
        self.names: list[int | None] = []

    def _frame(self, data: bytes) -> None:
        packed = self.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), _checksum(data)))

    def add(self, name: int | None, ids: bytes) -> None:
        self.names.append(name)
        self._frame(ids)

    def close(self) -> None:
        self._frame(np.array([x or 0 for x in self.names], "<i8").tobytes() + bytes(x is None for x in self.names))
        table = b"".join(ENTRY.pack(*e) for e in self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE))


class SeekableReader:
    """Reads the footer, the seek table and the id frame; then only the frames asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        source.seek(size - FOOTER.size)
        n, _, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEKABLE:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - FOOTER.size - n * ENTRY.size)
        table = np.frombuffer(source.read(n * ENTRY.size), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.lengths, self.sums = table.T
        self.at = np.cumsum(self.packed) - self.packed
        self.starts = (np.cumsum(self.lengths) - self.lengths) // 4  # ids before each document
        index = self._frame(n - 1)
        self.names = [None if gone else x for x, gone in zip(np.frombuffer(index[: 8 * (n - 1)], "<i8").tolist(), index[8 * (n - 1) :], strict=True)]

    def _frame(self, k: int) -> bytes:
        self.source.seek(int(self.at[k]))
        data = zstandard.ZstdDecompressor().decompress(self.source.read(int(self.packed[k])), max_output_size=int(self.lengths[k]))
        if len(data) != self.lengths[k] or _checksum(data) != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return data

    def read(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """Id, ids before it in this file, and token ids of all documents or of the wanted ones."""
        for k, name in enumerate(self.names):
            if wanted is None or name in wanted:
                yield name, int(self.starts[k]), self._frame(k) if self.lengths[k] else b""


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Tokenize whole texts, append end_id, and write shards in ascending id order under path. Returns the manifest: shard, path, n_docs, n_ids.

    Rows are dealt out by ranges of the id, so shard numbers follow the order; rows with one id follow the order of their texts.
    Each task writes under a name of its attempt and then renames the file, so a lost or repeated task leaves one whole shard.

    A null or empty text is the end id alone; a null id comes first and stays null; repeated rows are written each; an empty
    table gives no shards. Other columns of the input are left out, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer_path).encode_all, TaskContext.get()
        fs, root = _open(path)
        final, own = f"{root}/shard-{task.partitionId():06d}.zst", f"{root}/.shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, total = None, 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                if writer is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own)
                    writer = SeekableWriter(out)
                ids += end
                total += len(ids) // 4
                writer.add(name, ids)
        if writer is not None:
            writer.close()
            out.close()
            fs.move(own, final)
            uri = path.rstrip("/") + f"/shard-{task.partitionId():06d}.zst"
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "path": uri, "n_docs": len(writer.names), "n_ids": total}], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, wanted: Sequence[int] | None = None) -> DataFrame:
    """Read shards back: doc_id, ids (little-endian unsigned 32-bit) and start (ids of all documents before it, over all shards).

    Checksums of all frames that are read are tested. With `wanted` only the frames of those documents are decompressed.
    """
    spark = manifest.sparkSession
    bounded_batches(spark)
    chosen = None if wanted is None else set(wanted)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, name = _open(row["path"])
                with fs.open_input_file(name) as source:
                    rows, size = [], 0
                    for doc_id, start, ids in SeekableReader(source).read(chosen):
                        rows.append({"doc_id": doc_id, "start": row["base"] + start, "ids": ids})
                        size += len(ids)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    # one row per shard: few and small, whatever the input
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = max(1, manifest.count())
    return shards.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids binary")
