"""Packing token ids into fixed windows by best-fit decreasing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import bounded_batches
from .tokens import encoder

#: Ids that one packing block holds at once; windows are shared only within a block.
BLOCK_TOKENS = 6 << 20
FIELDS = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
OUT_BYTES = 8 << 20


class OpenWindows:
    """Open windows by remaining capacity; a segment tree of counts finds the tightest one with room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The room and number of the window with the least room of at least length."""
        node = length + self.size
        if not self.count[node]:
            while node & 1 or not self.count[node + 1]:  # climb until a right neighbour holds windows
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, window, offset) in window order, and the number of windows.

    Documents longer than a window are first cut into full windows; what remains of each is placed, longest first, in the
    tightest open window. Documents without tokens have no pieces.
    """
    pieces, rest, n = [], [], 0
    for d, length in enumerate(lengths):
        full = length // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, n, 0))
            n += 1
        if length % capacity:
            rest.append((length % capacity, d, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    open_windows = OpenWindows(capacity)
    for length, d, start in rest:
        if (found := open_windows.take(length)) is None:
            room, window = capacity, n
            n += 1
        else:
            room, window = found
        pieces.append((d, start, length, window, capacity - room))
        if room > length:
            open_windows.put(room - length, window)
    pieces.sort(key=lambda x: (x[3], x[4]))
    return pieces, n


def pack(docs: DataFrame, tokenizer_path: str, *, end_id: int, capacity: int = 4096, text_col: str = "text", id_col: str = "doc_id", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Tokenize whole texts, append end_id to each, and pack the ids: one row per piece with its ids.

    Returned: id_col, start (ids of the document before the piece), length, doc_tokens, sequence_id, offset in the sequence
    (gapless from 0) and ids (little-endian unsigned 32-bit). Windows are filled by best-fit decreasing within blocks of about
    block_tokens ids of one partition, so no shuffle is needed and a lost task is redone by itself; sequence ids hold the
    partition's number above their lower 32 bits.

    A null or empty text is the end id alone; documents with a null or repeated id are packed row by row; an empty table gives
    no pieces. Other columns of the input are left out, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string(FIELDS)])
    arrow = to_arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base, used = encoder(tokenizer_path).encode_all, TaskContext.get().partitionId() << 32, 0
        ids: list = []
        names: list = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal used
            pieces, n = best_fit_decreasing([len(x) // 4 for x in ids], capacity)
            rows: list[tuple] = []
            size = 0
            for d, start, length, window, offset in pieces:
                rows.append((names[d], start, length, len(ids[d]) // 4, base + used + window, offset, ids[d][4 * start : 4 * (start + length)]))
                size += 4 * length
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
            used += n

        for batch in batches:
            for name, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                names.append(name)
                ids.append(found + end)
                held += len(ids[-1]) // 4
                if held >= block_tokens:
                    yield from flush()
                    ids, names, held = [], [], 0
        if ids:
            yield from flush()

    return docs.select(id_col, docs[text_col].cast("string").alias("__text")).mapInArrow(run, schema)
