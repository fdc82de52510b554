"""Words of a block of texts as numbers, for operators that compare places within each text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .common import texts

#: Bytes and texts of one block; a longer text is a block of its own.
BLOCK_BYTES, BLOCK_TEXTS = 1 << 20, 512


@dataclass
class WordBlock:
    """Whole texts and their words `[^\\x20\\x09-\\x0D]+`: all words in order, how many each text has, and equal codes (from 1) for equal words."""

    texts: list[bytes]
    words: list[bytes]
    counts: np.ndarray
    codes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.counts)


def word_block(held: list[bytes]) -> WordBlock:
    words, counts = [], []
    for t in held:
        w = t.split()  # bytes split at ASCII white space only
        words += w
        counts.append(len(w))
    codes = pa.array(words, pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return WordBlock(held, words, np.array(counts, np.int64), codes)


def word_blocks(column: pa.Array) -> Iterator[WordBlock]:
    """All texts of a column in their order, block by block; a null text has no words."""
    held, size = [], 0
    for t in texts(column):
        if held and (size + len(t) > BLOCK_BYTES or len(held) >= BLOCK_TEXTS):
            yield word_block(held)
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield word_block(held)
