"""Token ids by the tokenizers library, with the ids of words that were seen kept in each worker."""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Unicode white space, as regular expressions of the tokenizer files see it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A word with the white space before it, or white space at the end: no token of the byte-level files crosses the start of one.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
WORD = re.compile(f"[^{SPACE}]+")
# Letters that need no care (no composition, simple lower case), and punctuation without apostrophes and what special tokens hold.
LETTERS = string.ascii_letters + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


def _strings(column: pa.Array) -> list[str]:
    """As to_pylist, ten times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Encodes whole texts word by word; exact, as neither kind of file has a token that crosses the start of a CHUNK or WORD.

    spaces: whether white space is part of tokens (byte-level files) or dropped (word files). Ids of up to twice `cache`
    words are kept: when `cache` new ones have come, those not seen since the last time are forgotten.
    """

    def __init__(self, path: str, cache: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache = self.tokenizer.model, cache
        self.new: dict[str | tuple[str], bytes] = {}
        self.old: dict[str | tuple[str], bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.line = self._slow("\n")
        self.spaces = bool(self.line)
        # printable characters that stand for bytes in byte-level vocabularies, as the file's own pre-tokenizer maps them
        self.byte_char = {}
        for b in [*range(33, 39), *range(40, 127), *range(0xC0, 0x100)]:
            c = chr(b)
            shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0]
            for raw, mapped in zip(c.encode(), shown, strict=True):
                self.byte_char[raw] = mapped
        self.space = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][0] if self.spaces else ""
        self.byte_char[32] = self.space

    def _slow(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of one pre-token."""
        if piece.isascii():  # letters and marks stand for themselves
            shown = self.space + piece[1:] if piece[0] == " " else piece
        else:
            shown = piece.encode().decode("latin-1").translate(self.byte_char)
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def _stem(self, stem: str) -> bytes:
        """The ids of letters after a space, or after a new line that the stem starts with."""
        if not self.spaces:
            return self._piece(stem.lower())
        return self.line + self._piece(stem[1:]) if stem[0] == "\n" else self._piece(" " + stem)

    def _known(self, key: str | tuple[str], chunk: str, encode: Callable[[str], bytes]) -> bytes:
        ids = self.new.get(key)
        if ids is None:
            ids = self.old.get(key)
            if ids is None:
                ids = encode(chunk)
            if len(self.new) >= self.cache:
                self.old, self.new = self.new, {}
            self.new[key] = ids
        return ids

    def _part(self, part: str) -> bytes | None:
        """The ids of what stands between two spaces (byte-level files) or white spaces; None if it needs the text around it."""
        if not self.spaces:
            return b"".join([self._known((w,), w, self._slow) for w in WORD.findall(part)])
        # a part stands for itself if it starts with a new line, else for itself after a space
        if not part.strip() or part[-1].isspace() or part[part[0] == "\n"].isspace():
            return None
        chunk = part if part[0] == "\n" else " " + part
        return self._known((chunk,), chunk, self._slow)

    def _distinct(self, parts: pa.Array) -> pa.Array:
        """The ids of each of some distinct parts; null for those that need the text around them."""
        # a stem of letters, perhaps after a new line, then punctuation: both are tokenized by themselves
        stems, marks = pc.utf8_rtrim(parts, MARKS), pc.utf8_ltrim(parts, "\n" + LETTERS)
        size = pc.binary_length(stems)
        fits = pc.and_(pc.equal(pc.add(size, pc.binary_length(marks)), pc.binary_length(parts)), pc.greater(size, pc.if_else(pc.starts_with(parts, "\n"), 1, 0)))
        stems, marks = (pc.if_else(fits, x, "").dictionary_encode() for x in (stems, marks))
        found = list(map(self.new.get, names := _strings(stems.dictionary)))
        for i in [i for i, x in enumerate(found) if x is None]:
            found[i] = self._known(names[i], names[i], self._stem) if names[i] else b""  # of parts that don't fit
        for m in (names := marks.dictionary.to_pylist()):
            if m not in self.marks:
                if len(self.marks) >= 10_000:
                    self.marks.clear()
                self.marks[m] = self._piece(m) if m else b""
        ends = pa.array([self.marks[m] for m in names], pa.large_binary())
        whole = pc.binary_join_element_wise(pa.array(found, pa.large_binary()).take(stems.indices), ends.take(marks.indices), pa.scalar(b"", pa.large_binary()))
        if pc.all(fits).as_py():
            return whole
        others = [None if ok else self._part(p) for ok, p in zip(fits.to_pylist(), _strings(parts), strict=True)]
        return pc.if_else(fits, whole, pa.array(others, pa.large_binary()))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; null is empty.

        Texts are split and their distinct parts found for all of them at once; only distinct stems are looked up.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ") if self.spaces else pc.ascii_split_whitespace(texts)
        flat = parts.flatten().dictionary_encode()
        starts, codes = parts.offsets.to_numpy(), flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = self._distinct(flat.dictionary)
        whole = np.zeros(len(texts), bool)  # texts that go chunk by chunk: white space other than single spaces and new lines
        if self.spaces:
            if found.null_count:
                whole = np.logical_or.reduceat(found.is_null().to_numpy(zero_copy_only=False)[codes], starts[:-1])
            # the first part of a text has no space before it
            firsts = flat.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist()
            more: list[bytes] = []
            for i, (at, first) in enumerate(zip(starts[:-1].tolist(), firsts, strict=True)):
                whole[i] |= not first or first[0].isspace() or first[-1].isspace()
                if not whole[i]:
                    codes[at] = len(found) + len(more)
                    more.append(self._known((first,), first, self._slow))
            found = pa.concat_arrays([found, pa.array(more, pa.large_binary())])
        taken = found.fill_null(b"").take(pa.array(codes))
        data, at = memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[starts].tolist()
        for i, slow in enumerate(whole.tolist()):
            yield b"".join([self._known((c,), c, self._slow) for c in CHUNK.findall(texts[i].as_py())]) if slow else bytes(data[at[i] : at[i + 1]])

    def encode(self, text: str) -> bytes:
        return next(self.encode_all(pa.array([text])))


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)
