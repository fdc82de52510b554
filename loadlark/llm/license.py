"""Licence scans: Aho-Corasick over normalised words, and a shunting-yard parser for licence expressions in identifier tags."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ALNUM, bounded_batches, map_batches, spaced, texts

# Phrases of the base list and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICE_PHRASES = {
    "all rights reserved": "reserved",
    "bsd license": "bsd",
    "creative commons attribution": "cc-by",
    "eclipse public license": "epl",
    "gnu affero general public license": "agpl",
    "gnu lesser general public license": "lgpl",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "public domain": "public-domain",
    "redistribution and use in source and binary forms": "bsd",
}
# How free the use is under each phrase's label, from 0 to 1.
FREEDOM = {"gpl": 0.3, "apache": 0.9, "cc-by": 0.8, "mit": 0.9, "reserved": 0.0, "bsd": 0.9, "epl": 0.5, "agpl": 0.1, "lgpl": 0.5, "isc": 0.9, "mpl": 0.6, "public-domain": 1.0}
# Identifiers in expressions without version, their labels, and how free the use is.
IDENTIFIERS = {
    "0bsd": ("bsd", 1.0),
    "afl": ("afl", 0.8),
    "agpl": ("agpl", 0.1),
    "apache": ("apache", 0.9),
    "apsl": ("apsl", 0.5),
    "artistic": ("artistic", 0.6),
    "beerware": ("beerware", 0.9),
    "blueoak": ("blueoak", 0.9),
    "bsd": ("bsd", 0.9),
    "bsl": ("bsl", 0.9),
    "busl": ("busl", 0.0),
    "cc-by": ("cc-by", 0.8),
    "cc-by-nc": ("cc-by-nc", 0.1),
    "cc-by-nc-nd": ("cc-by-nc-nd", 0.0),
    "cc-by-nc-sa": ("cc-by-nc-sa", 0.1),
    "cc-by-nd": ("cc-by-nd", 0.1),
    "cc-by-sa": ("cc-by-sa", 0.5),
    "cc-pddc": ("public-domain", 1.0),
    "cc0": ("public-domain", 1.0),
    "cddl": ("cddl", 0.5),
    "cecill": ("cecill", 0.4),
    "cecill-b": ("cecill-b", 0.8),
    "cecill-c": ("cecill-c", 0.5),
    "cpal": ("cpal", 0.4),
    "cpl": ("cpl", 0.5),
    "curl": ("curl", 0.9),
    "ecl": ("ecl", 0.8),
    "efl": ("efl", 0.9),
    "elastic": ("elastic", 0.0),
    "entessa": ("entessa", 0.8),
    "epl": ("epl", 0.5),
    "eupl": ("eupl", 0.4),
    "fair": ("fair", 0.9),
    "fsfap": ("fsfap", 0.9),
    "ftl": ("ftl", 0.8),
    "gfdl": ("gfdl", 0.4),
    "gpl": ("gpl", 0.3),
    "hpnd": ("hpnd", 0.9),
    "icu": ("icu", 0.9),
    "ijg": ("ijg", 0.9),
    "ipl": ("ipl", 0.5),
    "isc": ("isc", 0.9),
    "json": ("json", 0.6),
    "lgpl": ("lgpl", 0.5),
    "libpng": ("libpng", 0.9),
    "lppl": ("lppl", 0.6),
    "mit": ("mit", 0.9),
    "mit-0": ("mit", 1.0),
    "mit-cmu": ("mit", 0.9),
    "mpl": ("mpl", 0.6),
    "ms-pl": ("ms-pl", 0.7),
    "ms-rl": ("ms-rl", 0.5),
    "mulanpsl": ("mulanpsl", 0.9),
    "naist": ("naist", 0.8),
    "nasa": ("nasa", 0.5),
    "naumen": ("naumen", 0.8),
    "ncsa": ("ncsa", 0.9),
    "nlpl": ("public-domain", 1.0),
    "npl": ("npl", 0.5),
    "ntp": ("ntp", 0.9),
    "odbl": ("odbl", 0.5),
    "odc-by": ("odc-by", 0.8),
    "ofl": ("ofl", 0.7),
    "oldap": ("oldap", 0.8),
    "openssl": ("openssl", 0.8),
    "osl": ("osl", 0.3),
    "parity": ("parity", 0.1),
    "pddl": ("public-domain", 1.0),
    "php": ("php", 0.8),
    "polyform-noncommercial": ("polyform", 0.0),
    "postgresql": ("postgresql", 0.9),
    "psf": ("psf", 0.8),
    "python": ("psf", 0.8),
    "qpl": ("qpl", 0.3),
    "rpl": ("rpl", 0.2),
    "ruby": ("ruby", 0.7),
    "sgi-b": ("sgi-b", 0.9),
    "sleepycat": ("sleepycat", 0.3),
    "spl": ("spl", 0.5),
    "sspl": ("sspl", 0.0),
    "tcl": ("tcl", 0.9),
    "unicode-dfs": ("unicode", 0.9),
    "unlicense": ("public-domain", 1.0),
    "upl": ("upl", 0.9),
    "vim": ("vim", 0.6),
    "w3c": ("w3c", 0.9),
    "watcom": ("watcom", 0.4),
    "wtfpl": ("public-domain", 1.0),
    "x11": ("mit", 0.9),
    "xnet": ("xnet", 0.9),
    "zlib": ("zlib", 0.9),
    "zpl": ("zpl", 0.8),
}
#: What may follow an identifier's name: clauses of BSD licences, a version with a jurisdiction, and whether later versions count.
SUFFIX = re.compile(r"(?:-\d+-clause(?:-[a-z-]+)?)?(?:-\d+(?:\.\d+)*(?:-[a-z]{2,3})?)?(?:\+|-only|-or-later)?")
#: What an identifier reads as that is not in the list: cautious, but not as the worst that is known.
UNKNOWN = ("other", 0.2)
#: `with` binds tightest; an exception raises the freedom of the licence before it by this share of what is missing.
PRECEDENCE, EXCEPTION_GAIN = {"or": 1, "and": 2, "with": 3}, 0.25
TAG, TAG_WORDS, LINE_END = b"spdx-license-identifier:", " spdx license identifier ", re.compile(r"[\r\n]|\Z")
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, score double"


def parse_expression(text: str, at: int = 0, end: int | None = None) -> list[str] | None:
    """Postfix tokens by the shunting-yard method. The longest valid expression at the start of text[at:end] counts; None if there is none."""
    end = len(text) if end is None else end
    out: list[str] = []
    stack: list[str] = []
    best, operand_next, depth, exception = None, True, 0, False
    while m := TOKEN.match(text, at, end):
        token = m[1]
        word = token.lower()
        if token == "(":
            if not operand_next or exception:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in PRECEDENCE:
            if operand_next:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next, exception = True, word == "with"
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = exception = False
        at = m.end()
        if not operand_next and not depth:
            best = len(out), stack[::-1]  # out only grows, and outside of parentheses the stack holds an operator of each kind at most
    return out[: best[0]] + best[1] if best else None


def expressions_at(raw: bytes, words: list[int]) -> Iterator[list[str]]:
    """The expression of each tag that has one, given the numbers of the tags' first words; it ends with the line or before the next
    tag, however long it is. A tag is written with its dashes and colon, in any case."""
    inside = np.frombuffer(b" " + raw.translate(ALNUM), np.uint8) != 32
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])[words].tolist()
    starts = [at for at in starts if raw[at : at + len(TAG)].lower() == TAG]
    text, line_end = raw.decode("latin-1"), -1  # one character for each byte
    for start, after in zip_longest(starts, starts[1:]):
        at = start + len(TAG)
        if line_end < at:
            line_end = LINE_END.search(text, at).start()
        if postfix := parse_expression(text, at, line_end if after is None else min(line_end, after)):
            yield postfix


def tagged_expressions(text: str) -> Iterator[list[str]]:
    """The expressions of a text's identifier tags, found by the automaton."""
    raw = text.encode()
    return expressions_at(raw, [word for word, _, label in hits(spaced(raw).decode("utf-8", "replace")) if label is None])


def identifier(token: str) -> tuple[str, float]:
    """Label and freedom of an identifier: a known name, then nothing but its version and the like. All else is UNKNOWN."""
    word = token.lower()
    return next((IDENTIFIERS[k] for k in sorted(IDENTIFIERS, key=len, reverse=True) if word.startswith(k) and SUFFIX.fullmatch(word, len(k))), UNKNOWN)


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """How free the use is, and the labels: `or` lets the user choose, `and` binds to both, `with` eases what stands before it."""
    stack: list[tuple[float, set[str]]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (b, more), (a, labels) = stack.pop(), stack.pop()
            stack.append((max(a, b), labels | more) if token == "or" else (min(a, b), labels | more) if token == "and" else (a + (1 - a) * EXCEPTION_GAIN, labels))
        else:
            label, free = identifier(token)
            stack.append((free, {label}))
    return stack[0]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICE_PHRASES}:
        found.add_word(f" {phrase} ", (phrase.count(" ") + 2, BASE_PHRASES.get(phrase), BASE_PHRASES.get(phrase) or NOTICE_PHRASES[phrase]))
    found.add_word(TAG_WORDS, (TAG_WORDS.count(" "), None, None))
    found.make_automaton()
    return found


def hits(words: str) -> Iterator[tuple[int, str | None, str | None]]:
    """First word, base label and label of each phrase in spaced words; a tag has no labels."""
    spaces = upto = 0  # spaces of the text up to the present hit: its ends come in order
    for end, (own, base_label, label) in _automaton().iter(words):
        spaces, upto = spaces + words.count(" ", upto, end + 1), end + 1
        yield spaces - own, base_label, label


def _scan(batch: pa.RecordBatch, text_col: str) -> list:
    rows: list[list] = [[] for _ in range(8)]
    for raw in texts(batch.column(text_col)):
        norm = spaced(raw)
        base, base_labels, labels, tags, free = [], set(), set(), [], []
        for word, base_label, label in hits(norm.decode("utf-8", "replace")):
            if label is None:
                tags.append(word)
                continue
            labels.add(label)
            free.append(FREEDOM[label])
            if base_label:
                base.append(word)
                base_labels.add(base_label)
        expressions = []
        for postfix in expressions_at(raw, tags) if tags else ():
            value, found = evaluate(postfix)
            expressions.append(" ".join(postfix))
            labels |= found
            free.append(value)
        values = [norm.count(b" ") - 1, len(base), min(base, default=None), max(base, default=None), sorted(base_labels), sorted(labels), expressions, min(free, default=0.0)]
        for column, value in zip(rows, values, strict=True):
            column.append(value)
    return rows


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Find licence phrases and evaluate the licence expressions of identifier tags in whole texts.

    Words: A-Z lowered, runs of ASCII letters, digits and non-ASCII characters. Added: n_words; n_base, first_word and
    last_word (all places where the words of a base phrase stand consecutively, and the smallest and largest start, null
    without a place); base_labels; labels (those of the base, of further notices and of expressions; both sorted); expressions
    (postfix) and score: how free the use is under all that was found, 0 to 1, and 0 where nothing was.

    Each tag of a line has its own expression, of any length, up to the next tag; it is parsed where the automaton found the tag. Null
    and empty texts have no words and no labels; an unreadable expression is ignored; an identifier that is not in the list gets the
    label `other` and a freedom of 0.2; repeated rows are each scanned. `keep` names the input columns to return (all by default); an
    added column replaces an input column of its name. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch, _scan(batch, text_col)

    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), ADDED, run, keep)
