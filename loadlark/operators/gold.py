"""Comparison of what was read with gold labels: normal forms of each kind of value, and stops against stops."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import bind

# Endings of company names, words around times, patterns of times, and the parts of a stop.
LEGAL_SUFFIXES = ["llc", "inc", "inc.", "corp", "corp.", "co", "co.", "company", "ltd", "ltd."]
TIME_WORDS = r"\b(?:appt|appointment|fcfs|time|window|hours|shipping/receiving|shipping|receiving)\b"
TIME_TOKENS = r"\b\d{1,2}:\d{2}\s*(?:am|pm)?\b|\b\d{3,4}\s*(?:am|pm)?\b"
PARTS = ["facility", "address", "city", "state", "zip", "date", "time"]
#: A stop as readers and labels give it; all parts may be null.
STOP = "struct<" + ",".join(f"{p}:string" for p in [*PARTS, "appointment_window"]) + ">"
COMPARED = "struct<status:string,issues:array<string>,n_exact:int,n_partial:int>"
STATES = ["unlabeled", "missing", "normalized_match", "partial_match", "wrong_value"]
ISSUES = [*sorted(["missing_stop", *(f"{how}_{p}" for how in ("missing", "wrong") for p in PARTS)]), "unlabeled"]


def plain(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")))


def normal_money(text: Column) -> Column:
    """Amounts with two decimals, without dollar signs and thousands' commas; empty if it is no amount."""
    bare = F.trim(F.regexp_replace(plain(text), "[$,]", ""))
    return F.coalesce(F.bround(F.nullif(bare, F.lit("")).try_cast("decimal(30,10)"), 2).cast("decimal(30,2)").cast("string"), F.lit(""))


def normal_name(text: Column) -> Column:
    """Company names in lower case, without marks and legal endings."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.lower(plain(text)), "[^a-z0-9 ]+", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(LEGAL_SUFFIXES))
    return F.array_join(words, " ")


def normal_date(text: Column) -> Column:
    """Month, day, year with slashes or dashes as an ISO date; anything else in lower case."""
    year = lambda y: F.lpad(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), 4, "0")
    told = lambda p: F.concat_ws("-", year(p[2]), F.lpad(p[0], 2, "0"), F.lpad(p[1], 2, "0"))
    return bind(plain(text), lambda s: F.when(s.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$"), bind(F.split(s, "[/-]"), told)).otherwise(F.lower(s)))


def _clock(token: Column) -> Column:
    """hh:mm of one time of day, empty if there is no such time."""

    def read(digits: Column) -> Column:
        """Hour and minute as numbers: two digits at the end are minutes."""
        bare = F.replace(digits, F.lit(":"), F.lit(""))
        return F.struct(F.substring(bare, F.lit(1), F.length(bare) - 2).try_cast("int").alias("h"), F.right(bare, F.lit(2)).try_cast("int").alias("m"))

    def told(t: Column) -> Column:
        hour = F.when(F.endswith(token, F.lit("pm")) & (t["h"] < 12), t["h"] + 12).when(F.endswith(token, F.lit("am")) & (t["h"] == 12), 0).otherwise(t["h"])
        return bind(hour, lambda h: F.when(h.between(0, 23) & t["m"].between(0, 59), F.concat_ws(":", F.lpad(h.cast("string"), 2, "0"), F.lpad(t["m"].cast("string"), 2, "0"))).otherwise(""))

    return bind(read(F.translate(token, "apm \t\n\x0b\f\r", "")), told)


def normal_time(text: Column) -> Column:
    """A time of day as hh:mm, two as hh:mm-hh:mm; `fcfs` without one; anything else in lower case without white space."""
    clocks = lambda said: F.filter(F.transform(F.regexp_extract_all(F.regexp_replace(F.translate(said, "\u2013\u2014", "--"), TIME_WORDS, " "), F.lit(TIME_TOKENS), F.lit(0)), _clock), lambda t: t != "")
    other = lambda said: F.when(F.contains(said, F.lit("fcfs")), "fcfs").otherwise(F.regexp_replace(said, r"\s+", ""))
    told = lambda said: bind(clocks(said), lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, 2), "-")).otherwise(other(said)))
    return bind(F.lower(plain(text)), lambda said: F.when(said == "", "").otherwise(told(said)))


def normal_place(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(plain(text)), "[^a-z0-9 ]+", " "))


# The forms above for single texts without spaces around: stops are compared in Arrow batches, where each distinct text is read once.
_NO_PLACE, _NO_DIGIT, _SPACES = re.compile("[^a-z0-9 ]+"), re.compile("[^0-9]+"), re.compile(r"\s+", re.ASCII)
#: Java's `$` also stands before a line's end.
_DATE = re.compile("[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}(?:\r\n|[\n\r\x85\u2028\u2029])?")
_TIME_WORDS, _TIME_TOKENS = re.compile(TIME_WORDS, re.ASCII), re.compile(TIME_TOKENS, re.ASCII)


def _place(text: str) -> str:
    return _NO_PLACE.sub(" ", text.lower()).strip(" ")


def _zip(text: str) -> str:
    return _NO_DIGIT.sub("", text)


def _date(text: str) -> str:
    if not _DATE.fullmatch(text):
        return text.lower()
    month, day, year = re.split("[/-]", text)
    year = f"20{year}" if len(year) == 2 else year
    return f"{year.rjust(4, '0')[:4]}-{month.rjust(2, '0')}-{day.rjust(2, '0')}"


def _bounds(text: str) -> str:
    """A text whose words end where Java's do: letters and digits outside of ASCII are parts of words, as are marks upon letters of 16 bits."""
    if text.isascii():
        return text
    out, base = [], False
    for c in text:
        kind = unicodedata.category(c)
        base = base if kind == "Mn" else kind[0] == "L" or kind == "Nd"
        out.append(c if c.isascii() else "q" if base else "\0")
        base = base and c <= "\uffff"
    return "".join(out)


def _time(text: str) -> str:
    said, clocks = text.lower(), []
    for token in _TIME_TOKENS.findall(_TIME_WORDS.sub(" ", _bounds(said))):
        digits = _NO_DIGIT.sub("", token)
        hour, minute = int(digits[:-2]), int(digits[-2:])
        hour = hour + 12 if token.endswith("pm") and hour < 12 else 0 if token.endswith("am") and hour == 12 else hour
        if hour < 24 and minute < 60:
            clocks.append(f"{hour:02}:{minute:02}")
    return "-".join(clocks[:2]) if clocks else "fcfs" if "fcfs" in said else _SPACES.sub("", said)


FORMS = {p: lru_cache(1 << 16)(form) for p, form in zip(PARTS, [_place, _place, _place, _place, _zip, _date, _time], strict=True)}


def _stops(lists: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The stops that are not null, and each one's row."""
    rows, stops = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists)
    given = stops.is_valid()
    return (rows[given.to_numpy(zero_copy_only=False)], stops.filter(given)) if stops.null_count else (rows, stops)


def _coded(sides: list[pa.Array], form: Callable[[str], str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Numbers which are equal where the forms of two texts are, 0 for an empty form; and which texts hold more than spaces."""
    held = pa.concat_arrays(sides).dictionary_encode()
    texts = [t.decode("utf-8", "replace").strip(" ") for t in held.dictionary.cast(pa.large_binary()).to_pylist()] + [""]
    known = {"": 0}
    code = np.array([known.setdefault(form(t) if t else "", len(known)) for t in texts])
    at, ends = held.indices.fill_null(len(texts) - 1).to_numpy(), np.cumsum([len(s) for s in sides])[:-1]
    return np.split(code[at], ends), np.split(np.array([t != "" for t in texts])[at], ends)


def _normal_stops(wanted: pa.StructArray, said: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both sides' parts as numbers, a row for each of PARTS, and which wanted stops have any part; the window stands in for a missing time."""
    labelled, ours, theirs = np.zeros(len(wanted), bool), [], []
    for part, form in FORMS.items():
        names = ["time", "appointment_window"] if part == "time" else [part]
        codes, given = _coded([side.field(n) for n in names for side in (wanted, said)], form)
        w, s = codes[:2]
        if part == "time":
            w, s = np.where(given[0], w, codes[2]), np.where(given[1], s, codes[3])
        labelled |= np.logical_or.reduce(given[::2])
        ours.append(w)
        theirs.append(s)
    return np.stack(ours), np.stack(theirs), labelled


def _best(wanted: np.ndarray, said: np.ndarray, n_said: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many parts of each wanted stop its best said one agrees in, and as bits what is wrong with the others; one said stop of each row at a time."""
    lacks, other = (np.array([[1 << ISSUES.index(f"{how}_{p}")] for p in PARTS]) for how in ("missing", "wrong"))
    score, wrong = np.zeros(wanted.shape[1], int), np.zeros(wanted.shape[1], int)
    left, place = np.arange(len(score)), 0
    while len(left := left[n_said[left] > place]):
        w, s = wanted[:, left], said[:, first[left] + place]
        agreed = ((w != 0) & (w == s)).sum(0)
        more = agreed > score[left]
        w, s, at = w[:, more], s[:, more], left[more]
        score[at], wrong[at] = agreed[more], (np.where(s == 0, lacks, other) * ((w != 0) & (w != s))).sum(0)
        place += 1
    return score, wrong


def _compare(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    """compare_stops of one Arrow batch, whose arrays are not null."""
    n, (row, wanted), (said_row, said) = len(gold), _stops(gold), _stops(predicted)
    wanted, said, labelled = _normal_stops(wanted, said)
    row, wanted = row[labelled], wanted[:, labelled]
    n_wanted, n_said = np.bincount(row, minlength=n), np.bincount(said_row, minlength=n)
    score, wrong = _best(wanted, said, n_said[row], (np.cumsum(n_said) - n_said)[row])
    parts, no_stop = (wanted != 0).sum(0), 1 << ISSUES.index("missing_stop")
    exact = (parts > 0) & (score == parts)
    n_exact, n_partial = np.bincount(row[exact], minlength=n), np.bincount(row[(score > 0) & ~exact], minlength=n)

    status = np.select([n_wanted == 0, n_said == 0, n_exact == n_wanted, n_exact + n_partial > 0], [0, 1, 2, 3], 4)
    bits = np.zeros(n, int)
    if len(row):
        bits[n_wanted > 0] = np.bitwise_or.reduceat(np.where(score == 0, no_stop, np.where(exact, 0, wrong)), (np.cumsum(n_wanted) - n_wanted)[n_wanted > 0])
    bits = np.where(status == 0, 1 << ISSUES.index("unlabeled"), np.where(status == 1, no_stop, bits))
    sets, at = np.unique(bits, return_inverse=True)
    issues = pa.array([[name for i, name in enumerate(ISSUES) if s >> i & 1] for s in sets.tolist()], pa.list_(pa.string())).take(pa.array(at))
    return pa.StructArray.from_arrays([pa.array(STATES).take(pa.array(status)), issues, pa.array(n_exact, pa.int32()), pa.array(n_partial, pa.int32())], ["status", "issues", "n_exact", "n_partial"])


def compare_stops(predicted: Column, gold: Column) -> Column:
    """status and issues of predicted stops against gold ones, and how many gold stops were met in full and in part.

    predicted, gold: arrays of STOP; null stops, and gold stops without any part, do not count. Each gold stop takes the predicted
    stop that agrees with most of its labelled parts, the first on a tie; a predicted stop may serve several. status: unlabeled (no
    gold), missing (no prediction), normalized_match (all in full), partial_match, or wrong_value; issues name the parts that
    the best predicted stops lack (missing_) or have otherwise (wrong_), sorted, and missing_stop where none agrees in any part.
    """
    none = F.array().cast(f"array<{STOP}>")
    return F.arrow_udf(_compare, COMPARED)(F.coalesce(predicted, none), F.coalesce(gold, none))
