"""Column functions on loads, locations and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing identifier.
NO_VALUE = ["", "-", "n/a", "na", "needs check", "no id", "none", "null", "unknown"]


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is worked out once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def to_number(text: Column) -> Column:
    """Digits of a posted amount, weight or distance; what can't be read is 0."""
    bare = F.trim(F.regexp_replace(text, r"[$,]|lbs|lb|mi", ""))
    return F.coalesce(F.nullif(bare, F.lit("")).try_cast("double"), F.lit(0.0))


def to_bool(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes", "y", "book", "bookable"), F.lit(False))


def has_value(text: Column) -> Column:
    """Whether an identifier is given and is no placeholder."""
    return F.coalesce(~F.lower(F.trim(text)).isin(NO_VALUE), F.lit(False))


def location_state(location: Column) -> Column:
    """Two letters after the last comma, else the last word of two letters, else empty."""
    text = F.trim(F.coalesce(location, F.lit("")))
    after = F.upper(F.trim(F.element_at(F.split(text, ","), -1)))
    word = F.upper(F.element_at(F.split(text, r"\s+"), -1))
    return F.when(F.contains(text, F.lit(",")) & (F.length(after) == 2), after).when(F.length(word) == 2, word).otherwise("")


def rate_per_mile(rate: Column, miles: Column) -> Column:
    """Cents per mile, rounded half up with whole numbers, as dollars; 0 without miles."""
    cents = F.floor((rate * 200 + miles) / F.when(miles != 0, miles * 2))
    return F.coalesce(cents.cast("double") / 100, F.lit(0.0))


def mileage_bucket(loaded: Column, total: Column) -> Column:
    """Buckets of the snapshot: under 450, 700, 1300, and above, of the loaded or else the total miles."""
    miles = F.when(loaded != 0, loaded).otherwise(total)
    return F.when(miles < 450, "0-450").when(miles < 700, "450-700").when(miles < 1300, "700-1300").otherwise("1300+")


def baseline_bucket(loaded: Column, total: Column) -> Column:
    """Buckets of the baseline: up to 400, 700, 1300, and above."""
    miles = F.when(loaded > 0, loaded).otherwise(total)
    return F.when(miles <= 400, "0-400").when(miles <= 700, "400-700").when(miles <= 1300, "700-1300").otherwise("1300+")


def lane_key(pickup: Column, delivery: Column) -> Column:
    return F.concat(pickup, F.lit(" -> "), delivery)


def broker_key(name: Column, mc: Column) -> Column:
    return F.regexp_replace(F.concat(F.coalesce(name, F.lit("")), F.lit("|"), F.coalesce(mc, F.lit(""))), r"^\|+|\|+$", "")


def equipment_view(posted: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(posted, F.lit(""))))
    return F.when(F.contains(text, F.lit("stoga")), "conestoga").when(F.contains(text, F.lit("flatbed")) | (text == "flat"), "flatbed").otherwise("other")


def ordered_distinct(*parts: Column) -> Column:
    """The texts that are given, each once, in their order."""
    return F.array_distinct(F.array_compact(F.array(*parts)))
