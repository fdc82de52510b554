"""Event streams: windows with watermarks, a change-data fold and the reload-watch state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# What an event does to a watch.
WATCH_STEPS = {"signup": "WATCHING", "click": "WATCHING", "view": "MUTED", "purchase": "BOOKED", "error": "ATTENTION"}
TERMINAL = ["BOOKED"]


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums of each type and window; the same plan for a batch and for a stream with a watermark."""
    # a watermark needs instants, so a stream's wall-clock times are read in the session's zone
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("total_cents")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total_cents")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select("user_id", F.col("s.start").alias("start"), "last_ts", "n")


def fold_changes(events: DataFrame) -> DataFrame:
    """The board after all changes: signup puts a load, click and view update it while it is there, purchase removes it; error is ignored.

    For each key the last put counts; updates between it and a removal hold, each attribute by its last value.
    """
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    state = F.when(F.col("event_type") == "signup", F.col("event_id")).when(F.col("event_type") == "purchase", F.lit(-1))
    rows = events.withColumn("put", F.last(state, ignorenulls=True).over(upto)).withColumn("last_put", F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    live = rows.where("last_put > 0 AND put = last_put AND event_type <> 'error'")
    return live.groupBy("user_id").agg(F.max("put").alias("put_id"), F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_change"), F.count(F.lit(1)).alias("changes"))


def watch_states(events: DataFrame) -> DataFrame:
    """State of each watch after its events in order: terminal states stay, a muted watch wakes up only for attention.

    The fold needs no list of events: a booking ends it whenever it comes; else the last mute or call for attention decides,
    and only the latter gives way to a later watch. So each watch is a handful of partial aggregates.
    """
    step = F.create_map(*(F.lit(x) for p in WATCH_STEPS.items() for x in p))
    rows = events.select("user_id", step[F.col("event_type")].alias("to"), F.struct("ts", "event_id").alias("at"))
    firm = F.when(F.col("to").isin("MUTED", "ATTENTION"), F.col("at"))
    last = rows.groupBy("user_id").agg(F.bool_or(F.col("to").isin(TERMINAL)).alias("ended"), F.max_by("to", firm).alias("firm"), F.max(firm).alias("firm_at"), F.max(F.when(F.col("to") == "WATCHING", F.col("at"))).alias("watch_at"), F.count(F.lit(1)).alias("events"))
    wakes = F.col("firm").isNull() | ((F.col("firm") == "ATTENTION") & (F.col("watch_at") > F.col("firm_at")))
    return last.select("user_id", F.when(F.col("ended"), "BOOKED").when(wakes, "WATCHING").otherwise(F.col("firm")).alias("state"), "events")


def watch_stream(events: DataFrame) -> DataFrame:
    """The same state machine over a stream, with one state for each watch."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, n = state.get if state.exists else ("NEW", 0)
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            to = WATCH_STEPS[row.event_type]
            name = name if name in TERMINAL or (name == "MUTED" and to == "WATCHING") else to
            n += 1
        state.update((name, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [name], "events": [n]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, state string, events long", "state string, events long", "update", GroupStateTimeout.NoTimeout)
