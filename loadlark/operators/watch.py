"""Reload watches: what each event does to a watch, and who is told."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States that end a watch, the events that stop it (state, reason), and those that are told at once while it goes on.
TERMINAL = ["WATCH_STOPPED", "DRIVER_LOADED", "PARENT_LOAD_REMOVED"]
STOPS = {
    "DRIVER_LOADED": ("DRIVER_LOADED", "Driver is loaded; reload watch should stop."),
    "STOP_SEARCH": ("WATCH_STOPPED", "Dispatcher stopped search; reload watch should stop."),
    "WATCH_STOPPED": ("WATCH_STOPPED", "Reload watch was stopped."),
    "PARENT_LOAD_REMOVED": ("PARENT_LOAD_REMOVED", "Parent load was removed; notify dispatcher and stop reload watch."),
}
CRITICAL = {
    "PARENT_LOAD_UPDATED": "Parent load changed; notify dispatcher and continue watching.",
    "CLEAN_EXIT_FOUND": "Clean exit appeared; notify dispatcher and continue watching.",
    "STRONG_CHAIN_FOUND": "Strong two-load chain appeared; notify dispatcher and continue watching.",
}
CLOSED, MUTED, DUE, STILL_MUTED, GOES_ON = "Reload watch is already stopped or closed.", "Normal reload-watch updates are muted.", "Normal reload-watch status is due.", "Normal reload-watch status is muted.", "Reload watch remains active."
EVENTS = ["PARENT_LOAD_ACTIVE", "NORMAL_STATUS_DUE", "MUTE_WATCH_UPDATES", *STOPS, *CRITICAL]


def watch_decisions(rows: DataFrame, event: str = "event_type", status: str = "watch_status", muted: str = "mute_normal_updates") -> DataFrame:
    """Rows with `decision`: the watch's state after the event, continue_watch, stop_watch, send_normal_status, send_critical_alert,
    mute_normal_updates and the reason.

    Each row is judged on its own, in a batch or a stream. Case and outer blanks do not count; a missing event is
    PARENT_LOAD_ACTIVE, a missing state WATCH_ACTIVE, a missing mute no mute; events that are not known leave a watch as it is.
    """
    text = lambda c, default: F.upper(F.trim(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))))
    rows = rows.withColumns({"__event": text(event, EVENTS[0]), "__status": text(status, "WATCH_ACTIVE")})
    what, state = F.col("__event"), F.col("__status")
    closed, stops = state.isin(TERMINAL) & (what == EVENTS[0]), what.isin(list(STOPS))
    ends = closed | stops
    mute = ~ends & (F.coalesce(F.col(muted), F.lit(False)) | (state == "WATCH_MUTED") | (what == "MUTE_WATCH_UPDATES"))
    critical, due = what.isin(list(CRITICAL)), what == "NORMAL_STATUS_DUE"
    reasons = F.create_map(*(F.lit(x) for e, r in {**{e: r for e, (_, r) in STOPS.items()}, **CRITICAL, "MUTE_WATCH_UPDATES": MUTED}.items() for x in (e, r)))
    states = F.create_map(*(F.lit(x) for e, (s, _) in STOPS.items() for x in (e, s)))
    decision = {
        "watch_status": F.when(closed, state).when(stops, F.try_element_at(states, what)).when(critical, what).when(mute, "WATCH_MUTED").otherwise("WATCH_ACTIVE"),
        "continue_watch": ~ends, "stop_watch": ends, "send_normal_status": due & ~mute, "send_critical_alert": critical | (what == "PARENT_LOAD_REMOVED"), "mute_normal_updates": mute,
        "reason": F.when(closed, CLOSED).when(due, F.when(mute, STILL_MUTED).otherwise(DUE)).otherwise(F.coalesce(F.try_element_at(reasons, what), F.lit(GOES_ON))),
    }
    return rows.withColumn("decision", F.struct(*(c.alias(n) for n, c in decision.items()))).drop("__event", "__status")
