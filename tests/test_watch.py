"""Watch decisions and priorities on hand-written cases."""

import pytest

from loadlark.operators.decisions import with_priority
from loadlark.operators.watch import watch_decisions

CASES = [
    # state, muted, event; state after, stops, normal status, critical alert, muted after
    (None, None, None, "WATCH_ACTIVE", False, False, False, False),
    ("watch_active", False, " normal_status_due ", "WATCH_ACTIVE", False, True, False, False),
    ("WATCH_MUTED", False, "NORMAL_STATUS_DUE", "WATCH_MUTED", False, False, False, True),
    ("WATCH_ACTIVE", True, "CLEAN_EXIT_FOUND", "CLEAN_EXIT_FOUND", False, False, True, True),
    ("WATCH_ACTIVE", False, "MUTE_WATCH_UPDATES", "WATCH_MUTED", False, False, False, True),
    ("WATCH_MUTED", True, "DRIVER_LOADED", "DRIVER_LOADED", True, False, False, False),
    ("WATCH_ACTIVE", False, "STOP_SEARCH", "WATCH_STOPPED", True, False, False, False),
    ("WATCH_ACTIVE", False, "PARENT_LOAD_REMOVED", "PARENT_LOAD_REMOVED", True, False, True, False),
    ("DRIVER_LOADED", True, "PARENT_LOAD_ACTIVE", "DRIVER_LOADED", True, False, False, False),
    ("DRIVER_LOADED", False, "STRONG_CHAIN_FOUND", "STRONG_CHAIN_FOUND", False, False, True, False),
    ("WATCH_ACTIVE", False, "SOMETHING_ELSE", "WATCH_ACTIVE", False, False, False, False),
]


def test_watch_decisions(spark):
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i long, watch_status string, mute_normal_updates boolean, event_type string")
    for r in watch_decisions(rows).collect():
        d = r.decision
        assert (d.watch_status, d.stop_watch, d.send_normal_status, d.send_critical_alert, d.mute_normal_updates) == CASES[r.i][3:], CASES[r.i]
        assert d.continue_watch is not d.stop_watch and d.reason


@pytest.mark.parametrize(
    "row, wanted",
    [
        ((5000, 4.0, 50, "MATCH", 95), ("HIGH", "CALL NOW + EMAIL BACKUP", "Strong gross, Excellent RPM, Low empty miles, Matches driver target")),
        ((3000, 3.0, 150, "MATCH", 84), ("MEDIUM", "CALL IF AVAILABLE", "Good gross, Good RPM, Acceptable empty miles, Matches driver target")),
        ((2999, 2.9, 151, "REVIEW_ONCE", 90), ("HIGH", "REVIEW ONCE", "Needs dispatcher review")),
        ((0, 0.0, 500, "BLOCK", 0), ("BLOCK", "DO NOT SEND", "Potential opportunity based on current filters")),
        ((None, None, None, "MATCH", 74), ("LOW", "MONITOR", "Matches driver target")),
    ],
)
def test_priorities(spark, row, wanted):
    df = spark.createDataFrame([row], "rate long, total_rpm double, empty_miles long, status string, score long")
    assert with_priority(df).select("priority", "suggested_action", "opportunity_reason").first() == wanted
