"""What notes and board rows say, on hand-written cases."""

import re

import pytest
from pyspark.sql import functions as F

from loadlark.functions import notes as N
from loadlark.operators import board as B

CASES = [
    ("need 8 ft tarps", {"requires_tarp": True, "tarp_size": "8 ft"}),
    ("6ft tarps required", {"requires_tarp": True, "tarp_size": "6 ft"}),
    ("8' tarps", {"requires_tarp": True, "tarp_size": "8 ft"}),
    ("8FT TARPS REQ", {"requires_tarp": True, "tarp_size": "8 ft"}),
    ("5FT", {"requires_tarp": False, "tarp_size": ""}),
    ("tarps", {"requires_tarp": False}),
    ("tarp not required", {"requires_tarp": False}),
    ("no tarping", {"requires_tarp": False}),
    ("need 6 straps", {"requires_straps": True, "strap_count": 6}),
    ("strap and go", {"requires_straps": True, "strap_count": 0}),
    ("58L x 111W x 7H", {"is_od": True, "dimensions": "58l x 111w x 7h", "length": "58", "width": "111", "height": "7"}),
    ("8 ft wide", {"is_od": False}),
    ("9 ft wide", {"is_od": True}),
    ("102 wide", {"is_od": False}),
    ("commodity is wood products", {"is_od": False, "dimensions": ""}),
    ("OD/permit", {"is_od": True}),
    ("Heavy haul", {"is_overweight": True}),
    ("conestoga won't work", {"no_conestoga": True, "conestoga_ok": False}),
    ("tarps/conestoga ok", {"conestoga_ok": True, "no_conestoga": False}),
    ("flatbed preferred", {"flatbed_preferred": True, "flatbed_required": False, "no_conestoga": False}),
    ("FD or SD", {"stepdeck_allowed": True}),
    ("no box trucks", {"no_box_truck": True}),
    ("Moffett", {"forklift_required": True}),
    ("ramps req", {"ramps_required": True}),
    ("Macro Point", {"tracking_required": True}),
    ("no tracking mentioned", {"tracking_required": False}),
    ("appt only", {"appointment_required": True, "detected_pickup_time": "Appointment required"}),
    ("straight thru", {"straight_through": True}),
    ("cash/zelle", {"cash_or_zelle": True, "quickpay_review": False}),
    ("quick pay available", {"quickpay_review": True, "cash_or_zelle": False}),
    ("haz mat", {"hazmat_required": True}),
    ("tanker endorsment", {"tanker_required": True}),
    ("TWIC card", {"twic_required": True}),
    ("U.S. citizen", {"document_required": True}),
    ("isotanks", {"iso_tank_required": True}),
    ("weight 45 k lbs", {"detected_weight": 45000}),
    ("weight 45,000 lbs", {"detected_weight": 45000}),
    ("150k or 48,000 lb", {"detected_weight": 48000}),
    ("verify weight", {"weight_unknown": True, "detected_weight": 0}),
    ("2P/1D", {"detected_stops": 3}),
    ("1 pickup 2 drops", {"detected_stops": 3}),
    ("3 drops", {"detected_stops": 4}),
    ("multistop load", {"detected_stops": 2}),
    ("multiple loads available", {"detected_stops": 0, "multiple_loads_available": True}),
    ("FCFS 8am-2pm", {"detected_pickup_time": "FCFS 8AM-2PM"}),
    ("fcfs", {"detected_pickup_time": "FCFS - NEEDS HOURS CHECK"}),
    ("pickup 0800-1400", {"detected_pickup_time": "0800-1400"}),
    ("call 443-2707", {"detected_pickup_time": "", "phone": ""}),
    ("ready now", {"detected_pickup_time": "Ready now"}),
    ("Actual pickup in Gary, in", {"actual_pickup_city": "Gary, IN"}),
    ("actual PU - Fort Worth (TX)", {"actual_pickup_city": "Fort Worth, TX"}),
    ("pickup in Dallas, TX", {"actual_pickup_city": ""}),
    ("additional pu", {"extra_pickup": True}),
    ("need solid drivers", {"dedicated_lane": True}),
    ("no double brokering", {"double_brokering_language": True}),
    ("carrier name must match", {"mc_must_match": True}),
    ("call 555-111-2222 ext 45", {"phone": "555-111-2222", "extension": "45"}),
    ("email dispatch at example dot com", {"email": "dispatch@example.com"}),
    ("dispatch@example`com", {"email": "dispatch@example.com"}),
    ("dispatch (at) example (dot) com", {"email": "dispatch@example.com"}),
    ("broker@example", {"email": ""}),
    (None, {"summary": [], "phone": "", "requires_tarp": False, "detected_weight": 0}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i long, notes string")
    return {r.i: r.parsed.asDict() for r in N.parse_notes(rows, commodity=None, posted=None, posted_weight=None).collect()}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[str(t) for t, _ in CASES])
def test_notes_say(i, parsed):
    for name, value in CASES[i][1].items():
        assert parsed[i][name] == value, name


def test_summary_and_posted_weight(spark):
    row = spark.createDataFrame([("8 ft tarps req, 6 straps, permit load", None, "ISO tank", "1")], "notes string, commodity string, posted string, weight string")
    assert N.parse_notes(row).first().parsed.summary == ["8 ft tarps detected", "6 straps required", "OD / permit / wide load detected", "ISO tank document/review warning detected", "posted weight may be incorrect / must verify real weight"]


def test_contacts_in_text(spark):
    row = spark.createDataFrame([("Joe at GMIAL dot com, (555)111-2222 or 555 111 2222 x 9, joe@gmail.com; a@b.org",), (None,)], "text string")
    first, none = row.select(N.emails(F.col("text")).alias("e"), N.phones(F.col("text")).alias("p"), N.extensions(F.col("text")).alias("x"), N.contact_summary(N.phones(F.col("text")), N.extensions(F.col("text")), N.emails(F.col("text"))).alias("c")).collect()
    assert first.e == ["joe@gmail.com", "a@b.org"] and first.p == ["(555) 111-2222"] and first.x == ["9"]
    assert first.c == "(555) 111-2222 ext 9 / joe@gmail.com / a@b.org"
    assert none.e is None and none.c is None


def test_board_rows(spark):
    notes = "Acme Freight | MC# 445566 | Contact: (555) 111-2222 | Reference ID: AB-12 | Credit Score: 91 | Days to Pay: 27 | 44k, 2P/1D"
    rows = spark.createDataFrame([("Dallas, TX", "$1,250.75", " ", "0", notes, None), (None, "call", "UNKNOWN", "45,000 lbs", None, "yes")], "origin string, posted_rate string, factoring_status string, weight string, comments string, is_od string")
    a, b = B.normalize_rows(rows).collect()
    assert (a.pickup, a.rate, a.weight, a.stops, a.broker_name, a.broker_mc, a.reference_id, a.credit_score, a.days_to_pay) == ("Dallas, TX", 1250, 44000, 3, "Acme Freight", "445566", "AB-12", 91, 27)
    assert a.broker_contact == "(555) 111-2222" and a.has_phone and not a.has_email and a.posted_trailer_type == "Conestoga"
    assert a.notes.startswith(notes + " | Parsed notes: ") and a.broker_status == "UNKNOWN"
    assert (b.pickup, b.rate, b.weight, b.stops, b.broker_name, b.notes, b.is_od, b.broker_status) == ("", 0, 45000, 2, "", "", True, "UNKNOWN")


def test_board_rows_by_other_headers(spark):
    """Aliases in second place, statuses that say nothing, given stops, and a row without any header of ours."""
    rows = spark.createDataFrame(
        [("", "Reno, NV", "n/a", "3", "900", "no buy today"), ("Gary, IN", "Reno, NV", "", "3", "900", "2P/2D, factoring eligible"), ("Gary, IN", "", "Approved", "x", None, "No Buy")],
        "pickup string, origin string, brokerStatus string, stops string, miles string, load_comments string",
    )
    a, b, c = B.normalize_rows(rows).collect()
    assert (a.pickup, a.broker_status, a.stops, a.loaded_miles) == ("Reno, NV", "NO_BUY", 3, 900)
    assert (b.pickup, b.broker_status, b.stops) == ("Gary, IN", "UNKNOWN", 4)
    assert (c.pickup, c.broker_status, c.stops, c.loaded_miles) == ("Gary, IN", "Approved", 2, 0)
    other = B.normalize_rows(spark.createDataFrame([("x", 1)], "colour string, n long")).first()
    assert (other.pickup, other.rate, other.stops, other.posted_trailer_type, other.broker_status, other.notes) == ("", 0, 2, "Conestoga", "UNKNOWN", "")


def test_texts_are_read_once_and_rows_kept(spark):
    """Repeated texts meet one reading each; rows, their repeats and their null texts all stay."""
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "need 8 ft tarps" if i % 3 == 1 else "twic", 1 if i % 2 else 5) for i in range(30)] * 2, "i long, notes string, weight long")
    out = N.parse_notes(rows, commodity=None, posted=None).select("i", "parsed.tarp_size", "parsed.twic_required", "parsed.weight_unknown").collect()
    assert sorted(tuple(r) for r in out) == sorted(2 * [(i, "8 ft" if i % 3 == 1 else "", i % 3 == 2, i % 2 == 1) for i in range(30)])


@pytest.mark.parametrize("name", ["notes_parsed", "notes_flags", "board_loads"])
def test_no_generated_method_is_too_large_to_compile(name, spark, sf_dir, capsys):
    from loadlark.queries import QUERIES

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it will run
    try:
        QUERIES[name](spark, sf_dir).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
