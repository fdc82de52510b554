"""Edge cases of the rules and functions on hand-made rows."""

import re
from datetime import date

from pyspark.sql import functions as F

from loadlark.functions import text as T
from loadlark.operators import decisions as D
from loadlark.operators import market as M
from loadlark.plans.rules import match_loads, with_reasons
from loadlark.sources.views import REQUEST_FIELDS, requests
from loadlark.streaming import events as S

LOAD = dict(load_id=1, rate=3000, loaded_miles=800, empty_miles=50, total_miles=850, total_rpm=3.53, bucket="700-1300", weight=40000, pickup="Dallas, TX", delivery="Chicago, IL", notes="", posted="Flatbed", broker_mc="1", broker_name="b", reference_id="R1", pickup_date=date(2024, 1, 1))
DRIVER = dict(driver="d", equipment="Flatbed", max_weight=45000, max_empty=200, min_rpm=2.0, target="midwest", target_city="", location="Dallas, TX", can_tarp=None, tarp_size="", tracking_ok=True, hazmat=None, tanker=None, twic=None, us_citizen=None, green_card=None, work_permit=None, ramps=None, dunnage=None)


FIELDS = "load_id long, rate long, loaded_miles long, empty_miles long, total_miles long, total_rpm double, bucket string, weight long, pickup string, delivery string, notes string, posted string, broker_mc string, broker_name string, reference_id string, pickup_date date"


def matched(spark, load=None, driver=None):
    loads = spark.createDataFrame([tuple((LOAD | (load or {})).values())], FIELDS + "".join(f", {c} string" for c in (load or {}) if c not in LOAD))
    return with_reasons(match_loads(loads, spark.createDataFrame([tuple((DRIVER | (driver or {})).values())], REQUEST_FIELDS)))


def status(spark, load=None, driver=None):
    row = matched(spark, load, driver).first()
    return row.status, row.reasons


def test_clean_match(spark):
    assert status(spark) == ("MATCH", ["TARGET_REGION"])


CASES = [
    # load, driver, status, reasons
    ({"notes": "hazmat load"}, {}, "REVIEW_ONCE", ["HAZMAT"]),
    ({"notes": "HAZMAT LOAD"}, {"hazmat": False}, "BLOCK", ["HAZMAT"]),
    ({"notes": "Haz-Mat"}, {"hazmat": True}, "MATCH", ["HAZMAT", "TARGET_REGION"]),
    ({"commodity": "HAZARDOUS waste"}, {"hazmat": False}, "BLOCK", ["HAZMAT"]),
    ({"notes": "Tanker Endoresment"}, {"tanker": False}, "BLOCK", ["TANKER"]),
    ({"notes": "TWIC"}, {"twic": False}, "BLOCK", ["TWIC"]),
    ({"notes": "U.S. Citizen"}, {"us_citizen": False, "green_card": True}, "MATCH", ["LEGAL_STATUS", "TARGET_REGION"]),
    ({"notes": "work permit"}, {"us_citizen": False, "green_card": None}, "REVIEW_ONCE", ["LEGAL_STATUS"]),
    ({"notes": "green-card"}, {"us_citizen": False, "green_card": False, "work_permit": False}, "BLOCK", ["LEGAL_STATUS"]),
    ({"notes": "Need Ramps and DUNNAGE"}, {"ramps": False, "dunnage": False}, "BLOCK", ["RAMPS", "DUNNAGE"]),
    ({"notes": None}, {"equipment": "Conestoga"}, "REVIEW_ONCE", ["POSTED_FLATBED"]),
    ({"notes": None, "posted": None}, {"equipment": "Conestoga"}, "MATCH", ["TARGET_REGION"]),
    ({"posted": "FD"}, {"equipment": "Conestoga"}, "REVIEW_ONCE", ["POSTED_FLATBED"]),
    ({"posted": "FDX"}, {"equipment": "Conestoga"}, "MATCH", ["TARGET_REGION"]),
    ({"notes": "FLATBED PREFERRED"}, {"equipment": "Conestoga"}, "REVIEW_ONCE", ["CONESTOGA"]),
    ({"notes": "Flatbed Only"}, {"equipment": "53 ft Conestoga"}, "BLOCK", ["CONESTOGA"]),
    ({"delivery": None}, {}, "BLOCK", ["TARGET_REGION"]),
    ({"delivery": "Miami, FL"}, {}, "BLOCK", ["TARGET_REGION"]),
    ({"delivery": "Miami, FL", "total_rpm": 4.5}, {}, "REVIEW_ONCE", ["OFF_TARGET"]),
    ({"delivery": "Atlanta, GA"}, {}, "REVIEW_ONCE", ["ALONG_ROUTE"]),
    ({"delivery": "Miami, FL"}, {"target_city": "MIAMI"}, "MATCH", ["TARGET_CITY"]),
    ({"delivery": "Houston, TX"}, {"target": " TX "}, "MATCH", ["TARGET_REGION"]),
    ({"delivery": "Boston, MA"}, {"target": "North East"}, "MATCH", ["TARGET_REGION"]),
    ({"delivery": "Atlanta, GA"}, {"target": "south east"}, "MATCH", ["TARGET_REGION"]),
    ({"delivery": "Chicago il"}, {}, "MATCH", ["TARGET_REGION"]),
    ({"delivery": "Chicago"}, {}, "BLOCK", ["TARGET_REGION"]),
    ({}, {"location": ""}, "MATCH", ["TARGET_REGION"]),
    ({}, {"location": None}, "MATCH", ["TARGET_REGION"]),
    ({"pickup": ""}, {}, "MATCH", ["TARGET_REGION"]),
    ({}, {"location": "Reno, NV"}, "BLOCK", ["PICKUP_FAR"]),
    ({"empty_miles": 251}, {"location": "Reno, NV", "max_empty": 300}, "MATCH", ["TARGET_REGION"]),
    ({}, {"location": "Tulsa, OK"}, "BLOCK", ["PICKUP_FAR"]),
    ({"pickup": "Tulsa, OK"}, {}, "MATCH", ["TARGET_REGION"]),
    ({"empty_miles": 201}, {"max_empty": 0}, "REVIEW_ONCE", ["EMPTY_MILES"]),
    ({"empty_miles": 201}, {"max_empty": None}, "REVIEW_ONCE", ["EMPTY_MILES"]),
    ({"empty_miles": 200}, {"max_empty": 0}, "MATCH", ["TARGET_REGION"]),
    ({"weight": 45001}, {}, "REVIEW_ONCE", ["WEIGHT"]),
    ({"weight": 45001, "posted": "Van"}, {"equipment": "conestoga"}, "BLOCK", ["WEIGHT"]),
    ({"weight": 45001}, {"max_weight": 0}, "MATCH", ["TARGET_REGION"]),
    ({"notes": "OVERSIZE"}, {}, "REVIEW_ONCE", ["OD_PERMIT"]),
    ({"notes": "Permit Required", "posted": "Van"}, {"equipment": "Conestoga"}, "BLOCK", ["OD_PERMIT"]),
    ({"notes": "Cash or Zelle; quickpay"}, {}, "BLOCK", ["CASH_PAYMENT"]),
    ({"notes": "QuickPay"}, {}, "REVIEW_ONCE", ["QUICKPAY"]),
    ({"rate": 0}, {}, "REVIEW_ONCE", ["RATE_MISSING"]),
    ({"rate": None, "total_rpm": None}, {}, "REVIEW_ONCE", ["RATE_MISSING"]),
    ({"total_rpm": 1.5}, {}, "MATCH", ["LOW_RPM", "TARGET_REGION"]),
    ({"loaded_miles": 10}, {}, "BLOCK", ["LOCAL_MILES"]),
    ({"loaded_miles": 11}, {}, "MATCH", ["TARGET_REGION"]),
    ({"pickup": " chicago, il "}, {"location": "Chicago, IL"}, "BLOCK", ["SAME_CITY"]),
    ({"notes": "8ft Tarps"}, {"can_tarp": True, "tarp_size": "4 ft"}, "REVIEW_ONCE", ["TARPS"]),
    ({"notes": "8ft Tarps"}, {"can_tarp": True, "tarp_size": ""}, "MATCH", ["TARPS", "TARGET_REGION"]),
    ({"notes": "tarp req"}, {"can_tarp": False}, "BLOCK", ["TARPS"]),
    ({"notes": "MUST TARP"}, {}, "REVIEW_ONCE", ["TARPS"]),
    ({"notes": "tarping required", "posted": "Van"}, {"equipment": "Conestoga", "can_tarp": False}, "MATCH", ["TARPS", "TARGET_REGION"]),
    ({"notes": "No tarps required"}, {"can_tarp": False}, "MATCH", ["TARGET_REGION"]),
    ({"notes": "MacroPoint"}, {"tracking_ok": False}, "BLOCK", ["TRACKING"]),
    ({"notes": "Tracking Required"}, {"tracking_ok": None}, "BLOCK", ["TRACKING"]),
    ({"notes": "macro point"}, {}, "MATCH", ["TRACKING", "TARGET_REGION"]),
    ({"broker_memory": "WATCHLIST"}, {}, "REVIEW_ONCE", ["BROKER_WATCH"]),
    ({"broker_memory": "BAD_BROKER_REVIEW"}, {}, "REVIEW_ONCE", ["BROKER_BAD"]),
    ({"broker_memory": "GOOD"}, {}, "MATCH", ["TARGET_REGION", "BROKER_GOOD"]),
    ({"broker_memory": "WATCHLIST", "broker_mc": "no mc"}, {}, "MATCH", ["TARGET_REGION"]),
]


def test_each_rule_on_hand_made_rows(spark):
    """All cases in one job: rows and drivers are numbered, and only equal numbers meet."""
    loads = spark.createDataFrame([tuple((LOAD | {"commodity": None, "broker_memory": None} | load | {"load_id": i}).values()) for i, (load, *_) in enumerate(CASES)], FIELDS + ", commodity string, broker_memory string")
    drivers = spark.createDataFrame([tuple((DRIVER | driver | {"driver": str(i)}).values()) for i, (_, driver, *_) in enumerate(CASES)], REQUEST_FIELDS)
    got = {r.load_id: (r.status, r.reasons) for r in with_reasons(match_loads(loads, drivers)).where("driver = cast(load_id as string)").collect()}
    wrong = [(CASES[i], got[i]) for i in range(len(CASES)) if got[i] != CASES[i][2:]]
    assert not wrong


def test_scores_priorities_and_categories(spark):
    row = D.with_priority(D.review_category(matched(spark, {"delivery_zone": "good reload"}))).first()
    assert (row.score, row.priority, row.suggested_action) == (18 + 25 + 15 + 20 + 5, "MEDIUM", "CALL IF AVAILABLE")
    assert row.opportunity_reason == "Good gross, Good RPM, Low empty miles, Matches driver target, Good reload area"
    kind = lambda load, driver=None: D.review_category(matched(spark, load, driver)).first().review_category
    assert kind({"rate": 0, "notes": "oversize"}) == "RATE CHECK" and kind({"notes": "oversize hazmat"}) == "OD / PERMIT"
    assert kind({"broker_memory": "WATCHLIST"}) == "BROKER REVIEW" and kind({"notes": "ISO Tanks"}) == "DOCUMENTS REQUIRED"
    assert kind({"notes": "ramps required"}) == "DOCUMENTS REQUIRED" and kind({"notes": "ramps required"}, {"ramps": True}) == "GENERAL REVIEW"
    assert kind({"weight": 99999, "notes": "must tarp"}) == "WEIGHT CHECK" and kind({"notes": "must tarp"}) == "TARPS REQUIRED"


def test_no_generated_method_is_too_large_to_compile(spark, sf_dir, capsys):
    """The JVM does not compile methods of over 8000 bytes; a match query with all its columns has none."""
    from loadlark.sources.views import loads

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it will run
    try:
        with_reasons(match_loads(loads(spark, sf_dir), requests(spark))).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    print(sizes)
    assert sizes and max(sizes) < 8000


def test_no_contact_hits_the_bare_conestoga_term(spark):
    assert status(spark, {"notes": "no contact after 5"}, {"equipment": "Conestoga"})[0] == "BLOCK"


def test_bucket_edges(spark):
    rows = spark.createDataFrame([(400, 1), (449, 1), (450, 1), (700, 1), (1300, 1), (0, 500)], "l int, t int")
    got = [tuple(r) for r in rows.select(T.mileage_bucket(F.col("l"), F.col("t")), T.baseline_bucket(F.col("l"), F.col("t"))).collect()]
    assert got == [("0-450", "0-400"), ("0-450", "400-700"), ("450-700", "400-700"), ("700-1300", "400-700"), ("1300+", "700-1300"), ("450-700", "400-700")]


def test_text_functions(spark):
    rows = spark.createDataFrame([("$1,200",), ("45000 lbs",), ("call",), (None,)], "x string")
    assert [r[0] for r in rows.select(T.to_number(F.col("x"))).collect()] == [1200.0, 45000.0, 0.0, 0.0]
    places = spark.createDataFrame([("Dallas, TX",), ("Dallas tx",), ("Nowhere",), ("",), (None,)], "x string")
    assert [r[0] for r in places.select(T.location_state(F.col("x"))).collect()] == ["TX", "TX", "", "", ""]
    ids = spark.createDataFrame([("A1",), (" needs check ",), (None,)], "x string")
    assert [r[0] for r in ids.select(T.has_value(F.col("x"))).collect()] == [True, False, False]


def test_empty_tables(spark, sf_dir):
    from loadlark.sources.views import loads

    none = match_loads(loads(spark, sf_dir).limit(0), requests(spark))
    assert M.fit_stats(none, ["driver"]).count() == 0 and M.baseline(none, ["driver"]).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = S.watch_stream(stream).writeStream.format("memory").queryName("watch").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.user_id: (r.state, r.events) for r in spark.table("watch").collect()}
    assert got == {r.user_id: (r.state, r.events) for r in S.watch_states(events).collect()}
    query = S.tumbling(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, S.tumbling(events).collect()))
