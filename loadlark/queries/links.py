"""Queries over identifiers, links, intakes, commands and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions as D
from ..operators import links as L
from ..operators import market as M
from ..plans.rules import MATCHES_SQL
from ..sources.views import CASES_SQL, FEEDBACK_SQL, LOADS_SQL, REQUESTS_SQL, cases, feedback, loads
from .market import BASELINE_SQL, ZONES_SQL, first_matches, matches

# Derived records, in expressions that Spark and DuckDB both read.
IDENTITY = ["load_id", "CASE WHEN reference_id = 'needs check' THEN 'NO ID' ELSE reference_id END AS reference_id", "'driver' || (load_id % 40) AS driver", "CASE WHEN load_id % 3 = 0 THEN '' ELSE broker_mc END AS broker_mc", "pickup", "delivery", "rate", "loaded_miles", "weight", "notes", "CAST(pickup_date AS STRING) AS day"]
OUTBOX = ["load_id", "CASE WHEN reference_id = 'needs check' THEN 'NO ID' ELSE reference_id END AS reference_id", "'driver' || (load_id % 40) AS driver", "pickup", "delivery", "CASE WHEN load_id % 3 = 0 THEN '' ELSE CAST(load_id % 97 AS STRING) END AS broker_mc"]
OUTBOX_CASES = ["case_id", "'REF' || case_id AS reference_id", "driver", "pickup", "delivery", "CASE WHEN case_id % 5 = 0 THEN '' ELSE broker_mc END AS broker_mc"]
ANSWERS = ["feedback_id", "CASE feedback_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'REF' || case_number ELSE 'L' || case_number END AS load_id", "CASE WHEN feedback_id % 5 = 0 THEN 'L' || case_number WHEN feedback_id % 5 < 3 THEN 'REF' || case_number ELSE '' END AS reference_id", "CASE WHEN feedback_id % 3 = 0 THEN '' ELSE driver END AS driver"]
ANSWER_CASES = ["case_id", "'L' || (case_id % 700) AS load_id", "'REF' || case_id AS reference_id", "CASE WHEN case_id % 6 = 0 THEN '' ELSE driver END AS driver"]
INTAKES = [
    "case_id AS i_id", "CASE WHEN case_id % 6 = 0 THEN '' WHEN case_id % 4 = 0 THEN 'REF' || (case_id + 1) ELSE 'REF' || case_id END AS i_reference_id",
    "CASE WHEN case_id % 5 = 0 OR case_id % 6 = 0 THEN '' ELSE 'L' || case_id END AS i_load_id", "CASE WHEN case_id % 7 = 0 THEN '' WHEN case_id % 11 = 0 THEN '0' ELSE broker_mc END AS i_broker_mc",
    "'Broker ' || broker_mc AS i_broker_name", "upper(pickup) AS i_pickup", "CASE WHEN case_id % 9 = 0 THEN pickup ELSE delivery END AS i_delivery",
    "CASE WHEN case_id % 19 = 0 THEN '' WHEN case_id % 3 = 0 THEN CAST(rate + 1 AS STRING) ELSE CAST(rate AS STRING) END AS i_rate", "case_id % 13 = 0 AS unsure",
]
INTAKE_CASES = ["case_id AS c_case_id", "'REF' || case_id AS c_reference_id", "'L' || case_id AS c_load_id", "broker_mc AS c_broker_mc", "'broker ' || broker_mc AS c_broker_name", "pickup AS c_pickup", "delivery AS c_delivery", "CAST(rate AS STRING) AS c_rate"]
EXPECTED = ["i_broker_name", "i_broker_mc", "i_rate", "i_pickup", "i_delivery", "i_reference_id"]
COMMANDS = ["feedback_id", "CASE feedback_id % 7 WHEN 0 THEN '/help' WHEN 1 THEN '/' || verb || ' REF' || case_number || '  left voice  mail' WHEN 2 THEN '/Feedback REF' || case_number || ' ' || upper(verb) || ' call back  later' WHEN 3 THEN '/booked@bot REF' || case_number WHEN 4 THEN '/feedback REF' || case_number WHEN 5 THEN 'hello there' ELSE ' /bad_broker ' END AS text"]
SHORT = {"/" + v: v for v in ("booked", "skipped", "called_broker", "sent_to_driver", "bad_broker")} | {"/called": "called_broker", "/sent": "sent_to_driver"}


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, case and event identifiers of each load."""
    rows = loads(spark, sf_dir).selectExpr(*IDENTITY)
    c = F.col
    rows = rows.withColumn("load_key", L.load_key(c("reference_id"), c("broker_mc"), c("pickup"), c("delivery"), c("rate"), c("loaded_miles"), c("weight"), c("notes")))
    rows = rows.withColumn("case_key", L.case_key(c("driver"), c("load_key"), c("reference_id"), c("broker_mc")))
    return rows.select("load_id", "load_key", "case_key", L.event_key(c("case_key"), F.lit("AI_DECISION_CREATED"), c("day"), c("load_key")).alias("event_key"))


def outbox_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_outbox(loads(spark, sf_dir).selectExpr(*OUTBOX), cases(spark, sf_dir).selectExpr(*OUTBOX_CASES)).select("load_id", "case_id")


def feedback_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.link_feedback(feedback(spark, sf_dir).selectExpr(*ANSWERS), cases(spark, sf_dir).selectExpr(*ANSWER_CASES), "feedback_id").select("feedback_id", "case_id")


def intake_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intakes against the case of their number; every seventeenth case is not there."""
    c = cases(spark, sf_dir)
    pairs = c.selectExpr(*INTAKES).join(c.where("case_id % 17 <> 0").selectExpr(*INTAKE_CASES), F.col("i_id") == F.col("c_case_id"), "left").withColumn("missing", L.missing_fields(["i_broker_mc", "i_rate"]))
    return L.intake_candidates(pairs).select("i_id", "match_score", F.array_join("match_reasons", ",").alias("matched"), F.array_join("mismatch_reasons", ",").alias("mismatched"), "action")


def intake_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields, fields to check and status of intakes: how many intakes have each."""
    rows = cases(spark, sf_dir).selectExpr(*INTAKES).withColumn("missing", L.missing_fields(EXPECTED))
    rows = rows.withColumn("check", L.needs_check([("i_broker_name", "i_broker_mc"), ("i_broker_mc", "i_broker_name"), ("i_load_id", "i_reference_id")], F.col("missing")))
    status = F.when(F.size("missing") > 0, "MISSING_FIELDS").when(F.size("check") > 0, "NEEDS_CHECK").otherwise("READY_FOR_REVIEW")
    return rows.groupBy(F.array_join("missing", ",").alias("missing"), F.array_join("check", ",").alias("needs_check"), status.alias("intake_status")).agg(F.count(F.lit(1)).alias("n"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_commands(feedback(spark, sf_dir).selectExpr(*COMMANDS), "text", SHORT).select("feedback_id", "command", "ref", "kind", "note")


def risk_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_risk_flags(matches(spark, sf_dir)).groupBy("driver", F.array_join("risk_flags", ",").alias("risk_flags")).agg(F.count(F.lit(1)).alias("n"))


def review_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review category, priority, suggested action and reason of every match: how many there are of each."""
    rows = D.with_priority(D.review_category(matches(spark, sf_dir)))
    return rows.groupBy("driver", "review_category", "priority", "suggested_action", "opportunity_reason").agg(F.count(F.lit(1)).alias("n"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).withColumns({"missing": F.array_compact(F.array(F.when(F.col("reference_id") == "needs check", F.lit("reference_id")))), "unsure": F.col("total_rpm") > 6, "conflict": F.lit(False)})
    return D.decide(rows).groupBy("driver", "decision", "action", "approval_required", "autonomous").agg(F.count(F.lit(1)).alias("n"))


def exit_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones, medians = M.zones_and_medians(first_matches(spark, sf_dir), ["driver"])
    judged = D.exit_markets(matches(spark, sf_dir).where("qualified"), zones, medians, "driver")
    return judged.groupBy("driver", "exit_status", "watch").agg(F.count(F.lit(1)).alias("n"), F.sum("rate").alias("total_rate"))


QUERIES = {f.__name__: f for f in (record_ids, outbox_links, feedback_links, intake_links, intake_gaps, commands, risk_flags, review_categories, decisions, exit_markets)}

_SAME = {f: f"CASE WHEN coalesce(i_{f}, '') <> '' AND coalesce(c_{f}, '') <> '' THEN lower(i_{f}) = lower(c_{f}) END" for f in ("reference_id", "load_id", "broker_mc", "broker_name", "pickup", "delivery", "rate")}
_LIST = lambda items: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in items) + "], lambda x: x IS NOT NULL), ',')"
_MISSING = _LIST([(f, f"coalesce({f}, '') = ''") for f in EXPECTED])
_ANY = lambda r: f"(list_contains(block_reasons, '{r}') OR list_contains(review_reasons, '{r}') OR list_contains(match_reasons, '{r}'))"
_FLAGS = [
    ("LOW_RPM", "list_contains(match_reasons, 'LOW_RPM')"), ("OVERWEIGHT", _ANY("WEIGHT")), ("PICKUP_TOO_FAR", _ANY("EMPTY_MILES")), ("LOCAL_LOAD", f"{_ANY('SAME_CITY')} OR {_ANY('LOCAL_MILES')}"),
    ("OD_PERMIT_LOAD", _ANY("OD_PERMIT")), ("RATE_MISSING", "coalesce(rate, 0) = 0"), ("RATE_CHECK_REQUIRED", "coalesce(rate, 0) = 0"), ("NO_CONESTOGA", "list_contains(block_reasons, 'CONESTOGA')"),
    ("CONESTOGA_VERIFY", "list_contains(review_reasons, 'CONESTOGA') OR list_contains(review_reasons, 'POSTED_FLATBED')"), ("TRACKING_REQUIRED", "list_contains(block_reasons, 'TRACKING')"),
    ("HAZMAT_REQUIRED", _ANY("HAZMAT")), ("TWIC_REQUIRED", _ANY("TWIC")), ("TANKER_REQUIRED", _ANY("TANKER")), ("RAMPS_REQUIRED", _ANY("RAMPS")), ("DUNNAGE_REQUIRED", _ANY("DUNNAGE")), ("LEGAL_STATUS_REQUIRED", _ANY("LEGAL_STATUS")),
    ("PAYMENT_RISK", f"{_ANY('CASH_PAYMENT')} OR {_ANY('QUICKPAY')}"), ("TARGET_DIRECTION_MISMATCH", "list_contains(review_reasons, 'OFF_TARGET')"),
]
MATCHED = f"WITH {LOADS_SQL}, {REQUESTS_SQL}, {MATCHES_SQL}"
ORACLES = {
    "record_ids": f"""WITH {LOADS_SQL}, r AS (SELECT {', '.join(IDENTITY)} FROM loads),
k AS (SELECT *, CASE WHEN reference_id <> 'NO ID' THEN CASE WHEN broker_mc <> '' THEN 'MC' || broker_mc || '-' ELSE '' END || 'REF' || reference_id ELSE 'LOAD-' || substr(sha1(concat_ws('|', coalesce(pickup, ''), coalesce(delivery, ''), rate, loaded_miles, weight, broker_mc, coalesce(substr(notes, 1, 300), ''))), 1, 12) END AS load_key FROM r),
c AS (SELECT *, 'CASE-' || substr(sha1(driver || CASE WHEN reference_id <> 'NO ID' THEN '|REF:' || reference_id ELSE '|LOAD:' || load_key END || '|MC:' || broker_mc), 1, 12) AS case_key FROM k)
SELECT load_id, load_key, case_key, 'EVT-' || substr(sha1(concat_ws('|', case_key, 'AI_DECISION_CREATED', day, load_key)), 1, 12) AS event_key FROM c""",
    "outbox_links": f"""WITH {LOADS_SQL}, {CASES_SQL}, o AS (SELECT row_number() OVER () AS r, {', '.join(OUTBOX)} FROM loads), c AS (SELECT {', '.join(OUTBOX_CASES)} FROM cases),
hits AS (SELECT r, c.case_id FROM o JOIN c ON o.reference_id = c.reference_id AND o.driver = c.driver WHERE o.reference_id <> 'NO ID'
  UNION ALL SELECT r, c.case_id FROM o JOIN c ON o.driver = c.driver AND o.pickup = c.pickup AND o.delivery = c.delivery WHERE o.broker_mc = '' OR c.broker_mc = '' OR o.broker_mc = c.broker_mc)
SELECT o.load_id, f.case_id FROM o LEFT JOIN (SELECT r, min(case_id) AS case_id FROM hits GROUP BY r) f USING (r)""",
    "feedback_links": f"""WITH {CASES_SQL}, {FEEDBACK_SQL}, a AS (SELECT {', '.join(ANSWERS)} FROM feedback), c AS (SELECT {', '.join(ANSWER_CASES)} FROM cases),
hits AS ({' UNION ALL '.join(f"SELECT feedback_id, case_id FROM a JOIN c ON a.{x} = c.{y} AND a.{x} <> '' WHERE a.driver = '' OR c.driver = '' OR a.driver = c.driver" for x in ('load_id', 'reference_id') for y in ('load_id', 'reference_id'))})
SELECT a.feedback_id, f.case_id FROM a LEFT JOIN (SELECT feedback_id, min(case_id) AS case_id FROM hits GROUP BY feedback_id) f USING (feedback_id)""",
    "intake_links": f"""WITH {CASES_SQL}, i AS (SELECT {', '.join(INTAKES)} FROM cases), c AS (SELECT {', '.join(INTAKE_CASES)} FROM cases WHERE case_id % 17 <> 0),
p AS (SELECT *, {', '.join(f'{e} AS ok_{f}' for f, e in _SAME.items())}, coalesce(i_broker_mc, '') = '' OR coalesce(i_rate, '') = '' AS gap, i_reference_id = '' AND i_load_id = '' AS nameless FROM i LEFT JOIN c ON i_id = c_case_id),
q AS (SELECT *, CASE WHEN ok_pickup AND ok_delivery THEN true WHEN NOT coalesce(ok_pickup, true) OR NOT coalesce(ok_delivery, true) THEN false END AS ok_lane FROM p),
s AS (SELECT *, least(100, {' + '.join(f'CASE WHEN ok_{f} THEN {n} ELSE 0 END' for f, n in L.EVIDENCE.items())}) AS match_score, {_LIST([(f + '_match', 'ok_' + f) for f in L.EVIDENCE])} AS matched,
  {_LIST([*((f + '_mismatch', 'NOT ok_' + f) for f in L.EVIDENCE), ('missing_identity_evidence', 'nameless')])} AS mismatched FROM q)
SELECT i_id, match_score, matched, mismatched, CASE WHEN gap OR unsure THEN 'NEEDS_REVIEW' WHEN c_case_id IS NULL AND nameless THEN 'KEEP_UNLINKED' WHEN mismatched <> '' THEN 'NEEDS_REVIEW'
  WHEN (coalesce(ok_reference_id, false) OR coalesce(ok_load_id, false)) AND (coalesce(ok_broker_mc, false) OR coalesce(ok_broker_name, false) OR coalesce(ok_lane, false)) THEN 'LINK_EXISTING' WHEN c_case_id IS NOT NULL THEN 'KEEP_UNLINKED' ELSE 'CREATE_CASE_REVIEW' END AS action FROM s""",
    "intake_gaps": f"""WITH {CASES_SQL}, i AS (SELECT {', '.join(INTAKES)} FROM cases), g AS (SELECT {_MISSING} AS missing, {_LIST([('i_broker_mc', "i_broker_name <> '' AND i_broker_mc = ''"), ('i_broker_name', "i_broker_mc <> '' AND i_broker_name = ''"), ('i_reference_id', "i_load_id <> '' AND i_reference_id = ''")])} AS needs_check FROM i)
SELECT missing, needs_check, CASE WHEN missing <> '' THEN 'MISSING_FIELDS' WHEN needs_check <> '' THEN 'NEEDS_CHECK' ELSE 'READY_FOR_REVIEW' END AS intake_status, count(*) AS n FROM g GROUP BY ALL""",
    "commands": f"""WITH {FEEDBACK_SQL}, t AS (SELECT {', '.join(COMMANDS)} FROM feedback), w AS (SELECT feedback_id, split_part(lower(regexp_extract(trim(text), '^(\\S+)', 1)), '@', 1) AS v, regexp_extract(trim(text), '^\\S+\\s+(\\S+)', 1) AS a, regexp_extract(trim(text), '^\\S+\\s+\\S+\\s+(\\S+)', 1) AS b, regexp_extract(trim(text), '^\\S+\\s+\\S+\\s+\\S+\\s+(.*)$', 1) AS c FROM t),
k AS (SELECT *, CASE v {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in SHORT.items())} END AS s FROM w),
d AS (SELECT *, CASE WHEN v = '' THEN NULL WHEN v = '/help' THEN 'help' WHEN v = '/feedback' THEN CASE WHEN b = '' THEN 'invalid' ELSE 'feedback' END WHEN s IS NOT NULL THEN CASE WHEN a = '' THEN 'invalid' ELSE 'feedback' END ELSE 'unknown' END AS command FROM k)
SELECT feedback_id, command, CASE WHEN command = 'feedback' THEN a END AS ref, CASE WHEN command = 'feedback' THEN CASE WHEN v = '/feedback' THEN lower(b) ELSE s END END AS kind, CASE WHEN command = 'feedback' THEN CASE WHEN v = '/feedback' THEN trim(c) ELSE trim(b || ' ' || trim(c)) END END AS note FROM d""",
    "risk_flags": f"{MATCHED} SELECT driver, {_LIST(_FLAGS)} AS risk_flags, count(*) AS n FROM matches GROUP BY ALL",
    "review_categories": f"""{MATCHED} SELECT driver, CASE WHEN coalesce(rate, 0) = 0 THEN 'RATE CHECK' WHEN {_ANY('OD_PERMIT')} THEN 'OD / PERMIT' WHEN list_contains(review_reasons, 'CONESTOGA') OR list_contains(review_reasons, 'POSTED_FLATBED') THEN 'CONESTOGA VERIFY'
  WHEN list_contains(review_reasons, 'ALONG_ROUTE') THEN 'ALONG ROUTE' WHEN {' OR '.join(_ANY(d) for d in ('HAZMAT', 'TANKER', 'TWIC', 'LEGAL_STATUS', 'DUNNAGE'))} OR list_contains(block_reasons, 'RAMPS') OR list_contains(review_reasons, 'RAMPS') OR coalesce(contains(lower(notes), 'iso tank'), false) OR coalesce(contains(lower(commodity), 'iso tank'), false) THEN 'DOCUMENTS REQUIRED'
  WHEN list_contains(review_reasons, 'OFF_TARGET') THEN 'STRONG OFF-TARGET' WHEN {_ANY('WEIGHT')} THEN 'WEIGHT CHECK' WHEN list_contains(block_reasons, 'TARPS') OR list_contains(review_reasons, 'TARPS') THEN 'TARPS REQUIRED' ELSE 'GENERAL REVIEW' END AS review_category,
  CASE WHEN status = 'BLOCK' THEN 'BLOCK' WHEN score >= 90 THEN 'HIGH' WHEN score >= 75 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE status WHEN 'BLOCK' THEN 'DO NOT SEND' WHEN 'REVIEW_ONCE' THEN 'REVIEW ONCE' ELSE CASE WHEN score >= 85 THEN 'CALL NOW + EMAIL BACKUP' WHEN score >= 75 THEN 'CALL IF AVAILABLE' ELSE 'MONITOR' END END AS suggested_action,
  coalesce(nullif(concat_ws(', ', CASE WHEN rate >= 5000 THEN 'Strong gross' WHEN rate >= 3000 THEN 'Good gross' END, CASE WHEN total_rpm >= 4 THEN 'Excellent RPM' WHEN total_rpm >= 3 THEN 'Good RPM' END,
    CASE WHEN empty_miles <= 50 THEN 'Low empty miles' WHEN empty_miles <= 150 THEN 'Acceptable empty miles' END, CASE status WHEN 'MATCH' THEN 'Matches driver target' WHEN 'REVIEW_ONCE' THEN 'Needs dispatcher review' END), ''), 'Potential opportunity based on current filters') AS opportunity_reason,
  count(*) AS n FROM matches GROUP BY ALL""",
    "decisions": f"""{MATCHED}, d AS (SELECT driver, CASE WHEN status = 'MATCH' AND (reference_id = 'needs check' OR total_rpm > 6) THEN 'REVIEW_REQUIRED' ELSE status END AS decision FROM matches),
a AS (SELECT *, CASE decision {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in D.ACTIONS.items())} END AS action FROM d)
SELECT driver, decision, action, action NOT IN ({', '.join(map(repr, D.SAFE_ACTIONS))}) AS approval_required, action IN ({', '.join(map(repr, D.SAFE_ACTIONS))}) AS autonomous, count(*) AS n FROM a GROUP BY ALL""",
    "exit_markets": f"""WITH z AS ({ZONES_SQL}), b AS ({BASELINE_SQL}), m AS ({MATCHED} SELECT driver, delivery, delivery_state, rate, total_rpm FROM matches WHERE qualified),
x AS (SELECT m.*, coalesce(c.zone_status, s.zone_status) AS zone, CASE WHEN c.driver IS NULL THEN s.clean_exits ELSE c.clean_exits END AS clean, CASE WHEN c.driver IS NULL THEN s.rate_check_exits ELSE c.rate_check_exits END AS checks,
  coalesce((b.median_rpm > 0 AND total_rpm >= b.median_rpm + 0.25::DOUBLE) OR (b.median_rate > 0 AND rate >= b.median_rate + 500), false) AS strong, coalesce((b.median_rpm > 0 AND total_rpm >= b.median_rpm) OR (b.median_rate > 0 AND rate >= b.median_rate), false) AS high
  FROM m LEFT JOIN z c ON c.driver = m.driver AND c.city = m.delivery AND c.city <> '' LEFT JOIN z s ON s.driver = m.driver AND s.state = m.delivery_state AND s.state <> '' LEFT JOIN b ON b.driver = m.driver AND b.bucket = 'ALL' AND b.equipment_view = 'ALL'),
y AS (SELECT *, CASE WHEN zone IS NULL THEN 'NO_EXIT_CONTEXT' WHEN zone = 'LOW_EXIT_CONFIDENCE' THEN zone WHEN clean > 0 THEN 'CLEAN_EXIT_AVAILABLE' WHEN checks > 0 THEN 'RATE_CHECK_EXITS_AVAILABLE' WHEN zone IN ('WEAK_EXIT_MARKET', 'RISKY_EXIT_MARKET') AND strong THEN 'STRONG_PAY_RELOAD_WATCH_RECOMMENDED'
  WHEN zone IN ('WEAK_EXIT_MARKET', 'RISKY_EXIT_MARKET') AND high THEN 'HIGH_PAY_EXIT_PLAN_NEEDED' ELSE zone END AS exit_status FROM x)
SELECT driver, exit_status, CASE WHEN exit_status = 'LOW_EXIT_CONFIDENCE' THEN strong OR high ELSE exit_status IN ('STRONG_PAY_RELOAD_WATCH_RECOMMENDED', 'HIGH_PAY_EXIT_PLAN_NEEDED') END AS watch, count(*) AS n, CAST(sum(rate) AS BIGINT) AS total_rate FROM y GROUP BY ALL""",
}
