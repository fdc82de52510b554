"""The driver-match rules as bits: what loads ask for, what drivers have, and the levels (block, review, match) that follow.

Every reason has a bit. What a load's texts ask for and what a driver has or lacks are whole numbers of such bits, computed before
loads meet requests, so that document rules are three bitwise operations for each pair and reasons are spelled out only where a
query selects them.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import location_state

# States of each target direction, and states on the way to it.
TARGETS = {
    "texas": ["TX"],
    "tx": ["TX"],
    "midwest": ["IL", "IN", "OH", "MI", "WI", "MN", "IA", "MO", "KS", "NE", "ND", "SD"],
    "north east": ["PA", "NY", "NJ", "CT", "MA", "RI", "NH", "VT", "ME"],
    "northeast": ["PA", "NY", "NJ", "CT", "MA", "RI", "NH", "VT", "ME"],
    "south east": ["GA", "SC", "NC", "TN", "AL"],
    "southeast": ["GA", "SC", "NC", "TN", "AL"],
    "west": ["CA", "OR", "WA", "NV", "AZ", "UT", "ID"],
}
ON_THE_WAY = {
    "texas": ["AL", "MS", "LA", "AR", "OK", "TX"],
    "tx": ["AL", "MS", "LA", "AR", "OK", "TX"],
    "midwest": ["GA", "AL", "TN", "KY", "IN", "IL", "OH", "MO", "WI", "MI", "IA", "MN"],
    "north east": ["GA", "SC", "NC", "VA", "MD", "PA", "NJ", "NY"],
    "northeast": ["GA", "SC", "NC", "VA", "MD", "PA", "NJ", "NY"],
    "west": ["AL", "MS", "LA", "TX", "OK", "NM", "AZ", "CA", "NV", "UT"],
}
# Neighbours of a driver's state.
NEIGHBOURS = {
    "CA": ["NV", "OR", "AZ"],
    "OR": ["CA", "WA", "ID", "NV"],
    "WA": ["OR", "ID"],
    "NV": ["CA", "OR", "ID", "UT", "AZ"],
    "AZ": ["CA", "NV", "UT", "NM"],
    "TX": ["OK", "AR", "LA", "NM"],
    "FL": ["GA", "AL"],
    "GA": ["FL", "AL", "TN", "SC", "NC"],
    "AL": ["FL", "GA", "MS", "TN"],
    "TN": ["AL", "GA", "KY", "AR", "MS", "MO", "NC"],
    "CO": ["WY", "NE", "KS", "OK", "NM", "AZ", "UT"],
    "IL": ["WI", "IA", "MO", "KY", "IN"],
    "IN": ["IL", "MI", "OH", "KY"],
    "OH": ["IN", "MI", "PA", "WV", "KY"],
}
# Terms of the rules.
PERMIT_TERMS = ["permit load", "permits required", "permit required", "over dimension", "over-dimensional", "overdimensional", "oversize", "over size", "wide load", "od load", "os/ow"]
CASH_TERMS = ["cash or zelle", "zelle or cash", "cash/zelle", "cashapp", "cash app", "zelle", "venmo", "cash on delivery"]
QUICKPAY_TERMS = ["quickpay", "quick pay"]
HAZMAT_TERMS = ["hazmat", "haz mat", "haz-mat", "hazardous"]
TANKER_TERMS = ["tanker", "tank endorsement", "tanker endorsement", "tanker endorsment", "tanker endoresment"]
TWIC_TERMS = ["twic", "twic card"]
STATUS_TERMS = ["us citizen", "u.s. citizen", "citizen required", "green card", "green-card", "permanent resident", "work permit", "employment authorization", "ead card"]
RAMP_TERMS = ["need ramps", "ramps required", "ramps req", "need ramp"]
DUNNAGE_TERMS = ["dunnage", "must provide wood", "provide wood", "wood required", "blocking and bracing", "block and brace"]
NO_CONESTOGA_TERMS = ["no conestoga", "no conestogas", "no stoga", "no stogas", "conestoga no", "flatbed only", "flat only", "must be flatbed", "conestoga wouldn't work", "conestoga would not work", "conestoga wont work", "conestoga won't work", "conestoga will not work", "no con"]
VERIFY_CONESTOGA_TERMS = ["flatbed preferred", "prefer flatbed", "preferred flatbed"]
NO_TARP_TERMS = ["no tarp", "no tarps", "no tarping", "no tarp required", "no tarps required", "does not need tarps", "tarps not required", "tarp not required"]
#: Patterns of tarps that are asked for, and of their size.
TARP_PATTERNS = [r"\b[468]\s*(?:ft|feet|foot|')\s*tarps?\b", r"\btarps?\s*req(?:uired)?\b", r"\bneeds?\s*tarps?\b", r"\bmust\s*tarp\b", r"\btarping\s*required\b"]
FEET_PATTERN = r"\b([468])\s*(?:ft|feet|foot|')\b"
TRACKING_TERMS = ["tracking required", "macro point", "macropoint"]

# Posted codes that mean an open deck, broker numbers that are none, and the default of the empty-mile limit.
DECK_CODES, NO_BROKER, EMPTY_LIMIT = ["f", "fd", "ft"], ["", "NEEDS CHECK", "NO MC", "UNKNOWN", "NONE"], 200

#: Reasons in the order in which they are listed; the level says what a reason means.
REASONS = [
    "SAME_CITY", "LOCAL_MILES", "WEIGHT", "OD_PERMIT", "EMPTY_MILES", "RATE_MISSING", "LOW_RPM", "CASH_PAYMENT", "QUICKPAY",
    "HAZMAT", "TANKER", "TWIC", "LEGAL_STATUS", "RAMPS", "DUNNAGE", "TARPS", "TRACKING", "TARGET_CITY", "TARGET_REGION",
    "ALONG_ROUTE", "OFF_TARGET", "CONESTOGA", "POSTED_FLATBED", "PICKUP_FAR", "BROKER_BAD", "BROKER_RATE", "BROKER_WATCH", "BROKER_GOOD",
]
BIT = {name: 1 << i for i, name in enumerate(REASONS)}
DOCUMENTS = ["HAZMAT", "TANKER", "TWIC", "LEGAL_STATUS", "RAMPS", "DUNNAGE"]
LEVELS = ["block", "review", "match"]
#: States that any rule names; a place's bit is its position, and a state that no rule names has none.
STATES = sorted({s for table in (TARGETS, ON_THE_WAY, NEIGHBOURS) for k, v in table.items() for s in v} | set(NEIGHBOURS))


def any_of(*names: str) -> int:
    return sum(BIT[n] for n in names)


def _has_any(text: Column, terms: list[str]) -> Column:
    return reduce(operator.or_, (F.contains(text, F.lit(t)) for t in terms))


def _bits(*parts: tuple[str, Column]) -> Column:
    """The sum of the bits whose condition holds."""
    zero = F.lit(0).cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), (F.when(condition, F.lit(BIT[name]).cast("long")).otherwise(zero) for name, condition in parts))


def _apart(bits: Column) -> Column:
    """The same bits through a function of the interpreter's, which keeps the projection that holds it out of the stage's one generated
    method: with joins before and rules after it, that method would be too large for the JVM to compile. Every query reads the blocking
    bits, so some of those are set apart, as few as will do; all else in such a projection is compiled, in methods of its own."""
    return F.aggregate(F.array(bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def _state_bit(state: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, STATES)), state)
    return F.when(at > 0, F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).otherwise(F.lit(0).cast("long"))


def _mask(places: dict[str, list[str]], key: Column) -> Column:
    """The bits of a table's states under a request's key; 0 for a key that it doesn't know."""
    known = F.create_map(*(F.lit(x) for k, v in places.items() for x in (k, sum(1 << (STATES.index(s) + 1) for s in v))))
    return F.coalesce(F.try_element_at(known, key).cast("long"), F.lit(0).cast("long"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def load_facts(loads: DataFrame) -> DataFrame:
    """Loads with what the rules read of them alone: texts are searched once for each load, case-insensitively.

    Null texts are empty and null numbers 0. Optional columns: commodity, parsed_od (boolean), broker_memory (a broker's class).
    """
    has = lambda c: c in loads.columns
    notes, posted = F.lower(_text("notes")), F.lower(_text("posted"))
    said = F.concat_ws(" ", notes, F.lower(_text("commodity")) if has("commodity") else F.lit(""), posted)
    rows = loads.withColumns({"__notes": notes, "__posted": posted, "__said": said})
    said, notes, posted = F.col("__said"), F.col("__notes"), F.col("__posted")
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    cash = _has_any(said, CASH_TERMS)
    tarps = ~_has_any(said, NO_TARP_TERMS) & said.rlike("|".join(TARP_PATTERNS))
    od = _has_any(notes, PERMIT_TERMS) | (F.coalesce(F.col("parsed_od"), F.lit(False)) if has("parsed_od") else F.lit(False))
    no_conestoga, verify = _has_any(notes, NO_CONESTOGA_TERMS), _has_any(notes, VERIFY_CONESTOGA_TERMS)
    deck = posted.contains("flatbed") | posted.contains("step") | posted.isin(DECK_CODES)
    pickup, delivery = F.lower(F.trim(_text("pickup"))), F.lower(F.trim(_text("delivery")))
    memory = F.col("broker_memory") if has("broker_memory") else F.lit(None).cast("string")
    memory = F.when(F.upper(F.trim(_text("broker_mc"))).isin(NO_BROKER), F.lit("")).otherwise(F.coalesce(memory, F.lit("")))
    asked = {"HAZMAT": HAZMAT_TERMS, "TANKER": TANKER_TERMS, "TWIC": TWIC_TERMS, "LEGAL_STATUS": STATUS_TERMS, "RAMPS": RAMP_TERMS, "DUNNAGE": DUNNAGE_TERMS, "TRACKING": TRACKING_TERMS}
    rows = rows.withColumns({
        # what texts ask for; CONESTOGA: it is not accepted, POSTED_FLATBED: an open deck is posted or preferred
        "__asks": _bits(*((n, _has_any(said, t)) for n, t in asked.items()), ("TARPS", tarps), ("OD_PERMIT", od), ("CONESTOGA", no_conestoga), ("POSTED_FLATBED", deck | verify)),
        # what an open deck means to a conestoga that is not turned away
        "__deck": F.when(no_conestoga, F.lit(0).cast("long")).when(verify, F.lit(BIT["CONESTOGA"]).cast("long")).otherwise(_bits(("POSTED_FLATBED", deck))),
        "__feet": F.when(tarps, F.coalesce(F.nullif(F.regexp_extract(said, FEET_PATTERN, 1), F.lit("")).try_cast("int"), F.lit(0))).otherwise(0),
        "__block": _bits(("SAME_CITY", (pickup != "") & (pickup == delivery)), ("CASH_PAYMENT", cash)).bitwiseOR(_apart(_bits(("LOCAL_MILES", (number("loaded_miles") > 0) & (number("loaded_miles") <= 10))))),
        "__review": _bits(("RATE_MISSING", number("rate") == 0), ("QUICKPAY", ~cash & _has_any(said, QUICKPAY_TERMS)), ("BROKER_BAD", memory == "BAD_BROKER_REVIEW"), ("BROKER_RATE", memory == "RATE_NEGOTIATION_REQUIRED"), ("BROKER_WATCH", memory == "WATCHLIST")),
        "__match": _bits(("BROKER_GOOD", memory == "GOOD")),
        "__delivery": delivery, "pickup_state": location_state(F.col("pickup")), "delivery_state": location_state(F.col("delivery")),
        "strong": (number("total_rpm") >= 4.5) & (number("rate") >= 2800) & (number("empty_miles") <= 150) & (number("loaded_miles") >= 450),
        **{f"__{c}": number(c) for c in ("weight", "empty_miles", "total_rpm")},
    })
    return rows.withColumns({"__pickup_bit": _state_bit(F.col("pickup_state")), "__delivery_bit": _state_bit(F.col("delivery_state"))}).drop("__notes", "__posted", "__said")


def request_facts(requests: DataFrame) -> DataFrame:
    """Requests with what the rules read of them alone: documents that the driver has or lacks (unknown: neither), and masks of states."""
    equipment, target = F.lower(_text("equipment")), F.lower(F.trim(_text("target")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    columns = {"HAZMAT": "hazmat", "TANKER": "tanker", "TWIC": "twic", "RAMPS": "ramps", "DUNNAGE": "dunnage", "TARPS": "can_tarp", "TRACKING": "tracking_ok"}
    papers = ["us_citizen", "green_card", "work_permit"]
    any_paper, no_paper = yes(papers[0]) | yes(papers[1]) | yes(papers[2]), no(papers[0]) & no(papers[1]) & no(papers[2])
    limit = F.coalesce(F.col("max_empty"), F.lit(0))
    rows = requests.withColumn("driver_state", location_state(F.col("location")))
    rows = rows.withColumns({
        "__has": _bits(*((n, yes(c)) for n, c in columns.items()), ("LEGAL_STATUS", any_paper)),
        "__lacks": _bits(*((n, no(c)) for n, c in columns.items()), ("LEGAL_STATUS", no_paper)),
        "conestoga": equipment.contains("conestoga"), "__only_conestoga": equipment == "conestoga",
        "__driver_feet": F.coalesce(F.nullif(F.regexp_extract(F.lower(_text("tarp_size")), FEET_PATTERN, 1), F.lit("")).try_cast("int"), F.lit(0)),
        "__city": F.lower(F.trim(_text("target_city"))), "__targets": _mask(TARGETS, target), "__route": _mask(ON_THE_WAY, target), "__near": _mask(NEIGHBOURS, F.col("driver_state")),
        "__limit": F.when(limit == 0, EMPTY_LIMIT).otherwise(limit), "__max_weight": F.coalesce(F.col("max_weight"), F.lit(0)), "__min_rpm": F.coalesce(F.col("min_rpm"), F.lit(0.0)),
    })
    # tarps longer than the driver's, from which on a person must look; never where a conestoga or no tarp of known size is there
    tarps = (~F.col("conestoga")) & (F.col("__has").bitwiseAND(F.lit(BIT["TARPS"])) != 0) & (F.col("__driver_feet") > 0)
    taken = {f"__{level}_taken": F.expr(_any_bits(parts)) for level, parts in _TAKEN.items()}
    rows = rows.withColumns({**taken, "__deck_taken": F.when(F.col("conestoga"), F.lit(-1)).otherwise(0).cast("long"), "__long_feet": F.when(tarps, F.col("__driver_feet")).otherwise(F.lit(2**31 - 1))})
    return rows.drop("__has", "__lacks", "__only_conestoga", "__driver_feet")


# A mask if a condition holds, else no bits.
_IF = "IF({1}, {0}L, 0L)"
_DOCS = any_of(*DOCUMENTS)
#: What each level takes of the bits that a load asks for, as a request alone decides: masks, worked out once for each request.
_TAKEN = {
    "block": [f"(__lacks & {_DOCS}L)", ("OD_PERMIT", "__only_conestoga"), ("TARPS", f"NOT conestoga AND (__lacks & {BIT['TARPS']}L) <> 0"), ("TRACKING", f"(__has & {BIT['TRACKING']}L) = 0"), ("CONESTOGA", "conestoga")],
    "review": [f"(~(__has | __lacks) & {_DOCS}L)", ("OD_PERMIT", "NOT __only_conestoga"), ("TARPS", f"NOT conestoga AND ((__has | __lacks) & {BIT['TARPS']}L) = 0")],
    "match": [f"(__has & {_DOCS | BIT['TRACKING']}L)", ("TARPS", f"conestoga OR (__has & {BIT['TARPS']}L) <> 0")],
}


def _any_bits(parts: list) -> str:
    return " | ".join(p if isinstance(p, str) else _IF.format(BIT[p[0]], p[1]) for p in parts)


def _level(name: str) -> str:
    """The bits of a level for a pair: those of the load alone (blocking ones are added where pairs are matched), those it asks for under
    the level's mask, and what both sides' figures decide."""
    over, off = "__max_weight > 0 AND __weight > __max_weight", "NOT in_city AND NOT in_target"
    parts = {
        "block": [
            "(__asks & __block_taken)", ("WEIGHT", f"conestoga AND {over}"), ("TARGET_REGION", f"NOT strong AND {off} AND NOT on_route"),
            ("PICKUP_FAR", "__empty_miles <= 250 AND (__near & __pickup_bit) = 0 AND driver_state <> '' AND pickup_state <> '' AND driver_state <> pickup_state"),
        ],
        "review": [
            "__review", "(__asks & __review_taken)", "(__deck & __deck_taken)", ("WEIGHT", f"NOT conestoga AND {over}"), ("EMPTY_MILES", "__empty_miles > __limit"), ("TARPS", "__feet > __long_feet"),
            ("ALONG_ROUTE", f"on_route AND {off}"), ("OFF_TARGET", f"strong AND {off} AND NOT on_route"),
        ],
        "match": [
            "__match", f"(__asks & __match_taken & ~{_IF.format(BIT['TARPS'], '__feet > __long_feet')})", ("LOW_RPM", "__min_rpm > 0 AND __total_rpm > 0 AND __total_rpm < __min_rpm"),
            ("TARGET_CITY", "in_city"), ("TARGET_REGION", "NOT in_city AND in_target"),
        ],
    }[name]
    return _any_bits(parts)


# Tiers of the opportunity score and what each adds; status as known after the rules, zone_good 1 for deliveries to a good zone.
SCORE = (
    "(CASE WHEN rate >= 5000 THEN 30 WHEN rate >= 3500 THEN 25 WHEN rate >= 2500 THEN 18 WHEN rate >= 1500 THEN 10 ELSE 5 END"
    " + CASE WHEN total_rpm >= 4 THEN 30 WHEN total_rpm >= 3 THEN 25 WHEN total_rpm >= 2.5 THEN 18 WHEN total_rpm >= 2 THEN 10 ELSE 3 END"
    " + CASE WHEN empty_miles <= 50 THEN 15 WHEN empty_miles <= 150 THEN 10 WHEN empty_miles <= 250 THEN 5 ELSE 0 END"
    " + CASE status WHEN 'MATCH' THEN 20 WHEN 'REVIEW_ONCE' THEN 8 ELSE -50 END)"
)
QUALIFIED = "(status <> 'BLOCK' AND rate > 0 AND (loaded_miles > 0 OR total_miles > 0))"
GOOD = f"({QUALIFIED} AND (rate >= 3000 OR total_rpm >= 3))"


def reasons_of(bits: Column) -> Column:
    """The names of the reasons whose bits are set, in their order."""
    names = F.array(*map(F.lit, REASONS))
    return F.filter(names, lambda name, i: F.call_function("shiftright", bits, i) % 2 == 1)


def match_loads(loads: DataFrame, requests: DataFrame) -> DataFrame:
    """Every load under every request: bits of each level, status (BLOCK over REVIEW_ONCE over MATCH), qualified, good, score, in_city, in_target.

    The requests are few and broadcast, so the plan has no shuffle; reasons are spelled out by with_reasons. Null texts, numbers
    and states never raise a reason but RATE_MISSING; a null delivery is off target. An optional column delivery_zone that holds
    `GOOD` adds to the score.
    """
    rows = load_facts(loads).crossJoin(F.broadcast(request_facts(requests)))
    rows = rows.withColumns({"in_city": F.expr("__city <> '' AND contains(__delivery, __city)"), "in_target": F.expr("(__targets & __delivery_bit) <> 0"), "on_route": F.expr("(__route & __delivery_bit) <> 0")})
    rows = rows.withColumns({f"{level}_bits": F.expr(_level(level)) for level in LEVELS} | {"block_bits": _apart(F.col("__block")).bitwiseOR(F.expr(_level("block")))})
    rows = rows.withColumn("status", F.expr("CASE WHEN block_bits <> 0 THEN 'BLOCK' WHEN review_bits <> 0 THEN 'REVIEW_ONCE' ELSE 'MATCH' END"))
    zone = "IF(upper(coalesce(delivery_zone, '')) LIKE '%GOOD%', 5, 0)" if "delivery_zone" in loads.columns else "0"
    rows = rows.withColumns({"qualified": F.expr(f"coalesce({QUALIFIED}, false)"), "good": F.expr(f"coalesce({GOOD}, false)"), "score": F.expr(f"greatest(0, {SCORE} + {zone})")})
    return rows.drop(*(c for c in rows.columns if c.startswith("__")), "on_route")


def with_reasons(matches: DataFrame) -> DataFrame:
    """Matches with `reasons`: those of the level that decides the status."""
    bits = F.when(F.col("status") == "BLOCK", F.col("block_bits")).when(F.col("status") == "REVIEW_ONCE", F.col("review_bits")).otherwise(F.col("match_bits"))
    return matches.withColumn("reasons", reasons_of(bits))


# The same rules for DuckDB, written out condition by condition.
def _sql_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, t.replace("'", "''")) for t in terms) + ")"


def _sql_state(place: str) -> str:
    after, word = f"upper(trim(split_part({place}, ',', -1)))", f"upper(split_part(trim({place}), ' ', -1))"
    return f"coalesce(CASE WHEN contains({place}, ',') AND length({after}) = 2 THEN {after} WHEN length({word}) = 2 THEN {word} ELSE '' END, '')"


def _sql_in(places: dict[str, list[str]], key: str, state: str) -> str:
    return "(" + " OR ".join(f"({key} = '{k}' AND {state} IN ({', '.join(repr(s) for s in v)}))" for k, v in places.items()) + ")"


def _sql_document(name: str, terms: list[str], has: str, lacks: str) -> tuple[list, list, list]:
    asked = _sql_any("said", terms)
    return (name, f"{asked} AND {lacks}"), (name, f"{asked} AND NOT {has} AND NOT {lacks}"), (name, f"{asked} AND {has}")


def _sql_levels() -> dict[str, list[tuple[str, str]]]:
    known = lambda c: (f"coalesce({c}, false)", f"coalesce(NOT {c}, false)")
    papers = ["us_citizen", "green_card", "work_permit"]
    status = "(" + " OR ".join(known(p)[0] for p in papers) + ")", "(" + " AND ".join(known(p)[1] for p in papers) + ")"
    docs = [
        _sql_document("HAZMAT", HAZMAT_TERMS, *known("hazmat")), _sql_document("TANKER", TANKER_TERMS, *known("tanker")), _sql_document("TWIC", TWIC_TERMS, *known("twic")),
        _sql_document("LEGAL_STATUS", STATUS_TERMS, *status), _sql_document("RAMPS", RAMP_TERMS, *known("ramps")), _sql_document("DUNNAGE", DUNNAGE_TERMS, *known("dunnage")),
    ]
    over, cash, permit = "coalesce(max_weight, 0) > 0 AND coalesce(weight, 0) > max_weight", _sql_any("said", CASH_TERMS), _sql_any("nlow", PERMIT_TERMS)
    no_con, verify, track = _sql_any("nlow", NO_CONESTOGA_TERMS), _sql_any("nlow", VERIFY_CONESTOGA_TERMS), _sql_any("said", TRACKING_TERMS)
    off, short = "NOT in_city AND NOT in_target", "(tarp_feet > driver_feet AND driver_feet > 0)"
    near = _sql_in(NEIGHBOURS, "driver_state", "pickup_state")
    return {
        "block": [
            ("SAME_CITY", "coalesce(trim(pickup) <> '' AND lower(trim(pickup)) = lower(trim(delivery)), false)"), ("LOCAL_MILES", "loaded_miles BETWEEN 1 AND 10"),
            ("WEIGHT", f"{over} AND conestoga"), ("OD_PERMIT", f"{permit} AND lower(equipment) = 'conestoga'"), ("CASH_PAYMENT", cash), *(d[0] for d in docs),
            ("TARPS", "tarps AND NOT conestoga AND coalesce(NOT can_tarp, false)"), ("TRACKING", f"{track} AND NOT coalesce(tracking_ok, false)"),
            ("TARGET_REGION", f"{off} AND NOT on_route AND NOT strong"), ("CONESTOGA", f"conestoga AND {no_con}"),
            ("PICKUP_FAR", f"driver_state <> '' AND pickup_state <> '' AND driver_state <> pickup_state AND NOT {near} AND empty_miles <= 250"),
        ],
        "review": [
            ("WEIGHT", f"{over} AND NOT conestoga"), ("OD_PERMIT", f"{permit} AND lower(equipment) <> 'conestoga'"), ("EMPTY_MILES", "empty_miles > CASE WHEN coalesce(max_empty, 0) = 0 THEN 200 ELSE max_empty END"),
            ("RATE_MISSING", "coalesce(rate, 0) = 0"), ("QUICKPAY", f"NOT {cash} AND {_sql_any('said', QUICKPAY_TERMS)}"), *(d[1] for d in docs),
            ("TARPS", f"tarps AND NOT conestoga AND (can_tarp IS NULL OR (can_tarp AND {short}))"),
            ("ALONG_ROUTE", f"{off} AND on_route"), ("OFF_TARGET", f"{off} AND NOT on_route AND strong"), ("CONESTOGA", f"conestoga AND NOT {no_con} AND {verify}"),
            ("POSTED_FLATBED", f"conestoga AND NOT {no_con} AND NOT {verify} AND (contains(lower(posted), 'flatbed') OR contains(lower(posted), 'step') OR lower(posted) IN ('f', 'fd', 'ft'))"),
        ],
        "match": [
            ("LOW_RPM", "coalesce(min_rpm, 0) > 0 AND total_rpm > 0 AND total_rpm < min_rpm"), *(d[2] for d in docs), ("TARPS", f"tarps AND (conestoga OR (coalesce(can_tarp, false) AND NOT {short}))"),
            ("TRACKING", f"{track} AND coalesce(tracking_ok, false)"), ("TARGET_CITY", "in_city"), ("TARGET_REGION", "NOT in_city AND in_target"),
        ],
    }


_SQL_FEET = r"coalesce(TRY_CAST(nullif(regexp_extract({}, '\b([468])\s*(?:ft|feet|foot|'')\b', 1), '') AS INTEGER), 0)"
_SQL_TARPS = r"regexp_matches(said, '\b[468]\s*(?:ft|feet|foot|'')\s*tarps?\b|\btarps?\s*req(?:uired)?\b|\bneeds?\s*tarps?\b|\bmust\s*tarp\b|\btarping\s*required\b')"
MATCHES_SQL = f"""said AS (
  SELECT *, lower(concat_ws(' ', coalesce(notes, ''), coalesce(commodity, ''), coalesce(posted, ''))) AS said, lower(coalesce(notes, '')) AS nlow, {_sql_state("pickup")} AS pickup_state, {_sql_state("delivery")} AS delivery_state,
         coalesce(total_rpm >= 4.5 AND rate >= 2800 AND empty_miles <= 150 AND loaded_miles >= 450, false) AS strong FROM loads
), tarped AS (
  SELECT *, NOT {_sql_any("said", NO_TARP_TERMS)} AND {_SQL_TARPS} AS tarps FROM said
), asked AS (SELECT *, CASE WHEN tarps THEN {_SQL_FEET.format("said")} ELSE 0 END AS tarp_feet FROM tarped
), drivers AS (
  SELECT * REPLACE (lower(trim(coalesce(target, ''))) AS target, lower(trim(coalesce(target_city, ''))) AS target_city), {_sql_state("location")} AS driver_state, contains(lower(coalesce(equipment, '')), 'conestoga') AS conestoga, {_SQL_FEET.format("lower(coalesce(tarp_size, ''))")} AS driver_feet FROM requests
), facts AS (
  SELECT *, coalesce(target_city, '') <> '' AND contains(lower(coalesce(delivery, '')), target_city) AS in_city, {_sql_in(TARGETS, "target", "delivery_state")} AS in_target,
         {_sql_in(ON_THE_WAY, "target", "delivery_state")} AS on_route FROM asked CROSS JOIN drivers
), reasoned AS (
  SELECT *, {", ".join("list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + f"], lambda x: x IS NOT NULL) AS {level}_reasons" for level, rules in _sql_levels().items())} FROM facts
), judged AS (
  SELECT *, CASE WHEN len(block_reasons) > 0 THEN 'BLOCK' WHEN len(review_reasons) > 0 THEN 'REVIEW_ONCE' ELSE 'MATCH' END AS status FROM reasoned
), matches AS (
  SELECT *, CASE status WHEN 'BLOCK' THEN block_reasons WHEN 'REVIEW_ONCE' THEN review_reasons ELSE match_reasons END AS reasons,
         {QUALIFIED} AS qualified, {GOOD} AS good, greatest(0, {SCORE}) AS score FROM judged
)"""
