"""Queries over notes, contacts, board rows and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import notes as N
from ..operators import board as B
from ..sources.io import upsert
from ..sources.views import FEEDBACK_SQL, LOADS_SQL, feedback, loads, table


def notes_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by the flags that they raise and the size of their tarps."""
    rows = N.parse_notes(loads(spark, sf_dir))
    flags = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"parsed.{n}"), F.lit(n)) for n in N.FLAGS))), ",")
    return rows.groupBy(flags.alias("flags"), F.col("parsed.tarp_size").alias("tarp_size")).agg(F.count(F.lit(1)).alias("n"), F.max("rate").alias("best_rate"))


def notes_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the notes of each load say."""
    rows = N.parse_notes(loads(spark, sf_dir)).select("load_id", "parsed.*")
    return rows.withColumn("summary", F.array_join("summary", "; "))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", *(F.array_join(f(text), ",").alias(n) for n, f in {"emails": N.emails, "phones": N.phones, "extensions": N.extensions}.items()))


def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads as a board exports them: texts under the board's own headers, numbers as they are posted."""
    n = F.col("load_id")
    return loads(spark, sf_dir).select(
        "load_id", F.col("pickup").alias("origin"), F.col("delivery").alias("destination"), F.concat(F.lit("$"), F.format_number("rate", 0)).alias("posted_rate"),
        F.concat(F.col("loaded_miles"), F.lit(" mi")).alias("trip_miles"), F.col("empty_miles").cast("string").alias("deadhead"), F.when(n % 3 != 0, F.concat(F.col("weight"), F.lit(" lbs"))).alias("weight"),
        F.when(n % 4 != 0, F.col("posted")).alias("truck"), F.col("commodity").alias("description"), F.col("notes").alias("comments"), F.when(n % 5 != 0, F.col("broker_name")).alias("company"),
        F.when(n % 2 == 0, F.col("broker_mc")).alias("mc_number"), F.when(n % 7 == 0, "n/a").alias("factoring_status"), F.when(n % 2 == 1, F.col("reference_id")).alias("ref"),
    ).withColumnRenamed("load_id", "row_id")


def board_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.normalize_rows(board(spark, sf_dir), keep=["row_id"]).drop("parsed")


def upsert_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of even days replaced by those of odd days, by case and driver."""
    rows = feedback(spark, sf_dir).select("case_number", "driver", "verb", "feedback_id", F.dayofmonth("ts").alias("day"))
    old, new = rows.where("day % 2 = 0"), rows.where("day % 2 = 1")
    return upsert(old, new, ["case_number", "driver"], "feedback_id").select("case_number", "driver", "verb", "feedback_id")


# The same readings for DuckDB; what each pattern must find is stated by hand in the tests.
def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _is(pattern: str, text: str = "clean") -> str:
    return f"regexp_matches({text}, {_q(pattern)})"


def _x(pattern: str, group: int = 1, text: str = "clean") -> str:
    return f"regexp_extract({text}, {_q(pattern)}, {group})"


def _first(patterns: list[str], group: int = 1, text: str = "clean") -> str:
    return "coalesce(" + ", ".join(f"nullif({_x(p, group, text)}, '')" for p in patterns) + ", '')"


def _int(text: str) -> str:
    return f"TRY_CAST({text} AS INTEGER)"


def _email_sql(text: str) -> str:
    text = f"lower(trim({text}))"
    for pattern, by in N.EMAIL_STEPS:
        text = f"regexp_replace({text}, {_q(pattern)}, {_q(by)}, 'g')"
    return text


_WEIGHTS = "coalesce(" + ", ".join(f"(SELECT CASE WHEN v BETWEEN 1000 AND 100000 THEN v END FROM (SELECT CASE WHEN u < 1000 THEN u * 1000 ELSE u END AS v FROM (SELECT {_int(f'''replace({_x(p)}, ',', '')''')} AS u)))" for p in N.WEIGHTS) + ", 0)"
_CITIES = "coalesce(" + ", ".join(f"CASE WHEN {_is(p, 'said')} THEN trim({_x(p, 1, 'said')}, ' .,-:') || ', ' || upper({_x(p, 2, 'said')}) END" for p in N.CITY_PATTERNS) + ", '')"
_EMAIL = "coalesce(" + ", ".join(f"(SELECT CASE WHEN {_is(N.IS_EMAIL, 'e')} THEN e END FROM (SELECT {_email_sql(_x(p, 1, 'said'))} AS e))" for p in N.EMAILS) + ", '')"
_SENTENCES = {n: f"CASE WHEN {n} THEN {_q(s)} END" for n, (_, s) in N.FLAGS.items()} | {
    "requires_tarp": "CASE WHEN requires_tarp THEN trim(tarp_size || ' tarps detected') END",
    "requires_straps": "CASE WHEN requires_straps THEN CASE WHEN strap_count > 0 THEN strap_count || ' straps required' ELSE 'straps required' END END",
    "dimensions": "CASE WHEN dimensions <> '' THEN 'dimensions detected: ' || dimensions END",
    "weight_unknown": "CASE WHEN weight_unknown THEN 'posted weight may be incorrect / must verify real weight' END",
    "detected_weight": "CASE WHEN detected_weight > 0 THEN 'weight detected from notes: ' || detected_weight END",
    "detected_stops": "CASE WHEN detected_stops > 0 THEN 'stops detected from notes: ' || detected_stops END",
    "detected_pickup_time": "CASE WHEN detected_pickup_time <> '' THEN 'pickup time detected from notes: ' || detected_pickup_time END",
    "contact": "CASE WHEN phone <> '' OR email <> '' THEN 'contact override detected: ' || concat_ws(' / ', CASE WHEN phone <> '' THEN phone || CASE WHEN extension <> '' THEN ' x' || extension ELSE '' END END, nullif(email, '')) END",
    "actual_pickup_city": "CASE WHEN actual_pickup_city <> '' THEN 'actual pickup city detected from notes: ' || actual_pickup_city END",
}


def parsed_sql(source: str, notes: str, commodity: str, posted: str, one_pound: str, columns: str = "*") -> str:
    """CTEs up to `parsed`: the source's columns with all readings and the sentences."""
    return f"""cleaned AS (
  SELECT {columns}, concat_ws(' ', trim(coalesce({notes}, '')), trim(coalesce({commodity}, '')), trim(coalesce({posted}, ''))) AS said, {one_pound} AS one_pound,
         trim(regexp_replace(translate(lower(concat_ws(' ', trim(coalesce({notes}, '')), trim(coalesce({commodity}, '')), trim(coalesce({posted}, '')))), '`_;|', '.   '), '\\s+', ' ', 'g')) AS clean FROM {source}
), measured AS (
  SELECT *, NOT {_is(N.one_of(N.NO_TARP))} AND {_is(N.one_of(N.TARP))} AS requires_tarp, CASE WHEN {_first(N.TARP_FEET)} = '' THEN '' ELSE {_first(N.TARP_FEET)} || ' ft' END AS tarp_size,
         {", ".join(f"{_is(N.one_of(p))} AS {n}" for n, (p, _) in N.FLAGS.items())}, coalesce({_int(_x(N.STRAPS))}, 0) AS strap_count,
         {", ".join(f"{_first(N.DIMENSIONS, g)} AS {n}" for g, n in enumerate(("dimensions", "length", "width", "height")))},
         one_pound OR {_is(N.one_of(N.WEIGHT_UNKNOWN))} AS weight_unknown, {_WEIGHTS} AS detected_weight,
         coalesce({_int(_x(N.PICKUPS_DROPS))} + {_int(_x(N.PICKUPS_DROPS, 2))}, CASE WHEN {_first(N.PICKUPS)} <> '' OR {_first(N.DROPS)} <> '' THEN coalesce({_int(_first(N.PICKUPS))}, 1) + coalesce({_int(_first(N.DROPS))}, 1) END, CASE WHEN {_is(N.one_of(N.MULTISTOP))} THEN 2 END, 0) AS detected_stops,
         CASE WHEN contains(clean, 'fcfs') THEN coalesce(nullif(upper({_x(N.FCFS, 0)}), ''), 'FCFS - NEEDS HOURS CHECK') WHEN {_first(N.WINDOWS, 0)} <> '' THEN upper({_first(N.WINDOWS, 0)})
              WHEN {_is(N.READY)} THEN 'Ready now' WHEN contains(clean, 'appt') OR contains(clean, 'appointment') THEN 'Appointment required' ELSE '' END AS detected_pickup_time,
         regexp_replace({_x(N.PHONE, 1, "said")}, '\\s+', ' ', 'g') AS phone, {_x(N.PHONE, 2, "said")} AS extension, {_EMAIL} AS email, {_CITIES} AS actual_pickup_city FROM cleaned
), parsed AS (SELECT *, concat_ws('; ', {", ".join(_SENTENCES[n] for n in N.SUMMARY)}) AS summary FROM measured)"""


_PARSED = parsed_sql("loads", "notes", "commodity", "posted", "weight = 1", "load_id, rate")


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)}, 1)"


def _unspelled(text: str) -> str:
    for old, new in N.SPELLINGS:
        text = f"replace({text}, {_q(old)}, {_q(new)})"
    return f"regexp_replace(regexp_replace({text}, '\\s*@\\s*', '@', 'g'), '\\s*\\.\\s*', '.', 'g')"


def _mended(address: str) -> str:
    address = f"lower({address})"
    for wrong, right in N.TYPOS.items():
        address = f"regexp_replace({address}, {_q(wrong.replace('.', chr(92) + '.') + '$')}, {_q(right)})"
    return address


def _once(items: str) -> str:
    return f"(SELECT list_filter(l, lambda x, i: list_position(l, x) = i) FROM (SELECT {items} AS l))"


def emails_sql(text: str) -> str:
    return _once(f"list_transform({_all(_unspelled(text), N.ADDRESS)}, lambda x: {_mended('x')})")


def phones_sql(text: str) -> str:
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    return _once(f"list_transform(list_concat({', '.join(_all(text, p) for p in N.NUMBERS)}), lambda x: '(' || substr({digits}, 1, 3) || ') ' || substr({digits}, 4, 3) || '-' || substr({digits}, 7))")


def extensions_sql(text: str) -> str:
    return _once(f"list_concat({', '.join(_all(text, p) for p in N.EXTENSIONS)})")


_WHOLE = "coalesce(TRY_CAST(trunc(TRY_CAST(trim(replace(replace(replace(replace(replace({}, '$', ''), ',', ''), 'lbs', ''), 'lb', ''), 'mi', '')) AS DOUBLE)) AS BIGINT), 0)"
_BOARD_SQL = f"""WITH {LOADS_SQL}, board AS (
  SELECT load_id AS row_id, trim(coalesce(pickup, '')) AS pickup, trim(coalesce(delivery, '')) AS delivery, rate, loaded_miles, empty_miles, CASE WHEN load_id % 3 <> 0 THEN weight ELSE 0 END AS posted_pounds,
         CASE WHEN load_id % 4 <> 0 THEN posted ELSE 'Conestoga' END AS truck, coalesce(commodity, '') AS commodity, trim(coalesce(notes, '')) AS notes, CASE WHEN load_id % 5 <> 0 THEN broker_name ELSE '' END AS company,
         CASE WHEN load_id % 2 = 0 THEN broker_mc ELSE '' END AS mc, CASE WHEN load_id % 7 = 0 THEN 'n/a' ELSE '' END AS factoring, CASE WHEN load_id % 2 = 1 THEN reference_id ELSE '' END AS ref FROM loads
), {parsed_sql("board", "notes", "commodity", "truck", "false")}, named AS (
  SELECT *, lower(notes) AS low, trim(split_part(notes, '|', 1)) AS head, trim({_x(B.CONTACT, 1, "notes")}) AS contact FROM parsed
), heard AS (
  SELECT *, CASE WHEN company <> '' THEN company WHEN {_is("|".join(B.BLOCK_MARKS), "low")} AND NOT {_is("|".join(B.NO_NAME), "lower(head)")} THEN head ELSE '' END AS name FROM named
), told AS (SELECT *, concat_ws(' | ', nullif(contact, ''), nullif(notes, ''), nullif(name, '')) AS words FROM heard
), reached AS (SELECT *, {emails_sql("words")} AS es, {phones_sql("words")} AS ps, {extensions_sql("words")} AS xs FROM told)
SELECT row_id, pickup, delivery, CAST(rate AS BIGINT) AS rate, CAST(loaded_miles AS BIGINT) AS loaded_miles, CAST(empty_miles AS BIGINT) AS empty_miles,
       CAST(CASE WHEN detected_stops <> 0 THEN detected_stops ELSE 2 END AS BIGINT) AS stops, CAST(CASE WHEN posted_pounds <> 0 THEN posted_pounds ELSE detected_weight END AS BIGINT) AS weight,
       truck AS posted_trailer_type, commodity, detected_pickup_time AS pickup_time, '' AS delivery_time,
       CASE WHEN summary = '' THEN notes WHEN notes = '' THEN '| Parsed notes: ' || commas ELSE notes || ' | Parsed notes: ' || commas END AS notes,
       len(es) > 0 AS has_email, len(ps) > 0 AS has_phone, requires_tarp, is_od, is_overweight,
       CASE WHEN contains(low, 'no buy') OR contains(low, 'no-buy') THEN 'NO_BUY' WHEN contains(low, 'factoring status not clearly shown') THEN 'BUY_REVIEW' WHEN contains(low, 'factoring eligible') THEN 'UNKNOWN' WHEN factoring <> '' THEN factoring ELSE 'UNKNOWN' END AS broker_status,
       name AS broker_name, CASE WHEN mc <> '' THEN mc ELSE {_x(B.MC, 1, "notes")} END AS broker_mc,
       coalesce(nullif(array_to_string(list_concat(list_transform(ps, lambda p: CASE WHEN len(xs) > 0 THEN p || ' ext ' || xs[1] ELSE p END), es), ' / '), ''), contact) AS broker_contact,
       {_WHOLE.format(_x(B.CREDIT, 1, "notes"))} AS credit_score, {_WHOLE.format(_x(B.DAYS, 1, "notes"))} AS days_to_pay,
       CASE WHEN ref <> '' THEN ref ELSE {_x(B.REFERENCE, 1, "notes")} END AS reference_id
FROM (SELECT *, concat_ws(', ', {", ".join(_SENTENCES[n] for n in N.SUMMARY)}) AS commas FROM reached)"""

QUERIES = {"notes_flags": notes_flags, "notes_parsed": notes_parsed, "board_loads": board_loads, "contacts": contacts, "upsert_answers": upsert_answers}
ORACLES = {
    "notes_flags": f"WITH {LOADS_SQL}, {_PARSED} SELECT concat_ws(',', {', '.join(f'CASE WHEN {n} THEN {_q(n)} END' for n in N.FLAGS)}) AS flags, tarp_size, count(*) AS n, max(rate) AS best_rate FROM parsed GROUP BY 1, 2",
    "notes_parsed": f"WITH {LOADS_SQL}, {_PARSED} SELECT * EXCLUDE (rate, said, one_pound, clean) FROM parsed",
    "board_loads": _BOARD_SQL,
    "contacts": f"SELECT doc_id, array_to_string({emails_sql('text')}, ',') AS emails, array_to_string({phones_sql('text')}, ',') AS phones, array_to_string({extensions_sql('text')}, ',') AS extensions FROM documents",
    "upsert_answers": f"WITH {FEEDBACK_SQL} SELECT case_number, driver, verb, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY case_number, driver ORDER BY day(ts) % 2 DESC, feedback_id DESC) AS n FROM feedback) WHERE n = 1",
}
