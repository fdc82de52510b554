"""Load-board rows of any header, as loads: aliases, what the notes add, and which of the two counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes as N
from ..functions.text import bind

# The headers under which a field may come, the first that is filled counts.
ALIASES = {
    "pickup": ["pickup", "origin", "pickup_city"],
    "delivery": ["delivery", "destination", "delivery_city"],
    "rate": ["rate", "posted_rate", "linehaul_rate"],
    "loaded_miles": ["loaded_miles", "trip_miles", "miles", "loaded"],
    "empty_miles": ["empty_miles", "deadhead", "dh_miles", "deadhead_miles"],
    "posted_trailer_type": ["posted_trailer_type", "equipment", "truck", "truck_type", "trailer_type"],
    "commodity": ["commodity", "commodity_name", "description"],
    "pickup_time": ["pickup_time", "pickup_window", "pickup_appointment"],
    "delivery_time": ["delivery_time", "delivery_window", "delivery_appointment"],
    "notes": ["notes", "comments", "comment", "load_comments"],
    "broker_name": ["broker_name", "broker", "company", "company_name"],
    "broker_mc": ["broker_mc", "mc", "mc_number", "broker_mc_number"],
    "broker_contact": ["broker_contact", "contact", "contact_info", "phone", "email"],
    "broker_status": ["broker_status", "brokerStatus", "broker_status_text", "factoring_status"],
    "reference_id": ["reference_id", "ref", "ref_id", "load_id", "reference"],
}
# Marks of a broker block in notes, phrases that are no broker's name, and patterns of what a block holds.
BLOCK_MARKS = ["mc#", "mc #", "contact:", "reference id", "factoring"]
NO_NAME = ["tarp required", "no tarps", "od load", "flatbed posting", "test load", "overweight load", "tracking required"]
MC, REFERENCE, CONTACT = r"(?i)\bMC\s*#?\s*(\d+)\b", r"(?i)\bReference\s*ID\s*:\s*([A-Za-z0-9\-]+)", r"(?i)\bContact\s*:\s*([^|]+)"
CREDIT, DAYS = r"(?i)\bCredit\s*Score\s*:\s*(\d+)", r"(?i)\bDays\s*to\s*Pay\s*:\s*(\d+)"
NO_STATUS = ["UNKNOWN", "N/A", "NA"]


def whole(text: Column, default: int = 0) -> Column:
    """A posted amount as a whole number, cut towards zero; what can't be read is the default."""
    for sign in ("$", ",", "lbs", "lb", "mi"):
        text = F.replace(text, F.lit(sign), F.lit(""))
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("double").try_cast("long"), F.lit(default))


def _any(text: Column, terms: list[str]) -> Column:
    return text.rlike("|".join(terms))


def normalize_rows(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Loads from rows of text columns; `keep` names columns that pass through unchanged.

    Headers that are not there count as empty, and so do null and blank values. Names, numbers and contacts are read from the
    notes where the row has none; a posted weight counts before the notes' one, but stops that the notes give before the posted
    ones; flags hold if either says so. The notes are read by
    parse_notes, each text once; the rest is a projection without a shuffle. Other columns are left out.
    """
    given = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in rows.columns else F.lit("")
    first = lambda names, default="": F.coalesce(*(F.nullif(given(n), F.lit("")) for n in names if n in rows.columns), F.lit(default))
    yes = lambda c: F.lower(given(c)).isin("true", "yes", "y", "1")
    fields = {f"__{f}": first(names, "Conestoga" if f == "posted_trailer_type" else "") for f, names in ALIASES.items()}
    plain = ["weight", "credit_score", "days_to_pay"]
    out = rows.select(
        *(F.col(c).alias(f"__keep_{c}") for c in keep or []), *(c.alias(n) for n, c in fields.items()), *(whole(given(c)).alias(f"__{c}") for c in plain),
        whole(given("stops"), 2).alias("__stops"), *(yes(c).alias(f"__{c}") for c in ("has_email", "has_phone", "requires_tarp", "is_od", "is_overweight")),
    )
    out = N.parse_notes(out, "__notes", "__commodity", "__posted_trailer_type", None)
    notes = F.col("__notes")
    low, head = F.lower(notes), F.trim(F.substring_index(notes, "|", 1))
    from_notes = {
        "broker_name": F.when(_any(low, BLOCK_MARKS) & ~_any(F.lower(head), NO_NAME), head).otherwise(""),
        "broker_mc": F.regexp_extract(notes, MC, 1), "broker_contact": F.trim(F.regexp_extract(notes, CONTACT, 1)), "reference_id": F.regexp_extract(notes, REFERENCE, 1),
        "pickup_time": F.col("parsed.detected_pickup_time"),
    }
    out = out.withColumns({f"__{f}": F.when(F.col(f"__{f}") != "", F.col(f"__{f}")).otherwise(c) for f, c in from_notes.items()})
    heard = F.array_join(F.filter(F.array("__broker_contact", "__notes", "__broker_name"), lambda x: x != ""), " | ")
    lists = bind(heard, lambda x: F.struct(N.emails(x).alias("emails"), N.phones(x).alias("phones"), N.extensions(x).alias("extensions")))
    reached = bind(lists, lambda x: F.struct((F.size(x["emails"]) > 0).alias("email"), (F.size(x["phones"]) > 0).alias("phone"), N.contact_summary(x["phones"], x["extensions"], x["emails"]).alias("contact")))
    out = out.withColumn("__reached", reached)
    status, parsed = F.col("__broker_status"), lambda c: F.col(f"parsed.{c}")
    or_notes = lambda c, pattern: F.when(F.col(f"__{c}") != 0, F.col(f"__{c}")).otherwise(whole(F.regexp_extract(notes, pattern, 1)))
    told = F.when(F.size("parsed.summary") > 0, F.concat(F.lit("Parsed notes: "), F.array_join("parsed.summary", ", ")))
    return out.select(
        *(F.col(f"__keep_{c}").alias(c) for c in keep or []), *(F.col(f"__{c}").alias(c) for c in ("pickup", "delivery")), *(whole(F.col(f"__{c}")).alias(c) for c in ("rate", "loaded_miles", "empty_miles")),
        F.when(parsed("detected_stops") != 0, parsed("detected_stops").cast("long")).otherwise(F.col("__stops")).alias("stops"),
        F.when(F.col("__weight") != 0, F.col("__weight")).otherwise(parsed("detected_weight").cast("long")).alias("weight"),
        *(F.col(f"__{c}").alias(c) for c in ("posted_trailer_type", "commodity", "pickup_time", "delivery_time")),
        F.when(told.isNull(), notes).when(notes == "", F.concat(F.lit("| "), told)).otherwise(F.concat(notes, F.lit(" | "), told)).alias("notes"),
        (F.col("__has_email") | F.col("__reached.email")).alias("has_email"), (F.col("__has_phone") | F.col("__reached.phone")).alias("has_phone"),
        *((F.col(f"__{c}") | parsed(c)).alias(c) for c in ("requires_tarp", "is_od", "is_overweight")),
        F.when((status != "") & ~F.upper(status).isin(NO_STATUS), status).when(_any(low, ["no buy", "no-buy"]), "NO_BUY").when(low.contains("factoring status not clearly shown"), "BUY_REVIEW")
        .when(low.contains("factoring eligible"), "UNKNOWN").when(status != "", status).otherwise("UNKNOWN").alias("broker_status"),
        *(F.col(f"__{c}").alias(c) for c in ("broker_name", "broker_mc")), F.when(F.col("__reached.contact") != "", F.col("__reached.contact")).otherwise(F.col("__broker_contact")).alias("broker_contact"),
        or_notes("credit_score", CREDIT).alias("credit_score"), or_notes("days_to_pay", DAYS).alias("days_to_pay"), F.col("__reference_id").alias("reference_id"), "parsed",
    )
