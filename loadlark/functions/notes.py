"""What a load's notes say: flags, sizes, weights, stops, times and contacts as columns, and the sentences of their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bind

# The patterns of each flag over cleaned text (one of them must match; those that another of the list covers are
# left out), and the sentence that it adds to the summary.
FLAGS = {
    "requires_straps": ([r"\bstrap\s*and\s*go\b", r"\bstraps?\s*required\b", r"\bstraps?\s*req\b", r"\bneed\s*straps?\b", r"\bneeds\s*straps?\b", r"\b\d+\s*straps?\b"], "straps required"),
    "is_od": (
        [
            r"\bpermit\s*load\b", r"\bpermits\s*required\b", r"\bpermit\s*required\b", r"\bpermit\s*needed\b", r"\bneeds\s*permit\b", r"\bneed\s*permit\b", r"\bneed\s*permits\b", r"\brequires\s*permit\b",
            r"\bover\s*dimension\b", r"\bover\s*dimensional\b", r"\bover\s*size\b", r"\bwide\s*load\b", r"\bwide\b.*\bload\b", r"\bod\s*load\b", r"\bod\s*permit\b", r"\bod\s*required\b", r"\bod\s*req\b",
            r"\bod\s*/\s*permit\b", r"\bescort\s*required\b", r"\bpilot\s*car\b", r"\blegal\s*over\s*dimension\b",
            r"\b(10[3-9]|1[1-9][0-9])\s*w\b", r"\b(10[3-9]|1[1-9][0-9])\s*wide\b", r"\b(10[3-9]|1[1-9][0-9])\s*inch\s*wide\b", r"\b(10[3-9]|1[1-9][0-9])\s*inches\s*wide\b",
            r"\b\d+\s*l\s*x\s*(10[3-9]|1[1-9][0-9])\s*w\b", r"\b\d+\s*x\s*(10[3-9]|1[1-9][0-9])\s*x\s*\d+\b", r"\b\d+\s*long\s*x\s*(10[3-9]|1[1-9][0-9])\s*wide\b",
            r"\b(9|10|11|12|13|14|15|16)\s*ft\s*wide\b", r"\b(9|10|11|12|13|14|15|16)'\s*wide\b", r"\b(9|10|11|12|13|14|15|16)\s*feet\s*wide\b",
        ],
        "OD / permit / wide load detected",
    ),
    "is_overweight": (["overweight", "over weight", "heavy haul"], "overweight detected"),
    "no_conestoga": (
        ["no conestoga", "no stoga", "conestoga no", "flatbed only", "flat only", "must be flatbed", "conestoga wouldn't work", "conestoga would not work", "conestoga wont work", "conestoga won't work", "no con"],
        "Conestoga may not be accepted",
    ),
    "conestoga_ok": ([r"\bconestoga\s*ok\b", r"\bstoga\s*ok\b", r"\bconestoga\s*works\b", r"\bconestoga\s*accepted\b", r"\bconestoga\s*would\s*work\b"], "Conestoga appears acceptable"),
    "flatbed_required": (["flatbed only", "must be flatbed", "flat only", "flatbed required", "flatbed needed"], "flatbed required"),
    "flatbed_preferred": ([r"\bflatbed\s*preferred\b", r"\bprefer\s*flatbed\b", r"\bpreferred\s*flatbed\b"], "flatbed preferred; verify Conestoga acceptance"),
    "stepdeck_allowed": ([r"\bflatbed\s*or\s*step\s*deck\b", r"\bflatbed\s*/\s*step\s*deck\b", r"\bfd\s*or\s*sd\b", r"\bsd\s*or\s*fd\b", r"\bstep\s*deck\s*ok\b"], "flatbed or step deck allowed"),
    "no_box_truck": ([r"\bno\s*box\s*trucks\b", r"\bno\s*box\b"], "no box truck"),
    "forklift_required": (["forklift", "moffet", "piggyback", "loader required", "unload equipment", "unloading equipment", "driver unload"], "forklift / moffett / unloading equipment detected"),
    "ramps_required": ([r"\bneed\s*ramps\b", r"\bneeds\s*ramps\b", r"\bramps?\s*required\b", r"\bramps?\s*needed\b", r"\bramps?\s*req\b"], "ramps required"),
    "tracking_required": (["tracking req", "tracking must", "macropoint", "macro point", "trucker tools", "12 month active mc required", "12 months active mc required"], "tracking required"),
    "appointment_required": (["appt", "appointment"], "appointment required"),
    "straight_through": (["straight through", "must deliver straight", "straight thru"], "straight-through delivery detected"),
    "cash_or_zelle": ([r"\bcash\s*or\s*zelle\b", r"\bcash\s*app\b", r"\bzelle\b", r"\bcash\s*on\s*delivery\b"], "cash/Zelle payment language detected"),
    "quickpay_review": ([r"\bquick\s*pay\b"], "QuickPay language detected; check broker MC"),
    "hazmat_required": ([r"\bhaz\s*mat\b"], "hazmat required"),
    "tanker_required": ([r"\btanker\b"], "tanker endorsement required"),
    "twic_required": ([r"\btwic\b"], "TWIC required"),
    "document_required": ([r"\bus\s*citizen\b", r"\bu\.s\.\s*citizen\b", r"\bgreen\s*card\b", r"\bwork\s*permit\b", r"\bpassport\b", r"\bdriver\s*license\b", r"\bdl\s*required\b"], "driver document requirement detected"),
    "iso_tank_required": ([r"\biso\s*tank\b", r"\biso\s*tanks\b"], "ISO tank document/review warning detected"),
    "extra_pickup": ([r"\bextra\s*pick\s*up\b", r"\bextra\s*pu\b", r"\badditional\s*pickup\b", r"\badditional\s*pu\b"], "extra pickup detected"),
    "multiple_loads_available": ([r"\bmultiple\s*loads\s*available\b", r"\bmore\s*loads\s*available\b", r"\bseveral\s*loads\b"], "multiple loads available"),
    "dedicated_lane": ([r"\bdedicated\s*lane\b", r"\bneed\s*solid\s*drivers\b", r"\bneed\s*solid\s*driver\b", r"\bconsistent\s*lane\b"], "dedicated lane / solid driver language detected"),
    "double_brokering_language": ([r"\bno\s*double\s*broker\b", r"\bdouble\s*brokering\b"], "double brokering language detected"),
    "mc_must_match": ([r"\bmc\s*must\s*match\b", r"\bname\s*must\s*match\b"], "MC / carrier name must match"),
}
# Patterns of values; of several, the first that matches counts.
NO_TARP = [r"\bno\s*tarp\b", r"\bno\s*tarps\b", r"\bno\s*tarping\b", r"\bnot\s*tarp\b", r"\bnot\s*tarps\b", r"\btarp\s*not\s*required\b", r"\btarps\s*not\s*required\b", r"\btarp\s*not\s*needed\b", r"\btarps\s*not\s*needed\b"]
TARP = [
    r"\btarp\s*required\b", r"\btarps\s*required\b", r"\btarp\s*req\b", r"\btarps\s*req\b", r"\btarp\s*needed\b", r"\btarps\s*needed\b", r"\bneed\s*tarp\b", r"\bneed\s*tarps\b", r"\bneeds\s*tarp\b", r"\bneeds\s*tarps\b",
    r"\b\d+\s*ft\s*tarp\b", r"\b\d+\s*ft\s*tarps\b", r"\b\d+'\s*tarp\b", r"\b\d+'\s*tarps\b", r"\b\d+\s*foot\s*tarp\b", r"\b\d+\s*foot\s*tarps\b", r"\b(4|6|8)\s*ft\b",
]
TARP_FEET = [r"\b(4|6|8)\s*ft\s*tarps?\b", r"\b(4|6|8)'\s*tarps?\b", r"\b(4|6|8)\s*foot\s*tarps?\b", r"\bneed\s*(4|6|8)\s*ft\b", r"\b(4|6|8)\s*ft\b"]
STRAPS = r"\b(\d+)\s*straps?\b"
DIMENSIONS = [
    r"\b(\d+(?:\.\d+)?)\s*l\s*x\s*(\d+(?:\.\d+)?)\s*w\s*x\s*(\d+(?:\.\d+)?)\s*h\b",
    r"\b(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)\b",
    r"\b(\d+(?:\.\d+)?)\s*long\s*x\s*(\d+(?:\.\d+)?)\s*wide\s*x\s*(\d+(?:\.\d+)?)\s*high\b",
]
WEIGHT_UNKNOWN = [
    r"\bweight\s*needs\s*check\b", r"\bconfirm\s*weight\b", r"\bverify\s*weight\b", r"\bweight\s*tbd\b", r"\bweight\s*unknown\b", r"\bcall\s*for\s*weight\b", r"\bweight\s*1\s*lb\b", r"\bweight\s*1\s*lbs\b", r"\bposted\s*weight\s*1\b",
]
WEIGHTS = [r"\b(\d{2,3})\s*k\s*lbs\b", r"\b(\d{2,3})\s*k\s*lb\b", r"\b(\d{2,3})\s*k\b", r"\b(\d{2,3},?\d{3})\s*lbs\b", r"\b(\d{2,3},?\d{3})\s*lb\b"]
PICKUPS_DROPS = r"\b(\d+)\s*p\s*/\s*(\d+)\s*d\b"
PICKUPS = [r"\b(\d+)\s*p/u\b", r"\b(\d+)\s*pu\b", r"\b(\d+)\s*pick\b", r"\b(\d+)\s*pickup\b", r"\b(\d+)\s*pickups\b", r"\b(\d+)\s*p\b"]
DROPS = [r"\b(\d+)\s*d/o\b", r"\b(\d+)\s*del\b", r"\b(\d+)\s*drop\b", r"\b(\d+)\s*drops\b", r"\b(\d+)\s*delivery\b", r"\b(\d+)\s*deliveries\b", r"\b(\d+)\s*d\b"]
MULTISTOP = [r"\bmulti\s*stop\b", r"\bmulti\s*stops\b", r"\bmultiple\s*stops\b", r"\bmultiple\s*drops\b", r"\bmultiple\s*pickups\b"]
FCFS = r"\bfcfs\s*\d{1,2}\s*(?:am|pm)?\s*(?:-|to)\s*\d{1,2}\s*(?:am|pm)?\b"
WINDOWS = [r"\b\d{1,2}\s*(?:am|pm)\s*(?:-|to)\s*\d{1,2}\s*(?:am|pm)\b", r"\b([01]\d{3}|2[0-3]\d{2})\s*(?:-|to)\s*([01]\d{3}|2[0-3]\d{2})\b"]
READY = r"\bready\s*now\b"
ACTUAL_CITIES = [
    r"actual\s*pickup\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"actual\s*pick\s*up\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"actual\s*pu\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"actual\s*pickup\s*city\s+([a-zA-Z\s.]+),?\s+([A-Z]{2})",
    r"actual\s*pick\s*up\s*[-:]+\s*([a-zA-Z\s.]+)\s*\(\s*([A-Z]{2})\s*\)",
    r"actual\s*pickup\s*[-:]+\s*([a-zA-Z\s.]+)\s*\(\s*([A-Z]{2})\s*\)",
    r"actual\s*pu\s*[-:]+\s*([a-zA-Z\s.]+)\s*\(\s*([A-Z]{2})\s*\)",
    r"load\s*actually\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"actually\s*load\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"actually\s*loads\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"real\s*pickup\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"correct\s*pickup\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
    r"pickup\s*is\s*actually\s*in\s+([a-zA-Z\s.]+),\s*([A-Z]{2})",
]
#: The same in any case.
CITY_PATTERNS = ["(?i)" + p for p in ACTUAL_CITIES]
PHONE = r"(?i)(\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4})(?:\s*(?:x|ext|extension|ex)\s*\.?\s*(\d+))?"
EMAILS = [
    r"(?i)(?:^|[^A-Za-z0-9])((?:[A-Za-z0-9]\s+){2,}[A-Za-z0-9]\s+at\s+[A-Za-z0-9.\-]+\s+dot\s+[A-Za-z]{2,})",
    r"(?i)([A-Za-z0-9._%+\-]+\s*@\s*[A-Za-z0-9.\-]+\s*(?:\.|`|,|\s+dot\s+|\s+)\s*[A-Za-z]{2,})",
    r"(?i)([A-Za-z0-9._%+\-]+\s+at\s+[A-Za-z0-9.\-]+\s*(?:\.|\s+dot\s+|\s+)\s*[A-Za-z]{2,})",
    r"(?i)([A-Za-z0-9._%+\-]+\s*\(\s*at\s*\)\s*[A-Za-z0-9.\-]+\s*\(\s*dot\s*\)\s*[A-Za-z]{2,})",
    r"(?i)([A-Za-z0-9._%+\-]+\s*\[\s*at\s*\]\s*[A-Za-z0-9.\-]+\s*\[\s*dot\s*\]\s*[A-Za-z]{2,})",
]
# How spelled-out addresses are brought to their usual form, in this order, and what an address is.
EMAIL_STEPS = [
    ("`", "."), ("'", ""), (r"\s*\(\s*at\s*\)\s*", "@"), (r"\s*\[\s*at\s*\]\s*", "@"), (r"\s+at\s+", "@"), (r"\bat\b", "@"), (r"\s*\(\s*dot\s*\)\s*", "."),
    (r"\s*\[\s*dot\s*\]\s*", "."), (r"\s+dot\s+", "."), (r"\bdot\b", "."), (" ", ""), (",", "."), (";", "."), (r"\.{2,}", "."), (r"^[.\-_:,/]+|[.\-_:,/]+$", ""),
]
IS_EMAIL = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"
# Spellings of addresses in running text, domains that are often mistyped, and the forms of numbers.
SPELLINGS = [("`com", ".com"), ("'com", ".com"), (",com", ".com"), (";com", ".com"), (" com", ".com"), ("(at)", "@"), ("[at]", "@"), (" at ", "@"), ("(dot)", "."), ("[dot]", "."), (" dot ", ".")]
TYPOS = {"gmai.com": "gmail.com", "gmial.com": "gmail.com", "gnail.com": "gmail.com", "gmal.com": "gmail.com", "outlok.com": "outlook.com", "hotmial.com": "hotmail.com", "yaho.com": "yahoo.com"}
ADDRESS = r"([a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,})"
NUMBERS = [r"(\(\d{3}\)\s*\d{3}[-\s]?\d{4})", r"\b(\d{3}[-\s]\d{3}[-\s]\d{4})\b"]
EXTENSIONS = [r"(?i)\b(?:ext|extension)\s*\.?\s*(\d{1,6})\b", r"(?i)\bx\s*(\d{1,6})\b"]


def clean(text: Column) -> Column:
    """Lower case, separators as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "`_;|", ".   "), r"\s+", " "))


def first_match(text: Column, patterns: list[str], group: int = 1) -> Column:
    """What the first pattern that matches takes, else empty."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns), F.lit(""))


def _number(text: Column) -> Column:
    """A match as a number; an empty one is null, without the price of a failed cast."""
    return F.nullif(text, F.lit("")).try_cast("int")


def one_of(patterns: list[str]) -> str:
    return "|".join(patterns)


def flag(text: Column, name: str) -> Column:
    return text.rlike(one_of(FLAGS[name][0]))


def requires_tarp(text: Column) -> Column:
    return ~text.rlike(one_of(NO_TARP)) & text.rlike(one_of(TARP))


def weight(text: Column) -> Column:
    """Pounds between 1,000 and 100,000, given in thousands or in full; 0 without any."""
    found = []
    for p in WEIGHTS:
        n = _number(F.replace(F.regexp_extract(text, p, 1), F.lit(","), F.lit("")))
        n = F.when(n < 1000, n * 1000).otherwise(n)
        found.append(F.when(n.between(1000, 100000), n))
    return F.coalesce(*found, F.lit(0))


def stops(text: Column) -> Column:
    """Pickups and drops together; a kind that is not counted is one, `multi stop` is two, and 0 says nothing."""
    both = _number(F.regexp_extract(text, PICKUPS_DROPS, 1)) + _number(F.regexp_extract(text, PICKUPS_DROPS, 2))
    kinds = F.struct(_number(first_match(text, PICKUPS)).alias("picked"), _number(first_match(text, DROPS)).alias("dropped"))
    total = bind(kinds, lambda k: F.when(k["picked"].isNotNull() | k["dropped"].isNotNull(), F.coalesce(k["picked"], F.lit(1)) + F.coalesce(k["dropped"], F.lit(1))))
    counted = F.when(text.rlike(r"\d\s*[pd]"), total)
    return F.coalesce(both, counted, F.when(text.rlike(one_of(MULTISTOP)), 2), F.lit(0))


def pickup_time(text: Column) -> Column:
    window = first_match(text, WINDOWS, 0)
    fcfs = F.coalesce(F.nullif(F.upper(F.regexp_extract(text, FCFS, 0)), F.lit("")), F.lit("FCFS - NEEDS HOURS CHECK"))
    return F.when(text.contains("fcfs"), fcfs).when(window != "", F.upper(window)).when(text.rlike(READY), "Ready now").when(flag(text, "appointment_required"), "Appointment required").otherwise("")


def actual_city(said: Column) -> Column:
    """`City, ST` of the place that the notes call the actual pickup."""
    places = [F.when(said.rlike(p), F.concat(F.btrim(F.regexp_extract(said, p, 1), F.lit(" .,-:")), F.lit(", "), F.upper(F.regexp_extract(said, p, 2)))) for p in CITY_PATTERNS]
    return F.when(said.rlike(r"(?i)actual|(?:real|correct)\s*pickup"), F.coalesce(*places, F.lit(""))).otherwise("")


def normal_email(text: Column) -> Column:
    """An address however it is spelled out, in lower case; empty if it is none."""
    email = F.lower(F.trim(text))
    for pattern, by in EMAIL_STEPS:
        email = F.regexp_replace(email, pattern, by)
    return F.when(email.rlike(IS_EMAIL), email).otherwise("")


def email(said: Column) -> Column:
    """The first address in any of the spellings; texts without an `@` or `at` are not searched."""
    return F.when(~said.rlike(r"@|(?i)\bat\b"), "").otherwise(F.coalesce(*(F.nullif(normal_email(F.regexp_extract(said, p, 1)), F.lit("")) for p in EMAILS), F.lit("")))


def summary(said: Column, p: dict[str, Column]) -> Column:
    """The sentences of what was found, in their order."""
    sentence = {n: F.when(p[n], F.lit(s)) for n, (_, s) in FLAGS.items()}
    value = lambda n, label: F.when(p[n].cast("string").isin("", "0"), None).otherwise(F.concat(F.lit(label), p[n].cast("string")))
    contact = F.concat_ws(" / ", F.when(p["phone"] != "", F.concat(p["phone"], F.when(p["extension"] != "", F.concat(F.lit(" x"), p["extension"])).otherwise(""))), F.nullif(p["email"], F.lit("")))
    special = {
        "requires_tarp": F.when(p["requires_tarp"], F.trim(F.concat(p["tarp_size"], F.lit(" tarps detected")))),
        "requires_straps": F.when(p["requires_straps"], F.when(p["strap_count"] > 0, F.concat(p["strap_count"].cast("string"), F.lit(" straps required"))).otherwise("straps required")),
        "dimensions": value("dimensions", "dimensions detected: "),
        "weight_unknown": F.when(p["weight_unknown"], "posted weight may be incorrect / must verify real weight"),
        "detected_weight": value("detected_weight", "weight detected from notes: "),
        "detected_stops": value("detected_stops", "stops detected from notes: "),
        "detected_pickup_time": value("detected_pickup_time", "pickup time detected from notes: "),
        "contact": F.when(contact != "", F.concat(F.lit("contact override detected: "), contact)),
        "actual_pickup_city": value("actual_pickup_city", "actual pickup city detected from notes: "),
    }
    return F.array_compact(F.array(*((sentence | special)[n] for n in SUMMARY)))


#: The order of the summary: what is asked for, what was read, then what else the notes say.
_LAST = ["extra_pickup", "multiple_loads_available", "dedicated_lane", "double_brokering_language", "mc_must_match"]
_VALUES = ["weight_unknown", "detected_weight", "detected_stops", "detected_pickup_time", "contact", "actual_pickup_city"]
_FIRST = [n for n in FLAGS if n not in _LAST]
SUMMARY = ["requires_tarp", *_FIRST[:2], "dimensions", *_FIRST[2:], *_VALUES, *_LAST]


def readings(said: Column, text: Column, one_pound: Column) -> dict[str, Column]:
    """What one text says, by name; `text` is the cleaned form of `said`."""
    feet = first_match(text, TARP_FEET)
    return {
        "requires_tarp": requires_tarp(text), "tarp_size": F.when(feet == "", "").otherwise(F.concat(feet, F.lit(" ft"))),
        **{n: flag(text, n) for n in FLAGS}, "strap_count": F.coalesce(_number(F.regexp_extract(text, STRAPS, 1)), F.lit(0)),
        **{n: first_match(text, DIMENSIONS, g) for g, n in enumerate(("dimensions", "length", "width", "height"))},
        "weight_unknown": one_pound | text.rlike(one_of(WEIGHT_UNKNOWN)), "detected_weight": weight(text), "detected_stops": stops(text), "detected_pickup_time": pickup_time(text),
        "phone": F.regexp_replace(F.regexp_extract(said, PHONE, 1), r"\s+", " "), "extension": F.regexp_extract(said, PHONE, 2), "email": email(said), "actual_pickup_city": actual_city(said),
    }


def read_text(said: Column, one_pound: Column) -> Column:
    """All readings of one text and their sentences, as a struct.

    The cleaned text is bound before it is read, and the readings before they are summed up: no pattern runs twice, however often its
    reading is used, and the stage's generated code holds one call instead of all patterns.
    """
    names = readings(F.lit(""), F.lit(""), F.lit(False))
    read = lambda text: F.struct(*(c.alias(n) for n, c in readings(said, text, one_pound).items()))
    told = lambda p: F.struct(*(p[n] for n in names), summary(said, {n: p[n] for n in names}).alias("summary"))
    return bind(bind(clean(said), read), told)


def parse_notes(rows: DataFrame, notes: str = "notes", commodity: str | None = "commodity", posted: str | None = "posted", posted_weight: str | None = "weight") -> DataFrame:
    """Rows with a struct `parsed` of all that notes, commodity and posted trailer say; null texts are empty.

    A text is read once, however many rows say it: partitions drop their own repeats before distinct texts meet, and rows get their
    readings by an equi-join on the text, whose text side has one row for each. Boards repost and copy notes, so the
    patterns, which are by far the dearest part, run over a fraction of the rows; a text that many rows share is one row of one
    side, and the other side is split where it is skewed.
    """
    parts = [F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (notes, commodity, posted) if c]
    one_pound = F.coalesce(F.col(posted_weight).try_cast("double").try_cast("long") == 1, F.lit(False)) if posted_weight else F.lit(False)
    rows = rows.withColumns({"__said": F.concat_ws(" ", *parts), "__one_pound": one_pound})
    read = rows.select("__said", "__one_pound").distinct().select("__said", "__one_pound", read_text(F.col("__said"), F.col("__one_pound")).alias("parsed"))
    return rows.join(read, ["__said", "__one_pound"]).drop("__said", "__one_pound")


def emails(text: Column) -> Column:
    """All addresses in order, each once, in lower case, spelled-out and mistyped ones mended."""
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.regexp_replace(F.regexp_replace(text, r"\s*@\s*", "@"), r"\s*\.\s*", ".")

    def mended(address: Column) -> Column:
        address = F.lower(address)
        for wrong, right in TYPOS.items():
            address = F.regexp_replace(address, wrong.replace(".", r"\.") + "$", right)
        return address

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(1)), mended))


def phones(text: Column) -> Column:
    """All numbers of ten digits as `(ddd) ddd-dddd`, each once; those with a bracketed area code first."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NUMBERS))
    return F.array_distinct(F.transform(found, lambda p: F.regexp_replace(F.regexp_replace(p, "[^0-9]", ""), r"^(\d{3})(\d{3})(\d{4})$", r"($1) $2-$3")))


def extensions(text: Column) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in EXTENSIONS)))


def contact_summary(phones: Column, extensions: Column, emails: Column) -> Column:
    """Numbers with the first extension, then addresses, joined by ` / `."""
    ext = F.element_at(F.concat(extensions, F.array(F.lit(""))), 1)
    told = F.transform(phones, lambda p: F.when(ext != "", F.concat(p, F.lit(" ext "), ext)).otherwise(p))
    return F.array_join(F.concat(told, emails), " / ")
