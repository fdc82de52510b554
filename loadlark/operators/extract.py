"""Document extraction: lines, candidates, contexts, resolvers, fusion, evaluation."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of candidates and of private details.
MONEY = r"\$[0-9][0-9,]*\.[0-9]{2}"
EMAIL = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]"
PHONE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
SECRET = r"[0-9a-f]{32,64}"
#: What a rate confirmation says about a load.
CONFIRMED = ["reference_id", "broker_name", "broker_mc", "pickup", "pickup_date", "delivery", "rate", "empty_miles", "weight"]


def lines(docs: DataFrame, id_col: str | list[str], text: Column) -> DataFrame:
    """One row per line with its number; empty lines stay."""
    return docs.select(*([id_col] if isinstance(id_col, str) else id_col), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def with_context(rows: DataFrame, id_col: str) -> DataFrame:
    """Previous and next line of each line, and the window of two lines to both sides."""
    order = Window.partitionBy(id_col).orderBy("line_no")
    return rows.withColumns({"prev_line": F.lag("line").over(order), "next_line": F.lead("line").over(order), "context": F.array_join(F.collect_list("line").over(order.rowsBetween(-2, 2)), "\n")})


def carry_section(rows: DataFrame, id_col: str | list[str]) -> DataFrame:
    """The section that the last section line before, or the line itself, opens."""
    opened = F.when(F.col("line").startswith("PICKUP"), "pickup").when(F.col("line").startswith("DELIVERY"), "delivery").when(F.col("line").startswith("RATE"), "rate").when(F.col("line").startswith("TERMS"), "terms")
    order = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last(opened, ignorenulls=True).over(order), F.lit("header")))


def rate_confirmations(loads: DataFrame, own: tuple[str, ...] = ("load_id",)) -> DataFrame:
    """The text of a rate confirmation for each load, written from its columns."""
    money = lambda c: F.concat(F.lit("$"), c.cast("string"), F.lit(".00"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("LOAD NUMBER: "), F.col("reference_id")), F.concat(F.lit("BROKER: "), F.col("broker_name"), F.lit(" MC "), F.col("broker_mc")),
        F.lit("PICKUP"), F.concat(F.lit("Location: "), F.col("pickup")), F.concat(F.lit("Date: "), F.col("pickup_date").cast("string")),
        F.lit("DELIVERY"), F.concat(F.lit("Location: "), F.col("delivery")),
        F.lit("RATE"), F.concat(F.lit("Line haul: "), money(F.col("rate") - F.col("empty_miles"))), F.concat(F.lit("Fuel surcharge: "), money(F.col("empty_miles"))), F.concat(F.lit("Total carrier rate: "), money(F.col("rate"))),
        F.lit("TERMS"), F.concat(F.lit("Late fee up to "), money(F.floor(F.col("weight") / 100))), F.concat(F.lit("Weight: "), F.col("weight"), F.lit(" lbs")),
    )
    return loads.select(*own, text.alias("text"))


def money_candidates(rows: DataFrame) -> DataFrame:
    """Every amount of every line with the context that its label and section give, and a confidence in percent."""
    hits = rows.select("*", F.posexplode(F.regexp_extract_all("line", F.lit(f"({MONEY})"), F.lit(1))).alias("hit", "raw"))
    low = F.lower("line")
    kind = F.when(low.contains("total"), "TOTAL").when(low.contains("line haul"), "LINE_HAUL").when(low.contains("fuel"), "ACCESSORIAL").when(low.contains("fee"), "PENALTY").otherwise("OTHER")
    amount = F.regexp_replace("raw", r"[$,]", "").cast("double")
    base = F.when(kind == "TOTAL", 90).when(kind == "LINE_HAUL", 70).when(kind == "ACCESSORIAL", 40).when(kind == "PENALTY", 10).otherwise(30)
    return hits.withColumns({"kind": kind, "amount": amount, "confidence": base + F.when(F.col("section") == "rate", 5).otherwise(0)})


def abstain(candidates: DataFrame, id_col: str) -> DataFrame:
    """Cap candidates that aren't totals where their document has an explicit total, and penalties always."""
    has_total = F.max(F.when(F.col("kind") == "TOTAL", 1).otherwise(0)).over(Window.partitionBy(id_col)) == 1
    return candidates.withColumn("capped", F.when(F.col("kind") == "PENALTY", F.least("confidence", F.lit(35))).when(has_total & (F.col("kind") != "TOTAL"), F.least("confidence", F.lit(55))).otherwise(F.col("confidence")))


# Kinds of amounts by what their line holds, in order, with their confidence in percent; the cap of each kind.
KINDS = [("total", "TOTAL", 90), ("line haul", "LINE_HAUL", 70), ("fuel", "ACCESSORIAL", 40), ("fee", "PENALTY", 10)]
_SECTIONS = ("PICKUP", "DELIVERY", "RATE", "TERMS")


def _amounts(lists: pa.Array) -> pa.Array:
    """document_amounts of one Arrow batch."""
    from .layout import lines_of

    row, text, _, lines = lines_of(lists)
    place = np.arange(len(lines))
    opened = np.select([pc.starts_with(lines, s).to_numpy(zero_copy_only=False) for s in _SECTIONS], range(1, len(_SECTIONS) + 1), 0)
    last = np.maximum.accumulate(np.where(opened > 0, place, -1)) if len(lines) else place
    in_rate = (last >= 0) & (text[last] == text) & (opened[last] == 1 + _SECTIONS.index("RATE"))

    at = np.flatnonzero(pc.match_substring(lines, "$").to_numpy(zero_copy_only=False))
    hits = [re.findall(MONEY, line) for line in lines.take(pa.array(at)).to_pylist()]
    at = np.repeat(at, [len(h) for h in hits])
    amount = np.array([float(raw[1:].replace(",", "")) for h in hits for raw in h])
    low = pc.utf8_lower(lines.take(pa.array(at)))
    kind = np.select([pc.match_substring(low, term).to_numpy(zero_copy_only=False) for term, _, _ in KINDS], range(len(KINDS)), len(KINDS))
    names, base = [k for _, k, _ in KINDS] + ["OTHER"], np.array([c for _, _, c in KINDS] + [30])
    of, sure = row[text[at]], base[kind] + 5 * in_rate[at]
    has_total = np.bincount(of[kind == 0], minlength=len(lists)) > 0
    capped = np.where(kind == names.index("PENALTY"), np.minimum(sure, 35), np.where(has_total[of] & (kind != 0), np.minimum(sure, 55), sure))
    found = pa.StructArray.from_arrays([pa.array(names).take(pa.array(kind)), pa.array(amount, pa.float64()), pa.array(capped, pa.int32())], ["kind", "amount", "capped"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(lists)))), pa.int32()), found)


def document_amounts(texts: Column) -> Column:
    """money_candidates of a row's texts, capped by abstain over all of them, as an array of kind, amount and capped; an Arrow batch is read at once."""
    return F.arrow_udf(_amounts, "array<struct<kind:string,amount:double,capped:int>>")(texts)


def resolve(candidates: DataFrame, id_col: str, low: int = 60) -> DataFrame:
    """The best candidate of each document; a conflict if another value is as strong as the threshold; value blank then, candidate kept."""
    rank = Window.partitionBy(id_col).orderBy(F.desc("capped"), F.desc("amount"), "line_no", "hit")
    ranked = candidates.withColumn("place", F.row_number().over(rank)).withColumn("best_amount", F.first("amount").over(rank))
    found = ranked.groupBy(id_col).agg(
        F.max(F.when(F.col("place") == 1, F.col("amount"))).alias("selected"), F.max(F.when(F.col("place") == 1, F.col("capped"))).alias("confidence"),
        F.max(F.when(F.col("place") == 1, F.col("kind"))).alias("kind"), F.count_if((F.col("amount") != F.col("best_amount")) & (F.col("capped") >= low)).alias("rivals"),
    )
    status = F.when(F.col("confidence") < low, "LOW_CONFIDENCE").when(F.col("rivals") > 0, "CONFLICT").otherwise("RESOLVED")
    return found.select(id_col, "selected", "confidence", "kind", "rivals", status.alias("status"), F.when(status == "RESOLVED", F.col("selected")).alias("value"))


def equivalence_groups(candidates: DataFrame, id_col: str | list[str]) -> DataFrame:
    """Equal amounts of a document: how often and in which contexts they stand."""
    return candidates.groupBy(*([id_col] if isinstance(id_col, str) else id_col), "amount").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def redact(text: Column) -> Column:
    """E-mails, phones, addresses and secrets replaced by their kind."""
    for pattern, name in ((EMAIL, "<EMAIL>"), (PHONE, "<PHONE>"), (SECRET, "<SECRET>"), (IPV4, "<IP>")):
        text = F.regexp_replace(text, pattern, name)
    return text


def shape(text: Column) -> Column:
    """Letters and digits by kind; what a value looks like without what it says."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[A-Z]", "A"), "[a-z]", "a"), "[0-9]", "9")


def precision_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """predicted and gold in 0, 1 or null: counts, precision and recall in basis points of exact division."""
    correct, said, wanted = F.count_if((F.col("predicted") == 1) & (F.col("gold") == 1)), F.count_if(F.col("predicted") == 1), F.count_if(F.col("gold") == 1)
    share = lambda a, b: F.coalesce(F.floor(a * 10000 / F.when(b != 0, b)), F.lit(0)).cast("long")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correct.alias("correct"), said.alias("said"), wanted.alias("wanted"), share(correct, said).alias("precision_bp"), share(correct, wanted).alias("recall_bp"))
