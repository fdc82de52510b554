"""Freight views over the star tables: loads, requests, cases and feedback, derived with whole-number arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import mileage_bucket, rate_per_mile

# Fixed values of the derived views.
CITIES = ["Dallas, TX", "Houston, TX", "Chicago, IL", "Columbus, OH", "Atlanta, GA", "Nashville, TN", "Miami, FL", "Denver, CO", "Phoenix, AZ", "Reno, NV", "Seattle, WA", "Portland, OR", "Newark, NJ", "Boston, MA", "Charlotte, NC", "Birmingham, AL", "Memphis, TN", "Detroit, MI", "Tulsa, OK", "Fresno, CA"]
NOTES = ["", "tarps required", "need 8 ft tarps", "no tarp needed", "hazmat load", "twic card needed", "tracking required macropoint", "us citizen only", "flatbed only", "flatbed preferred", "oversize permit required", "quickpay available", "cash or zelle", "ramps required", "tanker endorsement", "must provide wood", None, "HAZMAT LOAD", "8FT TARPS REQ", "No Conestogas", "U.S. Citizen, TWIC CARD", "Wide Load, Tarps not required",
    "6 straps, 48k lbs, 2P/1D, FCFS 8am-3pm", "58L x 111W x 7H, need 6 ft, call 555-123-4567 ext 45", "Actual pickup in Gary, IN; 1 pickup 2 drops", "email dispatch at example dot com, pickup 0800-1400",
    "Acme Freight | MC# 445566 | Contact: (555) 111-2222 joe@gmai.com | Reference ID: AB-12 | Credit Score: 91 | Days to Pay: 27 | factoring eligible",
    "No buy | MC #77 | name must match, no double brokering", "ready now, multi stop, verify weight, stepdeck ok", "driver unload, appt only, straight thru, extra pickup, several loads, dedicated lane, no box trucks"]
TRAILERS = ["Flatbed", "Step Deck", "Van", "Conestoga", "FD"]
COMMODITIES = ["Steel coils", "Lumber", "Machinery", None, "Hazardous resin", "ISO TANK"]
VERBS = {"click": "called_broker", "error": "bad_broker", "purchase": "booked", "signup": "sent_to_driver", "view": "skipped"}
REQUESTS = [
    ("alex", "Flatbed", 45000, 200, 2.0, "midwest", "", "Atlanta, GA", True, "8 ft", True, None, False, True, True, None, None, True, None),
    ("boris", "Conestoga", 40000, 150, 2.5, "texas", "dallas", "Memphis, TN", None, "", True, False, None, None, False, False, True, None, True),
    ("carl", "Step Deck", 47000, 250, 0.0, "northeast", "", "Charlotte, NC", True, "4 ft", False, True, True, False, None, None, None, False, False),
    ("dan", "Flatbed", 0, 0, 1.5, "west", "phoenix", "Denver, CO", False, "", True, None, None, None, False, False, False, True, True),
    ("finn", "Conestoga", 46000, None, None, " TX", "", "", True, "8ft", None, None, None, None, None, None, None, None, None),
    ("egor", "Flatbed", 48000, 100, 3.0, "southeast", "", "Nashville, TN", None, "6 ft", None, True, None, True, None, True, None, None, None),
]
REQUEST_FIELDS = "driver string, equipment string, max_weight long, max_empty long, min_rpm double, target string, target_city string, location string, can_tarp boolean, tarp_size string, tracking_ok boolean, hazmat boolean, tanker boolean, twic boolean, us_citizen boolean, green_card boolean, work_permit boolean, ramps boolean, dunnage boolean"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str | None], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values)).cast("int") + 1)


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load for each line item; its broker is the supplier, its places follow the customer's and supplier's nations.

    A load's id holds order, line, part and quantity, as lines of an order share their number. Line items are dealt out by order,
    at any size: that is how they meet orders too large to broadcast, and a table in a single row group still fills all cores.
    Orders meet their customers first, so that line items are never dealt out by customer.
    """
    return _loads(table(spark, sf_dir, "lineitem").repartition("l_orderkey"), spark, sf_dir)


#: The columns by which loads that lie by order are grouped by id, where they are.
OWN = ["order_no", "load_id"]


def loads_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads with the number of their order, in whose partition all of them lie: grouping them by OWN moves no row.

    An id tells its order, unless a line's number, part or quantity is beyond its digits. With any such line, which the
    footers of the table's files mostly rule out, all loads are dealt out by id instead, and their order's number is left empty.
    """
    parts, line = int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf_dir, "lineitem")
    beyond = [f"{c} IS NULL OR {c} < 0 OR {c} >= {n}" for c, n in (("l_linenumber", 10), ("l_partkey", 1 << 62), ("l_quantity", 100))]
    if line.where(" OR ".join(beyond)).isEmpty():
        return _loads(line.repartition(parts, "l_orderkey"), spark, sf_dir, F.col("l_orderkey").alias("order_no"))
    return loads(spark, sf_dir).repartition(parts, "load_id").withColumn("order_no", F.lit(None).cast("long"))


def _loads(line: DataFrame, spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    order = order.join(customer, order.o_custkey == customer.c_custkey)
    rows = line.join(order, line.l_orderkey == order.o_orderkey).join(supplier, line.l_suppkey == supplier.s_suppkey)
    key, number, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    load_id = (key * 10 + number) * 100_000_000 + part % 1_000_000 * 100 + F.col("l_quantity").cast("long")
    loaded, empty = part % 1800, (F.col("l_suppkey") * 7 + number * 13) % 300
    rate = F.when(part % 37 == 0, 0).otherwise(F.floor(F.col("l_extendedprice") / 10)).cast("long")
    return rows.select(
        *more, load_id.alias("load_id"), rate.alias("rate"), loaded.alias("loaded_miles"), empty.alias("empty_miles"), (loaded + empty).alias("total_miles"),
        rate_per_mile(rate, loaded + empty).alias("total_rpm"), mileage_bucket(loaded, loaded + empty).alias("bucket"),
        (F.col("l_quantity").cast("long") * 1000).alias("weight"),
        pick(CITIES, F.col("c_nationkey") + number).alias("pickup"), F.when(part % 89 != 0, pick(CITIES, F.col("s_nationkey") * 3 + part)).alias("delivery"),
        pick(NOTES, part + key).alias("notes"), pick(TRAILERS, F.col("l_suppkey")).alias("posted"), pick(COMMODITIES, part + number).alias("commodity"),
        F.col("l_suppkey").cast("string").alias("broker_mc"), F.col("s_name").alias("broker_name"),
        F.when(key % 11 == 0, "needs check").otherwise(F.concat(F.lit("REF"), key)).alias("reference_id"),
        F.to_date("l_shipdate").alias("pickup_date"), part.alias("part_no"),
    )


def requests(spark: SparkSession) -> DataFrame:
    """The drivers' search requests: a handful of rows, broadcast by every query."""
    return spark.createDataFrame(REQUESTS, REQUEST_FIELDS)


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dispatch case for each order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("case_id"), F.concat(F.lit("driver"), customer % 40).alias("driver"),
        pick(CITIES, customer).alias("pickup"), pick(CITIES, key).alias("delivery"),
        (key % 97).cast("string").alias("broker_mc"), F.floor(F.col("o_totalprice") / 10).cast("long").alias("rate"),
        (key % 1800).alias("loaded_miles"),
        F.when(F.col("o_orderstatus") == "F", "BOOKED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("REVIEW").alias("status"),
        F.substring("o_orderpriority", 1, 1).alias("category"), F.col("o_orderdate").alias("created_at"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dispatcher answer for each event, on a case chosen by the event's id from the whole range of orders."""
    n = table(spark, sf_dir, "orders").count()
    verb = F.create_map(*(F.lit(x) for pair in VERBS.items() for x in pair))[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("feedback_id"), (F.col("event_id") * 7 % F.lit(n)).alias("case_number"), F.concat(F.lit("driver"), F.col("user_id") % 40).alias("driver"), verb.alias("verb"), "ts", "value")


# The same views for DuckDB.
def _sql_pick(values: list[str | None], number: str) -> str:
    return "([" + ", ".join(map(_sql_value, values)) + f"])[CAST(({number}) % {len(values)} AS INTEGER) + 1]"


def _sql_value(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


LOADS_SQL = f"""
load_base AS (
  SELECT (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey % 1000000 * 100 + CAST(l_quantity AS BIGINT) AS load_id,
         CASE WHEN l_partkey % 37 = 0 THEN 0 ELSE CAST(floor(l_extendedprice / 10) AS BIGINT) END AS rate,
         l_partkey % 1800 AS loaded_miles, (l_suppkey * 7 + l_linenumber * 13) % 300 AS empty_miles,
         l_partkey % 1800 + (l_suppkey * 7 + l_linenumber * 13) % 300 AS total_miles,
         CAST(l_quantity AS BIGINT) * 1000 AS weight,
         {_sql_pick(CITIES, "c_nationkey + l_linenumber")} AS pickup, CASE WHEN l_partkey % 89 <> 0 THEN {_sql_pick(CITIES, "s_nationkey * 3 + l_partkey")} END AS delivery,
         {_sql_pick(NOTES, "l_partkey + l_orderkey")} AS notes, {_sql_pick(TRAILERS, "l_suppkey")} AS posted, {_sql_pick(COMMODITIES, "l_partkey + l_linenumber")} AS commodity, l_partkey AS part_no,
         CAST(l_suppkey AS VARCHAR) AS broker_mc, s_name AS broker_name,
         CASE WHEN l_orderkey % 11 = 0 THEN 'needs check' ELSE 'REF' || l_orderkey END AS reference_id,
         CAST(l_shipdate AS DATE) AS pickup_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
), loads AS (
  SELECT *, CASE WHEN total_miles = 0 THEN 0.0 ELSE CAST((200 * rate + total_miles) // (2 * total_miles) AS DOUBLE) / 100 END AS total_rpm,
         CASE WHEN m < 450 THEN '0-450' WHEN m < 700 THEN '450-700' WHEN m < 1300 THEN '700-1300' ELSE '1300+' END AS bucket
  FROM (SELECT *, CASE WHEN loaded_miles <> 0 THEN loaded_miles ELSE total_miles END AS m FROM load_base)
)"""
REQUESTS_SQL = "requests(" + ", ".join(f.split()[0] for f in REQUEST_FIELDS.split(", ")) + ") AS (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in REQUESTS) + ")"
CASES_SQL = f"""
cases AS (
  SELECT o_orderkey AS case_id, 'driver' || (o_custkey % 40) AS driver, {_sql_pick(CITIES, "o_custkey")} AS pickup, {_sql_pick(CITIES, "o_orderkey")} AS delivery,
         CAST(o_orderkey % 97 AS VARCHAR) AS broker_mc, CAST(floor(o_totalprice / 10) AS BIGINT) AS rate, o_orderkey % 1800 AS loaded_miles,
         CASE o_orderstatus WHEN 'F' THEN 'BOOKED' WHEN 'O' THEN 'OPEN' ELSE 'REVIEW' END AS status,
         substr(o_orderpriority, 1, 1) AS category, o_orderdate AS created_at
  FROM orders
)"""
FEEDBACK_SQL = "feedback AS (SELECT event_id AS feedback_id, event_id * 7 % (SELECT count(*) FROM orders) AS case_number, 'driver' || (user_id % 40) AS driver, CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VERBS.items()) + " END AS verb, ts, value FROM events)"
