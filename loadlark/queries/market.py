"""Queries over loads and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators.decisions import with_priority
from ..plans.rules import MATCHES_SQL, match_loads, reasons_of, with_reasons
from ..sources.views import CITIES, LOADS_SQL, REQUESTS_SQL, loads, requests

BASE = f"WITH {LOADS_SQL}, {REQUESTS_SQL}, {MATCHES_SQL}"
AVG = "CASE WHEN {n} = 0 THEN 0 ELSE CAST((2 * {s} + {n}) // (2 * {n}) AS BIGINT) END"


def avg_sql(value: str, condition: str) -> str:
    n, s = f"count(*) FILTER (WHERE {condition})", f"coalesce(sum({value}) FILTER (WHERE {condition}), 0)"
    return "CAST(" + AVG.format(n=n, s=s) + " AS BIGINT)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_loads(loads(spark, sf_dir), requests(spark))


def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the first post of each load: reposts are dropped before loads meet requests."""
    return match_loads(M.first_posts(loads(spark, sf_dir)), requests(spark))


def driver_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_reasons(matches(spark, sf_dir)).select("driver", "load_id", "status", F.array_join("reasons", " | ").alias("reasons"), "qualified", "good", F.col("score").cast("long").alias("score"))


DRIVER_MATCH_SQL = BASE + " SELECT driver, load_id, status, array_to_string(reasons, ' | ') AS reasons, qualified, good, CAST(score AS BIGINT) AS score FROM matches"


def flagship_bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.bucket_stats(matches(spark, sf_dir), ["driver"]).drop("bucket_order")


STATS_SQL = f"""{BASE}, stats AS (
  SELECT driver, bucket, count(*) AS total_loads, count(*) FILTER (WHERE qualified) AS qualified_loads, count(*) FILTER (WHERE good) AS good_loads,
         count(*) FILTER (WHERE good AND status = 'MATCH') AS clean_match_loads, count(*) FILTER (WHERE good AND status = 'REVIEW_ONCE') AS review_once_loads,
         count(*) FILTER (WHERE status = 'BLOCK') AS blocked_loads, CAST({avg_sql("CAST(round(total_rpm * 100) AS BIGINT)", "true")} AS DOUBLE) / 100 AS avg_total_rpm,
         {avg_sql("rate", "true")} AS avg_rate, {avg_sql("score", "true")} AS avg_opportunity_score, {avg_sql("score", "qualified")} AS avg_qualified_score,
         {avg_sql("score", "good")} AS avg_good_score, {avg_sql("score", "good AND status = 'MATCH'")} AS avg_clean_match_score,
         {avg_sql("score", "good AND status = 'REVIEW_ONCE'")} AS avg_review_once_score
  FROM matches GROUP BY driver, bucket
), keys AS (SELECT DISTINCT driver, b.bucket, b.o FROM matches, (VALUES ('0-450', 0), ('450-700', 1), ('700-1300', 2), ('1300+', 3)) b(bucket, o)
), all_stats AS (
  SELECT k.driver, k.bucket, k.o, {", ".join(f"coalesce({c}, 0) AS {c}" for c in "total_loads qualified_loads good_loads clean_match_loads review_once_loads blocked_loads avg_total_rpm avg_rate avg_opportunity_score avg_qualified_score avg_good_score avg_clean_match_score avg_review_once_score".split())}
  FROM keys k LEFT JOIN stats s ON k.driver = s.driver AND k.bucket = s.bucket
), fit AS (
  SELECT driver, count(*) FILTER (WHERE good AND status = 'MATCH') AS clean_matches, count(*) FILTER (WHERE good AND status = 'REVIEW_ONCE') AS review_once,
         count(*) FILTER (WHERE status = 'BLOCK') AS blocked, count(*) FILTER (WHERE qualified) AS qualified, count(*) FILTER (WHERE good) AS good
  FROM matches GROUP BY driver
), fits AS (
  SELECT *, CASE WHEN clean_matches >= 3 THEN 'GOOD' WHEN clean_matches >= 1 THEN 'WORKABLE' WHEN review_once >= 3 THEN 'REVIEW_ONLY' WHEN review_once >= 1 THEN 'WEAK_FIT' ELSE 'NO_MATCH' END AS driver_fit FROM fit
)"""
BUCKET_SQL = STATS_SQL + " SELECT * EXCLUDE (o) FROM all_stats"


def driver_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.fit_stats(matches(spark, sf_dir), ["driver"])


FIT_SQL = STATS_SQL + " SELECT * FROM fits"


def market_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir)
    return M.recommend(M.bucket_stats(rows, ["driver"]), M.fit_stats(rows, ["driver"]), ["driver"])


RECOMMEND_SQL = STATS_SQL + """, scored AS (
  SELECT *, row_number() OVER (PARTITION BY driver ORDER BY clean_match_loads * 600 + good_loads * 360 + qualified_loads * 240 + avg_clean_match_score * 15 + avg_good_score * 8 DESC, o) AS rn FROM all_stats
), best AS (
  SELECT driver, max(bucket) FILTER (WHERE rn = 1) AS best_bucket, CAST(sum(good_loads) AS BIGINT) AS total_good, CAST(sum(qualified_loads) AS BIGINT) AS total_qualified FROM scored GROUP BY driver
)
SELECT driver, best_bucket, total_good, total_qualified, clean_matches, review_once, blocked, driver_fit,
       CASE WHEN total_good >= 6 THEN 'GOOD' WHEN total_good >= 3 THEN 'MEDIUM' WHEN total_qualified >= 2 THEN 'WEAK' ELSE 'BAD' END AS market_activity,
       CASE driver_fit WHEN 'GOOD' THEN 'STRONG_MATCHES_AVAILABLE' WHEN 'WORKABLE' THEN 'SOME_MATCHES_AVAILABLE' WHEN 'REVIEW_ONLY' THEN 'REVIEW_ONLY' WHEN 'WEAK_FIT' THEN 'WEAK_FIT' ELSE 'NO_CLEAN_MATCHES' END AS action_status
FROM best JOIN fits USING (driver)"""

DEDUPED_SQL = """, keyed AS (
  SELECT *, CASE WHEN lower(trim(reference_id)) NOT IN ('', '-', 'n/a', 'na', 'needs check', 'no id', 'none', 'null', 'unknown') THEN concat_ws('|', 'REF', lower(reference_id), lower(pickup), lower(delivery), CAST(pickup_date AS VARCHAR))
         ELSE concat_ws('|', 'MC', lower(broker_mc), lower(pickup), lower(delivery), CAST(pickup_date AS VARCHAR)) END AS repost_key FROM {source}
), deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by}repost_key ORDER BY load_id, rate, loaded_miles, empty_miles, weight) AS rn FROM keyed) WHERE rn = 1)"""


def repost_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.first_posts(loads(spark, sf_dir)).select("repost_key", "load_id")


REPOST_SQL = f"WITH {LOADS_SQL}" + DEDUPED_SQL.format(source="loads", by="") + " SELECT repost_key, load_id FROM deduped"


def market_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.baseline(first_matches(spark, sf_dir), ["driver"])


_MEDIAN = "(list_sort({x})[(len({x}) + 1) // 2] + list_sort({x})[len({x}) // 2 + 1])"
BASELINE_SQL = BASE + DEDUPED_SQL.format(source="matches", by="driver, ") + f""", viewed AS (
  SELECT driver, rate, status, qualified, CAST(round(total_rpm * 100) AS BIGINT) AS rpm,
         CASE WHEN m <= 400 THEN '0-400' WHEN m <= 700 THEN '400-700' WHEN m <= 1300 THEN '700-1300' ELSE '1300+' END AS bucket,
         CASE WHEN contains(lower(posted), 'stoga') THEN 'conestoga' WHEN contains(lower(posted), 'flatbed') THEN 'flatbed' ELSE 'other' END AS equipment_view
  FROM (SELECT * REPLACE (CASE WHEN loaded_miles > 0 THEN loaded_miles ELSE total_miles END AS m) FROM deduped)
), grouped AS (
  SELECT driver, coalesce(bucket, 'ALL') AS bucket, coalesce(equipment_view, 'ALL') AS equipment_view, count(*) AS load_count, count(*) FILTER (WHERE qualified) AS qualified_count,
         count(*) FILTER (WHERE status = 'MATCH') AS clean_match_count, count(*) FILTER (WHERE status = 'REVIEW_ONCE') AS review_once_count, count(*) FILTER (WHERE status = 'BLOCK') AS blocked_count,
         count(*) FILTER (WHERE rate <= 0) AS rate_check_count, CAST({avg_sql("rpm", "rpm > 0")} AS DOUBLE) / 100 AS avg_rpm, {avg_sql("rate", "rate > 0")} AS avg_rate,
         coalesce(list_sort(list(rpm) FILTER (WHERE rpm > 0)), []) AS rpms, coalesce(list_sort(list(rate) FILTER (WHERE rate > 0)), []) AS rates
  FROM viewed GROUP BY GROUPING SETS ((driver), (driver, bucket), (driver, equipment_view), (driver, bucket, equipment_view))
), halves AS (
  SELECT *, CASE WHEN len(rpms) = 1 THEN rpms ELSE rpms[1:len(rpms) // 2] END AS low, CASE WHEN len(rpms) = 1 THEN rpms ELSE rpms[len(rpms) - len(rpms) // 2 + 1:len(rpms)] END AS high FROM grouped
), medians AS (
  SELECT *, coalesce({_MEDIAN.format(x="rpms")}, 0) AS m2, coalesce({_MEDIAN.format(x="rates")}, 0) AS r2, coalesce({_MEDIAN.format(x="low")}, 0) AS l2, coalesce({_MEDIAN.format(x="high")}, 0) AS h2 FROM halves
)
SELECT driver, bucket, equipment_view, load_count, qualified_count, clean_match_count, review_once_count, blocked_count, rate_check_count, avg_rpm, avg_rate,
       CAST(m2 AS DOUBLE) / 200 AS median_rpm, CAST(r2 AS DOUBLE) / 2 AS median_rate, CAST(l2 AS DOUBLE) / 200 AS bottom_quartile_rpm, CAST(h2 AS DOUBLE) / 200 AS top_quartile_rpm,
       CASE WHEN load_count < 3 OR len(rpms) < 3 THEN 'LOW_DATA' WHEN m2 >= 600 THEN 'STRONG_MARKET' WHEN m2 < 400 THEN 'SOFT_MARKET' ELSE 'NORMAL_MARKET' END AS market_status
FROM medians"""


def market_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.zones(first_matches(spark, sf_dir), ["driver"])


ZONES_SQL = BASE + DEDUPED_SQL.format(source="matches", by="driver, ") + f""", places AS (
  SELECT driver, delivery AS city, delivery_state AS state, rate, status, CAST(round(total_rpm * 100) AS BIGINT) AS rpm FROM deduped
), grouped AS (
  SELECT driver, coalesce(city, '') AS city, coalesce(state, '') AS state, count(*) AS load_count, count(*) FILTER (WHERE status = 'MATCH') AS clean_exits,
         count(*) FILTER (WHERE status = 'REVIEW_ONCE' AND rate > 0) AS review_exits, count(*) FILTER (WHERE rate <= 0) AS rate_check_exits, count(*) FILTER (WHERE status = 'BLOCK') AS blocked,
         CAST({avg_sql("rpm", "rpm > 0")} AS DOUBLE) / 100 AS avg_rpm, CAST(max(rpm) AS DOUBLE) / 100 AS best_rpm, max(rate) AS best_rate, coalesce(list(rpm) FILTER (WHERE rpm > 0), []) AS rpms
  FROM places GROUP BY GROUPING SETS ((driver, city), (driver, state))
), medians AS (SELECT *, coalesce({_MEDIAN.format(x="rpms")}, 0) AS m2 FROM grouped)
SELECT driver, city, state, load_count, clean_exits, review_exits, rate_check_exits, blocked, avg_rpm, CAST(m2 AS DOUBLE) / 200 AS median_rpm, best_rpm, best_rate,
       CASE WHEN load_count < 3 THEN 'LOW_EXIT_CONFIDENCE' WHEN clean_exits >= 2 AND m2 >= 400 THEN 'STRONG_EXIT_MARKET' WHEN clean_exits = 0 AND review_exits + rate_check_exits >= 2 THEN 'RISKY_EXIT_MARKET' ELSE 'WEAK_EXIT_MARKET' END AS zone_status
FROM medians"""


def top_opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.top_opportunities(matches(spark, sf_dir), "driver").select("driver", "place", "load_id", "rate", F.col("score").cast("long").alias("score"))


TOP_SQL = BASE + " SELECT driver, CAST(place AS INTEGER) AS place, load_id, rate, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY score DESC, rate DESC, total_rpm DESC, empty_miles, load_id) AS place FROM matches WHERE good AND status = 'MATCH') WHERE place <= 5"


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.review_queue(matches(spark, sf_dir), "driver").select("driver", "place", "load_id", "rate_check", F.col("score").cast("long").alias("score"))


REVIEW_SQL = BASE + " SELECT driver, CAST(place AS INTEGER) AS place, load_id, rate_check, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY rate_check DESC, score DESC, rate DESC, total_rpm DESC, empty_miles, load_id) AS place FROM (SELECT *, rate = 0 AS rate_check FROM matches WHERE status = 'REVIEW_ONCE') WHERE good OR rate_check) WHERE place <= 5"


def near_cities(spark: SparkSession) -> DataFrame:
    """City pairs within reach, by their places in the list of cities."""
    pairs = [(a, b, 40 * abs(i - j)) for i, a in enumerate(CITIES) for j, b in enumerate(CITIES) if abs(i - j) * 40 <= 175]
    return spark.createDataFrame(pairs, "delivery string, pickup string, miles long")


def reload_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.reload_chains(matches(spark, sf_dir), "driver", near_cities(spark)).select("driver", "place", "first_id", "reload_id", "gross", "miles", "chain_score")


_NEAR = "near(delivery, pickup, miles) AS (VALUES " + ", ".join(f"('{a}', '{b}', {40 * abs(i - j)})" for i, a in enumerate(CITIES) for j, b in enumerate(CITIES) if abs(i - j) * 40 <= 175) + ")"
CHAINS_SQL = BASE + f""", {_NEAR}, pairs AS (
  SELECT a.driver, a.load_id AS first_id, b.load_id AS reload_id, a.rate + b.rate AS gross, a.total_miles + b.total_miles + n.miles AS miles, (a.rate + b.rate) // 100 - n.miles // 10 AS chain_score
  FROM matches a JOIN near n ON a.delivery = n.delivery JOIN matches b ON b.driver = a.driver AND b.pickup = n.pickup AND b.pickup_date BETWEEN a.pickup_date + 1 AND a.pickup_date + 3
  WHERE a.strong AND NOT a.in_target AND NOT a.in_city AND a.rate > 0 AND b.good AND b.in_target
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY driver, first_id ORDER BY chain_score DESC, gross DESC, reload_id) AS rn FROM pairs) WHERE rn = 1)
SELECT driver, CAST(place AS INTEGER) AS place, first_id, reload_id, gross, miles, chain_score FROM (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY chain_score DESC, gross DESC, first_id) AS place FROM best) WHERE place <= 5"""


def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocker reasons of each driver, the five most frequent."""
    counts = matches(spark, sf_dir).where("status = 'BLOCK'").select("driver", F.explode(reasons_of(F.col("block_bits"))).alias("reason")).groupBy("driver", "reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("driver").orderBy(F.desc("n"), "reason"))).where("place <= 5")


REASONS_SQL = BASE + " SELECT driver, reason, n, CAST(place AS INTEGER) AS place FROM (SELECT driver, reason, count(*) AS n, row_number() OVER (PARTITION BY driver ORDER BY count(*) DESC, reason) AS place FROM (SELECT driver, unnest(block_reasons) AS reason FROM matches WHERE status = 'BLOCK') GROUP BY driver, reason) WHERE place <= 5"


def load_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priority, suggested action and reason of every match."""
    return with_priority(matches(spark, sf_dir)).select("driver", "load_id", "priority", F.col("suggested_action").alias("action"), F.col("opportunity_reason").alias("worth"))


PRIORITIES_SQL = BASE + """ SELECT driver, load_id, CASE WHEN status = 'BLOCK' THEN 'BLOCK' WHEN score >= 90 THEN 'HIGH' WHEN score >= 75 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE WHEN status = 'BLOCK' THEN 'DO NOT SEND' WHEN status = 'REVIEW_ONCE' THEN 'REVIEW ONCE' WHEN score >= 85 THEN 'CALL NOW + EMAIL BACKUP' WHEN score >= 75 THEN 'CALL IF AVAILABLE' ELSE 'MONITOR' END AS action,
  coalesce(nullif(concat_ws(', ', CASE WHEN rate >= 5000 THEN 'Strong gross' WHEN rate >= 3000 THEN 'Good gross' END, CASE WHEN total_rpm >= 4 THEN 'Excellent RPM' WHEN total_rpm >= 3 THEN 'Good RPM' END,
    CASE WHEN empty_miles <= 50 THEN 'Low empty miles' WHEN empty_miles <= 150 THEN 'Acceptable empty miles' END, CASE status WHEN 'MATCH' THEN 'Matches driver target' WHEN 'REVIEW_ONCE' THEN 'Needs dispatcher review' END), ''),
    'Potential opportunity based on current filters') AS worth FROM matches"""

QUERIES = {
    "load_priorities": load_priorities,
    "driver_match": driver_match,
    "flagship_bucket_stats": flagship_bucket_stats,
    "driver_fit": driver_fit,
    "market_recommendation": market_recommendation,
    "repost_dedupe": repost_dedupe,
    "market_baseline": market_baseline,
    "market_zones": market_zones,
    "top_opportunities": top_opportunities,
    "review_queue": review_queue,
    "reload_chains": reload_chains,
    "reason_histogram": reason_histogram,
}
ORACLES = {
    "load_priorities": PRIORITIES_SQL,
    "driver_match": DRIVER_MATCH_SQL,
    "flagship_bucket_stats": BUCKET_SQL,
    "driver_fit": FIT_SQL,
    "market_recommendation": RECOMMEND_SQL,
    "repost_dedupe": REPOST_SQL,
    "market_baseline": BASELINE_SQL,
    "market_zones": ZONES_SQL,
    "top_opportunities": TOP_SQL,
    "review_queue": REVIEW_SQL,
    "reload_chains": CHAINS_SQL,
    "reason_histogram": REASONS_SQL,
}
