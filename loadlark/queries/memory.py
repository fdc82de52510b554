"""Queries over cases and feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import market as M
from ..operators import memory as R
from ..sources.views import CASES_SQL, FEEDBACK_SQL, LOADS_SQL, REQUESTS_SQL, cases, feedback, loads, table
from ..plans.rules import MATCHES_SQL
from .market import DEDUPED_SQL, matches

BASE = f"WITH {CASES_SQL}, {FEEDBACK_SQL}, joined AS (SELECT f.feedback_id, f.driver AS feedback_driver, f.verb, f.ts, f.value, c.* FROM feedback f JOIN cases c ON f.case_number = c.case_id)"
VERBS_SQL = ", ".join(f"count(*) FILTER (WHERE verb = '{v}') AS {v}" for v in R.VERB_LIST)
BROKERS_SQL = f"""{BASE}, counts AS (
  SELECT broker_mc, count(*) AS answers, count(DISTINCT case_id) AS cases, max(ts) AS latest, {VERBS_SQL} FROM joined GROUP BY broker_mc
), brokers AS (
  SELECT *, CASE WHEN answers < 3 THEN 'NO_MEMORY' WHEN bad_broker * 2 >= answers THEN 'AVOID' WHEN bad_broker >= 5 THEN 'CAUTION' WHEN booked * 4 >= answers THEN 'PREFERRED' WHEN booked >= 1 THEN 'KNOWN' ELSE 'NEUTRAL' END AS broker_status FROM counts
)"""
LANES_SQL = f"""{BASE}, lanes AS (
  SELECT lower(feedback_driver) AS driver, pickup || ' -> ' || delivery AS lane, verb, count(*) AS n, count(DISTINCT case_id) AS cases, CAST(sum(rate) AS BIGINT) AS total_rate, max(ts) AS latest FROM joined GROUP BY ALL
)"""


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.feedback_with_cases(feedback(spark, sf_dir), cases(spark, sf_dir))


def feedback_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).agg(F.count(F.lit(1)).alias("answers"), F.count_distinct("case_id").alias("cases"), F.count_distinct("broker_mc").alias("brokers"), F.count_distinct("feedback_driver").alias("drivers"))


def feedback_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).groupBy("category").pivot("verb", R.VERB_LIST).count().fillna(0)


def learning_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brokers and verbs that came up at least three times."""
    return joined(spark, sf_dir).groupBy("broker_mc", "verb").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")


def broker_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten brokers with most cases."""
    rows = cases(spark, sf_dir).groupBy("broker_mc").agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "BOOKED").alias("booked"), F.count_if(F.col("status") == "OPEN").alias("open"), F.max("rate").alias("best_rate"), F.sum("rate").alias("total_rate"), F.max("created_at").alias("latest"))
    return rows.orderBy(F.desc("cases"), F.desc("total_rate"), "broker_mc").limit(10)


def driver_lane_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir).groupBy(F.col("feedback_driver").alias("driver"), "pickup", "delivery", "verb").agg(F.count(F.lit(1)).alias("n"), M.rounded_average(F.sum("rate"), F.count(F.lit(1))).alias("avg_rate"), M.rounded_average(F.sum("loaded_miles"), F.count(F.lit(1))).alias("avg_miles"))
    return rows.orderBy(F.desc("n"), "driver", "pickup", "delivery", "verb").limit(50)


def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of status, category and broker presence, one column of kinds."""
    c = cases(spark, sf_dir)
    return c.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.coalesce("status", F.lit("NONE")).alias("name")), F.struct(F.lit("category").alias("kind"), F.coalesce("category", F.lit("UNKNOWN")).alias("name")))).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("orders", "lineitem", "events", "customer", "supplier"):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def events_for_open_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback(spark, sf_dir).join(cases(spark, sf_dir).where("status = 'OPEN'"), F.col("case_number") == F.col("case_id"), "left_semi").groupBy("verb").agg(F.count(F.lit(1)).alias("n"))


def event_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's latest event (ties: later in the input) with its number of events."""
    f = feedback(spark, sf_dir)
    return f.groupBy("case_number").agg(F.count(F.lit(1)).alias("events"), F.max_by("verb", F.struct("ts", "feedback_id")).alias("latest_verb"), F.max("ts").alias("latest_ts"))


def event_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each case, driver, verb and day."""
    first = Window.partitionBy("case_number", "driver", "verb", F.to_date("ts")).orderBy("feedback_id")
    return feedback(spark, sf_dir).withColumn("n", F.row_number().over(first)).where("n = 1").select("feedback_id", "case_number", "driver", "verb")


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each answer the latest booking of its driver before it: an as-of join as a running window."""
    order = Window.partitionBy("driver").orderBy("ts", "feedback_id").rowsBetween(Window.unboundedPreceding, -1)
    return feedback(spark, sf_dir).withColumn("last_booked", F.last(F.when(F.col("verb") == "booked", F.col("feedback_id")), ignorenulls=True).over(order)).select("feedback_id", "last_booked")


def selected_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline and experiment selections side by side: a full outer join with null-safe comparison."""
    rows = feedback(spark, sf_dir)
    last = lambda df, name: df.groupBy("case_number").agg(F.max_by("verb", "feedback_id").alias(name))
    a, b = last(rows.where("feedback_id % 3 <> 0"), "baseline"), last(rows.where("feedback_id % 4 <> 0"), "experiment")
    return a.join(b, "case_number", "full_outer").select("case_number", "baseline", "experiment", F.when(F.col("baseline").isNull(), "ADDED").when(F.col("experiment").isNull(), "REMOVED").when(F.col("baseline").eqNullSafe(F.col("experiment")), "SAME").otherwise("CHANGED").alias("change"))


def verb_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback(spark, sf_dir)
    half = lambda c, name: rows.where(c).groupBy("verb").agg(F.count(F.lit(1)).alias(name))
    return half("ts < timestamp '2024-01-16 00:00:00'", "before").join(half("ts >= timestamp '2024-01-16 00:00:00'", "after"), "verb", "full_outer").select("verb", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"), (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of loads sent before: those of every third load; those of even days are known by the older key of broker, lane and date."""
    rows = with_keys(M.first_posts(loads(spark, sf_dir)).where("load_id % 3 = 0"))
    return rows.select(F.when(F.dayofmonth("pickup_date") % 2 == 0, F.col("legacy_key")).otherwise(F.col("repost_key")).alias("key"))


def with_keys(rows: DataFrame) -> DataFrame:
    """Loads with today's key and the one that older records hold."""
    return rows.withColumns({"repost_key": M.repost_key(rows), "legacy_key": F.concat_ws("|", "broker_mc", "pickup", "delivery", "pickup_date")})


def unsent_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads by bucket that were sent neither under today's key nor under the older one."""
    return R.unsent(with_keys(loads(spark, sf_dir)), sent(spark, sf_dir), ["repost_key", "legacy_key"]).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def select_unsent(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = matches(spark, sf_dir).where("good AND status <> 'BLOCK'")
    good = good.withColumn("repost_key", M.repost_key(good))
    order = [-F.col("score"), -F.col("rate"), F.col("load_id")]
    return R.first_unsent(good, sent(spark, sf_dir), "driver", order, 5).select("driver", "load_id", "unsent")


QUERIES = {
    "broker_memory": lambda s, d: R.broker_memory(joined(s, d)),
    "driver_memory": lambda s, d: R.driver_memory(joined(s, d)),
    "lane_feedback": lambda s, d: R.lane_feedback(joined(s, d)),
    "lane_signals": lambda s, d: R.lane_signals(R.lane_feedback(joined(s, d))),
    "broker_recommendations": lambda s, d: R.recommendations(R.broker_memory(joined(s, d))),
    "case_status_fold": lambda s, d: R.fold_status(feedback(s, d)),
    "latest_event_window": lambda s, d: R.latest_window(feedback(s, d), "booked").select("feedback_id", "case_number", "start_id"),
    "feedback_overview": feedback_overview,
    "feedback_by_category": feedback_by_category,
    "learning_signals": learning_signals,
    "broker_summary": broker_summary,
    "driver_lane_top": driver_lane_top,
    "group_counts": group_counts,
    "table_counts": table_counts,
    "events_for_open_cases": events_for_open_cases,
    "event_report": event_report,
    "event_dedupe": event_dedupe,
    "latest_decision": latest_decision,
    "selected_compare": selected_compare,
    "verb_delta": verb_delta,
    "unsent_loads": unsent_loads,
    "select_unsent": select_unsent,
}
_SENT = DEDUPED_SQL.format(source="loads", by="") + ", sent AS (SELECT DISTINCT CASE WHEN day(pickup_date) % 2 = 0 THEN concat_ws('|', broker_mc, pickup, delivery, CAST(pickup_date AS VARCHAR)) ELSE repost_key END AS key FROM deduped WHERE load_id % 3 = 0)"
ORACLES = {
    "broker_memory": BROKERS_SQL + " SELECT * FROM brokers",
    "driver_memory": f"""{BASE}, counts AS (SELECT lower(feedback_driver) AS driver, count(*) AS answers, count(DISTINCT broker_mc) AS brokers, CAST(sum(rate) AS BIGINT) AS total_rate, {VERBS_SQL} FROM joined GROUP BY 1)
SELECT *, CASE WHEN answers >= 50 THEN 'STRONG' WHEN answers >= 25 THEN 'GOOD' WHEN answers >= 10 THEN 'LIMITED' ELSE 'LOW' END AS sample_quality,
  CASE WHEN answers < 10 THEN 'NOT_ENOUGH_DATA' WHEN booked * 3 >= answers THEN 'ACTIVE' WHEN skipped * 2 >= answers THEN 'SELECTIVE' ELSE 'MIXED' END AS driver_status FROM counts""",
    "lane_feedback": LANES_SQL + " SELECT * FROM lanes",
    "lane_signals": LANES_SQL + """, rolled AS (
  SELECT driver, lane, CAST(sum(n) AS BIGINT) AS answers, CAST(coalesce(sum(n) FILTER (WHERE verb = 'booked'), 0) AS BIGINT) AS booked, CAST(coalesce(sum(n) FILTER (WHERE verb = 'bad_broker'), 0) AS BIGINT) AS bad,
         CAST(coalesce(sum(n) FILTER (WHERE verb = 'skipped'), 0) AS BIGINT) AS skipped, max(latest) AS latest, string_agg(verb || ':' || n, ',' ORDER BY verb || ':' || n) AS verbs FROM lanes GROUP BY driver, lane
) SELECT *, CASE WHEN answers < 2 THEN 'LOW_DATA' WHEN booked * 2 >= answers THEN 'LIKES_LANE' WHEN (bad + skipped) * 2 > answers THEN 'AVOIDS_LANE' ELSE 'MIXED' END AS signal FROM rolled""",
    "broker_recommendations": BROKERS_SQL + """ SELECT broker_mc, 'WARN' AS action, 'several bad-broker answers' AS why FROM brokers WHERE bad_broker >= 3
UNION ALL SELECT broker_mc, 'PREFER', 'booked several times' FROM brokers WHERE booked >= 3
UNION ALL SELECT broker_mc, 'CHECK', 'called often, never booked' FROM brokers WHERE called_broker >= 3 AND booked = 0
UNION ALL SELECT broker_mc, 'LOWER', 'mostly skipped' FROM brokers WHERE skipped * 2 >= answers""",
    "case_status_fold": f"""WITH {FEEDBACK_SQL}, ranked AS (
  SELECT *, CASE verb WHEN 'booked' THEN 'BOOKED' WHEN 'bad_broker' THEN 'BAD_BROKER' WHEN 'skipped' THEN 'SKIPPED' END AS f, CASE verb WHEN 'sent_to_driver' THEN 1 WHEN 'called_broker' THEN 2 ELSE 0 END AS r FROM feedback
), folded AS (
  SELECT case_number, last(f ORDER BY feedback_id) FILTER (WHERE f IS NOT NULL) AS final_outcome, CASE max(r) WHEN 2 THEN 'CALLED' WHEN 1 THEN 'SENT' ELSE 'NEW' END AS working_status, count(*) AS events FROM ranked GROUP BY case_number
) SELECT case_number, final_outcome, working_status, coalesce(final_outcome, working_status) AS status, events FROM folded""",
    "latest_event_window": f"WITH {FEEDBACK_SQL} SELECT feedback_id, case_number, start_id FROM (SELECT *, max(feedback_id) FILTER (WHERE verb = 'booked') OVER (PARTITION BY case_number) AS start_id FROM feedback) WHERE feedback_id >= start_id",
    "feedback_overview": BASE + " SELECT count(*) AS answers, count(DISTINCT case_id) AS cases, count(DISTINCT broker_mc) AS brokers, count(DISTINCT feedback_driver) AS drivers FROM joined",
    "feedback_by_category": f"{BASE} SELECT category, {VERBS_SQL} FROM joined GROUP BY category",
    "learning_signals": BASE + " SELECT broker_mc, verb, count(*) AS n FROM joined GROUP BY ALL HAVING count(*) >= 3",
    "broker_summary": f"WITH {CASES_SQL} SELECT broker_mc, count(*) AS cases, count(*) FILTER (WHERE status = 'BOOKED') AS booked, count(*) FILTER (WHERE status = 'OPEN') AS open, max(rate) AS best_rate, CAST(sum(rate) AS BIGINT) AS total_rate, max(created_at) AS latest FROM cases GROUP BY broker_mc ORDER BY cases DESC, total_rate DESC, broker_mc LIMIT 10",
    "driver_lane_top": BASE + " SELECT feedback_driver AS driver, pickup, delivery, verb, count(*) AS n, CAST((2 * sum(rate) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_rate, CAST((2 * sum(loaded_miles) + count(*)) // (2 * count(*)) AS BIGINT) AS avg_miles FROM joined GROUP BY ALL ORDER BY n DESC, driver, pickup, delivery, verb LIMIT 50",
    "group_counts": f"WITH {CASES_SQL} SELECT 'status' AS kind, coalesce(status, 'NONE') AS name, count(*) AS n FROM cases GROUP BY ALL UNION ALL SELECT 'category', coalesce(category, 'UNKNOWN'), count(*) FROM cases GROUP BY ALL",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "events", "customer", "supplier")),
    "events_for_open_cases": f"WITH {CASES_SQL}, {FEEDBACK_SQL} SELECT verb, count(*) AS n FROM feedback WHERE case_number IN (SELECT case_id FROM cases WHERE status = 'OPEN') GROUP BY verb",
    "event_report": f"WITH {FEEDBACK_SQL} SELECT case_number, count(*) AS events, last(verb ORDER BY ts, feedback_id) AS latest_verb, max(ts) AS latest_ts FROM feedback GROUP BY case_number",
    "event_dedupe": f"WITH {FEEDBACK_SQL} SELECT feedback_id, case_number, driver, verb FROM (SELECT *, row_number() OVER (PARTITION BY case_number, driver, verb, CAST(ts AS DATE) ORDER BY feedback_id) AS n FROM feedback) WHERE n = 1",
    "latest_decision": f"WITH {FEEDBACK_SQL} SELECT feedback_id, last_value(CASE WHEN verb = 'booked' THEN feedback_id END IGNORE NULLS) OVER (PARTITION BY driver ORDER BY ts, feedback_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_booked FROM feedback",
    "selected_compare": f"""WITH {FEEDBACK_SQL}, a AS (SELECT case_number, last(verb ORDER BY feedback_id) AS baseline FROM feedback WHERE feedback_id % 3 <> 0 GROUP BY 1), b AS (SELECT case_number, last(verb ORDER BY feedback_id) AS experiment FROM feedback WHERE feedback_id % 4 <> 0 GROUP BY 1)
SELECT case_number, baseline, experiment, CASE WHEN baseline IS NULL THEN 'ADDED' WHEN experiment IS NULL THEN 'REMOVED' WHEN baseline = experiment THEN 'SAME' ELSE 'CHANGED' END AS change FROM a FULL JOIN b USING (case_number)""",
    "verb_delta": f"WITH {FEEDBACK_SQL} SELECT verb, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS after, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') - count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS delta FROM feedback GROUP BY verb",
    "unsent_loads": f"WITH {LOADS_SQL}{_SENT} SELECT bucket, count(*) AS n FROM keyed WHERE repost_key NOT IN (SELECT key FROM sent) AND concat_ws('|', broker_mc, pickup, delivery, CAST(pickup_date AS VARCHAR)) NOT IN (SELECT key FROM sent) GROUP BY bucket",
    "select_unsent": f"""WITH {LOADS_SQL}{_SENT}, {REQUESTS_SQL}, {MATCHES_SQL.replace("AS strong FROM loads", "AS strong FROM keyed")}, flagged AS (
  SELECT m.driver, m.load_id, m.score, m.rate, CASE WHEN s.key IS NULL THEN 1 ELSE 0 END AS unsent FROM matches m LEFT JOIN sent s ON m.repost_key = s.key WHERE m.good AND m.status <> 'BLOCK'
) SELECT driver, load_id, unsent FROM (SELECT *, coalesce(sum(unsent) OVER (PARTITION BY driver ORDER BY score DESC, rate DESC, load_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM flagged) WHERE before < 5""",
}
