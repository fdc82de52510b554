"""Market statistics over matched loads: buckets, fit, baselines, zones, opportunities, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import baseline_bucket, equipment_view, has_value, location_state
from ..plans.rules import any_of
from ..sources.io import cut

BUCKETS = ["0-450", "450-700", "700-1300", "1300+"]


def rounded_average(total: Column, n: Column) -> Column:
    """Whole-number average, half up; 0 over nothing."""
    return F.coalesce(F.floor((total * 2 + n) / F.when(n != 0, n * 2)), F.lit(0)).cast("long")


def cents(dollars: Column) -> Column:
    return F.round(dollars * 100).cast("long")


def average_where(value: Column, condition: Column) -> Column:
    return rounded_average(F.coalesce(F.sum(F.when(condition, value)), F.lit(0)), F.count_if(condition))


def bucket_stats(matches: DataFrame, by: list[str]) -> DataFrame:
    """Thirteen measures of each mileage bucket, all buckets present; by: what else the loads are grouped by."""
    good, status = F.col("good"), F.col("status")
    stats = matches.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("total_loads"), F.count_if("qualified").alias("qualified_loads"), F.count_if(good).alias("good_loads"),
        F.count_if(good & (status == "MATCH")).alias("clean_match_loads"), F.count_if(good & (status == "REVIEW_ONCE")).alias("review_once_loads"),
        F.count_if(status == "BLOCK").alias("blocked_loads"),
        (rounded_average(F.sum(cents(F.col("total_rpm"))), F.count(F.lit(1))) / 100).alias("avg_total_rpm"),
        rounded_average(F.sum("rate"), F.count(F.lit(1))).alias("avg_rate"), rounded_average(F.sum("score"), F.count(F.lit(1))).alias("avg_opportunity_score"),
        average_where(F.col("score"), F.col("qualified")).alias("avg_qualified_score"), average_where(F.col("score"), good).alias("avg_good_score"),
        average_where(F.col("score"), good & (status == "MATCH")).alias("avg_clean_match_score"),
        average_where(F.col("score"), good & (status == "REVIEW_ONCE")).alias("avg_review_once_score"),
    )
    # every group has some bucket, so the groups come from the few rows of the statistics, not from the matches again
    order = F.broadcast(matches.sparkSession.createDataFrame([(b, i) for i, b in enumerate(BUCKETS)], "bucket string, bucket_order int"))
    return stats.select(*by).distinct().crossJoin(order).join(stats, [*by, "bucket"], "left").fillna(0)


def fit_stats(matches: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each status and the driver-fit label."""
    good, status = F.col("good"), F.col("status")
    counts = matches.groupBy(*by).agg(
        F.count_if(good & (status == "MATCH")).alias("clean_matches"), F.count_if(good & (status == "REVIEW_ONCE")).alias("review_once"),
        F.count_if(status == "BLOCK").alias("blocked"), F.count_if("qualified").alias("qualified"), F.count_if(good).alias("good"),
    )
    clean, review = F.col("clean_matches"), F.col("review_once")
    return counts.withColumn("driver_fit", F.when(clean >= 3, "GOOD").when(clean >= 1, "WORKABLE").when(review >= 3, "REVIEW_ONLY").when(review >= 1, "WEAK_FIT").otherwise("NO_MATCH"))


def recommend(stats: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    """Best bucket (largest weighted score; the first wins ties), market activity and action, from bucket and fit statistics."""
    # all weights times 120, so that the score is a whole number
    weight = F.col("clean_match_loads") * 600 + F.col("good_loads") * 360 + F.col("qualified_loads") * 240 + F.col("avg_clean_match_score") * 15 + F.col("avg_good_score") * 8
    best = stats.groupBy(*by).agg(F.max_by("bucket", F.struct(weight, -F.col("bucket_order"))).alias("best_bucket"), F.sum("good_loads").alias("total_good"), F.sum("qualified_loads").alias("total_qualified"))
    good, qualified, driver_fit = F.col("total_good"), F.col("total_qualified"), F.col("driver_fit")
    activity = F.when(good >= 6, "GOOD").when(good >= 3, "MEDIUM").when(qualified >= 2, "WEAK").otherwise("BAD")
    action = F.when(driver_fit == "GOOD", "STRONG_MATCHES_AVAILABLE").when(driver_fit == "WORKABLE", "SOME_MATCHES_AVAILABLE").when(driver_fit.isin("REVIEW_ONLY", "WEAK_FIT"), driver_fit).otherwise("NO_CLEAN_MATCHES")
    return best.join(fit, by).select(*by, "best_bucket", "total_good", "total_qualified", "clean_matches", "review_once", "blocked", "driver_fit", activity.alias("market_activity"), action.alias("action_status"))


def repost_key(loads: DataFrame) -> Column:
    """Identity of a load over its reposts: by reference, else by broker and lane and date, else by lane, date and miles."""
    lane = [F.lower("pickup"), F.lower("delivery"), F.col("pickup_date").cast("string")]
    return F.when(has_value(F.col("reference_id")), F.concat_ws("|", F.lit("REF"), F.lower("reference_id"), *lane)).when(has_value(F.col("broker_mc")), F.concat_ws("|", F.lit("MC"), F.lower("broker_mc"), *lane)).otherwise(F.concat_ws("|", F.lit("LANE"), *lane, F.col("loaded_miles")))


def first_posts(loads: DataFrame, by: list[str] | None = None, order: tuple[str, ...] = ("load_id", "rate", "loaded_miles", "empty_miles", "weight")) -> DataFrame:
    """The first load of each repost identity, in the order of some columns."""
    key = loads.withColumn("repost_key", repost_key(loads))
    first = Window.partitionBy(*(by or []), "repost_key").orderBy(*order)
    return key.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def _counted_values(rows: DataFrame, keys: list[str], sets: list[list[str]], derived: dict[str, Column] | None = None) -> DataFrame:
    """Counts of each distinct rpm (cents) and rate within each grouping set, with places among the positive values.

    Loads are counted by value before they meet, so what a window orders is one group's distinct values, never its loads.
    derived: keys that follow from other keys; they are worked out for the counts, not for each load.
    """
    derived = derived or {}
    own = [k for k in keys if k not in derived]
    measures = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("rpm", "rate")))
    counts = {"n": F.lit(True), "n_qualified": F.col("qualified"), "n_match": F.col("status") == "MATCH", "n_review": F.col("status") == "REVIEW_ONCE", "n_block": F.col("status") == "BLOCK", "n_open": (F.col("status") == "REVIEW_ONCE") & (F.col("rate") > 0)}
    fine = rows.select(*own, "status", "qualified", "rate", F.explode(measures).alias("m")).groupBy(*own, "m.measure", "m.value").agg(*(F.count_if(c).alias(n) for n, c in counts.items())).withColumns(derived)
    grouped = fine.groupingSets([[F.col(c) for c in [*s, "measure", "value"]] for s in sets], *keys, "measure", "value").agg(*(F.sum(n).alias(n) for n in counts))
    group = Window.partitionBy(*keys, "measure")
    placed = grouped.withColumn("positive", F.when(F.col("value") > 0, F.col("n")).otherwise(0))
    return placed.withColumns({"upto": F.sum("positive").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("positive").over(group)})


def _at(measure: str, place: Column) -> Column:
    """The positive value at a place (from 1) in the order of the measure's values."""
    return F.min(F.when((F.col("measure") == measure) & (F.col("value") > 0) & (F.col("upto") >= place), F.col("value")))


def _twice_median(measure: str, part: str = "all") -> Column:
    """Twice the median of all positive values, or of the lower or upper half without the middle value; 0 over nothing."""
    n = F.col("total")
    half = F.when(n == 1, 1).otherwise(F.floor(n / 2))
    size, before = {"all": (n, F.lit(0)), "low": (half, F.lit(0)), "high": (half, n - half)}[part]
    middle = [before + F.floor((size + 1) / 2), before + F.floor(size / 2) + 1]
    return F.coalesce(_at(measure, middle[0]) + _at(measure, middle[1]), F.lit(0))


def _sum_of(count: str, measure: str = "rate", condition: Column | None = None) -> Column:
    wanted = F.col("measure") == measure if condition is None else (F.col("measure") == measure) & condition
    return F.coalesce(F.sum(F.when(wanted, F.col(count))), F.lit(0))


def _positive_average(measure: str) -> Column:
    return rounded_average(F.coalesce(F.sum(F.when(F.col("measure") == measure, F.col("positive") * F.col("value"))), F.lit(0)), _sum_of("positive", measure))


def baseline(matches: DataFrame, by: list[str]) -> DataFrame:
    """Baseline of deduped loads in total, by bucket, by equipment view and by both; averages and medians are of positive values only.

    Quartiles are medians of the halves without the middle value. All figures are exact: values are whole cents and dollars.
    """
    rows = matches.withColumns({"bucket": baseline_bucket(F.col("loaded_miles"), F.col("total_miles")), "equipment_view": equipment_view(F.col("posted")), "rpm": cents(F.col("total_rpm"))})
    keys = [*by, "bucket", "equipment_view"]
    grouped = _counted_values(rows, keys, [by, [*by, "bucket"], [*by, "equipment_view"], keys]).groupBy(*keys).agg(
        _sum_of("n").alias("load_count"), _sum_of("n_qualified").alias("qualified_count"), _sum_of("n_match").alias("clean_match_count"),
        _sum_of("n_review").alias("review_once_count"), _sum_of("n_block").alias("blocked_count"), _sum_of("n", condition=F.col("value") <= 0).alias("rate_check_count"),
        _positive_average("rpm").alias("rpm_avg"), _positive_average("rate").alias("avg_rate"), _sum_of("positive", "rpm").alias("n_rpm"),
        _twice_median("rpm").alias("rpm2"), _twice_median("rate").alias("rate2"), _twice_median("rpm", "low").alias("low2"), _twice_median("rpm", "high").alias("high2"),
    )
    market = F.when((F.col("load_count") < 3) | (F.col("n_rpm") < 3), "LOW_DATA").when(F.col("rpm2") >= 600, "STRONG_MARKET").when(F.col("rpm2") < 400, "SOFT_MARKET").otherwise("NORMAL_MARKET")
    return grouped.select(
        *by, F.coalesce("bucket", F.lit("ALL")).alias("bucket"), F.coalesce("equipment_view", F.lit("ALL")).alias("equipment_view"),
        "load_count", "qualified_count", "clean_match_count", "review_once_count", "blocked_count", "rate_check_count",
        (F.col("rpm_avg") / 100).alias("avg_rpm"), "avg_rate", (F.col("rpm2") / 200).alias("median_rpm"), (F.col("rate2") / 2).alias("median_rate"),
        (F.col("low2") / 200).alias("bottom_quartile_rpm"), (F.col("high2") / 200).alias("top_quartile_rpm"), market.alias("market_status"),
    )


def _zones(matches: DataFrame, by: list[str], whole: bool) -> DataFrame:
    """zones; also of each group as a whole, in a row with `whole`, where that is asked."""
    rows = matches.withColumns({"city": F.col("delivery"), "rpm": cents(F.col("total_rpm"))})
    best = lambda m: F.max(F.when(F.col("measure") == m, F.col("value")))
    keys, sets, derived = [*by, "city", "state"], [[*by, "city"], [*by, "state"]], {"state": location_state(F.col("city"))}
    if whole:
        keys, sets, derived = [*keys, "whole"], [*sets, [*by, "whole"]], derived | {"whole": F.lit(True)}
    grouped = _counted_values(rows, keys, sets, derived).groupBy(*keys).agg(
        _sum_of("n").alias("load_count"), _sum_of("n_match").alias("clean_exits"), _sum_of("n_open").alias("review_exits"),
        _sum_of("n", condition=F.col("value") <= 0).alias("rate_check_exits"), _sum_of("n_block").alias("blocked"), _positive_average("rpm").alias("rpm_avg"),
        best("rpm").alias("best_rpm_cents"), best("rate").alias("best_rate"), _twice_median("rpm").alias("rpm2"), *([_twice_median("rate").alias("rate2")] if whole else []),
    )
    zone = F.when(F.col("load_count") < 3, "LOW_EXIT_CONFIDENCE").when((F.col("clean_exits") >= 2) & (F.col("rpm2") >= 400), "STRONG_EXIT_MARKET").when((F.col("clean_exits") == 0) & (F.col("review_exits") + F.col("rate_check_exits") >= 2), "RISKY_EXIT_MARKET").otherwise("WEAK_EXIT_MARKET")
    more = ["whole", (F.col("rate2") / 2).alias("median_rate")] if whole else []
    return grouped.select(*by, F.coalesce("city", F.lit("")).alias("city"), F.coalesce("state", F.lit("")).alias("state"), "load_count", "clean_exits", "review_exits", "rate_check_exits", "blocked", (F.col("rpm_avg") / 100).alias("avg_rpm"), (F.col("rpm2") / 200).alias("median_rpm"), (F.col("best_rpm_cents") / 100).alias("best_rpm"), "best_rate", zone.alias("zone_status"), *more)


def zones(matches: DataFrame, by: list[str]) -> DataFrame:
    """Exit markets by delivery city and by delivery state."""
    return _zones(matches, by, False)


def zones_and_medians(matches: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """zones, and of the baseline each group's total row with its medians, from one count of the loads: the few rows are cut."""
    found = cut(_zones(matches, by, True))
    total = found.where("whole").select(*by, F.lit("ALL").alias("bucket"), F.lit("ALL").alias("equipment_view"), "median_rpm", "median_rate")
    return found.where("whole IS NULL").drop("whole", "median_rate"), total


def top_opportunities(matches: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k best clean matches of each group; ties go to the smaller load id."""
    best = Window.partitionBy(by).orderBy(F.desc("score"), F.desc("rate"), F.desc("total_rpm"), "empty_miles", "load_id")
    return matches.where("good AND status = 'MATCH'").withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def review_queue(matches: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k first loads to review: rate checks first, then as opportunities."""
    check = F.col("review_bits").bitwiseAND(F.lit(any_of("RATE_MISSING"))) != 0
    rows = matches.where("status = 'REVIEW_ONCE'").withColumn("rate_check", check).where("good OR rate_check")
    first = Window.partitionBy(by).orderBy(F.desc("rate_check"), F.desc("score"), F.desc("rate"), F.desc("total_rpm"), "empty_miles", "load_id")
    return rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k)


def reload_chains(matches: DataFrame, by: str, near: DataFrame, k: int = 5) -> DataFrame:
    """Pairs of a strong off-direction load and a good reload near its delivery on a later date; the best reload of each first load, then the k best chains.

    near: pickup, delivery, miles of city pairs within reach. Of each city and day only the reload with the largest rate, then
    the smallest id, can be the best, so that alone is joined: a first load meets one reload of each near city and later day.
    First loads of one delivery and day meet the same reloads, so a larger rate, then a smaller id, never gives a chain that comes
    later: only the k first of them in that order can be among the k best, and ranks keep those within partitions first.
    """
    first = matches.where("strong AND NOT in_target AND NOT in_city AND rate > 0").select(by, F.col("load_id").alias("first_id"), F.col("rate").alias("first_rate"), F.col("delivery").alias("first_delivery"), F.col("total_miles").alias("first_miles"), F.col("pickup_date").alias("first_date"))
    # loads that share a number are told apart by all that a chain takes from them
    rank = Window.partitionBy(by, "first_delivery", "first_date").orderBy(F.desc("first_rate"), "first_id", "first_miles")
    first = first.withColumn("__n", F.dense_rank().over(rank)).where(F.col("__n") <= k).drop("__n")
    reload = matches.where("good AND in_target").select(by, F.col("load_id").alias("reload_id"), F.col("rate").alias("reload_rate"), F.col("pickup").alias("reload_pickup"), F.col("total_miles").alias("reload_miles"), F.col("pickup_date").alias("reload_date"))
    fields = F.struct("reload_id", "reload_rate", "reload_miles")
    reload = reload.groupBy(by, "reload_pickup", "reload_date").agg(F.max_by(fields, F.struct("reload_rate", -F.col("reload_id"))).alias("best")).select(by, "reload_pickup", "reload_date", "best.*")
    reach = F.broadcast(near.select(F.col("delivery").alias("first_delivery"), F.col("pickup").alias("reload_pickup"), F.col("miles").alias("gap_miles")))
    # reloads are gathered for each delivery and day, so first loads meet them where their ranks were found, without another shuffle
    offers = reload.join(reach, "reload_pickup").withColumn("first_date", F.explode(F.sequence(F.date_sub("reload_date", 3), F.date_sub("reload_date", 1))))
    offers = offers.groupBy(by, "first_delivery", "first_date").agg(F.collect_list(F.struct("reload_id", "reload_rate", "reload_miles", "gap_miles")).alias("offers"))
    pairs = first.join(offers, [by, "first_delivery", "first_date"]).withColumn("offer", F.explode("offers")).drop("offers").select("*", "offer.*")
    gross = F.col("first_rate") + F.col("reload_rate")
    score = F.floor(gross / 100).cast("long") - F.floor(F.col("gap_miles") / 10).cast("long")
    pairs = pairs.withColumns({"gross": gross, "miles": F.col("first_miles") + F.col("reload_miles") + F.col("gap_miles"), "chain_score": score})
    own = ["first_id", "first_rate", "first_delivery", "first_miles", "first_date"]
    best = pairs.groupBy(by, *own).agg(F.max_by(F.struct("reload_id", "gross", "miles", "chain_score"), F.struct("chain_score", "gross", -F.col("reload_id"))).alias("best")).select(by, *own, "best.*")
    order = Window.partitionBy(by).orderBy(F.desc("chain_score"), F.desc("gross"), "first_id", "reload_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

