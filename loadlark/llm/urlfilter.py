"""URL filters: host-suffix and path-prefix expressions, an equi-join on short hash prefixes, full digests, rule precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules up to this count are broadcast; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 200_000
#: Hex digits of a digest that the join compares.
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; path: from there up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="__url"))).otherwise("")
    lower = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """Judge each url by the longest fitting rule.

    rules: host, path (both may be empty), verdict (allow or block). A rule fits its host and all subdomains where the url's
    path starts with the rule's; an empty rule host fits every host. Of the fitting rules the one with the longest host and
    path together wins, then the longer host, then block. Added: host, path, rule (host and path of the rule, else null) and
    verdict (`default` where no rule fits).

    Null urls and urls without `://` have an empty host and path. Repeated pages are each judged; rules with a null host, path
    or verdict are left out; with no rules every page gets `default`. `keep` names the input columns to return (all by
    default); an added column replaces an input column of its name.

    Distinct hosts and paths are judged once, so a hot url costs one row. Which label counts and path lengths are expanded
    follows the rules, so any rule is found, not only one that ends at a slash.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").distinct()
    labels = F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\.")))
    shape = rules.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(labels)).alias("labels"), F.array_sort(F.collect_set(F.length("path"))).alias("lengths")).first()
    # every column that is kept moves into one struct, so that no name can clash
    urls = pages.select(F.struct(*keep).alias("__row"), F.col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    urls = urls.select("__row", host.alias("host"), path.alias("path"))
    if not shape.n:
        return urls.select("__row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    digest = lambda h, p: F.sha2(F.concat(h, F.lit("\n"), p), 256)
    keyed = rules.select(digest(F.col("host"), F.col("path")).alias("rule_digest"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("blocks"), F.col("verdict").alias("rule_verdict"))
    keyed = keyed.withColumn("prefix", F.substring("rule_digest", 1, PREFIX_HEX))
    if shape.n <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    distinct = urls.select("host", "path").distinct()
    parts = F.split("host", r"\.")
    suffixes = F.array_compact(F.array(*(F.lit("") if n == 0 else F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in shape.labels)))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in shape.lengths)))
    expressions = distinct.select("host", "path", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "path", "suffix", F.explode("prefixes").alias("path_prefix"))
    expressions = expressions.withColumn("digest", digest(F.col("suffix"), F.col("path_prefix"))).select("host", "path", "digest", F.substring("digest", 1, PREFIX_HEX).alias("prefix"))
    fits = expressions.join(keyed, "prefix").where("digest = rule_digest")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.length("rule"), "host_length", "blocks", "rule")).alias("best"))
    best = materialize(best.select(F.col("host").alias("__host"), F.col("path").alias("__path"), "best.*"), "urls")
    # the verdicts grow with the pages, so they are never broadcast
    judged = urls.join(best.hint("shuffle_merge"), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")), "left")
    return judged.select("__row.*", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
