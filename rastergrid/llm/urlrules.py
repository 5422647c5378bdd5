"""URL filters: hand-written host rules, and rules that FP-growth mines from labelled URLs.

All of it is DataFrame functions and Spark's own FP-growth; no Python runs on the executors.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastergrid.session import materialize

ALLOW, BLOCK = "allow", "block"
CLASS = "=block"        # the item that marks a bad URL; tokens of URLs have a letter and a colon in front
LONGEST = 12            # tokens of a URL that a mined combination can draw from
SUPPORT, LEAST, CONFIDENCE = 0.001, 30, 0.5


@dataclass(frozen=True)
class HostRule:
    """A rule for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """What follows the first ``://``, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(url: Column) -> Column:
    """Distinct tokens: ``s:`` scheme, ``h:`` labels of the host, ``p:`` parts of the path and ``q:``
    names of query fields, lower-cased, with every run of digits as one ``#``."""
    whole = F.coalesce(url, F.lit(""))
    has = F.contains(whole, F.lit("://"))
    query = F.regexp_extract(whole, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)

    def parts(kind: str, text: Column, at: str) -> Column:
        plain = F.regexp_replace(F.lower(text), "[0-9]+", "#")
        return F.transform(F.filter(F.split(plain, at), lambda t: t != ""), lambda t: F.concat(F.lit(kind), t))

    fields = parts("q:", F.regexp_replace(query, "=[^&]*", ""), "&")
    found = F.concat(parts("s:", F.substring_index(whole, "://", 1), "://"), parts("h:", host_of(url), r"\."),
                     parts("p:", path_of(url), "/"), fields)
    return F.when(has, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def by_host(host: Column, path: Column, rules: list[HostRule]) -> Column:
    """``rule, verdict`` of the longest of ``rules`` that fits, or null."""
    def fits(r: HostRule) -> Column:
        return ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))

    ordered = sorted(rules, key=lambda r: len(r.host + r.path), reverse=True)
    choices = [F.when(fits(r), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
               for r in ordered]
    return F.coalesce(*choices, F.lit(None).cast("struct<rule:string,verdict:string>"))


def contained(sets: DataFrame, rules: DataFrame, *keys: str) -> DataFrame:
    """``keys`` of ``sets`` (column ``tokens``) with the rows of ``rules`` whose ``items`` they all hold.

    The inverted index lists a rule under the rarest of its items alone (column ``lead``), so
    frequent tokens lead nowhere; what it finds is compared in full.
    """
    found = sets.select(*keys, "tokens", F.explode("tokens").alias("lead")).join(rules, "lead")
    return found.where(F.size(F.array_except("items", "tokens")) == 0).drop("tokens", "lead")


def mine(labelled: DataFrame, support: float = SUPPORT, least: int = LEAST, confidence: float = CONFIDENCE,
         longest: int = LONGEST) -> DataFrame:
    """``rule, items, confidence, n_bad, lead``: token combinations that mean a bad URL.

    ``labelled`` has ``url`` and ``bad``; a null url or label takes no part, repeated rows count as often as they come.
    FP-growth finds the combinations that come with ``bad`` in a share ``support`` of the
    URLs and at least ``least`` of them; those whose URLs are bad in a share of ``confidence`` or
    more stay, but for those that hold another of no less confidence.

    A combination draws from the ``longest`` tokens of a URL that tell most (the share of bad URLs
    they come with against that of all, in standard errors), so one long URL that comes up often
    does not make 2^n combinations. Without enough labelled URLs there are no rules.
    """
    rows = materialize(labelled.where("url IS NOT NULL AND bad IS NOT NULL").select(
        F.monotonically_increasing_id().alias("row"), "bad", tokens_of(F.col("url")).alias("tokens")))
    n, n_bad = rows.agg(F.count("*"), F.sum(F.col("bad").cast("long"))).first()
    need = max(least, -(-n * round(support * 1e9) // 10**9))
    spark = labelled.sparkSession
    if n < need or (n_bad or 0) < need:
        return spark.createDataFrame([], "rule long, items array<string>, confidence double, n_bad long, lead string")
    known = (rows.select("bad", F.explode("tokens").alias("token")).groupBy("token")
             .agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("b")).where(F.col("n") >= need))
    tells = F.abs(F.col("b") * float(n) - F.col("n") * float(n_bad)) / F.sqrt(F.col("n").cast("double"))
    known = materialize(known.select("token", "n", tells.alias("tells")))
    sorted_in = F.sort_array(F.collect_list(F.struct((-F.col("tells")).alias("down"), "token")))
    chosen = (rows.select("row", F.explode("tokens").alias("token")).join(known.select("token", "tells"), "token")
              .groupBy("row").agg(F.slice(sorted_in, 1, longest).getField("token").alias("few")))
    marked = F.when(F.col("bad"), F.array(F.lit(CLASS))).otherwise(F.array().cast("array<string>"))
    baskets = rows.join(chosen, "row", "left").select(
        F.concat(F.coalesce("few", F.array().cast("array<string>")), marked).alias("items")).where(F.size("items") > 0)
    # half a row less, so that the product with the number of baskets is not rounded up beyond ``need``
    n_baskets = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / n_baskets), minConfidence=confidence).fit(baskets)
    sure = model.associationRules.where(F.col("consequent") == F.array(F.lit(CLASS)))
    named = sure.select(F.sort_array("antecedent").alias("items"), "confidence",
                        F.round(F.col("support") * n_baskets).cast("long").alias("n_bad"))
    named = materialize(named.withColumn("rule", F.monotonically_increasing_id()))
    rarest = (named.select("rule", F.explode("items").alias("token")).join(known, "token")
              .groupBy("rule").agg(F.min(F.struct("n", "token")).getField("token").alias("lead")))
    rules = materialize(named.join(rarest, "rule"))
    smaller = rules.select("items", "lead", F.col("rule").alias("part"), F.col("confidence").alias("part_confidence"))
    sets = rules.select("rule", "confidence", F.size("items").alias("size"), F.col("items").alias("tokens"))
    within = contained(sets, smaller, "rule", "confidence", "size")
    needless = within.where("part_confidence >= confidence AND size(items) < size").select("rule").distinct()
    return materialize(rules.join(needless, "rule", "left_anti").select("rule", "items", "confidence", "n_bad", "lead"))


def judge(pages: DataFrame, host_rules: list[HostRule], mined: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern, confidence`` of every row of ``pages``.

    The longest fitting host rule decides. Where none fits, a URL is blocked if it holds a mined
    combination; ``pattern`` and ``confidence`` name the surest of them (of equal ones the first in
    order), for all rows alike. Each distinct URL is matched once. A URL that is null or without
    ``://`` has an empty host and path, no rule and no pattern, and is allowed; rows with a null
    page_id and repeated rows stay as they are.
    """
    urls = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"))
    sets = urls.where("url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    surest = F.min(F.struct((-F.col("confidence")).alias("down"), F.array_join("items", " ").alias("pattern")))
    hits = contained(sets, mined, "url").groupBy("url").agg(surest.alias("hit")).select(
        F.col("url").alias("hit_url"), F.col("hit.pattern").alias("pattern"), (-F.col("hit.down")).alias("confidence"))
    split = urls.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = (split.withColumn("by_host", by_host(F.col("host"), F.col("path"), host_rules))
              .join(hits, F.col("url") == F.col("hit_url"), "left"))
    own = F.when(F.col("pattern").isNotNull(), BLOCK).otherwise(ALLOW)
    return judged.select("page_id", "host", "path", F.col("by_host.rule").alias("rule"),
                         F.coalesce("by_host.verdict", own).alias("verdict"), "pattern", "confidence")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of the pages whose document has a label. The first number in a path is the
    document's ``doc_id``; a document is bad if one of its labels has quality 0 or is toxic."""
    bad = (F.coalesce(labels["quality"], F.lit(1)) == 0) | (F.coalesce(labels["toxic"], F.lit(0)) == 1)
    known = (labels.where(labels["doc_id"].isNotNull())
             .groupBy(labels["doc_id"].cast("long").alias("of")).agg(F.max(bad).alias("bad")))
    url = pages["url"].cast("string")
    number = F.regexp_extract(path_of(url), "([0-9]+)", 1).try_cast("long")
    return pages.select(url.alias("url"), number.alias("of")).join(known, "of").select("url", "bad")
