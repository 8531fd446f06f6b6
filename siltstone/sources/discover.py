"""Discovery over the network: the sitemaps of domains, then the links of their pages, level by level.

What is fetched is written to a folder and read from there, so that no page is
asked for twice when a plan is run again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import is_url_allowed, relevance_score
from ..operators.dedup import fresh_entries
from ..operators.discovery import MOST_SITEMAP_DEPTH, discover_sitemaps, locs, page_links, robots_allow, robots_rules, sitemap_probes, sitemaps_in_robots, truncate_per_domain, usable_responses
from .pages import fetch_pages
from .tables import read_table, replace_domains

CACHE_HOURS = 168
FOUND = "url string, found string, relevance double, rank int, over long, authority_level string, visa_types array<string>, at timestamp, domain string"

#: What a domain's strategy is without an entry of its own.
STRATEGY = {
    "seed_paths": "array('/')",
    "authority_level": "'third_party'",
    "default_visa_types": "array('general')",
    "max_depth": "3",
    "max_pages": "100",
    "allowed_path_patterns": "cast(array() as array<string>)",
    "blocked_path_patterns": "cast(array() as array<string>)",
    "relevance_keywords": "cast(array() as array<string>)",
    "language_prefixes": "array('/en/', '/de/')",
    "use_sitemap": "true",
}


def strategies_of(domains: DataFrame) -> DataFrame:
    """Each domain once with all of a strategy; what is absent or null takes its default."""
    for name, default in STRATEGY.items():
        value = F.expr(default)
        domains = domains.withColumn(name, F.coalesce(F.col(name), value) if name in domains.columns else value)
    return domains.where("domain is not null").select("domain", *STRATEGY).dropDuplicates(["domain"])


def _allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(domain, url, ...) that their strategy's patterns and robots rules allow; the strategy's columns are there."""
    own = urls.where(is_url_allowed(F.col("url"), F.col("blocked_path_patterns"), F.col("allowed_path_patterns"), F.col("language_prefixes")))
    return robots_allow(own, rules).where("allowed").drop("allowed")


def discover(spark: SparkSession, domains: DataFrame, folder: str, tasks: int, **fetching) -> DataFrame:
    """(domain, url, found, relevance, rank, over): the best max_pages URLs of each domain, and how many more there were.

    found says whether a sitemap or only a link led there. Links are followed
    from the seed paths to max_depth; a level fetches the best max_pages of a
    domain's new URLs.
    """

    def kept(rows: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.parquet(path)

    def fetch(urls: DataFrame) -> DataFrame:
        return kept(fetch_pages(urls, tasks, **fetching))

    plans = strategies_of(domains)
    asked = plans.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/robots.txt")).alias("url"))
    robots = usable_responses(asked.join(fetch(asked), "url"), body="html").select("domain", F.col("html").alias("text"))
    rules = robots_rules(robots)

    with_sitemap = plans.where("use_sitemap")
    level = sitemap_probes(with_sitemap).select(F.col("sitemap").alias("url")).unionByName(sitemaps_in_robots(robots).select(F.col("sitemap").alias("url"))).distinct()
    files = None
    for _ in range(MOST_SITEMAP_DEPTH + 1):
        got = fetch(level)
        files = got if files is None else files.unionByName(got)
        level = usable_responses(got, body="html").select(F.explode(locs(F.col("html"), "sitemap")).alias("url")).distinct().join(files.select("url"), "url", "left_anti")
        if level.isEmpty():
            break
    patterns = with_sitemap.select("domain", F.col("blocked_path_patterns").alias("blocked"), F.col("allowed_path_patterns").alias("allowed"), F.col("language_prefixes").alias("prefixes"))
    responses = files.select(F.col("url").alias("sitemap"), "status", F.col("html").alias("body"))
    listed = discover_sitemaps(with_sitemap.select("domain"), responses, robots, patterns).select("domain", "url", F.lit("sitemap").alias("found"))

    seeds = plans.withColumn("path", F.explode("seed_paths")).withColumn("url", F.concat(F.lit("https://"), "domain", "path")).drop("path")
    frontier = kept(robots_allow(seeds, rules).where("allowed").drop("allowed").dropDuplicates(["domain", "url"]))
    seen = []
    deepest = plans.agg(F.max("max_depth")).first()[0] or 0
    for depth in range(deepest + 1):
        got = fetch(frontier.select("url"))
        pages = usable_responses(frontier.select("domain", "url").join(got, "url"), body="html")
        seen.append(pages.select("domain", "url"))
        links = page_links(pages, "domain").where("same_domain").select("domain", F.col("link").alias("url")).distinct()
        asked = asked.unionByName(frontier.select("domain", "url"))
        new = _allowed(links.join(asked, ["domain", "url"], "left_anti").join(plans.where(F.col("max_depth") > depth), "domain"), rules)
        scored = new.withColumn("relevance", relevance_score(F.col("url"), F.col("relevance_keywords")))
        frontier = kept(truncate_per_domain(scored, "domain", "relevance", "url", "max_pages").drop("relevance", "rank", "over"))
        if frontier.isEmpty():
            break
    linked = reduce(DataFrame.unionByName, seen).select("domain", "url", F.lit("link").alias("found"))
    both = robots_allow(listed, rules).where("allowed").drop("allowed").unionByName(linked).groupBy("domain", "url").agg(F.max("found").alias("found"))
    scored = both.join(plans, "domain").withColumn("relevance", relevance_score(F.col("url"), F.col("relevance_keywords")).cast("double"))
    return truncate_per_domain(scored, "domain", "relevance", "url", "max_pages").select(
        "domain", "url", "found", "relevance", "rank", F.col("over").cast("long").alias("over"), "authority_level", F.col("default_visa_types").alias("visa_types")
    )


def discovered(spark: SparkSession, domains: DataFrame, store: str, tasks: int, now: Column, refresh: bool = False, hours: int = CACHE_HOURS, **fetching) -> DataFrame:
    """discover(), with what the store keeps from the last ``hours``; refresh asks anew for every domain."""
    path = f"{store}/discovered"
    fresh = fresh_entries(read_table(spark, path, FOUND), "domain", "at", now, hours).select("domain").distinct()
    missing = domains if refresh else domains.join(fresh, "domain", "left_anti")
    if not missing.isEmpty():
        found = discover(spark, missing, f"{store}/fetched", tasks, **fetching).withColumn("at", now)
        replace_domains(found.select([x.split()[0] for x in FOUND.split(", ")]), path)
    return read_table(spark, path, FOUND).join(domains.select("domain").distinct(), "domain", "left_semi")
