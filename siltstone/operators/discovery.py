"""Domain strategies, robots, sitemaps, link graphs and truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.urls import bare_domain, canonical_url, hrefs, is_live_href, page_base, is_url_allowed, resolve, url_authority, url_path
from ..session import checkpoint
from .ranks import place_in_group

DEFAULT_DEPTH, DEFAULT_PAGES = 2, 50
MOST_SITEMAP_DEPTH = 5


def strategy_for(urls: DataFrame, strategies: DataFrame, url: str = "url", dot_boundary: bool = False) -> DataFrame:
    """urls with the strategy that applies: exact domain, then without www, then the first registered suffix, else the default.

    strategies(domain, seq, max_depth, max_pages, authority_level) is a registry
    of hand-written rules; the join is on every suffix of a host's characters
    that could be a domain, so it stays an equi-join.
    """
    host = F.lower(url_authority(F.col(url)))
    bare = bare_domain(host)
    rules = strategies.select(F.col("domain").alias("strategy_domain"), "seq", "max_depth", "max_pages", "authority_level")
    hosts = urls.select(host.alias("host"), bare.alias("bare")).distinct()
    labels = F.split("bare", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if not dot_boundary:
        suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("bare"), F.lit(1))), lambda i: F.substr(F.col("bare"), i, F.length("bare")))
    probes = hosts.select("host", F.explode(F.array_union(F.array(F.struct(F.lit(1).alias("p"), F.col("host").alias("d")), F.struct(F.lit(2).alias("p"), F.col("bare").alias("d"))), F.transform(suffixes, lambda s: F.struct(F.lit(3).alias("p"), s.alias("d"))))).alias("x")).select("host", "x.*")
    hit = probes.join(rules, F.col("d") == F.col("strategy_domain"))
    best = hit.groupBy("host").agg(F.min_by(F.struct("strategy_domain", "max_depth", "max_pages", "authority_level"), F.struct("p", "seq")).alias("s")).select("host", "s.*")
    out = urls.withColumn("host", host).join(best, "host", "left")
    return out.withColumn("max_depth", F.coalesce("max_depth", F.lit(DEFAULT_DEPTH))).withColumn("max_pages", F.coalesce("max_pages", F.lit(DEFAULT_PAGES))).withColumn("authority_level", F.coalesce("authority_level", F.lit("third_party")))


def robots_rules(robots: DataFrame, key: str = "domain", text: str = "text", agent: str = "siltstone") -> DataFrame:
    """(key, disallow) of the groups for any agent or ours."""
    lines = robots.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    field, value = F.lower(F.btrim(F.split_part("line", F.lit(":"), F.lit(1)))), F.btrim(F.regexp_replace("line", "^[^:]*:", ""))
    order = W.partitionBy(key).orderBy("pos")
    lines = lines.withColumn("agent", F.last_value(F.when(field == "user-agent", F.lower(value)), True).over(order))
    mine = (F.col("agent") == "*") | F.contains("agent", F.lit(agent))
    return lines.where((field == "disallow") & mine & (value != "")).select(key, value.alias("disallow")).distinct()


def sitemaps_in_robots(robots: DataFrame, key: str = "domain", text: str = "text") -> DataFrame:
    lines = robots.select(key, F.explode(F.split(text, r"\r?\n")).alias("line"))
    return lines.where(F.lower("line").startswith("sitemap:")).select(key, F.btrim(F.regexp_replace("line", "^[^:]*:", "")).alias("sitemap"))


def locs(xml: Column, element: str) -> Column:
    """The addresses in the elements (url or sitemap) of a sitemap file; none in a text that is no such file, or in the part of one that was cut off."""
    found = F.regexp_extract_all(xml, F.lit(rf"(?is)<(?:\w+:)?{element}(?:\s[^>]*)?>(?:(?!</(?:\w+:)?{element}\s*>).)*?<(?:\w+:)?loc(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?([^<\]]*)"), 1)
    return F.filter(F.transform(found, lambda x: F.btrim(F.regexp_replace(F.replace(x, F.lit("&amp;"), F.lit("&")), r"\s+", " "))), lambda x: x != "")


def sitemap_urls(sitemaps: DataFrame, key: str = "domain", xml: str = "xml") -> DataFrame:
    return sitemaps.select(key, F.explode(locs(F.col(xml), "url")).alias("url"))


def first_answering(probes: DataFrame, key: str = "domain") -> DataFrame:
    """Of probes(key, probe, url) the URLs of the first probe that gave any."""
    first = probes.groupBy(key).agg(F.min("probe").alias("probe"))
    return probes.join(first, [key, "probe"]).select(key, "url")


def page_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, link, same_domain): canonical absolute links, each once a page. A page's base tag counts."""
    found = pages.select(key, url, page_base(F.col(html), F.col(url)).alias("base"), F.explode(hrefs(F.col(html))).alias("href")).where(is_live_href(F.col("href")))
    found = found.select(key, url, canonical_url(resolve(F.col("href"), F.col("base"))).alias("link")).where("link IS NOT NULL").distinct()
    return found.select(key, "link", (bare_domain(url_authority(F.col("link"))) == bare_domain(url_authority(F.col(url)))).alias("same_domain"))


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): nodes within max_depth of the seeds. One anti-join a level; each level is checkpointed."""
    seen = checkpoint(seeds.select("node", F.lit(0).alias("depth")).distinct())
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = checkpoint(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def sitemap_closure(sitemaps: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """(url): each page URL once of the sitemaps that roots(sitemap) reach through index files within max_depth.

    sitemaps holds (sitemap, xml). Indexes that name each other end the walk.
    """
    edges = sitemaps.select(F.col("sitemap").alias("src"), F.explode(locs(F.col("xml"), "sitemap")).alias("dst"))
    reached = breadth_first(edges, roots.select(F.col("sitemap").alias("node")), max_depth)
    return sitemap_urls(sitemaps.join(reached, F.col("sitemap") == F.col("node"), "left_semi"), "sitemap").select("url").distinct()


def truncate_per_domain(scored: DataFrame, group: str, score: str, tie: str, limit: str) -> DataFrame:
    """The best ``limit`` rows of each group with their rank, and ``over``: how many rows of the group were left out."""
    kept = place_in_group(scored, group, score, tie, "rank").where(F.col("rank") <= F.col(limit))
    sizes = scored.groupBy(group).agg(F.greatest(F.count("*") - F.max(limit), F.lit(0)).alias("over"))
    return kept.join(sizes.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group"))).drop("__group")


#: Where sites keep their sitemap, best first.
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml")


def sitemap_probes(domains: DataFrame, key: str = "domain") -> DataFrame:
    """(key, probe, sitemap): where to look for a domain's sitemap, in order: every path of the domain, then those of its www host."""
    www = F.when(F.startswith(key, F.lit("www.")), F.array(F.col(key))).otherwise(F.array(F.col(key), F.concat(F.lit("www."), F.col(key))))
    places = F.flatten(F.transform(www, lambda d: F.transform(F.array(*map(F.lit, SITEMAP_PATHS)), lambda p: F.concat(F.lit("https://"), d, p))))
    return domains.select(key, F.posexplode(places).alias("probe", "sitemap"))


def usable_responses(responses: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Responses with status 200 and a body that is not blank."""
    return responses.where((F.col(status) == 200) & (F.btrim(F.regexp_replace(body, r"\s+", " ")) != ""))


def discover_sitemaps(domains: DataFrame, responses: DataFrame, robots: DataFrame, rules: DataFrame, key: str = "domain") -> DataFrame:
    """(key, url): the page URLs of each domain's sitemaps that its rules allow, each once.

    responses(sitemap, status, body) hold what was fetched. The first place that
    gives an allowed URL answers for a domain; if none does, the sitemaps that
    robots(key, text) names do, all of them. Index files are followed, five deep.
    rules holds (key, blocked, allowed, prefixes), arrays of patterns.
    """
    files = usable_responses(responses).select("sitemap", F.col("body").alias("xml"))
    edges = files.select(F.col("sitemap").alias("src"), F.explode(locs(F.col("xml"), "sitemap")).alias("dst"))
    leaves = files.select("sitemap", F.explode(locs(F.col("xml"), "url")).alias("url"))

    def found(places: DataFrame) -> DataFrame:
        """(key, probe, url) of places(key, probe, sitemap): walks from each place by itself."""
        level = checkpoint(places.select(key, "probe", F.col("sitemap").alias("node")).distinct())
        seen = level
        for _ in range(MOST_SITEMAP_DEPTH):
            after = level.join(edges, F.col("node") == F.col("src")).select(key, "probe", F.col("dst").alias("node")).distinct()
            level = checkpoint(after.join(seen, [key, "probe", "node"], "left_anti"))
            if level.isEmpty():
                break
            seen = seen.unionByName(level)
        urls = seen.join(leaves, F.col("node") == F.col("sitemap")).select(key, "probe", "url").distinct()
        return urls.join(rules, key).where(is_url_allowed(F.col("url"), F.col("blocked"), F.col("allowed"), F.col("prefixes"))).select(key, "probe", "url")

    first = first_answering(found(sitemap_probes(domains, key)), key)
    named = sitemaps_in_robots(robots, key).withColumn("probe", F.lit(0))
    others = found(named.join(first.select(key).distinct(), key, "left_anti").select(key, "probe", "sitemap")).select(key, "url")
    return first.unionByName(others).distinct()


def robots_allow(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """urls with allowed: whether no rule(domain, disallow) of their own domain begins their path.

    Rules join by domain and first path characters that a rule could have: an equi-join on every prefix of a path.
    """
    own = urls.withColumn("__domain", F.lower(url_authority(F.col(url)))).withColumn("__path", F.when(url_path(F.col(url)) == "", "/").otherwise(url_path(F.col(url))))
    asked = own.select("__domain", "__path").distinct()
    prefixes = asked.select("__domain", "__path", F.explode(F.transform(F.sequence(F.lit(1), F.length("__path")), lambda n: F.left(F.col("__path"), n))).alias("disallow"))
    hit = prefixes.join(rules.select(F.col("domain").alias("__domain"), "disallow"), ["__domain", "disallow"], "left_semi").select("__domain", "__path").distinct()
    marked = own.join(hit.withColumn("__no", F.lit(True)), ["__domain", "__path"], "left")
    return marked.select(*urls.columns, F.col("__no").isNull().alias("allowed"))


def enriched(docs: DataFrame, metadata: DataFrame, url: str = "url") -> DataFrame:
    """docs with authority_level and visa_types of metadata(url, authority_level, visa_types); without an entry third_party and general."""
    known = metadata.select(F.col(url).alias("__url"), "authority_level", "visa_types").dropDuplicates(["__url"])
    joined = docs.join(known, F.col(url) == F.col("__url"), "left").drop("__url")
    return joined.withColumn("authority_level", F.coalesce("authority_level", F.lit("third_party"))).withColumn("visa_types", F.coalesce("visa_types", F.array(F.lit("general"))))


def source_documents(discovered: DataFrame, extra: DataFrame) -> DataFrame:
    """Discovered and hand-listed sources as a bag: an URL in both stays twice."""
    return discovered.unionByName(extra, allowMissingColumns=True)
