"""URL rules, links and crawl order over the pages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import discovery as D
from ..sources import tables as T
from ._registry import register, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ = lambda sql=None: register(QUERIES, ORACLE_SQL, sql)

#: Rules for the shapes that the generated URLs have.
BLOCKED, ALLOWED, PREFIXES, KEYWORDS = [r"/fr/", r"\.(pdf|jpg|png)$", r"7$"], [r"/en", r"/de", r"\.html$", r"/[0-9]+"], ["/en", "/de", "/fr", "/es"], ["en", "1", "html", "de", "25"]
STRATEGIES = [("example.com", 1, 3, 8, "official"), ("m.example.net", 2, 4, 5, "semi_official"), ("example.org", 3, 2, 4, "third_party"), ("net", 4, 1, 6, "semi_official")]

_PATH = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_ALLOWED = rf"""(len(list_filter({_LIST(BLOCKED)}, lambda p: regexp_matches(lower({_PATH}), p))) = 0
  AND len(list_filter({_LIST(ALLOWED)}, lambda p: regexp_matches(lower({_PATH}), p))) > 0
  AND (lower({_PATH}) IN ('', '/') OR len(list_filter({_LIST(PREFIXES)}, lambda p: starts_with(lower({_PATH}), p))) > 0))"""
_SCORE = f"round(least(1.0, len(list_filter({_LIST(KEYWORDS)}, lambda k: contains(lower({_PATH}), k))) / greatest({len(KEYWORDS)} * 0.3, 1.0))::DOUBLE, 6)"


def _array(items: list[str]):
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def _pages(spark, d):
    return table(spark, d, "pages")


@_(f"SELECT page_id, {_ALLOWED} AS allowed FROM pages")
def url_allowed(spark, d):
    return _pages(spark, d).select("page_id", U.is_url_allowed(F.col("url"), _array(BLOCKED), _array(ALLOWED), _array(PREFIXES)).alias("allowed"))


@_(f"SELECT page_id, {_SCORE} AS score FROM pages")
def relevance_score(spark, d):
    return _pages(spark, d).select("page_id", F.round(U.relevance_score(F.col("url"), _array(KEYWORDS)).cast("double"), 6).alias("score"))


@_("SELECT page_id, CASE WHEN regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '/' THEN bare ELSE regexp_replace(bare, '/+$', '') END AS canonical FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS bare FROM pages)")
def url_canonical(spark, d):
    return _pages(spark, d).select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@_(f"SELECT page_id, {_HOST} AS host, replace({_HOST}, 'www.', '') AS domain, {_PATH} AS path FROM pages")
def url_parts(spark, d):
    host = F.lower(U.url_authority(F.col("url")))
    return _pages(spark, d).select("page_id", host.alias("host"), U.bare_domain(host).alias("domain"), U.url_path(F.col("url")).alias("path"))


_RULES = ", ".join(f"('{a}', {b}, {c}, {e}, '{f}')" for a, b, c, e, f in STRATEGIES)
_CHOSEN = f"""chosen AS (
  SELECT page_id, url, {_HOST} AS host, r.* FROM pages LEFT JOIN LATERAL (
    SELECT * FROM (VALUES {_RULES}) s(domain, seq, max_depth, max_pages, authority_level)
    WHERE {_HOST} = domain OR ends_with(replace({_HOST}, 'www.', ''), domain)
    ORDER BY CASE WHEN {_HOST} = domain THEN 1 WHEN replace({_HOST}, 'www.', '') = domain THEN 2 ELSE 3 END, seq LIMIT 1) r ON true)"""


def _strategies(spark, d):
    rules = spark.createDataFrame(STRATEGIES, "domain string, seq int, max_depth int, max_pages int, authority_level string")
    return D.strategy_for(_pages(spark, d), rules)


@_(f"WITH {_CHOSEN} SELECT page_id, host, domain AS strategy_domain, coalesce(max_depth, 2) AS max_depth, coalesce(max_pages, 50) AS max_pages, coalesce(authority_level, 'third_party') AS authority_level FROM chosen")
def strategy_join(spark, d):
    return _strategies(spark, d).select("page_id", "host", "strategy_domain", "max_depth", "max_pages", "authority_level")


@_(f"WITH {_CHOSEN} SELECT * FROM (SELECT page_id, coalesce(domain, 'default') AS strategy, row_number() OVER (PARTITION BY coalesce(domain, 'default') ORDER BY {_SCORE} DESC, page_id)::INT AS rank, coalesce(max_pages, 50) AS max_pages, greatest(count(*) OVER (PARTITION BY coalesce(domain, 'default')) - coalesce(max_pages, 50), 0) AS over FROM chosen) WHERE rank <= max_pages")
def top_pages_per_domain(spark, d):
    scored = _strategies(spark, d).select("page_id", F.coalesce("strategy_domain", F.lit("default")).alias("strategy"), "max_pages", F.round(U.relevance_score(F.col("url"), _array(KEYWORDS)).cast("double"), 6).alias("score"))
    return D.truncate_per_domain(scored, "strategy", "score", "page_id", "max_pages").drop("score")


@_(f"SELECT page_id, replace({_HOST}, 'www.', '') AS domain, row_number() OVER (PARTITION BY replace({_HOST}, 'www.', '') ORDER BY {_SCORE} DESC, url || ' ' || lpad(page_id::VARCHAR, 12, '0'))::INT AS place FROM pages")
def cached_urls(spark, d):
    scored = _pages(spark, d).select("page_id", "url", U.bare_domain(U.url_authority(F.col("url"))).alias("domain"), F.round(U.relevance_score(F.col("url"), _array(KEYWORDS)).cast("double"), 6).alias("relevance"))
    cache = scored.withColumn("url", F.concat("url", F.lit(" "), F.lpad(F.col("page_id").cast("string"), 12, "0")))
    return T.cached_urls(cache).select("page_id", "domain", "place")


@_(f"SELECT page_id FROM pages WHERE replace({_HOST}, 'www.', '') = (SELECT min(replace({_HOST}, 'www.', '')) FROM pages)")
def single_domain(spark, d):
    cache = _pages(spark, d).select("page_id", U.bare_domain(U.url_authority(F.col("url"))).alias("domain"), "url", F.lit(0.5).alias("relevance"))
    return T.cached_urls(cache, cache.agg(F.min("domain")).first()[0]).select("page_id")


_LINKS = r"""links AS (
  SELECT DISTINCT page_id, url, CASE
    WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
    WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href END AS raw
  FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1))) AS href FROM pages)
  WHERE href <> '' AND NOT (starts_with(href, '#') OR starts_with(href, 'mailto:') OR starts_with(href, 'tel:') OR starts_with(href, 'javascript:'))),
canonical AS (
  SELECT DISTINCT page_id, url, CASE WHEN regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '/' THEN bare ELSE regexp_replace(bare, '/+$', '') END AS link
  FROM (SELECT page_id, url, regexp_replace(raw, '[?#].*$', '') AS bare FROM links WHERE raw IS NOT NULL))"""


@_(rf"WITH {_LINKS} SELECT page_id, link, replace(lower(regexp_extract(link, '://([^/?#]*)', 1)), 'www.', '') = replace({_HOST}, 'www.', '') AS same_domain FROM canonical")
def link_extract(spark, d):
    return D.page_links(_pages(spark, d))


@_(rf"WITH {_LINKS} SELECT link, count(*) AS pages FROM canonical WHERE replace(lower(regexp_extract(link, '://([^/?#]*)', 1)), 'www.', '') = replace({_HOST}, 'www.', '') GROUP BY link")
def same_domain_links(spark, d):
    return D.page_links(_pages(spark, d)).where("same_domain").groupBy("link").agg(F.count("*").alias("pages"))


#: More levels than any walk needs: along 2 p and 2 p + 1 modulo n, every one of n pages is within log2(n) + 1 of any other.
_LEVELS = 64


@_(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), edges AS (SELECT page_id AS src, page_id * 2 % n AS dst FROM pages, n UNION SELECT page_id, (page_id * 2 + 1) % n FROM pages, n),
walk(node, depth) AS (SELECT page_id, 0 FROM pages WHERE page_id IN (0, 10) UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < {_LEVELS})
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def bfs_depth(spark, d):
    p = _pages(spark, d).select(F.col("page_id").alias("src"))
    counted = p.crossJoin(F.broadcast(p.agg(F.count("*").alias("n"))))
    edges = counted.select("src", F.explode(F.array(F.col("src") * 2 % F.col("n"), (F.col("src") * 2 + 1) % F.col("n"))).alias("dst")).distinct()
    return D.breadth_first(edges, p.where("src IN (0, 10)").select(F.col("src").alias("node")), _LEVELS)


_CANON = "CASE WHEN regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '/' THEN regexp_replace(url, '[?#].*$', '') ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') END"


@_(f"""WITH RECURSIVE {_LINKS}, edges AS (SELECT DISTINCT {_CANON} AS src, link AS dst FROM canonical),
walk(node, depth) AS (SELECT DISTINCT {_CANON}, 0 FROM pages WHERE page_id % 20 = 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 4)
SELECT node, min(depth)::INT AS depth FROM walk GROUP BY node""")
def bfs_links(spark, d):
    p = _pages(spark, d)
    own = p.select("page_id", U.canonical_url(F.col("url")).alias("src"))
    edges = D.page_links(p).join(own, "page_id").select("src", F.col("link").alias("dst")).distinct()
    return D.breadth_first(edges, own.where("page_id % 20 = 0").select(F.col("src").alias("node")), 4)


_ROBOTS = "'User-agent: *' || chr(10) || 'Disallow: /private' || (page_id % 5) || chr(10) || 'User-agent: other' || chr(10) || 'Disallow: /x' || chr(10) || 'Sitemap: https://s.example/' || page_id || '.xml' || chr(10) || 'user-agent: SiltstoneBot' || chr(10) || 'disallow:  /bot '"


def _robots(spark, d):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("User-agent: *\nDisallow: /private"), (F.col("page_id") % 5).cast("string"), F.lit("\nUser-agent: other\nDisallow: /x\nSitemap: https://s.example/"), n, F.lit(".xml\nuser-agent: SiltstoneBot\ndisallow:  /bot "))
    return _pages(spark, d).select(F.col("page_id").alias("domain"), text.alias("text"))


@_("SELECT page_id AS domain, '/private' || (page_id % 5) AS disallow FROM pages UNION ALL SELECT page_id, '/bot' FROM pages")
def robots_disallow(spark, d):
    return D.robots_rules(_robots(spark, d))


@_("SELECT page_id AS domain, 'https://s.example/' || page_id || '.xml' AS sitemap FROM pages")
def robots_sitemaps(spark, d):
    return D.sitemaps_in_robots(_robots(spark, d))


_OWN_RULE = "'/' || split_part(" + _PATH + ", '/', 2)"


@_(f"WITH rules AS (SELECT DISTINCT {_HOST} AS domain, {_OWN_RULE} AS disallow FROM pages WHERE page_id % 7 = 0) SELECT page_id, NOT EXISTS (SELECT 1 FROM rules WHERE domain = {_HOST} AND starts_with({_PATH}, disallow)) AS allowed FROM pages")
def robots_allow(spark, d):
    """Each domain's rules are its own: the first path segment of every seventh page."""
    p = _pages(spark, d)
    rules = p.where("page_id % 7 = 0").select(F.lower(U.url_authority(F.col("url"))).alias("domain"), F.concat(F.lit("/"), F.split_part(U.url_path(F.col("url")), F.lit("/"), F.lit(2))).alias("disallow")).distinct()
    return D.robots_allow(p.select("page_id", "url"), rules).select("page_id", "allowed")


@_("SELECT page_id AS domain, 'https://a.example/' || page_id || '/' || i AS url FROM pages, (SELECT unnest([1, 2]) AS i)")
def sitemap_leaves(spark, d):
    n = F.col("page_id").cast("string")
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://a.example/'), n, F.lit("/1</loc></url><url><loc> https://a.example/"), n, F.lit("/2 </loc></url></urlset>"))
    return D.sitemap_urls(_pages(spark, d).select(F.col("page_id").alias("domain"), xml.alias("xml")))


@_("SELECT DISTINCT url FROM (SELECT url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0)")
def discovered_union(spark, d):
    p = _pages(spark, d)
    return p.where("page_id % 2 = 0").select("url").union(p.where("page_id % 3 = 0").select("url")).distinct()


@_(f"SELECT CASE WHEN grouping(domain) = 1 THEN 'total' ELSE domain END AS domain, count(*) AS urls FROM (SELECT replace({_HOST}, 'www.', '') AS domain FROM pages) GROUP BY ROLLUP (domain)")
def discovered_totals(spark, d):
    p = _pages(spark, d).select(U.bare_domain(U.url_authority(F.col("url"))).alias("domain"))
    return p.rollup("domain").agg(F.count("*").alias("urls"), F.grouping("domain").alias("all")).select(F.when(F.col("all") == 1, "total").otherwise(F.col("domain")).alias("domain"), "urls")


_ROOT = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
_FOLDER = f"regexp_extract(CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END, '^(.*/)', 1)"


@_(f"""WITH l AS (SELECT page_id, url, unnest([
    {_ROOT} || CASE WHEN {_FOLDER} = '/' THEN '/' ELSE regexp_replace({_FOLDER}, '[^/]+/$', '') END || 'up/' || page_id || '.html',
    {_ROOT} || {_FOLDER} || 'sub/p.html', {_ROOT} || {_FOLDER} || 'q', {_ROOT} || '/a/b', 'https://other.example/z']) AS link FROM pages)
SELECT DISTINCT page_id, link, replace(lower(regexp_extract(link, '://([^/?#]*)', 1)), 'www.', '') = replace({_HOST}, 'www.', '') AS same_domain FROM l""")
def relative_links(spark, d):
    """Links relative to a page's folder, with dot segments, in every way of quoting."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<A class=x HREF="../up/'), n, F.lit("""?a=1&amp;b=2.html">1</A><a href='../up/"""), n, F.lit(""".html'>2</a><a id="i" href=sub/./p.html#top>3</a><a href="./q/">4</a><a href="/a/c/../b">5</a><a href='https://other.example/z?x'>6</a><a href="mailto:x">7</a>"""))
    html = F.replace(html, F.lit("?a=1&amp;b=2.html"), F.lit(".html?a=1&amp;b=2"))
    return D.page_links(_pages(spark, d).select("page_id", "url", html.alias("html")))


_VISA = "CASE page_id % 3 WHEN 0 THEN 'work_visa' ELSE 'student_visa' END"


@_(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'official' ELSE 'third_party' END AS authority_level, CASE WHEN page_id % 2 = 0 THEN {_VISA} ELSE 'general' END AS visa_types FROM pages")
def url_metadata(spark, d):
    p = _pages(spark, d).select("page_id", F.concat("url", F.lit("#"), "page_id").alias("url"))
    known = p.where("page_id % 2 = 0").select("url", F.lit("official").alias("authority_level"), F.array(F.when(F.col("page_id") % 3 == 0, "work_visa").otherwise("student_visa")).alias("visa_types"))
    return D.enriched(p, known).select("page_id", "authority_level", F.array_join("visa_types", ",").alias("visa_types"))


@_("SELECT url, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def source_documents(spark, d):
    p = _pages(spark, d)
    return D.source_documents(p.select("url", F.lit("official").alias("authority_level")), p.where("page_id % 3 = 0").select("url")).groupBy("url").agg(F.count("*").alias("n"))


@_("SELECT page_id FROM pages WHERE page_id % 4 = 0 AND page_id % 3 > 0")
def usable_responses(spark, d):
    status = F.when(F.col("page_id") % 4 == 0, 200).when(F.col("page_id") % 4 == 1, 404)
    body = F.when(F.col("page_id") % 3 > 0, F.col("html")).otherwise(F.lit(" \n\t "))
    return D.usable_responses(_pages(spark, d).select("page_id", status.alias("status"), body.alias("body"))).select("page_id")


@_("SELECT page_id::VARCHAR || '.example' AS domain, 'https://' || page_id || '.example/en/' || i AS url FROM pages, (SELECT unnest([1, 2]) AS i) WHERE page_id % 4 < 3 AND (i = 1 OR page_id % 4 <> 1)")
def sitemap_discovery(spark, d):
    """Domains by page: an index on the second path (0), a plain sitemap with a second URL that is blocked (1), one that only robots names (2), none (3)."""
    n = F.concat(F.col("page_id").cast("string"), F.lit(".example"))
    p = _pages(spark, d).select(n.alias("domain"), (F.col("page_id") % 4).alias("kind"), F.concat(F.lit("https://"), n).alias("root"))
    url = lambda path: F.concat(F.lit("<url><loc> "), F.col("root"), F.lit(f"{path} </loc></url>"))
    leaf = lambda *paths: F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), *map(url, paths), F.lit("</urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("root"), F.lit("/leaf.xml</loc></sitemap></sitemapindex>"))
    file = lambda kind, path, body, status=200: p.where(F.col("kind") == kind).select(F.concat("root", F.lit(path)).alias("sitemap"), F.lit(status).alias("status"), body.alias("body"))
    responses = file(0, "/sitemap.xml", F.lit("gone"), 404).unionByName(file(0, "/sitemap_index.xml", index)).unionByName(file(0, "/leaf.xml", leaf("/en/1", "/en/2")))
    responses = responses.unionByName(file(1, "/sitemap.xml", leaf("/en/1", "/private/2"))).unionByName(file(1, "/wp-sitemap.xml", leaf("/en/9"))).unionByName(file(2, "/hidden.xml", leaf("/en/1", "/en/2")))
    robots = p.select("domain", F.concat(F.lit("User-agent: *\nSitemap: "), F.col("root"), F.lit("/hidden.xml")).alias("text"))
    rules = p.select("domain", F.array(F.lit("/private")).alias("blocked"), F.array().cast("array<string>").alias("allowed"), F.array(F.lit("/en")).alias("prefixes"))
    return D.discover_sitemaps(p.select("domain"), responses, robots, rules)
