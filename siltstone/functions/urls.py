"""URL rules as column expressions. Rules are data: arrays of patterns beside the URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Links that lead nowhere.
DEAD_PREFIXES = ("#", "mailto:", "tel:", "javascript:")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def bare_domain(authority: Column) -> Column:
    return F.replace(F.lower(authority), F.lit("www."), F.lit(""))


def is_url_allowed(url: Column, blocked: Column, allowed: Column, prefixes: Column) -> Column:
    """No blocked pattern, one allowed pattern if there are any, one language prefix if there are any; the root needs no prefix."""
    path = F.lower(url_path(url))
    none_blocked = ~F.exists(blocked, lambda p: F.regexp_like(path, p))
    some_allowed = (F.size(allowed) == 0) | F.exists(allowed, lambda p: F.regexp_like(path, p))
    language = (F.size(prefixes) == 0) | path.isin("", "/") | F.exists(prefixes, lambda p: F.startswith(path, p))
    return none_blocked & some_allowed & language


def relevance_score(url: Column, keywords: Column) -> Column:
    path = F.lower(url_path(url))
    hits = F.size(F.filter(keywords, lambda k: F.contains(path, k)))
    return F.when(F.size(keywords) == 0, 0.5).otherwise(F.least(F.lit(1.0), hits / F.greatest(F.size(keywords) * 0.3, F.lit(1.0))))


def canonical_url(url: Column) -> Column:
    """Without query and fragment, and without a trailing slash unless it is the root's."""
    bare = F.regexp_replace(url, r"[?#].*$", "")
    return F.when(url_path(bare) == "/", bare).otherwise(F.regexp_replace(bare, "/+$", ""))


def is_live_href(href: Column) -> Column:
    return (href != "") & ~F.exists(F.array(*map(F.lit, DEAD_PREFIXES)), lambda p: F.startswith(href, p))


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, without its . and .. segments."""
    parts = F.slice(F.split(path, "/"), 2, 1 << 20)
    last = F.element_at(parts, -1).isin(".", "..")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.array_append(acc, x)))
    kept = F.when(last, F.array_append(kept, F.lit(""))).otherwise(kept)
    plain = ~F.contains(path, F.lit("/."))
    return F.when(plain, path).otherwise(F.concat(F.lit("/"), F.array_join(kept, "/")))


def resolve(href: Column, base: Column) -> Column:
    """The absolute form of a link on the page base: absolute, scheme-relative, root-relative, document-relative, or a query."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    path, rest = F.regexp_extract(href, "^([^?#]*)", 1), F.regexp_extract(href, "^[^?#]*(.*)$", 1)
    own = F.when(url_path(base) == "", "/").otherwise(url_path(base))
    folder = F.regexp_extract(own, "^(.*/)", 1)
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(path == "", F.concat(root, own, rest))
        .otherwise(F.concat(root, without_dots(absolute), rest))
    )


def hrefs(html: Column) -> Column:
    """The targets of a page's links: tag and attribute in any case, in double, single or no quotes; what stands inside another attribute's quotes is neither a tag's end nor an attribute."""
    tags = F.regexp_extract_all(html, F.lit(r"""(?i)(<a\s(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>)"""), 1)
    return F.filter(F.transform(tags, lambda t: _attribute(t, "href")), lambda x: x.isNotNull())


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, without quotes and white space at its ends; null if it has none."""
    attributes = F.regexp_extract_all(tag, F.lit(r"""([^\s"'>/=]++\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>]++))"""), 1)
    own = F.get(F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}\s*=")), 0)
    value = F.regexp_extract(own, r"""(?s)^[^=]*=\s*["']?(.*?)["']?$""", 1)
    return F.btrim(F.replace(value, F.lit("&amp;"), F.lit("&")))


def page_base(html: Column, url: Column) -> Column:
    """What a page's links are relative to: its base tag's address, resolved, else its own."""
    own = _attribute(F.regexp_extract(html, r"""(?i)(<base\s(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>)""", 1), "href")
    return F.when(own.isNull() | (own == ""), url).otherwise(resolve(own, url))
