"""HTML into Markdown and metadata, by an event parser in Arrow batches.

Pages are malformed often enough that expressions cannot take them apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import iso_timestamp

#: Elements and classes that are not content.
NOISE_TAGS = frozenset({"script", "style", "nav", "footer", "header", "aside", "button"})
NOISE_CLASSES = frozenset({"sidebar", "navigation", "menu", "footer", "header", "cookie-banner", "ads", "social-share", "newsletter-signup", "breadcrumb", "breadcrumbs", "meta-navigation", "utility-nav", "slick-prev", "slick-next", "slider-nav", "carousel-control", "translate-banner", "google-translate-container", "btn", "contact-bar", "sharing-bar"})
#: Where content is looked for, best first.
MAIN = ("article", "main", "#main-content", ".main-content", "#content", ".content", "body")
BATCH_ROWS = 64  # pages of an Arrow batch that are Python strings at once
VOID = frozenset({"br", "img", "hr", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track"})
BLOCK = frozenset({"p", "div", "section", "article", "main", "ul", "ol", "table", "tr", "body", "blockquote", "pre"})


#: What stands around inline elements in Markdown.
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}


class _Reader(HTMLParser):
    """Collects metadata and, for each place content may be, its Markdown."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, list[str]]] = []
        self.out: dict[str, list[str]] = {"": []}
        self.title, self.in_title, self.meta = None, False, {}
        self.link: str | None = None
        self.lists: list[int | None] = []  # of each open list, its next number; None for bullets
        self.rows: list[int] = []  # of each open table, its rows so far
        self.cells = 0

    def _put(self, text: str) -> None:
        if not any(noise for _, noise, _ in self.stack):
            for name in {"", *(n for _, _, names in self.stack for n in names)}:
                self.out.setdefault(name, []).append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(own.get("property") or own.get("name") or "", own.get("content", ""))
        if tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n---\n\n")
        elif tag == "img":
            self._put(f"![{own.get('alt', '')}]({own.get('src', '')})")
        if tag in VOID:
            return
        if tag == "title" and self.title is None:  # the first one only
            self.title, self.in_title = "", True
        classes = set(own.get("class", "").split())
        noise = tag in NOISE_TAGS or tag == "title" or bool(classes & NOISE_CLASSES) or (tag == "nav" and own.get("aria-label") == "Breadcrumb")
        names = [n for n in MAIN if n == tag or n == f"#{own.get('id')}" or (n[0] == "." and n[1:] in classes)]
        names = [n for n in names if n not in self.out]
        for n in names:
            self.out[n] = []
        self.stack.append((tag, noise, names))
        if re.fullmatch("h[1-6]", tag):
            self._put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
            self._put("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            n = self.lists[-1] if self.lists else None
            self._put("\n* " if n is None else f"\n{n}. ")
            if n is not None:
                self.lists[-1] = n + 1
        elif tag == "table":
            self.rows.append(0)
            self._put("\n\n")
        elif tag == "tr":
            self.cells = 0
            self._put("\n|")
        elif tag in ("td", "th"):
            self.cells += 1
            self._put(" ")
        elif tag == "pre":
            self._put("\n\n```\n")
        elif tag == "blockquote":
            self._put("\n\n> ")
        elif tag in BLOCK:
            self._put("\n\n")
        elif tag in INLINE:
            self._put(INLINE[tag])
        elif tag == "a" and own.get("href"):
            self.link = own["href"]
            self._put("[")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if any(t == tag for t, _, _ in self.stack):
            while self.stack[-1][0] != tag:
                self._close(self.stack[-1][0])
                self.stack.pop()
            self._close(tag)
            self.stack.pop()

    def _close(self, tag: str) -> None:
        if tag == "a" and self.link is not None:
            self._put(f"]({self.link})")
            self.link = None
        elif tag in INLINE:
            self._put(INLINE[tag])
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._put("\n\n")
        elif tag in ("td", "th"):
            self._put(" |")
        elif tag == "tr" and self.rows:
            self.rows[-1] += 1
            if self.rows[-1] == 1:
                self._put("\n|" + " --- |" * self.cells)
        elif tag == "table" and self.rows:
            self.rows.pop()
            self._put("\n\n")
        elif tag == "pre":
            self._put("\n```\n\n")
        elif re.fullmatch("h[1-6]", tag) or tag in BLOCK - {"tr"}:
            self._put("\n\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        else:
            self._put(data if any(t == "pre" for t, _, _ in self.stack) else re.sub(r"\s+", " ", data))


def read_page(html: str | None, url: str | None) -> tuple[str, str, str | None, str | None]:
    """(markdown, title, description, published); markdown is empty where nothing can be read."""
    reader = _Reader()
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError):
        return "", url or "", None, None
    body = next((x for n in (*MAIN, "") if (x := "".join(reader.out.get(n, [])).strip())), "")
    body = re.sub(r"[ \t]+", " ", body)
    body = re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", body)).strip()
    meta = reader.meta
    return body, (reader.title or "").strip() or url or "", meta.get("og:description") or meta.get("description"), meta.get("article:published_time")


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, title, description, published, markdown); pages without content are dropped, and published is null where it is no timestamp."""
    kind = dict(pages.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, BATCH_ROWS) for whole in batches for at in range(0, whole.num_rows, BATCH_ROWS)):
            read = [read_page(h, u) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            keep = pa.array([bool(r[0]) for r in read], pa.bool_())
            columns = [batch.column(0), batch.column(1), *(pa.array([r[i] for r in read], pa.string()) for i in (1, 2, 3, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, url, "title", "description", "published", "markdown"]).filter(keep)

    found = pages.select(key, url, html).mapInArrow(run, f"{key} {kind}, {url} string, title string, description string, published string, markdown string")
    return found.withColumn("published", iso_timestamp(F.col("published")))


#: What stands at the ends of a title is removed if it is one of these: the space separators.
SEPARATORS = " \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def written_title(html: Column, url: Column) -> Column:
    """The first title element as it is written, of its references only &amp; read; the URL where it is empty or absent. extract_pages() reads all references."""
    title = F.replace(F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1), F.lit("&amp;"), F.lit("&"))
    return F.coalesce(F.nullif(F.btrim(title, F.lit(SEPARATORS)), F.lit("")), url)
