"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that count as white space, the same in both regex engines.
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Symbols that cleaning removes, without and with the hyphen.
SYMBOLS = r"[✔©✅ℹ️⚠❌📊📄🔗📂📜📌📏]"
SYMBOLS_AND_HYPHEN = r"[✔©✅ℹ️⚠❌📊📄🔗📂📜📌📏\-]"

#: What cleaning removes from Markdown, in order. (?iu) folds case, (?m) anchors at lines, (?d) knows \n only.
MARKDOWN_NOISE = (
    r"(?s)!\[.*?\]\(.*?\)",
    r"(?iud)\[(?:Download|Print|View|Overview|Back to).*?\]\(.*?\)",
    r"(?iud)Previous slide",
    r"(?iud)Next slide",
    r"(?iud)Slide \d+ of \d+",
    r"(?iud)\[closed envelope E-Mail\]\(.*?\)",
    r"(?iud)\[Hotline\]\(.*?\)",
    r"(?iud)\[FAQ\]\(.*?\)",
    r"(?iud)<desc>.*?</desc>",
    r"(?iud)©\s*.*?(?:\.com|\d{4})",
    SYMBOLS,
    r"(?imud)^.*?\]\(/en/working-in-germany/job-listings\?tx_solr.*$",
    r"(?iud)Translate it via your browser\.",
    r"(?iud)Google Translate is a third-party provider\.",
    r"(?iud)Find points of contact all over the world",
    r"(?iud)\* \[Living in Germany\]\(.*?\) \* \[Housing & mobility\]\(.*?\)",
)


#: The characters of SPACE.
SPACE_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Text without white space at its ends; looks at the ends only."""
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def collapse_whitespace(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{SPACE}+", " "))


def preserve_paragraphs(text: Column) -> Column:
    """Runs of spaces and tabs as one space, trimmed lines, at most one blank line in a row."""
    lines = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n")
    return strip(F.regexp_replace(lines, r"\n{3,}", "\n\n"))


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the text in lower case with white space collapsed."""
    return F.sha2(collapse_whitespace(F.lower(text)), 256)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def point_id(text_hash: Column) -> Column:
    """A stable 63-bit id from a hex hash."""
    return F.conv(F.substring(text_hash, 1, 15), 16, 10).cast("long")


#: What a text in lower case must hold for each of the patterns to match; letters whose case folds in one way only.
NOISE_NEEDS = ("![", "[", "rev", "next", " of ", "[", "[", "[", "<de", "©", "", "](/en/wor", "tran", "goo", "nd po", "* [l")


def _without(pattern: str, needs: str) -> Callable[[Column], Column]:
    return lambda t: F.when(F.contains(F.lower(t), F.lit(needs)), F.regexp_replace(t, pattern, "")).otherwise(t)


def clean_markdown(text: Column, newline_mode: str = "preserve", strip_hyphens: bool = False) -> Column:
    """Markdown without images, boilerplate links and interface noise.

    newline_mode "collapse" and strip_hyphens give the literal variant, which
    makes one line of a document and removes all hyphens. Most texts match few
    of the patterns, so each is tried only where a plain search finds its needs.
    """
    for pattern, needs in zip(MARKDOWN_NOISE, NOISE_NEEDS, strict=True):
        if not needs:
            text = F.regexp_replace(text, SYMBOLS_AND_HYPHEN if strip_hyphens else SYMBOLS, "")
        else:
            text = F.get(F.transform(F.array(text), _without(pattern, needs)), 0)
    return collapse_whitespace(text) if newline_mode == "collapse" else preserve_paragraphs(text)


def strip_markup(text: Column) -> Column:
    """Text without HTML comments and tags, headers with one space, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")
    return collapse_whitespace(F.regexp_replace(text, r"(?md)^(#{2,})\s+", "$1 "))


def section_title(text: Column, end: Column) -> Column:
    """The last Markdown header that begins before the position, else General."""
    headers = F.filter(F.split(F.left(text, end), "\n"), lambda x: x.rlike(r"^#+\s+"))
    return F.when(F.size(headers) > 0, F.btrim(F.element_at(headers, -1))).otherwise("General")


def truncate(text: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.left(text, F.lit(length - len(suffix))), F.lit(suffix)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Pieces that end in . ! or ? before white space, stripped, empties dropped."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){SPACE}+"), strip), lambda x: x != "")


def extract_urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s)]+)"), 1))


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
