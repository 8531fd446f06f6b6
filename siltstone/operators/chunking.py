"""Documents into sections, sections into parent and child chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_hash, extract_urls, strip

CHUNK_SIZE, MIN_CHILD_LENGTH = 512, 150
BATCH_ROWS = 64  # texts of an Arrow batch that are Python strings at once
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def sections(text: Column) -> Column:
    """An array of (header, content) by H2 and H3 lines; what stands before the first is the Introduction. Empty sections are dropped."""

    def one(piece: Column) -> Column:
        headed, first = piece.rlike("^#{2,3} "), F.substring_index(piece, "\n", 1)
        said = F.when(headed, F.substr(piece, F.length(first) + 2)).otherwise(piece)
        header = F.when(headed, strip(F.regexp_replace(first, "^#{2,3} ", ""))).otherwise("Introduction")
        return F.struct(header.alias("header"), strip(said).alias("content"))

    pieces = F.split(F.concat(F.lit("\n"), text), "\n(?=#{2,3} )")
    return F.filter(F.transform(pieces, one), lambda x: x["content"] != "")


def split_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """(key, also..., section_index, header, content): the sections of each row, numbered from 1.

    A row is split by itself: nothing is shuffled, and rows that share a key stay apart.
    """
    each = docs.select(key, *also, F.posexplode(sections(F.col(text))).alias("section_index", "s"))
    return each.select(key, *also, (F.col("section_index") + 1).alias("section_index"), "s.header", "s.content")


def pack_text(text: str, max_size: int = CHUNK_SIZE) -> list[str]:
    """Paragraphs, or sentences of paragraphs that are too long, packed greedily in order.

    A sentence counts one character for its separator and a paragraph two; the
    first unit after a full chunk counts none. A unit over the size stands alone.
    """
    units: list[tuple[str, int]] = []
    for p in text.split("\n\n"):
        p = p.strip()
        if len(p) > max_size:
            units += [(s, 1) for x in _SENTENCE_END.split(p) if (s := x.strip())]
        elif p:
            units.append((p, 2))
    done, open_, size = [], [], 0
    for unit, gap in units:
        if open_ and size + len(unit) > max_size:
            done.append(" ".join(open_))
            open_, size = [unit], len(unit)
        else:
            open_.append(unit)
            size += len(unit) + gap
    return [*done, " ".join(open_)] if open_ else done


def packed_chunks(text: Column, max_size: int = CHUNK_SIZE) -> Column:
    """pack_text() of each text, in Arrow batches: its running size has no built-in form that is linear in a text's length. Null stays null."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        pieces = (texts.slice(at, BATCH_ROWS).to_pylist() for at in range(0, len(texts), BATCH_ROWS))
        return pa.concat_arrays([pa.array([], kind), *(pa.array([None if t is None else pack_text(t, max_size) for t in piece], kind) for piece in pieces)])

    return run(text)


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", max_size: int = CHUNK_SIZE, min_length: int = MIN_CHILD_LENGTH) -> DataFrame:
    """Parent and child chunks of docs(key, text, title): of each section itself, and its packed pieces.

    Pieces under min_length characters are left out and leave a gap in the
    numbers. All chunks of a document come from its row, without a shuffle.
    """
    title_ = F.col("title") if title == "title" else F.col(title).alias("title")
    parts = split_sections(docs.select(key, text, title_), key, text, ("title",)).withColumn("packed", packed_chunks(F.col("content"), max_size))
    piece = lambda at, said, prefix: F.struct(at.cast("int").alias("child_index"), said.alias("said"), F.concat(prefix, F.lit("\n\n"), said).alias("text"))
    parent = F.array(piece(F.lit(0), F.col("content"), F.col("header")))
    prefix = F.concat(F.col("title"), F.lit(" | "), F.col("header"))
    own = F.filter(F.transform("packed", lambda x, i: piece(i + 1, x, prefix)), lambda x: F.length(x["said"]) >= min_length)
    each = parts.select(key, "section_index", F.explode(F.concat(parent, own)).alias("c"))
    is_parent, at = F.col("c.child_index") == 0, F.col("c.child_index")
    name = F.when(is_parent, F.lit("parent")).otherwise(F.concat(F.lit("child_"), at))
    return each.select(
        key, "section_index", at.alias("child_index"), F.concat_ws("_", F.col(key), F.lit("section"), "section_index", name).alias("chunk_id"),
        is_parent.alias("is_parent"), "c.text", canonical_hash(F.col("c.text")).alias("text_hash"), extract_urls(F.col("c.said")).alias("referenced_urls"),
    )


def display_title(title: Column, url: Column) -> Column:
    """The title, or the last part of the URL with spaces for hyphens and capitals."""
    tail = F.initcap(F.replace(F.substring_index(url, "/", -1), F.lit("-"), F.lit(" ")))
    return F.when(title != "", title).otherwise(tail)


def context_prefix(title: Column, url: Column, header: Column) -> Column:
    return F.concat(F.lit("Topic: "), display_title(title, url), F.lit(" | Section: "), header, F.lit("\n"))


def payload(chunks: DataFrame, sources: DataFrame, key: str = "doc_id", language: str = "de") -> DataFrame:
    """What is stored beside a chunk's vector: chunks(key, chunk_id, ...) with their document's row of sources.

    sources holds (key, source_url, source_title, authority_level, visa_types, published_at, fetched_at, language).
    """
    joined = chunks.join(sources, key, "left")
    header = F.when(F.col("is_parent"), F.substring_index("text", "\n\n", 1)).otherwise(F.substring_index(F.substring_index("text", "\n\n", 1), " | ", -1))
    return joined.select(
        "chunk_id", F.col(key).cast("string").alias("parent_doc_id"), F.coalesce("source_url", F.lit("")).alias("source_url"), "source_title",
        F.coalesce("authority_level", F.lit("third_party")).alias("authority_level"), F.coalesce("visa_types", F.array(F.lit("general"))).alias("visa_types"),
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"),
        header.alias("section_header"), "is_parent", F.coalesce("language", F.lit(language)).alias("language"), "text_hash", "text", "referenced_urls",
    )
