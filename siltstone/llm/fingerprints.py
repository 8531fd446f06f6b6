"""Document fingerprints by SimHash, in DataFrame operations only.

A text's lower-case words are its terms, once for each occurrence, weighted by
about the square of their length: short words say little about a text. Every term
hash votes with its weight on 64 signed bits. The votes are summed two bits to
a long: 32 sums of shifted and masked hashes hold all 64 counters, and a text's
words are added up in the task that splits them.

Close fingerprints are found with permuted block tables: two fingerprints
within the radius agree on all but ``radius`` of the blocks, so each table
joins on one choice of the remaining blocks.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import partitions

SPACES = "[\\x20\\x09-\\x0D]+"
MOST_BYTES = 15
RADIUS, BLOCKS = 3, 6
LANES, LANE_MASK = 32, (1 << 32) | 1


def _votes(word: Column) -> list[Column]:
    """The total weight, and for each k the votes for bits k (low half) and k + 32 (high half).

    A weight is at most a word's bytes and a text shorter than 2 GiB, so neither half overflows.
    """
    size = F.least(F.octet_length(word), F.lit(MOST_BYTES))
    weight = F.greatest(F.shiftright(size * size, 4), F.least(size, F.lit(1))).cast("long")
    hashed = F.xxhash64(word)
    lanes = [F.sum(weight * F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(LANE_MASK))).alias(f"v{k}") for k in range(LANES)]
    return [F.sum(weight).alias("weight"), *lanes]


def _signs() -> Column:
    """The fingerprint from _votes(): a bit is set if its votes are over half the weight."""
    out = F.lit(0).cast("long")
    for k in range(LANES):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for votes, bit in ((low, k), (high, k + 32)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(2 * votes > F.col("weight"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, fp) of rows; keys must name a row. Null, empty and wordless texts have fingerprint 0."""
    words = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SPACES)).alias("word"))
    return words.groupBy(*keys).agg(*_votes(F.col("word"))).select(*keys, _signs().alias("fp"))


def hex_fingerprint(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of bits that agree."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def block_tables(radius: int = RADIUS, blocks: int = BLOCKS) -> list[int]:
    """One mask, as a signed long, for each choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    masks = [sum(c) for c in combinations(own, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def find_within(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, also: tuple[str, ...] = ()) -> DataFrame:
    """(query, fp, also..., distance): for each of queries(query) all of fps(fp, also...) within radius, each pair once.

    Both sides hold distinct fingerprints; null ones meet none, and an empty side
    gives no rows. A pair is reported by the first table in which it meets, so
    the join returns hits only; what is summed by query is summed where it joins.
    """
    masks = block_tables(radius, blocks)
    all_masks = F.array(*[F.lit(m) for m in masks])

    def filed(df: DataFrame, name: str, *others: str) -> DataFrame:
        tables = F.posexplode(all_masks).alias("t", "mask")
        return df.select(name, *others, tables).select(name, *others, "t", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    a, b = filed(queries, "query"), filed(fps, "fp", *also)
    differ = F.col("query").bitwiseXOR(F.col("fp"))
    first = F.lit(len(masks))
    for t, m in reversed(list(enumerate(masks))):
        first = F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)).otherwise(first)
    met = (a.t == b.t) & (a.key == b.key) & (F.bit_count(differ) <= radius) & (a.t == first)
    # both sides grow with the table, and estimates miss the growth by tables: never a broadcast
    return a.join(b.hint("merge"), met).select("query", "fp", *also, F.bit_count(differ).alias("distance"))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, rn, edge, id, text, next): each document with the next one's text, in descending order of id.

    Ids are dealt into buckets between approximate quantiles, which are ids of
    the table; a bucket also gets a copy of the next bucket's first row, marked
    as edge. So every bucket finds its successors by itself and no task sees the
    whole order. Null ids come last; equal ids go by text, descending; after the
    last document comes the first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = 2 * partitions(docs.sparkSession)
    shares = [i / n for i in range(1, n + 1)]
    facts = rows.agg(F.percentile_approx("id", shares, 100 * n).alias("cuts"), F.count_if(F.col("id").isNull()).alias("nulls")).first()
    cuts = sorted(set(facts.cuts or []))
    known = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    bucket = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.size(F.filter(known, lambda c: c < F.col("id"))))
    firsts = rows.where(F.col("id").isin(cuts) | F.col("id").isNull() if facts.nulls else F.col("id").isin(cuts)).groupBy("id").agg(F.max("text").alias("text"))
    wrap = -1 if facts.nulls else 0
    before = F.when(F.col("id").isNull(), F.lit(0 if cuts else -1)).when(F.col("id") == F.lit(cuts[-1] if cuts else None), F.lit(wrap)).otherwise(F.array_position(known, F.col("id")).cast("int"))
    edges = firsts.select(before.alias("bucket"), F.lit(True).alias("edge"), "id", "text")
    both = rows.select(bucket.alias("bucket"), F.lit(False).alias("edge"), "id", "text").unionByName(edges)
    order = W.partitionBy("bucket").orderBy("edge", F.col("id").desc_nulls_last(), F.col("text").desc())
    return both.select("*", F.row_number().over(order).alias("rn"), F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_chars, edited_sha256, fp, edited_fp, next_fp.

    The edited text has its last half replaced by the start of the next document.
    Null texts count as empty; a lone document is its own next; repeated rows
    are documents of their own; an empty table gives none; other columns are
    ignored.
    """
    pairs = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - tail), F.left("next", tail))
    keys = ["bucket", "rn", "edge", "id", "n_chars", "edited_sha256"]
    pairs = pairs.withColumn("edited", edited).withColumn("edited_sha256", F.sha2("edited", 256))
    sides = pairs.select(*keys, F.posexplode(F.array("text", "edited")).alias("side", "said"))
    own = fingerprints(sides, [*keys, "side"], "said")
    both = own.groupBy(*keys).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    order = W.partitionBy("bucket").orderBy("rn")
    out = both.withColumn("next_fp", F.lead("fp").over(order)).where(~F.col("edge"))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")
