"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed hash. A source's target is met by whole copies of
all of its documents and one more copy of those whose hash lies below a
threshold. The threshold comes from sums by source and hash bucket: cumulative
sums name the bucket in which the budget ends, and only that bucket is split
again, until it holds one hash. Documents are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import WORD_SQL, store

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
HASH_BITS, LEVEL_BITS = 60, 12


def document_hash(id_col: str) -> F.Column:
    """The first 60 bits of the id's MD5; 0 for a null id."""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(id_col).cast("string").cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long"), F.lit(0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, copies, budget) from sizes(source, size), one row per source.

    All sizes are shared by weight; a target stops at ``most`` times its
    source's size, and what is over goes to the others by weight. With sources
    ordered by cap over weight, those that reach their cap come first, so the
    common level is that of the first that does not, the highest of the rest.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    each = totals.withColumn("place", place).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    each = each.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    each = each.withColumn("level", (everything - before) / left)
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    each = each.withColumn("target", F.when(F.col("level") <= F.col("ratio"), level * F.col("weight")).otherwise(F.col("cap")))
    copies = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    each = each.withColumn("copies", copies.cast("long"))
    return each.select("source", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, below): documents of a source with hash < below are taken once more. rows: (source, hash, size)."""
    shift = HASH_BITS - LEVEL_BITS
    open_ = targets.select("source", "budget", F.lit(0).cast("long").alias("prefix"))
    settled = None
    inside = rows.withColumn("prefix", F.lit(0).cast("long"))
    while True:
        parts = inside.join(open_.withColumnRenamed("source", "s").withColumnRenamed("prefix", "p"), F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")))
        parts = parts.groupBy("source", F.shiftright("hash", shift).alias("bucket"))
        parts = parts.agg(F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.first("budget").alias("budget"))
        order = W.partitionBy("source").orderBy("bucket")
        parts = parts.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") > F.col("budget"))
        edge = parts.groupBy("source").agg(F.min_by(F.struct("bucket", "lo", "hi", "size", (F.col("budget") - F.col("upto") + F.col("size")).alias("budget")), "bucket").alias("e")).select("source", "e.*")
        edge, _ = store(edge, "edges")
        one = (F.col("lo") == F.col("hi")) | F.lit(shift == 0)
        here = edge.where(one).select("source", F.when(2 * F.col("budget") >= F.col("size"), F.col("hi") + 1).otherwise(F.col("lo")).alias("below"))
        settled = here if settled is None else settled.unionByName(here)
        open_ = edge.where(~one).select("source", "budget", F.col("bucket").alias("prefix"))
        if open_.isEmpty():
            break
        inside = rows.withColumn("prefix", F.shiftright("hash", shift))
        shift -= LEVEL_BITS
    everything = F.lit(1 << HASH_BITS).cast("long")  # a source whose budget reaches past its last document
    return targets.select("source").join(settled.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", F.coalesce("below", everything).alias("below"))


def _planned(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, source, size, hash) of docs, and the plan (s, source_size, target, copies, below) of each source."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SQL)), F.lit(0)).cast("long")
    rows, _ = store(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), document_hash(id_col).alias("hash")), "sizes")
    targets, _ = store(source_targets(rows), "targets")
    below = thresholds(rows, targets).withColumnRenamed("source", "s")
    plan, _ = store(targets.join(below, F.col("source").eqNullSafe(F.col("s"))).select("s", "source_size", "target", "copies", "below"), "plan")
    return rows, plan


def _times(plan: DataFrame, hashed: F.Column) -> F.Column:
    """How often a document of the plan's source with this hash is taken."""
    return plan["copies"] + ((hashed < plan["below"]) & (plan["target"] > plan["copies"] * plan["source_size"])).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken, copies.

    copies says how often the mix takes the document, at most three times. Null
    texts have size 0; null is a source of its own, the last; null ids share one
    hash and are taken together; a source without words has target 0; repeated
    rows share their id's hash. An empty table gives none; other columns are
    ignored.
    """
    rows, plan = _planned(docs, id_col, source_col, text_col)
    out = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("times", _times(plan, F.col("hash")))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), F.col("times").alias("copies"))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them: each row as many times as its copies, columns unchanged.

    A row's copies follow from its source's plan and its own id, so only the
    plan, one row per source, is joined. Columns of docs may have any names.
    """
    _, plan = _planned(docs, id_col, source_col, text_col)
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), document_hash(id_col).alias("hash"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("times", _times(plan, F.col("hash"))).where("times > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")
