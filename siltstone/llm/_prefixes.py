"""Candidates in large groups of sets: prefixes of rare members first.

Two sets of a Jaccard similarity of t or more share most of their members, so in
any common order their first shared member comes early in both: within the first
``s - ceil(2ts / (1 + t)) + 1`` of the smaller one, and within the first
``s - ceil(ts) + 1`` of the larger. Sets are filed under these members only, rare
ones first, and a member that is early enough in none of its sets is left out.
No pair is lost.

Rarity is read from 2^16 counts of hashed members over all of the sets. Sets that
differ from each other in a tenth of their members or more meet few others then;
sets that differ in less are mostly one component, which dealt() links in linear
work. Only where a member's sets are neither, across() forms a group of each two
chunks of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix64, small_batches

SLOT_BITS = 16


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many members of all sets(hashes) fall into each slot: an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in small_batches(batches):
            n += np.bincount(_slot(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])

    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for r in sets.select("hashes").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # 2^16 rows at most
        counts[r.slot] = r.n
    return counts


def prefix_lengths(size: int | np.ndarray, tenths: int) -> tuple[int, int] | tuple[np.ndarray, np.ndarray]:
    """How many members a set is filed under as the smaller and as the larger one of a pair; of arrays of sizes as well."""
    return size + (-2 * tenths * size) // (10 + tenths) + 1, size + (-tenths * size) // 10 + 1


def prefix_keys(sets: DataFrame, counts: np.ndarray, tenths: int) -> DataFrame:
    """(name, node, short) of sets(name, node, hashes): a name for each early member, and whether it is early enough for the smaller set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            names, nodes, short = [], [], []
            groups = mix64(np.asarray(batch.column(0)).view(np.uint64))
            for group, node, raw in zip(groups, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint64)
                few, more = prefix_lengths(len(own), tenths)
                own = own[np.lexsort((own, counts[_slot(own)]))][:more]
                names.append(mix64(own ^ group))
                nodes.append(np.full(len(own), node, np.int64))
                short.append(np.arange(len(own)) < few)
            if names:
                columns = [np.concatenate(names).view(np.int64), np.concatenate(nodes), np.concatenate(short)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["name", "node", "short"])

    return sets.select("name", "node", "hashes").mapInArrow(run, "name long, node long, short boolean")


def shared_members(keys: DataFrame) -> DataFrame:
    """(name, node, n) of prefix_keys(): what shares a member with others, n sets in all, and is near enough for one of them."""
    sizes = keys.groupBy("name").agg(F.count("*").alias("n"), F.max("short").alias("short")).where("n > 1 and short").select("name", "n")
    return keys.select("name", "node").join(sizes, "name")


def unsettled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Those of rows(name, node, ...) whose name has nodes of several components; nodes without a label are their own."""
    known = rows.select("name", "node").join(labels, "node", "left").groupBy("name").agg(F.min(F.coalesce("label", "node")).alias("a"), F.max(F.coalesce("label", "node")).alias("b"))
    return rows.join(known.where("a <> b").select("name"), "name", "left_semi")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """(name, node) of rows(name, node, n): each node in one chunk of about ``most``, and the chunks' least nodes in chunks again, up to one."""
    level = rows.select("name", "node", F.col("n").cast("long").alias("n"))
    found = rows.select("name", "node").limit(0)
    depth = 0
    while (top := level.agg(F.max("n")).first()[0]) is not None:
        chunked = level.withColumn("chunks", F.expr(f"(n + {most - 1}) div {most}"))
        chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(depth)), F.col("chunks")))
        found = found.unionByName(chunked.select(F.xxhash64("name", F.lit(depth), "chunk").alias("name"), "node"))
        if top <= most:
            break
        level = chunked.where("chunks > 1").groupBy("name", "chunk", "chunks").agg(F.min("node").alias("node")).select("name", "node", F.col("chunks").alias("n"))
        depth += 1
    return found


def across(rows: DataFrame, most: int) -> DataFrame:
    """(name, node) of rows(name, node, n): a set of each two chunks of a name's nodes, ``most`` nodes in both."""
    parts = rows.withColumn("chunks", F.ceil(2 * F.col("n") / most).cast("int"))
    parts = parts.withColumn("own", F.pmod(F.xxhash64("node"), "chunks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return parts.select(F.xxhash64("name", F.least("own", "with"), F.greatest("own", "with")).alias("name"), "node")
