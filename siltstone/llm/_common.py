"""Shared helpers: intermediate tables, Arrow plumbing, connected components.

Intermediate results that are read more than once are written as Parquet under
the folder that the cluster names in ``spark.checkpoint.dir``; a lost executor
then costs only the tasks it was running. Nothing is kept on executors' disks;
without that setting only local mode runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, scratch

#: Words of every contract: runs of bytes other than space and 09-0D.
WORD_SQL = r"[^\x20\x09-\x0D]+"


#: Tables that store() wrote, oldest first.
_STORED: list[str] = []


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later read needs, and lets Spark drop the shuffles of plans that are done."""
    jvm = spark.sparkContext._jvm
    release(spark)
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df once and returns the table that was written, and its path."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _STORED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored() -> int:
    """How many tables store() has written: a mark for discard()."""
    return len(_STORED)


def discard(spark: SparkSession, mark: int, *keep: str) -> None:
    """Deletes all tables written since the mark but those to keep, when nothing reads them any more."""
    remove(spark, *(path for path in _STORED[mark:] if path not in keep))
    _STORED[mark:] = keep


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches, so that what Python holds of long texts stays bounded."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of the components of the edges u, v; a root is its component's least node and not listed.

    Union-find on arrays: roots that an open edge joins are hooked to the lesser
    one, then all paths are compressed.
    """
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        open_ = root[a] != root[b]
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(edges: DataFrame, most: int) -> DataFrame:
    """Edges (u, v) of a spanning forest of each partition's edges(u, v), at most ``most`` of them held at a time; v is the least node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def row() -> pa.RecordBatch:
            u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(tuple(np.asarray(c) for c in batch.columns))
            n += batch.num_rows
            if n >= most:
                yield row()
                held, n = [], 0
        if held:
            yield row()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, task_edges: int = 1 << 21) -> DataFrame:
    """(node, label) of every node in edges(u, v), both longs; label: the least node reachable.

    Every partition first reduces its own edges to a forest by union-find.
    Forests are merged by rounds of large-star and small-star steps: joins and
    aggregations that combine on the map side, so that no component is gathered
    in one task; their number grows with the logarithm of the longest path. As
    soon as all forests together have at most ``task_edges`` edges (32 MB), one
    task ends the work by union-find. Self-loops and nulls are left out.
    """
    spark = edges.sparkSession
    now, path = store(_forests(edges.where("u <> v").select("u", "v"), task_edges), "cc")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen.n <= task_edges:
            now = _forests(now.coalesce(1), seen.n + 1)
        elif (seen.n, seen.s) != mark:
            mark = (seen.n, seen.s)
            now = _star_round(now)
        else:
            break
        old = path
        now, path = store(now, "cc")
        remove(spark, old)
        if seen.n <= task_edges:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _star_round(now: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges(u, v), v less than u."""
    both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
