"""Places within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint


def place_in_group(rows: DataFrame, group: str, score: str, tie: str, name: str) -> DataFrame:
    """rows with ``name``: the place of each in its group by score, greatest first and equal ones by tie, without sorting a group in one task.

    Rows are dealt into ranges of (group, score, tie), whatever share one group or
    score has; places count inside a group's part of a range, and what the group
    holds in the ranges before is added. Null scores come last; null groups are one
    group.
    """
    best_first = F.col(score).desc()
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = checkpoint(rows.repartitionByRange(n, F.col(group), best_first, F.col(tie)).withColumn("__range", F.spark_partition_id()))  # ranges must not be drawn twice
    counts = dealt.groupBy(F.col(group).alias("__g"), F.col("__range").alias("__r")).agg(F.count("*").alias("__n"))  # a row for each range of a group
    above = F.sum("__n").over(W.partitionBy("__g").orderBy("__r").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__g", "__r", F.coalesce(above, F.lit(0)).alias("__above"))
    inside = F.row_number().over(W.partitionBy("__range", group).orderBy(best_first, tie))
    ranked = dealt.withColumn("__in", inside).join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return ranked.withColumn(name, (F.col("__in") + F.col("__above")).cast("int")).select(*rows.columns, name)
