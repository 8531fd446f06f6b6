"""Token counts behind a digest cache.

A text's digest and the tokenizer file's digest name a stored count. Only
distinct digests without one are encoded, each once, and what was encoded is
appended to the cache, a Parquet folder that later runs read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import small_batches
from ._tokenizers import ByteLevelCounter, load, tokenizer_path, version_digest

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("version", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("run", T.StringType())])


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens, run) of one tokenizer version; an absent folder is an empty cache."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens", "run")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"), F.min("run").alias("run"))


def _encode(rows: DataFrame, path: str, version: str, now: str) -> DataFrame:
    """CACHE_SCHEMA of rows(digest, text), in which repeated rows follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, before = load(ByteLevelCounter, path).count, None
        for batch in small_batches(batches):
            digests, counts = [], []
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if digest != before:
                    digests.append(digest)
                    counts.append(count(text.as_py()))
                    before = digest
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64()), pa.array([now] * len(counts), pa.string())], names=CACHE_SCHEMA.names)

    return rows.mapInArrow(run, CACHE_SCHEMA)


def token_counts(docs: DataFrame, cache: str, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit, cached (whether an earlier run had stored the count).

    ``cache`` is the folder of stored counts; it is appended to. Texts are
    normalised by taking null as empty and by nothing else, as any other change
    could change the count. Null ids pass through; repeated rows give repeated
    results and are encoded once; an empty table gives none; other columns are
    ignored. A run that fails after appending leaves valid counts behind.
    """
    spark = docs.sparkSession
    path, now = vocabulary or tokenizer_path(VOCABULARY), uuid.uuid4().hex
    version = version_digest(path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    misses = rows.select("digest", "id").join(read_cache(spark, cache, version).select("digest"), "digest", "left_anti")
    chosen = misses.groupBy("digest").agg(F.min("id").alias("least")).hint("merge")
    one = (rows.digest == chosen.digest) & rows.id.eqNullSafe(chosen.least)
    _encode(rows.join(chosen, one, "left_semi").select("digest", "text"), path, version, now).write.mode("append").parquet(cache)
    sized = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(read_cache(spark, cache, version), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), (F.col("run") != now).alias("cached"))
