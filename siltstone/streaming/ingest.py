"""Incremental ingestion of a landing folder with Structured Streaming.

All tables are append-only Parquet, partitioned by run, so a run that is
repeated after a failure replaces its own rows and nothing else:

- documents: the state of each document that the run took in or deleted,
- holders: which documents hold which chunks, many to many, with their places,
- chunks: what a chunk is, once for each text: payload, vector and point id,
- runs: one row of totals.

Tables are compressed with zstd, and what a step shuffled is dropped before the
next one begins.

A document's present chunks are those of its latest run. A chunk lives while any
document holds it: it outlives the document that brought it, and is gone with the
last. What an earlier run stored is replaced without being rewritten; compact()
folds finished runs into one base, which leaves out what no longer counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import token_estimate
from ..functions.text import content_hash, point_id
from ..operators.chunking import chunk_documents
from ..operators.dedup import classify_changes, first_wins
from ..session import release, scratch
from ..sources.models import hashed_embedding
from ..sources.tables import drop_table, ensure_table, read_table

SCHEMA = "doc_id long, text string"
DOCUMENTS = "doc_id long, content_hash string, status string, error string, chunks_ingested long, chunks_skipped long, run_id long"
HOLDERS = "text_hash string, doc_id long, section_index int, child_index int, chunk_id string, is_parent boolean, referenced_urls array<string>, stored boolean, run_id long"
CHUNKS = "text_hash string, text string, point_id long, vector array<float>, run_id long"
RUNS = "documents_processed long, documents_unchanged long, chunks_ingested long, chunks_skipped long, error_count long, errors array<string>, total_tokens long, success boolean, run_id long"
BASES = "base long, upto long"
NO_CHUNKS = "Chunking produced no chunks"
#: Errors that a run's row quotes; failures() has all of them.
QUOTED_ERRORS = 100


def _base(spark: SparkSession, out: str) -> tuple[int, int]:
    """The number of the store's base and the last run in it; -1 and -1 without one."""
    last = read_table(spark, f"{out}/bases", BASES).agg(F.max(F.struct("base", "upto")).alias("b")).first().b
    return (last.base, last.upto) if last else (-1, -1)


def _rows(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """A table of the store: its base and the runs after it."""
    base, upto = _base(spark, out)
    runs = read_table(spark, f"{out}/{name}", schema)
    return runs if base < 0 else read_table(spark, f"{out}/base-{base}/{name}", schema).unionByName(runs.where(F.col("run_id") > upto))


def _new_run(spark: SparkSession, out: str, run_id: int) -> None:
    if run_id <= (upto := _base(spark, out)[1]):
        raise ValueError(f"run {run_id} is part of the store's base, which ends with run {upto}")


def compact(spark: SparkSession, out: str) -> int | None:
    """Folds all runs into a new base and deletes their files; the last run folded, None where there is nothing new.

    The base holds each document's latest state and all failures, the present
    holders, and the chunks that live. It counts as soon as its row in bases is
    written; a crash before that leaves the store as it was, one after it leaves
    files that no reader looks at. A run that was not finished must be repeated
    first. Nothing else may work on the store meanwhile.
    """
    base, upto = _base(spark, out)
    documents = _rows(spark, out, "documents", DOCUMENTS)
    last = documents.agg(F.max("run_id")).first()[0]
    if last is None or last <= upto:
        return None
    finished = read_table(spark, f"{out}/runs", RUNS).select("run_id")
    if not documents.where((F.col("run_id") > upto) & (F.col("status") != "deleted")).join(finished, "run_id", "left_anti").isEmpty():
        raise RuntimeError("a run of the store is not finished: repeat it before compacting")
    latest = documents.groupBy("doc_id").agg(F.max("run_id").alias("run_id"))
    counts = documents.join(latest.withColumn("latest", F.lit(True)), ["doc_id", "run_id"], "left").where("latest or status = 'failed'").drop("latest")
    holders = present_holders(spark, out)
    chunks = _rows(spark, out, "chunks", CHUNKS)
    first = chunks.groupBy("text_hash").agg(F.min("run_id").alias("run_id")).join(holders.select("text_hash").distinct(), "text_hash", "left_semi")
    living = chunks.join(first, ["text_hash", "run_id"], "left_semi")  # texts and vectors are shuffled once and not aggregated
    for name, schema, rows in (("documents", DOCUMENTS, counts), ("holders", HOLDERS, holders), ("chunks", CHUNKS, living)):
        rows.select([x.split()[0] for x in schema.split(", ")]).write.option("compression", "zstd").mode("overwrite").parquet(f"{out}/base-{base + 1}/{name}")
        release(spark)
    spark.createDataFrame([(base + 1, last)], BASES).coalesce(1).write.mode("append").parquet(f"{out}/bases")
    for name, schema in (("documents", DOCUMENTS), ("holders", HOLDERS), ("chunks", CHUNKS)):
        for r in read_table(spark, f"{out}/{name}", schema).where(F.col("run_id") <= last).select("run_id").distinct().collect():  # the runs since the last base
            drop_table(spark, f"{out}/{name}/run_id={r.run_id}")
    drop_table(spark, f"{out}/base-{base}")
    return last


def document_state(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """(doc_id, content_hash, status, error, run_id): each document as its last run, before the one named, left it."""
    rows = _rows(spark, out, "documents", DOCUMENTS)
    if before is not None:
        rows = rows.where(F.col("run_id") < before)
    row = F.struct("content_hash", "status", "error", "run_id")
    return rows.groupBy("doc_id").agg(F.max_by(row, "run_id").alias("r")).select("doc_id", "r.*")


def failures(spark: SparkSession, out: str, run_id: int) -> DataFrame:
    """(doc_id, error) of a run."""
    return _rows(spark, out, "documents", DOCUMENTS).where((F.col("run_id") == run_id) & (F.col("status") == "failed")).select("doc_id", "error")


def present_holders(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """The rows of holders that count: those of each document's latest run. Failed and deleted documents have none."""
    state = document_state(spark, out, before).where("status = 'ingested'").select("doc_id", "run_id")
    rows = _rows(spark, out, "holders", HOLDERS)
    if before is not None:
        rows = rows.where(F.col("run_id") < before)
    return rows.join(state, ["doc_id", "run_id"], "left_semi")


def chunk_holders(spark: SparkSession, out: str) -> DataFrame:
    """(text_hash, n_holders, n_places): how many documents hold each living chunk, and how often."""
    return present_holders(spark, out).groupBy("text_hash").agg(F.count_distinct("doc_id").alias("n_holders"), F.count("*").alias("n_places"))


def present_chunks(spark: SparkSession, out: str, before: int | None = None, said: tuple[str | Column, ...] = ("text", "point_id", "vector")) -> DataFrame:
    """Each living chunk once, in the place of the holder that has had it longest (least run, document, section, child).

    ``said``: what of chunks the rows hold, taken where chunks are read.
    """
    owner = first_wins(present_holders(spark, out, before).drop("stored"), ["text_hash"], ["run_id", "doc_id", "section_index", "child_index"])
    chunks = _rows(spark, out, "chunks", CHUNKS)
    first = chunks.groupBy("text_hash").agg(F.min("run_id").alias("stored_by"))
    own = chunks.select("text_hash", *said, F.col("run_id").alias("stored_by"))
    return owner.join(first, "text_hash").join(own, ["text_hash", "stored_by"]).drop("stored_by")


def _write_run(rows: DataFrame, path: str, schema: str, run_id: int) -> None:
    """Writes a run's rows of a table, in place of what an earlier try of the run left: its own folder, so that nothing is sorted by run."""
    rows.select([x.split()[0] for x in schema.split(", ")]).drop("run_id").write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/run_id={run_id}")
    release(rows.sparkSession)


def ingest_batch(docs: DataFrame, out: str, run_id: int, force: bool = False) -> None:
    """Takes in docs(doc_id, text) as one run.

    Documents whose stored content is the same are passed over; their rows in
    documents are not written again. Others are chunked anew, which replaces
    their chunks. A chunk that another document holds already, or that comes
    earlier in the batch, is skipped in the counts, but both hold it. Documents
    without chunks are marked failed. Of rows that share an id the one with the
    greatest content hash counts; rows without an id are left out. The totals are
    observed while the tables are written.
    """
    spark = docs.sparkSession
    _new_run(spark, out, run_id)
    for name in ("documents", "holders", "chunks", "runs"):
        ensure_table(spark, f"{out}/{name}")
    run = F.lit(run_id).cast("long")
    rows = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("content_hash", content_hash(F.col("text")))
    if not rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.max_by("text", "content_hash").alias("text"), F.max("content_hash").alias("content_hash"))
    seen, kept, done = Observation(), Observation(), Observation()
    classed = classify_changes(rows, document_state(spark, out, run_id), force=force).observe(seen, F.count_if(F.col("change") == "unchanged").alias("unchanged"))
    taken, light, made = (scratch(spark, x) for x in ("taken", "light", "chunks"))
    classed.where("change <> 'unchanged'").select("doc_id", "text", "content_hash").write.option("compression", "zstd").parquet(taken)
    release(spark)
    texts = spark.read.schema("doc_id long, text string, content_hash string").parquet(taken)
    texts.select("doc_id", "content_hash").write.parquet(light)
    work = spark.read.schema("doc_id long, content_hash string").parquet(light)
    chunk_documents(texts.withColumn("title", F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))).withColumn("tokens", token_estimate(F.col("text")).cast("long")).write.option("compression", "zstd").parquet(made)
    drop_table(spark, taken)
    release(spark)
    chunks = spark.read.schema(HOLDERS.replace("stored boolean, run_id long", "text string, tokens long")).parquet(made)

    place = ["doc_id", "section_index", "child_index"]
    elsewhere = present_holders(spark, out, run_id).join(work.select("doc_id"), "doc_id", "left_anti").select("text_hash").distinct()
    first = first_wins(chunks.select("text_hash", *place), ["text_hash"], place).join(elsewhere, "text_hash", "left_anti").withColumn("stored", F.lit(True))
    held = chunks.drop("text").join(first, ["text_hash", *place], "left").withColumn("stored", F.coalesce("stored", F.lit(False))).withColumn("run_id", run)
    tokens = F.coalesce(F.sum(F.when(F.col("stored"), F.col("tokens"))), F.lit(0)).cast("long")
    _write_run(held.observe(kept, tokens.alias("tokens")), f"{out}/holders", HOLDERS, run_id)

    known = _rows(spark, out, "chunks", CHUNKS).where(F.col("run_id") != run_id).select("text_hash").distinct()
    fresh = first_wins(chunks.select("text_hash", *place), ["text_hash"], place).join(known, "text_hash", "left_anti").select(place)
    said = chunks.select("text_hash", "text", *place).join(fresh, place, "left_semi")  # texts are shuffled once and not aggregated
    _write_run(said.withColumn("point_id", point_id(F.col("text_hash"))).withColumn("vector", hashed_embedding(F.col("text"))).withColumn("run_id", run), f"{out}/chunks", CHUNKS, run_id)
    drop_table(spark, made)

    own = _rows(spark, out, "holders", HOLDERS).where(F.col("run_id") == run_id).groupBy("doc_id").agg(F.count("*").alias("made"), F.count_if("stored").alias("chunks_ingested"))
    each = work.select("doc_id", "content_hash").join(own, "doc_id", "left").fillna(0, ["made", "chunks_ingested"]).withColumn("chunks_skipped", F.col("made") - F.col("chunks_ingested"))
    failed = F.col("made") == 0
    each = each.withColumn("status", F.when(failed, "failed").otherwise("ingested")).withColumn("error", F.when(failed, F.lit(NO_CHUNKS))).withColumn("run_id", run)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    _write_run(each.observe(done, F.count_if(~failed).alias("taken"), total("chunks_ingested"), total("chunks_skipped"), F.count_if(failed).alias("failed")), f"{out}/documents", DOCUMENTS, run_id)

    t, unchanged = done.get, seen.get["unchanged"]
    quoted = [f"{r.doc_id}: {r.error}" for r in failures(spark, out, run_id).orderBy("doc_id").limit(QUOTED_ERRORS).collect()] if t["failed"] else []
    row = (t["taken"] + unchanged, unchanged, t["chunks_ingested"], t["chunks_skipped"], t["failed"], sorted(quoted), kept.get["tokens"], t["failed"] == 0, run_id)
    _write_run(spark.createDataFrame([row], RUNS), f"{out}/runs", RUNS, run_id)
    drop_table(spark, light)


def delete_documents(ids: DataFrame, out: str, run_id: int) -> None:
    """Marks the stored documents of ids(doc_id) deleted, as one run; the chunks that no other document holds are gone with them."""
    _new_run(ids.sparkSession, out, run_id)
    state = document_state(ids.sparkSession, out, run_id).where("status <> 'deleted'").join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    none = F.lit(0).cast("long")
    _write_run(state.select("doc_id", "content_hash", F.lit("deleted").alias("status"), F.lit(None).cast("string").alias("error"), none.alias("chunks_ingested"), none.alias("chunks_skipped"), F.lit(run_id).cast("long").alias("run_id")), f"{out}/documents", DOCUMENTS, run_id)


def next_run(spark: SparkSession, out: str) -> int:
    """A run id that no table of the store has."""
    last = [rows.agg(F.max("run_id")).first()[0] for rows in (_rows(spark, out, "documents", DOCUMENTS), read_table(spark, f"{out}/runs", RUNS))]
    return max([-1, *(x for x in last if x is not None)]) + 1


def ingest_available(spark: SparkSession, landing: str, out: str) -> None:
    """Takes in whatever arrived in the landing folder since the last call, then stops.

    A micro-batch is a run, numbered after those that the store has. One that is
    repeated after a failure keeps the number that it was given first: what the
    stream's checkpoint calls a batch is noted beside it before the run begins.
    """

    def take(df: DataFrame, batch: int) -> None:
        numbers = read_table(spark, f"{out}/batches", "batch long, run_id long")
        given = numbers.where(F.col("batch") == batch).first()
        run = given.run_id if given else max(next_run(spark, out), (numbers.agg(F.max("run_id")).first()[0] or -1) + 1)
        if given is None:
            spark.createDataFrame([(batch, run)], "batch long, run_id long").coalesce(1).write.mode("append").parquet(f"{out}/batches")
        if run > _base(spark, out)[1]:  # else it was finished, and folded before the checkpoint knew
            ingest_batch(df, out, run)

    stream = spark.readStream.schema(SCHEMA).parquet(landing).writeStream
    stream = stream.foreachBatch(take).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True)
    stream.start().awaitTermination()
