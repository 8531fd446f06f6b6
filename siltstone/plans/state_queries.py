"""State tables, caches, run reports and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import canonical_hash, content_hash, point_id
from ..operators import chunking, dedup
from ..operators.evaluation import after_quota, answered_cases, first_rows, health, metric_means
from ..session import scratch
from ..sources import tables
from ..sources.tables import read_table
from ..streaming import caches
from ..streaming.ingest import RUNS, chunk_holders, compact, delete_documents, document_state, ingest_batch, present_chunks, present_holders
from ._registry import AS_OF, FETCHED_SQL, LEVEL_SQL, WS, as_of, fetched_at, level, register, table
from .text_queries import _CHILDREN, _SECTIONS, _headed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ = lambda sql=None: register(QUERIES, ORACLE_SQL, sql)


@_("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents")
def content_change(spark, d):
    docs = table(spark, d, "documents").select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    old = F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash"))
    prior = docs.where("doc_id % 5 <> 0").select("doc_id", old.alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, "failed").otherwise("ingested").alias("status"))
    return dedup.classify_changes(docs, prior).select("doc_id", "change")


@_(f"SELECT ('0x' || substr(sha256(trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'))), 1, 15))::BIGINT AS point_id, max(doc_id) AS doc_id, arg_max(source, doc_id) AS source FROM documents GROUP BY ALL")
def upsert_latest(spark, d):
    rows = table(spark, d, "documents").select(point_id(canonical_hash(F.col("text"))).alias("point_id"), "doc_id", "source")
    return dedup.latest_wins(rows, ["point_id"], F.col("doc_id"))


@_("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def delete_by_doc(spark, d):
    return dedup.not_known(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels").where("toxic = 1"), "doc_id")


@_("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def current_status(spark, d):
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("status"))
    return dedup.current_state(e, "user_id", "seq", "status")


@_("WITH m AS (SELECT max(ts) AS t FROM events), n AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY user_id) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM n, m WHERE newest >= t - INTERVAL 24 HOUR)")
def cache_ttl(spark, d):
    e = table(spark, d, "events")
    latest = e.agg(F.max("ts").alias("t")).first().t
    return dedup.fresh_entries(e, "user_id", "ts", F.lit(latest), 24).select("event_id", "user_id")


_ASKED = f"TIMESTAMP '{AS_OF}' - (conv_id % 48) * INTERVAL 1 HOUR"


@_(f"""WITH cache AS (SELECT sha256(text) AS cache_key, arg_max(conv_id, ({_ASKED}, conv_id)) AS answer FROM conversations WHERE role = 'user' AND conv_id % 48 < 24 GROUP BY ALL)
SELECT conv_id, turn, coalesce(answer, -1) AS answer FROM conversations LEFT JOIN cache ON cache_key = sha256(text) WHERE role = 'user'""")
def answer_cache(spark, d):
    """Every user turn is looked up in a cache of the same turns, stored up to two days before; entries live a day."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    at = F.timestamp_micros(F.unix_micros(as_of()) - (F.col("conv_id") % 48) * 3_600_000_000)
    cache = asked.select(tables.answer_key(F.col("query")).alias("cache_key"), F.col("conv_id").alias("answer"), at.alias("at"))
    return tables.cached_answers(asked, cache, as_of(), 24).select("conv_id", "turn", F.coalesce("answer", F.lit(-1)).alias("answer"))


def _streamed(spark, rows, change):
    """What a stream over rows leaves, in one run from a new checkpoint."""
    landing, state, out = (scratch(spark, x) for x in ("landing", "stream-state", "streamed"))
    rows.write.parquet(landing)
    stream = change(spark.readStream.schema(rows.schema).parquet(landing))
    stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@_(ORACLE_SQL["answer_cache"])
def cache_stream(spark, d):
    """answer_cache as a stream with one entry of state a key: turns are stored at their times, and all are asked for at the end."""
    asked = table(spark, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", tables.answer_key(F.col("text")).alias("cache_key"))
    at = F.timestamp_micros(F.unix_micros(as_of()) - (F.col("conv_id") % 48) * 3_600_000_000)
    stored = asked.select("cache_key", at.alias("at"), F.lit(False).alias("is_query"), F.format_string("%018d", "conv_id").alias("answer"))
    queries = asked.select("cache_key").distinct().select("cache_key", as_of().alias("at"), F.lit(True).alias("is_query"), F.lit(None).cast("string").alias("answer"))
    answers = _streamed(spark, stored.unionByName(queries), lambda df: caches.cache_stream(df, 24))
    turns = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", tables.answer_key(F.col("text")).alias("cache_key"))
    return turns.join(answers, "cache_key", "left").select("conv_id", "turn", F.coalesce(F.col("answer").cast("long"), F.lit(-1)).alias("answer"))


@_("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Events that arrive twice, once each user and type, by a stream whose state the watermark bounds."""
    e = table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _streamed(spark, e.unionByName(e), lambda df: caches.distinct_within(df, ["user_id", "event_type"], "ts", "3650 days")).select("user_id", "event_type")


@_("SELECT event_type AS message, count(*) AS n FROM events WHERE value > 50 GROUP BY ALL ORDER BY n DESC, min(event_id) LIMIT 5")
def error_top5(spark, d):
    e = table(spark, d, "events").where("value > 50").withColumn("message", F.when(F.length("event_type") > 75, F.concat(F.left("event_type", F.lit(75)), F.lit("..."))).otherwise(F.col("event_type")))
    top = e.groupBy("message").agg(F.count("*").alias("n"), F.min("event_id").alias("seq"))
    return top.orderBy(F.col("n").desc(), "seq").limit(5).select("message", "n")


@_("SELECT date_trunc('day', ts) AS day, count(*) AS total, count(*) FILTER (value > 50) AS errors, count(*) FILTER (value <= 50) AS processed, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def run_summary(spark, d):
    e = table(spark, d, "events").groupBy(F.date_trunc("day", "ts").alias("day"))
    return e.agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("errors"), F.count_if(F.col("value") <= 50).alias("processed"), F.count_distinct("user_id").alias("users"))


@_("SELECT count(*) AS runs, count(DISTINCT user_id) AS domains FROM events")
def stats(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("runs"), F.count_distinct("user_id").alias("domains"))


@_("SELECT source, count(*) FILTER (doc_id % 2 = 0) AS from_sitemap, count(*) FILTER (doc_id % 3 = 0) AS from_crawling FROM documents GROUP BY source")
def cached_flag_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("from_sitemap"), F.count_if(F.col("doc_id") % 3 == 0).alias("from_crawling"))


_HASHED = f"sha256(trim(regexp_replace(lower(%s), '{WS}+', ' ', 'g')))"


@_(f"""SELECT doc_id || '_section_1_parent' AS chunk_id, doc_id::VARCHAR AS parent_doc_id, coalesce(source, '') AS source_url, 'Doc ' || doc_id AS source_title, {LEVEL_SQL} AS authority_level,
  CASE WHEN doc_id % 2 = 0 THEN 'work_visa' ELSE 'general' END AS visa_types, NULL::VARCHAR AS published_at, strftime({FETCHED_SQL}, '%Y-%m-%dT%H:%M:%S') AS fetched_at, 'Introduction' AS section_header, true AS is_parent,
  coalesce(lang, 'de') AS language, {_HASHED % "'Introduction' || chr(10) || chr(10) || said"} AS text_hash, length('Introduction' || chr(10) || chr(10) || said) AS text_length
FROM (SELECT *, regexp_replace(replace(text, '#', ''), '^{WS}+|{WS}+$', '', 'g') AS said FROM documents) WHERE said <> ''""")
def payload_projection(spark, d):
    docs = table(spark, d, "documents")
    chunks = chunking.chunk_documents(docs.select("doc_id", F.replace("text", F.lit("#"), F.lit("")).alias("text"), F.lit("t").alias("title"))).where("is_parent")
    kinds = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("work_visa")))
    sources = docs.select("doc_id", F.col("source").alias("source_url"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("source_title"), level().alias("authority_level"), kinds.alias("visa_types"), F.lit(None).cast("timestamp").alias("published_at"), fetched_at().alias("fetched_at"), F.col("lang").alias("language"))
    found = chunking.payload(chunks, sources)
    return found.withColumn("visa_types", F.array_join("visa_types", ",")).withColumn("text_length", F.length("text").cast("long")).drop("text", "referenced_urls")


@_("SELECT round(avg(quality), 6) AS quality, round(avg(CASE WHEN doc_id % 10 <> 0 THEN toxic END), 6) AS toxic, count(*) AS n FROM labels")
def eval_means(spark, d):
    rows = table(spark, d, "labels").select(F.col("quality").cast("double").alias("quality"), F.when(F.col("doc_id") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("toxic").cast("double")).alias("toxic"))
    return metric_means(rows, ["quality", "toxic"])


@_("SELECT item_id, text AS question, length(text) AS ground_truth, CASE WHEN item_id % 3 = 0 THEN '' ELSE 'answer ' || item_id END AS answer, CASE WHEN item_id % 3 = 0 THEN 0 ELSE item_id % 4 END AS sources_count FROM benchmark")
def eval_cases(spark, d):
    """A case is a row; only read_eval_set(), whose files hold parallel arrays, goes through arrays."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), "item_id", F.col("text").alias("question"), F.length("text").cast("long").alias("ground_truth"))
    sources = F.slice(F.array(*[F.lit(f"s{i}") for i in range(4)]), 1, (F.col("pos") % 4).cast("int"))
    answers = rows.where("pos % 3 > 0").select("pos", F.concat(F.lit("answer "), F.col("pos").cast("string")).alias("answer"), sources.alias("sources"))
    return answered_cases(rows, answers).drop("pos").withColumn("sources_count", F.col("sources_count").cast("long"))


@_("SELECT item_id, text FROM benchmark ORDER BY item_id LIMIT 5")
def report_sample(spark, d):
    return first_rows(table(spark, d, "benchmark").select("item_id", "text"), "item_id")


@_("SELECT event_type AS service, bool_and(value > 1) AS healthy FROM events GROUP BY event_type")
def service_health(spark, d):
    return health(table(spark, d, "events").select(F.col("event_type").alias("service"), F.col("user_id").alias("dependency"), (F.col("value") > 1).alias("ok")))


@_("WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE value > 90 GROUP BY user_id) SELECT user_id, count(*) AS n, count(*) FILTER (event_id > first) AS skipped FROM events LEFT JOIN f USING (user_id) GROUP BY user_id")
def quota_skips(spark, d):
    rows = after_quota(table(spark, d, "events").withColumn("full", F.col("value") > 90), "user_id", "event_id", "full")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("skipped").alias("skipped"))


@_("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 50")
def sample_points(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").orderBy("doc_id").limit(50)


def _ingested(spark, d, texts, folded: bool = False) -> str:
    """Runs of documents, a column of texts each (null: not in the run), into new tables; folded: compacted after each run but the last."""
    out = scratch(spark, "ingested")
    for run, text in enumerate(texts):
        ingest_batch(table(spark, d, "documents").select("doc_id", text.alias("text")).where("text is not null"), out, run)
        if folded and run + 1 < len(texts):
            compact(spark, out)
    return out


_MARKED = "'## Part' || chr(10) || coalesce(text, '')"


_REPLACED = f"""SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 AND doc_id % 6 > 0 THEN '## New' || chr(10) || coalesce(text, '') ELSE {_MARKED} END) AS content_hash,
  CASE WHEN doc_id % 6 = 0 THEN 2 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS run_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[^[:space:]]')"""


def _replacing():
    """The texts of three runs: every third document changes in the second; every sixth returns to its first text in the third, in which the others are as they were."""
    own = F.coalesce("text", F.lit(""))
    first, changed = F.concat(F.lit("## Part\n"), own), F.concat(F.lit("## New\n"), own)
    return [first, F.when(F.col("doc_id") % 3 == 0, changed).otherwise(first), F.when(F.col("doc_id") % 6 == 0, first)]


@_(_REPLACED)
def ingest_replace(spark, d):
    out = _ingested(spark, d, _replacing())
    return document_state(spark, out).where("status = 'ingested'").select("doc_id", "content_hash", "run_id")


@_(f"SELECT *, true AS held FROM ({_REPLACED})")
def ingest_compacted(spark, d):
    """ingest_replace over a store that is folded into a new base after each run but the last, and whether all chunks that a document holds are there."""
    out = _ingested(spark, d, _replacing(), folded=True)
    there = present_chunks(spark, out, said=(F.col("text").isNotNull().alias("held"),)).select("text_hash", "held")
    chunks = present_holders(spark, out).join(there, "text_hash", "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("held", F.lit(False))).alias("held"))
    return document_state(spark, out).where("status = 'ingested'").select("doc_id", "content_hash", "run_id").join(chunks, "doc_id", "left")


@_(f"""WITH {_SECTIONS}, {_CHILDREN}, h AS (SELECT {_HASHED % 'text'} AS text_hash FROM all_chunks)
SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sections)) AS documents_processed, (SELECT count(DISTINCT text_hash) FROM h) AS chunks_ingested,
  (SELECT count(*) - count(DISTINCT text_hash) FROM h) AS chunks_skipped, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sections)) AS error_count, 0::BIGINT AS run_id
UNION ALL SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sections)), 0, 0, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM sections)), 1""")
def ingest_run_log(spark, d):
    """The same documents twice: the second run passes over all but those that failed."""
    out = scratch(spark, "ingested")
    for run in (0, 1):
        ingest_batch(_headed(spark, d).select("doc_id", "text"), out, run)
    return read_table(spark, f"{out}/runs", RUNS).select("documents_processed", "chunks_ingested", "chunks_skipped", "error_count", "run_id")


@_(f"""WITH {_SECTIONS}, {_CHILDREN}, h AS (SELECT {_HASHED % 'text'} AS text_hash FROM all_chunks)
SELECT DISTINCT text_hash, ('0x' || substr(text_hash, 1, 15))::BIGINT AS point_id, 64 AS dimension, 1.0::DOUBLE AS norm FROM h""")
def chunk_vectors(spark, d):
    """Chunk and vector are columns of one row, so that they cannot be paired wrongly."""
    out = scratch(spark, "ingested")
    ingest_batch(_headed(spark, d).select("doc_id", "text"), out, 0)
    norm = F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 3)
    return present_chunks(spark, out).select("text_hash", "point_id", F.size("vector").alias("dimension"), F.when(norm == 0, 1.0).otherwise(norm).alias("norm"))


@_(f"""WITH {_SECTIONS}, {_CHILDREN}, h AS (SELECT doc_id, {_HASHED % 'text'} AS text_hash FROM all_chunks WHERE doc_id % 4 <> 0)
SELECT text_hash, count(DISTINCT doc_id) AS n_holders, count(*) AS n_places, true AS stored FROM h GROUP BY text_hash""")
def shared_chunks(spark, d):
    """After every fourth document is deleted: who holds each chunk that is left, and that its text is still there, whoever brought it."""
    out, docs = scratch(spark, "ingested"), _headed(spark, d).select("doc_id", "text")
    ingest_batch(docs, out, 0)
    delete_documents(docs.where("doc_id % 4 = 0"), out, 1)
    there = present_chunks(spark, out).select("text_hash", F.col("text").isNotNull().alias("stored"))
    return chunk_holders(spark, out).join(there, "text_hash", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
