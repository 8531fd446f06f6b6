"""Dense, sparse and hybrid retrieval, context and prompt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.text import canonical_hash, terms
from ..operators import chunking
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import blocks, search_index, segments, vector_index
from ..operators.dedup import first_wins
from ..session import checkpoint, scratch
from ..sources.models import ANSWERS, generate_rows, rerank_scores
from ..sources.tables import answer_key, cached_answers
from ._registry import AS_OF, FETCHED_SQL, LEVEL_SQL, WS, as_of, fetched_at, level, register, table
from .text_queries import _CHILDREN, _SECTIONS, _headed

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ = lambda sql=None: register(QUERIES, ORACLE_SQL, sql)

_DOT = "round(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)), 6)"


#: The queries of a search: the rows whose id is divisible by this.
EVERY = 20


def _dense_sql(k: int) -> str:
    return f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {_DOT} AS score,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, v.vec_id)::INT AS rank FROM embeddings v, embeddings q WHERE q.vec_id % {EVERY} = 0) WHERE rank <= {k})"""


def _dense(spark, d, k: int = R.TOP_K):
    """The best k of all vectors for every vector whose id is divisible by EVERY."""
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.dense_top_k(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), queries, k)


@_(f"WITH {_dense_sql(20)} SELECT * FROM dense")
def dense_topk(spark, d):
    return _dense(spark, d)


@_(f"WITH {_dense_sql(10)} SELECT * FROM dense")
def dense_topk_multi(spark, d):
    return _dense(spark, d, 10)


def _ann(spark, d, k: int = R.TOP_K):
    e, path = table(spark, d, "embeddings"), scratch(spark, "vectors")
    vector_index.write_vector_index(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), path)
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search_vector_index(spark, path, queries, k)


@_()
def dense_ann(spark, d):
    """The hits of the inverted file; dense_ann_verified holds them against the exact search."""
    return _ann(spark, d)


@_(f"""WITH {_dense_sql(20)},
pairs AS (SELECT query_id, count(*) AS n FROM dense GROUP BY query_id)
SELECT query_id, n AS n_hits, 0::BIGINT AS n_false_scores, id AS best_id, score AS best_score, true AS recall_reached FROM dense JOIN pairs USING (query_id) WHERE rank = 1""")
def dense_ann_verified(spark, d):
    """For each query of dense_ann: hits, hits whose score is not that of their vectors, the best hit, and whether the recall of all queries is 0.9 or more."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = checkpoint(_ann(spark, d))
    own = found.join(e, "id").join(e.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    false = F.abs(R.dot(F.col("vector"), F.col("query")) - F.col("score")) > 1e-6
    best = F.min_by(F.struct("id", "score"), "rank")
    by_query = own.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.count_if(false).alias("n_false_scores"), best.alias("b"))
    reached = vector_index.recall(found, _dense(spark, d)).select((F.col("recall") >= 0.9).alias("recall_reached"))
    return by_query.crossJoin(F.broadcast(reached)).select("query_id", "n_hits", "n_false_scores", F.col("b.id").alias("best_id"), F.col("b.score").alias("best_score"), "recall_reached")  # one row


#: BM25 of every text of {docs} whose id is divisible by EVERY, as a query, against all of {docs}.
_BM25 = rf"""
words AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS term FROM {{docs}}),
tf AS (SELECT id, term, count(*) AS tf FROM words GROUP BY ALL), dl AS (SELECT id, sum(tf) AS dl FROM tf GROUP BY id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT (SELECT count(*) FROM {{docs}}) AS n_docs, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM {{docs}}) AS avgdl),
wanted AS (SELECT DISTINCT id AS query_id, term FROM tf WHERE id % {EVERY} = 0),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM tf JOIN dl USING (id) JOIN df USING (term) JOIN wanted USING (term), n GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= 20)"""
_BM25_DOCS = _BM25.replace("{docs}", "documents")


def _bm25(docs, k: int = R.TOP_K):
    return R.bm25(docs, docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), k)


@_(f"WITH {_BM25_DOCS} SELECT * FROM bm")
def bm25_topk(spark, d):
    return _bm25(table(spark, d, "documents"))


@_(f"WITH {_BM25_DOCS} SELECT * FROM bm")
def bm25_stored(spark, d):
    """bm25_topk by a stored index, which is written first."""
    docs, path = table(spark, d, "documents"), scratch(spark, "search-index")
    search_index.write_index(docs, path)
    return search_index.search_index(spark, path, docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))


@_(f"WITH {_BM25_DOCS} SELECT * FROM bm")
def bm25_block_max(spark, d):
    """bm25_topk by index segments, written first: ranges of documents that cannot enter a query's best are not visited."""
    docs, path = table(spark, d, "documents"), scratch(spark, "segments")
    segments.update_index(spark, path, docs)
    return segments.search_segments(spark, path, docs.where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))


_NOW = "(SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN reverse(text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"


@_(f"WITH {_BM25.replace('{docs}', _NOW)} SELECT * FROM bm")
def index_update(spark, d):
    """An index after four updates: all documents, odd ones reversed, half of these as they were, and some deleted. It answers as one built afresh of what is left."""
    docs, path = table(spark, d, "documents").select("doc_id", "text"), scratch(spark, "segments")
    odd = docs.where(F.col("doc_id") % 2 == 1)
    segments.update_index(spark, path, docs)
    segments.update_index(spark, path, odd.withColumn("text", F.reverse("text")))
    segments.update_index(spark, path, odd.where(F.col("doc_id") % 4 == 3))
    segments.update_index(spark, path, docs.limit(0), delete=docs.where(F.col("doc_id") % 10 == 7))
    now = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.reverse("text")).otherwise(F.col("text"))).where((F.col("doc_id") % 10 != 7) & (F.col("doc_id") % EVERY == 0))
    return segments.search_segments(spark, path, now.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))


@_(r"SELECT (SELECT count(*) FROM documents) AS n_docs, sum(tf)::BIGINT AS n_terms, count(DISTINCT term) AS n_distinct, round(sum(tf) / (SELECT count(*) FROM documents), 6) AS avgdl FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents) GROUP BY ALL)")
def corpus_statistics(spark, d):
    docs = table(spark, d, "documents")
    _lengths, df, totals = R.corpus_stats(R.postings(docs), docs)
    return totals.crossJoin(df.agg(F.count("*").alias("n_distinct"))).select("n_docs", "n_terms", "n_distinct", F.round("avgdl", 6).alias("avgdl"))


_FUSED = """
dn AS (SELECT query_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM dense)),
sn AS (SELECT query_id, id, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS s FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM bm)),
fused AS (SELECT query_id, id, round(0.7 * coalesce(dn.s, 0.0) + 0.3 * coalesce(sn.s, 0.0), 6) AS score FROM dn FULL JOIN sn USING (query_id, id)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM fused) WHERE rank <= 20)"""


@_(f"WITH {_dense_sql(20)}, {_BM25_DOCS}, {_FUSED} SELECT * FROM top")
def hybrid_fusion(spark, d):
    return R.fuse(_dense(spark, d), _bm25(table(spark, d, "documents")))


@_(f"WITH {_dense_sql(20)}, {_BM25_DOCS}, r AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, id, rank FROM dense UNION ALL SELECT query_id, id, rank FROM bm) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM r) WHERE rank <= 20")
def rank_fusion(spark, d):
    return R.reciprocal_rank_fusion([_dense(spark, d), _bm25(table(spark, d, "documents"))])


_FACTOR = f"(1 - least(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us({FETCHED_SQL})) / 86400000000), 365) / 365.0 * 0.1)"
_BOOST = f"(CASE {LEVEL_SQL} WHEN 'official' THEN 1.2 WHEN 'semi_official' THEN 1.0 ELSE 0.8 END)"


@_(f"SELECT doc_id, {LEVEL_SQL} AS authority_level, round({_FACTOR}::DOUBLE, 6) AS recency, round((0.8::DOUBLE * {_FACTOR} * {_BOOST})::DOUBLE, 6) AS adjusted_score FROM documents")
def recency_authority(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", level().alias("authority_level"), F.round(S.recency_factor(fetched_at(), as_of()), 6).alias("recency"),
        F.round(S.adjusted_score(F.lit(0.8), fetched_at(), level(), as_of()), 6).alias("adjusted_score"),
    )


@_(f"SELECT doc_id FROM documents WHERE {LEVEL_SQL} IN ('official', 'semi_official') AND lang IN ('de', 'en') AND (doc_id % 5 IN (1, 3))")
def authority_filter(spark, d):
    topics = F.array(F.when(F.col("doc_id") % 5 == 1, "work_visa").when(F.col("doc_id") % 5 == 3, "student_visa").otherwise("general"))
    wanted = F.arrays_overlap(topics, F.array(F.lit("work_visa"), F.lit("student_visa")))
    return table(spark, d, "documents").where(S.authority_at_least(level(), "semi_official") & F.col("lang").isin("de", "en") & wanted).select("doc_id")


@_(f"""WITH {_dense_sql(20)}, first AS (SELECT query_id // 80 AS group_id, id, arg_min(score, query_id * 1000 + rank) AS score FROM dense GROUP BY ALL)
SELECT group_id, id, score, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, id)::INT AS rank FROM first""")
def multi_query_merge(spark, d):
    hits = _dense(spark, d).withColumn("group_id", F.floor(F.col("query_id") / 80).cast("long"))
    return R.merge_queries(hits.withColumnRenamed("query_id", "query_pos"))


@_(f"WITH {_dense_sql(10)} SELECT query_id, id, round(1.0 / rank, 6)::DOUBLE AS score, rank FROM dense")
def rerank_mock(spark, d):
    """Without a scorer the order stays, and the best RERANKED are left."""
    hits = _dense(spark, d)
    return R.rerank(hits, rerank_scores(hits)).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_(f"WITH {_dense_sql(20)}, s AS (SELECT query_id, id, (((rank - 1) * 7) % 20)::DOUBLE / 20 AS score FROM dense) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 10")
def rerank_map(spark, d):
    hits = _dense(spark, d)
    answers = hits.select("query_id", (F.col("rank") - 1).alias("idx"), (((F.col("rank") - 1) * 7) % 20 / 20).alias("rerank_score"))
    return R.rerank(hits, answers).select("query_id", "id", "score", "rank")


_CHUNKED = f"WITH {_SECTIONS}, {_CHILDREN}"
_LONG = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 5))"


@_(f"""{_CHUNKED},
asked AS (SELECT item_id AS query_id, unnest({_LONG.format('text')}) AS term FROM benchmark),
said AS (SELECT chunk_id AS id, unnest({_LONG.format('text')}) AS term FROM all_chunks WHERE NOT is_parent),
found AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM asked JOIN said USING (term) GROUP BY ALL HAVING count(*) >= 3),
tree AS (
  SELECT chunk_id AS id, CASE WHEN is_parent THEN 'doc_' || doc_id ELSE doc_id || '_section_' || section_index || '_parent' END AS parent, length(text) AS size FROM all_chunks
  UNION ALL SELECT 'doc_' || doc_id, NULL, sum(length(text)) FROM all_chunks WHERE is_parent GROUP BY doc_id),
kids AS (SELECT parent, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent),
full1 AS (SELECT query_id, parent, max(score) AS score FROM found JOIN tree USING (id) JOIN kids USING (parent) GROUP BY query_id, parent, n HAVING count(*) >= 0.5 * n),
one AS (
  SELECT query_id, id, max(score) AS score FROM (
    SELECT query_id, id, score FROM found JOIN tree USING (id) WHERE NOT EXISTS (SELECT 1 FROM full1 f WHERE f.query_id = found.query_id AND f.parent = tree.parent)
    UNION ALL SELECT query_id, parent, score FROM full1) GROUP BY ALL),
full2 AS (SELECT query_id, parent, max(score) AS score FROM one JOIN tree USING (id) JOIN kids USING (parent) GROUP BY query_id, parent, n HAVING count(*) >= 0.5 * n),
two AS (
  SELECT query_id, id, max(score) AS score FROM (
    SELECT query_id, id, score FROM one JOIN tree USING (id) WHERE NOT EXISTS (SELECT 1 FROM full2 f WHERE f.query_id = one.query_id AND f.parent = tree.parent)
    UNION ALL SELECT query_id, parent, score FROM full2) GROUP BY ALL),
placed AS (SELECT query_id, id, score, row_number() OVER w AS rank, sum(size) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM two JOIN tree USING (id) WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id))
SELECT query_id, id, score, rank::INT AS rank, used::BIGINT AS used FROM placed WHERE used <= 20000""")
def retrieve_parents(spark, d):
    """Children that share three longer words with a benchmark item; sections, then documents, stand for them where half of the children are hits."""
    longer = lambda c: F.array_distinct(F.filter(terms(F.col(c)), lambda w: F.length(w) >= 5))
    chunks = checkpoint(chunking.chunk_documents(_headed(spark, d)).select("doc_id", "section_index", "chunk_id", "is_parent", "text"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(longer("text")).alias("term"))
    said = chunks.where("not is_parent").select(F.col("chunk_id").alias("id"), F.explode(longer("text")).alias("term"))
    hits = asked.join(said, "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score")).where("score >= 3")
    parent = F.when(F.col("is_parent"), F.concat(F.lit("doc_"), "doc_id")).otherwise(F.concat("doc_id", F.lit("_section_"), "section_index", F.lit("_parent")))
    tree = chunks.select(F.col("chunk_id").alias("id"), parent.alias("parent"), F.length("text").cast("long").alias("size"))
    top = chunks.where("is_parent").groupBy(F.concat(F.lit("doc_"), "doc_id").alias("id")).agg(F.sum(F.length("text")).alias("size")).select("id", F.lit(None).cast("string").alias("parent"), "size")
    return R.fold_into_parents(hits, tree.unionByName(top), budget=20_000)


@_(f"""WITH {_dense_sql(20)}, rel AS (SELECT q.vec_id AS query_id, v.vec_id AS id FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
ideal AS (SELECT query_id, n, list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM n),
hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM dense JOIN rel USING (query_id, id) WHERE rank <= 10),
found AS (SELECT query_id, sum(1 / log2(rank + 1)) AS gain, min(rank) AS first, sum(upto / rank) AS precision, count(*) AS hits FROM hits GROUP BY query_id)
SELECT query_id, round(coalesce(gain / ideal, 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS reciprocal_rank, round(coalesce(precision / n, 0), 6) AS average_precision, round(coalesce(hits / n, 0), 6) AS recall
FROM ideal LEFT JOIN found USING (query_id)""")
def eval_ranking(spark, d):
    """Ranked measures of the dense search; vectors of a query's label are relevant, itself aside."""
    e = table(spark, d, "embeddings")
    queries = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    found = E.class_measures(_dense(spark, d), e.select(F.col("vec_id").alias("id"), "label"), queries)
    return found.select("query_id", *(F.round(c, 6).alias(c) for c in ("ndcg", "reciprocal_rank", "average_precision", "recall")))


@_()
def eval_overlap(spark, d):
    """Words that each assistant turn has in common, in order, with the turn before it."""
    c = table(spark, d, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("truth"))
    pairs = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer")).join(before, ["conv_id", "turn"])
    return E.answer_overlap(pairs.withColumn("key", F.concat_ws("_", "conv_id", "turn")), "key")


_BADGE = "CASE authority_level WHEN 'official' THEN '🔴 [OFFICIAL]' WHEN 'semi_official' THEN '🟡 [SEMI-OFFICIAL]' WHEN 'third_party' THEN '⚪ [THIRD-PARTY]' ELSE '' END"


@_(f"""WITH r AS (SELECT doc_id // 8 AS query_id, (doc_id % 8 + 1)::INT AS rank, {LEVEL_SQL} AS authority_level, text, source FROM documents)
SELECT query_id, string_agg(chr(10) || '[Passage ' || rank || '] ' || {_BADGE} || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || chr(10) || 'Section: General' || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10), chr(10) ORDER BY rank) AS context
FROM r WHERE rank <= 5 GROUP BY query_id""")
def context_build(spark, d):
    rows = table(spark, d, "documents").select(
        F.floor(F.col("doc_id") / 8).cast("long").alias("query_id"), (F.col("doc_id") % 8 + 1).cast("int").alias("rank"), level().alias("authority_level"),
        F.col("source").alias("source_url"), F.lit(None).cast("string").alias("section_header"), "text",
    )
    return R.build_context(rows)


_VARIANTS = "SELECT item_id * 2 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, array_to_string(regexp_split_to_array(text, ' ')[1:6], ' ') FROM benchmark"


@_(rf"""WITH variants AS ({_VARIANTS}),
{_BM25_DOCS.replace(f"wanted AS (SELECT DISTINCT id AS query_id, term FROM tf WHERE id % {EVERY} = 0)", "wanted AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^" + chr(92) + "p{L}" + chr(92) + "p{N}]+'), lambda w: w <> '')) AS term FROM variants)")},
merged AS (SELECT query_id // 2 AS item_id, id, arg_min(score, query_id * 1000 + rank) AS score FROM bm GROUP BY ALL),
adjusted AS (SELECT item_id, id, source, text, {LEVEL_SQL} AS authority_level, round((score * {_FACTOR} * {_BOOST})::DOUBLE, 6) AS score FROM merged JOIN documents ON id = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id)::INT AS rank FROM adjusted),
said AS (
  SELECT item_id, count(*) AS n, string_agg(chr(10) || '[Passage ' || rank || '] ' || {_BADGE} || chr(10) || 'Source: ' || coalesce(source, 'Unknown') || chr(10) || 'Section: General' || chr(10) || '---' || chr(10) || coalesce(text, '') || chr(10) || '---' || chr(10), chr(10) ORDER BY rank) AS context
  FROM ranked WHERE rank <= 5 GROUP BY item_id)
SELECT benchmark.item_id, CASE WHEN benchmark.item_id % 3 = 0 THEN 'kept' WHEN n IS NULL THEN 'No passages' ELSE 'Passages: ' || n END AS answer, benchmark.item_id % 3 = 0 AS from_cache,
  CASE WHEN benchmark.item_id % 3 <> 0 THEN sha256(coalesce(context, '')) END AS context_hash
FROM benchmark LEFT JOIN said USING (item_id)""")
def answer_chain(spark, d):
    """Benchmark items as questions, from the cache or by the whole chain: variants, search, merging, rescoring, reranking, context, and a generator that answers with the prompt's first line."""
    docs = table(spark, d, "documents")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("query"))
    kept = items.where("item_id % 3 = 0").select(answer_key(F.col("query")).alias("cache_key"), F.lit("kept").alias("answer"), as_of().alias("at")).distinct()
    looked_up = cached_answers(items, kept, as_of(), 24)
    open_ = checkpoint(looked_up.where("answer is null").select("item_id", "query"))
    short = F.array_join(F.slice(F.split("query", " "), 1, 6), " ")
    variants = open_.select((F.col("item_id") * 2).alias("query_id"), "query").unionByName(open_.select((F.col("item_id") * 2 + 1).alias("query_id"), short.alias("query")))
    found = R.bm25(docs, variants).withColumn("group_id", F.expr("query_id div 2")).withColumnRenamed("query_id", "query_pos")
    meta = docs.select(F.col("doc_id").alias("id"), fetched_at().alias("fetched_at"), level().alias("authority_level"))
    scored = R.rescore(R.merge_queries(found), meta, as_of()).select(F.col("group_id").alias("query_id"), "id", F.col("adjusted_score").alias("score"))
    # Hits and passages are few beside the documents and are used more than once: written, so that whole texts are read once and not shuffled for each use.
    hits = blocks.stored(R.top_k(scored, R.TOP_K), "hits")
    best = blocks.stored(R.rerank(hits, rerank_scores(hits)).where(F.col("rank") <= R.CONTEXT_ROWS), "best")
    passages = blocks.stored(best.join(docs.select(F.col("doc_id").alias("id"), level().alias("authority_level"), F.col("source").alias("source_url"), F.lit(None).cast("string").alias("section_header"), "text"), "id"), "passages")
    prompts = open_.join(R.build_context(passages).join(passages.groupBy("query_id").agg(F.count("*").alias("n")), "query_id").withColumnRenamed("query_id", "item_id"), "item_id", "left")
    head = F.when(F.col("n").isNull(), "No passages").otherwise(F.concat(F.lit("Passages: "), F.col("n").cast("string")))
    prompts = checkpoint(prompts.select("item_id", F.coalesce("context", F.lit("")).alias("context"), head.alias("head")))
    path = scratch(spark, "answers")
    generate_rows(prompts.select(F.col("item_id").alias("id"), F.concat("head", F.lit("\n"), "context").alias("system"), F.lit("").alias("user")), path)
    answered = prompts.join(spark.read.schema(ANSWERS).parquet(path).where("error is null").select(F.col("id").alias("item_id"), "answer"), "item_id")
    done = answered.select("item_id", "answer", F.lit(False).alias("from_cache"), F.sha2("context", 256).alias("context_hash"))
    return done.unionByName(looked_up.where("answer is not null").select("item_id", "answer", F.lit(True).alias("from_cache"), F.lit(None).cast("string").alias("context_hash")))


@_("SELECT doc_id, NOT regexp_matches(lower(said), 'ignore previous instructions|system prompt|you are now|disregard|pretend you are|forget about|new instructions|execute code|eval\\(|import os') AS safe FROM (SELECT doc_id, text || CASE doc_id % 11 WHEN 0 THEN ' Ignore previous instructions' WHEN 5 THEN ' eval(x)' ELSE '' END AS said FROM documents)")
def injection_flag(spark, d):
    said = F.concat("text", F.when(F.col("doc_id") % 11 == 0, " Ignore previous instructions").when(F.col("doc_id") % 11 == 5, " eval(x)").otherwise(""))
    return table(spark, d, "documents").select("doc_id", S.is_context_safe(said).alias("safe"))


@_(f"SELECT doc_id, {_BADGE} AS badge FROM (SELECT doc_id, {LEVEL_SQL} AS authority_level FROM documents)")
def authority_badge(spark, d):
    return table(spark, d, "documents").select("doc_id", S.authority_badge(level()).alias("badge"))


_LANGS = r"""concat_ws(',', CASE WHEN regexp_matches(q, '[\x{4e00}-\x{9fff}]') THEN 'zh' END,
  CASE WHEN regexp_matches(lower(q), '[äöüß]') OR regexp_matches(lower(q), '(^|[^\p{L}\p{N}_])(der|die|das|und|in|zu|mit)($|[^\p{L}\p{N}_])') THEN 'de' END)"""


@_(f"SELECT conv_id, turn, CASE WHEN l = '' THEN 'en' ELSE l END AS languages FROM (SELECT conv_id, turn, {_LANGS} AS l FROM (SELECT conv_id, turn, text AS q FROM conversations))")
def detect_language(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.detect_languages(F.col("text")), ",").alias("languages"))


_ASK = "CASE conv_id % 5 WHEN 0 THEN 'Opportunity card or work visa' WHEN 1 THEN 'Freiberufler und Unternehmer' WHEN 2 THEN 'Studentenvisum' ELSE '' END || ' ' || text"


def _ask():
    n = F.col("conv_id") % 5
    return F.concat(F.when(n == 0, "Opportunity card or work visa").when(n == 1, "Freiberufler und Unternehmer").when(n == 2, "Studentenvisum").otherwise(""), F.lit(" "), F.col("text"))


@_("SELECT conv_id, turn, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(q), '{p}') THEN '{n}' END" for n, p in S.TOPIC_PATTERNS.items()) + f") AS topics FROM (SELECT conv_id, turn, {_ASK} AS q FROM conversations)")
def detect_topics(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(S.detect_topics(_ask()), ",").alias("topics"))


@_(f"SELECT conv_id, turn, CASE WHEN length(trim(q)) > 50 THEN q ELSE array_to_string(list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda x: x <> ''), '|') END AS queries, len(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> '')) < 3 AS expand FROM (SELECT conv_id, turn, q, trim(q) AS a, lower(trim(q)) AS b FROM (SELECT conv_id, turn, {_ASK} AS q FROM conversations))")
def search_query_gate(spark, d):
    found = S.search_queries(_ask(), F.btrim(_ask()), F.lower(F.btrim(_ask())), F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, "|").alias("queries"), S.needs_expansion(_ask()).alias("expand"))


@_("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


_MODEL = "CASE conv_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4' WHEN 2 THEN 'gpt-4o-mini' ELSE 'other' END"
_IN = "CASE conv_id % 4 WHEN 0 THEN 0.005 WHEN 1 THEN 0.03 WHEN 2 THEN 0.00015 ELSE 0 END"
_OUT = "CASE conv_id % 4 WHEN 0 THEN 0.015 WHEN 1 THEN 0.06 WHEN 2 THEN 0.0006 ELSE 0 END"


def _model():
    n = F.col("conv_id") % 4
    return F.when(n == 0, "gpt-4o").when(n == 1, "gpt-4").when(n == 2, "gpt-4o-mini").otherwise("other")


@_(f"SELECT conv_id, turn, length(text) // 4 AS tokens, round((length(text) // 4 / 1000 * ({_IN})::DOUBLE + (length(text) // 8) / 1000 * ({_OUT})::DOUBLE)::DOUBLE, 6) AS cost FROM conversations")
def cost_estimate(spark, d):
    t, out = S.token_estimate(F.col("text")), F.floor(F.length("text") / 8)
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("tokens"), S.cost_estimate(t, out, _model()).alias("cost"))


@_(f"SELECT conv_id, turn, round((length(text) // 4 / 1000 * (CASE WHEN conv_id % 4 = 0 THEN 0 ELSE {_IN} END)::DOUBLE + (length(text) // 8) / 1000 * (CASE WHEN conv_id % 4 = 0 THEN 0 ELSE {_OUT} END)::DOUBLE)::DOUBLE, 9) AS cost FROM conversations")
def client_cost(spark, d):
    t, out = S.token_estimate(F.col("text")), F.floor(F.length("text") / 8)
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(S.client_cost(t, out, _model()), 9).alias("cost"))


_TOPICS = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(lower(q), '{p}') THEN '{n}' END" for n, p in S.TOPIC_PATTERNS.items()) + ")"


@_(f"""SELECT conv_id, turn, CASE WHEN short AND conv_id % 2 = 0 THEN 'fixed' ELSE q END AS corrected, CASE WHEN short THEN '' ELSE {_TOPICS} END AS topics,
  CASE WHEN short AND conv_id % 2 = 0 THEN 'en' WHEN short THEN 'de' WHEN {_LANGS} = '' THEN 'en' ELSE {_LANGS} END AS languages, CASE WHEN short AND conv_id % 2 = 0 THEN 0.7::DOUBLE WHEN short THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM (SELECT conv_id, turn, text AS q, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) < 3 AS short FROM conversations)""")
def query_transform(spark, d):
    """Every turn as a query; a model answers for even conversations, and what it says for the others is no JSON."""
    said = F.when(F.col("conv_id") % 2 == 0, F.lit('{"corrected_query": "fixed", "query_variants": ["a"], "detected_visa_types": [], "languages_detected": ["en"], "confidence": 0.7}')).otherwise("no object")
    t = table(spark, d, "conversations").select("conv_id", "turn", S.transformed_query(F.col("text"), said).alias("t"))
    return t.select("conv_id", "turn", F.col("t.corrected_query").alias("corrected"), F.array_join("t.detected_visa_types", ",").alias("topics"), F.array_join("t.languages_detected", ",").alias("languages"), F.col("t.confidence").alias("confidence"))


@_("SELECT conv_id, sum(4 + length(role) // 4 + length(text) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def message_tokens(spark, d):
    each = 4 + S.token_estimate(F.col("role")) + S.token_estimate(F.col("text"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(each).alias("tokens"))


@_("""SELECT conv_id, turn, i::INT AS pos, 'data: {"choices":[{"delta":{"content":' || to_json(substr(text, i * 20 + 1, 20)) || '},"finish_reason":null}]}' || chr(10) || chr(10) AS event
FROM (SELECT *, unnest(range((length(text) + 19) // 20)) AS i FROM conversations)""")
def sse_chunks(spark, d):
    rows = table(spark, d, "conversations").where("text <> ''")  # an empty text has no piece
    pieces = rows.select("conv_id", "turn", "text", F.explode(F.expr("sequence(0, cast((length(text) + 19) div 20 as int) - 1)")).alias("pos"))
    return pieces.select("conv_id", "turn", "pos", S.sse_event(F.substr("text", F.col("pos") * 20 + 1, F.lit(20))).alias("event"))


_UNIQUE = f"(SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(trim(regexp_replace(lower(text), '{WS}+', ' ', 'g'))) ORDER BY doc_id) = 1)"


@_(f"""WITH {_BM25.replace('{docs}', _UNIQUE)}
SELECT query_id, id, score, authority_level, adjusted_score, rank FROM (
  SELECT query_id, id, score, {LEVEL_SQL.replace('doc_id', 'id')} AS authority_level, round((score * {_FACTOR.replace('doc_id', 'id')} * {_BOOST.replace('doc_id', 'id')})::DOUBLE, 6) AS adjusted_score,
    row_number() OVER (PARTITION BY query_id ORDER BY round((score * {_FACTOR.replace('doc_id', 'id')} * {_BOOST.replace('doc_id', 'id')})::DOUBLE, 6) DESC, id)::INT AS rank FROM bm) WHERE rank <= 10""")
def retrieve_rescored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", canonical_hash(F.col("text")).alias("text_hash"))
    unique = first_wins(docs.withColumn("at", F.col("doc_id")), ["text_hash"], ["at"]).select("doc_id", "text")
    hits = _bm25(unique).drop("rank")
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("id"), level().alias("authority_level"), fetched_at().alias("fetched_at"))
    scored = R.rescore(hits, meta, as_of()).drop("fetched_at")
    return R.top_k(scored, R.RERANKED, score="adjusted_score")
