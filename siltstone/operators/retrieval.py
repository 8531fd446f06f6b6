"""Dense, sparse and hybrid retrieval for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import adjusted_score, authority_badge
from ..functions.text import terms
from . import blocks

TOP_K, RERANKED, CONTEXT_ROWS = 20, 10, 5
DENSE_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3
K1, B = 1.2, 0.75
#: Query batches up to this many rows are sent to every task; larger ones are cut into blocks of about half as many.
MOST_BROADCAST_QUERIES = 16384
#: Scores that a task of the exact search works out for one block of queries, at most about.
TASK_SCORES = 1 << 32


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(scored: DataFrame, k: int, query: str = "query_id", score: str = "score", tie: str = "id") -> DataFrame:
    order = W.partitionBy(query).orderBy(F.col(score).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_tasks(n_queries: int, n_vectors: int, sends: int, cores: int) -> int:
    """Tasks for each block of queries: as many as there are cores, fewer where one would have less than 2^24 scores, more where one would have over TASK_SCORES."""
    scores = -(-n_queries // sends) * n_vectors
    return max(min(cores, -(-scores // (1 << 24))), -(-scores // TASK_SCORES), 1)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, digits: int = 6) -> DataFrame:
    """Exact search: (query_id, id, score, rank), stored. vectors(id, vector) are read once for each block of queries(query_id, query).

    Tasks multiply matrices and keep their own best k a query (blocks.py): no row is made for a pair.
    A block of queries has its own tasks, so their number goes by its scores, not by all.
    """
    queries = blocks.stored(queries.select("query_id", "query"), "queries")
    n = queries.count()
    sends = 1 if n <= MOST_BROADCAST_QUERIES else -(-2 * n // MOST_BROADCAST_QUERIES)
    dealt = vectors.select("id", "vector").repartition(search_tasks(n, vectors.count(), sends, queries.sparkSession.sparkContext.defaultParallelism))
    found = None
    for i in range(sends):
        block = queries if sends == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(sends)) == i)
        part = blocks.nearest(dealt, block.select("query_id", "query").toArrow(), k)
        found = part if found is None else found.unionByName(part)
    return blocks.stored(top_k(found.withColumn("score", F.round("score", digits)), k), "nearest")


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.explode(terms(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def corpus_stats(index: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(document lengths, document frequency by term, one row of totals). Documents without terms count in the totals."""
    lengths = index.groupBy("id").agg(F.sum("tf").alias("dl"))
    df = index.groupBy("term").agg(F.count("*").alias("df"))
    totals = docs.agg(F.count("*").alias("n_docs")).crossJoin(lengths.agg(F.sum("dl").alias("n_terms"))).withColumn("avgdl", F.col("n_terms") / F.col("n_docs"))
    return lengths, df, totals


def bm25(docs: DataFrame, queries: DataFrame, k: int = TOP_K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score, rank) by Okapi BM25, stored. Null texts count as documents without terms; rows that share an id are one document of their terms together.

    Documents are packed in blocks where they are read, and blocks of queries
    multiplied with them (blocks.py): no row is made for a posting or a pair.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), blocks.term_hashes(F.col(text)).alias("words"))
    packed = blocks.pack(rows)
    ids = blocks.block_ids(packed).groupBy("id").count().agg(F.sum("count").alias("n_docs"), F.max("count").alias("most")).first()
    if not ids.n_docs:
        return docs.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
    if ids.most > 1:
        packed = blocks.pack(rows.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words")))
    mean = (packed.agg(F.sum("n_words")).first()[0] or 0) / ids.n_docs
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array_distinct(blocks.term_hashes(F.col("query")))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weight = F.col("times") * idf(F.lit(ids.n_docs), F.col("df"))
    weighted = blocks.stored(asked.join(blocks.block_frequencies(packed), "term").select("query_id", "term", weight.alias("weight")), "asked")
    return blocks.stored(top_k(blocks.search(packed, weighted, mean, k, K1, B), k), "found")


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = TOP_K, dense_weight: float = DENSE_WEIGHT, sparse_weight: float = SPARSE_WEIGHT) -> DataFrame:
    """Weighted sum of min-max scaled scores over each query's candidates; a missing side counts 0."""

    def scaled(df: DataFrame, name: str) -> DataFrame:
        ends = df.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
        share = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
        return df.join(ends, "query_id").select("query_id", "id", share.alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), ["query_id", "id"], "full_outer")
    score = F.round(dense_weight * F.coalesce("d", F.lit(0.0)) + sparse_weight * F.coalesce("s", F.lit(0.0)), 6)
    return top_k(both.select("query_id", "id", score.alias("score")), k)


def reciprocal_rank_fusion(runs: list[DataFrame], k: int = TOP_K, offset: int = 60) -> DataFrame:
    all_ = runs[0].select("query_id", "id", "rank")
    for run in runs[1:]:
        all_ = all_.unionByName(run.select("query_id", "id", "rank"))
    return top_k(all_.groupBy("query_id", "id").agg(F.round(F.sum(1 / (F.lit(offset) + F.col("rank"))), 6).alias("score")), k)


def rescore(hits: DataFrame, meta: DataFrame, as_of: Column) -> DataFrame:
    """hits with adjusted_score from meta(id, fetched_at, authority_level); missing authority counts as third party."""
    level = F.coalesce("authority_level", F.lit("third_party"))
    return hits.join(meta, "id").withColumn("adjusted_score", F.round(adjusted_score(F.col("score"), F.col("fetched_at"), level, as_of), 6))


def merge_queries(hits: DataFrame, group: str = "group_id", score: str = "score") -> DataFrame:
    """Results of several queries of a group: each id once, as its first query and rank found it, by score."""
    chosen = hits.groupBy(group, "id").agg(F.min_by(F.col(score), F.struct("query_pos", "rank")).alias(score))
    return chosen.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.col(score).desc(), "id")))


def fold_into_parents(hits: DataFrame, tree: DataFrame, share: float = 0.5, levels: int = 2, budget: int | None = None) -> DataFrame:
    """(query_id, id, score, rank, used): hits(query_id, id, score), in which parents stand for their children, level by level.

    tree holds (id, parent, size), a row a chunk; the top has a null parent. Where
    at least ``share`` of a parent's children are among a query's hits, the parent
    takes their place with the best of their scores (its own counts too, if it was
    a hit). ``budget``: only hits stay up to which the sizes, best first, do not
    exceed it; ``used`` is that sum. Equal scores go by id. Hits that the tree does
    not know are left out.
    """
    children = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    now = hits.groupBy("query_id", "id").agg(F.max("score").alias("score")).join(tree.select("id", "parent"), "id")
    for _ in range(levels):
        full = now.where("parent is not null").groupBy("query_id", "parent").agg(F.count("*").alias("n"), F.max("score").alias("best")).join(children, "parent").where(F.col("n") >= share * F.col("n_children")).select("query_id", "parent", "best")
        kept = now.join(full, ["query_id", "parent"], "left_anti").select("query_id", "id", "score")
        raised = full.select("query_id", F.col("parent").alias("id"), F.col("best").alias("score"))
        now = kept.unionByName(raised).groupBy("query_id", "id").agg(F.max("score").alias("score")).join(tree.select("id", "parent"), "id")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    sized = now.join(tree.select("id", "size"), "id").withColumn("rank", F.row_number().over(order)).withColumn("used", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return (sized if budget is None else sized.where(F.col("used") <= budget)).select("query_id", "id", "score", "rank", "used")


def rerank(hits: DataFrame, scores: DataFrame, k: int = RERANKED) -> DataFrame:
    """A reranker's answer (query_id, idx, rerank_score) joined back by 0-based place; its score replaces the adjusted one."""
    placed = hits.withColumn("idx", F.col("rank") - 1).drop("rank", "score")
    return top_k(placed.join(scores, ["query_id", "idx"]).withColumnRenamed("rerank_score", "score"), k)


def build_context(hits: DataFrame, k: int = CONTEXT_ROWS) -> DataFrame:
    """(query_id, context): the first k hits(rank, authority_level, source_url, section_header, text), numbered, in order."""
    part = F.concat(
        F.lit("\n[Passage "), F.col("rank").cast("string"), F.lit("] "), authority_badge(F.col("authority_level")), F.lit("\nSource: "), F.coalesce("source_url", F.lit("Unknown")),
        F.lit("\nSection: "), F.coalesce("section_header", F.lit("General")), F.lit("\n---\n"), F.coalesce("text", F.lit("")), F.lit("\n---\n"),
    )
    rows = hits.where(F.col("rank") <= k).select("query_id", F.struct("rank", part.alias("part")).alias("p"))
    return rows.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("p"))["part"], "\n").alias("context"))
