"""Scores by blocks: what is shuffled grows with the queries, and results are those of scoring each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import blocks, evaluation, retrieval, search_index


def side(rng, n, share):
    held = rng.random((200, n)) < share[:, None]
    term, place = np.nonzero(held)
    distinct, size = np.unique(term, return_counts=True)
    value = rng.random(len(term))
    full = np.zeros((200, n))
    full[term, place] = value
    return blocks.Side(n, distinct, size, place, value), full


@pytest.mark.parametrize("dense", [1, 50, 10**9])
def test_product_in_both_ways(monkeypatch, dense):
    monkeypatch.setattr(blocks, "DENSE_SHARE", dense)
    monkeypatch.setattr(blocks, "PAIRS", 64)
    rng = np.random.default_rng(1)
    share = rng.random(200) ** 4
    a, x = side(rng, 30, share)
    b, y = side(rng, 70, share)
    assert np.allclose(blocks.product(a, b), x.T @ y)


def test_best_keeps_the_least_ids_of_equal_scores():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 4, (5, 90)) / 4 + rng.random((5, 90)) * 1e-8, rng.permutation(90)
    best = blocks.Best(5, 7)
    for at in range(0, 90, 30):
        best.add(score[:3, at : at + 30], ids[at : at + 30], 0)
        best.add(score[3:, at : at + 30], ids[at : at + 30], 3)
        best.settle()
    for q in range(5):
        want = sorted((-round(s, 6), i) for s, i in zip(score[q].tolist(), ids.tolist(), strict=True))[:7]
        assert [(-s, i) for s, i in zip(best.held[1][best.held[0] == q].tolist(), best.held[2][best.held[0] == q].tolist(), strict=True)] == want


def test_no_row_is_made_for_a_pair(spark):
    """Before, a search made a row for each query and vector, or for each query and posting of a shared term."""
    vectors = spark.range(3000).select("id", F.array(*(F.sin(F.col("id") * j) for j in range(1, 5))).alias("vector"))
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query")).toArrow()
    found = blocks.nearest(vectors.coalesce(2), asked, 5)
    assert found.count() <= 2 * 150 * 5
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two "), F.col("id") % 7).alias("text"))
    packed = blocks.pack(docs.coalesce(2).select(F.col("doc_id").alias("id"), blocks.term_hashes(F.col("text")).alias("words")))
    weighted = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.explode(blocks.term_hashes(F.col("text"))).alias("term"), F.lit(1.0).alias("weight"))
    assert blocks.search(packed, weighted, 3.0, 5, 1.2, 0.75).count() <= 2 * 150 * 5
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_rows_that_share_an_id_are_one_document(spark):
    docs = spark.createDataFrame([(1, "ä b b"), (1, "b c"), (2, "b"), (3, None), (None, "b c")], "doc_id long, text string")
    whole = spark.createDataFrame([(1, "ä b b b c"), (2, "b"), (3, ""), (4, ""), (None, "b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "B"), (2, "c Ä")], "query_id long, query string")
    rows = lambda d: sorted(map(tuple, retrieval.bm25(d, asked).collect()))
    assert rows(docs) == rows(whole)
    assert [r[1] for r in rows(docs)] == [1, 2, 1]


def test_queries_in_several_sends(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(9))) for i in range(80)], "doc_id long, text string")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    rows = lambda: sorted(map(tuple, retrieval.bm25(docs, asked, 5).collect()))
    want = rows()
    monkeypatch.setattr(blocks, "SENT_PAIRS", 100)
    monkeypatch.setattr(blocks, "BLOCK_QUERIES", 3)
    assert rows() == want


def test_vectors_with_nulls_come_last(spark):
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [5.0]), (5, [0.0, 1.0])], "id long, vector array<double>")
    queries = spark.createDataFrame([(7, [0.5, 0.25])], "query_id long, query array<double>")
    assert [(r.id, r.score) for r in retrieval.dense_top_k(vectors, queries).orderBy("rank").collect()] == [(1, 1.0), (5, 0.25), (2, None), (3, None), (4, None)]


def test_measures_by_class_are_those_of_its_pairs(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else i % 3 if i < 20 else 90 + i) for i in range(22)], "id long, label int")
    queries = rows.where("id % 2 = 0").select(F.col("id").alias("query_id"), "label")
    run = spark.createDataFrame([(q, (q * 5 + r * 7) % 22, r) for q in range(0, 18, 2) for r in range(1, 12)], "query_id long, id long, rank int")
    pairs = queries.join(rows, "label").where("id <> query_id").select("query_id", "id", F.lit(1).alias("grade"))
    got, want = evaluation.class_measures(run, rows, queries), evaluation.ranked_measures(run, pairs)
    plain = lambda df: sorted((r[0], *(round(x, 9) for x in r[1:])) for r in df.collect())
    assert plain(got) == plain(want) != []


def test_stored_index_makes_no_row_for_a_pair(spark, tmp_path):
    """Before, the search joined postings with queries, a row for each pair of one term."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two two "), F.col("id") % 7).alias("text"))
    search_index.write_index(docs, f"{tmp_path}/index")
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    found = search_index.search_index(spark, f"{tmp_path}/index", asked, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, retrieval.bm25(docs, asked, 5).collect()))
    assert "HashAggregate(keys=[query_id" not in found._jdf.queryExecution().executedPlan().toString()  # of pairs


def test_tasks_go_by_a_block_of_queries():
    from siltstone.operators.retrieval import search_tasks

    assert search_tasks(300_000, 6_000_000, 37, 12) == 12  # not one for each 2^30 of all scores, each with its own best of every query
    assert search_tasks(8192, 10_000_000, 1, 12) == 20
    assert search_tasks(10, 100, 1, 12) == search_tasks(0, 0, 1, 12) == 1


def test_a_file_holds_few_blocks(spark):
    rows = spark.range(0, 6 * blocks.BLOCK_DOCS, 1, 1).selectExpr("id", "array(id % 7) as words")
    packed = blocks.pack(rows)
    sizes = [r["count"] for r in packed.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) >= 6 and max(sizes) <= 4


def test_best_of_single_precision_are_those_of_double():
    rng = np.random.default_rng(7)
    x, y = rng.random((40, 60)) * (rng.random((40, 60)) < 0.5), rng.random((40, 300)) * (rng.random((40, 300)) < 0.5)
    y[:, 150:] = y[:, :150] * (1 + 1e-7)  # told apart by double precision only
    sides = []
    for m in (x, y):
        term, place = np.nonzero(m)
        sides.append(blocks.Side(m.shape[1], *np.unique(term, return_counts=True), place, m[term, place]))
    want, best, ids = blocks.Best(60, 5), blocks.Best(60, 5, 5e-324), np.arange(300)
    found = blocks.Product(*sides)
    assert found.error > 0 and np.abs(found.score - x.T @ y).max() > 0
    assert np.all(np.abs(found.score - x.T @ y) <= found.error * (x.T @ y))
    want.add(x.T @ y, ids, 0)
    best.add(found.score, ids, 0, found.exact, found.error)
    want.settle()
    best.settle()
    assert all(np.array_equal(a, b) for a, b in zip(want.held, best.held, strict=True))


def test_rows_in_one_language_share_a_block(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 50)
    said = ["the of and", "der und die"]
    docs = [(i, f"{said[i % 2]} word{i} word{i + 1}") for i in range(100)]
    rows = spark.createDataFrame(docs, "id long, text string").coalesce(1).select("id", blocks.term_hashes("text").alias("words")).toArrow().to_batches()
    found = [set(np.frombuffer(b.column(1)[0].as_py(), np.int64) % 2) for b in blocks._packed(iter(rows))]
    assert sorted(map(tuple, found)) == [(0,), (1,)]
