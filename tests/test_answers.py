"""Model calls in waves, measures of answers and rankings, small-to-big folding, places in large groups."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation, ranks, retrieval
from siltstone.sources import models


def test_quota_stops_the_work(spark, tmp_path):
    class _Model:
        """Answers, fails for ids that end in 7, and has no quota for those from `last` on."""

        def __init__(self, last):
            self.last = last

        def generate(self, system, user):
            n = int(user)
            if n >= self.last:
                raise models.QuotaExhausted
            if n % 10 == 7:
                raise RuntimeError("busy")
            return f"{system}{n}"

    path = str(tmp_path / "answers")
    rows = spark.createDataFrame([*((i, "s", str(i)) for i in range(200)), (None, "s", "1"), (5, "s", "5")], "id long, system string, user string").repartition(3)
    none = lambda _wait: None
    first = models.generate_rows(rows, path, lambda: _Model(150), waves=5, sleep=none)
    assert sum(first.values()) == 200 and first["skipped"] >= 50 and first["answered"] > 0
    kept = {r.id: r.answer for r in spark.read.parquet(path).where("error is null").collect()}
    assert len(kept) == first["answered"] and all(a == f"s{i}" for i, a in kept.items())
    second = models.generate_rows(rows, path, lambda: _Model(1000), waves=5, sleep=none)
    assert second == {"answered": 180 - first["answered"], "failed": 20, "skipped": 0}
    assert spark.read.parquet(path).where("error is null").select("id").distinct().count() == 180
    assert models.generate_rows(rows.limit(0), path, lambda: _Model(0)) == {"answered": 0, "failed": 0, "skipped": 0}


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return row[-1]


def test_answer_overlap(spark):
    random.seed(2)
    pairs = [(i, *(" ".join(random.choices("a b c D e".split(), k=random.choice([0, 1, 9, 80]))) for _ in range(2))) for i in range(60)] + [(900, None, "x"), (901, "x", None), (902, "Same words", "same  WORDS")]
    for r in evaluation.answer_overlap(spark.createDataFrame(pairs, "key long, answer string, truth string"), "key").collect():
        a, b = next(((x or "").lower().split(), (y or "").lower().split()) for i, x, y in pairs if i == r.key)
        n = plain_common(a, b)
        assert (r.common, r.precision, r.recall) == (n, n / len(a) if a else 0.0, n / len(b) if b else 0.0)
        assert r.f == pytest.approx(2 * n / (len(a) + len(b)) if n else 0.0)


def test_ranked_measures(spark):
    run = [(1, 10, 1), (1, 11, 2), (1, 12, 3), (1, 12, 5), (2, 10, 1), (4, 1, 1)]
    relevant = [(1, 11, 2), (1, 12, 1), (1, 99, 3), (1, 11, 1), (2, 77, 1), (3, 5, 1), (4, 1, 0)]
    got = {r.query_id: r for r in evaluation.ranked_measures(spark.createDataFrame(run, "query_id long, id long, rank int"), spark.createDataFrame(relevant, "query_id long, id long, grade int"), 3).collect()}
    assert set(got) == {1, 2, 3} and all((got[q].ndcg, got[q].recall) == (0, 0) for q in (2, 3))
    ideal = 3 + 2 / math.log2(3) + 1 / 2
    assert (got[1].ndcg, got[1].reciprocal_rank, got[1].average_precision, got[1].recall) == pytest.approx(((2 / math.log2(3) + 1 / 2) / ideal, 1 / 2, (1 / 2 + 2 / 3) / 3, 2 / 3))


def test_parents_stand_for_their_children(spark):
    tree = [("d", None, 100), ("s1", "d", 60), ("s2", "d", 40), ("a", "s1", 20), ("b", "s1", 20), ("c", "s1", 20), ("e", "s2", 40), ("x", "s9", 5), ("y", "s9", 5), ("z", "s9", 5), ("s9", "q", 15), ("s8", "q", 1), ("s7", "q", 1), ("q", None, 17)]
    hits = [(1, "a", 3.0), (1, "b", 5.0), (1, "x", 4.0), (2, "x", 1.0), (2, "y", 2.0), (3, "s1", 9.0), (3, "a", 1.0), (4, "unknown", 1.0)]
    frame = lambda rows, s: spark.createDataFrame(rows, s)
    fold = lambda **o: [(r.query_id, r.id, r.score, r["rank"], r.used) for r in retrieval.fold_into_parents(frame(hits, "query_id long, id string, score double"), frame(tree, "id string, parent string, size long"), **o).orderBy("query_id", "rank").collect()]
    assert fold(levels=1) == [(1, "s1", 5.0, 1, 60), (1, "x", 4.0, 2, 65), (2, "s9", 2.0, 1, 15), (3, "d", 9.0, 1, 100), (3, "a", 1.0, 2, 120)]
    assert fold() == [(1, "d", 5.0, 1, 100), (1, "x", 4.0, 2, 105), (2, "s9", 2.0, 1, 15), (3, "d", 9.0, 1, 100), (3, "a", 1.0, 2, 120)]
    assert fold(budget=100) == [(1, "d", 5.0, 1, 100), (2, "s9", 2.0, 1, 15), (3, "d", 9.0, 1, 100)]


def test_places_in_one_large_group(spark):
    random.seed(6)
    rows = [(random.choice(["hot"] * 8 + ["b", None]), random.choice([1.0, 1.0, 1.0, 0.5, None, random.random()]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score double, id long").repartition(5)
    got = {r.id: r.place for r in ranks.place_in_group(df, "g", "score", "id", "place").collect()}
    for g in ("hot", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert [got[x[2]] for x in own] == list(range(1, len(own) + 1))
    one = spark.createDataFrame([("hot", 1.0, i) for i in range(4000)], "g string, score double, id long").repartition(5)
    ranged = one.repartitionByRange(4, F.col("g"), F.col("score").desc(), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranged) < 2000  # a group of one score is still dealt out
    assert ranks.place_in_group(one.limit(0), "g", "score", "id", "place").count() == 0
