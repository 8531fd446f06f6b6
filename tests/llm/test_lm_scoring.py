"""The language model against plain counts, plain scores and its own sum of probabilities."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import lm_scoring, queries

DATA = "/root/testdata/sf0.001"
AWKWARD = [(1, "One two\x85three  one\n"), (2, None), (3, ""), (None, "two two TWO Ä ä"), (1, "One two\x85three  one\n"), (5, " \t\x0b\x0c\r\n"), (6, "long " * 60_000), (None, None), (8, "one\x1ctwo one")]


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0d]+", text or "")] + [""]


def held_out(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 == 2


def plain_base(docs):
    counts = Counter(t for i, text in docs if not held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    return [(i, held_out(i), len(said := tokens(text)), sum(t in counts for t in said), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in said)) for i, text in docs]


def same_base(got, want):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want])


def base_of(df):
    return [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in df.collect()]


def in_training():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    df = queries.op13_lm_scoring(spark, DATA).cache()
    same_base(base_of(df), plain_base(docs))
    own = df.where("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("n_tokens").alias("n")).first()
    assert own.score > own.base + 0.2 * own.n  # log10 a token, on documents that were not learnt from
    df.unpersist()


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(*x, "s", 1, 2, 3) for x in AWKWARD], "doc_id long, text string, train string, score int, chunk int, words int")
    for options in ({}, {"chunk_bytes": 8}):
        df = lm_scoring.lm_scores(docs, in_training(), **options)
        same_base(base_of(df), plain_base(AWKWARD))
        assert all(math.isfinite(r.score) and r.score < 0 for r in df.collect())
    assert lm_scoring.lm_scores(docs.limit(0), in_training()).count() == 0
    assert {(r.held_out, r.train_tokens, r.n_known, r.base_score, r.score) for r in lm_scoring.lm_scores(docs, F.lit(None).cast("boolean")).collect()} == {(True, 0, 0, 0.0, 0.0)}
    empty = lm_scoring.lm_scores(docs, F.col("doc_id") == 3).collect()  # nothing but an end to learn from
    assert len(empty) == len(AWKWARD) and all(math.isfinite(r.score) for r in empty)


def test_scores_and_sum_of_probabilities(spark):
    """Histories, weights and smoothing recomputed token by token; probabilities of all outcomes sum to one."""
    rows = 64
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 40")
    model, ready, vocabulary = lm_scoring.fit(docs, F.col("doc_id") % 4 != 1, rows=rows, chunk_bytes=30_000)
    known = {bytes(r.word).decode(): (r["count"], r["class"]) for r in vocabulary.collect()}
    code = {t: xxhash.xxh32_intdigest(t.encode()) for r in docs.collect() for t in tokens(r.text)}
    assert ready.count() > 1
    m32 = 0xFFFFFFFF
    classes, weights = model["classes"], model["weights"]
    side = classes + 2

    def slot(x):
        return side * side + side + (((((x * 0x85EBCA6B) & m32) ^ (x >> 15)) * 0xC2B2AE35 & m32) >> 7) % rows

    def likely(said, at):
        seen = [known[w][1] if w in known else classes + 1 for w in said]
        c1, c2, c3 = (seen[at - k] if at >= k else classes for k in (1, 2, 3))
        w1, w2 = (code[said[at - k]] if at >= k else 0x9E3779B9 for k in (1, 2))
        z = sum(weights[r].astype(float) for r in (c2 * side + c1, side * side + c3, slot(w1), slot((w1 * 0x27D4EB2F + (w2 ^ (w2 >> 13))) & m32)))
        p = np.exp(z - z.max())
        return p / p.sum()

    n, types = model["train_tokens"], model["types"]
    assert (n, types) == (sum(c for c, _ in known.values()), len(known))

    def mixed(p, word):
        count, own = known.get(word, (0, None))
        inner = p @ model["unknown"] if own is None else p[own] * (count - model["discount"][own]) / model["n"][own]
        return (1 - lm_scoring.BASE_SHARE) * inner + lm_scoring.BASE_SHARE * (count + 1) / (n + types + 1)

    got = {r.id: r.score for r in lm_scoring._scored(ready, model, rows).collect()}
    for r in docs.collect()[:12]:
        said = tokens(r.text)
        assert got[r.doc_id] == pytest.approx(sum(math.log10(mixed(likely(said, t), w)) for t, w in enumerate(said)), rel=1e-4)
        for t in (0, 1, len(said) - 1):
            p = likely(said, t)
            assert sum(mixed(p, w) for w in known) + mixed(p, None) == pytest.approx(1)


def test_update_follows_the_gradient():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(20, 4)).astype(np.float32)
    rows, target = rng.integers(0, 20, (4, 30)), rng.integers(0, 4, 30)
    gain = lambda w: np.log(lm_scoring.softmax_of(w.astype(np.float64), rows)[np.arange(30), target]).sum()
    slope = np.zeros((20, 4))
    for i, j in np.ndindex(20, 4):
        more, less = weights.astype(np.float64), weights.astype(np.float64)
        more[i, j] += 1e-4
        less[i, j] -= 1e-4
        slope[i, j] = (gain(more) - gain(less)) / 2e-4
    now, squares, touched = weights.copy(), np.ones(20, np.float32), np.zeros(20)
    lm_scoring.update(now, squares, touched, rows, target, rate=0.1)
    step = 0.1 / np.sqrt(1 + (slope**2).sum(1, keepdims=True))
    assert now - weights == pytest.approx(np.where(touched[:, None] > 0, step * slope, 0), abs=1e-4)
    assert touched.sum() == rows.size


def test_anchor_groups_and_classes():
    together = np.kron(np.eye(2), np.full((3, 3), 5.0)) + 0.1
    assert lm_scoring.anchor_groups(together[[0, 3, 1, 4, 2, 5]][:, [0, 3, 1, 4, 2, 5]]).tolist() == [0, 1, 0, 1, 0, 1]
    plan = lm_scoring.class_plan([(0, lv, 100) for lv in range(50)] + [(3, 2, 7)], classes=11)
    assert sorted(set(plan.values())) == list(range(1, 7)) and Counter(plan[0, lv] for lv in range(50)) == {c: 10 for c in range(1, 6)}
