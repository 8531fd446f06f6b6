"""Ranked search against a plain scorer."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
AWKWARD = [(1, "Ab ab CD ünïX, ab"), (2, None), (3, ""), (None, "ab cd zz"), (1, "Ab ab CD ünïX, ab"), (5, " .,; "), (6, "zz " * 50_000 + "ab"), (None, None), (9, "cd-ab_cd ÜNÏx")]


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def plain_search(docs, items, k=20):
    words = [(i, plain_terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(plain_terms(t))
    found = []
    for item, terms in asked.items():
        scored = []
        for doc, w in words:
            tf, score = Counter(w), 0
            for t in terms:
                if t in tf:
                    m = 100 - 25 + (25 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        found += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"block_terms": 40, "k": 3}])
def test_search(spark, options, monkeypatch):
    random.seed(3)
    words = [f"w{i}" for i in range(60)] + ["Ünï", "THE", "the"]
    docs = [(i, " ".join(random.choices(words, range(1, 64), k=random.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[i][1]) for i in range(100)]  # ties
    items = [(i, ", ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(30)]
    monkeypatch.setattr(ranked_search, "CHUNK", 500)
    want = plain_search(docs, items, options.get("k", 20))
    df = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert got(df) == want


def test_awkward_tables(spark):
    docs = spark.createDataFrame([(*x, "s", 1, 2, 3) for x in AWKWARD], "doc_id long, text string, item_id string, score int, rank int, n int")
    items = [(1, "ab CD cd"), (2, None), (None, "zz"), (3, "nowhere"), (4, ""), (1, "ab"), (5, "ünïx")]
    asked = spark.createDataFrame([(*x, 7, "y") for x in items], "item_id long, text string, doc_id int, words string")
    assert got(ranked_search.search(docs, asked)) == plain_search(AWKWARD, items)
    assert got(ranked_search.search(docs.limit(0), asked)) == []
    assert got(ranked_search.search(docs, asked.limit(0))) == []


def test_radix_order():
    keys = np.random.default_rng(1).integers(0, 1 << 50, 5000, dtype=np.uint64) >> np.uint64(20)
    assert (ranked_search.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(ranked_search.radix_order(keys[:0])) == 0
    many = np.random.default_rng(2).integers(0, 70_000, (3, 4000))
    want = Counter()
    for i, d, s in many.T.tolist():
        want[i, d] += s
    assert {(i, d): s for i, d, s in zip(*(x.tolist() for x in ranked_search.accumulate(*many)), strict=True)} == want
