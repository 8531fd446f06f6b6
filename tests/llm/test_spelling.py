"""Spelling variants against comparing all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import queries, spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_words(docs, drop_every=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if drop_every and i is not None and h % drop_every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_variants(words):
    near = {w: [x for x in words if x != w and one_edit(x, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(rows)


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def made_words(seed, n, letters="abé", size=(7, 10)):
    random.seed(seed)
    words = {}
    while len(words) < n:
        w = "".join(random.choices(letters, k=random.randint(*size)))
        words[w] = random.choice([1, 2, 3, 30, 31, 400, 5000])
        i = random.randrange(len(w))
        words[w[:i] + random.choice(letters) + w[i + random.randint(0, 1) :]] = random.choice([1, 20, 300])
    return words


@pytest.mark.parametrize("most", [2048, 20, 3])
def test_variants(spark, most, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_ROWS", 300)
    words = made_words(4, 500) | made_words(5, 200, "abcdefgÿ", (1, 3)) | {"stem" * 9 + a + b: 2 for a in "abcdef" for b in "uvwxyz"} | {"y" * 5000: 3, "y" * 4999: 30, "日本語": 4, "日本": 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    assert got(spelling.spelling_variants(df, most=most)) == plain_variants(words)


def test_words_and_query(spark, tmp_path):
    random.seed(8)
    forms = ["Zeitung", "zeitungen", "Éclairage", "straßen", "letter", "NOTHING", "nothin×g", "accommodate"]
    docs = [(i, ", ".join(random.choices(forms, k=random.randint(0, 40)))) for i in range(120)]
    docs += [(None, "Zeitung Zeitung"), (3, None), (4, ""), (5, docs[5][1]), (6, "w" * 100_000 + " " + "w" * 100_000), (7, "日本語日本語日本語 zeitung9zeitung")]
    table = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, n int, held int")
    words = plain_words(docs)
    assert {r.word: r.n for r in spelling.word_counts(table, drop_every=31).collect()} == words
    assert {r.word: r.n for r in spelling.word_counts(table).collect()} == plain_words(docs, None)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert got(queries.op12_spelling_variants(spark, str(tmp_path))) == plain_variants(words)


def test_empty_and_odd_words(spark):
    df = spark.createDataFrame([("", 3), (None, 4), ("abcdefg", None), ("abcdefh", 5)], "word string, n long")
    assert got(spelling.spelling_variants(df)) == [("abcdefh", 5, 0, None, None, "abcdefh")]
    assert got(spelling.spelling_variants(df.limit(0))) == []
    assert spelling.word_counts(df.select(F.lit(1).alias("doc_id"), F.col("word").alias("text")).limit(0)).count() == 0


def test_bands_share_the_bits(spark):
    words = spark.createDataFrame([(w, 1) for w in made_words(2, 300, "abcdefgh")], "word string, n long")
    bands = spelling.band_masks(spelling._with_masks(words))
    assert bands[0] | bands[1] | bands[2] == (1 << 64) - 1 and not (bands[0] & bands[1] | bands[0] & bands[2] | bands[1] & bands[2])
