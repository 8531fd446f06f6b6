"""What op2 holds and moves: hashes of a pack's places by pieces, contexts of a pack once."""

import tracemalloc

import numpy as np

from siltstone.llm import suffix_dedup

rng = np.random.default_rng(5)


def test_anchors_by_pieces(monkeypatch):
    data = rng.integers(97, 101, 3 << 20).astype(np.uint8)
    data[5000:9000] = 97
    owner = np.sort(rng.integers(0, 900, len(data))).astype(np.int32)
    tracemalloc.start()
    got = suffix_dedup.anchor_runs(data, owner)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 * len(data)  # all places at once: 56 bytes a place
    monkeypatch.setattr(suffix_dedup, "STARTS", len(data))
    assert all((a == b).all() for a, b in zip(got, suffix_dedup.anchor_runs(data, owner), strict=True))


def test_columns_come_back():
    columns = [np.array([0, 1, 1 << 40]), np.empty(0, np.int64), np.array([-3, suffix_dedup.NO_ID]), np.zeros(5, np.int64)]
    back = suffix_dedup.restored(suffix_dedup.squeezed(*columns), 4)
    assert all((a == b.astype(np.int64)).all() for a, b in zip(columns, back, strict=True))
    rising = np.sort(rng.integers(0, 1 << 36, 5000))
    assert len(suffix_dedup.squeezed(suffix_dedup._rises(rising))) < 4 * len(rising)


def test_a_pack_sends_a_context_once(spark):
    """The smallest document has two contexts of one anchor, a later one in the same pack the first of them."""
    line = "all of this long line occurs again and again in every one of these texts, letter by letter; "
    tails = ["one end of it " * 4, "and another one " * 4]
    rows = [(1, line + tails[0] + line + tails[1]), (2, "0123456789" + line + tails[0]), (3, "x" + line), (4, line + tails[1] + line + tails[1])]
    docs = spark.createDataFrame(rows, "id long, text string")
    for hot in (4096, 2):
        got = {r.id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeated_bytes(docs, "id", "text", hot=hot, with_text=True).collect()}
        for i, text in rows:
            held = {t[p : p + 50] for j, t in rows if j < i for p in range(len(t) - 49)}
            gone = {q for p in range(len(text) - 49) if text[p : p + 50] in held for q in range(p, p + 50)}
            assert got[i] == "".join(c for p, c in enumerate(text) if p not in gone)
    many = spark.createDataFrame([(i, f"{i:05d}" + line * 3) for i in range(400)], "id long, text string").selectExpr("id as order", "sha2(text, 256) as digest", "text")
    packs = suffix_dedup._packed_by_digest(many, 1 << 20, 4)
    sent = suffix_dedup._suffixes(packs, suffix_dedup._again(suffix_dedup._hashes(packs, 4), 1 << 20), 4)
    assert sent.selectExpr("sum(length(items) + length(bytes)) as n").first().n < 400 * len(line)  # before: 120 bytes for each of the 18 anchors of a text


def test_buckets_are_level():
    """Anchors are least hashes, so small ones: a range of keys must not hold most of them."""
    data = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    keys = suffix_dedup._keys(suffix_dedup.anchor_runs(data, np.zeros(len(data), np.int32))[3])
    n = np.bincount(suffix_dedup._bucket(keys, 50).astype(np.int64), minlength=50)
    assert n.max() < 1.2 * n.mean()
