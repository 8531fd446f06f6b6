"""Ranked lexical search by sort-based accumulation.

Items are taken in blocks of a bounded number of terms. For each block:

1. One pass over the texts keeps each document's length and its counts of the
   block's terms, as a table of postings by document.
2. The documents that hold a term are counted from that table; a term's weight
   and the items that ask for it go to every task (bounded with the block).
3. A task owns a range of documents. It concatenates the arrays of item,
   document and impact that its postings match, radix sorts their packed keys
   and sums each key's run by ``reduceat``. A heap for each item keeps the best
   of the range.
4. What the ranges kept is ranked in two levels, so that no task gets all of it.

A document lies in one range, so no sum is split, and no posting is shuffled.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import small_batches, store

TOP = 20
BLOCK_TERMS = 1 << 19  # terms of the items that are searched together, repeats included
CHUNK = 1 << 20  # matches that are sorted at a time
NO_ID = (1 << 63) - 1  # sorts a null id after all others
SALTS = 64
DIGIT = 16

#: What is no part of a term becomes a space; A-Z become a-z. Bytes from 80 on belong to letters beyond ASCII.
_TERM = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))

POSTINGS = "id long, n long, terms array<int>, counts array<int>"


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return data.translate(_TERM).split()


def _rows_of_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """POSTINGS of docs(id, text): one row for each document with a term, with its counts of the vocabulary's terms."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for part in small_batches([batch]):
                out = []
                for i, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    if words := terms_of(text or b""):
                        found = Counter(filter(number.__contains__, words))
                        out.append((i, len(words), [number[w] for w in found], list(found.values())))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, POSTINGS)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by digits of 16 bits from the least; a digit that is in order already costs one look."""
    order = np.arange(len(keys))
    now = keys
    for shift in range(0, int(keys.max()).bit_length() if len(keys) else 0, DIGIT):
        digit = (now >> np.uint64(shift)).astype(np.uint16)
        if (digit[1:] < digit[:-1]).any():
            by = np.argsort(digit, kind="stable")  # numpy's stable sort of 16-bit integers is a radix sort
            order, now = order[by], now[by]
    return order


def accumulate(items: np.ndarray, docs: np.ndarray, impacts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, docs, sums) of the distinct pairs, by item and then document. Both are below 2**32."""
    keys = items.astype(np.uint64) << np.uint64(32) | docs.astype(np.uint64)
    order = radix_order(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    sums = np.add.reduceat(impacts[order], at) if len(at) else impacts
    return (keys[at] >> np.uint64(32)).astype(np.int64), (keys[at] & np.uint64((1 << 32) - 1)).astype(np.int64), sums


class _Heaps:
    """The k best (score, id) of each item; of equal scores the lesser id is better."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.of, self.least = k, [[] for _ in range(n)], np.zeros(n, np.int64)

    def add(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        fits = (scores > 0) & (scores >= self.least[items])
        items, ids, scores = items[fits], ids[fits], scores[fits]
        cuts = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1], [True]))) if len(items) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            item, heap, own, said = int(items[a]), self.of[int(items[a])], scores[a:b], ids[a:b]
            if b - a > self.k:  # all that the k-th best of these excludes
                some = own >= np.partition(own, b - a - self.k)[b - a - self.k]
                own, said = own[some], said[some]
            for x in zip(own.tolist(), (-said).tolist(), strict=True):
                if len(heap) < self.k:
                    heapq.heappush(heap, x)
                elif x > heap[0]:
                    heapq.heapreplace(heap, x)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _best_of_ranges(rows: DataFrame, block: dict, k: int) -> DataFrame:
    """(item, id, score): the k best of each task's documents. block: weight by term, n_docs, n_terms, and the items that ask for each term."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = sent.value
        ends, asking, times, weight = b["ends"], b["items"], b["times"], b["weight"]
        best = _Heaps(b["n_items"], k)
        for batch in batches:
            sizes = np.diff(np.asarray(batch["terms"].offsets))
            if not len(sizes):
                continue
            term, tf = np.asarray(batch["terms"].flatten()).astype(np.int64), np.asarray(batch["counts"].flatten()).astype(np.int64)
            ids = np.array([NO_ID if i is None else i for i in batch["id"].to_pylist()], np.int64)
            long = np.array([100 - 25 + (25 * n * b["n_docs"]) // b["n_terms"] for n in batch["n"].to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * long[doc]))
            matched = ends[term + 1] - ends[term]
            upto = np.concatenate(([0], np.cumsum(np.bincount(doc, matched, len(sizes)).astype(np.int64))))
            at, first = np.concatenate(([0], np.cumsum(sizes))), 0
            while first < len(sizes):
                last = max(first + 1, int(np.searchsorted(upto, upto[first] + CHUNK, side="right")) - 1)
                own = slice(at[first], at[last])
                n = matched[own]
                from_ = np.repeat(np.arange(own.start, own.stop), n)
                place = np.arange(len(from_)) - np.repeat(np.cumsum(n) - n, n) + ends[term[from_]]
                items, docs, sums = accumulate(asking[place], doc[from_], impact[from_] * times[place])
                best.add(items, ids[docs], sums)
                first = last
        found = [(i, -d, s) for i, heap in enumerate(best.of) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["item", "id", "score"])

    return rows.mapInArrow(run, "item long, id long, score long")


def _first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = W.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: DataFrame, most: int) -> tuple[int, DataFrame]:
    """The number of blocks, and items(item_id, words) with their block. A block has at most ``most`` terms, or one item."""
    blocks = 1
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.sum(F.size("words")).alias("n"), F.count_distinct("item_id").alias("items"))
        if sizes.where((F.col("n") > most) & (F.col("items") > 1)).isEmpty():
            return blocks, dealt
        blocks *= 2


def _search_block(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """(item, id, score, rank) for asked: a row (item_id, words) for each row of the items."""
    numbers: dict[bytes, int] = {}
    wanted: Counter = Counter()
    names = {x: n for n, x in enumerate(dict.fromkeys(r.item_id for r in asked))}
    for r in asked:
        for word in r.words:
            wanted[numbers.setdefault(bytes(word), len(numbers)), names[r.item_id]] += 1
    rows, _ = store(_rows_of_terms(docs, numbers), "postings")
    whole = rows.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
    held = np.zeros(len(numbers), np.int64)
    for r in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # the block's terms at most
        held[r.term] = r.df
    pairs = np.array(sorted((t, i, n) for (t, i), n in wanted.items()), np.int64).reshape(-1, 3)
    block = {
        "n_docs": whole.n_docs, "n_terms": whole.n_terms, "n_items": len(names), "items": pairs[:, 1], "times": pairs[:, 2],
        "weight": np.floor(1000 * np.log((2.0 * whole.n_docs + 2) / (2.0 * held + 1))).astype(np.int64), "ends": np.searchsorted(pairs[:, 0], np.arange(len(numbers) + 1)),
    }
    near = _first(_best_of_ranges(rows, block, k).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))), k, "item", "salt")
    ranked = _first(near.drop("salt", "rank"), k, "item")
    named = ranked.join(docs.sparkSession.createDataFrame([(n, x) for x, n in names.items()], "item long, item_id long"), "item")
    return named.select("item_id", "rank", F.when(F.col("id") < NO_ID, F.col("id")).alias("id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 for each item, of equal scores the least id first.

    Ids are integers. Every row of docs counts as a document of its own; null
    texts and texts without terms count as none, null ids rank after others.
    Rows of items that share an id are one item with the terms of all of them;
    a null id is one too. An empty table of either kind gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms_of(x or b"") for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["item_id"], pa.array(words, pa.list_(pa.binary()))], names=["item_id", "words"])

    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("binary").alias("text")).mapInArrow(split, "item_id long, words array<binary>")
    asked, _ = store(asked, "asked")
    blocks, dealt = _blocks(asked, block_terms)
    found = None
    for i in range(blocks):
        if rows := dealt.where(F.col("block") == i).select("item_id", "words").collect():  # block_terms terms at most
            part, _ = store(_search_block(own, rows, k), "ranked")
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "item_id long, rank int, id long, score long")
    return found.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
