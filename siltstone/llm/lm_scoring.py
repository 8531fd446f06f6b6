"""Scores of texts by a hashed maximum-entropy language model with class-factored softmax.

P(word | history) = P(class | history) * P(word | class). The first factor is a
softmax over at most CLASSES classes whose logits sum one weight row for each
feature of the history: the two classes before, the class three before (a skip
feature), and, hashed into ROWS rows, the word before and the two words before.
The second is the maximum-likelihood solution of a
softmax with a bias for each word, absolutely discounted; what the discounts free
goes to the one outcome that stands for all unknown words. A thousandth of the
base model is mixed in, so that no probability is zero. Over the vocabulary and
the unknown word the probabilities sum to one.

1. Texts become chunks of token numbers with a dictionary each (no text is read
   again).
2. The most frequent words of all chunks are the anchors. Anchors that occur in
   the same documents form groups, for languages and the like; a word belongs to
   the group of documents that hold most of it. A class is a group's words of
   about one frequency, each class with about the same share of the group.
3. Counts and classes are joined back to the chunks' dictionaries.
4. Training goes in rounds over disjoint shares of all training documents: each
   task updates a copy of the weights by sparse minibatches, and the copies are
   averaged row by row, by the tokens that touched the row, in tasks that stream.
5. All documents are scored chunk by chunk.

What goes through the driver has a fixed size: the anchors, their co-occurrence,
the class table and the weights (10 MB).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import remove, store

CLASSES, GROUPS, ANCHORS, CHUNK_TOP = 64, 6, 64, 256
SAME_GROUP = 0.7  # cosine of two anchors' companions
ROWS = 1 << 15
ROUNDS, RATE, BATCH, SCORED = 3, 1.0, 2048, 4096
PIECE = 1 << 18  # tokens whose histories are held at a time
BASE_SHARE = 1e-3
CHUNK_BYTES = 16 << 20
PACKED_ROWS = 1 << 20  # rows that a task holds before it packs them
LEVELS = 8  # frequency levels an octave
BLOCK_ROWS = 2048
UNKNOWN = 255  # a class number that no class has
END = b""

CODED = "chunk long, ids array<long>, train array<boolean>, sizes array<int>, tokens binary, hashes binary, words array<binary>"
READY = "chunk long, ids array<long>, train array<boolean>, sizes array<int>, tokens binary, hashes binary, classes binary, counts binary"
PARTS = "block int, rows binary, touched binary, squares binary, change binary"


def tokens_of(data: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    words = data.lower().split()  # both know ASCII only, and split at 20 and 09-0D
    words.append(END)
    return words


def _coded(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """CODED of docs(id, train, text): token numbers of whole texts, with each chunk's dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, train, sizes, words, held = [], [], [], [], 0

        def row() -> pa.RecordBatch:
            nonlocal number, held
            coded = pa.array(words, pa.binary()).dictionary_encode()
            tokens = pa.compress(np.asarray(coded.indices).astype(np.int32).tobytes(), codec="zstd", asbytes=True)
            known = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
            hashes = np.fromiter(map(xxhash.xxh32_intdigest, coded.dictionary.to_pylist()), np.uint32, len(coded.dictionary)).tobytes()
            out = [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in (tokens, hashes)), known]
            number, held = number + 1, 0
            for x in (ids, train, sizes, words):
                x.clear()
            return pa.RecordBatch.from_arrays(out, names=["chunk", "ids", "train", "sizes", "tokens", "hashes", "words"])

        for batch in batches:
            for at in range(batch.num_rows):
                i, use, text = (batch[c][at].as_py() for c in ("id", "train", "text"))
                said = tokens_of(text or b"")
                ids.append(i)
                train.append(use)
                sizes.append(len(said))
                words += said
                held += len(text or b"") + 1
                if held >= chunk_bytes:
                    yield row()
        if ids:
            yield row()

    return docs.mapInArrow(run, CODED)


class _Chunk:
    """A row of CODED or READY as arrays."""

    def __init__(self, row: dict, words: int) -> None:
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.array(row["train"], bool)
        self.tokens = np.frombuffer(pa.decompress(row["tokens"], int(self.sizes.sum()) * 4, codec="zstd", asbytes=True), np.int32)
        self.n_words = words

    @cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def counted(self, groups: np.ndarray | None = None, n: int = 1) -> np.ndarray:
        """Occurrences in training documents, (group of document, word)."""
        own = self.train[self.doc]
        at = self.tokens[own].astype(np.int64)
        if groups is not None:
            at = at + groups[self.doc[own]] * self.n_words
        return np.bincount(at, minlength=n * self.n_words).reshape(n, self.n_words)


def _anchors(coded: DataFrame) -> list[bytes]:
    """The most frequent words of training documents, by what is frequent in chunks; the end is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch.drop_columns(["words"]).to_pylist(), batch["words"], strict=True):
                words = words.values
                n = _Chunk(row, len(words)).counted()[0]
                top = np.argsort(-n, kind="stable")[:CHUNK_TOP]
                top = top[n[top] > 0]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(top)), pa.array(n[top])], names=["word", "n"])

    rows = coded.select("train", "sizes", "tokens", "words").mapInArrow(run, "word binary, n long").where(F.length("word") > 0)
    best = rows.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(ANCHORS).collect()
    return [bytes(r.word) for r in best]


def _anchor_numbers(words: pa.Array, anchors: list[bytes]) -> np.ndarray:
    """The number of the anchor that each word of a dictionary is, or -1."""
    at = pc.index_in(words, value_set=pa.array(anchors, pa.binary()))
    return np.asarray(at.fill_null(-1)).astype(np.int64)


def _by_anchor(chunk: _Chunk, number: np.ndarray, n: int) -> np.ndarray:
    """How often each document holds each anchor."""
    at = number[chunk.tokens]
    own = at >= 0
    return np.bincount(chunk.doc[own] * n + at[own], minlength=len(chunk.sizes) * n).reshape(len(chunk.sizes), n)


def _together(coded: DataFrame, anchors: list[bytes]) -> np.ndarray:
    """For each two anchors, over training documents, how much they occur together."""
    n = len(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            for row, words in zip(batch.drop_columns(["words"]).to_pylist(), batch["words"], strict=True):
                chunk = _Chunk(row, len(words.values))
                held = np.sqrt(_by_anchor(chunk, _anchor_numbers(words.values, anchors), n)[chunk.train])
                total += held.T @ held
        yield pa.RecordBatch.from_arrays([pa.array(range(n * n), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    rows = coded.select("train", "sizes", "tokens", "words").mapInArrow(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()  # ANCHORS squared at most
    out = np.zeros(n * n)
    for r in rows:
        out[r.cell] = r.value
    return out.reshape(n, n)


def anchor_groups(together: np.ndarray, most: int = GROUPS) -> np.ndarray:
    """A group for each anchor, most frequent first: that of the leader whose companions are most like its own, or a new one."""
    size = np.linalg.norm(together, axis=1, keepdims=True)
    own = together / np.where(size > 0, size, 1)
    leaders: list[int] = []
    groups = np.zeros(len(own), np.int64)
    for i in range(len(own)):
        like = own[leaders] @ own[i] if leaders else np.empty(0)
        if len(like) and (like.max() >= SAME_GROUP or len(leaders) == most):
            groups[i] = int(np.argmax(like))
        else:
            groups[i] = len(leaders)
            leaders.append(i)
    return groups


def _by_group(coded: DataFrame, anchors: list[bytes], groups: np.ndarray) -> DataFrame:
    """(word, g0, g1, ...): occurrences of each word in training documents, by the document's group."""
    n = max(1, len(anchors))
    belongs = np.zeros((n, GROUPS))
    belongs[np.arange(len(groups)), groups] = 1
    names = [f"g{k}" for k in range(GROUPS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, words in zip(batch.drop_columns(["words"]).to_pylist(), batch["words"], strict=True):
                words = words.values
                chunk = _Chunk(row, len(words))
                of = np.argmax(_by_anchor(chunk, _anchor_numbers(words, anchors), n) @ belongs, axis=1)
                counts = chunk.counted(of, GROUPS)
                some = np.flatnonzero(counts.any(0))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(some)), *(pa.array(x[some]) for x in counts)], names=["word", *names])

    rows = coded.select("train", "sizes", "tokens", "words").mapInArrow(run, "word binary, " + ", ".join(f"{g} long" for g in names))
    return rows.groupBy("word").agg(*(F.sum(g).alias(g) for g in names))


def class_plan(rows: list[tuple[int, int, int]], classes: int = CLASSES) -> dict[tuple[int, int], int]:
    """The class of each (group, level) of rows (group, level, occurrences), from 1; a group's classes have about the same share of it."""
    by_group: dict[int, list[tuple[int, int]]] = {}
    for group, level, n in rows:
        by_group.setdefault(group, []).append((level, n))
    bins = (classes - 1) // max(1, len(by_group))
    plan: dict[tuple[int, int], int] = {}
    used: dict[tuple[int, int], int] = {}
    for group, own in sorted(by_group.items()):
        total, before = sum(n for _, n in own), 0
        for level, n in sorted(own, reverse=True):
            plan[group, level] = used.setdefault((group, min(bins - 1, before * bins // total)), len(used) + 1)
            before += n
    return plan


def _vocabulary(counts: DataFrame) -> tuple[DataFrame, str, dict]:
    """(table word, count, class), its path, and the model's sizes and class statistics. Class 0 is the end."""
    spark = counts.sparkSession
    names = [f"g{k}" for k in range(GROUPS)]
    total = sum((F.col(g) for g in names), F.lit(0))
    group = F.array_position(F.array(*names), F.array_max(F.array(*names))).cast("int") - 1
    known, counts_at = store(counts.select("word", total.cast("long").alias("count"), group.alias("group")), "word-counts")
    level = F.floor(LEVELS * F.log2("count")).cast("int")
    levels = known.where(F.length("word") > 0).groupBy("group", level.alias("level")).agg(F.sum("count").alias("n")).collect()  # GROUPS times LEVELS times 63 at most
    plan = class_plan([(r.group, r.level, r.n) for r in levels])
    table = spark.createDataFrame([(g, lv, c) for (g, lv), c in plan.items()], "group int, level int, class int")
    classed = known.withColumn("level", level).join(F.broadcast(table), ["group", "level"], "left")
    vocabulary, path = store(classed.select("word", "count", F.when(F.length("word") == 0, 0).otherwise(F.col("class")).alias("class")), "vocabulary")
    rows = vocabulary.groupBy("class").agg(F.sum("count").alias("n"), F.count("*").alias("types"), F.count_if(F.col("count") == 1).alias("once"), F.count_if(F.col("count") == 2).alias("twice")).collect()  # CLASSES at most
    n_classes = 1 + max((r["class"] for r in rows), default=0)
    n, types, once, twice = (np.zeros(n_classes) for _ in range(4))
    for r in rows:
        n[r["class"]], types[r["class"]], once[r["class"]], twice[r["class"]] = r.n, r.types, r.once, r.twice
    discount = once / np.maximum(1, once + 2 * twice)
    discount[0] = 0
    remove(spark, counts_at)
    model = {"classes": n_classes, "n": np.maximum(n, 1), "discount": discount, "unknown": discount * types / np.maximum(n, 1), "train_tokens": int(n.sum()), "types": int(types.sum())}
    if not rows:
        model["unknown"] = np.ones(1)
    return vocabulary, path, model


def _packed_words(coded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(of, cells): places, classes and counts of words of a chunk's dictionary, some of them in each row."""
    words = coded.select("chunk", F.posexplode("words").alias("place", "word")).join(vocabulary, "word", "left")
    words = words.select(F.col("chunk").alias("of"), "place", F.coalesce("class", F.lit(UNKNOWN)).alias("class"), F.coalesce("count", F.lit(0)).alias("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            of, place, own, count = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1], [True])))
            cells = [place[at].tobytes() + own[at].tobytes() + count[at].tobytes() for at in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]
            return pa.RecordBatch.from_arrays([pa.array(of[order[cuts[:-1]]]), pa.array(cells, pa.binary())], names=["of", "cells"])

        for batch in batches:
            held.append(tuple(np.asarray(batch[c]).astype(kind) for c, kind in zip(("of", "place", "class", "count"), (np.int64, np.int32, np.uint8, np.int64), strict=True)))
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield rows()
                held, n = [], 0
        if n:
            yield rows()

    return words.mapInArrow(run, "of long, cells binary")


def _ready(coded: DataFrame, words: DataFrame) -> DataFrame:
    """READY: the chunks with class and count of each word of their dictionaries in place of the words."""

    def run(chunk: pa.Table, words: pa.Table) -> pa.Table:
        cells = [(x, len(x) // 13) for x in words["cells"].to_pylist()]  # 4, 1 and 8 bytes a word
        order = np.argsort(np.concatenate([np.frombuffer(x, np.int32, n) for x, n in cells]), kind="stable")
        own = np.concatenate([np.frombuffer(x, np.uint8, n, 4 * n) for x, n in cells])[order]
        count = np.concatenate([np.frombuffer(x[5 * n :], np.int64) for x, n in cells])[order]
        return pa.table([*(chunk[c].combine_chunks() for c in chunk.column_names), pa.array([own.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], names=[x.split()[0] for x in READY.split(", ")])

    return coded.drop("words").groupBy("chunk").cogroup(words.groupBy("of")).applyInArrow(run, READY)


class _Histories:
    """Some documents of a chunk, token by token: document, word, count, class, and the weight rows of the history."""

    def __init__(self, chunk: _Chunk, row: dict, docs: np.ndarray, n_classes: int, rows: int) -> None:
        sizes = chunk.sizes[docs]
        self.starts = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(self.starts, sizes)
        tokens = chunk.tokens[place + np.repeat(chunk.starts[docs], sizes)]
        self.count = np.frombuffer(row["counts"], np.int64)[tokens]
        self.target = np.frombuffer(row["classes"], np.uint8)[tokens].astype(np.int32)
        side = np.int32(n_classes + 2)  # the classes, before the text, unknown words
        seen = np.where(self.target == UNKNOWN, np.int32(n_classes + 1), self.target)
        word = np.frombuffer(row["hashes"], np.uint32)[tokens]

        def before(x: np.ndarray, k: int, none: int) -> np.ndarray:
            out = np.empty_like(x)
            out[k:] = x[:-k] if len(x) > k else x[:0]
            out[place < k] = none
            return out

        def slot(x: np.ndarray) -> np.ndarray:
            mixed = ((x * np.uint32(0x85EBCA6B)) ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(7)
            return (mixed % np.uint32(rows)).astype(np.int32) + (side * side + side)

        c1, c2, c3 = (before(seen, k, n_classes) for k in (1, 2, 3))
        w1, w2 = (before(word, k, 0x9E3779B9) for k in (1, 2))
        self.rows = np.stack([c2 * side + c1, side * side + c3, slot(w1), slot(w1 * np.uint32(0x27D4EB2F) + (w2 ^ (w2 >> np.uint32(13))))])


def _pieces(row: dict, n_classes: int, rows: int, chosen: Callable[[_Chunk], np.ndarray]) -> Iterator[tuple[np.ndarray, _Histories]]:
    """(documents, their histories) of a row of READY, about PIECE tokens or one document at a time."""
    chunk = _Chunk(row, len(row["classes"]))
    docs = chosen(chunk)
    upto = np.cumsum(chunk.sizes[docs])
    first = 0
    while first < len(docs):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PIECE, side="right")))
        yield docs[first:last], _Histories(chunk, row, docs[first:last], n_classes, rows)
        first = last


def n_rows(n_classes: int, rows: int) -> int:
    return (n_classes + 2) * (n_classes + 3) + rows


def softmax_of(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """P(class | history) for each column of rows."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def update(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, rows: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One minibatch: the gradient of the log-likelihood, summed for each weight row that it touches; steps shrink with the row's gradients so far."""
    slope = softmax_of(weights, rows)
    slope[np.arange(len(target)), target] -= 1
    flat = rows.ravel()
    if len(weights) <= 1 << 16:
        flat = flat.astype(np.uint16)  # of which numpy's stable sort is a radix sort
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    cuts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    total = np.add.reduceat(slope[order % len(target)], cuts, axis=0)
    own = flat[cuts]
    squares[own] += np.einsum("ij,ij->i", total, total)
    weights[own] -= (rate / np.sqrt(squares[own] + 1e-6))[:, None] * total
    touched[own] += np.diff(np.append(cuts, len(flat)))


def _round(ready: DataFrame, weights: np.ndarray, squares: np.ndarray, n_classes: int, rows: int, share: int, shares: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and squares after a pass over one of the shares of the training documents."""
    sent = ready.sparkSession.sparkContext.broadcast((weights, squares))
    width = weights.shape[1]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = (x.copy() for x in sent.value)
        touched = np.zeros(len(own))
        for batch in batches:
            for row in batch.to_pylist():
                for _docs, part in _pieces(row, n_classes, rows, lambda c: np.flatnonzero(c.train & (np.arange(len(c.train)) % shares == share))):
                    for k in range(0, len(part.target), BATCH):
                        update(own, seen, touched, part.rows[:, k : k + BATCH], part.target[k : k + BATCH])
        out = []
        for block in range(0, len(own), BLOCK_ROWS):
            some = np.flatnonzero(touched[block : block + BLOCK_ROWS]) + block
            if len(some):
                change = (own[some] - sent.value[0][some]).astype(np.float16)
                out.append((block // BLOCK_ROWS, some.astype(np.int32).tobytes(), touched[some].tobytes(), (seen[some] - sent.value[1][some]).tobytes(), change.tobytes()))
        kinds = (pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in PARTS.split(", ")])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                touched, squared, moved = held.setdefault(r["block"], (np.zeros(BLOCK_ROWS), np.zeros(BLOCK_ROWS, np.float32), np.zeros((BLOCK_ROWS, width), np.float32)))
                at = np.frombuffer(r["rows"], np.int32) - r["block"] * BLOCK_ROWS
                n = np.frombuffer(r["touched"])
                touched[at] += n
                squared[at] += np.frombuffer(r["squares"], np.float32)
                moved[at] += np.frombuffer(r["change"], np.float16).reshape(-1, width) * n[:, None].astype(np.float32)
        for block, (touched, squared, moved) in held.items():
            some = np.flatnonzero(touched)
            mean = (moved[some] / touched[some, None]).astype(np.float32)
            cells = [(some + block * BLOCK_ROWS).astype(np.int32).tobytes(), touched[some].tobytes(), squared[some].tobytes(), mean.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=[x.split()[0] for x in PARTS.split(", ")])

    weights, squares = weights.copy(), squares.copy()
    # each row of weights once: n_rows() times CLASSES numbers at most
    for r in ready.mapInArrow(learn, PARTS).repartition("block").mapInArrow(merge, PARTS).select("rows", "squares", "change").toLocalIterator():
        at = np.frombuffer(r.rows, np.int32)
        weights[at] += np.frombuffer(r.change, np.float32).reshape(-1, width)
        squares[at] += np.frombuffer(r.squares, np.float32)
    return weights, squares


def token_scores(part: _Histories, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(base, score): log10 probabilities of the tokens."""
    count = part.count
    plain = (count + 1.0) / (model["train_tokens"] + (model["types"] + 1.0))
    within = np.where(count > 0, 1.0, 0.0)
    known = np.flatnonzero(count > 0)
    own = part.target[known]
    within[known] = (count[known] - model["discount"][own]) / model["n"][own]
    likely = np.empty(len(count))
    for a in range(0, len(count), SCORED):
        p = softmax_of(model["weights"], part.rows[:, a : a + SCORED])
        target = part.target[a : a + SCORED]
        there = target != UNKNOWN
        rest = p @ model["unknown"].astype(np.float32)
        likely[a : a + SCORED] = np.where(there, p[np.arange(len(p)), np.where(there, target, 0)] * within[a : a + SCORED], rest)
    return np.log10(plain), np.log10((1 - BASE_SHARE) * likely + BASE_SHARE * plain)


def _scored(ready: DataFrame, model: dict, rows: int) -> DataFrame:
    sent = ready.sparkSession.sparkContext.broadcast(model)
    schema = "id long, train boolean, n_tokens long, n_known long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, train = pa.array(row["ids"], pa.int64()), pa.array(row["train"], pa.bool_())
                for docs, part in _pieces(row, sent.value["classes"], rows, lambda c: np.arange(len(c.sizes))):
                    base, score = (np.add.reduceat(x, part.starts) for x in token_scores(part, sent.value))
                    known = np.add.reduceat((part.count > 0).astype(np.int64), part.starts)
                    at = pa.array(docs)
                    cells = [ids.take(at), train.take(at), pa.array(np.diff(np.append(part.starts, len(part.target)))), pa.array(known), pa.array(base), pa.array(score)]
                    yield pa.RecordBatch.from_arrays(cells, names=[x.split()[0] for x in schema.split(", ")])

    return ready.mapInArrow(run, schema)


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", *, rows: int = ROWS, rounds: int = ROUNDS, chunk_bytes: int = CHUNK_BYTES) -> tuple[dict, DataFrame, DataFrame]:
    """(model, READY chunks of all docs, vocabulary), learnt from the rows for which train holds."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("binary").alias("text"))
    coded, coded_at = store(_coded(own, chunk_bytes), "coded")
    anchors = _anchors(coded)
    groups = anchor_groups(_together(coded, anchors)) if anchors else np.zeros(0, np.int64)
    vocabulary, _, model = _vocabulary(_by_group(coded, anchors, groups))
    words, words_at = store(_packed_words(coded, vocabulary), "coded-words")
    remove(spark)
    ready, _ = store(_ready(coded, words), "ready")
    remove(spark, coded_at, words_at)
    weights = np.zeros((n_rows(model["classes"], rows), model["classes"]), np.float32)
    squares = np.zeros(len(weights), np.float32)
    if model["train_tokens"]:
        for share in range(rounds):
            weights, squares = _round(ready, weights, squares, model["classes"], rows, share, rounds)
            remove(spark)
    return model | {"weights": weights}, ready, vocabulary


def lm_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text).

    ``train``: which rows are learnt from; where it is null, none. Null texts are
    empty: their one token is the end. Ids are integers and may be null or
    repeated. Nothing to learn from gives scores of 0, as every word is the unknown
    one then; an empty table gives no rows; other columns are ignored.
    """
    model, ready, _ = fit(docs, train, id_col, text_col, **options)
    scored = _scored(ready, model, options.get("rows", ROWS))
    return scored.select(F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model["train_tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
