"""Spelling variants: words one edit apart, found by bands of their letters' parities.

A word's mask has a bit for each class of letters, set if the word holds an odd
number of them. One inserted or deleted code point flips one bit, a replaced one
two or none. The 64 bits are split into three bands of about equal entropy, so
two words one edit apart agree in a band at least.

1. Each word is filed under its three bands, with the words of its own length and
   of one more, and again with those of one less.
2. A group of words with equal band and fitting lengths is compared in one task:
   masks first, then the words themselves.
3. A group of over ``most`` words is split: one edit leaves the left or the right
   half of a word as it was, so its words are filed again under either half, and
   so on into the half that holds the edit, until no group is too large. At one
   open position a group cannot exceed the alphabet.

A pair is counted once: in its first equal band, and of a split group in the part
that holds its edit's last possible place.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import remove, small_batches, store

LEAST_CHARS, LEAST_COUNT, RATIO = 7, 2, 10
BANDS = 3
MOST = 2048  # words of a group that one task compares
HELD_WORDS = 1 << 19  # distinct words that a task counts before it sends them
BLOCK_ROWS = 1 << 15  # rows of whole groups that are compared together
CELLS = 1 << 21  # cells of a comparison at a time

LETTERS = "A-Za-zÀ-ÿ"
#: A-Z and no other letters.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

GROUP = ("band", "short", "part", "key", "a", "b")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop_every: int | None = None) -> DataFrame:
    """(word, n): runs of letters of whole texts with A-Z lower-cased, of least_chars or more, that occur least_count times or more.

    ``drop_every`` plants misspellings: where it divides the CRC-32 of
    ``<id>:<run>``, the run loses the code point at CRC modulo length. Null ids
    get none of them; null and empty texts have no words; repeated rows count
    each; other columns are ignored.
    """
    run_of = re.compile(f"[{LETTERS}]{{{least_chars},}}")  # shorter runs cannot become words

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in small_batches(batches):
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                found = Counter(run_of.findall((text or "").translate(LOWER)))
                if drop_every is None or i is None:
                    held.update(found)
                    continue
                start = zlib.crc32(f"{i}:".encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), start)
                    if h % drop_every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= least_chars:
                        held[run] += n
            if len(held) >= HELD_WORDS:
                yield rows()
        if held:
            yield rows()

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words, starts, lengths)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    return codes, np.cumsum(sizes) - sizes, sizes


def parity_masks(words: list[str]) -> np.ndarray:
    """A word's mask: bit k set if the word holds an odd number of code points that are k modulo 64. No word is empty."""
    if not words:
        return np.empty(0, np.uint64)
    codes, starts, _ = _codes(words)
    return np.bitwise_xor.reduceat(np.uint64(1) << (codes & np.uint32(63)).astype(np.uint64), starts)


def _with_masks(words: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["word"], batch["n"], pa.array(parity_masks(batch["word"].to_pylist()).view(np.int64))], names=["word", "n", "mask"])

    return words.mapInArrow(run, "word string, n long, mask long")


def band_masks(masks: DataFrame) -> list[int]:
    """Three masks that share the 64 bits out, each with about the same entropy over masks(mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(64, np.int64), 0
        for batch in batches:
            own = np.asarray(batch["mask"]).view(np.uint64)
            seen += [int(((own >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)]
            n += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array(seen), pa.array(np.full(64, n))], names=["bit", "odd", "n"])

    rows = masks.select("mask").mapInArrow(run, "bit int, odd long, n long").groupBy("bit").agg(F.sum("odd").alias("odd"), F.sum("n").alias("n")).collect()  # 64 rows
    share = np.zeros(64)
    for r in rows:
        share[r.bit] = r.odd / max(1, r.n)
    inner = np.clip(share, 1e-12, 1 - 1e-12)
    entropy = -(inner * np.log2(inner) + (1 - inner) * np.log2(1 - inner))
    bands, held = [0] * BANDS, [0.0] * BANDS
    for bit in np.argsort(-entropy, kind="stable").tolist():
        least = min(range(BANDS), key=lambda b: (held[b], bands[b].bit_count()))
        bands[least] |= 1 << bit
        held[least] += entropy[bit]
    return bands


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _filed(words: DataFrame, bands: list[int]) -> DataFrame:
    """GROUP and (word, n) of words(word, n, mask): each under its bands, as the shorter and as the longer of a pair."""
    places = [F.struct(F.lit(b).alias("band"), (F.length("word") - longer).alias("short"), F.col("mask").bitwiseAND(F.lit(_signed(bits))).alias("part")) for b, bits in enumerate(bands) for longer in (0, 1)]
    rows = words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("p.*", "word", "n")
    return rows.select("band", "short", "part", F.lit(0).cast("long").alias("key"), F.lit(0).alias("a"), F.col("short").alias("b"), "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The rows of groups that are too large, each filed under either half of the open places [a, b)."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    more = F.length("word") - F.col("short")  # 1: the longer word, whose right part lies one on
    left = F.substring("word", F.col("a") + 1, middle - F.col("a"))
    right = F.substring("word", middle + more + 1, F.col("b") - middle)
    sides = F.array(
        F.struct(F.xxhash64("key", F.lit(0), left).alias("key"), middle.alias("a"), F.col("b").alias("b")), F.struct(F.xxhash64("key", F.lit(1), right).alias("key"), F.col("a").alias("a"), middle.alias("b"))
    )
    return rows.withColumn("s", F.explode(sides)).select("band", "short", "part", "s.key", "s.a", "s.b", "word", "n")


def _grouped(words: DataFrame, bands: list[int], most: int) -> tuple[DataFrame, list[str]]:
    """(rows of GROUP, word and n in which no group exceeds most, tables to delete afterwards)."""
    rows, done, paths = _filed(words, bands), None, []
    while True:
        large = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where((F.col("n") > most) & (F.col("b") - F.col("a") > 1)).drop("n")
        large, path = store(large, "large-groups")
        paths.append(path)
        small = rows.join(large, list(GROUP), "left_anti")
        done = small if done is None else done.unionByName(small)
        if large.isEmpty():
            return done, paths
        rows, path = store(_halved(rows.join(large, list(GROUP), "left_semi")), "halved")
        paths.append(path)


def _candidates(masks: np.ndarray, shorts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of a group whose masks allow one edit; its first ``shorts`` words are the shorter ones. i is one of them."""
    left, right = [], []
    step = max(1, CELLS // max(1, len(masks)))
    for a in range(0, shorts, step):
        b = min(shorts, a + step)
        flips = np.bitwise_count(masks[a:b, None] ^ masks[None, a:])
        fits = flips == 1
        fits[:, : shorts - a] = (flips[:, : shorts - a] & 0xFD) == 0  # equal lengths: none or two
        i, j = np.nonzero(fits)
        keep = j > i
        left.append(i[keep] + a)
        right.append(j[keep] + a)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def edit_places(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For the words i and j, j as long or one longer: the last place where one edit can turn i into j, -1 if none does."""
    out = np.full(len(i), -1, np.int64)
    for size in np.unique(sizes[i]).tolist():
        for more in (0, 1):
            own = np.flatnonzero((sizes[i] == size) & (sizes[j] == size + more))
            step = max(1, CELLS // max(1, size))
            for at in (own[k : k + step] for k in range(0, len(own), step)):
                x = codes[starts[i[at]][:, None] + np.arange(size)]
                y = codes[starts[j[at]][:, None] + np.arange(size + more)]
                same = x == y[:, :size]
                first = np.where(same.all(1), size, np.argmin(same, 1))
                if more:
                    rest = x == y[:, 1:]
                    last = np.where(rest.all(1), -1, size - 1 - np.argmin(rest[:, ::-1], 1))
                    out[at] = np.where(last < first, first, -1)
                else:
                    out[at] = np.where((~same).sum(1) == 1, first, -1)
    return out


def _near(rows: DataFrame, bands: list[int], ratio: int) -> DataFrame:
    """(word, n_near, form_n, form) by group: how many near words, and the best of those with ratio times the count."""
    masks = np.array(bands, np.uint64)

    def compare(table: pa.Table) -> pa.RecordBatch:
        words = table["word"].to_pylist()
        codes, starts, sizes = _codes(words)
        mask, n = parity_masks(words), table["n"].to_numpy()
        band, short, a, b = (table[c].to_numpy() for c in ("band", "short", "a", "b"))
        new = np.zeros(len(words), bool)
        new[:1] = True
        for c in GROUP:
            x = table[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = np.append(np.flatnonzero(new), len(words))
        left, right = [], []
        for g, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if end - g > 1:
                longer = sizes[g:end] > short[g]
                order = np.argsort(longer, kind="stable")
                i, j = _candidates(mask[g:end][order], int(end - g - longer.sum()))
                left.append(order[i] + g)
                right.append(order[j] + g)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        flipped = mask[i] ^ mask[j]
        fresh = np.ones(len(i), bool)
        for k in range(BANDS - 1):
            fresh &= (band[i] <= k) | (flipped & masks[k] != 0)
        i, j = i[fresh], j[fresh]
        place = edit_places(codes, starts, sizes, i, j)
        found = (place >= a[i]) & ((place < b[i]) | (b[i] == short[i]))
        u, v = np.concatenate((i[found], j[found])), np.concatenate((j[found], i[found]))
        near = np.bincount(u, minlength=len(words))
        good = n[v] >= ratio * n[u]
        u, v = u[good], v[good]
        rank = pc.rank(table["word"].combine_chunks(), tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.lexsort((rank[v], -n[v], u))
        u, v = u[order], v[order]
        best = np.full(len(words), -1, np.int64)
        best[u[::-1]] = v[::-1]
        some = np.flatnonzero(near)
        form = pa.array(best[some], mask=best[some] < 0)
        said = table["word"].combine_chunks()
        return pa.RecordBatch.from_arrays([said.take(pa.array(some)), pa.array(near[some]), pa.array(n, pa.int64()).take(form), said.take(form)], names=["word", "n_near", "form_n", "form"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.table(batch.columns, names=batch.schema.names) if held is None else pa.concat_tables([held, pa.table(batch.columns, names=batch.schema.names)])
            if held.num_rows >= BLOCK_ROWS:
                last = {c: held[c][-1].as_py() for c in GROUP}
                open_ = np.ones(held.num_rows, bool)
                for c in GROUP:
                    open_ &= held[c].to_numpy() == last[c]
                whole = int(np.argmax(open_))  # the last group may go on
                if whole:
                    yield compare(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield compare(held)

    dealt = rows.select(*GROUP, "word", "n").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, "word string, n_near long, form_n long, form string")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): forms are followed to the last by doubling. Counts grow along them, so none comes back."""
    now, path = store(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step, at = store(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        remove(forms.sparkSession, path)
        now, path = step.select("word", "root"), at
        if step.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, *, ratio: int = RATIO, most: int = MOST) -> DataFrame:
    """words(word, n) with n_near, form, form_n and root.

    Near words differ by one inserted, deleted or replaced code point. A word's
    form is its near word of largest n, of equal ones the first in code-point
    order, if that n is ratio times its own; its root is what forms lead to, or
    the word. Words are distinct and not empty; null ones and rows with a null n
    go. An empty table gives none.
    """
    spark = words.sparkSession
    own, _ = store(_with_masks(words.where("word <> '' and n is not null").select("word", F.col("n").cast("long").alias("n"))), "words")
    bands = band_masks(own)
    rows, paths = _grouped(own, bands, most)
    near = _near(rows, bands, ratio).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form"))).alias("f"))
    joined = own.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("f.form").alias("form"), (-F.col("f.less")).alias("form_n"))
    named, _ = store(joined, "forms")
    remove(spark, *paths)
    roots = _roots(named.where("form is not null"))
    return named.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
