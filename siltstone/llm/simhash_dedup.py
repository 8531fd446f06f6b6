"""SimHash near-duplicate groups by pigeonhole blocks.

Fingerprints are cut into blocks; two that differ in at most ``radius`` bits
agree on at least ``blocks - radius`` blocks, so each is filed under every such
choice of blocks and only those filed together are compared. A bucket returns
a spanning star for each group it holds, never its pairs. Buckets of more than
``bucket_rows`` fingerprints are filed again under blocks of the bits that the
bucket leaves open, until they are small or under 20 bits are open.

Few pairs at a Jaccard similarity of 0.8 lie within so small a radius, and no
radius with few enough tables holds them all, so ``jaccard_words`` adds the
links of texts whose sets of word shingles are similar: MinHash bands name the
candidates, and their sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import connected_components, mix64, remove, small_batches, store
from ._prefixes import across, dealt, prefix_keys, shared_members, slot_counts, unsettled
from .line_dedup import TENTHS, set_keys, set_stars

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 6
BUCKET_ROWS = 4096
HASH_SEED = 42
JACCARD_WORDS = 5  # of near copies in the pipeline; the similarity is line_dedup's 0.8
SET_TEXTS = 2048


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, highest bit first."""
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 20):
        part = hashes[at : at + (1 << 20)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the text's word shingles; 0 if it has no word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    line, h = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = np.array([h(line, HASH_SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((h(line[a:b], HASH_SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)
    return int.from_bytes(np.packbits(2 * _bits(hashes) > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text_col: str = "text", jaccard_words: int | None = None) -> DataFrame:
    """(id, t, fp, keys) of docs(id, text): hash of the text, fingerprint as a signed long, and band keys of the word shingles if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            said = batch.column(2).to_pylist()
            found = np.array([fingerprint(x) for x in said], dtype=np.uint64)
            sizes, keys = np.zeros(len(said) + 1, np.int32), np.empty((0, 0), np.uint64)
            if jaccard_words:
                hashed, starts, which = word_sets(said, jaccard_words)
                keys = set_keys(hashed, starts)
                sizes[which + 1] = keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64)), lists], names=["id", "t", "fp", "keys"])

    rows = docs.select("id", F.xxhash64(F.col(text_col)).alias("t"), text_col)
    return rows.mapInArrow(run, T.StructType([docs.schema["id"], *(T.StructField(c, T.LongType()) for c in ("t", "fp")), T.StructField("keys", T.ArrayType(T.LongType()))]))


def _masks(used: int, radius: int, blocks: int) -> list[int]:
    """One mask for each choice of blocks - radius blocks of the bits not in used."""
    open_bits = np.array([b for b in range(64) if not used >> b & 1])
    cut = [sum(1 << int(b) for b in part) for part in np.array_split(open_bits, blocks)]
    return [sum(choice) for choice in combinations(cut, blocks - radius)]


def _filed(rows: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Rows (key, used, fp) filed under each choice of blocks among the open bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks: dict[int, list[int]] = {}
        for batch in batches:
            key, used, fp = (np.asarray(c).view(np.uint64) for c in batch.columns)
            for u in np.unique(used).tolist():
                own = used == u
                for i, mask in enumerate(masks.setdefault(u, _masks(u, radius, blocks))):
                    seed = mix64(key[own] + np.uint64(i + 1))
                    new = mix64(seed ^ (fp[own] & np.uint64(mask)))
                    both = np.full(len(new), u | mask, dtype=np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (new, both, fp[own])], names=["key", "used", "fp"])

    return rows.mapInArrow(run, "key long, used long, fp long")


def stars(fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Groups of the fingerprints linked within radius: one member, the others."""
    rest = fps
    while len(rest):
        first, rest = rest[0], rest[1:]
        todo, group = [first], []
        while todo and len(rest):
            near = np.bitwise_count(rest ^ todo.pop()) <= radius
            if near.any():
                group.append(rest[near])
                todo.extend(group[-1])
                rest = rest[~near]
        if group:
            yield first, np.concatenate(group)


def _linked(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) of spanning stars in each bucket; rows: (key, fp), sorted by key in each partition."""

    def edges(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        sizes = np.diff(cuts)
        at = cuts[:-1][sizes == 2]
        at = at[np.bitwise_count(fp[at] ^ fp[at + 1]) <= radius]
        us, vs = [fp[at]], [fp[at + 1]]
        for a, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            for first, others in stars(fp[a : a + n], radius):
                us.append(np.full(len(others), first, dtype=np.uint64))
                vs.append(others)
        return np.concatenate(us), np.concatenate(vs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
        for batch in batches:
            now = [np.asarray(c).view(np.uint64) for c in batch.columns]
            if not len(now[0]):
                continue
            key, fp = (np.concatenate(x) for x in zip(held, now, strict=True))
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            held = [key[last:], fp[last:]]
            if last:
                u, v = edges(key[:last], fp[:last])
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])
        if len(held[0]):
            u, v = edges(*held)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return rows.mapInArrow(run, "u long, v long")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (u, v) that connect all of the distinct fingerprints fps(fp) within radius."""
    spark = fps.sparkSession
    rows = fps.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("used"), "fp")
    found, drop = [], []
    while True:
        filed = _filed(rows, radius, blocks)
        sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        shared, path = store(filed.join(sizes, "key"), "filed")
        drop.append(path)
        final = F.lit(64) - F.bit_count("used") < 20
        small = shared.where((F.col("n") <= bucket_rows) | final).repartition("key").sortWithinPartitions("key")
        part, path = store(_linked(small.select("key", "fp"), radius), "edges")
        found.append(part)
        rows = shared.where((F.col("n") > bucket_rows) & ~final).select("key", "used", "fp")
        if rows.isEmpty():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    remove(spark, *drop)
    return out


def word_sets(texts: list[str | None], words: int = JACCARD_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, which): the hashed word shingles of the texts that have a word, where each one's begin, and their places.

    A text of fewer words than a shingle gives one.
    """
    said = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    sizes = np.fromiter(map(len, said), np.int64, len(said))
    which = np.flatnonzero(sizes)
    if not len(which):
        return np.empty(0, np.uint64), np.empty(0, np.int64), which
    h = xxhash.xxh64_intdigest
    padded = [said[i] + [b""] * (words - len(said[i])) for i in which.tolist()]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    each = np.fromiter((h(x, HASH_SEED) for tokens in padded for x in tokens), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    last = len(each) - words + 1
    hashed = each[:last]
    for k in range(1, words):
        hashed = mix64(hashed * np.uint64(0x9E3779B97F4A7C15) + each[k : k + last])
    inside = np.ones(len(each), bool)
    for k in range(1, words):
        inside[ends - k] = False
    return hashed[inside[:last]], ends - sizes - (words - 1) * np.arange(len(sizes)), which


def _similar(named: DataFrame) -> DataFrame:
    """Edges (u, v) between the fingerprints of similar texts; rows: (name, fp, hashes), sorted by name in each partition."""

    def links(fps: list[int], sets: list[bytes]) -> pa.RecordBatch:
        hashed = np.frombuffer(b"".join(sets), np.uint64)
        ends = np.cumsum([len(x) // 8 for x in sets])
        fp = np.array(fps, dtype=np.int64)
        at = np.array([*set_stars(hashed, np.concatenate(([0], ends[:-1])))], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(fp[at[:, i]]) for i in (0, 1)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fps, sets = None, [], []
        for batch in small_batches(batches):
            for name, fp, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    if len(sets) > 1:
                        yield links(fps, sets)
                    now, fps, sets = name, [], []
                fps.append(fp)
                sets.append(hashes)
        if len(sets) > 1:
            yield links(fps, sets)

    return named.mapInArrow(run, "u long, v long")


def jaccard_links(texts: DataFrame, rows: DataFrame, labels: DataFrame, words: int = JACCARD_WORDS, set_texts: int = SET_TEXTS) -> DataFrame:
    """Edges (u, v) of fingerprints that, with those behind labels(fp, label), connect all texts(text) of a Jaccard similarity of 0.8 or more.

    rows is with_fingerprint()'s table. Texts that share a band key are compared
    unless all of them have one label already. Texts of a key that over
    ``set_texts`` share are filed again under their rare shingles (``_prefixes``).
    """
    spark = texts.sparkSession
    texts = texts.select(F.xxhash64("text").alias("t"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            hashed, starts, which = word_sets(batch.column(2).to_pylist(), words)
            ends = np.append(starts[1:], len(hashed))
            sets = [np.unique(hashed[a:b]).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), batch.column(1).take(pa.array(which)), pa.array(sets, pa.binary())], names=["t", "fp", "hashes"])

    filed = rows.where(F.size("keys") > 0)
    each = filed.groupBy("t").agg(F.min("fp").alias("fp")).join(labels, "fp")  # copies count once
    own, own_at = store(each, "labelled")
    keys = filed.select("t", "keys").dropDuplicates(["t"]).select("t", F.explode("keys").alias("key")).join(own.select("t", "label"), "t")
    keys, keys_at = store(keys, "keys")
    total = F.sum(F.xxhash64("t").cast("decimal(38,0)"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"), total.alias("s")).where("a <> b")
    shared = shared.select("key", "n", F.xxhash64("s", "n").alias("name"))
    met = keys.join(shared, "key").select(F.col("t").alias("node"), "n", "name").distinct()
    met, met_at = store(met, "sets")
    remove(spark, keys_at)
    asked = met.select(F.col("node").alias("t")).distinct().join(own.select("t", "fp"), "t")
    found = texts.join(asked, "t").select("t", "fp", "text").dropDuplicates(["t"]).mapInArrow(cut, "t long, fp long, hashes binary")
    found, found_at = store(found.withColumnRenamed("t", "node"), "word-sets")
    drop = [own_at, met_at, found_at]

    def similar(sets: DataFrame) -> DataFrame:
        rows = sets.join(found, "node").select("name", "fp", "hashes").repartition("name").sortWithinPartitions("name")
        return store(_similar(rows), "edges")[0]

    sets, hot = met.where(F.col("n") <= set_texts).select("name", "node"), met.where(F.col("n") > set_texts)
    if hot.isEmpty():
        links = similar(sets)
    else:
        large = hot.join(found, "node").select("name", "node", "hashes")
        members, members_at = store(shared_members(prefix_keys(large, slot_counts(found), TENTHS)), "members")
        many = members.where(F.col("n") > set_texts)
        few = members.where(F.col("n") <= set_texts).select("name", "node")
        links = similar(sets.unionByName(few).unionByName(dealt(many, set_texts)))
        linked = connected_components(links.unionByName(labels.select(F.col("fp").alias("u"), F.col("label").alias("v")).where("u <> v")))
        of_text = found.select("node", "fp").join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("node", F.coalesce("label", "fp").alias("label"))
        rest, rest_at = store(across(unsettled(many, of_text), set_texts), "across")
        drop += [members_at, rest_at]
        if not rest.isEmpty():
            links = links.unionByName(similar(rest))
    remove(spark, *drop)
    return links


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, blocks: int = BLOCKS, bucket_rows: int = BUCKET_ROWS,
    jaccard_words: int | None = None, set_texts: int = SET_TEXTS,
) -> DataFrame:
    """One row per row of docs: id, t (XXH64 of the text), fp (signed long), fingerprint (hex), component_id, label.

    component_id is the least id among the documents reachable over links of at
    most ``radius`` differing bits, the document itself included; with
    ``jaccard_words``, links of 0.8 or more in Jaccard similarity over shingles
    of so many words count as well. Null and empty
    texts, and texts without a word, have fingerprint 0, which links like any
    other. A null id never names a component: a group without any other id has
    a null component_id. label, a fingerprint of the component, names it also
    then. Repeated rows give repeated results; an empty table
    gives none. Columns other than the two named are ignored.
    """
    rows, _ = store(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", jaccard_words), "fingerprints")
    least, _ = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    links = fingerprint_links(least.select("fp"), radius, blocks, bucket_rows)

    def labelled(labels: DataFrame) -> DataFrame:
        return least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    named = labelled(connected_components(links))
    if jaccard_words:
        similar = jaccard_links(docs.select(F.col(text_col).alias("text")), rows, named.select("fp", "label"), jaccard_words, set_texts)
        named = labelled(connected_components(links.unionByName(similar)))
    component = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = named.join(component, "label").select("fp", "label", "component_id")
    return rows.join(found, "fp").select(F.col("id").alias(id_col), "t", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "label")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without near copies: of each group the row with the least id, and of those the least fingerprint, stays.

    Rows without an id stay only if no other row of their group has one; of rows
    that agree in id and text one stays. Null texts group with empty ones.
    """
    groups = simhash_groups(docs, id_col, text_col, **options)
    order = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), "fp", "t")
    chosen = groups.groupBy("label").agg(F.min(order).alias("least")).select(F.col("least.id").alias("least_id"), F.col("least.t").alias("least_t"))
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))
    kept = own.join(chosen, (F.col("t") == F.col("least_t")) & F.col("id").eqNullSafe(F.col("least_id")), "left_semi")
    return kept.dropDuplicates(["id", "t"]).select("row.*")
