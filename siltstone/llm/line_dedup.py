"""Fuzzy line deduplication: MinHash signatures, banding, exact Jaccard, union-find.

Lines are compared as sets of 8-character shingles; two with a Jaccard
similarity of 0.8 or more are linked, and of each connected component the line
that comes first (least document id, then position) stays in place. 12 bands of
4 rows find a pair at 0.8 with probability 0.998, one at 0.85 with 0.9999.

1. Copies of whole texts are settled by digest; the others form packs.
2. Each distinct line of a pack is filed under its band keys. A task sees keys,
   line hashes and line numbers only. It names the sets of different lines that
   share a key, a set that several bands find by one name, and the copies of a
   line in other packs.
3. Packs send the lines named; within a set spanning stars of verified links
   are found, never all pairs.
4. Components come from union-find in each partition and rounds that merge its
   forests.
5. Packs get the place where a shared line stays, and rewrite their texts.

A key that more than ``set_lines`` different lines share is dealt into chunks,
each line into one, and the chunks' first lines form a set of their own, level
by level. Near variants of one line, the usual cause, are one component then.
Where a key's lines are still in different components, they are filed again
under their rare shingles (``_prefixes``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, mix64, partitions, remove, small_batches, store
from ._prefixes import across, dealt, prefix_keys, prefix_lengths, shared_members, slot_counts, unsettled
from .suffix_dedup import NO_ID, PACK_BYTES, _opened, _packed, _split

SHINGLE = 8  # a power of two
BANDS, ROWS = 12, 4
TENTHS = 8  # similarity of 0.8 or more
SET_LINES = 4096
BUCKET_BYTES = 32 << 20
FILED_ROWS = 1 << 20  # rows that a task holds before it sends them
BLOCK = 1 << 16  # hashes worked on at a time, so that they stay in the processor's cache
LINE_BITS = 31  # of a line's number: its pack's number, then its own in the pack
FIRST_BAND = np.uint64(1 << 63)
SPACE = " \t\n\x0b\x0c\r"

#: An odd multiplier for each hash function.
_ODD = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).astype(np.uint32) | np.uint32(1)


def mix32(x: np.ndarray) -> np.ndarray:
    """Scrambles unsigned 32-bit integers in place, one to one."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def _blocks(lines: list[str], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of lines of about size characters."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1)
    first = 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield first, last
        first = last


def shingle_hashes(lines: list[str], kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts): the hashed shingles of all lines, and where each line's begin. kind: uint64 or uint32.

    A line shorter than a shingle is padded and gives one.
    """
    padded = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    one = (mix32 if kind is np.uint32 else mix64)(code.astype(kind) + kind(1))
    width = 1
    while width < SHINGLE:
        one = one[:-width] * kind(pow(0x9E3779B97F4A7C15, width, 1 << 64) & np.iinfo(kind).max) + one[width:]
        width *= 2
    inside = np.ones(len(code), bool)
    ends = np.cumsum(sizes)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    hashed = one[inside[: len(one)]]
    return (mix32 if kind is np.uint32 else mix64)(hashed), ends - sizes - (SHINGLE - 1) * np.arange(len(sizes))


def band_keys(lines: list[str]) -> np.ndarray:
    """BANDS keys for each line, from BANDS * ROWS minima under as many hash functions."""
    keys = [set_keys(*shingle_hashes(lines[a:b], np.uint32)) for a, b in _blocks(lines)]
    return np.concatenate(keys) if keys else np.empty((0, BANDS), np.uint64)


def set_keys(hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys for each set of hashes; starts: where each set begins, none empty."""
    keys = np.empty((len(starts), BANDS), np.uint64)
    ends = np.append(starts[1:], len(hashed))
    low = hashed.astype(np.uint32, copy=False)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BLOCK, side="right")))
        part, at = low[starts[first] : ends[last - 1]], starts[first:last] - starts[first]
        turned, least = np.empty_like(part), np.empty((BANDS * ROWS, last - first), np.uint32)
        for odd, row in zip(_ODD, least, strict=True):
            np.multiply(part, odd, out=turned)
            np.minimum.reduceat(turned, at, out=row)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], last - first, axis=1)
        for r in range(ROWS):
            key = mix64(key * np.uint64(31) + least[r::ROWS])
        keys[first:last] = key.T
        first = last
    return keys


def _lines_of(pack: dict) -> tuple[list[list[str]], dict[str, tuple[int, int]]]:
    """A pack's documents as lines, and the first place (document order, position) of each distinct line that is not blank."""
    data, _ = _opened(pack["blob"], pack["sizes"])
    ends = np.cumsum(pack["sizes"]).tolist()
    raw = data.tobytes()
    docs = [raw[b - n : b].decode("utf-8", "surrogatepass").split("\n") for b, n in zip(ends, pack["sizes"], strict=True)]
    first: dict[str, tuple[int, int]] = {}
    for d in sorted(range(len(docs)), key=pack["ids"].__getitem__):
        order = pack["ids"][d]
        for at, line in enumerate(docs[d]):
            if line not in first and line.strip(SPACE):
                first[line] = (order, at)
    return docs, first


def _filed(packs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, rows): band key, line number and line hash of each distinct line of a pack, for each band; first bands are marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            key, node, said = (np.concatenate(x) for x in zip(*held, strict=True))
            out = [(b, key[at].tobytes() + node[at].tobytes() + said[at].tobytes()) for b, at in _split(key % np.uint64(buckets))]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "rows"])

        for batch in batches:
            for pack in batch.to_pylist():
                lines = list(_lines_of(pack)[1])
                if not lines:
                    continue
                keys = band_keys(lines) & ~FIRST_BAND
                keys[:, 0] |= FIRST_BAND
                node = np.uint64(pack["pack"] << LINE_BITS) + np.arange(len(lines), dtype=np.uint64)
                said = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
                held.append((keys.ravel(), np.repeat(node, BANDS), np.repeat(said, BANDS)))
                n += keys.size
                if n >= FILED_ROWS:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    return packs.select("pack", "ids", "sizes", "blob").mapInArrow(run, "bucket long, rows binary")


def _repeated(key: np.ndarray) -> np.ndarray:
    """Marks at least all of the keys that occur twice or more, few others."""
    bits = np.uint64(max(1, len(key).bit_length()))
    slot = (key << np.uint64(1) >> (np.uint64(64) - bits)).astype(np.int64)
    return np.bincount(slot, minlength=1)[slot] > 1


def _dealt(name: np.uint64, nodes: np.ndarray, spread: np.ndarray, set_lines: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, nodes): the nodes in chunks, each in one; of each chunk the first again, until these fit in one set."""
    while len(nodes) > set_lines:
        chunk = spread % np.uint64(-(-len(nodes) // set_lines))
        name = mix64(np.array([name]) + np.uint64(1))[0]
        yield mix64(name + chunk + np.uint64(1)), nodes
        first = np.unique(chunk, return_index=True)[1]
        nodes, spread = nodes[first], mix64(spread[first])
    yield np.full(len(nodes), name), nodes


def _sets(filed: DataFrame, set_lines: int) -> DataFrame:
    """(kind, name, node, other): what shares a band key.

    kind 0: the node, a line by its first pack, belongs to the set. 1: the node
    is a copy of the line other. 2: the node belongs to the key's lines, which
    are other in number, too many for a set.
    """

    def run(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in table["rows"].to_pylist()]
        key, node, said = (np.concatenate([r[i] for r in raw]) for i in range(3))
        again = _repeated(key)
        key, node, said = key[again], node[again], said[again]
        order = np.lexsort((node, said, key))
        key, node, said = key[order], node[order], said[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (said[1:] != said[:-1])  # a line once for each key
        first = node[new][np.cumsum(new) - 1] if len(node) else node
        copied = np.zeros(len(key), bool)
        copied[:-1] = ~new[1:]
        copied = (copied | ~new) & (key >= FIRST_BAND)
        parts = [(np.full(int(copied.sum()), 1), np.zeros(int(copied.sum()), np.uint64), node[copied], first[copied])]
        key, node = key[new], node[new]
        cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.append(cuts, len(key)))
        spread = mix64(node)
        names = mix64(np.add.reduceat(spread, cuts) + sizes.astype(np.uint64)) if len(cuts) else spread
        name, size = np.repeat(names, sizes), np.repeat(sizes, sizes)
        few = (size > 1) & (size <= set_lines)
        parts.append((np.zeros(int(few.sum()), int), name[few], node[few], node[few]))
        for g in np.flatnonzero(sizes > set_lines):
            own = slice(cuts[g], cuts[g] + sizes[g])
            for called, members in _dealt(names[g], node[own], spread[own], set_lines):
                parts.append((np.zeros(len(members), int), called, members, members))
            parts.append((np.full(sizes[g], 2), name[own], node[own], np.full(sizes[g], sizes[g], np.uint64)))
        kind, name, node, other = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.table({"kind": pa.array(kind, pa.int32()), "name": name.view(np.int64), "node": node.astype(np.int64), "other": other.astype(np.int64)})

    return filed.groupBy("bucket").applyInArrow(run, "kind int, name long, node long, other long")


def _named_lines(packs: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, node, other, line, doc, at) of asked(kind, name, node, other): the first place of each, and the lines of sets."""
    schema = "name long, node long, other long, line string, doc long, at long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["name", "node", "other", "line", "doc", "at"]

    def run(pack: pa.Table, asked: pa.Table) -> pa.Table:
        if not (pack.num_rows and asked.num_rows):
            return pa.table([pa.array([], k) for k in kinds], names=names)
        rows = np.unique(np.stack([asked[c].to_numpy() for c in ("kind", "name", "node", "other")], axis=1), axis=0)  # a set that several bands found
        first = _lines_of(pack.to_pylist()[0])[1]
        at = rows[:, 2] & ((1 << LINE_BITS) - 1)
        lines = pa.array(list(first), pa.string()).take(pa.array(at, mask=rows[:, 0] != 0))
        place = np.array(list(first.values()), np.int64)[at]
        return pa.table([pa.array(rows[:, 1]), pa.array(rows[:, 2]), pa.array(rows[:, 3]), lines, pa.array(place[:, 0]), pa.array(place[:, 1])], names=names)

    asked = asked.withColumn("pack", F.shiftright("node", LINE_BITS))
    return packs.select("pack", "ids", "sizes", "blob").groupBy("pack").cogroup(asked.groupBy("pack")).applyInArrow(run, schema)


def similar_stars(lines: list[str], tenths: int = TENTHS) -> Iterator[tuple[int, int]]:
    """Links (a, b) that connect all of the distinct lines whose similarity is tenths / 10 or more."""
    return set_stars(*shingle_hashes(lines), tenths)


def set_stars(hashed: np.ndarray, starts: np.ndarray, tenths: int = TENTHS) -> Iterator[tuple[int, int]]:
    """Links (a, b) that connect all of the sets of hashes whose similarity is tenths / 10 or more.

    Sets are compared with those only that share an early member in order of
    rarity (``_prefixes``), which similar ones do: sets that have a frequent
    passage in common and little else are not compared two by two.
    """
    number, times = np.unique(hashed, return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(times), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(times))  # rare members first
    sizes = np.diff(np.append(starts, len(number)))
    pairs = np.unique(np.repeat(np.arange(len(starts)), sizes) * len(times) + rank[number])
    owner, number = np.divmod(pairs, len(times))
    cuts = np.searchsorted(owner, np.arange(len(starts) + 1))
    sizes = np.diff(cuts)
    few, more = prefix_lengths(sizes, tenths)
    place = np.arange(len(number)) - np.repeat(cuts[:-1], sizes)
    early = np.flatnonzero(place < more[owner])
    early = early[np.argsort(number[early], kind="stable")]
    mark = np.zeros(len(times), bool)
    alive = np.ones(len(starts), bool)
    left = indexed = len(starts)
    at = np.searchsorted(number[early], np.arange(len(times) + 1))
    for first in range(len(starts)):
        if not alive[first]:
            continue
        alive[first] = False
        left -= 1
        todo = [first]
        while todo and left:
            x = todo.pop()
            if 2 * left < indexed:  # sets that have their component are left out
                early, indexed = early[alive[owner[early]]], left
                at = np.searchsorted(number[early], np.arange(len(times) + 1))
            own = number[cuts[x] : cuts[x + 1]]
            asked = own[: more[x]]
            found = early[_spread(at[asked], at[asked + 1])]
            near_x = np.repeat(np.arange(len(asked)) < few[x], at[asked + 1] - at[asked])
            some = owner[found[near_x | (place[found] < few[owner[found]])]]
            some = np.unique(some[alive[some]])
            some = some[10 * np.minimum(sizes[some], sizes[x]) >= tenths * np.maximum(sizes[some], sizes[x])]
            if not len(some):
                continue
            mark[own] = True
            both = np.add.reduceat(mark[number[_spread(cuts[some], cuts[some + 1])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            mark[own] = False
            near = some[10 * both >= tenths * (sizes[some] + sizes[x] - both)]
            alive[near] = False
            left -= len(near)
            for i in near.tolist():
                yield first, i
                todo.append(i)


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first, first + 1, ... up to but not including last, of each."""
    size = last - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def similar_pairs(lines: list[str], tenths: int = TENTHS) -> np.ndarray:
    """For each of the pairs lines[0], lines[1]; lines[2], lines[3]; ... whether they are similar."""
    found = [_similar_block(lines[2 * a : 2 * b], tenths) for a, b in _blocks([x + y for x, y in zip(lines[::2], lines[1::2], strict=True)], BLOCK // 2)]
    return np.concatenate(found) if found else np.empty(0, bool)


def _similar_block(lines: list[str], tenths: int) -> np.ndarray:
    hashed, starts = shingle_hashes(lines)
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(np.append(starts, len(hashed))))
    # pair, hash and side in one integer: one sort puts what both sides share next to each other
    bits = np.uint64(max(1, (len(lines) // 2).bit_length()))
    key = np.sort((owner >> np.uint64(1)) << (np.uint64(64) - bits) | (hashed >> (bits + np.uint64(1))) << np.uint64(1) | (owner & np.uint64(1)))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    pair = (key >> (np.uint64(64) - bits)).astype(np.int64)
    both = np.bincount(pair[1:][(key[1:] ^ key[:-1]) == 1], minlength=len(lines) // 2)
    return 10 * both >= tenths * (np.bincount(pair, minlength=len(lines) // 2) - both)


def _links(named: DataFrame) -> DataFrame:
    """(u, v): numbers of linked lines, spanning each set's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[str] = []
        ends: list[tuple[int, int]] = []
        out: list[tuple[int, int]] = []
        size = 0

        def settle() -> None:
            nonlocal size
            if pairs:
                out.extend(ends[i] for i in np.flatnonzero(similar_pairs(pairs)).tolist())
                pairs.clear()
                ends.clear()
                size = 0

        def add(nodes: list[int], lines: list[str]) -> None:
            nonlocal size
            if len(lines) == 2:  # most sets
                pairs.extend(lines)
                ends.append((nodes[0], nodes[1]))
                size += len(lines[0]) + len(lines[1])
                if size > 1 << 20:
                    settle()
            elif len(lines) > 2:
                out.extend((nodes[a], nodes[b]) for a, b in similar_stars(lines))

        def rows() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["u", "v"])
            out.clear()
            return found

        now, nodes, lines = None, [], []
        for batch in batches:
            for name, node, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:
                    add(nodes, lines)
                    now, nodes, lines = name, [], []
                nodes.append(node)
                lines.append(line)
            if out:
                yield rows()
        add(nodes, lines)
        settle()
        if out:
            yield rows()

    rows = named.where("line is not null").select("name", "node", "line")
    return rows.repartition("name").sortWithinPartitions("name").mapInArrow(run, "u long, v long")


def _hashed(named: DataFrame) -> DataFrame:
    """(name, node, hashes) of named(name, node, line): the distinct hashed shingles of each line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                hashed, starts = shingle_hashes(batch.column(2).to_pylist())
                sets = [np.unique(x).tobytes() for x in np.split(hashed, starts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["name", "node", "hashes"])

    return named.select("name", "node", "line").mapInArrow(run, "name long, node long, hashes binary")


def _sets_of(rows: DataFrame) -> DataFrame:
    """rows(name, node) as sets."""
    return rows.select(F.lit(0).alias("kind"), "name", "node", F.col("node").alias("other"))


def _large_keys(packs: DataFrame, hot: DataFrame, edges: DataFrame, labels: DataFrame, set_lines: int) -> tuple[DataFrame, list[str]]:
    """labels with the links inside hot(name, node), the lines of keys that more than ``set_lines`` share, and the tables that were written."""
    drop: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        table, path = store(df, name)
        drop.append(path)
        return table

    hot = kept(unsettled(hot, labels), "hot")
    if hot.isEmpty():
        return labels, drop
    lines = kept(_hashed(_named_lines(packs, _sets_of(hot))), "shingles")
    shared = kept(shared_members(prefix_keys(lines, slot_counts(lines), TENTHS)), "members")
    many = shared.where(F.col("n") > set_lines)
    sets = shared.where(F.col("n") <= set_lines).select("name", "node").unionByName(dealt(many, set_lines))
    edges = edges.unionByName(kept(_links(kept(_named_lines(packs, _sets_of(sets)), "named")), "links"))
    labels = connected_components(edges)
    rest = kept(across(unsettled(many, labels), set_lines), "across")
    if not rest.isEmpty():
        labels = connected_components(edges.unionByName(kept(_links(kept(_named_lines(packs, _sets_of(rest)), "named")), "links")))
    return labels, drop


def _rewritten(packs: DataFrame, stays: DataFrame, with_text: bool) -> DataFrame:
    """(digest, n_lines, n_removed, kept, blank) of each text; stays: (node, doc, at), the place where a line that is shared stays."""

    def run(pack: pa.Table, found: pa.Table) -> pa.Table:
        if not pack.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        own = pack.to_pylist()[0]
        docs, place = _lines_of(own)
        lines = list(place)
        for node, doc, at in zip(*(found[c].to_pylist() for c in ("node", "doc", "at")), strict=True):
            place[lines[node & ((1 << LINE_BITS) - 1)]] = (doc, at)
        out = []
        for order, digest, said in zip(own["ids"], own["digests"], docs, strict=True):
            kept = [x for at, x in enumerate(said) if place.get(x, (order, at)) == (order, at)]
            blank = [x for x in said if not x.strip(SPACE)]
            left = ["\n".join(x) for x in (kept, blank)]
            if not with_text:
                left = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in left]
            out.append((digest, len(said) - len(blank), len(said) - len(kept), *left))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["digest", "n_lines", "n_removed", "kept", "blank"]
    stays = stays.withColumn("pack", F.shiftright("node", LINE_BITS))
    packs = packs.select("pack", "ids", "digests", "sizes", "blob")
    return packs.groupBy("pack").cogroup(stays.groupBy("pack")).applyInArrow(run, "digest string, n_lines long, n_removed long, kept string, blank string")


def _staying(packs: DataFrame, set_lines: int) -> DataFrame:
    """(node, doc, at): for each line that others equal or resemble, the place where its component stays."""
    spark = packs.sparkSession
    breaks = packs.agg(F.sum(F.col("breaks") + F.size("sizes")).alias("n")).first().n or 0
    buckets = max(partitions(spark), -(-breaks * BANDS * 24 // BUCKET_BYTES))
    sets, sets_at = store(_sets(_filed(packs, buckets), set_lines), "sets")
    remove(spark)
    named, named_at = store(_named_lines(packs, sets.where("kind < 2")), "named")
    links, links_at = store(_links(named), "links")
    remove(spark)
    copies = named.where("line is null and node <> other").select(F.col("node").alias("u"), F.col("other").alias("v"))
    edges = links.unionByName(copies)
    labels = connected_components(edges)
    drop = [sets_at, named_at, links_at]
    labels, more = _large_keys(packs, sets.where("kind = 2").select("name", "node"), edges, labels, set_lines)
    drop += more
    # the least (doc, at) as one number, which an aggregation can hold in place
    place = F.col("doc").cast("decimal(38,0)") * (1 << 31) + F.col("at")
    first = named.select("node", "doc", "at").join(labels, "node").groupBy("label").agg(F.min(place).alias("first"))
    first = first.withColumn("at", F.expr(f"cast(pmod(first, {1 << 31}) as long)")).select("label", F.expr(f"(first - at) div {1 << 31}").alias("doc"), "at")
    stays, _ = store(labels.join(first, "label").select("node", "doc", "at"), "stays")
    remove(spark, *drop)
    return stays


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, pack_bytes: int = PACK_BYTES, set_lines: int = SET_LINES, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, digest, n_lines, n_removed, kept (the text that is left; its SHA-256 if not with_text).

    Lines are what stands between line feeds; blank ones are never compared and
    stay. Of linked or equal lines the one in the document with the least id,
    and there the first, stays. Null ids come after all others and count as one
    document; null texts count as empty. Repeated rows give repeated results; an
    empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.sha2("text", 256).alias("digest"), F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("order"))
    light, _ = store(rows.select("id", "digest", "order"), "texts")
    least = light.groupBy("digest").agg(F.min("order").alias("order"))
    texts = rows.join(least.hint("merge"), ["digest", "order"], "left_semi").select("order", "digest", "text")
    packs, packs_at = store(_packed(texts, pack_bytes), "packs")
    remove(spark)
    stays = _staying(packs, set_lines)
    done, _ = store(_rewritten(packs, stays, with_text), "kept")
    remove(spark, packs_at)
    if done.count() > least.count():  # a table with repeated rows whose copies were packed apart
        done = done.dropDuplicates(["digest"])
    named = light.join(least.withColumnRenamed("order", "least"), "digest").join(done, "digest")
    copy = F.col("order") > F.col("least")
    return named.select(
        F.col("id").alias(id_col), "digest", "n_lines", F.when(copy, F.col("n_lines")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(copy, F.col("blank")).otherwise(F.col("kept")).alias("kept")
    )


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_lines, n_removed and kept_sha256 of what dedup_lines() leaves."""
    return dedup_lines(docs, id_col, text_col, with_text=False, **options).select(id_col, "n_lines", "n_removed", F.col("kept").alias("kept_sha256"))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """docs with the lines that are left; documents that lose all of their lines go. Of equal rows one stays.

    ``length_col``, if docs has it, gets the new length in characters.
    """
    left = dedup_lines(docs, id_col, text_col, **options).where("n_lines = 0 or n_removed < n_lines").dropDuplicates([id_col, "digest"])
    left = left.select(F.col(id_col).alias("left_id"), F.col("digest").alias("left_digest"), "kept")
    others = [c for c in docs.columns if c != text_col]
    own = docs.select(F.struct(*others).alias("row"), F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("digest"))
    joined = own.dropDuplicates(["id", "digest"]).join(left, F.col("id").eqNullSafe(F.col("left_id")) & (F.col("digest") == F.col("left_digest")))
    new = {text_col: F.col("kept")}
    if length_col in others:
        new[length_col] = F.length("kept").cast(docs.schema[length_col].dataType)
    return joined.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
