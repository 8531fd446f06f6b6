"""Exact removal of repeated byte passages with sparse suffix arrays.

Every 50-byte string holds an anchor: the position of its least 20-byte hash.
Equal strings have equal anchors at equal places, so only suffixes at anchors
whose hash occurs again need sorting, and those with one key meet in one task.

1. Copies of a whole text are settled by digest; one text of each goes on, and
   texts are gathered into packs of bounded size.
2. Packs send the distinct keys of their anchors (40 bits of the hash, rising);
   a mark for each comes back: seen once, again, or very often.
3. Packs send the suffixes at those anchors with the bytes to their left, each
   different one once, with the places that have it.
4. Suffixes of one key whose contexts are all equal need no order; a
   vectorised grouping tells these from the others. The others are ordered by
   multikey quicksort to a shallow depth below what they share, and blind tries
   order the runs that still agree there; both give the common prefix lengths. A
   string belongs to the smallest document in the run that shares its bytes.
5. Packs delete what was found and report.

An anchor with more than ``hot`` occurrences would gather a large group. Packs
send its 50-byte strings instead, each distinct one once, dealt by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix64, partitions, remove, store

LENGTH, GRAM = 50, 20
WINDOWS = LENGTH - GRAM + 1
SHALLOW_BYTES = 24
PACK_BYTES = 4 << 20
BUCKET_BYTES = 64 << 20
HOT = 4096
CONTEXT = LENGTH + WINDOWS - 1
NO_ID = (1 << 63) - 1
STARTS = 1 << 16
KEY_BITS = 40  # of an anchor's hash: enough to tell most apart; contexts are compared byte by byte
PACK_BITS = 10  # of a pack's number: at most 1024 packs a task, 2^22 tasks

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each position, by doubling."""
    power = [np.uint64(pow(int(_BASE), 2**i, 1 << 64)) for i in range(4)]
    one = _letters()[data]
    two = one[:-1] * power[0] + one[1:]
    four = two[:-2] * power[1] + two[2:]
    eight = four[:-4] * power[2] + four[4:]
    sixteen = eight[:-8] * power[3] + eight[8:]
    n = len(data) - GRAM + 1
    return mix64(sixteen[:n] * power[2] + four[16 : 16 + n])


def _anchor_runs(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h = gram_hashes(data)
    value, at, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < WINDOWS:
        step = min(width, WINDOWS - width)
        right = value[step:] < value[:-step]  # the leftmost of equals
        value = np.where(right, value[step:], value[:-step])
        at = np.where(right, at[step:], at[:-step])
        width += step
    inside = owner[: len(at)] == owner[LENGTH - 1 :]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]))))
    last = np.concatenate((cut[1:], [len(at)])) - 1
    real = inside[cut]
    first, last = cut[real], last[real]
    anchor = at[first].astype(np.int64)
    return first, last, anchor, h[anchor]


def anchor_runs(data: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash): runs of string starts first..last with one anchor, inside a document.

    STARTS starts are looked at together, so that the hashes of all places are never held at once.
    """
    parts = [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)]
    for a in range(0, len(data) - LENGTH + 1, STARTS):
        piece = slice(a, a + STARTS + LENGTH - 1)
        first, last, anchor, h = _anchor_runs(data[piece], owner[piece])
        parts.append((first + a, last + a, anchor + a, h))
    first, last, anchor, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    goes_on = (first[1:] == last[:-1] + 1) & (anchor[1:] == anchor[:-1])  # cut between two pieces
    begins, ends = np.concatenate(([True], ~goes_on))[: len(first)], np.concatenate((~goes_on, [True]))[: len(first)]
    return first[begins], last[ends], anchor[begins], h[begins]


def shared_bytes(a: bytes, b: bytes) -> int:
    """How many bytes a and b have in common at their start."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def multikey_quicksort(strings: list[bytes], depth: int, limit: int) -> Iterator[list[int]]:
    """Distinct strings that agree in their first ``depth`` bytes, in order: runs of those that agree up to ``limit``."""
    stack = [(list(range(len(strings))), depth)]
    while stack:
        own, at = stack.pop()
        if len(own) == 1 or at == limit:
            yield own
            continue
        letters = [strings[i][at] if at < len(strings[i]) else -1 for i in own]
        pivot = sorted((letters[0], letters[len(own) // 2], letters[-1]))[1]
        parts = [[i for i, x in zip(own, letters, strict=True) if x > pivot], [i for i, x in zip(own, letters, strict=True) if x == pivot], [i for i, x in zip(own, letters, strict=True) if x < pivot]]
        stack.extend((part, at + k) for part, k in zip(parts, (0, 1, 0), strict=True) if part)


class BlindTrie:
    """Orders distinct byte strings; inner nodes keep only the depth at which their children part."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.root: list | int = 0
        for i in range(1, len(strings)):
            self._insert(i)

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        node = self.root
        while not isinstance(node, int):
            children = node[1]
            node = children.get(self._byte(i, node[0]))
            if node is None:
                node = next(iter(children.values()))
        same = shared_bytes(self.strings[i], self.strings[node])
        mine, other = self._byte(i, same), self._byte(node, same)
        parent, node = None, self.root
        while not isinstance(node, int) and node[0] < same:
            parent, node = node, node[1][self._byte(i, node[0])]
        if not isinstance(node, int) and node[0] == same:
            node[1][mine] = i
            return
        new = [same, {mine: i, other: node}]
        if parent is None:
            self.root = new
        else:
            parent[1][self._byte(i, parent[0])] = new

    def ordered(self) -> Iterator[tuple[int, int]]:
        """(string, bytes it shares with the one before) in order."""
        stack, shared = [(self.root, 0)], 0
        while stack:
            node, shared = stack.pop()
            if isinstance(node, int):
                yield node, shared
                continue
            children = sorted(node[1].items(), reverse=True)
            stack.extend((child, node[0]) for _, child in children[:-1])
            stack.append((children[-1][1], shared))


def deep_shallow(strings: list[bytes]) -> Iterator[tuple[int, int]]:
    """(string, bytes it shares with the one before) of distinct strings, in order.

    Multikey quicksort goes SHALLOW_BYTES below what all of them share; the runs
    that still agree there, and only these, go through blind tries.
    """
    depth, before = shared_bytes(min(strings), max(strings)) if len(strings) > 1 else 0, None
    for run in multikey_quicksort(strings, depth, depth + SHALLOW_BYTES):
        order = BlindTrie([strings[i] for i in run]).ordered() if len(run) > 1 else ((0, 0),)
        for n, (k, shared) in enumerate(order):
            yield run[k], shared if n or before is None else shared_bytes(strings[before], strings[run[k]])
            before = run[k]


def group_bounds(contexts: list[bytes], lead: list[int], count: list[int], ids: list[int]) -> list[list[int]]:
    """For each context and each of its strings, the smallest document that holds the string.

    A context has ``count`` strings, the first at 0, and its anchor at ``lead``.
    All anchors have one key; ids are the smallest documents of the contexts.
    """
    suffixes = [c[at:] for c, at in zip(contexts, lead, strict=True)]
    distinct = sorted(set(suffixes), key=len)
    number = {s: i for i, s in enumerate(distinct)}
    members: list[list[int]] = [[] for _ in distinct]
    for i, s in enumerate(suffixes):
        members[number[s]].append(i)
    order = list(deep_shallow(distinct))
    bounds = [[0] * n for n in count]
    for before in range(WINDOWS):  # strings that begin so many bytes before their anchor
        after, run = LENGTH - before, {}
        held: list[tuple[int, int, bytes]] = []
        for s, shared in order:
            if shared < after and held:
                for i, t, left in held:
                    bounds[i][t] = run[left]
                run, held = {}, []
            for i in members[s]:
                t = lead[i] - before
                if 0 <= t < count[i]:
                    left = contexts[i][t : lead[i]]
                    held.append((i, t, left))
                    if ids[i] < run.get(left, NO_ID + 1):
                        run[left] = ids[i]
        for i, t, left in held:
            bounds[i][t] = run[left]
    return bounds


PACK = "pack long, ids array<long>, digests array<string>, sizes array<long>, breaks long, blob binary"


def _pack_rows(task: int, texts: Iterable[tuple[int, str, bytes]], pack_bytes: int, level: int = 1) -> Iterator[pa.RecordBatch]:
    """PACK rows of texts (id, digest, text); task is part of their numbers."""
    n, ids, digests, parts, size = 0, [], [], [], 0

    def row() -> pa.RecordBatch:
        blob = zstandard.ZstdCompressor(level).compress(b"".join(parts))
        if task >> 32 - PACK_BITS or n >> PACK_BITS:
            raise OverflowError("too many packs: raise pack_bytes")
        columns = [[task << PACK_BITS | n], [ids], [digests], [[len(p) for p in parts]], [sum(p.count(b"\n") for p in parts)], [blob]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["pack", "ids", "digests", "sizes", "breaks", "blob"])

    for i, d, raw in texts:
        if parts and size + len(raw) > pack_bytes:
            yield row()
            ids, digests, parts, size, n = [], [], [], 0, n + 1
        ids.append(i)
        digests.append(d)
        parts.append(raw)
        size += len(raw)
    if parts:
        yield row()


def _packed(texts: DataFrame, pack_bytes: int) -> DataFrame:
    """Texts (id, digest, text), sorted by digest in each partition, as packs (pack, ids, digests, sizes, breaks, blob).

    pack is below 2^32; breaks is the number of line feeds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def distinct() -> Iterator[tuple[int, str, bytes]]:
            before = None
            for batch in batches:
                for i, d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    if d != before:  # repeated rows follow each other
                        before = d
                        yield i, d, text.as_buffer().to_pybytes()

        yield from _pack_rows(TaskContext.get().partitionId(), distinct(), pack_bytes)

    return texts.mapInArrow(run, PACK)


def _packed_by_digest(texts: DataFrame, pack_bytes: int, buckets: int) -> DataFrame:
    """Packs of one text of each digest, that of the smallest id, of rows (id, digest, text). Texts move compressed, each different one of an Arrow batch once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, tuple[int, int]] = {}
            for at, (i, d) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own[d] = min((i, at), own.get(d, (i, at)))
            names = sorted(own)  # by their first digits, as buckets are
            bucket = [int(d[:12], 16) * buckets >> 48 for d in names]
            for b, at in _split(np.array(bucket)):
                part = names[at[0] : at[-1] + 1]
                raw = [batch.column(2)[own[d][1]].as_buffer() for d in part]
                blob = zstandard.ZstdCompressor(3).compress(b"".join(raw))
                columns = [[b], [[own[d][0] for d in part]], [part], [[len(x) for x in raw]], [blob]]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "ids", "digests", "sizes", "blob"])

    def pack(table: pa.Table) -> pa.Table:
        ids, digests, sizes = (table[c].to_pylist() for c in ("ids", "digests", "sizes"))
        least: dict[str, tuple[int, int]] = {}
        for n, part in enumerate(ids):
            for i, d in zip(part, digests[n], strict=True):
                least[d] = min((i, n), least.get(d, (i, n)))

        def first() -> Iterator[tuple[int, str, bytes]]:
            for n, blob in enumerate(table["blob"]):
                data, at = zstandard.ZstdDecompressor().decompress(blob.as_py()), 0
                for i, d, size in zip(ids[n], digests[n], sizes[n], strict=True):
                    if least[d] == (i, n):
                        yield i, d, data[at : at + size]
                    at += size

        return pa.Table.from_batches(list(_pack_rows(table["bucket"][0].as_py(), first(), pack_bytes, 3)))

    dealt = texts.mapInArrow(deal, "bucket long, ids array<long>, digests array<string>, sizes array<long>, blob binary")
    return dealt.groupBy("bucket").applyInArrow(pack, PACK)


def _opened(blob: bytes, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(sum(sizes))), np.uint8)
    return data, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows of it)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], bucket[order][1:] != bucket[order][:-1], [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers, compressed: of each the planes of its low bytes, as many as its largest value has."""
    head, parts = [], []
    for c in columns:
        c = c.astype(np.uint64)
        width = -(-int(c.max()).bit_length() // 8) if len(c) else 0
        head += [len(c), width]
        parts.append(c.view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join((np.array(head, np.uint32).tobytes(), *parts)))


def restored(blob: bytes, n: int) -> list[np.ndarray]:
    """The n columns of squeezed()."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    out, at = [], 8 * n
    for size, width in raw[:at].view(np.uint32).reshape(n, 2).tolist():
        c = np.zeros((size, 8), np.uint8)
        c[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(c.view(np.uint64).ravel())
        at += size * width
    return out


def _rises(x: np.ndarray) -> np.ndarray:
    """Steps of rising numbers, from 0."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _keys(h: np.ndarray) -> np.ndarray:
    return mix64(h) >> np.uint64(64 - KEY_BITS)  # anchors have small hashes; their keys are spread


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of keys, so that rising keys have rising buckets."""
    return keys * np.uint64(buckets) >> np.uint64(KEY_BITS)


def _hashes(packs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, hashes): each pack's distinct anchor keys, rising, and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, sizes, blob in zip(*batch.columns, strict=True):
                data, owner = _opened(blob.as_py(), sizes.as_py())
                h, n = np.unique(_keys(anchor_runs(data, owner)[3]), return_counts=True)
                rows = [(b, pack.as_py(), squeezed(_rises(h[at]), n[at])) for b, at in _split(_bucket(h, buckets))]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "pack", "hashes"])

    return packs.select("pack", "sizes", "blob").mapInArrow(run, "bucket long, pack long, hashes binary")


def _again(sent: DataFrame, hot: int) -> DataFrame:
    """(pack, bucket, marks): for each of a pack's keys in a bucket 0, 1 if it occurs twice or more, 2 if very often."""

    def run(table: pa.Table) -> pa.Table:
        bucket, packs = table["bucket"][0].as_py(), table["pack"].to_pylist()
        raw = [restored(x.as_py(), 2) for x in table["hashes"]]
        _, which = np.unique(np.concatenate([np.cumsum(h) for h, _ in raw]), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([n for _, n in raw]))[which]
        out, at = [], 0
        for pack, (h, _) in zip(packs, raw, strict=True):
            own = total[at : at + len(h)]
            at += len(h)
            if (own > 1).any():
                out.append((pack, bucket, squeezed((own > 1) * (1 + (own > hot)))))
        kinds = [pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names=["pack", "bucket", "marks"])

    return sent.groupBy("bucket").applyInArrow(run, "pack long, bucket long, marks binary")


def _runs_of(pack: pa.Table, again: pa.Table, buckets: int) -> tuple:
    """A pack opened: data, owner, ids, and its anchor runs that occur again (first, last, anchor, key), with their hot marks."""
    data, owner = _opened(pack["blob"][0].as_py(), pack["sizes"][0].as_py())
    first, last, anchor, h = anchor_runs(data, owner)
    own, which = np.unique(_keys(h), return_inverse=True)
    bucket, mark = _bucket(own, buckets), np.zeros(len(own), np.uint8)
    for b, marks in zip(again["bucket"].to_pylist(), again["marks"], strict=True):
        lo, hi = np.searchsorted(bucket, np.array([b, b + 1], np.uint64))
        mark[lo:hi] = restored(marks.as_py(), 1)[0]
    mark = mark[which]
    known = mark > 0
    return data, owner, np.array(pack["ids"][0].as_py(), np.int64), first[known], last[known], anchor[known], own[which][known], mark[known] > 1


def _strings_at(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Rows of width bytes from each position; past the end of data: 0."""
    padded = np.concatenate((data, np.zeros(width, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, width)[at]


def _hot_strings(data: np.ndarray, owner: np.ndarray, ids: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, distinct strings, which of them each start has) of hot runs, a bounded number at a time."""
    counts = last - first + 1
    starts = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(int(counts.sum())) if len(first) else np.empty(0, np.int64)
    for at in range(0, len(starts), 1 << 18):
        part = starts[at : at + (1 << 18)]
        rows = np.ascontiguousarray(_strings_at(data, part, LENGTH)).view(f"V{LENGTH}").ravel()
        distinct, which = np.unique(rows, return_inverse=True)
        yield part, distinct, which


def _contexts(key: np.ndarray, lead: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, begins): items by key, those with equal contexts together, and where others begin; equal ones stay in order."""
    words = mix64(np.ascontiguousarray(text).view(np.uint64) + np.arange(1, CONTEXT // 8 + 1, dtype=np.uint64) * _BASE)
    mixed = np.bitwise_xor.reduce(words, axis=1) + (lead * WINDOWS + count).astype(np.uint64)
    order = np.lexsort((mixed, key))
    a, b = order[1:], order[:-1]
    same = (key[a] == key[b]) & (lead[a] == lead[b]) & (count[a] == count[b])
    same[same] = (text[a[same]] == text[b[same]]).all(axis=1)
    return order, np.flatnonzero(np.concatenate(([True], ~same))[: len(order)])


def _suffixes(packs: DataFrame, again: DataFrame, buckets: int) -> DataFrame:
    """(bucket, pack, items, bytes): suffixes at the anchors that occur again, with what stands before them.

    A pack sends each context once, with the places and documents that have it.
    """

    def run(pack: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if pack.num_rows and known.num_rows:
            data, owner, ids, first, last, anchor, key, hot = _runs_of(pack, known, buckets)
            name = pack["pack"][0].as_py()
            cold = ~hot
            width = last[cold] - first[cold] + LENGTH
            text = _strings_at(data, first[cold], CONTEXT).copy()
            text[np.arange(CONTEXT) >= width[:, None]] = 0
            parts = [(key[cold], ids[owner[first[cold]]], first[cold] + 1, anchor[cold] - first[cold], width - LENGTH + 1, text)]
            least: dict[bytes, int] = {}
            for starts, distinct, which in _hot_strings(data, owner, ids, first[hot], last[hot]):
                smallest = np.full(len(distinct), NO_ID, np.int64)
                np.minimum.at(smallest, which, ids[owner[starts]])
                for s, i in zip(distinct.tolist(), smallest.tolist(), strict=True):
                    s = bytes(s)
                    least[s] = min(i, least.get(s, NO_ID))
            if least:
                keys = _keys(np.fromiter((xxhash.xxh64_intdigest(s, 7) for s in least), np.uint64, len(least)))
                text = np.zeros((len(least), CONTEXT), np.uint8)
                text[:, :LENGTH] = np.frombuffer(b"".join(least), np.uint8).reshape(-1, LENGTH)
                n = len(least)
                parts.append((keys, np.fromiter(least.values(), np.int64, n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), text))
            key, id_, start, lead, count, text = (np.concatenate(x) for x in zip(*parts, strict=True))
            # A hot string has the place 0 and is no item's copy: its row stands for itself.
            order, begins = _contexts(key, lead, count + WINDOWS * (start == 0), text)
            sizes = np.diff(np.append(begins, len(order)))
            one = order[begins]
            for b, at in _split(_bucket(key[one], buckets)):
                own = slice(begins[at[0]], begins[at[-1]] + sizes[at[-1]])
                reps = one[at]
                out.append((b, name, squeezed(_rises(key[reps]), lead[reps], count[reps], sizes[at], id_[order[own]], start[order[own]]), zstandard.ZstdCompressor(1).compress(text[reps].tobytes())))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["bucket", "pack", "items", "bytes"])

    return packs.groupBy("pack").cogroup(again.groupBy("pack")).applyInArrow(run, "bucket long, pack long, items binary, bytes binary")


def sort_and_bound(key: np.ndarray, ids: np.ndarray, most: np.ndarray, lead: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first, bound): runs of an item's strings by the smallest document that holds them.

    ids and most are the smallest and the largest document that have an item's context.
    Runs follow each other; a run ends where the item's next run begins, or at its last string.
    """
    words = np.ascontiguousarray(text[:, :SHALLOW_BYTES]).view(">u8")
    # By hash, place of the anchor, length and the first bytes of the context; then, to tell equal from different, all bytes.
    order = np.lexsort((*(words[:, j] for j in reversed(range(words.shape[1]))), count, lead, key))
    k = key[order]
    cuts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
    same = (k[1:] == k[:-1]) & (lead[order][1:] == lead[order][:-1]) & (count[order][1:] == count[order][:-1])
    same &= (text[order[1:]] == text[order[:-1]]).all(axis=1)
    group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    uniform = np.ones(len(cuts) - 1, bool)
    uniform[group[1:][~same & (k[1:] == k[:-1])]] = False
    least = np.minimum.reduceat(ids[order], cuts[:-1]) if len(order) else ids
    easy = uniform[group]
    items, firsts, bounds = [order[easy]], [np.zeros(int(easy.sum()), np.int64)], [least[group[easy]]]
    for g in np.flatnonzero(~uniform):
        own = order[cuts[g] : cuts[g + 1]]
        if (ids[own] == ids[own[0]]).all() and (most[own] == ids[own[0]]).all():
            continue
        classes: dict[tuple[bytes, int, int], list[int]] = {}
        for i, raw, at, n in zip(own.tolist(), text[own], lead[own].tolist(), count[own].tolist(), strict=True):
            classes.setdefault((raw[: n + LENGTH - 1].tobytes(), at, n), []).append(i)
        names = list(classes)
        found = group_bounds([c[0] for c in names], [c[1] for c in names], [c[2] for c in names], [int(ids[classes[c]].min()) for c in names])
        for c, b in zip(names, found, strict=True):
            starts = [0] + [t for t in range(1, len(b)) if b[t] != b[t - 1]]
            for i in classes[c]:
                items.append(np.full(len(starts), i))
                firsts.append(np.array(starts, np.int64))
                bounds.append(np.array([b[t] for t in starts], np.int64))
    return np.concatenate(items), np.concatenate(firsts), np.concatenate(bounds)


def _sorted(sent: DataFrame) -> DataFrame:
    """(pack, spans, strings, bounds): byte ranges to remove, and the smallest documents of hot strings."""

    def run(table: pa.Table) -> pa.Table:
        packs = table["pack"].to_pylist()
        raw = [restored(x.as_py(), 6) for x in table["items"]]
        text = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x.as_py()) for x in table["bytes"]), np.uint8).reshape(-1, CONTEXT)
        origin = np.repeat(np.arange(len(packs)), [len(r[0]) for r in raw])
        key = np.concatenate([np.cumsum(r[0]) for r in raw])
        lead, count, size, ids, start = (np.concatenate(c).astype(np.int64) for c in list(zip(*raw, strict=True))[1:])
        begins = np.cumsum(size) - size
        least, most = np.minimum.reduceat(ids, begins), np.maximum.reduceat(ids, begins)
        item, first, bound = sort_and_bound(key, least, most, lead, count, text)
        follows = np.concatenate((item[1:] == item[:-1], [False])) if len(item) else np.empty(0, bool)
        end = np.where(follows, np.concatenate((first[1:], [0])), count[item]) if len(item) else first
        hot = np.flatnonzero(start[begins[item]] == 0)
        hot = hot[np.argsort(origin[item[hot]], kind="stable")]
        # Each run of a context, at all places that have it.
        run_of = np.repeat(np.arange(len(item)), size[item])
        member = np.arange(len(run_of)) - np.repeat(np.cumsum(size[item]) - size[item] - begins[item], size[item])
        gone = (start[member] > 0) & (bound[run_of] < ids[member])
        run_of, member = run_of[gone], member[gone]
        a, n, pack_of = start[member] - 1 + first[run_of], end[run_of] - first[run_of] - 1 + LENGTH, origin[item[run_of]]
        order = np.lexsort((a, pack_of))
        a, n = a[order], n[order]
        cuts = np.searchsorted(pack_of[order], np.arange(len(packs) + 1))
        hot_cuts = np.searchsorted(origin[item[hot]], np.arange(len(packs) + 1))
        out = []
        for p, pack in enumerate(packs):
            g, t = slice(cuts[p], cuts[p + 1]), hot[hot_cuts[p] : hot_cuts[p + 1]]
            out.append((pack, squeezed(_rises(a[g]), n[g]) if len(a[g]) else b"", text[item[t]][:, :LENGTH].tobytes(), bound[t].tobytes()))
        out = [x for x in out if x[1] or x[2]]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], names=["pack", "spans", "strings", "bounds"])

    return sent.groupBy("bucket").applyInArrow(run, "pack long, spans binary, strings binary, bounds binary")


def _cut(packs: DataFrame, found: DataFrame, buckets: int, with_text: bool) -> DataFrame:
    """(digest, n_removed, n_spans, kept_sha256[, kept]) of each text."""

    def run(pack: pa.Table, parts: pa.Table) -> pa.Table:
        sizes = np.array(pack["sizes"][0].as_py(), np.int64)
        data, owner = _opened(pack["blob"][0].as_py(), sizes.tolist())
        edge = np.zeros(len(data) + 1, np.int32)
        for spans in parts["spans"]:
            if spans.as_py():
                start, n = (c.astype(np.int64) for c in restored(spans.as_py(), 2))
                start = np.cumsum(start)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n, -1)
        strings = b"".join(x or b"" for x in parts["strings"].to_pylist())
        if strings:
            bounds = np.frombuffer(b"".join(x or b"" for x in parts["bounds"].to_pylist()), np.int64)
            least = dict(zip((strings[a : a + LENGTH] for a in range(0, len(strings), LENGTH)), bounds.tolist(), strict=True))
            own = parts.filter(pc.is_valid(parts["marks"]))
            _, _, ids, first, last, _, _, hot = _runs_of(pack, own, buckets)
            for starts, distinct, which in _hot_strings(data, owner, ids, first[hot], last[hot]):
                bound = np.fromiter((least[bytes(s)] for s in distinct.tolist()), np.int64, len(distinct))
                gone = starts[bound[which] < ids[owner[starts]]]
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + LENGTH, -1)
        covered = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(sizes)
        out = []
        for digest, a, b in zip(pack["digests"][0].as_py(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            mask = covered[a:b]
            n = int(mask.sum())
            runs = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
            kept = data[a:b][~mask].tobytes() if n else data[a:b].tobytes()
            out.append((digest, n, runs, hashlib.sha256(kept).hexdigest() if n else digest, kept))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["digest", "n_removed", "n_spans", "kept_sha256", "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names).select(names[: 4 + with_text])

    return packs.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(run, "digest string, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, pack_bytes: int = PACK_BYTES, hot: int = HOT, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and kept (bytes) on request.

    Null texts count as empty. Null ids count as larger than all others and
    equal to one another; rows with one id remove nothing from each other.
    Repeated rows give repeated results; an empty table gives none; other
    columns are ignored. Removal may cut a character: kept bytes need not be
    valid UTF-8.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("*", F.sha2("text", 256).alias("digest"), F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("order"), F.octet_length("text").cast("long").alias("n_bytes"))
    light, _ = store(rows.select("id", "digest", "order", "n_bytes"), "texts")
    least = light.groupBy("digest").agg(F.min("order").alias("order"), F.max("n_bytes").alias("n_bytes"))
    total = least.agg(F.sum("n_bytes").alias("n")).first().n or 0
    buckets = max(partitions(spark), -(-total // BUCKET_BYTES))
    texts = rows.where(F.col("n_bytes") >= LENGTH).select("order", "digest", "text")
    packs, at = store(_packed_by_digest(texts, pack_bytes, buckets), "packs")
    remove(spark)
    again, again_at = store(_again(_hashes(packs, buckets), hot), "again")
    remove(spark)
    found, found_at = store(_sorted(_suffixes(packs, again, buckets)), "found")
    remove(spark)
    both = found.unionByName(again, allowMissingColumns=True)
    done, _ = store(_cut(packs, both, buckets, with_text).dropDuplicates(["digest"]), "cut")
    remove(spark, at, again_at, found_at)
    named = light.join(least.select("digest", F.col("order").alias("least")), "digest").join(done, "digest", "left")
    copy = (F.col("order") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
    pick = lambda whole, own, none: F.when(copy, whole).otherwise(F.coalesce(own, none))
    zero = F.lit(0).cast("long")
    columns = [F.col("id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("n_spans"), zero).alias("n_spans")]
    columns.append(pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("digest")).alias("kept_sha256"))
    if not with_text:
        return named.select(*columns)
    short = rows.where(F.col("n_bytes") < LENGTH).groupBy("digest").agg(F.first(F.col("text").cast("binary")).alias("short"))
    return named.join(short, "digest", "left").select(*columns, pick(F.lit(b""), F.col("kept"), F.coalesce("short", F.lit(b""))).alias("kept"))
