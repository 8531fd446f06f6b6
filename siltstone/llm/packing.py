"""Packing documents into fixed-length sequences by first-fit decreasing.

A document's ids are cut into full sequences and a rest. Rests are dealt into
groups at random, and each group is packed by itself: longest first, each into
the first sequence with room, which a tournament tree over the sequences' room
finds in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, store, texts_of
from ._tokenizers import WordEncoder, load, tokenizer_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
GROUP_ROWS = 4096


def first_fit_decreasing(lengths: list[int], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length. Ties go in the order given."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    room = [0] * size + [length] * size  # room[1] is the most room in any bin; leaf size + b is bin b
    for i in range(size - 1, 0, -1):
        room[i] = length
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for at in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, node = lengths[at], 1
        while node < size:
            node *= 2
            if room[node] < need:
                node += 1
        bins[at], offsets[at] = node - size, length - room[node]
        room[node] -= need
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def token_pieces(docs: DataFrame, id_col: str, text_col: str, path: str, length: int, with_ids: bool) -> DataFrame:
    """Pieces of each document: full sequences, and the rest without a sequence yet."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = load(WordEncoder, path).encode, np.array([END_ID], "<u4").tobytes()
        task, n = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches):
            at, start, size, crc, total, number, ids = [], [], [], [], [], [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                raw = encode(text) + end
                for a in range(0, len(raw), 4 * length):
                    piece = raw[a : a + 4 * length]
                    n += 1
                    at.append(i)
                    start.append(a // 4)
                    size.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(raw) // 4)
                    number.append(task << 32 | n)
                    ids.append(piece)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.int64()) for c in (start, size, crc, total, number))]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "number"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, number long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, length: int = LENGTH, group_rows: int = GROUP_ROWS, with_ids: bool = False
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids on request.

    Every id of a document, its end id included, lies in exactly one piece.
    Null and empty texts are one end id. Null ids pass through; repeated rows
    are documents of their own; an empty table gives none; other columns are
    ignored. ``ids`` holds little-endian unsigned 32-bit ids.
    """
    path = vocabulary or tokenizer_path(VOCABULARY)
    pieces, _ = store(token_pieces(docs, id_col, text_col, path, length, with_ids), "pieces")
    rests = pieces.where(F.col("length") < length).select("number", "length")
    groups = max(1, -(-rests.count() // group_rows))

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["number"].to_numpy(), kind="stable")
        number, sizes = table["number"].to_numpy()[order], table["length"].to_numpy()[order]
        bins, offsets = first_fit_decreasing(sizes.tolist(), length)
        group = table["grp"][0].as_py()
        return pa.table({"number": number, "sequence_id": np.array(bins, np.int64) + ((1 << 62) + (group << 32)), "offset": np.array(offsets, np.int64)})

    dealt = rests.withColumn("grp", F.pmod(F.xxhash64(F.lit("group"), "number"), F.lit(groups)))
    packed = dealt.groupBy("grp").applyInArrow(run, "number long, sequence_id long, offset long")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    full = pieces.where(F.col("length") == length).withColumn("sequence_id", F.col("number")).withColumn("offset", F.lit(0).cast("long"))
    return full.select(*names).unionByName(pieces.join(packed, "number").select(*names))
