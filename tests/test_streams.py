"""Streams that remember for a while, stopped and started again."""

from datetime import datetime, timedelta

import pytest

from siltstone.streaming import caches

START = datetime(2025, 1, 1)
at = lambda h: START + timedelta(hours=h)
EVENTS = "cache_key string, at timestamp, is_query boolean, answer string"


@pytest.fixture
def landing(spark, tmp_path):
    """Adds rows to a folder, and runs the stream over what is new from its checkpoint."""

    def add(rows, schema=EVENTS):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(stream, schema=EVENTS):
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True)
        writer.start().awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    return add, run


def test_entries_expire(spark, landing):
    add, run = landing
    stream = lambda df: caches.cache_stream(df, 24)
    said = lambda df: sorted((r.cache_key, r.asked_at, r.answer) for r in df.collect())
    add([("a", at(0), False, "old"), ("a", at(1), False, "new"), ("a", at(2), True, None), ("b", at(2), True, None), (None, at(2), True, None), ("c", None, True, None)])
    first = [("a", at(2), "new"), ("b", at(2), None)]
    assert said(run(stream)) == first
    add([("a", at(20), True, None), ("b", at(3), False, "x"), ("b", at(3), False, "y"), ("b", at(3), True, None)])  # a restart keeps what the cache held
    second = [*first, ("a", at(20), "new"), ("b", at(3), "y")]
    assert said(run(stream)) == sorted(second, key=lambda x: x[:2])
    add([("a", at(25), True, None), ("a", at(100), True, None)])  # stored at 1: just too old at 25
    third = [*second, ("a", at(25), None), ("a", at(100), None)]
    assert said(run(stream)) == sorted(third, key=lambda x: x[:2])
    add([("a", at(101), False, "again"), ("a", at(101), True, None), ("z", at(1), True, None)])  # the last comes too late
    assert said(run(stream)) == sorted([*third, ("a", at(101), "again")], key=lambda x: x[:2])


def test_duplicates_within_the_watermark(spark, landing):
    add, run = landing
    schema = "url string, at timestamp, n int"
    stream = lambda df: caches.distinct_within(df, ["url"], "at", "2 hours")
    said = lambda df: sorted((r.url, r.at) for r in df.collect())
    add([("a", at(0), 1), ("a", at(0), 2), ("b", at(1), 3), (None, at(1), 4), (None, at(1), 5), ("c", None, 6)], schema)
    first = [("a", at(0)), ("b", at(1)), (None, at(1))]
    key = lambda x: (x[0] or "", x[1])
    assert sorted(((r.url, r.at) for r in run(stream, schema).collect()), key=key) == sorted(first, key=key)
    add([("a", at(1), 7), ("b", at(3), 8)], schema)  # both inside the two hours of their first
    assert run(stream, schema).count() == 3
    add([("x", at(9), 9)], schema)
    assert run(stream, schema).count() == 4
    add([("a", at(9), 10), ("b", at(2), 11)], schema)  # beyond: a passes again; b is later than the watermark
    assert run(stream, schema).where("url = 'a'").count() == 2 and run(stream, schema).where("url = 'b'").count() == 1


def test_a_key_makes_no_frame(spark, landing):
    """Rows of a key come as rows: a key with many stores and queries of equal times, answers of null and of nothing."""
    assert not hasattr(caches, "pd")
    add, run = landing
    add([("k", at(1), False, None), ("k", at(1), True, None), ("k", at(2), False, ""), ("k", at(2), True, None), ("k", at(3), False, "z"), ("k", at(3), False, "a"), ("k", at(3), True, None)])
    got = {r.asked_at: (r.answer, r.stored_at) for r in run(lambda df: caches.cache_stream(df, 24)).collect()}
    assert got == {at(1): (None, at(1)), at(2): ("", at(2)), at(3): ("z", at(3))}


def test_what_a_run_stores_is_compressed_and_read_by_need(spark, tmp_path):
    from pyarrow import parquet
    from siltstone.streaming import ingest

    out = str(tmp_path / "store")
    ingest.ingest_batch(spark.createDataFrame([(1, "## A\none two three"), (2, "## B\nfour five six")], "doc_id long, text string"), out, 0)
    files = [f for name in ("documents", "holders", "chunks") for f in (tmp_path / "store" / name).rglob("*.parquet")]
    assert files and {parquet.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if parquet.ParquetFile(f).metadata.num_row_groups} == {"ZSTD"}
    there = ingest.present_chunks(spark, out, said=("point_id",))
    assert there.count() and not {"text", "vector"} & set(there.columns)
