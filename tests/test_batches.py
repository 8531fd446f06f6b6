"""What Python holds of long texts at once does not grow with an Arrow batch."""

from pyspark.sql import functions as F

from siltstone.operators import chunking, html


def test_pages_and_sections_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(html, "BATCH_ROWS", 3)
    monkeypatch.setattr(chunking, "BATCH_ROWS", 3)
    pages = spark.range(10).coalesce(1).select(F.col("id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.concat(F.lit("<title>t</title><p>text "), "id").alias("html"))
    assert sorted((r.page_id, r.markdown) for r in html.extract_pages(pages).collect()) == [(i, f"text {i}") for i in range(10)]
    texts = spark.range(10).coalesce(1).select("id", F.when(F.col("id") != 4, F.concat(F.lit("a. b.\n\nc "), "id")).alias("text"))
    assert sorted((r.id, r.p) for r in texts.select("id", chunking.packed_chunks(F.col("text"), 6).alias("p")).collect()) == [(i, None if i == 4 else chunking.pack_text(f"a. b.\n\nc {i}", 6)) for i in range(10)]
    assert html.BATCH_ROWS == chunking.BATCH_ROWS == 3
