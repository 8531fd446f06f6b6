"""Pages as a data source, in batch and as a stream that goes on from its checkpoint."""

from siltstone.sources import page_source


def test_hosts():
    hosts = page_source.by_host(["http://b.example/1", " http://A.example/1", "http://b.example/2", "", "http://b.example/1", "http://[bad/x"])
    assert [(h.name, h.urls) for h in hosts] == [("", ["http://[bad/x"]), ("a.example", ["http://A.example/1"]), ("b.example", ["http://b.example/1", "http://b.example/2"])]


def test_batch_and_stream(spark, tmp_path):
    page = tmp_path / "page.html"
    page.write_text("<main>hello</main>")
    page_source.register(spark)
    urls = f"file://{page}\nfile://{tmp_path}/none\n\nhttp://127.0.0.1:9/a b\nhttp://[bad/x\nfile://{page}"
    options = {"urls": urls, "rate": "1000", "attempts": "1"}
    rows = {r.url: r for r in spark.read.format("pages").options(**options).load().collect()}
    assert len(rows) == 4 and "hello" in rows[f"file://{page}"].html
    assert all(r.html is None and r.error for url, r in rows.items() if url != f"file://{page}")
    assert spark.read.format("pages").load().count() == 0

    def run(every):
        stream = spark.readStream.format("pages").options(**options, every=every).load()
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).start()
        query.processAllAvailable()
        query.stop()
        return spark.read.parquet(str(tmp_path / "out"))

    assert run("1e9").count() == 4
    assert run("1e9").count() == 4  # the period is done
    again = run("3600")  # periods of an hour have larger numbers: time has come for another crawl
    assert again.count() == 8 and again.where("html is not null").count() == 2
