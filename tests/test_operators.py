"""Operators on small hand-made tables."""

import json
import random
import sys
import types
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siltstone import cli, plans
from siltstone.functions import scoring, text, urls
from siltstone.operators import chunking, dedup, discovery, evaluation, retrieval, search_index
from siltstone.operators.html import read_page
from siltstone.sources import models, pages, seeds, tables
from siltstone.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_packer_arithmetic(spark):
    assert one(spark, chunking.packed_chunks(F.lit("Aaaaa. Bbbbb. Ccccc. Ddddd."), 13)) == ["Aaaaa. Bbbbb.", "Ccccc. Ddddd."]
    assert one(spark, chunking.packed_chunks(F.lit(""), 12)) == []
    assert one(spark, chunking.packed_chunks(F.lit("x" * 50), 12)) == ["x" * 50]


def test_sections(spark):
    docs = spark.createDataFrame([(1, "intro\n## One\nbody\n### Two\n\n## Three\nend"), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in chunking.split_sections(docs).collect())
    assert got == [(1, 1, "Introduction", "intro"), (1, 2, "One", "body"), (1, 3, "Three", "end")]


def test_clean_markdown_variants(spark):
    said = "![a](b)\nA well-known  fact ✅\n\n\nSlide 1 of 3 next"
    assert one(spark, text.clean_markdown(F.lit(said))) == "A well-known fact\n\nnext"
    assert one(spark, text.clean_markdown(F.lit(said), "collapse", True)) == "A wellknown fact next"


def test_search_queries_and_replies(spark):
    none = F.array().cast("array<string>")
    assert one(spark, scoring.search_queries(F.lit("q"), F.lit("a"), F.lit("b"), F.array(F.lit("a"), F.lit("z")))) == ["a", "b"]
    assert one(spark, scoring.search_queries(F.lit("x" * 60), F.lit("a"), F.lit("b"), none)) == ["x" * 60]
    assert one(spark, scoring.json_reply(F.lit('Sure:\n```json\n{"a": 1}\n```'), "a int")).a == 1
    assert one(spark, scoring.recency_factor(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-31").cast("timestamp"))) == 1 - 30 / 365 * 0.1


def test_urls(spark):
    assert one(spark, urls.canonical_url(F.lit("https://a.b/x/?q=1#t"))) == "https://a.b/x"
    assert one(spark, urls.canonical_url(F.lit("https://a.b/"))) == "https://a.b/"
    assert one(spark, urls.resolve(F.lit("//c.d/x"), F.lit("https://a.b/y"))) == "https://c.d/x"


def test_first_probe_and_graph(spark):
    probes = spark.createDataFrame([("d", 2, "u2"), ("d", 1, "u1"), ("e", 3, "v")], "domain string, probe int, url string")
    assert sorted(tuple(r) for r in discovery.first_answering(probes).collect()) == [("d", "u1"), ("e", "v")]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = discovery.breadth_first(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0), (2, 1), (3, 2)]


def test_first_wins_with_nulls_and_ties(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 1, "z")], "k string, n int, v string")
    assert sorted((tuple(r) for r in dedup.first_wins(rows, ["k"], ["n"]).collect()), key=str) == [("a", 1, "y"), (None, 1, "z")]
    assert dedup.first_wins(rows.limit(0), ["k"], ["n"]).count() == 0


def test_read_page():
    page = '<title>T</title><meta name="description" content="D"><nav>menu</nav><main><h2>Head</h2><p>Some <a href="/x">link</a>.</main><footer>f'
    markdown, title, description, _ = read_page(page, "u")
    assert (title, description) == ("T", "D")
    assert markdown == "## Head\n\nSome [link](/x)."
    assert read_page(None, "u") == ("", "u", None, None)


def test_page_to_markdown():
    page = """<svg><title>icon</title></svg><title>late</title><body><h1>A <b>bold</b> <i>word</i></h1><ol><li>one<li>two</ol>
      <ul><li>x <code>y</code></ul><table><tr><th>h</th><th>i</th></tr><tr><td>a</td><td>b</td></tr></table><img src="p.png" alt="pic"><pre>k  l
m</pre><blockquote>said</blockquote></body>"""
    markdown, title, _, published = read_page(page, "u")
    assert (title, published) == ("icon", None)
    for piece in ("# A **bold** *word*", "1. one\n2. two", "* x `y`", "| h | i |\n| --- | --- |\n| a | b |", "![pic](p.png)", "```\nk l\nm\n```", "> said"):
        assert piece in markdown
    assert read_page("<title>T</title><body>x<svg><title>icon</title></svg>", "u")[1] == "T"


def test_resolved_links(spark):
    for href, want in (("x.html", "/a/b/x.html"), ("../y", "/a/y"), ("../../../z", "/z"), ("./q/../r/", "/a/b/r/"), ("?p=2", "/a/b/c?p=2"), ("/m/./n", "/m/n"), ("..", "/a/")):
        assert one(spark, urls.resolve(F.lit(href), F.lit("https://h.example/a/b/c?k#t"))) == f"https://h.example{want}" == urljoin("https://h.example/a/b/c?k#t", href)
    assert one(spark, urls.resolve(F.lit("x"), F.lit("https://h.example"))) == "https://h.example/x"
    assert one(spark, urls.hrefs(F.lit("<A HREF = 'a b'><a class=c href=d><a\nhref=\"e&amp;f\"><abbr href='no'>"))) == ["a b", "d", "e&f"]
    odd = """<a title="a > b" href="/x">1</a><a data-x=" href=/wrong" HREF=/right/>2</a><a name='n'>3</a><a href>4</a><a href=p?a=b&c=d class=e>"""
    assert one(spark, urls.hrefs(F.lit(odd))) == ["/x", "/right/", "p?a=b&c=d"]
    long = "<a " + "x" * 200_000 + " " + "a='b' " * 20_000 + "href=z>"
    assert one(spark, urls.hrefs(F.lit(long))) == ["z"]
    for page, want in (("<base target=_top href='/d/'><a href=e>", "https://h.example/d/"), ("<a href=e>", "https://h.example/a/b"), ("<base href=''>", "https://h.example/a/b")):
        assert one(spark, urls.page_base(F.lit(page), F.lit("https://h.example/a/b"))) == want


def test_ingestion_replaces_documents(spark, tmp_path):
    out, long = str(tmp_path / "out"), "A sentence that is long enough to be kept as a child of its section, number {}. " * 4
    doc = lambda i, x: (i, f"## Head {x}\n" + long.format(x, x, x, x))
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda n, rows, **options: ingest.ingest_batch(table(rows), out, n, **options)
    said = lambda: sorted((r.doc_id, r.text.split("\n")[0]) for r in ingest.present_chunks(spark, out).where("is_parent").collect())
    run(0, [doc(1, "A"), doc(2, "X"), (3, " "), (None, "no id")])
    assert said() == [(1, "Head A"), (2, "Head X")]
    run(1, [doc(1, "B"), doc(2, "X"), doc(4, "X")])
    assert said() == [(1, "Head B"), (2, "Head X")]  # the parent of 4 is stored for 2
    run(2, [doc(1, "A")])
    run(2, [doc(1, "A")])  # repeated after a failure
    assert said() == [(1, "Head A"), (2, "Head X")]
    run(3, [doc(1, "A")])
    run(4, [doc(1, "A")], force=True)
    log = {r.run_id: r for r in spark.read.parquet(f"{out}/runs").collect()}
    assert [log[n].documents_unchanged for n in range(5)] == [0, 1, 0, 1, 0]
    assert (log[0].documents_processed, log[0].error_count, log[0].errors, log[0].success) == (2, 1, [f"3: {ingest.NO_CHUNKS}"], False)
    assert log[1].chunks_skipped >= 1 and log[2].success and log[4].chunks_ingested == log[2].chunks_ingested > 0
    row = ingest.present_chunks(spark, out).first()
    assert len(row.vector) == 64 and abs(sum(x * x for x in row.vector) - 1) < 1e-5 and row.point_id == int(row.text_hash[:15], 16)
    assert log[0].total_tokens > 0 and log[1].total_tokens < log[0].total_tokens and log[3].total_tokens == 0
    ingest.ingest_batch(table([]), out, 5)
    assert len(said()) == 2


def test_chunks_outlive_their_first_document(spark, tmp_path):
    out, said = str(tmp_path / "out"), "## Same\n" + "A sentence that two documents hold, long enough to stand as a child of its section. " * 3
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    here = lambda: sorted((r.doc_id, r.text.split("\n")[0]) for r in ingest.present_chunks(spark, out).where("is_parent").collect())
    ingest.ingest_batch(table([(1, said), (2, said)]), out, 0)
    assert here() == [(1, "Same")] and {(r.n_holders, r.n_places) for r in ingest.chunk_holders(spark, out).where("n_holders = 2").collect()} == {(2, 2)}
    ingest.ingest_batch(table([(1, "## Other\nsomething else"), (2, said)]), out, 1)
    assert here() == [(1, "Other"), (2, "Same")]
    ingest.delete_documents(spark.createDataFrame([(1,), (77,), (None,)], "doc_id long"), out, 2)
    assert here() == [(2, "Same")] and ingest.document_state(spark, out).where("status = 'deleted'").count() == 1
    ingest.ingest_batch(table([(1, said)]), out, 3)
    ingest.delete_documents(spark.createDataFrame([(2,)], "doc_id long"), out, 4)
    assert here() == [(1, "Same")] and ingest.next_run(spark, out) == 5
    ingest.delete_documents(spark.createDataFrame([(1,)], "doc_id long"), out, 5)
    assert here() == []


def test_folding_changes_nothing(spark, tmp_path):
    said = "## Same\n" + "A sentence that two documents hold, long enough to stand as a child of its section. " * 3
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda *own: spark.createDataFrame([(i,) for i in own], "doc_id long")
    stores = {fold: str(tmp_path / str(fold)) for fold in (False, True)}
    steps = [
        lambda out, n: ingest.ingest_batch(table([(1, said), (2, said), (3, "## Own\ntext"), (4, " ")]), out, n),
        lambda out, n: ingest.ingest_batch(table([(1, "## Other\nsomething else"), (2, said), (3, "## Own\ntext")]), out, n),
        lambda out, n: ingest.delete_documents(ids(2, 3), out, n),
        lambda out, n: ingest.ingest_batch(table([(3, said), (5, "## Own\ntext")]), out, n),  # both texts had died
    ]
    for n, step in enumerate(steps):
        for fold, out in stores.items():
            step(out, n)
            if fold:
                assert ingest.compact(spark, out) == n and ingest.compact(spark, out) is None
        views = [[sorted(map(str, view(spark, out).drop("run_id").collect())) for view in (ingest.document_state, ingest.present_chunks, ingest.chunk_holders)] for out in stores.values()]
        assert views[0] == views[1]
    assert ingest.failures(spark, stores[True], 0).first().doc_id == 4 and ingest.next_run(spark, stores[True]) == 4
    assert ingest.read_table(spark, f"{stores[True]}/chunks", ingest.CHUNKS).isEmpty()  # the runs' own files are gone
    with pytest.raises(ValueError):
        ingest.ingest_batch(table([(1, said)]), stores[True], 3)


def test_unfinished_runs_are_not_folded(spark, tmp_path):
    out, row = str(tmp_path / "out"), spark.createDataFrame([(1, "## Part\ntext")], "doc_id long, text string")
    assert ingest.compact(spark, out) is None
    ingest.ingest_batch(row, out, 0)
    tables.drop_table(spark, f"{out}/runs/run_id=0")
    with pytest.raises(RuntimeError):
        ingest.compact(spark, out)
    ingest.ingest_batch(row, out, 0)
    assert ingest.compact(spark, out) == 0 and ingest.document_state(spark, out).count() == 1


def test_seed_files(spark, tmp_path, monkeypatch):
    parser = types.SimpleNamespace(safe_load=lambda f: json.load(f), YAMLError=ValueError)  # JSON is YAML
    monkeypatch.setitem(sys.modules, "yaml", parser)
    path = tmp_path / "seeds.yml"
    path.write_text(json.dumps({"documents": [{"url": "u", "title": "t"}, "no mapping"], "domains": [{"domain": "d", "max_pages": 3}]}))
    assert [(r.url, r.title, r.visa_types) for r in seeds.read_seeds(spark, str(path)).collect()] == [("u", "t", None)]
    assert [(r.domain, r.max_pages) for r in seeds.read_domains(spark, str(path)).collect()] == [("d", 3)]
    path.write_text(json.dumps({"extra_urls": [{"url": "v"}], "documents": [{"url": "u"}]}))
    assert [r.url for r in seeds.read_seeds(spark, str(path)).collect()] == ["v"]
    for bad in ("{", "[1]"):
        path.write_text(bad)
        with pytest.warns(UserWarning):
            assert seeds.read_seeds(spark, str(path)).isEmpty()
    with pytest.warns(UserWarning):
        assert seeds.read_domains(spark, str(tmp_path / "absent.yml")).isEmpty()


def test_landing_folder(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, f"## Head\nSentence number {i} is here. " * 20) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(landing)
    ingest.ingest_batch(spark.createDataFrame([(50, "## Before\nthe stream")], "doc_id long, text string"), out, 0)
    ingest.ingest_available(spark, landing, out)
    first = ingest.present_chunks(spark, out).count()
    spark.createDataFrame(rows[:3], "doc_id long, text string").write.mode("append").parquet(landing)
    ingest.ingest_available(spark, landing, out)
    assert ingest.present_chunks(spark, out).count() == first > 1
    assert {r.run_id for r in spark.read.parquet(f"{out}/runs").collect()} == {0, 1, 2}


def test_bad_addresses_are_rows(spark):
    asked = spark.createDataFrame([("http://127.0.0.1:9/a b",), ("http://h:port/",), ("nonsense",)], "url string")
    got = pages.fetch_pages(asked, 1, rate=1000.0, attempts=1).collect()
    assert len(got) == 3 and all(r.html is None and r.error for r in got)


def test_fetching(spark, tmp_path):
    page = tmp_path / "page.html"
    page.write_text("<title>T</title><main>hello</main>")
    asked = spark.createDataFrame([(f"file://{page}",), (f"file://{tmp_path}/none",), (None,), (f"file://{page}",)], "url string")
    got = {r.url[-4:]: r for r in pages.fetch_pages(asked, 2, rate=1000.0, attempts=1).collect()}
    assert set(got) == {"html", "none"} and got["none"].html is None and got["none"].error and "hello" in got["html"].html
    assert [(r.title, r.markdown) for r in pages.crawl_batch(asked, 1, rate=1000.0, attempts=1).collect()] == [("T", "hello")]
    waits, failures = [], iter([OSError("a"), OSError("b"), (200, "x")])

    def get(url):
        if isinstance(x := next(failures), OSError):
            raise x
        return x

    assert pages.with_retries(get, "u", sleep=waits.append) == (200, "x", None) and waits == [2.0, 4.0]


def test_token_bucket(spark):
    random.seed(3)
    times = sorted(random.random() * 3 for _ in range(30))
    clock = [times[0]]

    def sleep(seconds):
        clock[0] += seconds

    bucket, served = pages.TokenBucket(2.0, now=lambda: clock[0], sleep=sleep), []
    for t in times:
        clock[0] = max(clock[0], t)
        bucket.acquire()
        served.append(clock[0])
    assert all(b - a >= 1 - 1e-9 for a, b in zip(served, served[4:], strict=False))  # a full bucket, then two a second
    assert served[-1] >= times[0] + 28 / 2 - 1e-9
    table = spark.createDataFrame([("h", t) for t in times] + [("other", 1.0)], "host string, at double")
    got = {r.host: r.waits for r in evaluation.token_bucket_waits(table, "host", "at", 2.0).collect()}
    assert got["other"] == [0.0] and len(got["h"]) == 30
    assert all(abs(t + w - x) < 1e-9 for t, w, x in zip(times, got["h"], served, strict=True))


def test_caches_and_seeds(spark, tmp_path):
    at = lambda x: F.lit(x).cast("timestamp")
    cache = spark.createDataFrame([("q", "old", "2025-01-01 00:00:00"), ("q", "new", "2025-01-01 05:00:00"), ("r", "stale", "2024-12-30 00:00:00")], "query string, answer string, at string")
    cache = cache.select(tables.answer_key(F.col("query")).alias("cache_key"), "answer", F.col("at").cast("timestamp").alias("at"))
    asked = spark.createDataFrame([("q",), ("r",), (None,)], "query string")
    got = {r.query: r.answer for r in tables.cached_answers(asked, cache, at("2025-01-01 06:00:00"), 24).collect()}
    assert got == {"q": "new", "r": None, None: None}
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a.example", "u1", 0.1), ("a.example", "u2", 0.9), ("b.example", "v", 0.5)], "domain string, url string, relevance double")
    tables.replace_domains(rows, path)
    tables.replace_domains(spark.createDataFrame([("b.example", "w", 0.4)], rows.schema), path)
    read = lambda d=None: [r.url for r in tables.cached_urls(spark.read.schema(rows.schema).parquet(path), d).orderBy("domain", "place").collect()]
    assert read() == ["u2", "u1", "w"] and read("a.example") == ["u2", "u1"]
    tables.clear_domains(spark, path, "a.example")
    assert read() == ["w"]
    tables.log_metrics(spark, str(tmp_path / "metrics"), "r1", faithfulness=0.5)
    assert spark.read.parquet(str(tmp_path / "metrics")).collect()[0].value == 0.5
    (tmp_path / "eval.json").write_text('{"questions": ["a", "b"], "ground_truths": ["c", "d"]}')
    eval_set = seeds.read_eval_set(spark, str(tmp_path / "eval.json"))
    assert sorted(map(tuple, eval_set.collect())) == [(0, "a", "c"), (1, "b", "d")]
    seeds.write_report(eval_set.agg(F.count("*").alias("n")), eval_set, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/samples"), header=True).count() == 2
    good, bad = seeds.valid_and_rejected(spark.createDataFrame([("official",), ("other",), (None,)], "authority_level string"))
    assert (good.count(), bad.count()) == (1, 2)
    assert models.choose_generator().generate("first\nsecond", "q") == "first"


def test_templates_fill_once(spark):
    got = one(spark, scoring.fill_template("<{a}|{b}>", a=F.lit("{b}"), b=F.lit(None).cast("string")))
    assert got == "<{b}|>"


def test_sitemaps_that_name_each_other(spark):
    index = "<sitemapindex><sitemap><loc>{}</loc></sitemap></sitemapindex>"
    files = [("a", index.format("b")), ("b", index.format("a")), ("c", "<urlset><url><loc>x</loc></url></urlset>")]
    sitemaps = spark.createDataFrame(files, "sitemap string, xml string")
    roots = lambda name: sitemaps.where(F.col("sitemap") == name).select("sitemap")
    assert discovery.sitemap_closure(sitemaps, roots("a")).count() == 0
    assert [r.url for r in discovery.sitemap_closure(sitemaps, roots("c")).collect()] == ["x"]


def test_whole_texts_and_rows(spark, tmp_path):
    long = "so " * 200 + "und 签证 work visa"
    turns = [(3, 1, "user", long), (3, 2, "assistant", "x" * 45), (3, 3, "user", "")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    spark.createDataFrame([(0, long, "s")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    assert long in run("context_build")[0].context
    assert {r.turn: r.languages for r in run("detect_language")}[1] == "zh,de"
    assert {r.turn: r.queries for r in run("search_query_gate")}[1] == " " + long
    assert {r.turn: r.topics for r in run("detect_topics")}[1] == "work_visa"
    assert sorted((r.turn, r.pos) for r in run("sse_chunks") if r.turn > 1) == [(2, 0), (2, 1), (2, 2)]


def test_dense_search_goes_through_blocks(spark, monkeypatch):
    rows = [(i, [float((i * 7 + j * j) % 11) for j in range(8)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = vectors.where("id % 2 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = {(q, i, r + 1) for q, a in rows if q % 2 == 0 for r, (_, i) in enumerate(sorted((-score(a, b), i) for i, b in rows)[:5])}
    for most in (4096, 8):
        monkeypatch.setattr(retrieval, "MOST_BROADCAST_QUERIES", most)
        assert {(r.query_id, r.id, r["rank"]) for r in retrieval.dense_top_k(vectors, queries, 5).collect()} == want


def test_searches_ask_every_twentieth_row(spark):
    data = "/root/testdata/sf0.001"
    asked = {r.vec_id for r in spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 20 = 0").collect()}
    for name in ("dense_topk", "rerank_mock", "rerank_map"):
        assert {r.query_id for r in plans.QUERIES[name](spark, data).collect()} == asked
    texts = {r.doc_id for r in spark.read.parquet(f"{data}/documents.parquet").where("doc_id % 20 = 0").collect()}
    assert {r.query_id for r in plans.QUERIES["bm25_topk"](spark, data).collect()} == texts


def test_walks_and_points_grow_with_the_table(spark, tmp_path):
    url = lambda i: f"https://a.example/{i}"
    pages = [(i, url(i), f'<a href="/{i + 1}">next</a><a href="/0">back</a>') for i in range(400)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(i, f"text {i % 350}", "s") for i in range(400)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    depth, todo = {0: 0, 10: 0}, [0, 10]
    for n in todo:
        for m in (n * 2 % 400, (n * 2 + 1) % 400):
            if m not in depth:
                depth[m] = depth[n] + 1
                todo.append(m)
    assert {r.node: r.depth for r in run("bfs_depth")} == depth and len(depth) == 400
    want = {url(i): i % 20 for i in range(400) if i % 20 <= 4}
    assert {r.node: r.depth for r in run("bfs_links")} == want
    assert sorted(r.doc_id for r in run("upsert_latest")) == list(range(50, 400))


def test_stored_index_gives_what_the_scan_gives(spark, tmp_path):
    rows = [(i, None if i == 3 else " ".join(f"w{(i * j) % 13}" for j in range(i % 9))) for i in range(60)] + [(61, "W1 w1, ä w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "Ä absent"), (3, ""), (None, "w3")], "query_id long, query string")
    path = str(tmp_path / "index")
    search_index.write_index(docs, path, buckets=8, files=2)
    found = lambda df: {(r.query_id, r.id, round(r.score, 5)) for r in df.collect()}
    filled = docs.fillna({"text": ""})
    assert found(search_index.search_index(spark, path, asked, 100)) == found(retrieval.bm25(filled, asked, 100)) != set()
    plan = search_index.search_index(spark, path, asked.limit(1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan
    search_index.write_index(docs.limit(0), path, buckets=8)
    assert search_index.search_index(spark, path, asked).count() == 0


def test_buckets_grow_with_the_words(spark, tmp_path, monkeypatch):
    docs, path = spark.createDataFrame([(i, f"one two three word{i}") for i in range(50)], "doc_id long, text string"), str(tmp_path / "index")
    monkeypatch.setattr(search_index, "BUCKETS", 2)
    monkeypatch.setattr(search_index, "BUCKET_WORDS", 40)
    search_index.write_index(docs, path, files=1)
    assert spark.read.parquet(f"{path}/totals").first().buckets == 5
    asked = spark.createDataFrame([(1, "word7 word9"), (2, "absent")], "query_id long, query string")
    assert {r.id for r in search_index.search_index(spark, path, asked).collect()} == {7, 9}


def test_addresses_in_sitemaps(spark):
    locs = lambda x, e="url": one(spark, discovery.locs(F.lit(x), e))
    assert locs("<urlset xmlns='x'><url><lastmod>1</lastmod><loc> a?b&amp;c </loc></url><s:url><s:loc><![CDATA[d]]></s:loc></s:url><url></url><url><loc>e") == ["a?b&c", "d", "e"]
    assert locs("<html><a href=x>no") == [] and locs("") == [] and locs("<url><lastmod>1</lastmod></url><sitemap><loc>x</loc></sitemap>") == []
    assert locs("<sitemapindex><sitemap><loc>x</loc></sitemap></sitemapindex>", "sitemap") == ["x"]


SITE = {
    "https://a.example/robots.txt": "User-agent: *\nDisallow: /en/secret\n",
    "https://a.example/sitemap.xml": "<sitemapindex><sitemap><loc>https://a.example/more.xml</loc></sitemap></sitemapindex>",
    "https://a.example/more.xml": "<urlset><url><loc>https://a.example/en/listed</loc></url><url><loc>https://a.example/fr/other</loc></url><url><loc>https://a.example/en/secret</loc></url></urlset>",
    "https://a.example/": '<main>root</main><a href="/en/one">1</a><a href="https://b.example/en/x">b</a>',
    "https://a.example/en/one": '<title>One</title><main>first page</main><a href="two">2</a><a href="/en/gone">g</a><a href="/en/secret">s</a>',
    "https://a.example/en/two": "<main>second page</main>",
    "https://a.example/en/listed": "<main>listed page</main>",
}


def test_command_line(spark, tmp_path, capsys):
    store, site = str(tmp_path / "store"), dict(SITE)

    def get(url):
        if url not in site:
            raise OSError("not there")
        return 200, site[url]

    run = lambda *argv: (cli.main([*argv, "--store", store], spark, get=get, attempts=1, rate=1000.0), capsys.readouterr().out)
    code, said = run("discover", "--domain", "a.example", "--tasks", "2")
    urls = sorted(line.split()[-1] for line in said.splitlines() if ". https" in line)
    assert code == 0 and urls == [f"https://a.example/{x}" for x in ("", "en/listed", "en/one", "en/two")]
    assert "1 from sitemaps, 3 from links, 0 beyond" in said
    code, said = run("ingest", "--source", "https://a.example/en/one")
    assert code == 0 and "Processed: 1\nFailed: 0" in said
    code, said = run("ingest", "--source", "https://a.example/en/gone")
    assert code == 1 and "Failed: 1" in said and "not there" in said
    assert run("compact") == (0, "Folded up to run 0\n") and run("compact") == (0, "Nothing to fold.\n")
    code, said = run("status")
    assert code == 0 and "documents ingested: 1" in said and "runs: 2" in said
    page = spark.read.parquet(f"{store}/pages").where("status = 200").first()
    assert (page.url, page.authority_level, page.visa_types) == ("https://a.example/en/one", "third_party", ["general"])


def test_discovery_is_kept(spark, tmp_path, capsys, monkeypatch):
    store, site, asked = str(tmp_path / "store"), dict(SITE), str(tmp_path / "asked")

    def get(url):
        with open(asked, "a") as f:
            f.write(url + "\n")
        if url not in site:
            raise OSError("not there")
        return 200, site[url]

    entry = {"domain": "a.example", "authority_level": "official", "max_depth": 1, "max_pages": 2}
    monkeypatch.setattr(seeds, "_yaml", lambda path: {"domains": [entry]})
    run = lambda *argv: (cli.main([*argv, "--store", store], spark, get=get, attempts=1, rate=1000.0), capsys.readouterr().out)
    code, said = run("ingest", "--auto-discover")
    assert code == 0 and "Processed: 2" in said
    fetched = open(asked).read().split()
    assert "https://a.example/robots.txt" in fetched and "https://a.example/en/two" not in fetched  # beyond max_depth
    code, said = run("discover")
    assert code == 0 and "Total: 2" in said and "1 beyond" in said and open(asked).read().split() == fetched  # nothing asked again
    levels = {r.authority_level for r in spark.read.parquet(f"{store}/pages").collect()}
    assert levels == {"official"}


def test_a_repeated_run_leaves_nothing_of_its_first_try(spark, tmp_path):
    out = str(tmp_path / "out")
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    ingest.ingest_batch(table([(1, "## One\ntext")]), out, 0)
    ingest.ingest_batch(table([]), out, 0)
    assert [ingest.read_table(spark, f"{out}/{name}", schema).count() for name, schema in (("documents", ingest.DOCUMENTS), ("holders", ingest.HOLDERS), ("chunks", ingest.CHUNKS))] == [0, 0, 0]
    assert ingest.present_chunks(spark, out).count() == 0
