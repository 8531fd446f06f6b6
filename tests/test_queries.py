"""Every registered query against its SQL, and the entry module without the optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from siltstone import plans

DATA = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages benchmark labels conversations".split()
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(frame):
    plain = lambda x: round(x, 9) if isinstance(x, float) else x.item() if hasattr(x, "item") else x
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA).toPandas()
    if name not in plans.ORACLE_SQL:
        assert len(got)
        return
    want = duck.sql(plans.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries in which a null text, of a document, a turn or a page, must not lose or miscount anything.
NULLS = "bm25_topk bm25_block_max index_update hybrid_fusion dedup_first_wins dedup_anti_known content_change ingest_run_log ingest_compacted shared_chunks pack_chunks chunk_ids link_extract relative_links answer_chain retrieve_parents".split()


@pytest.fixture(scope="module")
def with_nulls(tmp_path_factory):
    """The tables with every tenth text null."""
    c, out = duckdb.connect(), tmp_path_factory.mktemp("nulls")
    for t in TABLES:
        key, text = {"documents": ("doc_id", "text"), "conversations": ("conv_id", "text"), "pages": ("page_id", "html")}.get(t, (None, None))
        shown = f"* REPLACE (CASE WHEN {key} % 10 = 3 THEN NULL ELSE {text} END AS {text})" if key else "*"
        c.execute(f"COPY (SELECT {shown} FROM '{DATA}/{t}.parquet') TO '{out}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{out}/{t}.parquet'")
    return c, str(out)


@pytest.mark.parametrize("name", [n for n in NULLS if n in plans.QUERIES])
def test_null_texts(spark, with_nulls, name):
    c, data = with_nulls
    assert rows(plans.QUERIES[name](spark, data).toPandas()) == rows(c.sql(plans.ORACLE_SQL[name]).df())


def test_entry_without_training_operators():
    code = "import sys; sys.modules['siltstone.llm'] = None; import __spark_entry__ as e; assert e.llm_queries is None; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not [k for k in e.queries() if k.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO).returncode == 0
