"""Prompts, sources, replies and the small parsers around an answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import discovery as D
from ._registry import LEVEL_SQL, level, register, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_ = lambda sql=None: register(QUERIES, ORACLE_SQL, sql)

PROMPT = "Answer from these passages only.\n\n{context}\n\nQuestion: {question}\n"


@_("SELECT doc_id, sha256('Answer from these passages only.' || chr(10) || chr(10) || text || ' {question}' || chr(10) || chr(10) || 'Question: ' || source || chr(10)) AS prompt FROM documents")
def prompt_build(spark, d):
    filled = S.fill_template(PROMPT, context=F.concat("text", F.lit(" {question}")), question=F.col("source"))
    return table(spark, d, "documents").select("doc_id", F.sha2(filled, 256).alias("prompt"))


DISCLAIMER = "This is no legal advice."
QUESTION = "Question:\n{question}\n\nCite a source for each statement.\n"


@_("SELECT conv_id, turn, role = 'user' AS asked, CASE WHEN role = 'user' THEN 'Question:' || chr(10) || text || chr(10) || chr(10) || 'Cite a source for each statement.' || chr(10) ELSE text || chr(10) || chr(10) || 'This is no legal advice.' END AS said FROM conversations")
def answer_messages(spark, d):
    """User turns as the last message to a model, answers with the disclaimer."""
    text = F.col("text")
    said = F.when(F.col("role") == "user", S.user_message(text, QUESTION)["content"]).otherwise(S.with_disclaimer(text, DISCLAIMER))
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("asked"), said.alias("said"))


_HITS = f"SELECT doc_id // 6 AS query_id, doc_id, source, CASE WHEN doc_id % 4 > 0 THEN lang END AS title, {LEVEL_SQL} AS authority FROM documents"


def _sources(spark, d):
    hit = F.struct("doc_id", F.col("source").alias("source_url"), F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("source_title"), level().alias("authority_level"))
    hits = table(spark, d, "documents").groupBy(F.expr("doc_id div 6").alias("query_id")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return hits.select("query_id", S.source_list(F.col("hits")).alias("sources"))


@_(f"SELECT query_id, count(*) AS sources_count, string_agg(coalesce(source, '') || ',' || coalesce(title, '') || ',' || authority, '|' ORDER BY doc_id) AS sources FROM ({_HITS}) GROUP BY query_id")
def source_attribution(spark, d):
    said = F.transform("sources", lambda s: F.concat_ws(",", F.coalesce(s["url"], F.lit("")), F.coalesce(s["title"], F.lit("")), s["authority"]))
    return _sources(spark, d).select("query_id", F.size("sources").cast("long").alias("sources_count"), F.array_join(said, "|").alias("sources"))


@_(f"SELECT query_id, string_agg('[' || coalesce(title, 'Unknown') || ']' || chr(10) || coalesce(source, ''), '|' ORDER BY doc_id) AS contexts FROM ({_HITS}) GROUP BY query_id")
def eval_contexts(spark, d):
    return _sources(spark, d).select("query_id", F.array_join(S.evaluation_contexts(F.col("sources")), "|").alias("contexts"))


@_("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'q' || doc_id ELSE '' END AS corrected, CASE WHEN doc_id % 3 < 2 THEN doc_id % 7 ELSE -1 END AS n FROM documents")
def json_replies(spark, d):
    n = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"corrected": "q'), n, F.lit('", "n": '), (F.col("doc_id") % 7).cast("string"), F.lit("}"))
    reply = F.when(F.col("doc_id") % 3 == 0, body).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).otherwise(F.lit("no object"))
    return table(spark, d, "documents").select("doc_id", S.json_reply(reply, "corrected string, n long").alias("r")).select("doc_id", F.coalesce("r.corrected", F.lit("")).alias("corrected"), F.coalesce("r.n", F.lit(-1)).alias("n"))


@_("SELECT event_id, CASE WHEN event_id % 7 > 0 THEN epoch_us(TIMESTAMP '2024-01-02 03:04:05' + (event_id % 400) * INTERVAL 1 DAY) ELSE -1 END AS micros FROM events")
def iso_timestamps(spark, d):
    day = F.date_format(F.date_add(F.lit("2024-01-02").cast("date"), (F.col("event_id") % 400).cast("int")), "yyyy-MM-dd")
    said = F.when(F.col("event_id") % 7 == 0, F.lit("yesterday")).otherwise(F.concat(day, F.lit("T03:04:05Z")))
    return table(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(S.iso_timestamp(said)), F.lit(-1)).alias("micros"))


@_("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '## Part ' || doc_id ELSE 'General' END AS title FROM documents")
def section_titles(spark, d):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Top\n## Part "), F.col("doc_id").cast("string"), F.lit("\n"))).otherwise("")
    said = F.concat(head, F.lit("body\n"), F.replace("text", F.lit("#"), F.lit("")), F.lit("\n# Later"))
    return table(spark, d, "documents").select("doc_id", T.section_title(said, F.length(head) + 4).alias("title"))


@_("SELECT 'https://a.example/' || page_id AS url FROM pages WHERE page_id % 2 = 0")
def sitemap_index(spark, d):
    """Each page has an index file that names itself and, for even pages, a leaf file; leaf files of odd pages are never reached."""
    n = F.col("page_id").cast("string")
    loc = lambda tag, x: F.concat(F.lit(f"<{tag}><loc> "), x, F.lit(f" </loc></{tag}>"))
    p = table(spark, d, "pages")
    leaf, index = F.concat(F.lit("leaf"), n), F.concat(F.lit("index"), n)
    leaves = p.select(leaf.alias("sitemap"), F.concat(F.lit("<urlset>"), loc("url", F.concat(F.lit("https://a.example/"), n)), F.lit("</urlset>")).alias("xml"))
    named = F.concat(loc("sitemap", index), F.when(F.col("page_id") % 2 == 0, loc("sitemap", leaf)).otherwise(""))
    indexes = p.select(index.alias("sitemap"), F.concat(F.lit("<sitemapindex>"), named, F.lit("</sitemapindex>")).alias("xml"))
    return D.sitemap_closure(leaves.unionByName(indexes), indexes.select("sitemap"))
