"""Command line: python -m siltstone.cli ingest | discover | status | compact.

All work on a store, a folder that the executors share. Exit code 1 says
that there was nothing to do or that something failed.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import point_id
from .operators.html import extract_pages
from .session import build_session
from .sources import seeds
from .sources.discover import discovered
from .sources.pages import RATE, fetch_pages
from .sources.tables import ensure_table, read_table
from .streaming.ingest import RUNS, compact, document_state, ingest_batch, next_run, present_chunks

SHOWN_ERRORS = 5
SOURCES = "url string, title string, authority_level string, visa_types array<string>"
PAGES = "doc_id long, url string, title string, authority_level string, visa_types array<string>, status int, html string, error string, fetched_at timestamp, run_id long"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("--store", default="siltstone-store", help="folder of the state tables")
    network = argparse.ArgumentParser(add_help=False)
    network.add_argument("--config", "-c", default="seed_urls.yml", help="seed file")
    network.add_argument("--tasks", type=int, default=4, help="fetches at once")
    network.add_argument("--rate", type=float, default=RATE, help="requests a second, of all tasks together")
    ingest = commands.add_parser("ingest", parents=[shared, network], help="fetch sources and store their chunks")
    ingest.add_argument("--source", "-s", help="one URL instead of the seed file")
    ingest.add_argument("--auto-discover", "-a", action="store_true", help="take the domains of the seed file and find their pages first")
    ingest.add_argument("--force-discover", "-f", action="store_true", help="discover anew, whatever the store keeps")
    ingest.add_argument("--force", action="store_true", help="store documents again whose content is the same")
    discover = commands.add_parser("discover", parents=[shared, network], help="list the URLs that would be fetched")
    discover.add_argument("--domain", "-d", help="one domain instead of the seed file's")
    commands.add_parser("status", parents=[shared], help="counts of the store")
    commands.add_parser("compact", parents=[shared], help="fold the runs of the store into one base")
    return p


def _sources(spark: SparkSession, args: argparse.Namespace, fetching: dict) -> DataFrame:
    if args.source:
        return spark.createDataFrame([(args.source, None, "third_party", ["general"])], SOURCES)
    if args.auto_discover:
        found = discovered(spark, seeds.read_domains(spark, args.config), args.store, args.tasks, F.current_timestamp(), args.force_discover, **fetching)
        return found.select("url", F.lit(None).cast("string").alias("title"), "authority_level", "visa_types")
    return seeds.read_seeds(spark, args.config)


def ingest(spark: SparkSession, args: argparse.Namespace, fetching: dict) -> int:
    """Fetches the sources once, into pages of the run, and takes in those that could be read."""
    sources = _sources(spark, args, fetching).where("url is not null").dropDuplicates(["url"])
    if sources.isEmpty():
        print("No documents to process.")
        return 1
    store = args.store
    for name in ("pages", "runs"):
        ensure_table(spark, f"{store}/{name}")
    run = next_run(spark, store)
    got = sources.join(fetch_pages(sources, args.tasks, **fetching), "url").withColumn("doc_id", point_id(F.sha2("url", 256))).withColumn("run_id", F.lit(run).cast("long"))
    names = [x.split()[0] for x in PAGES.split(", ")]
    got.select(names).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{store}/pages")

    pages = read_table(spark, f"{store}/pages", PAGES).where(F.col("run_id") == run)
    read = extract_pages(pages.where("status = 200 and html is not null"), "doc_id").select("doc_id", F.col("markdown").alias("text"))
    ingest_batch(read, store, run, args.force)  # a page that could not be had leaves its stored chunks as they are
    lost = pages.join(read, "doc_id", "left_anti").groupBy(F.coalesce("error", F.concat(F.lit("No content, status "), F.col("status").cast("string"))).alias("error")).agg(F.count("*").alias("n"))
    totals = read_table(spark, f"{store}/runs", RUNS).where(F.col("run_id") == run).first()
    n_lost = lost.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    print(f"Run {run}\nDocuments: {totals.documents_processed + totals.error_count + n_lost}\nProcessed: {totals.documents_processed}\nFailed: {totals.error_count + n_lost}")
    print(f"Chunks stored: {totals.chunks_ingested}\nChunks skipped: {totals.chunks_skipped}")
    for r in lost.orderBy(F.desc("n"), "error").limit(SHOWN_ERRORS).collect():
        print(f"  {r.n} x {r.error}")
    for error in totals.errors[:SHOWN_ERRORS]:
        print(f"  {error}")
    return 0 if totals.success and not n_lost else 1


def discover(spark: SparkSession, args: argparse.Namespace, fetching: dict) -> int:
    """Prints the URLs by domain; of one domain always found anew, of the seed file's as the store keeps them."""
    domains = spark.createDataFrame([(args.domain,)], "domain string") if args.domain else seeds.read_domains(spark, args.config)
    found = discovered(spark, domains, args.store, args.tasks, F.current_timestamp(), bool(args.domain), **fetching)
    by = found.groupBy("domain").agg(F.count_if(F.col("found") == "sitemap").alias("sitemap"), F.count_if(F.col("found") == "link").alias("link"), F.max("over").alias("over"))
    for r in by.orderBy("domain").toLocalIterator():
        print(f"{r.domain}: {r.sitemap} from sitemaps, {r.link} from links, {r.over} beyond its limit")
    n = 0
    for r in found.orderBy("domain", "rank").toLocalIterator():
        n += 1
        print(f"{r.domain} {r['rank']}. {r.url}")
    print(f"Total: {n}")
    return 0 if n else 1


def status(spark: SparkSession, args: argparse.Namespace, fetching: dict) -> int:
    states = {r.status: r.n for r in document_state(spark, args.store).groupBy("status").agg(F.count("*").alias("n")).collect()}
    print(f"documents: {sum(states.values())}")
    for name, n in sorted(states.items()):
        print(f"documents {name}: {n}")
    print(f"chunks: {present_chunks(spark, args.store).count()}\nruns: {read_table(spark, f'{args.store}/runs', RUNS).count()}")
    return 0


def compact_store(spark: SparkSession, args: argparse.Namespace, fetching: dict) -> int:
    try:
        last = compact(spark, args.store)
    except RuntimeError as e:
        print(e)
        return 1
    print("Nothing to fold." if last is None else f"Folded up to run {last}")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, **fetching) -> int:
    """The exit code. fetching goes to fetch_pages(), as another ``get`` in tests."""
    args = parser().parse_args(argv)
    if args.command in ("ingest", "discover"):
        fetching = {"rate": args.rate} | fetching
    return {"ingest": ingest, "discover": discover, "status": status, "compact": compact_store}[args.command](spark or build_session(), args, fetching)


if __name__ == "__main__":
    sys.exit(main())
