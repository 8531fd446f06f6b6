"""Small driver-side sources: seed files, evaluation sets and reports."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluation import cases

SEED_SCHEMA = "url string, title string, authority_level string, visa_types array<string>"
DOMAIN_SCHEMA = "domain string, seed_paths array<string>, authority_level string, default_visa_types array<string>, max_depth int, max_pages int, use_sitemap boolean"
#: Fixed values.
AUTHORITY_LEVELS = ("official", "semi_official", "third_party")


def _yaml(path: str) -> dict:
    """What a seed file says; nothing, with a warning, of one that cannot be read or is no mapping."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("seed files need a YAML parser") from e
    try:
        with open(path, encoding="utf-8") as f:
            found = yaml.safe_load(f)
    except (OSError, UnicodeDecodeError, yaml.YAMLError) as e:
        warnings.warn(f"seed file {path}: {e}", stacklevel=3)
        return {}
    if found is not None and not isinstance(found, dict):
        warnings.warn(f"seed file {path}: not a mapping", stacklevel=3)
    return found if isinstance(found, dict) else {}


def _rows(entries: list[dict], schema: str) -> list[tuple]:
    names = [part.split()[0] for part in schema.split(", ")]
    return [tuple(e.get(n) for n in names) for e in entries if isinstance(e, dict)]


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """extra_urls of a seed file, else its documents (the older key)."""
    found = _yaml(path)
    return spark.createDataFrame(_rows(found.get("extra_urls") or found.get("documents") or [], SEED_SCHEMA), SEED_SCHEMA)


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(_rows(_yaml(path).get("domains") or [], DOMAIN_SCHEMA), DOMAIN_SCHEMA)


def valid_and_rejected(sources: DataFrame, column: str = "authority_level") -> tuple[DataFrame, DataFrame]:
    """Rows with a known level, and the others."""
    known = F.coalesce(F.col(column).isin(*AUTHORITY_LEVELS), F.lit(False))
    return sources.where(known), sources.where(~known)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(pos, question, ground_truth) of a JSON file with parallel arrays."""
    columns = spark.read.json(path, multiLine=True).select(F.col("questions").alias("question"), F.col("ground_truths").alias("ground_truth"))
    return cases(columns, ["question", "ground_truth"])


def write_report(means: DataFrame, samples: DataFrame, out: str) -> None:
    means.write.mode("overwrite").json(f"{out}/summary")
    samples.write.mode("overwrite").csv(f"{out}/samples", header=True)
