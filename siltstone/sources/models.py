"""Pluggable models with deterministic offline defaults: embedder, reranker, generator."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import terms
from .tables import read_table

DIMENSION = 64


class Generator(Protocol):
    def generate(self, system: str, user: str) -> str: ...


class EchoGenerator:
    """Answers with the first line of the context."""

    def generate(self, system: str, user: str) -> str:
        return system.partition("\n")[0] or "No information."


def choose_generator(hosted: Generator | None = None, local: Generator | None = None) -> Generator:
    return hosted or local or EchoGenerator()


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector of hashed term counts: linear in a text's terms, the same on every run. Without terms all are 0; null stays null."""

    @F.arrow_udf("array<float>")
    def unit(slots: pa.Array) -> pa.Array:
        size = slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = np.repeat(np.arange(len(slots)), size) * dimension + slots.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(at, minlength=len(slots) * dimension).reshape(-1, dimension).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(1, keepdims=True))
        vectors = (counts / np.where(norm > 0, norm, 1)).astype(np.float32)
        upto = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * dimension)
        return pa.ListArray.from_arrays(upto, pa.array(vectors.ravel()), mask=slots.is_null())

    return unit(F.transform(terms(text), lambda w: F.pmod(F.xxhash64(w), F.lit(dimension))))


def rerank_scores(hits: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(query_id, idx, rerank_score) of hits(query_id, rank), with a scorer also (query, text); without one the order stays."""
    score = scorer(F.col("query"), F.col("text")) if scorer else 1 / F.col("rank")
    return hits.select("query_id", (F.col("rank") - 1).alias("idx"), score.alias("rerank_score"))


class QuotaExhausted(Exception):
    """What a generator raises when it will answer nothing more."""


ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 1.0, 10.0
ANSWERS = "id long, answer string, error string, wave int"


def _answered(rows: DataFrame, choose: Callable[[], Generator], attempts: int, sleep: Callable[[float], None]) -> DataFrame:
    """(id, answer, error, asked) of rows(id, system, user); after a task's first exhausted quota the rest is not asked."""

    def ask(model: Generator, system: str, user: str) -> tuple[str | None, str | None]:
        wait, error = FIRST_WAIT, ""
        for n in range(attempts):
            try:
                return model.generate(system or "", user or ""), None
            except QuotaExhausted:
                raise
            except Exception as e:  # noqa: BLE001  whatever a client library raises is a row's error
                error = str(e) or type(e).__name__
            if n + 1 < attempts:
                sleep(wait)
                wait = min(2 * wait, LONGEST_WAIT)
        return None, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, closed = choose(), False
        for batch in batches:
            out = []
            for i, system, user in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not closed:
                    try:
                        out.append((i, *ask(model, system, user), True))
                        continue
                    except QuotaExhausted:
                        closed = True
                out.append((i, None, None, False))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate(kinds)], names=["id", "answer", "error", "asked"])

    return rows.select("id", "system", "user").mapInArrow(run, "id long, answer string, error string, asked boolean")


def generate_rows(rows: DataFrame, path: str, choose: Callable[[], Generator] = choose_generator, *, waves: int = 8, attempts: int = ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> dict[str, int]:
    """Asks a generator for each of rows(id, system, user), once an id, and appends ANSWERS to the table at path: counts of answered, failed and skipped.

    Rows are asked in waves, by hash of the id; each wave's answers are committed
    before the next begins. A task stops asking at its first exhausted quota, and
    no wave follows one in which that happened; what was answered stays. A later
    call goes on with the ids that the table does not have; rows that failed are
    asked again then. Null ids are left out.
    """
    spark = rows.sparkSession
    known = read_table(spark, path, ANSWERS).where("error is null").select("id").distinct()
    todo = rows.where("id is not null").dropDuplicates(["id"]).join(known, "id", "left_anti")
    total = todo.count()
    counts = {"answered": 0, "failed": 0}
    for wave in range(waves):
        seen = Observation()
        part = _answered(todo.where(F.pmod(F.xxhash64("id"), F.lit(waves)) == wave), choose, attempts, sleep)
        part = part.observe(seen, F.count_if(F.col("asked") & F.col("error").isNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(~F.col("asked")).alias("closed"))
        part.where("asked").select("id", "answer", "error", F.lit(wave).alias("wave")).write.mode("append").parquet(path)
        for name in counts:
            counts[name] += seen.get[name]
        if seen.get["closed"]:
            break
    return counts | {"skipped": total - sum(counts.values())}
