"""Quality scores by a regularised quadratic discriminant.

Each text becomes a vector of statistics, transformed to be near normal. Class
means and covariances come from sums that every partition adds up by itself;
covariances are shrunk toward the pooled one and toward a multiple of the
identity. A score is the logistic of the difference of the two Gaussian log
densities, whose Mahalanobis terms use Cholesky factors computed once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, store, texts_of

FOLDS, HELD_OUT_FOLD = 3, 1
TO_POOLED, TO_IDENTITY = 0.1, 0.02

_UPPER, _LOWER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
_MARKS = (b"#*$%&<>", b"|", b"!", b".,", b"?;:()\"'-")
N_FEATURES = 15


def features(text: str) -> list[float]:
    """Transformed statistics of one text; of an empty text all counts are 0."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), len(raw)
    each = [size - len(raw.translate(None, chars)) for chars in (_UPPER, _LOWER, _DIGIT, *_MARKS)]
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    rate = lambda k, of: math.log((k + 0.5) / (of + 1.0))
    packed = len(zlib.compress(raw, 1))
    return [
        math.log1p(n),
        math.log1p(lengths.mean()),
        math.log1p(lengths.std()),
        rate(len(set(words)), n),
        rate(len(lines) - len(set(lines)), len(lines)),
        math.log1p(n / max(1, len(lines))),
        math.log((packed + 8) / (size + 8)),
        math.sqrt(each[0] / (size + 64.0)),
        math.sqrt(each[2] / (size + 64.0)),
        *(math.sqrt(k / (n + 8.0)) for k in each[3:]),
        float((lengths <= 3).mean()) if n else 0.0,
    ]


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors of the shrunk covariances, log determinants and prior log odds."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    whitening: list[np.ndarray]
    log_dets: list[float]
    prior: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        density = []
        for mean, whiten, log_det in zip(self.means, self.whitening, self.log_dets, strict=True):
            y = whiten @ (z - mean).T
            density.append(-0.5 * ((y * y).sum(axis=0) + log_det))
        return density[1] - density[0] + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, not a probability: the log odds are divided by the number of statistics, which keeps 0.5 and the order and spreads the scores."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x) / x.shape[1], -30, 30)))


def _factor(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """(inverse of the Cholesky factor, log determinant)."""
    factor = np.linalg.cholesky(cov)
    return np.linalg.solve(factor, np.eye(len(cov))), 2.0 * float(np.log(np.diag(factor)).sum())


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], d: int = N_FEATURES) -> Discriminant:
    """From each class's count, sum and sum of outer products. A class without rows gets the pooled moments."""
    n = sum(c[0] for c in sums.values())
    total = sum((c[1] for c in sums.values()), np.zeros(d))
    outer = sum((c[2] for c in sums.values()), np.zeros((d, d)))
    centre = total / max(n, 1)
    scale = np.sqrt(np.maximum(np.diag(outer) / max(n, 1) - centre**2, 1e-6))
    means, within, counts = [], [], []
    for label in (0, 1):
        c, s, o = sums.get(label, (0.0, np.zeros(d), np.zeros((d, d))))
        counts.append(c)
        mean = s / c if c else centre
        cov = o / c - np.outer(mean, mean) if c else np.diag(scale**2)
        means.append((mean - centre) / scale)
        within.append(cov / np.outer(scale, scale))
    weight = max(sum(counts), 1.0)
    pooled = sum(c * v for c, v in zip(counts, within, strict=True)) / weight if sum(counts) else np.eye(d)
    factors, dets = [], []
    for c, cov in zip(counts, within, strict=True):
        pull = min(1.0, TO_POOLED + d / (c + d))  # small classes lean on the pooled covariance
        mixed = (1 - pull) * cov + pull * pooled
        mixed = (1 - TO_IDENTITY) * mixed + TO_IDENTITY * max(np.trace(mixed) / d, 1e-3) * np.eye(d)
        factor, det = _factor(mixed)
        factors.append(factor)
        dets.append(det)
    return Discriminant(centre, scale, means, factors, dets, math.log((counts[1] + 1) / (counts[0] + 1)))


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments of rows(label, x) by label; partitions send sums, and Spark adds those up."""
    d = N_FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros((d + 1, d + 1)), 1: np.zeros((d + 1, d + 1))}
        for batch in batches:
            label = np.asarray(batch.column(0))
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            x = np.hstack([np.ones((len(x), 1)), x])
            for k, t in total.items():
                t += x[label == k].T @ x[label == k]
        at = np.arange((d + 1) ** 2)
        for k, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(t.ravel())], names=["label", "at", "v"])

    out = {}
    sums = rows.mapInArrow(run, "label long, at long, v double").groupBy("label", "at").agg(F.sum("v").alias("v"))
    for r in sums.collect():  # two square matrices, whatever the input
        out.setdefault(r.label, np.zeros((d + 1) ** 2))[r.at] = r.v
    square = {k: v.reshape(d + 1, d + 1) for k, v in out.items()}
    return {k: (v[0, 0], v[0, 1:], v[1:, 1:]) for k, v in square.items() if v[0, 0] > 0}


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted.

    Only labelled rows whose crc32(id as text) mod 3 is not 1 train; all of them
    do. Null texts count as empty and get a score too. Null ids are never
    trained on and not held out. Labels other than 0 and 1, and null labels, are
    left out; an id labelled more than once counts once for each label row.
    Without labels all scores are 0.5. Repeated rows give repeated results, an
    empty table none; other columns of docs and labels are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = np.array([features(t) for t in texts_of(batch.column(1))], dtype=np.float64).reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * N_FEATURES), pa.array(x))], names=[id_col, "x"])

    measured, _ = store(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"{id_col} {kind}, x array<double>"), "features")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))
    known = labels.select(F.col(id_col), F.col(label_col).cast("long").alias("label")).where(F.col("label").isin(0, 1) & ~held)
    model = fit(class_sums(measured.join(known, id_col).select("label", "x")))

    def run_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, N_FEATURES)
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"])

    return measured.select(id_col, held.alias("held_out"), "x").mapInArrow(run_scores, f"{id_col} {kind}, held_out boolean, score double, predicted int")
