"""Quality rules as a short-circuit cascade.

Documents meet the rules one by one until one rejects them, and what a rule
needs is counted only for those that reach it. The order is chosen from a
sample: each rule's running time and the share it rejects are measured, and
rules run by rejections per second. A document is kept if no rule rejects it,
so the order changes the time only, never a verdict. A report of all base counts
has to make these for every document; there the cascade begins after the base
rule.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, texts_of

#: Fixed values of the contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

SAMPLE_ROWS = 16  # of each partition

_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Facts:
    """A document, and what rules read of it, each counted when it is first asked for."""

    def __init__(self, text: str) -> None:
        self.text = text

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACE)]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return int(repeat_words([self.words])[0])


@dataclass(frozen=True)
class Rule:
    """rejects() says for each of several documents whether it goes."""

    name: str
    rejects: Callable[[list[Facts]], list[bool]]


def _each(rejects: Callable[[Facts], bool]) -> Callable[[list[Facts]], list[bool]]:
    return lambda docs: [rejects(d) for d in docs]


def _few_words(d: Facts) -> bool:
    return d.n_words < MIN_WORDS


def count_repeats(docs: list[Facts]) -> None:
    """n_repeat_words of all the documents at once."""
    for d, n in zip(docs, repeat_words([d.words for d in docs]).tolist(), strict=True):
        d.n_repeat_words = n


def _repeats(docs: list[Facts]) -> list[bool]:
    count_repeats(docs)
    return [100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words for d in docs]


def _symbols(d: Facts) -> bool:
    return 10 * d.n_symbols > 3 * d.n_words


def _word_length(d: Facts) -> bool:
    return d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words


def _dup_lines(d: Facts) -> bool:
    return 10 * d.n_dup_lines > 4 * d.n_lines


def _letters(d: Facts) -> bool:
    return 10 * sum(1 for w in d.words if _LETTER.search(w)) < 6 * d.n_words


def _stutter(d: Facts) -> bool:
    return 10 * sum(a == b for a, b in pairwise(d.words)) > 3 * d.n_words


def _shouting(d: Facts) -> bool:
    upper = len(d.raw) - len(d.raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    lower = len(d.raw) - len(d.raw.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
    return upper > lower and 2 * upper > d.n_words


#: The contract's base rule, in two parts.
BASE = (Rule("few_words", _each(_few_words)), Rule("repeats", _repeats))
RULES = (
    Rule("letters", _each(_letters)),
    Rule("shouting", _each(_shouting)),
    Rule("symbols", _each(_symbols)),
    Rule("dup_lines", _each(_dup_lines)),
    Rule("stutter", _each(_stutter)),
    Rule("word_length", _each(_word_length)),
)


def repeat_words(docs: list[list[bytes]]) -> np.ndarray:
    """Words of each document inside a WINDOW-word window that it holds twice or more."""
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for words in docs for w in words), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(docs)), sizes)
    step, ranks = 1, ids
    while step < WINDOW and len(ranks) > step:  # ranks of 2-, 4- and then 8-word windows: exact, no hashing
        ranks = np.unique(ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:], return_inverse=True)[1]
        step *= 2
    if step < WINDOW or len(ids) < WINDOW:
        return np.zeros(len(docs), np.int64)
    n = len(ids) - WINDOW + 1
    inside = owner[:n] == owner[WINDOW - 1 :]
    _, group, count = np.unique(ranks[:n] * len(docs) + owner[:n], return_inverse=True, return_counts=True)
    own = np.bincount(group[inside], minlength=len(count))
    at = np.flatnonzero(inside & (own[group] > 1))
    edge = np.bincount(at, minlength=len(ids) + 1) - np.bincount(at + WINDOW, minlength=len(ids) + 1)
    covered = np.cumsum(edge)[: len(ids)] > 0
    return np.bincount(owner[covered], minlength=len(docs))


def base_fails(d: Facts) -> bool:
    return _few_words(d) or 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words


def rule_order(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """rules by rejections per second, measured on the first sample_rows documents of each partition, where they are.

    Only seconds and counts reach the driver. A rule is timed with all that it
    has to count, on documents that no rule has read before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, left = [0.0] * len(rules), [0] * len(rules), sample_rows
        for part in small_batches(batches, 16):
            texts = texts_of(part.column(0))[:left]
            left -= len(texts)
            for i, rule in enumerate(rules):
                began = time.perf_counter()
                rejected[i] += sum(rule.rejects([Facts(t) for t in texts]))
                seconds[i] += time.perf_counter() - began
            if not left:
                break  # no further batch is asked for
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rules)), pa.int32()), pa.array(seconds), pa.array(rejected, pa.int64())], names=["rule", "seconds", "rejected"])

    measured = docs.select(text_col).mapInArrow(run, "rule int, seconds double, rejected long").groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    worth = {r.rule: r.rejected / max(r.seconds, 1e-9) for r in measured.collect()}
    return tuple(sorted(rules, key=lambda r: worth.get(rules.index(r), 0.0), reverse=True))


def cascade(docs: list[Facts], rules: tuple[Rule, ...]) -> np.ndarray:
    """Which of the documents no rule rejects; a rule meets only what those before it left."""
    left = np.arange(len(docs))
    for rule in rules:
        if len(left):
            left = left[~np.array(rule.rejects([docs[i] for i in left.tolist()]), bool)]
    kept = np.zeros(len(docs), bool)
    kept[left] = True
    return kept


def _verdicts(texts: list[str], rules: tuple[Rule, ...]) -> Iterator[tuple[Facts, bool, bool]]:
    """(facts, base_failed, kept) of each text, with all base counts."""
    docs = [Facts(t) for t in texts]
    count_repeats(docs)
    failed = [base_fails(d) for d in docs]
    passed = [d for d, f in zip(docs, failed, strict=True) if not f]
    kept = iter(cascade(passed, rules).tolist())
    return ((d, f, not f and next(kept)) for d, f in zip(docs, failed, strict=True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as empty: all counts 0, base_failed true, kept false. The
    id is passed on as it is, null included; repeated rows give repeated
    results; an empty table gives none; other columns of docs are ignored.
    """
    order = rule_order(docs, text_col, rules)
    schema = f"{id_col} {dict(docs.dtypes)[id_col]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = [(d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, kept) for d, failed, kept in _verdicts(texts_of(batch.column(1)), order)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
            names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def keep_by_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs without the rows that the base rule or one of the rules rejects; all columns pass unchanged, whatever their names.

    The base rule's parts are rules of the cascade like the others. Null and
    empty texts go; null ids pass through; repeated rows share their fate; an
    empty table gives none.
    """
    order, at = rule_order(docs, text_col, BASE + rules), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(cascade([Facts(t) for t in texts_of(batch.column(at))], order)))

    return docs.mapInArrow(run, docs.schema)
