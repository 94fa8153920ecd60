"""Quality rules with risk-controlled thresholds.

Each text gets counts; the base rule rejects texts of too few or too often repeated words. On top of it, one fixed sequence of rules is tested on labelled holdout rows: each step adds a
cutoff of a statistic (beyond which a text is rejected) to all cutoffs before it, statistic by statistic and from lax to strict. In each stratum (language) the exact Clopper-Pearson bound on
the share of good texts that the cutoffs so far reject together must stay below the whole `risk`, at a confidence that is Bonferroni-corrected for the strata alone: a sequence that ends at its
first failure needs no correction for its steps. The last step that passes is used; what comes after a failure is not tried.
The counts for the bounds come from one aggregation over all labelled rows, so no rows are sampled.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import tune, written

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The statistics of a text in the order they are added, and the cutoffs tried, from lax to strict: reject above. The order must not depend on the labels.
CUTOFFS = {
    "symbols_per_word": (2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05),
    "chars_per_word": (30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "dup_lines_per_word": (0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01),
    "repeat_share": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02),
}
#: Of the good texts of a stratum at most so many are rejected by all rules together, at this confidence for all strata at once.
RISK, CONFIDENCE = 0.02, 0.95
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STATS_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def _seen_before(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: does its (row, key) come earlier, and does it come more than once."""
    order = np.lexsort((np.arange(len(row)), key, row))
    same = np.zeros(len(row), bool)
    if len(row):
        same[1:] = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    often = same.copy()
    often[:-1] |= same[1:]
    back = np.empty(len(row), np.int64)
    back[order] = np.arange(len(row))
    return same[back], often[back]


def text_stats(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text of a batch, a piece of texts at a time."""
    data, offsets = tb.column_bytes(column)
    out = [np.zeros(len(column), np.int64) for _ in range(5)]
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
        part, at, n = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], high - low
        row, start, end, hashed = tb.words(part, at, tb.UNSPACED, np.arange(256, dtype=np.uint8))
        lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
        symbols = np.concatenate(([0], np.cumsum(SYMBOLS[part])))
        first, gram = tb.windows(hashed, row, WINDOW)
        _, often = _seen_before(row[first], gram)
        line_row, line_start, line_end, line = tb.words(part, at, tb.LINE, np.arange(256, dtype=np.uint8))
        with_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        again, _ = _seen_before(line_row[with_word], line[with_word])
        out[0][low:high] = tb.per_row(row, n)
        out[1][low:high] = tb.per_row(row, n, lead[end] - lead[start])
        out[2][low:high] = symbols[at[1:]] - symbols[at[:-1]]
        out[3][low:high] = tb.per_row(line_row[with_word][again], n)
        out[4][low:high] = tb.per_row(row[tb.covered(first[often], WINDOW, len(row))], n)
        low = high
    return out


def with_stats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns of `carry`, and the counts of each whole text (null: none)."""
    rows = docs.select(F.col(id_column).alias("doc_id"), *carry, F.col(text_column).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [pa.array(x) for x in text_stats(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *stats], names=[*batch.schema.names[:-1], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])

    return rows.mapInArrow(count, f"{schema}, {STATS_SCHEMA}")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def statistic(name: str) -> Column:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {"symbols_per_word": F.col("n_symbols"), "dup_lines_per_word": F.col("n_dup_lines"), "repeat_share": F.col("n_repeat_words"), "chars_per_word": F.col("word_chars")}[name] / words


def _beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(1 - x, b, a)
    tiny, c = 1e-300, 1.0
    d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws with chance p."""
    return 1.0 if k >= n else _beta(1 - p, n - k, k + 1)


def upper_bound(k: int, n: int, alpha: float) -> float:
    """The exact (Clopper-Pearson) upper bound on a share of which k of n were seen: P(X <= k) falls to alpha there."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if tail(k, n, p) > alpha else (low, p)
    return high


def select_cutoffs(stats: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = RISK, confidence: float = CONFIDENCE, draw: str | None = None) -> DataFrame:
    """(stratum, n_good, cutoffs: a map from statistics to cutoffs), from all labelled rows: one row for each stratum, judged on executors however many there are.

    The bound holds for independent draws, so rows that agree in the column `draw` are one (without it every row is a draw of its own).
    """
    steps: list[dict[str, float]] = []
    for name, cutoffs in CUTOFFS.items():
        for c in cutoffs:
            steps.append({**(steps[-1] if steps else {}), name: c})
    # Each step rejects what the one before it does and more, so the first step that rejects a text tells of all.
    first = F.coalesce(*[F.when(statistic(name) > rules[name], F.lit(i)) for i, rules in enumerate(steps) for name in [list(rules)[-1]]], F.lit(len(steps)))
    rejected = F.array(*[F.sum((F.col("first") <= i).cast("long")) for i in range(len(steps))])
    labelled = stats.where(F.col(good) & ~base_failed())
    draws = labelled.select(F.col(stratum).alias("stratum"), first.alias("first")) if draw is None else labelled.groupBy(F.col(stratum).alias("stratum"), F.col(draw).alias("draw")).agg(F.min(first).alias("first"))
    counts = written(draws.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), rejected.alias("rejected")), "strata")
    alpha = (1 - confidence) / max(1, counts.count())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = []
            for n, failed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last: dict[str, float] = {}
                for rules, k in zip(steps, failed, strict=True):
                    # The bound is above the risk exactly if so few rejections are likelier than alpha at the risk.
                    if tail(k, n, risk) > alpha:
                        break
                    last = rules
                chosen.append(list(last.items()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(chosen, pa.map_(pa.string(), pa.float64()))], names=["stratum", "n_good", "cutoffs"])

    return counts.mapInArrow(judge, "stratum string, n_good long, cutoffs map<string,double>")


def with_passed(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """stats (with stratum) and `passed`: false where a cutoff chosen for the row's stratum is exceeded; a stratum without cutoffs keeps all."""
    limit = lambda name: F.coalesce(F.col("cutoffs").getItem(name), F.lit(float("inf")))
    passed = functools.reduce(lambda a, b: a & b, [statistic(name) <= limit(name) for name in CUTOFFS])
    rows = stats.join(cutoffs.select(F.col("stratum").alias("of"), "cutoffs"), F.col("stratum") == F.col("of"), "left")
    return rows.withColumn("passed", passed).drop("of", "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, confidence: float = CONFIDENCE) -> DataFrame:
    """documents (doc_id, text, lang) and labels (doc_id, quality) -> doc_id, the five counts, base_failed, kept.

    Holdout rows are all labelled ones; quality 1 is good. A null or empty text has no words and fails the base rule; texts may be as long as Arrow's strings; a null lang is a stratum, the same as an empty one; labels that are null or of no
    document are ignored; a document labelled twice is good if any label says so; repeated rows are all judged, but a text counts once in a
    holdout of its stratum, however many rows and ids have it (good if any of them is), as copies are no independent draws; other columns are ignored, whatever their names; empty tables give no rows, and without labels
    only the base rule rejects.
    """
    tune(docs.sparkSession)
    stats = written(with_stats(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("stratum"), F.xxhash64("text").alias("draw")), carry=("stratum", "draw")), "quality")
    good = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    # Written: a small table of known size, which Spark broadcasts only as long as it is small.
    chosen = written(select_cutoffs(stats.join(good, "doc_id").where("good is not null"), risk=risk, confidence=confidence, draw="draw"), "cutoffs")
    judged = with_passed(stats, chosen).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("passed")).drop("stratum", "passed", "draw")
