"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a weighted lexicon (words and beginnings of words, with their log-odds in labelled rows), how close its hits stand to
words of the second person, rates of capitals, of punctuation and of obfuscation (letters replaced by digits or signs, and lexicon words that only
show once these are undone). Lexicon, trees and calibration are fitted on separate parts of the labelled rows, so that none judges its own training rows.

Fitting uses at most MAX_LABELLED labelled rows, those with the smallest hashes of their ids (a documented bound), and the MAX_LEXICON entries with the highest log-odds; scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import tune, written

MAX_LABELLED, MAX_LEXICON = 30_000, 20_000
FOLDS = 5
#: An entry of the lexicon is in so many toxic texts at least, and its log-odds are this high.
MIN_TEXTS, MIN_ODDS = 3, 1.5
STRONG_ODDS, NEAR = 3.0, 6
PREFIXES = (4, 5, 6)
TREES, DEPTH, RATE, BINS, LEAF = 80, 3, 0.15, 48, 20.0
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te vous votre ton ta tes usted ustedes ti tú vos vosotros su tus".split()
#: Signs that stand for letters, fixed values.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
FEATURES = ("length", "weight", "density", "strong", "highest", "two_highest", "near_second_person", "second_person", "capitals", "shouted", "exclaimed", "asked", "punctuation", "obfuscated", "unmasked", "stretched")

_leet = tb.FOLD.copy()
for _sign, _letter in LEET.items():
    _leet[ord(_sign)] = ord(_letter)
#: Words for the lexicon, and words in which signs may stand for letters.
_masked = tb.ALNUM.copy()
_masked[[ord(c) for c in LEET]] = True
_upper = tb.word_class((0x41, 0x5A))
_letter = tb.word_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_odd = tb.word_class((0x30, 0x39)) | (_masked & ~tb.ALNUM)
_punctuation = tb.word_class((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))


def word_hash(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return tb.words(raw, np.array([0, len(raw)]), np.ones(256, bool))[3][0]


_second = np.sort(np.array([word_hash(w) for w in SECOND_PERSON], tb.U64))


def entries(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashed: np.ndarray, fold: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lexicon's view of words: (index of the word, hash) for whole words and for their first bytes."""
    out = [(np.arange(len(start)), hashed)]
    for n in PREFIXES:
        at = np.flatnonzero(end - start > n)
        h = np.zeros(len(at), tb.U64)
        for j, p in enumerate(tb.powers(n)):
            h += tb.BYTE[fold[data[start[at] + j]]] * p
        out.append((at, tb.mix(h ^ tb.U64(n << 56))))
    return out


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], 0.0)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tb.column_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def features(column: pa.Array, table: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """texts x FEATURES. An empty text has zeros."""
    out = np.zeros((len(column), len(FEATURES)))
    for low, high, data, offsets in _slices(column):
        n_rows = high - low
        row, start, end, hashed = tb.words(data, offsets, tb.ALNUM)
        n = np.maximum(np.bincount(row, minlength=n_rows), 1)
        weight = np.zeros(len(row))
        for at, key in entries(data, start, end, hashed, tb.FOLD):
            np.maximum.at(weight, at, look_up(key, table, odds))
        strong = weight >= STRONG_ODDS
        second = np.isin(hashed, _second)
        gap = np.concatenate(([0], np.cumsum(second)))
        index = np.arange(len(row))
        first = np.cumsum(np.bincount(row, minlength=n_rows)) - np.bincount(row, minlength=n_rows)
        ends = first + np.bincount(row, minlength=n_rows)
        near = strong & (gap[np.minimum(index + NEAR + 1, ends[row])] - gap[np.maximum(index - NEAR, first[row])] > 0)
        total = lambda x: np.bincount(row, x, minlength=n_rows)
        order = np.lexsort((-weight, row))
        ranked, at_row = weight[order], row[order]
        place = np.arange(len(order)) - first[at_row]
        top = np.zeros((2, n_rows))
        for j in (0, 1):
            top[j, at_row[place == j]] = ranked[place == j]
        size = np.maximum(np.diff(offsets), 1)
        cum = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[offsets])
        upper, odd = _upper[data], _odd[data]
        ups = np.concatenate(([0], np.cumsum(upper)))
        shouted = (ups[end] - ups[start] == end - start) & (end - start > 2)
        m_row, m_start, m_end, m_hash = tb.words(data, offsets, _masked, _leet)
        signs, letters = np.concatenate(([0], np.cumsum(odd))), np.concatenate(([0], np.cumsum(_letter[data])))
        masked = (signs[m_end - 1] - signs[m_start] > 0) & (letters[m_end] - letters[m_start] > 1)
        at = np.flatnonzero(masked)
        shown = np.zeros(len(at))
        for i, key in entries(data, m_start[at], m_end[at], m_hash[at], _leet):
            np.maximum.at(shown, i, look_up(key, table, odds))
        same = np.zeros(len(data))
        same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _letter[data[2:]]
        x = out[low:high]
        x[:, 0] = np.log1p(np.bincount(row, minlength=n_rows))
        x[:, 1], x[:, 2], x[:, 3] = total(weight) / n, total(weight > 0) / n, np.log1p(total(strong))
        x[:, 4], x[:, 5] = top
        x[:, 6], x[:, 7] = total(near) / n, total(second) / n
        x[:, 8], x[:, 9] = cum(upper) / size, total(shouted) / n
        x[:, 10], x[:, 11], x[:, 12] = cum(data == 0x21) / size, cum(data == 0x3F) / size, cum(_punctuation[data]) / size
        x[:, 13], x[:, 14] = np.bincount(m_row, masked, minlength=n_rows) / n, np.bincount(m_row[at], shown >= STRONG_ODDS, minlength=n_rows)
        x[:, 15] = cum(same) / size
    return out


@dataclass
class Trees:
    """Complete trees of one depth: the feature and threshold of each inner node, the value of each leaf."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on binned features, each split by the gain of gradients and hessians."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base, inner, n = float(np.log(p / (1 - p))), 2**DEPTH - 1, x.shape[1]
    margin, all_f, all_t, all_v = np.full(len(x), base), [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-margin))
        grad, hess = y - q, q * (1 - q)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(DEPTH):
            begin, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f in range(n):
                if not len(edges[f]):
                    continue
                cell = (node - begin) * BINS + binned[:, f]
                g = np.cumsum(np.bincount(cell, grad, minlength=width * BINS).reshape(width, BINS), axis=1)
                h = np.cumsum(np.bincount(cell, hess, minlength=width * BINS).reshape(width, BINS), axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = np.where((h > 1e-3) & (ht - h > 1e-3), g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1), 0)[:, : len(edges[f])]
                at = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), at] > best):
                    best[w], feature[begin + w], threshold[begin + w] = gain[w, at[w]], f, edges[f][at[w]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, grad, minlength=2**DEPTH) / (np.bincount(leaf, hess, minlength=2**DEPTH) + 1)
        margin += value[leaf]
        all_f.append(feature)
        all_t.append(threshold)
        all_v.append(value)
    return Trees(base, np.array(all_f), np.array(all_t), np.array(all_v))


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the margins at which steps begin and end, and the calibrated shares there."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, t in zip(margin[order], y[order], strict=True):
        blocks.append([float(t), 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + w, blocks[-1][2], high]
    at = [v for b in blocks for v in (b[2], b[3])]
    share = [(b[0] + 0.5) / (b[1] + 1) if len(blocks) > 1 else b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(at), np.maximum.accumulate(np.array(share))


@dataclass
class Model:
    table: np.ndarray
    odds: np.ndarray
    trees: Trees | None
    at: np.ndarray
    share: np.ndarray
    prior: float

    def score(self, column: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(column), self.prior)
        return np.clip(np.interp(self.trees.margin(features(column, self.table, self.odds)), self.at, self.share), 0, 1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: part 0 is held out and never fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def _count_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, toxic texts, other texts) of each entry."""
    keys, toxic, other = np.zeros(0, tb.U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        y = tb.longs(batch.column(1))
        for low, _, data, offsets in _slices(batch.column(0)):
            row, start, end, hashed = tb.words(data, offsets, tb.ALNUM)
            found = entries(data, start, end, hashed, tb.FOLD)
            r, h = np.concatenate([row[at] for at, _ in found]), np.concatenate([k for _, k in found])
            order = np.lexsort((h, r))
            r, h = r[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
            is_toxic = y[low + r[new]] == 1
            keys, back = np.unique(np.concatenate((keys, h[new])), return_inverse=True)
            toxic = np.bincount(back, np.concatenate((toxic, is_toxic)), minlength=len(keys)).astype(np.int64)
            other = np.bincount(back, np.concatenate((other, ~is_toxic)), minlength=len(keys)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(other)], names=["hash", "toxic", "other"])


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, fold, y, text) of at most max_labelled labelled ids outside part 0, those with the smallest hashes: one text each (of several the one with the least hash), however often its id comes."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).withColumn("fold", fold_of(F.col("doc_id"))).where("fold != 0")
    # At most max_labelled rows of three numbers, so it can be sent to all executors.
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "fold", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return written(rows.select("doc_id", F.col("fold").cast("long").alias("fold"), F.col("y").cast("long").alias("y"), "first.text"), "labelled")


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled rows of parts 1 to 4: the lexicon on 1 and 2, the trees on 3, the calibration on 4.

    What counts is the labelled rows that have a document. Where parts 3 or 4 lack one of the two kinds of label (so for an empty table, or labels without documents) the score is the share of toxic ones among them,
    or among all labels if none has a document (0 without any).
    """
    tune(docs.sparkSession)
    rows = labelled(docs, labels, max_labelled)
    part = {r["fold"]: (r["toxic"], r["n"] - r["toxic"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("toxic")).collect()}
    n, positive = sum(map(sum, part.values())), sum(p[0] for p in part.values())
    none = np.zeros(0, tb.U64), np.zeros(0)
    if any(0 in part.get(k, (0, 0)) for k in (3, 4)):
        prior = positive / n if n else labels.where(fold_of(F.col("doc_id")) != 0).agg(F.avg("toxic")).first()[0] or 0.0
        return Model(*none, None, np.zeros(0), np.zeros(0), float(prior))
    a, b = (part.get(1, (0, 0))[i] + part.get(2, (0, 0))[i] for i in (0, 1))
    counted = rows.where("fold in (1, 2)").select("text", "y").mapInArrow(_count_entries, "hash long, toxic long, other long").groupBy("hash").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (a + 1)) - F.log((F.col("other") + 0.5) / (b + 1))
    lexicon = counted.where(F.col("toxic") >= MIN_TEXTS).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).orderBy(F.desc("odds"), "hash").limit(MAX_LEXICON).collect()
    table, weights = np.array([r.hash for r in lexicon], np.int64).view(tb.U64), np.array([r.odds for r in lexicon])
    order = np.argsort(table)
    table, weights = table[order], weights[order]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0), table, weights)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "fold", "y", "x"])

    # At most max_labelled rows of 16 numbers.
    got = rows.where("fold in (3, 4)").select("text", F.col("doc_id").cast("string"), "fold", "y").mapInArrow(measure, "doc_id string, fold long, y long, x binary").collect()
    got.sort(key=lambda r: r.doc_id)
    x, y, fold = np.array([np.frombuffer(r.x) for r in got]), np.array([r.y for r in got], float), np.array([r.fold for r in got])
    trees = fit_trees(x[fold == 3], y[fold == 3])
    at, share = fit_isotonic(trees.margin(x[fold == 4]), y[fold == 4])
    return Model(table, weights, trees, at, share, positive / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with `score` at their end (a column of that name is replaced); texts that are null or empty are scored as texts without words.

    Texts may be as long as Arrow's strings. Repeated rows and equal texts get equal scores, whatever their ids; an empty table gives no rows.
    """
    docs = docs.drop("score")
    tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.score(batch.column(place)))], names=[*batch.schema.names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(judge, f"{schema}, score double")
