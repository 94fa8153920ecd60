"""Benchmark decontamination by a prefix-filtered set join.

Each benchmark item is cut into windows of ten consecutive words (shorter items are one window). A window is the set of its 2-word shingles, and since it must be
contained whole, one shingle of it is a necessary prefix: the rarest in the order of corpus counts. The counts of all shingles of all documents are kept in a table of
fixed size (shingles that share a cell share a count, which only blurs the order). A document that holds a prefix shingle at a word
gives the windows that could stand there: their place follows from the shingle's place in the item window (the positional bound), and they must lie within the document (the length bound). What remains
is joined on the prefix shingle, and the window's words themselves are compared, not only their hash.

Two bitmaps of fixed size, of the prefix shingles and of the windows, spare the join most of what it would not match; neither grows with the benchmark, and a fuller one only passes more candidates. Equal windows of several items are
one row of the join with the list of its items, so a window that many items share meets a document once.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import tune, written
from lodestone.llm.sketch import cell_counts, set_bits

WINDOW = 10
#: Cells of the table of counts, and bits of the two bitmaps (2 and 4 MB).
CELLS, FILTER_BITS = 1 << 18, 1 << 25


class Piece(NamedTuple):
    """Rows low to high of a batch of texts: for each word its row (from low), hash, and place in the lower-cased bytes."""

    low: int
    high: int
    row: np.ndarray
    hashed: np.ndarray
    start: np.ndarray
    end: np.ndarray
    folded: np.ndarray

    def words(self, first: np.ndarray, k: np.ndarray) -> list[bytes]:
        """k words from each first one on, a space between."""
        raw, start, end = self.folded.tobytes() if len(first) else b"", self.start.tolist(), self.end.tolist()
        return [b" ".join(raw[start[j] : end[j]] for j in range(i, i + n)) for i, n in zip(first.tolist(), k.tolist(), strict=True)]


def _pieces(column: pa.Array) -> Iterator[Piece]:
    data, offsets = tb.column_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
        part = data[offsets[low] : offsets[high]]
        row, start, end, hashed = tb.words(part, offsets[low : high + 1] - offsets[low], tb.ALNUM)
        yield Piece(low, high, row, hashed, start, end, tb.FOLD[part])
        low = high


def _shingles(hashed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The 2-word shingle that begins at each word; at the last word of a text, the word alone."""
    one = tb.mix(hashed + tb.U64(1))
    at, two = tb.windows(hashed, row, 2)
    out = one.copy()
    out[at] = two
    return out


def shingle_counts(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each cell come in the whole corpus."""
    return cell_counts(docs, lambda column: (_shingles(p.hashed, p.row) for p in _pieces(column)), CELLS)


def item_windows(benchmark: DataFrame, counts: np.ndarray) -> DataFrame:
    """(item_id, k, hash, words, shingle, place): the windows of all items with their rarest shingle and its place in them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch.column(1)):
                row, hashed = piece.row, piece.hashed
                n = np.bincount(row, minlength=piece.high - piece.low)
                shingle = _shingles(hashed, row)
                rank = counts[(shingle % tb.U64(CELLS)).astype(np.int64)]
                for k in sorted({min(int(x), WINDOW) for x in n if x}):
                    at, gram = tb.windows(hashed, row, k)
                    keep = n[row[at]] >= WINDOW if k == WINDOW else n[row[at]] == k
                    at, gram = at[keep], gram[keep]
                    span = max(k - 1, 1)
                    # In a one-word item the shingle is the word; else one of the k-1 pairs.
                    of = tb.mix(hashed + tb.U64(1)) if k == 1 else shingle
                    order = np.stack([rank[at + j] for j in range(span)])
                    place = order.argmin(axis=0)
                    items, size = batch.column(0).take(pa.array(piece.low + row[at])), np.full(len(at), k)
                    yield pa.RecordBatch.from_arrays([items, pa.array(size), pa.array(gram.view(np.int64)), pa.array(piece.words(at, size), pa.binary()), pa.array(of[at + place].view(np.int64)), pa.array(place.astype(np.int64))], names=["item_id", "k", "hash", "words", "shingle", "place"])

    return benchmark.select("item_id", "text").mapInArrow(cut, f"item_id {benchmark.schema['item_id'].dataType.simpleString()}, k long, hash long, words binary, shingle long, place long")


def _bitmap(windows: DataFrame, column: str) -> np.ndarray:
    """Set bits of the hashes of a column, as FILTER_BITS // 8 bytes."""
    return np.frombuffer(set_bits(windows.select(F.expr(f"`{column}` & {FILTER_BITS - 1}").alias("bit")), FILTER_BITS), np.uint8)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & tb.U64(FILTER_BITS - 1)
    return (bits[(at >> tb.U64(3)).astype(np.int64)] >> (at & tb.U64(7)).astype(np.uint8)) & 1 > 0


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents (doc_id, text), benchmark (item_id, text) -> doc_id, n_words, n_hit, item_ids (array), contaminated, spans (word ranges), text_hash (Spark's xxhash64 of the text).

    A document word within any occurrence of an item's window is hit. Null and empty texts have no words; items without words match nothing; every row is judged by its own text, whether its doc_id is null, repeated or
    shared with other texts, and repeated rows come out as often as they went in; texts may be as long as Arrow's strings, a piece is looked at at a time (one that is longer than a piece, whole); equal items are all listed;
    other columns are ignored, whatever their names; an empty table gives no rows, an empty benchmark leaves all clean.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    windows = written(item_windows(benchmark, shingle_counts(docs)), "windows")
    places = sorted((r.k, r.place) for r in windows.select("k", "place").distinct().collect())
    send = spark.sparkContext.broadcast
    prefix, whole = send(_bitmap(windows, "shingle")), send(_bitmap(windows, "hash"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch.column(1)):
                row, hashed, n_rows = piece.row, piece.hashed, piece.high - piece.low
                n = np.bincount(row, minlength=n_rows)
                first = np.cumsum(n) - n
                shingle = _shingles(hashed, row)
                one = tb.mix(hashed + tb.U64(1))
                rare = np.flatnonzero(_in(prefix.value, shingle))
                single = np.flatnonzero(_in(prefix.value, one)) if any(k == 1 for k, _ in places) else rare[:0]
                grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                at, size, key, of = [rare[:0]], [rare[:0]], [hashed[:0]], [hashed[:0]]
                for k, place in places:
                    if k not in grams:
                        begin, gram = tb.windows(hashed, row, k)
                        full, there = np.zeros(len(hashed), tb.U64), np.zeros(len(hashed), bool)
                        full[begin], there[begin] = gram, True
                        grams[k] = full, there
                    full, there = grams[k]
                    start = (single if k == 1 else rare) - place
                    start = start[start >= 0]
                    start = start[there[start]]
                    start = start[_in(whole.value, full[start])]
                    at.append(start)
                    size.append(np.full(len(start), k))
                    key.append(full[start])
                    of.append((one if k == 1 else shingle)[start + place])
                start, k, gram, token = np.concatenate(at), np.concatenate(size), np.concatenate(key), np.concatenate(of)
                order = np.lexsort((k, start))
                start, k, gram, token = start[order], k[order], gram[order], token[order]
                ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[start], minlength=n_rows)))).astype(np.int32))
                values = [pa.array(gram.view(np.int64)), pa.array(start - first[row[start]]), pa.array(k), pa.array(token.view(np.int64)), pa.array(piece.words(start, k), pa.binary())]
                lists = [pa.ListArray.from_arrays(ends, v) for v in values]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.low, n_rows), batch.column(2).slice(piece.low, n_rows), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "text_hash", "n_words", "hash", "start", "k", "shingle", "words"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = written(docs.mapInArrow(probe, f"doc_id {kind}, text_hash long, n_words long, hash array<long>, start array<long>, k array<long>, shingle array<long>, words array<binary>"), "candidates")
    maybe, clean = seen.where(F.size("hash") > 0), seen.where(F.size("hash") == 0)
    each = maybe.select("doc_id", "text_hash", F.explode(F.arrays_zip("hash", "start", "k", "shingle", "words")).alias("c")).select("doc_id", "text_hash", "c.*").distinct()
    listed = windows.groupBy("shingle", "hash", "k", "words").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    matched = each.join(listed, ["shingle", "hash", "k", "words"])
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    found = matched.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("k")).alias("end")))).alias("spans"), items.alias("item_ids"))
    # Spans come in the order of their starts; each adds what lies beyond the end so far.
    hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda acc, s: F.struct((acc.n + F.greatest(F.lit(0).cast("long"), s.end - F.greatest(acc.end, s.start))).alias("n"), F.greatest(acc.end, s.end).alias("end"))).getField("n")
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), "spans", "item_ids", hit.alias("n_hit"))
    out = maybe.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    columns = lambda n_hit, ids, spans: ["doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("item_ids"), (n_hit > 0).alias("contaminated"), spans.alias("spans"), "text_hash"]
    none, zero = F.array().cast(found.schema["item_ids"].dataType), F.lit(0).cast("long")
    nowhere = F.lit(None).cast(found.schema["spans"].dataType)
    return out.select(*columns(F.coalesce("n_hit", zero), F.coalesce("item_ids", none), F.col("spans"))).unionByName(clean.select(*columns(zero, none, nowhere)))
