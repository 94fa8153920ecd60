"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text; where its top bits are zero a chunk may end, so chunks follow the content and an insertion shifts none but its own.
All chunks of all texts are compared by a 128-bit digest: the first (smallest doc_id, then place) stays. A later one goes if it and its
neighbours that are also repeats make up `min_bytes` at least, so that chance repeats of a few words stay where they are.

Digests travel as packed runs to buckets of their hash; a run has each digest once, so a chunk that is in a third of all texts arrives once from each task. Repeats travel home
to their text in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import RUN_SCHEMA, Places, Runs, bring_home, bucket_count, by_bucket, cut_runs, homecoming, join_runs, later_ones, only_kind, run_batch, text_bytes, to_buckets, tune, with_homes

#: Bytes: the shortest and longest chunk, the mean between candidates (a power of two), and the least run of repeats that goes.
#: A candidate counts if the one before it is MIN_CHUNK away, so chunks are 22 bytes long on average: small beside a passage of 50 words. A line that is repeated many times may have no cut at all; the short MAX_CHUNK is for it.
MIN_CHUNK, MAX_CHUNK, MEAN, MIN_BYTES = 8, 48, 16, 64
GEAR = (tb.BYTE >> tb.U64(37)).astype(np.uint16)
_SHIFT = np.uint16(16 - MEAN.bit_length() + 1)
DIGEST = (np.uint64, np.uint64, np.uint32)


def boundaries(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the chunks of all texts (in bytes from the first text on). Every text is covered without gaps."""
    h = GEAR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for step in (1, 2, 4, 8):
        # Sums of twice as many bytes; what lies before the text counts as zero.
        back = np.zeros_like(h)
        back[step:] = h[:-step] << np.uint16(step)
        h = h + np.where(since >= step, back, np.uint16(0))
    cut = np.flatnonzero((h >> _SHIFT) == 0) + 1
    keep = np.ones(len(cut), bool)
    keep[1:] = (np.diff(cut) >= MIN_CHUNK) | (np.diff(np.searchsorted(offsets, cut - 1, "right")) > 0)
    ends = np.unique(np.concatenate((cut[keep], offsets[1:][np.diff(offsets) > 0])))
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    # Longer stretches are cut every MAX_CHUNK bytes from their beginning.
    n = np.maximum(1, -(-(ends - starts) // MAX_CHUNK))
    begin = np.repeat(starts, n) + MAX_CHUNK * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    return begin, np.minimum(begin + MAX_CHUNK, np.repeat(ends, n))


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each chunk's 128-bit hash."""
    view = memoryview(data)
    raw = b"".join([xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    both = np.frombuffer(raw, ">u8").astype(tb.U64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tb.column_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def dedup_substrings(docs: DataFrame, min_bytes: int = MIN_BYTES, keep: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """documents (doc_id, text) -> the columns of `keep`, with text as it stays, then n_bytes, n_removed, n_chunks, n_repeats (chunks that go as repeats).

    Within a text, too, later repeats go. Cuts never part a character: a range that goes is narrowed to whole characters. Null texts are empty and stay empty, null ids come first; repeated rows (equal
    id and text) count as one text and all get its result; of different texts with one doc_id the order is that of a hash; texts that repeat as a whole keep their first copy; long texts are looked at whole, their chunks meet others' one by one; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    size = text_bytes(docs)
    homes, buckets = bucket_count(spark, size), bucket_count(spark, size * 24 / MEAN)
    # Carried columns get names of their own; the text itself is not carried twice.
    texts = with_homes(docs, homes, keep)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(DIGEST)

        def flush() -> Iterator[pa.RecordBatch]:
            known, columns = runs.columns()
            first, later = later_ones(known, columns, 2)
            # Later repeats within the task need no comparison: they go home at once.
            yield run_batch(cut_runs(known, [columns[0][first], *(c[first] for c in columns[1:])], (columns[1][first] % tb.U64(buckets)).astype(np.int64)))
            yield run_batch(cut_runs(known, [columns[0][later], columns[3][later]], known[2][columns[0][later]]), 1)
            runs.clear()

        for batch in batches:
            doc, of, home = (tb.longs(batch.column(j)) for j in (0, 2, 3))
            base = runs.add_texts(doc, of, home)
            for low, _, data, offsets in _slices(batch.column(1)):
                start, end = boundaries(data, offsets)
                row = np.searchsorted(offsets, start, "right") - 1
                runs.add(base + low + row, *digests(data, start, end), start - offsets[row])
            if runs.full:
                yield from flush()
        yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            known, columns = join_runs([r for r in rows.column(2).to_pylist()], DIGEST)
            _, later = later_ones(known, columns, 2)
            yield run_batch(cut_runs(known, [columns[0][later], columns[3][later]], known[2][columns[0][later]]), 1)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = None, Places([], ())
        for runs, batch in homecoming(batches):
            if runs is not held:
                held, places = runs, Places([r for _, r in runs], (np.uint32,))
            doc, of = tb.longs(batch.column(3)), tb.longs(batch.column(5))
            out: list[bytes] = []
            told = np.zeros((4, batch.num_rows), np.int64)
            for low, high, data, offsets in _slices(batch.column(4)):
                start, end = boundaries(data, offsets)
                bounds = np.searchsorted(start, offsets)
                for i in range(high - low):
                    a, b = bounds[i], bounds[i + 1]
                    raw = data[offsets[i] : offsets[i + 1]]
                    s, e = start[a:b] - offsets[i], end[a:b] - offsets[i]
                    found = places.of(int(doc[low + i]), int(of[low + i]))
                    gone = np.zeros(len(raw), bool)
                    if found is not None:
                        repeat = np.isin(s, found[0])
                        edge = np.flatnonzero(np.diff(np.concatenate(([False], repeat, [False]))))
                        for x, y in zip(edge[::2], edge[1::2], strict=True):
                            f, t = int(s[x]), int(e[y - 1])
                            while f < t and raw[f] & 0xC0 == 0x80:
                                f += 1
                            while f < t < len(raw) and raw[t] & 0xC0 == 0x80:
                                t -= 1
                            if t - f >= min_bytes:
                                gone[f:t] = True
                                told[3, low + i] += y - x
                    out.append(raw[~gone].tobytes())
                    told[:3, low + i] = len(raw), gone.sum(), b - a
            told_columns = [*(pa.array(t) for t in told)]
            stays = pa.array(out, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(stays if c == "text" else batch.column(6 + i) for i, c in enumerate(keep)), *told_columns], names=[*keep, "n_bytes", "n_removed", "n_chunks", "n_repeats"])

    made = texts.select("doc_id", "text", "of", "home").mapInArrow(chunk, RUN_SCHEMA)
    # One exchange carries both kinds: digests to the bucket of their hash, what is known already on its way home.
    met = to_buckets(made, buckets).mapInArrow(only_kind(0, compare), RUN_SCHEMA)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return bring_home(texts, met, homes).mapInArrow(strip, f"{schema}, n_bytes long, n_removed long, n_chunks long, n_repeats long")
