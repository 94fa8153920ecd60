"""Exact dedup of 100-byte strings by a distributed, common-prefix-aware merge sort of suffixes.

Sorting all suffixes of all texts would move each byte a hundred times. A sample decides as well: of every 100-byte window the 32-byte string in it with the
smallest hash is its anchor, so equal windows have their anchors at the same place, and only suffixes that begin at anchors need comparing.

1. Each task lists its anchors: hash of the string, hash of the context (all bytes of the windows that the anchor stands for), place. Of anchors with equal contexts a task sends the first; the later ones are
   repeats with all their windows. What is sent meets by the string's hash, which only tells the strings that come once: these repeat nothing. All others are asked for their bytes.
2. Their texts send the suffixes from the anchors on, as sorted, front-coded runs; a loser tree merges the runs of a bucket by what is known of common prefixes (equal suffixes are its cheapest case), and yields what
   neighbours have in common. A window that begins l bytes before its anchor equals an earlier one if the suffixes have 100 - l bytes in common and the l bytes before are equal.
3. What is found goes home to its text and is cut out.

A string that comes from more than HOT tasks' runs is compared by hashes of its single windows instead, which spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import textbytes as tb
from lodestone.llm.exchange import RUN_SCHEMA, Places, Runs, bring_home, bucket_count, by_bucket, cut_runs, free_shuffles, homecoming, join_runs, later_ones, only_kind, pack, run_batch, text_bytes, to_buckets, tune, unpack, with_homes, written
from lodestone.llm.suffixes import LoserTree, front_code, front_decode

WINDOW, GRAM = 100, 32
SPREAD = WINDOW - GRAM + 1
#: Bytes of text that are looked at together; the low bits of a key hold the place in them.
PART, PLACE_BITS = 1 << 19, 20
HOT = 50_000
_BYTE2 = tb.mix(tb.BYTE)
#: hash of the string, hash of the context, place of the anchor, bytes before it, windows less one.
ANCHOR, SENT = (np.uint64, np.uint64, np.uint32, np.uint8, np.uint8), (np.uint32, np.uint32, np.uint8, np.uint8)
SPAN, ASKED, HASHED = 1, 2, 3
SPAN_KINDS = (np.uint32, np.uint32)
ASKED_KINDS = (np.uint32, np.uint8, np.uint8, np.uint32, np.uint8)


def parts(column: pa.Array, part: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """Rows low to high with their bytes and offsets; a long text comes in overlapping parts, of which the last number is the place of the first byte."""
    data, offsets = tb.column_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + part, "right")) - 1)
        begin, end = int(offsets[low]), int(offsets[high])
        if end - begin <= part:
            yield low, high, data[begin:end], offsets[low : high + 1] - begin, 0
        else:
            for at in range(begin, end - WINDOW + 1, part):
                stop = min(at + part + WINDOW - 1, end)
                yield low, high, data[at:stop], np.array([0, stop - at]), at - begin
        low = high


def grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on (those that end within the data), by doubling."""
    h, n = tb.BYTE[data], 1
    while n < GRAM:
        h = h[:-n] * tb.powers(n + 1)[n] + h[n:]
        n *= 2
    return tb.mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: row, hash, place in data, first and last window."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, np.zeros(0, tb.U64), none, none, none
    h = grams(data)
    low = tb.U64((1 << PLACE_BITS) - 1)
    least, n = (h & ~low) | np.arange(len(h), dtype=tb.U64), 1
    while 2 * n <= SPREAD:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    least = np.minimum(least[: len(data) - WINDOW + 1], least[SPREAD - n :][: len(data) - WINDOW + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    window = np.flatnonzero(np.arange(len(least)) + WINDOW <= offsets[1:][row])
    if not len(window):
        return none, np.zeros(0, tb.U64), none, none, none
    at = (least[window] & low).astype(np.int64)
    new = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(window) != 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(window)])) - 1
    return row[window[first]], h[at[first]], at[first], window[first], window[last]


def contexts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate(([tb.U64(0)], np.cumsum(_BYTE2[data] * tb.powers(len(data)))))
    return tb.mix((total[end] - total[start]) * tb.inverse_powers(len(data) + 1)[start])


def equal_windows(common: np.ndarray, left: np.ndarray, before: np.ndarray, least: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of suffixes in order (common: with the one before), which of their windows equal a window of lower rank.

    left: the bytes before each anchor, the nearest first (n x SPREAD - 1); a suffix has windows that begin least to before bytes ahead of it. Returns n x SPREAD booleans."""
    out = np.zeros((len(common), SPREAD), bool)
    hashed = np.zeros(len(common), tb.U64)
    for ahead in range(SPREAD):
        if ahead:
            hashed = hashed * tb.BASE + tb.BYTE[left[:, ahead - 1]]
        at = np.flatnonzero((least <= ahead) & (ahead <= before))
        if len(at) < 2:
            continue
        segment = np.cumsum(common < WINDOW - ahead)[at]
        h, r = tb.mix(hashed[at]), rank[at]
        order = np.lexsort((r, h, segment))
        s, h, r = segment[order], h[order], r[order]
        head = np.maximum.accumulate(np.where(np.concatenate(([True], (s[1:] != s[:-1]) | (h[1:] != h[:-1]))), np.arange(len(at)), 0))
        out[at[order], ahead] = r > r[head]
    return out


def spans_of(flags: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that begin `column` bytes before a place, as (row, start, length) of runs of neighbours."""
    padded = np.zeros((len(flags), SPREAD + 2), np.int8)
    padded[:, 1:-1] = flags
    change = np.diff(padded, axis=1)
    row, begin = np.nonzero(change == 1)
    _, stop = np.nonzero(change == -1)
    return row, place[row] - (stop - 1), WINDOW + (stop - 1 - begin)


def dedup_suffixes(docs: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept (binary): the bytes that stay.

    A byte goes if a 100-byte string covers it that also starts earlier: in a text of smaller doc_id, or earlier in its own. Null texts are empty; repeated rows (equal id and text) count as one text, and each gets its result; of different texts with one
    doc_id the order is that of a hash; null ids come first; an empty table gives no rows; other columns are ignored. Kept bytes need not be whole characters.
    """
    spark = docs.sparkSession
    tune(spark)
    size, part = text_bytes(docs), PART
    homes, buckets = bucket_count(spark, size), bucket_count(spark, size * 2)
    texts = with_homes(docs, homes).select("doc_id", "text", "of", "home")

    def spread(runs: Runs, known: np.ndarray, columns: list[np.ndarray], kind: int, n_keys: int) -> Iterator[pa.RecordBatch]:
        """Firsts of each key to its bucket, later ones home with their spans."""
        first, later = later_ones(known, columns, n_keys)
        sent = [c[first] for c in columns]
        bucket = (sent[1] % tb.U64(buckets)).astype(np.int64)
        if kind != HASHED:
            # Of an anchor's hash what its bucket does not tell, and no context: bytes decide from here on.
            sent = [sent[0], (sent[1] // tb.U64(buckets)).astype(np.uint32), *sent[3:]]
        yield run_batch(cut_runs(known, sent, bucket), kind)
        yield spans_home(known, columns, later, kind)
        runs.clear()

    def spans_home(known: np.ndarray, columns: list[np.ndarray], which: np.ndarray, kind: int) -> pa.RecordBatch:
        text, place = columns[0][which], columns[3][which].astype(np.int64)
        start, n = (place, np.full(len(place), WINDOW)) if kind == HASHED else (place - columns[4][which], columns[5][which].astype(np.int64) + WINDOW)
        return run_batch(cut_runs(known, [text, start.astype(np.uint32), n.astype(np.uint32)], known[2][text]), SPAN)

    def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(ANCHOR)
        for batch in batches:
            base = runs.add_texts(*(tb.longs(batch.column(j)) for j in (0, 2, 3)))
            for low, _, data, offsets, shift in parts(batch.column(1), part):
                row, h, at, first, last = anchors(data, offsets)
                context = contexts(data, first, last + WINDOW) ^ tb.mix(((at - first) * SPREAD + last - first).astype(tb.U64)) if len(at) else h
                runs.add(base + low + row, h, context, at - offsets[row] + shift, at - first, last - first)
            if runs.full:
                yield from spread(runs, *runs.columns(), 0, 2)
        yield from spread(runs, *runs.columns(), 0, 2)

    def ask_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            known, columns = join_runs(rows.column(2).to_pylist(), SENT)
            _, back, n = np.unique(columns[1], return_inverse=True, return_counts=True)
            ask = n[back] > 1
            text, _, place, before, more = (c[ask] for c in columns)
            hot = (n[back][ask] > HOT).astype(np.uint8)
            bucket = np.full(len(text), rows.column(0)[0].as_py(), np.uint32)
            yield run_batch(cut_runs(known, [text, place, before, more, bucket, hot], known[2][text]), ASKED)

    def send_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked = None, Places([], ())
        known: list[tuple[int, int, int]] = []
        found: list[tuple[bytes, int, int, int, int, int, bytes]] = []
        windows = Runs((np.uint64, np.uint64, np.uint32))

        def flush() -> Iterator[pa.RecordBatch]:
            found.sort()
            table = np.array(known, np.int64).reshape(-1, 3).T
            bucket = np.array([f[5] for f in found], np.int64)
            out = []
            for b in np.unique(bucket):
                run = [found[i] for i in np.flatnonzero(bucket == b)]
                used, text = np.unique(np.array([f[1] for f in run]), return_inverse=True)
                shared, lengths, rests = front_code([f[0] for f in run])
                numbers = np.array([f[2:5] for f in run], np.uint32).T
                out.append((int(b), pack(table[:, used], text.astype(np.uint32), shared, lengths, np.frombuffer(rests, np.uint8), numbers, np.frombuffer(b"".join(f[6] for f in run), np.uint8))))
            yield run_batch(out, ASKED)
            found.clear()
            known.clear()

        for runs, batch in homecoming(batches):
            if runs is not held:
                held, asked = runs, Places([r for _, r in runs], ASKED_KINDS)
            doc, of, text_column = tb.longs(batch.column(3)), tb.longs(batch.column(5)), batch.column(4)
            for i in range(batch.num_rows):
                mine = asked.of(int(doc[i]), int(of[i]))
                if mine is None:
                    continue
                raw = text_column[i].as_py().encode()
                home = batch.column(0)[i].as_py()
                known.append((int(doc[i]), int(of[i]), home))
                for place, before, more, bucket, hot in zip(*(c.tolist() for c in mine), strict=True):
                    if hot:
                        data = np.frombuffer(raw, np.uint8, more + WINDOW, place - before)
                        start = np.arange(more + 1)
                        text = windows.add_texts(doc[i : i + 1], of[i : i + 1], np.array([home]))
                        two = contexts(data, start, start + WINDOW)
                        windows.add(np.full(more + 1, text), two, tb.mix(two ^ contexts(data[::-1], more - start, more - start + WINDOW)), place - before + start)
                    else:
                        ahead = raw[place - before : place][::-1]
                        found.append((raw[place : place - before + more + WINDOW], len(known) - 1, place, before, before - more, bucket, ahead.ljust(SPREAD - 1, b"\0")))
            if len(found) > 100_000:
                yield from flush()
            if windows.full:
                yield from spread(windows, *windows.columns(), HASHED, 2)
        yield from flush()
        yield from spread(windows, *windows.columns(), HASHED, 2)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            texts_of, streams, numbers, lefts, which, n = [], [], [], [], [], 0
            for blob in rows.column(2).to_pylist():
                head, text, shared, lengths, rests, three, left = unpack(blob, np.int64, np.uint32, np.uint16, np.uint16, np.uint8, np.uint32, np.uint8)
                texts_of.append(head.reshape(3, -1))
                which.append(text.astype(np.int64) + n)
                n += texts_of[-1].shape[1]
                streams.append(front_decode(shared, lengths, rests.tobytes()))
                numbers.append(three.reshape(3, -1).astype(np.int64))
                lefts.append(left.reshape(-1, SPREAD - 1))
            known, text, (place, before, least), left = np.concatenate(texts_of, axis=1), np.concatenate(which), np.concatenate(numbers, axis=1), np.concatenate(lefts)
            first = np.cumsum([0, *(len(w) for w in which)])
            taken, common, order = [0] * len(streams), [], []
            for shared, run, _ in LoserTree(streams):
                common.append(shared)
                order.append(int(first[run]) + taken[run])
                taken[run] += 1
            order_of = np.array(order, np.int64)
            text, place, before, least, left = text[order_of], place[order_of], before[order_of], least[order_of], left[order_of]
            doc, of = known[0][text], known[1][text]
            sort = np.lexsort((place, of, doc))
            new = (np.diff(doc[sort]) != 0) | (np.diff(of[sort]) != 0) | (np.diff(place[sort]) != 0)
            rank = np.empty(len(sort), np.int64)
            rank[sort] = np.concatenate(([0], np.cumsum(new)))
            row, start, length = spans_of(equal_windows(np.array(common), left, before, least, rank), place)
            yield run_batch(cut_runs(known, [text[row], start.astype(np.uint32), length.astype(np.uint32)], known[2][text[row]]), SPAN)

    def compare_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            known, columns = join_runs(rows.column(2).to_pylist(), (np.uint64, np.uint64, np.uint32))
            _, later = later_ones(known, columns, 2)
            yield spans_home(known, columns, later, HASHED)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spans = None, Places([], ())
        for runs, batch in homecoming(batches):
            if runs is not held:
                held, spans = runs, Places([r for _, r in runs], SPAN_KINDS)
            doc, of = tb.longs(batch.column(3)), tb.longs(batch.column(5))
            data, offsets = tb.column_bytes(batch.column(4))
            told, kept = np.zeros((3, batch.num_rows), np.int64), []
            for i in range(batch.num_rows):
                raw = data[offsets[i] : offsets[i + 1]]
                mine = spans.of(int(doc[i]), int(of[i]))
                told[0, i] = len(raw)
                if mine is not None:
                    gone = tb.covered(mine[0].astype(np.int64), mine[1].astype(np.int64), len(raw))
                    told[1, i], told[2, i] = gone.sum(), np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)
                    raw = raw[~gone]
                kept.append(raw.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(t) for t in told), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    listed = texts.mapInArrow(list_anchors, RUN_SCHEMA)
    # Written, as two later steps read it: the questions, and the repeats that are known by then.
    met = written(to_buckets(listed, buckets).mapInArrow(only_kind(0, ask_repeated), RUN_SCHEMA), "anchors")
    asked = bring_home(texts, met.where(f"kind = {ASKED}"), homes).mapInArrow(send_suffixes, RUN_SCHEMA)
    merged = to_buckets(asked, buckets).mapInArrow(only_kind(ASKED, merge), RUN_SCHEMA).mapInArrow(only_kind(HASHED, compare_windows), RUN_SCHEMA)
    # Written, so that what the merge shuffled can go before the texts move once more.
    spans = met.where(f"kind = {SPAN}").unionByName(written(merged, "spans"))
    free_shuffles(spark)
    return bring_home(texts, spans, homes).mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
