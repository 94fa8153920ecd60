"""N-gram Jaccard join by vertical partitioning, down to components of linked documents.

A document is its set of distinct shingles of k words (fewer words: the one of all), in one global order: rarer cells of a corpus-wide count table of fixed size first, then by hash.

1. Documents with equal sets are one node. Two linked nodes share a shingle among the first n - ceil(t n) + 1 of each (the prefix filter), and mostly many: the more equal their sizes, the more of
   their prefixes must agree. So nodes meet at their prefix shingles, sizes and places rule pairs out early, and of the rest only those that meet often enough are verified.
   At each shingle all nodes are first paired with the least only.
2. Of the pairs those whose wide parity sketches, of a bit or two for each shingle, differ in no more bits than linked sets have different elements are verified by vertical partitioning: the global order of hashes is cut into fragments; in each fragment a member's part of its set is counted against the part of its partner, and the partial overlaps are summed for each pair.
3. The links give components. Each node joins the family of the least node that it meets at all; in a family, a node is paired with the few of other components whose parity sketches are nearest to its own and with a few more that its hash picks; these pairs are verified
   likewise. Large families of near copies are one component then, or nearly.
4. All other pairs that met often enough, are in different components still, and whose sketches differ in no more bits than linked sets have different elements, are verified in the same way; pairs within one component are connected already and can change nothing.
   So no link is lost, and a family of near copies costs a few pairs for each member, not one for each two.

Large groups are dealt to many tasks: a group that meets at one shingle by blocks of its members, of which only those outside its main component visit the others; the members of one leader by a salt of their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.components import connected_components
from lodestone.llm.exchange import bucket_count, by_bucket, pack, text_bytes, to_buckets, tune, unpack, written
from lodestone.llm.sketch import set_bits, signed_counts

CELLS, FRAGMENTS = 1 << 21, 6
#: The bitmap of documents to verify has two to the power of this many bits.
ASKED_BITS = 25
#: Bits of a set's parity sketch, and the most of its wide one, which has one bit or two for each shingle.
SKETCH, WIDE = 512, 1 << 16
#: Of step 3: partners by sketch and by hash; rows that are looked at together, and their bytes; cells up to this size are paired all at once, groups up to the next size have short sketches only; members of a group in one block at least; partners of a leader in one task.
NEAREST, PICKED, CHUNK, CHUNK_BYTES, SMALL, FEW, LARGE, FAMILY = 2, 3, 200_000, 32 << 20, 48, 8, 256, 256
META, TOKENS, PAIR, MEMBER = 0, 1, 2, 3
ROW = "bucket int, kind int, run binary, a long, b long, c long, d long, e long"
PAIRS = "a long, b long, n long, m long, times long"
#: Of the key of a shingle: the bits above hold how common its cell is.
LEVEL_BITS = 6


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a batch: first row, end row, and the rows (from the first) and hashes of shingles, repeats included."""
    data, offsets = tb.column_bytes(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + tb.PIECE, "right")) - 1)
        row, _, _, hashed = tb.words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tb.UNSPACED)
        n = np.bincount(row, minlength=high - low)
        at, gram = tb.windows(hashed, row, k)
        rows, grams = [row[at]], [gram]
        for size in range(1, k):
            if (n == size).any():
                first, short = tb.windows(hashed, row, size)
                whole = n[row[first]] == size
                rows.append(row[first][whole])
                grams.append(short[whole])
        yield low, high, np.concatenate(rows), np.concatenate(grams)
        low = high


def levels(counts: np.ndarray) -> np.ndarray:
    """How common the shingles of each cell are, for both signs that they may have in it: two levels for each doubling."""
    both = np.maximum(np.stack([counts, -counts], axis=1), 0).ravel()
    return np.minimum(2 * np.log2(both + 1), 2**LEVEL_BITS - 1).astype(np.uint8)


def ordered_sets(row: np.ndarray, gram: np.ndarray, n_rows: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in the global order, row after row: row, key, set sizes, and a hash of each set."""
    key = (level[(gram % tb.U64(len(level))).astype(np.int64)].astype(tb.U64) << tb.U64(64 - LEVEL_BITS)) | (gram >> tb.U64(LEVEL_BITS))
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    row, key = row[new], key[new]
    n = np.bincount(row, minlength=n_rows)
    node = np.zeros(n_rows, tb.U64)
    if len(row):
        total = np.add.reduceat(tb.mix(key), (np.cumsum(n) - n)[n > 0])
        node[n > 0] = tb.mix(total + n[n > 0].astype(tb.U64))
    return row, key, n, node


def parity_sketches(row: np.ndarray, key: np.ndarray, n_rows: int) -> list[bytes]:
    """For each set the parity of how many of its keys fall on each of SKETCH bits. Two sketches differ in no more bits than the sets have different elements."""
    bit = (tb.mix(key ^ tb.U64(SKETCH)) % tb.U64(SKETCH)).astype(np.int64)
    odd = np.bincount(row * SKETCH + bit, minlength=n_rows * SKETCH).reshape(n_rows, SKETCH) & 1
    return [r.tobytes() for r in np.packbits(odd.astype(np.uint8), axis=1)]


def wide_sketches(row: np.ndarray, key: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Parity sketches of a power of two of bits each, as many as the set has keys at least, but SKETCH to WIDE. Where bit i and bit i + half fall together, a sketch has half the size."""
    size = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), SKETCH, WIDE)
    end = np.cumsum(size)
    bit = (tb.mix(key ^ tb.U64(SKETCH)) & (size[row] - 1).astype(tb.U64)).astype(np.int64)
    odd = np.bincount((end - size)[row] + bit, minlength=int(end[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[e - s : e] for s, e in zip((size // 8).tolist(), (end // 8).tolist(), strict=True)]


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of `size` bytes."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def bits_apart(a: bytes, b: bytes) -> int:
    """In how many bits two wide sketches differ, at the size of the smaller: never more than the elements in which their sets do."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(np.frombuffer(a, np.uint8), size) ^ folded(np.frombuffer(b, np.uint8), size)).sum(dtype=np.int64))


class Sketches:
    """Sketches of several sizes side by side. Those of short sets, or of small groups, have SKETCH bits."""

    def __init__(self, sketches: list[bytes]):
        self.sizes = np.fromiter(map(len, sketches), np.int64, len(sketches))
        #: By size in bytes: all sketches of that size at least, folded to it, and where each row's is.
        self.folds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        of_size = {s: np.frombuffer(b"".join(x for x in sketches if len(x) == s), tb.U64).reshape(-1, s // 8) for s in np.unique(self.sizes).tolist()}
        at, folds = np.zeros(len(sketches), np.int64), []
        for s in sorted({SKETCH // 8, *of_size}, reverse=True):
            # The larger ones stand first, in the order in which they came.
            folds = [np.bitwise_xor.reduce(f.reshape(len(f), -1, s // 8), axis=1) for f in folds] + ([of_size[s]] if s in of_size else [])
            mine = self.sizes == s
            at[mine] = sum(map(len, folds)) - int(mine.sum()) + np.arange(int(mine.sum()))
            self.folds[s] = (np.concatenate(folds) if folds else np.zeros((0, s // 8), tb.U64)), at

    def apart(self, x: np.ndarray, y: np.ndarray, size: int = SKETCH // 8) -> np.ndarray:
        """In how many bits x and y differ, folded to `size` bytes; some MB of them are looked at together."""
        rows, at = self.folds[size]
        step = max(1, (64 << 20) // size)
        return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(rows[at[x[i : i + step]]] ^ rows[at[y[i : i + step]]]).sum(axis=1, dtype=np.int64) for i in range(0, len(x), step))])

    def within(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs differ in no more bits than `most`, at SKETCH bits and at the size of the smaller; and in how many those do."""
        apart = self.apart(x, y)
        keep = np.flatnonzero(apart <= most)
        apart, smaller = apart[keep], np.minimum(self.sizes[x[keep]], self.sizes[y[keep]])
        for size in np.unique(smaller[smaller > SKETCH // 8]).tolist():
            its = np.flatnonzero(smaller == size)
            apart[its] = self.apart(x[keep[its]], y[keep[its]], size)
        near = apart <= most[keep]
        return keep[near], apart[near]


def may_link(n: np.ndarray, i: np.ndarray, m: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Sets of n and m shingles that share their i-th and j-th: can their overlap be large enough."""
    need = -(-percent * (n + m) // (100 + percent))
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1 >= need)


def least_meetings(n, m, percent: int):
    """How many shingles are in the prefixes of both sets at least, if the sets of n and m link.

    Of their o common shingles the j-th stands at most n - o + j - 1 places from the beginning of the one, m - o + j - 1 of the other, and so within both prefixes for small j."""
    need = -(-percent * (n + m) // (100 + percent))
    prefix = lambda x: x + percent * x // -100 + 1  # noqa: E731  x - ceil(percent x / 100) + 1
    return np.maximum(1, np.minimum(prefix(n) - (n - need), prefix(m) - (m - need)))


def count_pairs(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> list[np.ndarray]:
    """Distinct pairs (a, b, n, m) and how often each came."""
    order = np.lexsort((b, a))
    a, b, n, m = a[order], b[order], n[order], m[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    return [a[new], b[new], n[new], m[new], np.diff(np.append(new, len(a)))]


def _rows(kind: int, bucket: np.ndarray | None, *columns: np.ndarray, runs: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(columns[0]) if columns else len(runs)
    longs = [pa.array(c.astype(np.int64)) for c in columns] + [pa.nulls(n, pa.int64())] * (5 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n) if bucket is None else bucket, pa.int32(), safe=False), pa.array(np.full(n, kind, np.int32)), pa.array(runs, pa.binary()) if runs is not None else pa.nulls(n, pa.binary()), *longs], names=["bucket", "kind", "run", "a", "b", "c", "d", "e"])


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of equal keys that have two members at least."""
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    end = np.append(begin[1:], len(key)) if len(key) else begin
    two = end - begin > 1
    return begin[two], end[two]


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, int]]:
    """Rows in the order of token and block, home rows first -> tables of many whole cells (rows of one token and block); or parts of one large cell, each with all its home rows. The number tells how many rows at the
    beginning have been visitors already. So a task holds some CHUNK rows, or CHUNK_BYTES, and the home rows of one cell."""
    held: list[pa.RecordBatch] = []
    old = old_bytes = 0
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) - old < CHUNK and sum(b.nbytes for b in held) - old_bytes < CHUNK_BYTES:
            continue
        rows = pa.Table.from_batches(held)
        token, block = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        changes = np.flatnonzero((token[1:] != token[:-1]) | (block[1:] != block[:-1])) + 1
        if len(changes):
            last = int(changes[-1])
            yield rows.slice(0, last), old
            held, old, old_bytes = rows.slice(last).combine_chunks().to_batches(), 0, 0
        else:
            yield rows, old
            held = rows.filter(rows.column("home")).combine_chunks().to_batches()
            old, old_bytes = sum(b.num_rows for b in held), sum(b.nbytes for b in held)
    if sum(b.num_rows for b in held) > old:
        yield pa.Table.from_batches(held), old


def small_pairs(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within groups of up to SMALL members, some groups at a time."""
    small = end - begin <= SMALL
    begin, end = begin[small], end[small]
    many = np.cumsum((end - begin) * (end - begin - 1) // 2) >> 20
    for k in np.unique(many):
        b, e = begin[many == k], end[many == k]
        size = e - b
        first = np.repeat(b, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        after = np.repeat(e, size) - first - 1
        x = np.repeat(first, after)
        yield x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(after) - after, after)


def large_pairs(begin: np.ndarray, end: np.ndarray, part: np.ndarray, node: np.ndarray, outside: np.ndarray, home: np.ndarray, old: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs across components within larger cells, a visitor at a time: a row outside its group's main component meets the home rows, of which those that are outside too only if their node is larger."""
    for b, e in zip(begin.tolist(), end.tolist(), strict=True):
        hosts = b + np.flatnonzero(home[b:e])
        for i in range(max(b, old if b == 0 else b), e):
            if outside[i]:
                y = hosts[(part[hosts] != part[i]) & (~outside[hosts] | (node[hosts] > node[i]))]
                yield np.full(len(y), i), y


def some_of_each(x: np.ndarray, y: np.ndarray, apart: np.ndarray, node: np.ndarray, ends: int = 2) -> np.ndarray:
    """For each end (or each first one) the NEAREST pairs by sketch and PICKED ones by a hash that both ends know."""
    picked = tb.mix(node[x].view(tb.U64) ^ node[y].view(tb.U64))
    keep = np.zeros(len(x), bool)
    for end in (x, y)[:ends]:
        for score, most in ((apart, NEAREST), (picked, PICKED)):
            order = np.lexsort((score, end))
            first = np.concatenate(([True], np.diff(end[order]) != 0))
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            keep[order[rank < most]] = True
    return keep


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_shingles, component_id: the least doc_id that links of Jaccard >= percent / 100 lead to.

    Words are what white space ends, with A-Z lowered. Texts that are null or have no words have no shingles and are linked with nothing, nor is a row without doc_id (its component is null). Repeated rows come out as often as they
    went in; rows of one doc_id with different texts share its component if any is linked; texts may be as long as Arrow's strings; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = bucket_count(spark, text_bytes(docs) * 0.8)
    level = levels(signed_counts(docs, lambda column: (gram for *_, gram in shingle_sets(column, k)), CELLS))

    def list_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            records = np.concatenate(held, axis=1) if held else np.zeros((3, 0), np.int64)
            held.clear()
            order = np.lexsort((records[1], records[0]))
            records = records[:, order]
            new = np.ones(len(order), bool)
            new[1:] = (records[0, 1:] != records[0, :-1]) | (records[1, 1:] != records[1, :-1])
            records = records[:, new]
            bucket = (tb.mix(records[0].view(tb.U64)) % tb.U64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, records = bucket[order], records[:, order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
            runs = [pack(records[0, a:b], records[1, a:b], records[2, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield _rows(TOKENS, bucket[cuts[:-1]] if cuts else None, runs=runs)

        for batch in batches:
            doc = tb.longs(batch.column(0))
            known = np.asarray(batch.column(0).is_valid())
            for low, high, row, gram in shingle_sets(batch.column(1), k):
                row, key, n, node = ordered_sets(row, gram, high - low, level)
                # Nothing meets these rows, so they spread evenly, copies too.
                yield _rows(META, np.arange(low, high) % buckets, doc[low:high], n, node.view(np.int64), known[low:high], runs=[s + w if len(w) > len(s) else s for s, w in zip(parity_sketches(row, key, high - low), wide_sketches(row, key, n), strict=True)])
                place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
                use = (place <= n[row] - -(-percent * n[row] // 100)) & known[low:high][row]
                # Size and place in one number: both are below 2**31.
                held.append(np.stack([key[use].view(np.int64), node[row[use]].view(np.int64), n[row[use]] << 32 | place[use]]))
            if sum(h.nbytes for h in held) > 20 << 20:
                yield from flush()
        yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            kind = rows.column("kind").to_numpy()
            yield from rows.filter(pa.array(kind != TOKENS)).combine_chunks().to_batches()
            blobs = rows.filter(pa.array(kind == TOKENS)).column("run").to_pylist()
            if not blobs:
                continue
            token, node, both = (np.concatenate(c) for c in zip(*(unpack(b, np.int64, np.int64, np.int64) for b in blobs), strict=True))
            order = np.lexsort((node, token))
            token, node, both = token[order], node[order], both[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, place = token[new], node[new], both[new] >> 32, both[new] & 0xFFFFFFFF
            begin, end = _groups(token)
            size = end - begin
            inside = np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            first = np.repeat(begin, size)
            link = (inside > first) & may_link(n[first], place[first], n[inside], place[inside], percent)
            x, y = first[link], inside[link]
            yield _rows(PAIR, None, *count_pairs(node[x], node[y], n[x], n[y]))
            yield _rows(MEMBER, None, token[inside], node[inside], n[inside], place[inside], node[first])

    def across(few: bool):
        """From cells (token, block, node, n, place, component, sketch, outside, home): pairs across components that may link, and how often each came. With few, only some for each node."""

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def flush() -> Iterator[pa.RecordBatch]:
                found = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
                held.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in count_pairs(*found)], names=["a", "b", "n", "m", "times"])

            for rows, old in cells(batches):
                token, block, node, n, place, part = (rows.column(j).to_numpy() for j in range(6))
                sketches = Sketches(rows.column(6).to_pylist())
                outside, home = (np.asarray(rows.column(j).combine_chunks()) for j in (7, 8))
                begin = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (block[1:] != block[:-1]))))
                end = np.append(begin[1:], len(token))
                small = (end - begin <= SMALL) & ((begin > 0) | (old == 0))
                # Pairs of a small cell come together, those of a large one by their visitor: only then has each end all its own.
                for x, y, ends in chain(((x, y, 2) for x, y in small_pairs(begin[small], end[small])), ((x, y, 1) for x, y in large_pairs(begin[~small], end[~small], part, node, outside, home, old))):
                    keep = (part[x] != part[y]) & may_link(n[x], place[x], n[y], place[y], percent)
                    x, y = x[keep], y[keep]
                    keep, apart = sketches.within(x, y, n[x] + n[y] - 2 * -(-percent * (n[x] + n[y]) // (100 + percent)))
                    x, y = x[keep], y[keep]
                    if few and len(x):
                        keep = some_of_each(x, y, apart, node, ends)
                        x, y = x[keep], y[keep]
                    swap = node[x] > node[y]
                    x, y = np.where(swap, y, x), np.where(swap, x, y)
                    held.append(np.stack([node[x], node[y], n[x], n[y]]))
                    if sum(h.shape[1] for h in held) > 1 << 19:
                        yield from flush()
            yield from flush()

        return pairs

    def groups(rows: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
        """The cells of groups (token, node, n, place) with more than one component: a group of more than LARGE is dealt to blocks, its home rows to one each, and those outside the main component to all (with few, to their own)."""
        rows = written(rows.join(parts, "node").select("token", "node", "n", "place", "component"), "groups")
        of_part = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
        # Written, so that a skewed join with it is split.
        mixed = written(of_part.groupBy("token").agg(F.sum("size").alias("size"), F.max_by("component", F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").drop("parts"), "mixed")
        # Blocks grow with the root of the group, as copies of visitors do.
        blocks = F.ceil(F.col("size") / F.greatest(F.lit(LARGE), 4 * F.sqrt("size"))).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        met = rows.join(mixed, "token").select("token", "node", "n", "place", "component", own.alias("own"), blocks.alias("blocks"), (F.col("component") != F.col("main")).alias("outside"), (F.col("size") > FEW).alias("large"))
        all_blocks = F.array("own") if few else F.when(F.col("outside") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
        # In a large group long sets, which fill the short sketch, would pass as links two by two; in a small one they make few pairs.
        met = met.join(reps.select("node", "sketch", "wide"), "node").select("*", F.explode(all_blocks).alias("block")).withColumn("sketch", F.when(F.col("large"), F.col("wide")).otherwise(F.col("sketch")))
        met = met.select("token", "block", "node", "n", "place", "component", "sketch", "outside", (F.col("block") == F.col("own")).alias("home"))
        return met.repartition(buckets, "token", "block").sortWithinPartitions("token", "block", F.desc("home"), "node")

    def cut_fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_pylist()
            for low, high, row, gram in shingle_sets(batch.column(1), k):
                row, key, n, node = ordered_sets(row, gram, high - low, level)
                # Fragments are ranges of the hash part of the order.
                part = ((key << tb.U64(LEVEL_BITS)) >> tb.U64(40)).astype(np.int64) * FRAGMENTS >> 24
                # Within a pair of documents 40 more bits of the hash tell its shingles apart.
                key = ((key << tb.U64(LEVEL_BITS)) >> tb.U64(LEVEL_BITS + 2)) & tb.U64((1 << 40) - 1)
                order = np.lexsort((key, part, row))
                row, key, part = row[order], key[order], part[order]
                packed = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :5])
                out: list[tuple[int, int, int, int, int, bytes]] = []
                begin = np.cumsum(n) - n
                for i in range(high - low):
                    mine = part[begin[i] : begin[i] + n[i]]
                    me = int(node[i : i + 1].view(np.int64)[0])
                    leaders = sorted({(x["leader"], x["salt"]) for x in asked[low + i] if x["node"] == me})
                    if not leaders:
                        continue
                    at = begin[i] + np.searchsorted(mine, np.arange(FRAGMENTS + 1))
                    for f in range(FRAGMENTS):
                        blob = packed[at[f] : at[f + 1]].tobytes()
                        out += [(leader, f, salt, int(leader != me), me, int(n[i]), blob) for leader, salt in leaders]
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["leader", "f", "salt", "role", "node", "n", "part"])

    def count_overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, size, last = None, np.zeros(0, tb.U64), 0, None
        for batch in batches:
            leaders, fs, salts, roles, nodes, ns = (batch.column(j).to_numpy() for j in range(6))
            out: list[tuple[int, int, int, int, int]] = []
            for i in range(batch.num_rows):
                here = leaders[i], fs[i], salts[i]
                if (*here, roles[i], nodes[i]) == last:
                    continue
                last = (*here, roles[i], nodes[i])
                five = np.frombuffer(batch.column(6)[i].as_buffer(), np.uint8).reshape(-1, 5)
                wide = np.zeros((len(five), 8), np.uint8)
                wide[:, :5] = five
                part = wide.view(tb.U64)[:, 0]
                if roles[i] == 0:
                    now, whole, size = here, part, ns[i]
                elif now == here and len(part) and len(whole):
                    shared = np.count_nonzero(whole[np.minimum(np.searchsorted(whole, part), len(whole) - 1)] == part)
                    if shared:
                        out.append((leaders[i], nodes[i], size, ns[i], shared))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n", "m", "shared"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            apart = np.array([bits_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
            keep = pa.array(apart <= n + m - 2 * -(-percent * (n + m) // (100 + percent)))
            yield batch.select([0, 1]).filter(keep)

    def plausible(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose wide sketches let them link: of long texts, which fill the short sketch, few others are left to verify."""
        side = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "wide_a", "wide_b")
        return written(both.mapInArrow(near, "a long, b long"), "near")

    def verify(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of nodes. The pairs of one leader a that has many are dealt to several tasks, each with the leader's own fragments."""
        many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > FAMILY)
        salts = F.coalesce(F.ceil(F.col("size") / F.greatest(F.lit(FAMILY), F.sqrt("size"))), F.lit(1)).cast("int")
        salted = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), salts).cast("int").alias("salt"))
        asks = salted.select(F.col("b").alias("node"), F.col("a").alias("leader"), "salt").unionByName(salted.select(F.col("a").alias("node"), F.col("a").alias("leader"), "salt")).distinct()
        of_doc = asks.join(reps.select("node", "doc_id"), "node").groupBy("doc_id").agg(F.collect_list(F.struct("node", "leader", "salt")).alias("asks"))
        of_doc = written(of_doc, "asks")
        # Only these texts are shuffled, and few others.
        bits = np.frombuffer(set_bits(of_doc.select(F.col("doc_id").bitwiseXOR(F.shiftright("doc_id", ASKED_BITS)).bitwiseAND((1 << ASKED_BITS) - 1).alias("bit")), 1 << ASKED_BITS), np.uint8)

        def asked_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                doc = tb.longs(batch.column(0))
                at = (doc ^ doc >> ASKED_BITS) & ((1 << ASKED_BITS) - 1)
                yield batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1))

        # Dealt out before they are joined: were both steps in one task, each would have a Python worker, and executors keep them all for later tasks.
        asked = docs.mapInArrow(asked_only, "doc_id long, text string").repartition(buckets, "doc_id")
        parts = asked.join(of_doc, "doc_id").select("doc_id", "text", "asks").mapInArrow(cut_fragments, "leader long, f int, salt int, role int, node long, n long, part binary")
        met = parts.repartition(buckets, "leader", "f", "salt").sortWithinPartitions("leader", "f", "salt", "role", "node").mapInArrow(count_overlaps, "a long, b long, n long, m long, shared long")
        links = met.groupBy("a", "b", "n", "m").agg(F.sum("shared").alias("shared")).where(100 * F.col("shared") >= percent * (F.col("n") + F.col("m") - F.col("shared")))
        return links.select("a", "b")

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        """(node, component) with the components that links between nodes bring together. Only edges between components count, so later rounds have small graphs."""
        left, right = (parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")) for c in "ab")
        edges = links.join(left, "a").join(right, "b").select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).where("a <> b").distinct()
        found = connected_components(edges).select(F.col("node").alias("of"), F.col("component").alias("now"))
        return written(parts.join(found, F.col("component") == F.col("of"), "left").select("node", F.coalesce("now", "component").alias("component")), "components")

    listed = docs.mapInArrow(list_prefixes, ROW)
    met = written(to_buckets(listed, buckets).mapInArrow(meet, ROW), "met")
    meta = met.where(f"kind = {META}").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("node"), (F.col("d") == 1).alias("known"), F.col("run").alias("sketches"))
    least = meta.where("n > 0 and known").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    short, wide = F.expr(f"substring(sketches, 1, {SKETCH // 8})"), F.expr(f"substring(sketches, {SKETCH // 8 + 1})")
    reps = written(least.select("node", "doc_id", "n", short.alias("sketch"), F.when(F.octet_length("sketches") > SKETCH // 8, wide).otherwise(short).alias("wide")), "reps")
    # Prefix lengths and least meetings, as least_meetings() has them, in SQL.
    need = f"(({percent} * (n + m) + {99 + percent}) div {100 + percent})"
    prefix = lambda x: f"({x} - (({percent} * {x} + 99) div 100) + 1)"
    often = f"times >= greatest(1, least({prefix('n')} - (n - {need}), {prefix('m')} - (m - {need})))"
    summed = lambda rows: rows.groupBy("a", "b", "n", "m").agg(F.sum("times").alias("times")).where(often).select("a", "b")
    pairs = written(summed(met.where(f"kind = {PAIR}").select("a", "b", F.col("c").alias("n"), F.col("d").alias("m"), F.col("e").alias("times"))), "pairs")
    parts = joined(reps.select("node", F.col("doc_id").alias("component")), written(verify(plausible(pairs)), "links"))
    members = met.where(f"kind = {MEMBER}").select(F.col("a").alias("token"), F.col("b").alias("node"), F.col("c").alias("n"), F.col("d").alias("place"), F.col("e").alias("leader"))
    # A family meets at many shingles, mostly under the same least node; each node is in the family of the least node that it meets at all.
    families = members.groupBy("node").agg(F.min("leader").alias("token"), F.first("n").alias("n")).where("token <> node").select("token", "node", "n").unionByName(members.where("leader = node").groupBy(F.col("leader").alias("token"), "node").agg(F.first("n").alias("n"))).withColumn("place", F.lit(0).cast("long"))
    for few in (True, False):
        some = groups(families if few else members, parts, few).mapInArrow(across(few), PAIRS)
        some = some.select("a", "b").distinct() if few else summed(some)
        more = written(some.join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            parts = joined(parts, written(verify(plausible(more)), "links"))
            pairs = pairs.unionByName(more)
    of_node = parts.select(F.col("node").alias("of"), "component")
    out = meta.join(of_node, (F.col("node") == F.col("of")) & F.col("known") & (F.col("n") > 0), "left")
    return out.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("known"), F.coalesce("component", "doc_id")).alias("component_id"))
