"""Corpus-wide counts in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
#: Bits in one of Spark's bitmaps.
PAGE = 32768


def set_bits(bits: DataFrame, size: int) -> bytes:
    """A bitmap of `size` bits from their places (column bit), put together on executors; the driver gets size / 8 bytes at most."""
    out = bytearray(-(-size // PAGE) * PAGE // 8)
    pages = bits.groupBy((F.col("bit") / PAGE).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("bit") % PAGE).alias("bits"))
    for page, found in pages.collect():
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] = found
    return bytes(out[: size // 8])


def cell_counts(docs: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """How many hashes of all texts fall in each cell. Tasks send one table each, which are summed on executors; the result has `cells` numbers however large the corpus is."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for found in hashes(batch.column(0)):
                table += np.bincount((found % np.uint64(cells)).astype(np.int64), minlength=cells)
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([blocks[b].tobytes() for b in used], pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "cells"])

    schema = "block long, cells binary"
    out = np.zeros(cells, np.int64)
    # One row for each block: `cells` numbers in all.
    for block, values in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(values, np.int64)
    return out


def signed_counts(docs: DataFrame, hashes: Callable[[pa.Array], Iterator[np.ndarray]], cells: int) -> np.ndarray:
    """A count sketch of one row, `cells` (a power of two) wide: the lowest bit of a hash tells whether it adds one to its cell or takes one away, the bits above name the cell.

    What shares a cell cancels out mostly, so a rare hash among n others is off by the root of n / cells, where a plain count would have all n / cells of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for found in hashes(batch.column(0)):
                np.add.at(table, (found >> np.uint64(1) & np.uint64(cells - 1)).astype(np.int64), 1 - 2 * (found & np.uint64(1)).astype(np.int64))
        blocks = table.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        # Cells of a task are small numbers: as narrow as those of their block are.
        narrow = [blocks[b].astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.abs(blocks[b]).max() <= np.iinfo(t).max)).tobytes() for b in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(narrow, pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = c.as_buffer()
                sums[b] = sums.get(b, 0) + np.frombuffer(part, f"i{part.size // BLOCK}").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["block", "cells"])

    schema = "block long, cells binary"
    out = np.zeros(cells, np.int64)
    # One row for each block: `cells` numbers in all.
    for block, values in docs.select("text").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(values, np.int64)
    return out
