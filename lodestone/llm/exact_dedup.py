"""Exact deduplication by an index of live digests with a cuckoo filter in front of each bucket of keys.

The index has three tables: members (a row for each document, with its digest), keys (a row for each live digest, with the number of its members and the one that stays) and filters (a cuckoo filter for each bucket of keys).
Documents are inserted in batches. Equal digests of a task are combined before they move, so a group of copies sends one record for each task, whatever its size. In its bucket a digest asks the filter first: a miss is a new
key and nothing is read; a hit is verified against the bucket's keys, and a false one is a new key too. A filter that overflows is made anew, twice as large, from the stored keys. Deleting documents elects another member
where the one that stayed is gone, and a digest without members leaves the keys and its filter.

Digests are SHA-256 of the normalised text and are compared in full; texts do not move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.cuckoo import Cuckoo
from lodestone.llm.exchange import partitions, tune, written
from lodestone.llm.textbytes import column_bytes, longs

#: Documents for each bucket of keys, and records that a task combines at a time.
BUCKET_KEYS, COMBINE = 50_000, 1 << 17

MEMBERS = "bucket int, digest binary, doc_id long, n_chars long, row long"
KEYS = "bucket int, digest binary, n long, n_chars long, doc_id long, row long"
FILTERS = "bucket int, size int, filter binary"
CHANGED = "bucket int, digest binary, n long, n_chars long, doc_id long, row long, size int, filter binary"

#: What a row of a bucket is: its filter, a key that a record may mean, a record.
FILTER, KEY, RECORD = 0, 1, 2


@dataclass(frozen=True)
class Index:
    buckets: int
    members: DataFrame
    keys: DataFrame
    filters: DataFrame


def empty_index(spark: SparkSession, buckets: int) -> Index:
    """An index without documents. The number of buckets stays; filters and keys grow within them."""
    return Index(buckets, spark.createDataFrame([], MEMBERS), spark.createDataFrame([], KEYS), spark.createDataFrame([], FILTERS))


def normalised(text: Column) -> Column:
    """Without white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def members_of(docs: DataFrame, buckets: int, base: int) -> DataFrame:
    """A row for each document, numbered from base."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(normalised(text), 256))
    rows = docs.select(digest.alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), (F.monotonically_increasing_id() + base).alias("row"))
    return rows.select(F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int").alias("bucket"), "digest", "doc_id", "n_chars", "row")


class Records:
    """Digests (n x 4 words) with the number of their members and the best of them: most code points, then least doc_id (null comes last), then the row that came first."""

    def __init__(self, digest: np.ndarray, n: np.ndarray, n_chars: np.ndarray, null: np.ndarray, doc_id: np.ndarray, row: np.ndarray):
        self.digest, self.n, self.n_chars, self.null, self.doc_id, self.row = digest, n, n_chars, null, doc_id, row

    def __len__(self) -> int:
        return len(self.n)

    @classmethod
    def read(cls, batch: pa.RecordBatch, counted: bool = True) -> Records:
        at = batch.schema.get_field_index
        digest = column_bytes(batch.column(at("digest")))[0].copy().view(np.uint64).reshape(-1, 4)
        ids = batch.column(at("doc_id"))
        n = longs(batch.column(at("n"))) if counted else np.ones(len(ids), np.int64)
        return cls(digest, n, longs(batch.column(at("n_chars"))), np.array(ids.is_null()), longs(ids), longs(batch.column(at("row"))))

    @classmethod
    def together(cls, parts: list[Records]) -> Records:
        return cls(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("digest", "n", "n_chars", "null", "doc_id", "row")))

    def take(self, which: np.ndarray) -> Records:
        return Records(self.digest[which], self.n[which], self.n_chars[which], self.null[which], self.doc_id[which], self.row[which])

    def combined(self) -> Records:
        """One for each digest."""
        if not len(self):
            return self
        words = [self.digest[:, i] for i in range(4)]
        order = np.lexsort((self.row, self.doc_id, self.null, -self.n_chars, *words))
        s = self.digest[order]
        first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]).any(1))))
        out = self.take(order[first])
        out.n = np.add.reduceat(self.n[order], first)
        return out

    def arrays(self) -> list[pa.Array]:
        raw = np.ascontiguousarray(self.digest).view(np.uint8)
        digest = pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer((np.arange(len(self) + 1) * 32).astype(np.int32)), pa.py_buffer(raw.tobytes())])
        return [digest, pa.array(self.n), pa.array(self.n_chars), pa.array(self.doc_id, mask=self.null), pa.array(self.row)]


NAMES = ["digest", "n", "n_chars", "doc_id", "row"]


def combine(members: DataFrame) -> DataFrame:
    """The records of members: those of a task with one digest become one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []

        def batch(r: Records) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(r.arrays(), names=NAMES)

        for b in batches:
            held.append(Records.read(b, counted=False))
            if sum(map(len, held)) > COMBINE:
                held = [Records.together(held).combined()]
                if len(held[0]) > COMBINE // 2:
                    yield batch(held.pop())
        if held:
            yield batch(Records.together(held).combined())

    return members.select("digest", "doc_id", "n_chars", "row").mapInArrow(run, KEYS.removeprefix("bucket int, "))


class Bucket:
    """One bucket of keys while a batch is inserted: the filter that was there, a filter of what is new, and the keys that records were compared with."""

    def __init__(self) -> None:
        self.old: Cuckoo | None = None
        self.new = Cuckoo()
        self.at: dict[bytes, int] = {}
        self.known = 0
        self.parts: list[Records] = []

    def load(self, keys: Records) -> None:
        """Keys of before that records may mean."""
        for d in keys.digest:
            self.at[d.tobytes()] = len(self.at)
        self.known = len(self.at)
        self.parts.append(keys)

    def fresh_keys(self) -> np.ndarray:
        """The hashes of the keys that are new in this batch, in their order."""
        words = np.frombuffer(b"".join(self.at), np.uint64).reshape(-1, 4)
        return words[self.known :, 0]

    def insert(self, records: Records) -> None:
        """A miss is new; a hit is compared with the keys, and new if it is none of them."""
        records = records.combined()
        hashes = records.digest[:, 0]
        hit = self.new.has(hashes)
        if self.old is not None:
            hit |= self.old.has(hashes)
        fresh = ~hit
        for i in np.flatnonzero(hit):
            fresh[i] = records.digest[i].tobytes() not in self.at
        for i in np.flatnonzero(fresh):
            self.at[records.digest[i].tobytes()] = len(self.at)
        if fresh.any() and not self.new.insert(hashes[fresh]):
            self.new = Cuckoo.of(self.fresh_keys(), 2 * self.new.buckets)
        self.parts.append(records)

    def touched(self) -> Records:
        """The keys that are new or have more members now."""
        return Records.together(self.parts).combined()

    def filter(self) -> Cuckoo | None:
        """The filter with all keys; None if it overflows and has to be made from the stored keys."""
        if self.old is None:
            return self.new
        return self.old if self.old.insert(self.fresh_keys()) else None


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(bucket, kind, rows) of rows in the order of bucket and kind."""
    for batch in batches:
        bucket, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        cuts = [0, *(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)) + 1), len(bucket)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high > low:
                yield int(bucket[low]), int(kind[low]), batch.slice(low, high - low)


def _meet(index: Index, keys: DataFrame | None, records: DataFrame) -> DataFrame:
    """The filter, keys and records of each bucket in one task, in this order."""
    parts = [index.filters.withColumn("kind", F.lit(FILTER)), records.withColumn("kind", F.lit(RECORD)).withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(index.buckets)).cast("int"))]
    if keys is not None:
        parts.append(keys.withColumn("kind", F.lit(KEY)))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p, allowMissingColumns=True)
    return met.select("bucket", "kind", "size", "filter", *NAMES).repartition(index.buckets, "bucket").sortWithinPartitions("bucket", "kind")


def probed(index: Index, records: DataFrame) -> DataFrame:
    """The digests of records that the filters may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Cuckoo] | None = None
        for bucket, kind, rows in _by_bucket(batches):
            if kind == FILTER:
                held = bucket, Cuckoo(rows.column(2)[0].as_py(), rows.column(3)[0].as_py())
            elif held and held[0] == bucket:
                hit = held[1].has(Records.read(rows).digest[:, 0])
                yield pa.RecordBatch.from_arrays([rows.column(4).filter(pa.array(hit))], names=["digest"])

    return _meet(index, None, records).mapInArrow(run, "digest binary").distinct()


def _inserted(met: DataFrame) -> DataFrame:
    """Touched keys, and a row for each bucket with its filter (null: it overflowed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = -1, Bucket()

        def done() -> Iterator[pa.RecordBatch]:
            made = bucket.filter()
            if bucket.parts:
                keys = bucket.touched()
                none = [pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(keys), pa.int32()), *keys.arrays(), *none], names=["bucket", *NAMES, "size", "filter"])
            kinds = [pa.binary(), *[pa.int64()] * 4]
            blob = [pa.array([made.buckets if made else 0], pa.int32()), pa.array([made.table.tobytes() if made else None], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *[pa.nulls(1, k) for k in kinds], *blob], names=["bucket", *NAMES, "size", "filter"])

        for at, kind, rows in _by_bucket(batches):
            if at != now:
                if now >= 0:
                    yield from done()
                now, bucket = at, Bucket()
            if kind == FILTER:
                bucket.old = Cuckoo(rows.column(2)[0].as_py(), rows.column(3)[0].as_py())
            elif kind == KEY:
                bucket.load(Records.read(rows))
            else:
                bucket.insert(Records.read(rows))
        if now >= 0:
            yield from done()

    return met.mapInArrow(run, CHANGED)


def _refilled(index: Index, full: DataFrame, keys: DataFrame) -> DataFrame:
    """New filters for buckets (bucket) from all their stored keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def done(bucket: int) -> pa.RecordBatch:
            made = Cuckoo.of(np.concatenate(held.pop(bucket)))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([made.buckets], pa.int32()), pa.array([made.table.tobytes()], pa.binary())], names=["bucket", "size", "filter"])

        for bucket, _, rows in _by_bucket(batches):
            for ended in [b for b in held if b != bucket]:
                yield done(ended)
            held.setdefault(bucket, []).append(column_bytes(rows.column(2))[0].copy().view(np.uint64).reshape(-1, 4)[:, 0])
        for bucket in list(held):
            yield done(bucket)

    rows = keys.join(full, "bucket", "left_semi").select("bucket", F.lit(KEY).alias("kind"), "digest")
    return rows.repartition(index.buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FILTERS)


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the documents (doc_id, text) of a batch.

    Null texts are empty, and texts without anything but white space are equal to them; repeated rows are members of their own; rows without doc_id are members that stay only if no other has as many code points; texts may be as long as
    Spark's strings; an empty batch changes nothing; other columns are left behind, whatever their names.
    """
    tune(docs.sparkSession)
    base = index.members.agg(F.max("row")).first()[0]
    members = written(members_of(docs, index.buckets, 0 if base is None else base + 1), "members")
    records = combine(members)
    if base is None:
        changed = written(_inserted(_meet(index, None, records)), "changed")
    else:
        records = written(records, "records")
        hits = written(probed(index, records), "hits")
        changed = written(_inserted(_meet(index, index.keys.join(hits, "digest", "left_semi"), records)), "changed")
    touched = changed.where(F.col("digest").isNotNull()).drop("size", "filter")
    filters = changed.where(F.col("digest").isNull()).select("bucket", "size", "filter")
    if base is None:
        return Index(index.buckets, members, touched, filters)
    keys = written(index.keys.join(touched, "digest", "left_anti").select(touched.columns).unionByName(touched), "keys")
    full = filters.where(F.col("filter").isNull()).select("bucket")
    if not full.isEmpty():
        filters = written(filters.where(F.col("filter").isNotNull()).unionByName(_refilled(index, full, keys)), "filters")
    return Index(index.buckets, index.members.unionByName(members), keys, filters)


def delete(index: Index, gone: DataFrame) -> Index:
    """The index without the documents of some ids (doc_id). Of a digest that lost members the best of the others stays; one without members leaves the keys and its filter. Unknown ids are passed over; nulls delete nothing."""
    lost = written(index.members.join(gone.select("doc_id"), "doc_id", "left_semi").select(index.members.columns), "lost")
    members = written(index.members.join(lost.select("row"), "row", "left_anti").select(index.members.columns), "members")
    hurt = written(lost.select("bucket", "digest").distinct(), "hurt")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    left = members.join(hurt.select("digest"), "digest", "left_semi").groupBy("bucket", "digest").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("n_chars", "doc_id", "row"), order).alias("b"))
    left = written(left.select("bucket", "digest", "n", "b.n_chars", "b.doc_id", "b.row"), "left")
    dead = hurt.join(left, "digest", "left_anti").select("digest", *[F.lit(None).cast("long").alias(c) for c in NAMES[1:]])
    keys = written(index.keys.join(hurt.select("digest"), "digest", "left_anti").select(left.columns).unionByName(left), "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Cuckoo] | None = None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1].buckets], pa.int32()), pa.array([held[1].table.tobytes()], pa.binary())], names=["bucket", "size", "filter"])

        for bucket, kind, rows in _by_bucket(batches):
            if kind == FILTER:
                if held:
                    yield out()
                held = bucket, Cuckoo(rows.column(2)[0].as_py(), rows.column(3)[0].as_py())
            else:
                held[1].delete(column_bytes(rows.column(4))[0].copy().view(np.uint64).reshape(-1, 4)[:, 0])
        if held:
            yield out()

    return Index(index.buckets, members, keys, written(_meet(index, None, dead).mapInArrow(run, FILTERS), "filters"))


def groups(index: Index) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every member. Only digests of several members are joined; keys are a written table, so Spark can split a large group."""
    several = index.keys.where("n > 1").select(F.col("digest").alias("d"), "n", F.col("doc_id").alias("keep"), F.col("row").alias("kept_row"))
    met = index.members.join(several, F.col("digest") == F.col("d"), "left")
    alone = F.col("n").isNull()
    return met.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("row") == F.col("kept_row"))).alias("kept"), "digest")


def exact_duplicates(docs: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and digest of every document, by an index of the whole table."""
    spark = docs.sparkSession
    buckets = max(partitions(spark), docs.count() // bucket_keys + 1)
    return groups(insert(empty_index(spark, buckets), docs))
