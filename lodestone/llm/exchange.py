"""Moving packed runs of records between executors, and keeping intermediate tables where all of them can read."""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import clean, scope, shared_dir, shared_path, written

__all__ = ["clean", "scope", "shared_dir", "shared_path", "written"]

#: Bytes of packed records that one task takes in at a time; with their sort this is some hundred MB.
BUCKET_BYTES = 12 << 20
#: Rows in an Arrow batch: with whole texts, some MB.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> None:
    """Whole texts are wide, so Arrow batches have fewer rows than Spark's 10,000."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_shuffles(spark: SparkSession) -> None:
    """Have Python and the driver's JVM look for plans that nothing refers to any more: Spark then deletes their shuffles' files on the executors, which it else does at some later collection."""
    for _ in range(2):
        # The bridge to the JVM lets go of collected objects in a thread of its own, and plans go only after what holds them.
        gc.collect()
        time.sleep(0.3)
        spark._jvm.System.gc()


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bucket_count(spark: SparkSession, total: float) -> int:
    """Buckets for so many bytes of records: as many as there are shuffle partitions, or more if they would be large."""
    return max(partitions(spark), int(total // BUCKET_BYTES) + 1)


def to_buckets(df: DataFrame, n: int) -> DataFrame:
    """Bring the runs of each bucket together; a task sees its buckets one after another."""
    return df.repartition(n, "bucket").sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one bucket at a time, from rows in the order of their bucket."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        b = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high == low:
                continue
            if held and held[-1].column(0)[0].as_py() != b[low]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its length in bytes before it."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return b"".join(x for p in parts for x in (len(p).to_bytes(8, "little"), p))


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


class Runs:
    """Gathers records of a task and hands them out as one packed run for each bucket.

    A record has a text (an index into the texts seen so far, each with its doc_id, hash and home bucket) and columns of fixed kinds.
    A run names only the texts of its own records.
    """

    def __init__(self, kinds: tuple, limit: int = 20 << 20):
        self.kinds, self.limit = kinds, limit
        self.clear()

    def clear(self) -> None:
        self.texts: list[np.ndarray] = []
        self.n_texts = self.size = 0
        self.records: list[tuple[np.ndarray, ...]] = []

    def add_texts(self, doc_id: np.ndarray, of: np.ndarray, home: np.ndarray) -> int:
        """The index of the first of these texts."""
        self.texts.append(np.stack([doc_id, of, home]))
        self.n_texts += len(doc_id)
        return self.n_texts - len(doc_id)

    def add(self, text: np.ndarray, *columns: np.ndarray) -> None:
        self.records.append((text.astype(np.uint32), *(c.astype(k, copy=False) for c, k in zip(columns, self.kinds, strict=True))))
        self.size += sum(c.nbytes for c in self.records[-1])

    @property
    def full(self) -> bool:
        return self.size + 24 * self.n_texts > self.limit

    def columns(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """All texts (3 x n), and all records by column, the text first."""
        texts = np.concatenate(self.texts, axis=1) if self.texts else np.zeros((3, 0), np.int64)
        if not self.records:
            return texts, [np.zeros(0, k) for k in (np.uint32, *self.kinds)]
        return texts, [np.concatenate(c) for c in zip(*self.records, strict=True)]


def cut_runs(texts: np.ndarray, columns: list[np.ndarray], bucket: np.ndarray) -> list[tuple[int, bytes]]:
    """A packed run for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else []
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        used, text = np.unique(columns[0][order[a:b]], return_inverse=True)
        out.append((int(bucket[a]), pack(texts[:, used], text.astype(np.uint32), *(c[order[a:b]] for c in columns[1:]))))
    return out


def join_runs(blobs: list[bytes], kinds: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """The texts and records of several runs together."""
    texts, columns, n = [], [], 0
    for blob in blobs:
        head, text, *rest = unpack(blob, np.int64, np.uint32, *kinds)
        texts.append(head.reshape(3, -1))
        columns.append([text.astype(np.int64) + n, *rest])
        n += texts[-1].shape[1]
    return np.concatenate(texts, axis=1), [np.concatenate(c) for c in zip(*columns, strict=True)]


RUN_SCHEMA = "bucket int, kind int, run binary"


def run_batch(runs: list[tuple[int, bytes]], kind: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in runs], pa.int32()), pa.array([kind] * len(runs), pa.int32()), pa.array([r for _, r in runs], pa.binary())], names=["bucket", "kind", "run"])


def with_homes(docs: DataFrame, homes: int, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, text, of (a hash of the text), home (the bucket where the text meets what is found out about it), and the columns of `keep` as keep0, keep1 ... (the text's is empty)."""
    kept = [(F.lit(None).cast("string") if c == "text" else F.col(c)).alias(f"keep{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *kept)
    rows = rows.withColumn("of", F.xxhash64("text")).withColumn("home", F.pmod(F.xxhash64("doc_id", "of"), F.lit(homes)).cast("int"))
    return rows.select("doc_id", "text", "of", "home", *[f"keep{i}" for i in range(len(keep))])


def bring_home(texts: DataFrame, runs: DataFrame, homes: int) -> DataFrame:
    """Rows (bucket, kind, run, doc_id, of, text and what else texts has): the runs of a bucket come first, then its texts (kind 9)."""
    rest = [c for c in texts.columns if c not in ("home",)]
    a = texts.select(F.col("home").alias("bucket"), F.lit(9).alias("kind"), F.lit(None).cast("binary").alias("run"), *rest)
    b = runs.select("bucket", "kind", "run", *[F.lit(None).cast(texts.schema[c].dataType).alias(c) for c in rest])
    return a.unionByName(b).repartition(homes, "bucket").sortWithinPartitions("bucket", "kind")


def homecoming(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[int, bytes]], pa.RecordBatch]]:
    """For each batch of texts, the (kind, run) of its bucket. Texts stream; only the runs of one bucket are held."""
    bucket, runs = None, []
    for batch in batches:
        b, kind = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)] if len(b) else []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if b[low] != bucket:
                bucket, runs = b[low], []
            first = low + int(np.searchsorted(kind[low:high], 9))
            runs += [(int(kind[i]), batch.column(2)[i].as_py()) for i in range(low, first)]
            if first < high:
                yield runs, batch.slice(first, high - first)


class Places:
    """Records by text: sorted once for a bucket, then looked up."""

    def __init__(self, runs: list[bytes], kinds: tuple):
        self.columns: list[np.ndarray] = []
        self.at: dict[tuple[int, int], tuple[int, int]] = {}
        if not runs:
            return
        texts, columns = join_runs(runs, kinds)
        doc, of = texts[0][columns[0]], texts[1][columns[0]]
        order = np.lexsort((columns[1], of, doc))
        doc, of, self.columns = doc[order], of[order], [c[order] for c in columns[1:]]
        cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(of) != 0)) + 1).tolist(), len(doc)]
        self.at = {(int(doc[a]), int(of[a])): (a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a}

    def of(self, doc: int, of: int) -> list[np.ndarray] | None:
        found = self.at.get((doc, of))
        return None if found is None else [c[found[0] : found[1]] for c in self.columns]


def later_ones(texts: np.ndarray, columns: list[np.ndarray], n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort records (text, keys, place, ...) by key and then doc_id, hash of the text and place. Which are the first of their key, and which come truly later than the first."""
    doc, of = texts[0][columns[0]], texts[1][columns[0]]
    keys, place = columns[1 : 1 + n_keys], columns[1 + n_keys]
    order = np.lexsort((place, of, doc, *keys[::-1]))
    first = np.ones(len(order), bool)
    first[1:] = False
    for k in keys:
        s = k[order]
        first[1:] |= s[1:] != s[:-1]
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    h = order[head]
    later = (doc[order] != doc[h]) | (of[order] != of[h]) | (place[order] != place[h])
    is_first, is_later = np.empty(len(order), bool), np.empty(len(order), bool)
    is_first[order], is_later[order] = first, later
    return is_first, is_later


def only_kind(wanted: int, reduce):
    """Apply reduce to the rows of one kind and let the others through."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aside: list[pa.RecordBatch] = []

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                its = batch.column(1).to_numpy(zero_copy_only=False) == wanted
                if not its.all():
                    aside.append(batch.filter(pa.array(~its)))
                if its.any():
                    yield batch.filter(pa.array(its))

        for out in reduce(chosen()):
            while aside:
                yield aside.pop(0)
            yield out
        while aside:
            yield aside.pop(0)

    return both
