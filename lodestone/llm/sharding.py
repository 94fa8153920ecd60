"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by seeded hashes: a record's shard is the one with the highest hash weight for its key (so one more shard takes records only into itself), and within a shard its bucket is
uniform, with as many buckets as the shard's bytes need to be near `bucket_bytes` each. Pass two draws a Fisher-Yates permutation for each bucket, puts the bucket's records in that order and writes them,
each shard in its folder; a slot is a record's number in its shard, read back from what was written.

The draws are hashes of the seed, the bucket and the step, and the array that is shuffled is the bucket sorted by its records' hashes, so the result depends on the records and the seed alone: not on partitions, their order, or tasks
that run twice. A record that comes more than once is counted first, and its copies are scattered like any others, so no key gathers in one bucket. Between the passes a task sorts its buckets with Spark's external
sort, so even a bucket of texts near the longest that Spark can hold spills instead of failing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.exchange import partitions, shared_path, written

#: Bytes of a bucket, the bytes that a record counts for at least (so a bucket has some 4,000 at most), bytes that one task of pass two takes in, and copies of a record that one task hands out.
BUCKET_BYTES, LEAST_BYTES, TASK_BYTES, COPIES = 4 << 20, 1 << 10, 32 << 20, 10_000


def shard_of(key: Column, shards: int, seed: int = 7) -> Column:
    """The shard with the highest weight of the key. With shards + 1, a key stays or moves to the new shard."""
    weigh = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(key, F.lit(seed), i).alias("weight"), i.alias("shard")))
    return F.array_max(weigh).getField("shard")


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """A permutation of 0 to n - 1, as n numbers of four bytes: from the last place down, each is swapped with one at or before it, drawn by a hash of the seeds and the step."""
    start = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.lpad(F.hex(i), 8, "0")), ""))

    def swap(numbers: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(*seeds, i), i + 1).cast("int")
        at = lambda k: F.substring(numbers, 4 * k + 1, F.lit(4))
        return F.overlay(F.overlay(numbers, at(j), 4 * i + 1, F.lit(4)), at(i), 4 * j + 1, F.lit(4))

    return F.when(n > 1, F.aggregate(F.sequence(n - 1, F.lit(1), F.lit(-1)), start, swap)).otherwise(start)


def number_at(numbers: Column, i: Column) -> Column:
    return F.conv(F.hex(F.substring(numbers, 4 * i + 1, F.lit(4))), 16, 10).cast("long")


def shuffle_into_shards(rows: DataFrame, key: str, shards: int, carry: Sequence[str], size: Column | None = None, seed: int = 7, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """key, the columns of `carry` (of types that Spark can sort), bucket, slot (long, gapless from 0 in a shard, in random order), shard: written to `path` (a new folder; else one in the shared
    folder) with a folder for each shard, and read from there. In a file the records stand in the order of their slots.

    `size` gives a record's bytes, by which the number of buckets is chosen. Records with a null key share a shard, which gets as many buckets as it needs; null and empty texts are records like others; repeated
    records all get slots of their own; texts may be as long as Spark's strings; an empty table gives no rows; other columns are left behind, whatever their names.
    """
    spark = rows.sparkSession
    record = F.struct(F.col(key).alias("k"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    of = F.xxhash64(F.col(key), *[F.col(c) for c in carry])
    weight = F.greatest(size if size is not None else F.lit(0), F.lit(LEAST_BYTES)).cast("long")
    told = written(rows.select(shard_of(F.col(key), shards, seed).alias("shard"), of.alias("of"), weight.alias("weight")), "records")
    # One row for each shard.
    bytes_of = {r["shard"]: r["bytes"] for r in told.groupBy("shard").agg(F.sum("weight").alias("bytes")).collect()}
    buckets = [max(1, -(-bytes_of.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards)]
    of_shard = lambda numbers: F.element_at(F.array(*[F.lit(n).cast("long") for n in numbers]), F.col("shard") + 1)
    bucket = of_shard(first) + F.pmod(F.xxhash64("of", "copy", F.lit(seed + 1)), of_shard(buckets))
    repeated = written(told.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("of"), "repeated")
    plain, numbers, zero = rows.select(of.alias("of"), shard_of(F.col(key), shards, seed).alias("shard"), record.alias("record")), told, F.lit(0).cast("long").alias("copy")
    if repeated.isEmpty():
        scattered, counted = plain.select("shard", "of", zero, "record"), numbers.select("shard", "of", zero)
    else:
        n, block = F.col("n"), F.col("block")
        blocks = plain.join(repeated, "of", "left_semi").groupBy("shard", "of", "record").agg(F.count(F.lit(1)).alias("n")).select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("block"))
        copies = blocks.repartition("of", "block").select("shard", "of", F.explode(F.sequence(block * COPIES, F.least(n, (block + 1) * COPIES) - 1)).alias("copy"), "record")
        scattered = plain.join(repeated, "of", "left_anti").select("shard", "of", zero, "record").unionByName(copies)
        counted = numbers.join(repeated, "of", "left_anti").select("shard", "of", zero).unionByName(copies.select("shard", "of", "copy"))
    counts = counted.withColumn("bucket", bucket).groupBy("shard", "bucket").agg(F.count(F.lit(1)).cast("int").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    counts = written(counts.select("bucket", "n", before.alias("before")), "buckets")
    tasks = max(partitions(spark), sum(bytes_of.values()) // TASK_BYTES + 1)
    # The same number of parts on either side, so that the records move once. Never broadcast: permutations grow with the records.
    drawn = counts.repartition(tasks, "bucket").select(F.col("bucket").alias("b"), "before", fisher_yates(F.col("n"), F.lit(seed + 2), F.col("bucket")).alias("drawn")).hint("merge")
    sorted_ones = Window.partitionBy("bucket").orderBy("of", "record")
    placed = scattered.withColumn("bucket", bucket).repartition(tasks, "bucket").select("shard", "bucket", "record", (F.row_number().over(sorted_ones) - 1).alias("rank"))
    out = placed.join(drawn, F.col("bucket") == F.col("b")).select(F.col("record.k").alias(key), *[F.col(f"record.c{i}").alias(c) for i, c in enumerate(carry)], "bucket", (F.col("before") + number_at(F.col("drawn"), F.col("rank"))).alias("slot"), "shard")
    path = path or shared_path(spark, "shards")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
