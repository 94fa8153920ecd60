"""Keeping the index in step with the files: each change of a file is read once, and what it adds and takes away is passed on.

`scan` logs the files that changed, and a stream follows the log. The references of each text that count now are kept as state under its entry; a newer version of the text emits the differences: references that came (+1) and that went
(-1), and hashtags that the text has from now on or no more. So versions that come twice or late emit nothing, a restart goes on where it was, and the first batch of all texts is nothing special. What was emitted is kept by batch; now and then
`compact` folds the batches into one committed table, and readers add only the batches after it. Counts are kept up the same way.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.refs import refs_of
from lodestone.sources import files
from lodestone.sources.manifest import Manifest
from lodestone.sources.shared import scope, written
from lodestone.sources.vault import read_markdown_files

#: A change of a file; of a file that is gone the text is null. seq is the number of the scan that saw it.
CHANGE = "file_path string, markdown string, mtime double, gone boolean, seq long"
REF = "ordinal int, target_text string, is_hashtag boolean, heading string, pre string, highlight string, post string"
#: change is 1 or -1 with a reference (as JSON) or with a hashtag that the entry gained or lost, and 0 in one row for each version of a text.
EMITTED = "source_id long, change int, ref string, member string, seq long, mtime double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scan(spark: SparkSession, folder: str, log: str) -> int:
    """Append to a log the Markdown files of a folder tree that are new, or whose time differs from the log's last, or that are gone; returns how many.

    (A file stream alone would miss files that are rewritten under their old name.)
    """
    with scope(spark) as tables:
        found, seq = read_markdown_files(spark, folder).withColumn("gone", F.lit(False)), 0
        try:
            known = spark.read.schema(CHANGE).parquet(log).groupBy("file_path").agg(F.max_by(F.struct("mtime", "gone"), "seq").alias("k"), F.max("seq").alias("seq")).select("file_path", "k.*", "seq")
            known = written(known, "known")
            seq = (known.agg(F.max("seq")).first()[0] or 0) + 1
            was = known.where("not gone").select("file_path", F.col("mtime").alias("last"))
            changed = found.join(was, "file_path", "left").where(F.col("last").isNull() | (F.col("last") != F.col("mtime"))).drop("last")
            lost = was.join(found.select("file_path"), "file_path", "left_anti").select("file_path", F.lit(None).cast("string").alias("markdown"), F.col("last").alias("mtime"), F.lit(True).alias("gone"))
            found = changed.unionByName(lost)
        except AnalysisException:  # no log yet
            pass
        found = written(found.select("file_path", "markdown", "mtime", "gone", F.lit(seq).cast("long").alias("seq")), "scan")
        n = found.count()
        if n:
            found.write.mode("append").parquet(log)
        tables.drop(spark)
    return n


def changed_files(spark: SparkSession, log: str, per_batch: int | None = None) -> DataFrame:
    """The log as a stream; a batch takes in so many files of the log, if it says."""
    reader = spark.readStream.schema(CHANGE)
    return (reader if per_batch is None else reader.option("maxFilesPerTrigger", per_batch)).parquet(log)


class Differences(StatefulProcessor):
    """The references of one entry's newest text, as state, and how they differ from those of a newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("refs", "seq long, refs string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        newest = None
        for frame in rows:
            for r in frame.itertuples(index=False):
                # Of rows of one scan one counts, a file that is gone before others.
                if newest is None or (r.seq, r.gone, r.mtime) > (newest.seq, newest.gone, newest.mtime):
                    newest = r
        seq, old = (self.state.get() if self.state.exists() else (-1, "[]"))
        if newest is None or newest.seq <= seq:
            return
        now = [] if newest.gone or newest.refs is None else list(newest.refs)
        self.state.update((int(newest.seq), json.dumps(now)))
        before, after = Counter(json.loads(old)), Counter(now)
        tags = [{t for ref in each if (r := json.loads(ref))["is_hashtag"] for t in [r["target_text"]]} for each in (before, after)]
        out = [(0, None, None)]
        out += [(-1, ref, None) for ref in (before - after).elements()] + [(1, ref, None) for ref in (after - before).elements()]
        out += [(-1, None, t) for t in sorted(tags[0] - tags[1])] + [(1, None, t) for t in sorted(tags[1] - tags[0])]
        yield pd.DataFrame([(key[0], change, ref, tag, newest.seq, newest.mtime) for change, ref, tag in out], columns=["source_id", "change", "ref", "member", "seq", "mtime"])

    def close(self) -> None:
        pass


def differences(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """changes of files -> EMITTED, a stream with state under each entry; entries (id, file_path) say whose file it is."""
    met = changes.join(entries.select(F.col("id").alias("entry_id"), "file_path"), "file_path")
    refs = F.transform(refs_of(F.col("markdown")), lambda r, i: F.to_json(F.struct(i.alias("ordinal"), *[r[c].alias(c) for c in ("target_text", "is_hashtag", "heading", "pre", "highlight", "post")])))
    keyed = met.select("entry_id", "seq", "mtime", "gone", refs.alias("refs")).groupBy("entry_id")
    return keyed.transformWithStateInPandas(Differences(), EMITTED, "Append", "None")


def follow(changes: DataFrame, entries: DataFrame, target: str, checkpoint: str, notify: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Write what each batch of changes adds and takes away to `target`, one folder for each batch, and tell `notify` (batch, files) when a batch is there. A batch that runs again overwrites its own folder, so each change counts once."""
    spark = entries.sparkSession

    def batch(frame: DataFrame, number: int) -> None:
        path = f"{target}/changes/{number:010d}"
        frame.write.mode("overwrite").parquet(path)
        if notify:
            notify(number, frame.sparkSession.read.schema(EMITTED).parquet(path).where("change = 0").count())

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)  # a query takes the setting from its start
    try:
        return differences(changes, entries).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(f"reconcile-{uuid.uuid4().hex}").start()
    finally:
        spark.conf.set(key, before)


def _later(spark: SparkSession, target: str, upto: int) -> tuple[DataFrame | None, int]:
    """What was emitted after a batch, and the last batch."""
    batches = [n for n in files.names(spark, f"{target}/changes") if n.isdigit() and int(n) > upto]
    return (spark.read.schema(EMITTED).parquet(*[f"{target}/changes/{n}" for n in batches]) if batches else None), max([upto, *map(int, batches)])


BASE = {"refs": "source_id long, ref string", "tags": "key string, n long"}


def _folded(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame, int]:
    """References (source_id, ref) and counts of hashtags (key, n) by all batches so far, and the last of them."""
    state = Manifest(spark, target).read()
    later, last = _later(spark, target, state.get("upto", -1))
    refs, tags = (spark.read.schema(s).parquet(state[name]) if state else spark.createDataFrame([], s) for name, s in BASE.items())
    if later is not None:
        change = F.col("change").cast("long")
        refs = refs.withColumn("n", F.lit(1).cast("long")).unionByName(later.where("ref is not null").select("source_id", "ref", change.alias("n"))).groupBy("source_id", "ref").agg(F.sum("n").alias("n")).where("n > 0").select("source_id", "ref")
        tags = tags.unionByName(later.where("member is not null").select(F.col("member").alias("key"), change.alias("n"))).groupBy("key").agg(F.sum("n").alias("n")).where("n > 0")
    return refs, tags, last


def current_refs(spark: SparkSession, target: str) -> DataFrame:
    """References by the newest version of each source: the last compacted table, and the batches after it."""
    refs, _, _ = _folded(spark, target)
    return refs.select("source_id", F.from_json("ref", REF).alias("r")).select("source_id", "r.*")


def current_tag_counts(spark: SparkSession, target: str) -> DataFrame:
    """(key, n): entries that have a hashtag in their text, kept up by differences instead of counted."""
    return _folded(spark, target)[1]


def compact(spark: SparkSession, target: str) -> int:
    """Fold all batches so far into one committed version; returns the last batch in it. Readers of the version before are not disturbed; `expire` deletes what no reader needs any more."""
    manifest = Manifest(spark, target)

    def fold(state: dict) -> dict:
        refs, tags, last = _folded(spark, target)
        return state if last <= state.get("upto", -1) else {"upto": last, "refs": manifest.write(refs, "refs"), "tags": manifest.write(tags, "tags")}

    return manifest.update(fold).get("upto", -1)


def expire(spark: SparkSession, target: str) -> None:
    """Delete batches that are compacted, and versions but the last."""
    manifest = Manifest(spark, target)
    upto = manifest.read().get("upto", -1)
    manifest.expire()
    for n in files.names(spark, f"{target}/changes"):
        if n.isdigit() and int(n) <= upto:
            files.delete(spark, f"{target}/changes/{n}")
