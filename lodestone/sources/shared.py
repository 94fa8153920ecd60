"""Intermediate tables in the folder that all executors share.

A table belongs to the scope that is open where it is written, and only its owner deletes it, so queries that run side by side (in threads of their own) never touch each other's tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where none is set (a local session), a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scope:
    """The tables that a piece of work has written and not deleted."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def drop(self, spark: SparkSession, keep: Sequence[DataFrame] = ()) -> None:
        """Delete the tables, but for those that the frames of `keep` read. Only what is materialised elsewhere may go: a lazy result still needs its tables."""
        held = [f for df in keep for f in df.inputFiles()]
        for name in list(self.paths):
            if not any(f"/{name.rsplit('/', 1)[1]}/" in f for f in held):
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                self.paths.remove(name)


#: What is written outside of any scope, or left by scopes that have ended.
_left = Scope()
_open: ContextVar[Scope] = ContextVar("scope")


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """What is written inside belongs to the block. If it fails, all of that is deleted; else what it has not dropped passes to the scope around it, whose lazy results may read it."""
    outer, mine = _open.get(_left), Scope()
    token = _open.set(mine)
    try:
        yield mine
    except BaseException:
        mine.drop(spark)
        raise
    finally:
        _open.reset(token)
        outer.paths.extend(mine.paths)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _open.get(_left).paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: the lineage ends here, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, keep: Sequence[DataFrame] = ()) -> None:
    """Delete what ended work has left, once no lazy result of this process is read any more; open scopes keep theirs."""
    _left.drop(spark, keep)
