"""Committed versions of a set of tables.

A version is a small file that says which folders its tables are in; the folders never change. To commit is to make the file of the next number, which only one of several writers can: the others are told, and may try again from the
version that won. A reader opens one version and sees it whole, whatever is committed meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources import files

State = dict[str, Any]


class Stale(RuntimeError):
    """Another writer has committed the version that this one was to be."""


class Manifest:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names(self.spark, f"{self.folder}/versions") if n.endswith(".json") and not n.startswith(".")]

    def latest(self) -> int:
        """The number of the last version; 0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> State:
        """What a version says; the last one's if no number is given, {} before the first."""
        version = self.latest() if version is None else version
        return json.loads(files.read_text(self.spark, f"{self.folder}/versions/{version:012d}.json")) if version else {}

    def commit(self, base: int, state: State) -> int:
        """Make `state` the version after base, or raise Stale and change nothing."""
        if not files.create_once(self.spark, f"{self.folder}/versions/{base + 1:012d}.json", json.dumps(state)):
            raise Stale(f"version {base + 1} of {self.folder} is there already")
        return base + 1

    def update(self, change: Callable[[State], State], tries: int = 10) -> State:
        """Commit change(state), from the last state anew whenever another writer was faster. What the change has written for a lost try stays for `expire`."""
        for left in reversed(range(tries)):
            base = self.latest()
            state = change(self.read(base))
            try:
                self.commit(base, state)
                return state
            except Stale:
                if not left:
                    raise
        return {}

    def new_folder(self, name: str) -> str:
        return f"{self.folder}/tables/{name}-{uuid.uuid4().hex}"

    def write(self, table: DataFrame, name: str) -> str:
        """Write a table to a folder of its own, and say which."""
        path = self.new_folder(name)
        table.write.parquet(path)
        return path

    def expire(self, keep: int = 1) -> list[str]:
        """Delete all versions but the last few, and the folders that none of these name. For quiet times: a writer that has not committed yet, or a reader of an old version, would lose its tables."""
        numbers = self.versions()
        kept = numbers[-keep:]
        used = json.dumps([self.read(v) for v in kept])
        for v in numbers[:-keep]:
            files.delete(self.spark, f"{self.folder}/versions/{v:012d}.json")
        gone = [n for n in files.names(self.spark, f"{self.folder}/tables") if n not in used]
        for n in gone:
            files.delete(self.spark, f"{self.folder}/tables/{n}")
        return gone
