"""Vaults that last: each version has all of a mutation or nothing of it, however many write and read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from lodestone.sources.manifest import Manifest, Stale
from lodestone.sources.vault import Vault

TABLES = ("entries", "tags", "entry_tags", "markdown")


class CommittedVault:
    """A folder with the versions of a vault. Tables that a mutation leaves alone are shared between versions, not written again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.manifest = spark, Manifest(spark, folder)

    def open(self, version: int | None = None) -> tuple[int, Vault]:
        """The number of a version (the last one), and the vault as it was then."""
        number = self.manifest.latest() if version is None else version
        state = self.manifest.read(number)
        if not state:
            raise LookupError(f"no version in {self.manifest.folder}")
        read = lambda name: self.spark.read.schema(state["schemas"][name]).parquet(state[name])
        return number, Vault(*[read(n) for n in TABLES], known_refs=read("refs") if "refs" in state else None)

    def commit(self, base: int, old: Vault | None, new: Vault) -> int:
        """Write what differs between two vaults and commit it after version base, or raise Stale."""
        before = self.manifest.read(base) if base else {}
        state: dict = {"schemas": dict(before.get("schemas", {}))}
        for name, table in [(n, getattr(new, n)) for n in TABLES] + [("refs", new.known_refs)]:
            was = None if old is None else (old.known_refs if name == "refs" else getattr(old, name))
            if table is None:
                continue
            state[name] = before[name] if table is was and name in before else self.manifest.write(table, name)
            state["schemas"][name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        return self.manifest.commit(base, state)

    def create(self, vault: Vault) -> int:
        """The first version."""
        return self.commit(0, None, vault)

    def mutate(self, change: Callable[[Vault], Vault | None], tries: int = 10) -> tuple[int, Vault]:
        """Commit change(vault). If another writer was faster, the change is made again, to the version that won, so none is lost; None and errors of the change commit nothing."""
        for left in reversed(range(tries)):
            number, vault = self.open()
            new = change(vault)
            if new is None or new is vault:
                return number, vault
            try:
                self.commit(number, vault, new)
                return self.open(number + 1)
            except Stale:
                if not left:
                    raise
        raise Stale("no tries")
