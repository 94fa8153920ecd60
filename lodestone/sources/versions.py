"""Bringing old vaults up to date: each step once, in order, remembered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import casefold
from lodestone.operators.entries import migrate_legacy
from lodestone.operators.tags import tag_merge
from lodestone.sources.vault import Vault


def flags_for_statuses(v: Vault) -> Vault:
    return v.with_(entries=migrate_legacy(v.entries))


def one_tag_for_each_identity(v: Vault) -> Vault:
    """Spellings of one identity become the tag with most members; entries name it once, at the end if they named another spelling."""
    merged = tag_merge(v.tags, v.entry_tags)
    tags = merged.select(F.col("canonical_id").alias("id"), "name", casefold(F.col("name")).alias("normalized")).distinct()
    given = v.entry_tags.join(merged, "tag_id").select("entry_id", F.col("canonical_id").alias("tag_id")).distinct()
    named = v.entries.select("id", F.posexplode("tags").alias("at", "typed")).withColumn("normalized", casefold(F.col("typed"))).join(tags.select("normalized", "name"), "normalized", "left")
    named = named.withColumn("shown", F.coalesce("name", "typed")).groupBy("id", "shown").agg(F.min(F.struct(F.col("typed") != F.col("shown"), "at")).alias("order"))
    lists = named.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("order", "shown"))), lambda x: x.shown).alias("merged"))
    entries = v.entries.join(lists, "id", "left").withColumn("tags", F.coalesce("merged", "tags")).select(v.entries.columns)
    return v.with_(tags=tags, entry_tags=given, entries=entries)


STEPS: list[tuple[str, Callable[[Vault], Vault]]] = [("flags", flags_for_statuses), ("tags", one_tag_for_each_identity)]


def upgrade(v: Vault, done: DataFrame) -> tuple[Vault, DataFrame]:
    """The vault after the steps that `done` (name) does not have, and the names with them."""
    have = {r.name for r in done.collect()}  # as many as there are steps
    for name, step in STEPS:
        if name not in have:
            v = step(v)
    return v, done.sparkSession.createDataFrame([(n,) for n, _ in STEPS], "name string").unionByName(done.select("name")).distinct()
