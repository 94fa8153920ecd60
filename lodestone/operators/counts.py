"""Counts that are kept up by differences: what a change takes away is subtracted and what it brings is added, so no change costs a recount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.entries import sections


def applied(counts: DataFrame, *differences: DataFrame) -> DataFrame:
    """counts (key, n) after differences (key, change); keys of which none is left go. Differences are summed before they meet the counts."""
    both = counts.select("key", F.col("n").cast("long").alias("n"))
    for d in differences:
        both = both.unionByName(d.groupBy("key").agg(F.sum("change").cast("long").alias("n")).select("key", "n"))
    return both.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")


def between(old: DataFrame, new: DataFrame, key: Column) -> DataFrame:
    """(key, change): how counts of a key differ between the old and the new state of some rows."""
    gone = old.select(key.alias("key"), F.lit(-1).alias("change"))
    return gone.unionByName(new.select(key.alias("key"), F.lit(1).alias("change"))).groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0")


def section_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of the six sections, by the entries that a change touched, as they were and as they are."""
    return between(sections(old), sections(new), F.col("section"))


def member_differences(old: DataFrame, new: DataFrame, held: DataFrame) -> DataFrame:
    """(key, change) of tag counts, by the memberships (entry_id, key) that a change took and brought. What an entry has the other way too (held: entry_id, key) counts before and after, and so not here."""
    rest = lambda m: m.select("entry_id", "key").distinct().join(held.select("entry_id", "key"), ["entry_id", "key"], "left_anti")
    return between(rest(old), rest(new), F.col("key"))


def edge_differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change) of edge weights, by the references' edges (source, target, n) as they were and as they are; the key is the edge, its ends parted by a tab."""
    edge = F.concat_ws("\t", "source", "target")
    gone = old.select(edge.alias("key"), (-F.col("n")).alias("change"))
    return gone.unionByName(new.select(edge.alias("key"), F.col("n").alias("change"))).groupBy("key").agg(F.sum("change").alias("change")).where("change <> 0")
