"""Tags: an entry has those given to it and those written in its text; both count alike, by identity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.identity import casefold, is_hashtag_name
from lodestone.sources.vault import Vault


def structural(vault: Vault) -> DataFrame:
    """(entry_id, key): tags given to entries, by identity. Spark broadcasts the tags if they are few."""
    return vault.entry_tags.join(vault.tags, F.col("tag_id") == F.col("id")).select("entry_id", F.col("normalized").alias("key"))


def hashtags(vault: Vault) -> DataFrame:
    """(entry_id, key): tags in the text of entries, once each."""
    return vault.refs.where("is_hashtag").select(F.col("source_id").alias("entry_id"), F.col("target_text").alias("key")).distinct()


def members(vault: Vault) -> DataFrame:
    """(entry_id, key), each once, whichever way the tag came."""
    return structural(vault).unionByName(hashtags(vault)).distinct()


def body_hashtag_entries(vault: Vault, tag: str) -> DataFrame:
    """Entries with the tag in their text; none if it could not be written there."""
    key = tag.casefold()
    named = vault.refs_by_key.where((F.col("slot") == key) & F.col("is_hashtag") & (F.col("target_text") == key))
    return named.where(is_hashtag_name(F.lit(tag))).select(F.col("source_id").alias("entry_id")).distinct()


def entries_by_tag(vault: Vault, tag: str) -> DataFrame:
    key = casefold(F.lit(tag))
    given = structural(vault).where(F.col("key") == key).select("entry_id")
    return given.unionByName(body_hashtag_entries(vault, tag)).distinct()


def tag_body_count(vault: Vault, tag: str) -> DataFrame:
    return body_hashtag_entries(vault, tag).agg(F.count(F.lit(1)).alias("n"))


def tag_counts(vault: Vault) -> DataFrame:
    """(name, key, n): every tag with its number of entries, given tags without entries too; names as given, else as written."""
    n = members(vault).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = n.join(vault.tags.select(F.col("normalized").alias("key"), "name"), "key", "full_outer")
    return both.select(F.coalesce("name", "key").alias("name"), "key", F.coalesce("n", F.lit(0)).alias("n"))


def content_hashtags(vault: Vault) -> DataFrame:
    """(entry_id, content_tags): names of the tags in a text, sorted; a given tag's casing wins. Entries without any are left out."""
    found = hashtags(vault).join(vault.tags.select(F.col("normalized").alias("key"), "name"), "key", "left")
    return found.groupBy("entry_id").agg(F.array_sort(F.collect_set(F.coalesce("name", "key"))).alias("content_tags"))


def tag_merge(raw_tags: DataFrame, raw_entry_tags: DataFrame) -> DataFrame:
    """Old vaults may have one identity under several spellings: (tag_id, canonical_id, name) maps each to the spelling with most members, of equals the lowest id."""
    sized = raw_tags.join(raw_entry_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n")), F.col("id") == F.col("tag_id"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")).withColumn("key", casefold(F.col("name")))
    best = sized.groupBy("key").agg(F.min_by(F.struct("id", "name"), F.struct(-F.col("n"), "id")).alias("best"))
    return sized.join(best, "key").select(F.col("id").alias("tag_id"), F.col("best.id").alias("canonical_id"), F.col("best.name").alias("name"))


def tag_suggestions(vault: Vault, typed: str, assigned: DataFrame, limit: int = 6) -> DataFrame:
    """The first tags (rank, name) in the order of the tag list that contain what is typed and are not assigned (name) yet."""
    found = tag_counts(vault).where(F.contains(F.lower("name"), F.lit(typed.lower()))).join(assigned.select(F.lower("name").alias("low")), F.lower(F.col("name")) == F.col("low"), "left_anti")
    top = found.withColumn("order", casefold(F.col("name"))).orderBy("order", "key").limit(limit)
    return top.select(F.row_number().over(Window.orderBy("order", "key")).alias("rank"), "name")


def tags_of_entry(vault: Vault, entry_id: int) -> DataFrame:
    """(name, key, n): the lines of the tag list that an entry names, letter for letter."""
    named = vault.entries.where(F.col("id") == entry_id).select(F.explode("tags").alias("name"))
    return tag_counts(vault).join(named, "name", "left_semi")
