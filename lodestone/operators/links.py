"""Links between entries: which entry a reference means, and who refers to whom."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import ascii_lower, title_key
from lodestone.operators.refs import parse_refs
from lodestone.operators.search import top
from lodestone.operators.tags import structural
from lodestone.sources.refstore import slot_of
from lodestone.sources.vault import Vault


#: Keys of one entry are looked up by value up to so many; more are joined.
FEW_KEYS = 500


def resolved(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """References with the entry they mean, if any."""
    index = titles.drop("slot").withColumnRenamed("is_hashtag", "of_hashtag")
    return refs.join(index, (F.col("is_hashtag") == F.col("of_hashtag")) & (F.col("target_text") == F.col("key")), "left").drop("of_hashtag", "key")


def near(table: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of a table with slots that may have some keys (slot). The keys of one entry are few; then Spark reads the buckets of these only."""
    few = [r.slot for r in keys.select("slot").distinct().take(FEW_KEYS + 1)]
    return table.where(F.col("slot").isin(few)) if len(few) <= FEW_KEYS else table.join(keys.select("slot").distinct(), "slot", "left_semi")


def title_keys(entries: DataFrame, entry_id: int) -> DataFrame:
    """(h, key, slot): what means an entry, as a wikilink and as a hashtag."""
    me = entries.where(F.col("id") == entry_id)
    keys = me.select(F.explode(F.array(F.struct(F.lit(False).alias("h"), F.lower("title").alias("key")), F.struct(F.lit(True).alias("h"), title_key(F.col("title")).alias("key")))).alias("k")).select("k.h", "k.key")
    return keys.withColumn("slot", slot_of(F.col("key"), F.col("h")))


def refs_to(vault: Vault, entry_id: int) -> DataFrame:
    """References of other entries to an entry's title, written as a wikilink or as a hashtag. One title has one slot, so of kept references one bucket is read."""
    keys = [tuple(r) for r in title_keys(vault.entries, entry_id).take(2)]  # two of one entry
    wanted = reduce(Column.__or__, [(F.col("is_hashtag") == h) & (F.col("target_text") == key) for h, key, _ in keys], F.lit(False))
    return vault.refs_by_key.where(F.col("slot").isin([slot for *_, slot in keys]) & wanted & (F.col("source_id") != entry_id)).drop("slot")


def backlinks(vault: Vault, entry_id: int) -> DataFrame:
    """References of other entries to an entry's title, with theirs; entries with the same title all have them."""
    sources = vault.entries.select(F.col("id").alias("source_id"), F.col("title").alias("source_title"))
    return refs_to(vault, entry_id).join(sources, "source_id").select("source_id", "source_title", "ordinal", "target_text", "is_hashtag", "heading", "pre", "highlight", "post").orderBy("source_title", "source_id", "ordinal")


def refs_from(vault: Vault, entry_id: int) -> DataFrame:
    """The references of one entry: of kept ones a bucket is read, else its text alone."""
    if vault.store is None and vault.known_refs is None:
        return parse_refs(vault.markdown.where(F.col("entry_id") == entry_id))
    return vault.refs.where(F.col("source_id") == entry_id)


def outgoing_links(vault: Vault, entry_id: int) -> DataFrame:
    """References of an entry that mean another entry; others are dropped."""
    mine = refs_from(vault, entry_id)
    titles = near(vault.titles, mine.select(slot_of(F.col("target_text"), F.col("is_hashtag")).alias("slot")))
    found = resolved(mine, titles).where(F.col("target_id").isNotNull() & (F.col("target_id") != entry_id))
    return found.select("target_id", "target_title", "ordinal", "is_hashtag", "heading", "pre", "highlight", "post").orderBy(F.lower("target_title"), "target_id", "ordinal")


def linked_entries(vault: Vault, entry_id: int) -> DataFrame:
    """(ordinal, id, title): entries named in the frontmatter, in its order and as often; titles compare without the case of A-Z, and of equal ones the first entry is meant."""
    from lodestone.operators.refs import frontmatter_links

    titles = vault.markdown.where(F.col("entry_id") == entry_id).select(F.posexplode(frontmatter_links("markdown")).alias("ordinal", "named"))
    first = vault.entries.groupBy(ascii_lower(F.col("title")).alias("key")).agg(F.min(F.struct("id", "title")).alias("e"))
    return titles.join(first, ascii_lower(F.col("named")) == F.col("key")).select("ordinal", F.col("e.id").alias("id"), F.col("e.title").alias("title")).orderBy("ordinal")


def unindexed_entries(vault: Vault, refs: DataFrame) -> DataFrame:
    return vault.entries.join(refs.select("source_id"), F.col("id") == F.col("source_id"), "left_anti").select("id", "title")


def direct_links(vault: Vault, entry_id: int) -> DataFrame:
    """(direction, id, title): entries that refer to an entry and that it refers to, once each way."""
    come = backlinks(vault, entry_id).select(F.lit("in").alias("direction"), F.col("source_id").alias("id"), F.col("source_title").alias("title"))
    go = outgoing_links(vault, entry_id).select(F.lit("out").alias("direction"), F.col("target_id").alias("id"), F.col("target_title").alias("title"))
    return come.unionByName(go).distinct().orderBy(F.collate("title", "UNICODE"), "direction", "id")


def tag_peers(vault: Vault, entry_id: int, keys: DataFrame) -> DataFrame:
    """(entry_id, key): the other entries that have some tags (key), given or written; of the references only those that name one of them are read."""
    named = near(vault.refs_by_key, keys.select(F.col("key").alias("slot"))).where("is_hashtag").select(F.col("source_id").alias("entry_id"), F.col("target_text").alias("key"))
    return structural(vault).unionByName(named).where(F.col("entry_id") != entry_id).join(keys, "key", "left_semi").distinct()


def hashtag_connections(vault: Vault, entry_id: int) -> DataFrame:
    """(key, id, title): for each tag of an entry the other entries that have it too."""
    written = refs_from(vault, entry_id).where("is_hashtag").select(F.col("target_text").alias("key"))
    mine = structural(vault).where(F.col("entry_id") == entry_id).select("key").unionByName(written).distinct()
    peers = tag_peers(vault, entry_id, mine)
    return peers.join(vault.entries.select(F.col("id"), "title"), F.col("entry_id") == F.col("id")).select("key", "id", "title").orderBy("key", "title", "id")


def connection_total(vault: Vault, entry_id: int) -> DataFrame:
    """(groups, n): how many tags an entry shares, and how many entries are shown under them in all."""
    found = hashtag_connections(vault, entry_id)
    return found.agg(F.count_distinct("key").alias("groups"), F.count(F.lit(1)).alias("n"))


def link_candidates(found: DataFrame, linked: DataFrame, entry_id: int, limit: int = 8) -> DataFrame:
    """The best search results (id, score) that are neither the entry nor linked (id) to it, with their rank. All results are filtered; only what is left is cut to the limit."""
    left = found.where(F.col("id") != entry_id).join(linked.select("id"), "id", "left_anti")
    return top(left, limit).select("rank", "id")
