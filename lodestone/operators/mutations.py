"""Changes to a vault, as functions from one version to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.identity import HASHTAG_FIRST, HASHTAG_REST, casefold
from lodestone.operators import refs as R
from lodestone.operators.tags import body_hashtag_entries, entries_by_tag
from lodestone.sources.shared import written
from lodestone.sources.vault import Vault


class InvalidTag(ValueError):
    """A name that could not be written as a hashtag."""


class Conflict(ValueError):
    """A url or tag that exists already."""


class Missing(LookupError):
    """No such entry."""


def valid(name: str) -> bool:
    import re

    return re.fullmatch(rf"[{HASHTAG_FIRST}][{HASHTAG_REST}]*", name) is not None


def _tag(vault: Vault, name: str):
    """The tag of an identity, or None: a point lookup."""
    return next(iter(vault.tags.where(F.col("normalized") == casefold(F.lit(name))).take(1)), None)


def _distinct_names(names: DataFrame, order: str) -> DataFrame:
    """(id, names): the first spelling of each identity, in order."""
    first = names.groupBy("id", casefold(F.col("name")).alias("key")).agg(F.min(F.struct(order, "name")).alias("n"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list("n")).alias("n")).select("id", F.transform("n", lambda n: n["name"]).alias("names"))


def _at(now: str | None):
    """The moment of a change: a given one, or that of the query."""
    return (F.lit(now) if now is not None else F.localtimestamp()).cast("timestamp_ntz")


def _retagged(entries: DataFrame, holders: DataFrame, names: DataFrame, now: str | None) -> DataFrame:
    """Entries of which the holders (entry_id) have new lists of names (id, at, name), without repeated identities, and are stamped; a holder without any name has none."""
    lists = holders.select(F.col("entry_id").alias("holder")).distinct().join(_distinct_names(names, "at"), F.col("holder") == F.col("id"), "left").drop("id")
    met, held = entries.join(lists, F.col("id") == F.col("holder"), "left"), F.col("holder").isNotNull()
    none = F.array().cast("array<string>")
    return met.withColumns({"tags": F.when(held, F.coalesce("names", none)).otherwise(F.col("tags")), "updated_at": F.when(held, _at(now)).otherwise(F.col("updated_at"))}).select(entries.columns)


def add_entry(vault: Vault, entry: dict, markdown: str) -> Vault:
    """A new entry with its text. The url must be new, letter for letter."""
    if vault.entries.where(F.col("url") == entry["url"]).take(1):
        raise Conflict(entry["url"])
    spark = vault.entries.sparkSession
    new_id = (vault.entries.agg(F.max("id")).first()[0] or 0) + 1
    row = {"status": "unread", "tags": [], "flags": [], "read_at": None, "indexed_mtime": None, "updated_at": entry.get("created_at"), **entry, "id": new_id}
    entries = spark.createDataFrame([tuple(row.get(c) for c in vault.entries.columns)], vault.entries.schema)
    page = spark.createDataFrame([(new_id, markdown)], "entry_id long, markdown string")
    return vault.with_(entries=vault.entries.unionByName(entries), markdown=vault.markdown.unionByName(page, allowMissingColumns=True))


def update_status(vault: Vault, entry_id: int, status: str, now: str) -> Vault:
    """Reading stamps read_at every time; marking as unread leaves it."""
    mine, at = F.col("id") == entry_id, F.lit(now).cast("timestamp_ntz")
    entries = vault.entries.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "updated_at": F.when(mine, at).otherwise(F.col("updated_at"))})
    return vault.with_(home=vault.home, entries=entries.withColumn("read_at", F.when(mine & F.lit(status == "read"), at).otherwise(F.col("read_at"))))


def update_flags(vault: Vault, entry_id: int, flags: Sequence[str], now: str | None = None) -> Vault:
    mine = F.col("id") == entry_id
    changes = {"flags": F.when(mine, F.lit(list(flags)).cast("array<string>")).otherwise(F.col("flags")), "updated_at": F.when(mine, _at(now)).otherwise(F.col("updated_at"))}
    return vault.with_(home=vault.home, entries=vault.entries.withColumns(changes))


def update_tags(vault: Vault, entry_id: int, names: Sequence[str], now: str | None = None) -> Vault:
    """Replace an entry's tags. Unknown names must be valid hashtags; all are checked before anything changes. The entry keeps names as typed, the tag its first spelling."""
    spark = vault.entries.sparkSession
    typed = list(dict.fromkeys(names))
    wanted = spark.createDataFrame([(i, n) for i, n in enumerate(typed)], "i int, name string").withColumn("normalized", casefold(F.col("name")))
    new = wanted.join(vault.tags.select("normalized"), "normalized", "left_anti").groupBy("normalized").agg(F.min_by("name", "i").alias("name"))
    for r in new.collect():  # at most as many as were passed in
        if not valid(r["name"]):
            raise InvalidTag(r["name"])
    tags = vault.tags.unionByName(new.select(F.xxhash64("normalized").alias("id"), "name", "normalized"))
    given = wanted.join(tags.drop("name"), "normalized").select(F.lit(entry_id).cast("long").alias("entry_id"), F.col("id").alias("tag_id")).distinct()
    rest = vault.entry_tags.where(F.col("entry_id") != entry_id)
    mine = F.col("id") == entry_id
    entries = vault.entries.withColumns({"tags": F.when(mine, F.lit(typed).cast("array<string>")).otherwise(F.col("tags")), "updated_at": F.when(mine, _at(now)).otherwise(F.col("updated_at"))})
    return vault.with_(home=vault.home, tags=tags, entry_tags=rest.unionByName(given), entries=entries)


def create_tag(vault: Vault, name: str) -> tuple[Vault, str, int]:
    """The vault with the tag, its name (an existing one keeps its own) and how many entries have it."""
    found = _tag(vault, name)
    if found is None and not valid(name):
        raise InvalidTag(name)
    n = entries_by_tag(vault, name).count()
    if found is not None:
        return vault, found["name"], n
    row = vault.tags.sparkSession.range(1).select(F.xxhash64(casefold(F.lit(name))).alias("id"), F.lit(name).alias("name"), casefold(F.lit(name)).alias("normalized"))
    return vault.with_(home=vault.home, tags=vault.tags.unionByName(row)), name, n


def _rewritten(vault: Vault, old: str, changed) -> dict[str, DataFrame]:
    """Markdown with a struct (markdown, changed) applied to the texts that have the hashtag, and the references after it. Only these texts are rewritten and read again, once."""
    holders = body_hashtag_entries(vault, old)
    mine = vault.markdown.join(holders, "entry_id", "left_semi").withColumn("markdown", changed.getField("markdown"))
    mine = written(mine.select(vault.markdown.columns), "rewritten")
    return {"markdown": vault.markdown.join(mine.select("entry_id"), "entry_id", "left_anti").select(mine.columns).unionByName(mine), "known_refs": index_refs(vault, mine)}


def rename_tag(vault: Vault, old: str, new: str, merge: bool = False, now: str | None = None) -> Vault | None:
    """Give a tag another name, in the tag list, on entries and in texts; None if nothing has the old one.

    A name that is new must be a valid hashtag, and so must any that goes into texts. If another tag has the new name, it is a conflict, unless both are to be merged; then the other's spelling wins.
    """
    has_row, other = _tag(vault, old), _tag(vault, new)
    in_text = bool(body_hashtag_entries(vault, old).take(1))
    same = old.casefold() == new.casefold()
    if has_row is None and not in_text:
        return None
    if not valid(new) and (in_text or other is None):
        raise InvalidTag(new)
    moved = has_row is not None and other is not None and not same
    if moved and not merge:
        raise Conflict(new)
    name = other["name"] if moved else new
    key_old, key_new = F.lit(old.casefold()), F.lit(new.casefold())
    tags, entry_tags, entries = vault.tags, vault.entry_tags, vault.entries
    if has_row is not None:
        if moved:
            tags = tags.where(F.col("normalized") != key_old)
            entry_tags = entry_tags.withColumn("tag_id", F.when(F.col("tag_id") == has_row["id"], F.lit(other["id"])).otherwise(F.col("tag_id"))).distinct()
        else:
            mine = F.col("normalized") == key_old
            tags = tags.withColumn("name", F.when(mine, F.lit(name)).otherwise(F.col("name"))).withColumn("normalized", F.when(mine, key_new).otherwise(F.col("normalized")))
        # Only the entries that have the tag are taken apart; equal identities are named once.
        holders = vault.entry_tags.where(F.col("tag_id") == has_row["id"]).select("entry_id")
        named = entries.join(holders.withColumnRenamed("entry_id", "id"), "id", "left_semi").select("id", F.posexplode("tags").alias("at", "name"))
        entries = _retagged(entries, holders, named.withColumn("name", F.when(casefold(F.col("name")) == key_old, F.lit(name)).otherwise(F.col("name"))), now)
    texts = _rewritten(vault, old, R.rename_hashtag(F.col("markdown"), key_old, F.lit(name))) if in_text else {"known_refs": vault.refs}
    return vault.with_(tags=tags, entry_tags=entry_tags, entries=entries, **texts)


def delete_tag(vault: Vault, name: str, now: str | None = None) -> Vault:
    """Take a tag from the list and from the entries that have it, and put what is written in texts in backticks."""
    key = F.lit(name.casefold())
    gone = vault.tags.where(F.col("normalized") == key).select(F.col("id").alias("tag_id"))
    holders = vault.entry_tags.join(gone, "tag_id", "left_semi").select("entry_id")
    named = vault.entries.join(holders.withColumnRenamed("entry_id", "id"), "id", "left_semi").select("id", F.posexplode("tags").alias("at", "name")).where(casefold(F.col("name")) != key)
    texts = _rewritten(vault, name, R.neutralize_hashtag(F.col("markdown"), key))
    return vault.with_(tags=vault.tags.where(F.col("normalized") != key), entry_tags=vault.entry_tags.join(gone, "tag_id", "left_anti").select("entry_id", "tag_id"), entries=_retagged(vault.entries, holders, named, now), **texts)


def hard_delete(vault: Vault, entry_id: int) -> Vault:
    """An entry with its tags given, text and references; the tags themselves stay."""
    refs = vault.refs.where(F.col("source_id") != entry_id)
    return vault.with_(entries=vault.entries.where(F.col("id") != entry_id), entry_tags=vault.entry_tags.where(F.col("entry_id") != entry_id), markdown=vault.markdown.where(F.col("entry_id") != entry_id), known_refs=refs)


def index_refs(vault: Vault, changed: DataFrame) -> DataFrame:
    """The references after some texts (entry_id, markdown) changed: theirs are read anew, all others stay."""
    fresh = R.parse_refs(changed)
    return vault.refs.join(changed.select(F.col("entry_id").alias("source_id")), "source_id", "left_anti").select(fresh.columns).unionByName(fresh)


def stale_entries(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(id, drifted): entries whose file changed since it was indexed, or that never were; entries without a file are passed over."""
    met = entries.join(files.select("file_path", "mtime"), "file_path")
    return met.where(F.col("indexed_mtime").isNull() | (F.col("mtime") != F.col("indexed_mtime"))).select("id", F.col("indexed_mtime").isNotNull().alias("drifted"))


def set_link(vault: Vault, a: int, b: int, on: bool = True) -> Vault:
    """Link two entries in both texts' frontmatter, or part them."""
    titles = {r["id"]: r["title"] for r in vault.entries.where(F.col("id").isin(a, b)).select("id", "title").take(2)}
    if {a, b} - set(titles):
        raise Missing(f"{a}, {b}")
    other = F.when(F.col("entry_id") == a, F.lit(titles[b])).when(F.col("entry_id") == b, F.lit(titles[a]))
    none = F.lit(None).cast("string")
    changed = R.update_linked("markdown", other if on else none, none if on else other)
    mine = written(vault.markdown.where(F.col("entry_id").isin(a, b)).withColumn("markdown", changed), "linked")
    rest = vault.markdown.where(~F.col("entry_id").isin(a, b))
    return vault.with_(markdown=rest.unionByName(mine), known_refs=index_refs(vault, mine))


def patch_entry(vault: Vault, entry_id: int, now: str, status: str | None = None, flags: Sequence[str] | None = None, tags: Sequence[str] | None = None, markdown: str | None = None) -> Vault:
    """Several changes to one entry, in this order; the last version has all, or none if a tag is invalid."""
    if not vault.entries.where(F.col("id") == entry_id).take(1):
        raise Missing(str(entry_id))
    before = vault
    if status is not None:
        vault = update_status(vault, entry_id, status, now)
    if flags is not None:
        vault = update_flags(vault, entry_id, flags, now)
    if tags is not None:
        vault = update_tags(vault, entry_id, tags, now)
    if markdown is not None:
        changed = vault.markdown.withColumn("markdown", F.when(F.col("entry_id") == entry_id, F.lit(markdown)).otherwise(F.col("markdown")))
        vault = vault.with_(markdown=changed, known_refs=index_refs(before, changed.where(F.col("entry_id") == entry_id)))
    return vault
