"""Reading entries: lookups, lists, sections, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUBLIC = ["id", "title", "url", "file_path", "source_type", "created_at", "updated_at", "status", "tags", "flags"]
#: Ids are broadcast up to this many; more are joined.
FEW_IDS = 10_000


def has(flag: str) -> Column:
    return F.coalesce(F.array_contains("flags", flag), F.lit(False))


def get_entry(entries: DataFrame, entry_id: int) -> DataFrame:
    return entries.where(F.col("id") == entry_id).select(PUBLIC)


def entries_by_ids(entries: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Entries of known ids; unknown ones are passed over and repeats count once."""
    if not ids:
        return entries.select(PUBLIC).limit(0)
    wanted = entries.sparkSession.createDataFrame([(i,) for i in set(ids)], "id long")
    return entries.join(F.broadcast(wanted) if len(set(ids)) <= FEW_IDS else wanted, "id", "left_semi").select(PUBLIC)


def all_titles(entries: DataFrame) -> DataFrame:
    return entries.select("id", "title").orderBy("id")


def select_entries(entries: DataFrame, status: str | None = None, flag: str | None = None, exclude_flag: str | None = None) -> DataFrame:
    if status is not None:
        entries = entries.where(F.col("status") == status)
    if flag is not None:
        entries = entries.where(has(flag))
    if exclude_flag is not None:
        entries = entries.where(~has(exclude_flag))
    return entries


def order_of(sort_by: str = "created_at", sort_dir: str = "desc") -> list[Column]:
    """An unknown column means created_at and any direction but `asc` means descending; ids settle ties."""
    column = sort_by if sort_by in ("title", "created_at") else "created_at"
    return [F.asc(column) if sort_dir == "asc" else F.desc(column), F.asc("id")]


def list_entries(entries: DataFrame, status: str | None = None, flag: str | None = None, exclude_flag: str | None = None, sort_by: str = "created_at", sort_dir: str = "desc") -> DataFrame:
    return select_entries(entries, status, flag, exclude_flag).select(PUBLIC).orderBy(*order_of(sort_by, sort_dir))


def tag_order_of(sort_by: str = "created_at", sort_dir: str = "desc") -> list[Column]:
    key = F.lower("title") if sort_by == "title" else F.col("created_at")
    return [key.desc() if sort_dir.lower() == "desc" else key.asc(), F.asc("id")]


def list_by_tag(entries: DataFrame, members: DataFrame, status: str | None = None, flag: str | None = None, exclude_flag: str | None = None, sort_by: str = "created_at", sort_dir: str = "desc") -> DataFrame:
    """Entries among members (entry_id). Titles sort without case here, and any direction but `desc`, in any case, is ascending."""
    found = select_entries(entries, status, flag, exclude_flag).join(members, F.col("id") == F.col("entry_id"), "left_semi")
    return found.select(PUBLIC).orderBy(*tag_order_of(sort_by, sort_dir))


def sections(entries: DataFrame) -> DataFrame:
    """(id, section): every section that an entry is in; only archive shows archived ones."""
    archived = has("archive")
    names = [F.lit("library"), F.when(F.col("status") == "unread", F.lit("unread")), F.when(F.col("status") == "read", F.lit("read")), F.when(has("bookmark"), F.lit("bookmark")), F.when(has("gem"), F.lit("gem"))]
    inside = F.when(archived, F.array(F.lit("archive"))).otherwise(F.array_compact(F.array(*names)))
    return entries.select("id", F.explode(inside).alias("section"))


def section_counts(entries: DataFrame) -> DataFrame:
    """One row with the six counts, in one pass. An empty vault has zeros."""
    live = ~has("archive")
    return entries.agg(
        F.count_if(live).alias("library"),
        F.count_if(live & (F.col("status") == "unread")).alias("unread"),
        F.count_if(live & (F.col("status") == "read")).alias("read"),
        F.count_if(live & has("bookmark")).alias("bookmark"),
        F.count_if(live & has("gem")).alias("gem"),
        F.count_if(~live).alias("archive"),
    )


def read_metrics(entries: DataFrame, as_of: str) -> DataFrame:
    """Reads since the beginning of the week (a Sunday), month and year of a moment; later reads count too."""
    day = F.to_date(F.lit(as_of))
    week = F.date_sub(day, F.dayofweek(day) - 1)
    since = lambda start: F.count_if(F.col("read_at") >= start.cast("timestamp_ntz"))
    return entries.agg(since(week).alias("week"), since(F.trunc(day, "month")).alias("month"), since(F.trunc(day, "year")).alias("year"))


def entry_out(entries: DataFrame, content_tags: DataFrame) -> DataFrame:
    """Entries as they are shown, with tags found in their text (entry_id, content_tags) beside those given to them."""
    none = F.array().cast("array<string>")
    return entries.select(PUBLIC).join(content_tags, F.col("id") == F.col("entry_id"), "left").drop("entry_id").withColumn("content_tags", F.coalesce("content_tags", none))


def toggle_flag(flags: Column, flag: str) -> Column:
    """Flags after a click on one: archive clears the others, and the others clear archive."""
    one = F.array(F.lit(flag))
    without = F.array_except(flags, one)
    with_it = one if flag == "archive" else F.array_union(F.array_except(flags, F.array(F.lit("archive"))), one)
    return F.when(F.array_contains(flags, flag), without).otherwise(with_it)


def migrate_legacy(entries: DataFrame) -> DataFrame:
    """Statuses of old vaults become flags: a favorite is an unread bookmark, a recommended one an unread gem; read entries take updated_at as read_at."""
    flag = F.create_map(F.lit("favorite"), F.lit("bookmark"), F.lit("recommend"), F.lit("gem"))[F.col("status")]
    old = entries.withColumn("flags", F.when(flag.isNotNull(), F.array(flag)).otherwise(F.col("flags"))).withColumn("status", F.when(flag.isNotNull(), F.lit("unread")).otherwise(F.col("status")))
    return old.withColumn("read_at", F.when(F.col("status") == "read", F.col("updated_at")).otherwise(F.col("read_at")))


def reading_stats(text: Column) -> Column:
    """struct (words, chars, minutes): 200 words a minute, half a minute rounded up, one minute at least."""
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.struct(words.alias("words"), F.length(text).alias("chars"), F.greatest(F.lit(1), F.floor(words / 200 + 0.5)).cast("int").alias("minutes"))
