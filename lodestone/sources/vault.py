"""A vault: the tables of a library of pages and notes, from files or from other tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identity import casefold
from lodestone.operators.refs import parse_refs, title_index
from lodestone.sources.refstore import RefStore, slot_of
from lodestone.sources.shared import shared_dir, written
from lodestone.sources.sink import write_files


@dataclass(frozen=True)
class Vault:
    """One version of a vault. Operators read it; mutations give a new one."""

    entries: DataFrame
    tags: DataFrame
    entry_tags: DataFrame
    markdown: DataFrame
    known_refs: DataFrame | None = field(default=None)
    #: Where what is derived from the vault is kept, if anywhere: references, and the search index.
    home: str | None = field(default=None)

    @cached_property
    def store(self) -> RefStore | None:
        """The references that are kept at the vault's home; the first who asks reads them from the texts."""
        if self.home is None or self.known_refs is not None:
            return None
        store = RefStore(self.entries.sparkSession, f"{self.home}/refs")
        return store if store.state else store.build(parse_refs(self.markdown), title_index(self.entries))

    @cached_property
    def refs(self) -> DataFrame:
        """References as indexed or kept, or else read from the Markdown: once, into the shared folder, however often a query asks for them."""
        if self.store is not None:
            return self.store.table("by_source")
        return self.known_refs if self.known_refs is not None else written(parse_refs(self.markdown), "refs")

    @cached_property
    def refs_by_key(self) -> DataFrame:
        """References with their slot, clustered by it if they are kept."""
        return self.store.table("by_key") if self.store is not None else self.refs.withColumn("slot", slot_of(F.col("target_text"), F.col("is_hashtag")))

    @cached_property
    def titles(self) -> DataFrame:
        """title_index with slots, clustered by them if it is kept."""
        return self.store.table("titles") if self.store is not None else title_index(self.entries).withColumn("slot", slot_of(F.col("key"), F.col("is_hashtag")))

    def with_(self, **changes: DataFrame) -> Vault:
        """Another version. It has no home, as what is kept there belongs to the texts and titles as they were; a change that leaves these alone passes `home` on."""
        return replace(self, **{"home": None, **changes})


#: The vault that the driver's tables stand for, in SQL that two engines read alike.
VIEWS = {
    "v_titles": """
select doc_id + 1 as id,
 coalesce(nullif(trim(substr(translate(split_part(text, chr(10), 1), '[]|#"', '     '), 1, 60)), ''), 'Untitled ' || cast(doc_id as varchar(20))) as title
from documents""",
    "v_entries": """
select d.doc_id + 1 as id, t.title,
 'https://' || d.source || '.example.org/' || d.lang || '/' || cast(d.doc_id as varchar(20)) as url,
 case d.doc_id % 10 when 7 then 'youtube' when 8 then 'substack' when 9 then 'x' else 'article' end as source_type,
 e.ts as created_at,
 case when l.quality = 1 then 'read' else 'unread' end as status,
 case when l.quality = 1 then e.ts end as read_at,
 coalesce(l.toxic, 0) = 1 as is_archive, d.doc_id % 7 = 0 as is_bookmark, d.doc_id % 11 = 0 as is_gem
from documents d join v_titles t on t.id = d.doc_id + 1
join events e on e.event_id = d.doc_id left join labels l on l.doc_id = d.doc_id""",
    "v_tag_raw": """
select doc_id + 1 as entry_id, case when doc_id % 3 = 0 then upper(lang) else lang end as name from documents
union all select doc_id + 1, source from documents where doc_id % 4 = 0""",
    "v_markdown": """
select d.doc_id + 1 as entry_id,
 '---' || chr(10) || 'title: "' || t.title || '"' || chr(10) ||
 case when d.doc_id % 5 = 0 then 'linked: ["' || t2.title || '"]' || chr(10) else '' end || '---' || chr(10) || chr(10) ||
 '# ' || t.title || ' #' || d.source || chr(10) || chr(10) || d.text || chr(10) || chr(10) ||
 'See [[' || t3.title || '|alias]] and [[Missing ' || cast(d.doc_id % 9 as varchar(20)) || ']] #' || upper(d.lang) || ' `#code` #' || d.lang || '-note' || chr(10) ||
 '```' || chr(10) || '#fenced [[' || t2.title || ']]' || chr(10) || '```' || chr(10) as markdown
from documents d join v_titles t on t.id = d.doc_id + 1
join v_titles t2 on t2.id = (d.doc_id * 7 + 3) % (select count(*) from documents) + 1
join v_titles t3 on t3.id = (d.doc_id * 13 + 5) % (select count(*) from documents) + 1""",
}


def from_tables(spark: SparkSession, sf_dir: str) -> Vault:
    """The vault of the driver's tables documents, events and labels."""
    for name in ("documents", "events", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    for name, text in VIEWS.items():
        spark.sql(text).createOrReplaceTempView(name)
    raw = spark.table("v_tag_raw").withColumn("normalized", casefold(F.col("name")))
    flags = F.array_compact(F.array(*[F.when(F.col(f"is_{f}"), F.lit(f)) for f in ("bookmark", "gem", "archive")]))
    typed = raw.groupBy("entry_id").agg(F.sort_array(F.collect_list("name")).alias("tags"))
    entries = spark.table("v_entries").withColumn("flags", flags).join(typed, F.col("id") == F.col("entry_id"), "left").drop("entry_id")
    entries = entries.select("id", "title", "url", F.concat(F.lit("pages/"), F.col("id"), F.lit(".md")).alias("file_path"), "source_type", "created_at", F.col("created_at").alias("updated_at"), "status", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "flags", "read_at", F.lit(None).cast("double").alias("indexed_mtime"))
    # Identities are their own ids: a hash needs no global numbering.
    tags = raw.groupBy("normalized").agg(F.min_by("name", "entry_id").alias("name")).select(F.xxhash64("normalized").alias("id"), "name", "normalized")
    entry_tags = raw.select("entry_id", F.xxhash64("normalized").alias("tag_id")).distinct()
    return Vault(entries, tags, entry_tags, spark.table("v_markdown"), home=home_of(spark, sf_dir))


def home_of(spark: SparkSession, sf_dir: str) -> str:
    """A folder for what is derived from these tables as they are now: other bytes or times of theirs mean another folder."""
    told = [sf_dir]
    for name in ("documents", "events", "labels"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        told += [str(fs.getFileStatus(path).getModificationTime()), str(fs.getContentSummary(path).getLength())]
    return f"{shared_dir(spark).rstrip('/')}/vaults/{sha256('|'.join(told).encode()).hexdigest()[:32]}"


def read_markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder tree as (file_path, markdown, mtime); what is missing is simply not there."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("markdown"), F.col("modificationTime").cast("double").alias("mtime"))


def write_pages(pages: DataFrame, folder: str) -> int:
    """Write (file_path, markdown) as one file each, all or none; of pages with one path the last in order of markdown stays. Returns how many."""
    once = written(pages.groupBy("file_path").agg(F.max("markdown").alias("markdown")), "pages")
    write_files(once.select(F.col("file_path").alias("path"), F.col("markdown").cast("binary").alias("content")), folder)
    return once.count()
