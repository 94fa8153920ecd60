"""References that are kept, in two layouts: by the entry that they stand in, and by the title or tag that they name.

Each layout is a bucketed, sorted table, so the references of one entry, or to one, lie in one bucket, and Spark reads no other: what that costs does not grow with the vault (the number of buckets does). Titles are clustered like the
references to them. A key that a third of all texts names has its bucket in several files, as the writers are rebalanced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identity import title_key
from lodestone.sources.manifest import Manifest, Stale

#: References of one bucket, about; buckets at least.
BUCKET_ROWS, LEAST = 1_000_000, 8

#: The column that each table is clustered by.
CLUSTERED = {"by_source": "source_id", "by_key": "slot", "titles": "slot"}


def slot_of(key: Column, is_hashtag: Column) -> Column:
    """What a wikilink to a title and the hashtag of that title have in common."""
    return F.when(is_hashtag, key).otherwise(title_key(key))


class RefStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.manifest = spark, Manifest(spark, folder)
        self.state = self.manifest.read()

    def build(self, refs: DataFrame, titles: DataFrame) -> RefStore:
        """Write the layouts of the references (as parse_refs has them) and of title_index, and commit them. If another writer was first, its tables count."""
        first = self.manifest.write(refs, "refs")
        refs = self.spark.read.schema(refs.schema).parquet(first)
        n = max(LEAST, refs.count() // BUCKET_ROWS + 1)
        slotted = refs.withColumn("slot", slot_of(F.col("target_text"), F.col("is_hashtag")))
        tables = {"by_source": refs, "by_key": slotted, "titles": titles.withColumn("slot", slot_of(F.col("key"), F.col("is_hashtag")))}
        state: dict = {"buckets": n, "schemas": {}}
        for layout, table in tables.items():
            by, path = CLUSTERED[layout], self.manifest.new_folder(layout)
            order = [by, "ordinal"] if layout == "by_source" else [by]
            table.hint("rebalance", n, by).write.bucketBy(n, by).sortBy(*order).option("path", path).saveAsTable(self._name(path))
            state[layout] = path
            state["schemas"][layout] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
        try:
            self.manifest.commit(0, state)
        except Stale:
            pass
        self.state = self.manifest.read()
        return self

    @staticmethod
    def _name(path: str) -> str:
        return f"lodestone_{path.rsplit('/', 1)[1].replace('-', '_')}"

    def table(self, layout: str) -> DataFrame:
        """A layout as a bucketed table; a session that has not seen it before is told where it is."""
        path, by = self.state[layout], CLUSTERED[layout]
        if not self.spark.catalog.tableExists(self._name(path)):
            order = f"{by}, ordinal" if layout == "by_source" else by
            self.spark.sql(f"create table if not exists {self._name(path)} ({self.state['schemas'][layout]}) using parquet clustered by ({by}) sorted by ({order}) into {self.state['buckets']} buckets location '{path}'")
        return self.spark.table(self._name(path))
