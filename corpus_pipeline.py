"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Stages get (spark, docs, sf_dir) and return documents with the columns of the table; the last returns the encoded documents. Each applies an operator of
`lodestone.llm` to all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chunk_dedup, decontaminate, jaccard, pieces, toxicity
from lodestone.llm.exchange import scope, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Calibrated share of toxic texts from which one is rejected.
TOXIC = 0.5
#: Near duplicates: shingles of five words, a similarity of 0.8.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; the model is fitted on the labels of the tables' folder.

    Each row is judged by its whole text, so repeated rows go or stay together; null and empty texts score as texts without words, very long ones by all their words; without documents or labels of both kinds the score is the share of toxic labels.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs.select(COLUMNS), model).where(F.col("score") < TOXIC).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id, and of rows with equal doc_id and text (nulls are equal) one, with the least lang, source and n_chars.

    Every text is linked by itself: of several texts of one doc_id only those that are near another go, and these, like texts without doc_id, stay only where no document with an id of its own is near. Texts without words are linked with
    nothing; very long texts count with all their shingles; an empty table gives no rows.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("h"))
    again = written(rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h").distinct(), "again")
    if not again.isEmpty():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        once = rows.join(again, "h", "left_semi").groupBy("doc_id", "text", "h").agg(F.min(F.struct(*rest)).alias("first")).select("doc_id", "text", "first.*", "h")
        rows = rows.join(again, "h", "left_anti").select(*COLUMNS, "h").unionByName(once.select(*COLUMNS, "h"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    several = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("d")), "several")
    keyed = rows.withColumn("key", F.col("doc_id"))
    if not several.isEmpty():
        spare = 1 + (rows.agg(F.max("doc_id")).first()[0] or 0)
        extra = rows.join(several, same("doc_id", "d"), "left_semi").select(F.col("doc_id").alias("d"), F.col("h").alias("dh")).distinct()
        extra = written(extra.withColumn("key", F.monotonically_increasing_id() + spare), "extra")
        keyed = keyed.join(several, same("doc_id", "d"), "left_anti").unionByName(rows.join(extra, same("doc_id", "d") & same("h", "dh")).select(*COLUMNS, "h", "key"))
    gone = jaccard.jaccard_components(keyed.select(F.col("key").alias("doc_id"), "text"), SHINGLE, PERCENT).where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(gone, "key", "left_anti").select(COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their later repeats. A document of which nothing but white space stays goes, unless it had no more before.

    The first place of a passage is that of the least doc_id (null comes first); null texts become empty; repeated rows count as one text; very long texts are cut and judged whole; an empty table gives no rows.
    """
    out = chunk_dedup.dedup_substrings(docs, keep=COLUMNS)
    kept = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Each row is judged by its own text: of several texts of one doc_id (or of none) only those that hold a window go. Null and empty texts stay, very long ones are searched to their end; an empty benchmark leaves all.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).distinct()
    return docs.select(COLUMNS).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("h")), "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the digest of the text that the ids give back.

    Null texts are empty and give no ids; very long texts are encoded in chunks; every row comes out, repeated or not; an empty table gives no rows.
    """
    out = pieces.encode(docs, decoded=True)
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_each_group), ("substring_dedup", drop_repeats), ("decontamination", drop_leaks), ("pieces", encode)]

#: Neither the boosted trees nor the piece model can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. A stage's own tables and its documents are deleted once the next stage has written its result, and all of them if one fails."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as tables:
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            tables.drop(spark, keep=[docs])
    return docs
