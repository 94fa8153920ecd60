"""Exact duplicates: the filter, the index under insertions and deletions, and the odd rows."""

import random

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import exact_dedup
from lodestone.llm.cuckoo import Cuckoo
from pyspark.sql import functions as F

DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (7, "x" * 300_000), (8, "x " * 300_000), (9, "A b"), (3, "a  b"), (3, "a  b"), (None, "a  b"), (None, "alone"), (10, "a\xa0b"), (11, "é😀"), (12, "e\u0301😀"), (13, "é 😀")]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as digest", "'r' as row", "2 as n", "3 as bucket", "4 as kind")


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex()) for r in df.collect()), key=repr)


def test_rows(spark):
    docs = frame(spark, DOCS)
    assert found(exact_dedup.exact_duplicates(docs)) == sorted(brute.kept(DOCS), key=repr)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


def test_a_group_of_most_rows(spark):
    docs = [(i, "same text" if i % 3 else f"text {i // 2}") for i in range(6000)]
    assert found(exact_dedup.exact_duplicates(frame(spark, docs).repartition(7), bucket_keys=100)) == sorted(brute.kept(docs), key=repr)



def consistent(index):
    """Every live digest is in its filter, and filters hold as many fingerprints as there are keys."""
    filters = {r.bucket: Cuckoo(r["size"], r["filter"]) for r in index.filters.collect()}
    rows = index.keys.collect()
    for r in rows:
        assert filters[r.bucket].has(np.frombuffer(bytes(r.digest), np.uint64)[:1]).all()
    assert sum(int((f.table > 0).sum()) for f in filters.values()) == len(rows)


def test_insertions_and_deletions(spark):
    r, live = random.Random(5), []
    index = exact_dedup.empty_index(spark, 3)
    for step in range(3):
        new = [(1000 * step + i, " ".join(str(r.randrange(400)) for _ in range(r.choice((1, 1, 3))))) for i in range(700)]
        index = exact_dedup.insert(index, frame(spark, new))
        live += new
        assert found(exact_dedup.groups(index)) == sorted(brute.kept(live), key=repr)
        consistent(index)
        gone = {d for d, _ in r.sample(live, 250)} | {-1}
        index = exact_dedup.delete(index, spark.createDataFrame([(g,) for g in gone] + [(None,)], "doc_id long"))
        live = [d for d in live if d[0] not in gone]
        assert found(exact_dedup.groups(index)) == sorted(brute.kept(live), key=repr)
        consistent(index)
    index = exact_dedup.delete(index, index.members.select("doc_id"))
    assert exact_dedup.groups(index).count() == 0 and index.keys.count() == 0
    consistent(index)
    again = exact_dedup.insert(index, frame(spark, DOCS))
    assert found(exact_dedup.groups(again)) == sorted(brute.kept(DOCS), key=repr)


def test_overflow_remakes_a_filter_from_the_stored_keys(spark):
    texts = lambda low, high: spark.range(low, high).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    index = exact_dedup.insert(exact_dedup.empty_index(spark, 2), texts(0, 400))
    before = {r.bucket: r["size"] for r in index.filters.collect()}
    index = exact_dedup.insert(index, texts(300, 1200))
    after = {r.bucket: r["size"] for r in index.filters.collect()}
    assert all(after[b] > before[b] for b in before)
    consistent(index)
    assert index.keys.count() == 1200 and index.keys.where("n = 2").count() == 100


def test_false_hits_are_told_apart(spark, monkeypatch):
    """With a filter that says yes to everything all keys are verified, and none is merged with another."""
    monkeypatch.setattr(Cuckoo, "has", lambda self, keys: np.ones(len(keys), bool))
    bucket = exact_dedup.Bucket()
    digest = np.arange(40, dtype=np.uint64).reshape(10, 4)
    ones = np.ones(10, np.int64)
    for _ in range(2):
        bucket.insert(exact_dedup.Records(digest, ones, ones, ones == 0, ones, ones))
    assert len(bucket.at) == 10 and (bucket.touched().n == 2).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=600), st.data())
def test_filter(keys, data):
    keys = np.array(keys, np.uint64)
    made = Cuckoo.of(keys)
    assert made.has(keys).all() and int((made.table > 0).sum()) == len(keys)
    cut = data.draw(st.integers(0, len(keys)))
    made.delete(keys[:cut])
    assert made.has(keys[cut:]).all() and int((made.table > 0).sum()) == len(keys) - cut
