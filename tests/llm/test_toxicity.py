import random
import zlib

import numpy as np
import pyarrow as pa
from lodestone.llm import toxicity as T
from pyspark.sql import functions as F

R = random.Random(17)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randrange(2, 8))) for _ in range(800)]


def prose(n):
    return " ".join(R.choice(VOCABULARY) for _ in range(n))


def documents():
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 6 == 0
        words = prose(R.randrange(20, 80)).split()
        if toxic:
            for _ in range(3):
                words.insert(R.randrange(len(words)), R.choice(["vilebad", "vilebads", "zorkish", "zork"]))
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = documents()
    odd = [(9000, None), (9001, ""), (9002, "zork " * 20000), (None, "x"), (9003, "\n")]
    frame = spark.createDataFrame(docs + odd + [docs[6]], "doc_id long, text string").selectExpr("*", "1 as fold", "2 as y")
    known = spark.createDataFrame([*labels, (None, 1), (8888, 0), (3, None), (4, 0)], "doc_id long, toxic int")
    model = T.fit(frame, known)
    got = [(r.doc_id, r.score) for r in T.score(frame, model).collect()]
    assert len(got) == len(docs) + len(odd) + 1 and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    held = [(y, score[d]) for d, y in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert len(held) > 200 and sum((s >= 0.5) == bool(y) for y, s in held) / len(held) > 0.97
    assert score[9001] == score[9000] < 0.5 <= score[9002]
    assert len({s for d, s in got if d == docs[6][0]}) == 1
    assert T.score(frame.limit(0), model).count() == 0


def test_labels_of_one_kind(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert {r.score for r in T.score(frame, T.fit(frame, spark.createDataFrame([], "doc_id long, toxic int"))).collect()} == {0.0}
    assert {r.score for r in T.score(frame, T.fit(frame, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int"))).collect()} == {1.0}


def test_labels_without_documents(spark):
    """An empty table, labels of other documents, and labels of one kind among those that have a document give the share of toxic labels."""
    docs, labels = documents()
    frame, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = T.fit(frame.limit(0), known)
    assert T.score(frame.limit(0), model).count() == 0
    assert all(0.1 < r.score < 0.25 for r in T.score(frame, model).collect())
    away = frame.withColumn("doc_id", F.col("doc_id") + 100_000)
    assert all(0.1 < r.score < 0.25 for r in T.score(away, T.fit(away, known)).collect())
    assert {r.score for r in T.score(frame, T.fit(frame.join(known.where("toxic = 0"), "doc_id").select("doc_id", "text"), known)).collect()} == {0.0}


def test_one_text_for_each_labelled_id(spark):
    docs, labels = documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").unionByName(spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 3).alias("text")))
    rows = T.labelled(frame, spark.createDataFrame(labels, "doc_id long, toxic int"), 200).collect()
    assert len(rows) == 200 == len({r.doc_id for r in rows})
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == r.fold != 0 for r in rows)


def test_features():
    table = np.sort(np.array([T.word_hash("idiot")], np.uint64))
    x = dict(zip(T.FEATURES, T.features(pa.array(["You IDIOT! 1d1ot soooo", None, ""]), table, np.array([4.0])).T, strict=True))
    assert x["strong"][0] == np.log1p(1) and x["near_second_person"][0] > 0 and x["unmasked"][0] == 1 and x["stretched"][0] > 0 and x["shouted"][0] > 0
    assert all(v[1] == v[2] == 0 for v in x.values())


def test_isotonic():
    at, share = T.fit_isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(share) >= 0).all() and (np.diff(at) >= 0).all()


def test_trees_learn():
    r = np.random.default_rng(18)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    margin = T.fit_trees(x[:1000], y[:1000]).margin(x[1000:])
    assert ((margin > 0) == y[1000:]).mean() > 0.95
