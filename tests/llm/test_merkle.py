"""Merkle manifests: a plain version, traversal against whole trees, and the odd rows."""

import random

import brute
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import merkle, queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(spark, docs, path):
    frame = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as leaf", "2 as node", "3 as rank", "4 as key", "5 as g0", "6 as place", "7 as n", "8 as claim")
    frame.write.parquet(f"{path}/documents.parquet")
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in queries.op13_merkle(spark, str(path)).collect()), key=repr)


def expected(docs):
    return sorted(((*m, m[3] == m[5]) for m in brute.manifest(docs)), key=repr)


def test_rows(spark, tmp_path):
    r = random.Random(3)
    docs = [(i, r.choice(["a", None, "", "é"]), r.choice(["en"] * 6 + ["de", "fr", "É", None, ""]), r.choice([None, i]), r.choice([None, "", "Text", "text", f"T{i} 😀"])) for i in range(1500)]
    docs += [docs[5]] * 20 + [(None, None, None, None, None)] * 3 + [(None, "s", "en", 1, "A"), (7, "s", "en", 1, "Second text of 7"), (-5, "s", "zz", 1, "X" * 500_000), (9**15, "s", "lone", 1, "Q")]
    r.shuffle(docs)
    got = rows_of(spark, docs, tmp_path)
    assert got == expected(docs)
    assert len({x[3] for x in got}) == 1 and {x[6] for x in got} == {True, False}


def test_small_tables(spark, tmp_path):
    for k, docs in enumerate([[], [(1, "s", "en", 1, "One")], [(i, "s", f"l{i}", 1, "T") for i in range(20)], [(i, "s", "en", 1, "T") for i in range(64)], [(i, "s", "en", 1, "T") for i in range(513)]]):
        assert rows_of(spark, docs, tmp_path / str(k)) == expected(docs)


def test_proofs_are_read_by_anyone(spark):
    docs = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    out = merkle.merkle_manifest(docs, ["doc_id", "text"], "lang", "doc_id").collect()
    for r in out[::50]:
        node = r.leaf
        for step in r.proof.split("|"):
            before, after = step.split(",")
            node = brute.sha(before + node + after)
        assert node == r.root and r.leaf == brute.leaf(r.doc_id, f"t{r.doc_id}") and r.claim == r.leaf


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 600))
def test_traversal(n):
    leaves = [brute.sha(str(i)) for i in range(n)]
    levels = brute.tree(leaves)
    depth = merkle.levels_of(n)
    assert depth == len(levels) - 1 and merkle.block_root([x.encode() for x in leaves], depth).decode() == levels[-1][0]
    for i, path in enumerate(merkle.traverse([x.encode() for x in leaves], depth)):
        siblings, root = brute.climb(levels, i, leaves[i])
        assert b"".join(b + a for b, a in path).decode() == "".join(siblings)
        assert merkle.folded(leaves[i].encode(), path).decode() == root == levels[-1][0]
