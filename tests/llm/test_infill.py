"""Fill-in-middle: a plain version, exact round trips, and the odd rows."""

import brute
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestone.llm import infill
from pyspark.sql import functions as F

DOCS = [(1, "plain words here"), (2, None), (3, ""), (4, "has <P> in it"), (5, "<S>"), (6, "<M"), (7, "é😀e\u0301 漢字"), (None, "no id"), (None, None), (8, "x" * 2_000_000 + "😀"), (1, "plain words here"), (9, "\n\n"), (10, "<<P<S<M>")] + [(i, f"<P text {i} S> <") for i in range(100, 400)]


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "'r' as form", "2 as h0", "3 as output")


def test_rows(spark):
    out = infill.fill_in_middle(frame(spark, DOCS)).select("*", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
    got = sorted(((r.doc_id, r.again, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((d, t or "", *brute.infilled(d, t)) for d, t in DOCS), key=repr)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame(spark, DOCS).limit(0)).count() == 0


def test_units_of_words_and_lines(spark):
    text = "one two\tthree\n\nfour 漢 five\nend"
    for unit, pieces in (("word", 13), ("line", 4)):
        rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
        out = infill.fill_in_middle(rows, seed=3, unit=unit, percent=100, spm_percent=50).select("*", infill.restored(F.col("output"), F.col("form")).alias("again")).collect()
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        cuts = set(infill.boundaries(codes, unit).tolist())
        assert {r.n for r in out} == {pieces} and {r.again for r in out} == {text}
        assert {r.prefix_chars for r in out} | {r.prefix_chars + r.middle_chars for r in out} <= cuts


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<PSM>ab 😀\n"), max_size=30), st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from(list(infill.UNITS)))
def test_marks_part_an_output_in_one_way(text, draws, unit):
    import re

    n, form, a, b, output = infill.transform(text, draws, unit, 90, 20)
    if form != "plain":
        first, second, third = re.split("<P>|<S>|<M>", output)[1:]
        assert (first + third + second if form == "psm" else second + third + first) == text
        assert len(first if form == "psm" else second) == a and len(third) == b
