import random

import brute
import pytest
from lodestone.llm import decontaminate, quality
from lodestone.llm.quality import CUTOFFS, upper_bound

WORDS = ["a", "B", "été", "x1", "don't", "中文", "--", "#", "Q"]


def texts(seed, n):
    r = random.Random(seed)
    out = [None, "", " ", "\n\n", "a", "A a A a", "x " * 3000]
    for _ in range(n):
        out.append("".join(r.choice(WORDS) + r.choice([" ", " ", "\n", "\t", ", "]) for _ in range(r.randrange(60))))
    return out


def test_counts(spark):
    rows = list(enumerate(texts(1, 80)))
    got = quality.with_stats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {d: brute.stats(t) for d, t in rows}


def test_quality_rules(spark):
    r = random.Random(2)
    good = [(i, " ".join(r.choice("abcdefghij") * 3 for _ in range(40 + i % 50)), "en") for i in range(1200)]
    junk = [(5000 + i, " ".join(r.choice("abcdefghij") * 3 + "###" for _ in range(60)), "en") for i in range(50)]
    docs = spark.createDataFrame([*good, *junk, (9000, None, None), (9001, "", "xx")], "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "2 as stratum")
    labels = spark.createDataFrame([(d, 1) for d, _, _ in good] + [(d, 0) for d, _, _ in junk] + [(None, 1), (99999, 1), (9000, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.quality_rules(docs, labels).collect()}
    assert all(got[d].kept for d, _, _ in good)
    assert not any(got[d].kept for d, _, _ in junk)
    assert not got[9000].kept and got[9000].base_failed and got[9001].base_failed
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    assert all(x.kept == (not x.base_failed) for x in quality.quality_rules(docs, labels.limit(0)).collect())


def test_exact_bound():
    assert upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert upper_bound(5, 5, 0.05) == 1.0 and upper_bound(0, 0, 0.05) == 1.0
    assert all(list(c) == sorted(c, reverse=True) for c in CUTOFFS.values())
    from math import comb

    for k, n, p in ((0, 7, 0.3), (3, 40, 0.02), (39, 40, 0.9), (20, 900, 0.03)):
        assert quality.tail(k, n, p) == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)
    assert quality.tail(19_000_000, 10**9, 0.02) < 1e-9 < 0.99 < quality.tail(21_000_000, 10**9, 0.02)


def test_leaks(spark):
    r = random.Random(3)
    item = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    items = [(i, item(r.choice([1, 2, 3, 9, 10, 11, 40]))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (53, "a b a b a b a b a b a b"), (54, "a b a b a b a b a b a b")]
    docs = [(i, t) for i, t in enumerate(texts(4, 20))]
    for i in range(100, 160):
        _, t = r.choice(items)
        w = brute.alnum(t)
        cut = w[: r.randrange(len(w) + 1)] if r.random() < 0.5 else w
        docs.append((i, item(r.randrange(30)) + " " + ", ".join(cut).upper() + " " + item(r.randrange(5))))
    from lodestone.llm.queries import F

    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.select("doc_id", "n_words", "n_hit", F.size("item_ids"), F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256), "contaminated").collect()
    assert sorted(map(tuple, rows)) == sorted(brute.decontaminated(docs, items))
    none = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string"))
    assert not any(x.contaminated for x in none.collect())


def test_leaks_of_odd_rows(spark):
    """Null ids, texts that share an id, repeated rows, names that clash, one very long text, and empty tables."""
    leak = "one two three four five six seven eight nine ten eleven"
    docs = [(None, "nothing here at all"), (None, leak), (1, "zz yy"), (1, f"x {leak}"), (1, f"x {leak}"), (2, None), (3, ""), (4, "pad, " * 200_000 + leak.upper())]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as hash", "2 as n_words", "3 as item_id", "4 as text_hash")
    items = [(7, leak), (8, leak), (9, leak), (None, "zz")]
    got = decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as k", "2 as words"))
    told = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got.collect()), key=str)
    assert told == sorted([(None, 4, 0, []), (None, 11, 11, [7, 8, 9]), (1, 2, 1, []), (1, 12, 11, [7, 8, 9]), (1, 12, 11, [7, 8, 9]), (2, 0, 0, []), (3, 0, 0, []), (4, 200_011, 11, [7, 8, 9])], key=str)
    assert decontaminate.decontaminate(frame.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_cutoffs_hold_their_risk(spark):
    """Over many drawn holdouts the share of good texts rejected in truth stays within the risk."""
    import numpy as np

    r = np.random.default_rng(19)
    over = 0
    for _ in range(3):
        n = 4000
        rows = [("s", 100, int(500 + 40 * a), int(b), 0, int(c)) for a, b, c in zip(r.normal(size=n), r.exponential(1.5, n), r.exponential(3, n), strict=True)]
        frame = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").selectExpr("*", "true as good")
        chosen = quality.select_cutoffs(frame).first().cutoffs
        x = r.exponential(1.5, 200_000), r.exponential(3, 200_000)
        rejected = (x[0].astype(int) / 100 > chosen.get("symbols_per_word", np.inf)) | (x[1].astype(int) / 100 > chosen.get("repeat_share", np.inf))
        over += rejected.mean() > quality.RISK
        assert chosen
    assert over == 0


def test_cutoffs_of_small_strata(spark):
    """The whole risk is for all cutoffs together, so 300 good rows are enough for a rule that rejects none of them, and 100 are not."""
    row = lambda s, n, symbols, dup=0: [(s, 100, 500, symbols, dup, 0)] * n
    # In "c", symbols above 0.2 and doubled lines above 0.05 reject 1.5% of the good texts each: within the risk alone, but not together.
    good = [*row("a", 300, 0), *row("b", 100, 0), *row("c", 3940, 0), *row("c", 60, 25), *row("c", 60, 0, 6)]
    frame = spark.createDataFrame(good, "stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long").selectExpr("*", "true as good")
    cutoffs = quality.select_cutoffs(frame)
    chosen = {r.stratum: r.cutoffs for r in cutoffs.collect()}
    assert chosen["a"] == {name: cutoffs[-1] for name, cutoffs in CUTOFFS.items()}
    assert chosen["b"] == {}
    assert chosen["c"] == {"symbols_per_word": 0.05, "chars_per_word": 8.0, "dup_lines_per_word": 0.07}
    junk = spark.createDataFrame([*row("a", 1, 60), *row("b", 1, 60)], frame.drop("good").schema)
    assert {r.stratum: r.passed for r in quality.with_passed(junk, cutoffs).collect()} == {"a": False, "b": True}


def test_copies_are_one_draw(spark):
    """A good text that comes 400 times is one draw, so it proves nothing about others; 400 different ones do."""
    words = " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"w{i} {'#$%&' * 3}{i}" for i in range(60))
    same = [(i, words, "en") for i in range(400)] + [(1, words, "en")] * 400
    other = [(i, f"{words} x{i}", "en") for i in range(400)]
    labels = spark.createDataFrame([(i, 1) for i in range(400)] + [(1000, 0)], "doc_id long, quality int")
    for rows, kept in ((same, True), (other, False)):
        frame = spark.createDataFrame([*rows, (1000, bad, "en")], "doc_id long, text string, lang string")
        got = {r.kept for r in quality.quality_rules(frame, labels).where("doc_id = 1000 and not base_failed").collect()}
        assert got == {kept}, (len(rows), got)


def test_verdicts_on_the_real_tables(spark):
    """At sf0.1 every language gets cutoffs, and they reject badly labelled texts that the base rule lets pass."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    few = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = quality.quality_rules(few, labels).join(docs.select("doc_id", "lang"), "doc_id").join(labels, "doc_id").where("not base_failed")
    told = {(r.lang, r.quality): (r.n, r.gone) for r in got.groupBy("lang", "quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("gone")).collect()}
    for lang in {k[0] for k in told}:
        n, gone = told[lang, 1]
        bad, caught = told[lang, 0]
        assert gone <= 2 * quality.RISK * n and caught >= 0.9 * bad > 0


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b " * 30, "en"), (1, "a b " * 30, "en"), (1, "other", None), (None, "x y", "en"), (None, None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as passed", "2 as kept", "3 as cutoffs", "4 as good")
    got = quality.quality_rules(frame, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) and sorted(r.n_words for r in got) == [0, 1, 2, 60, 60] and not any(r.kept for r in got)
