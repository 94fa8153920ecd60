"""The change log, its stream with state, and counts kept up by differences."""

import random

import pytest
from lodestone.operators import counts, entries
from lodestone.operators import tags as T
from lodestone.operators.refs import parse
from lodestone.streaming import reconcile as R
from pyspark.sql import functions as F
from test_vault import vault

LOG = R.CHANGE
TEXTS = ["#a [[b]]", "#b #a", "", "nothing", "#a\n#a", "[[b]] [[b]] #c", "---\nlinked: [x]\n---\n#d"]


def logged(spark, log, *changes):
    """changes: (file, text or None if it is gone, seq)."""
    rows = [(f"p{f}.md", text, float(seq), text is None, seq) for f, text, seq in changes]
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)


def run(spark, path, told=None):
    files = spark.range(20).select("id", F.concat(F.lit("p"), "id", F.lit(".md")).alias("file_path"))
    q = R.follow(R.changed_files(spark, f"{path}/log", 1), files, f"{path}/out", f"{path}/check", None if told is None else lambda *x: told.append(x))
    q.awaitTermination(300)
    assert q.exception() is None


def expected(texts):
    return sorted(((f, i, r[0], r[1]) for f, text in texts.items() if text for i, r in enumerate(parse(text))))


def found(spark, path):
    return sorted((r.source_id, r.ordinal, r.target_text, r.is_hashtag) for r in R.current_refs(spark, f"{path}/out").collect())


def tag_counts(texts):
    out = {}
    for text in texts.values():
        for t in {r[0] for r in parse(text or "") if r[1]}:
            out[t] = out.get(t, 0) + 1
    return out


def check(spark, path, texts):
    assert found(spark, path) == expected(texts)
    assert {r.key: r.n for r in R.current_tag_counts(spark, f"{path}/out").collect()} == tag_counts(texts)


def test_duplicates_late_changes_restarts_and_compaction(spark, tmp_path):
    told, log = [], f"{tmp_path}/log"
    texts = {0: "#a [[b]]", 1: "#a #c", 2: "#b"}
    logged(spark, log, *[(f, t, 0) for f, t in texts.items()])
    run(spark, tmp_path, told)
    check(spark, tmp_path, texts)
    # The same version again, an older one after a newer one, and a file that is gone.
    logged(spark, log, (0, "[[b]] #new", 2), (1, "#a #c", 0))
    logged(spark, log, (0, "#late", 1), (2, None, 3))
    run(spark, tmp_path, told)
    texts = {0: "[[b]] #new", 1: "#a #c", 2: None}
    check(spark, tmp_path, texts)
    assert sum(n for _, n in told) == 5
    last = R.compact(spark, f"{tmp_path}/out")
    assert last == max(n for n, _ in told) and R.compact(spark, f"{tmp_path}/out") == last
    R.expire(spark, f"{tmp_path}/out")
    check(spark, tmp_path, texts)
    logged(spark, log, (2, "#back #a", 4), (0, None, 5))
    run(spark, tmp_path)
    check(spark, tmp_path, {0: None, 1: "#a #c", 2: "#back #a"})


def test_a_batch_that_runs_again_counts_once(spark, tmp_path, monkeypatch):
    """The writer fails after its folder is there: the restarted query writes the batch anew."""
    logged(spark, f"{tmp_path}/log", (0, "#a", 0), (1, "#b", 0))

    def fail(*_):
        raise RuntimeError("lost")

    files = spark.range(20).select("id", F.concat(F.lit("p"), "id", F.lit(".md")).alias("file_path"))
    q = R.follow(R.changed_files(spark, f"{tmp_path}/log", 1), files, f"{tmp_path}/out", f"{tmp_path}/check", fail)
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination(300)
    run(spark, tmp_path)
    check(spark, tmp_path, {0: "#a", 1: "#b"})


def test_scan_sees_files_that_are_gone(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    log = f"{tmp_path}/log"
    (pages / "1.md").write_text("#a")
    (pages / "2.md").write_text("#b")
    assert R.scan(spark, str(pages), log) == 2 and R.scan(spark, str(pages), log) == 0
    (pages / "1.md").unlink()
    assert R.scan(spark, str(pages), log) == 1 and R.scan(spark, str(pages), log) == 0
    (pages / "1.md").write_text("#again")
    assert R.scan(spark, str(pages), log) == 1
    assert sorted(r.seq for r in spark.read.parquet(log).collect()) == [0, 0, 1, 2] or sorted(r.seq for r in spark.read.parquet(log).collect()) == [0, 0, 2, 3]


def test_counts_equal_a_recount_after_any_changes(spark):
    r = random.Random(2)
    names, flags = ["Py", "go", "C", "straße"], ["bookmark", "gem", "archive"]
    page = lambda i: (f"T{i}", " ".join(r.choices(["#py", "#go", "#x", "word"], k=r.randrange(4))), r.sample(names, r.randrange(3)))
    pages = [page(i) for i in range(12)]
    dressed = lambda v, seed: v.with_(entries=v.entries.withColumn("status", F.when((F.col("id") + seed) % 3 == 0, "read").otherwise("unread")).withColumn("flags", F.filter(F.array(*[F.when((F.hash("id", F.lit(f)) + seed) % 2 == 0, F.lit(f)) for f in flags]), lambda x: x.isNotNull())))
    old = dressed(vault(spark, pages, names), 0)
    kept = {"sections": entries.sections(old.entries).groupBy(F.col("section").alias("key")).agg(F.count(F.lit(1)).alias("n")), "tags": T.members(old).groupBy("key").agg(F.count(F.lit(1)).alias("n"))}
    for step in range(1, 4):
        touched = set(r.sample(range(12), 5))
        pages = [page(i) if i in touched else p for i, p in enumerate(pages)]
        new = dressed(vault(spark, pages, names), step)
        kept["sections"] = counts.applied(kept["sections"], counts.section_differences(old.entries, new.entries))
        # Given tags first, against the hashtags of before; then hashtags, against the given tags of now.
        given = counts.member_differences(T.structural(old), T.structural(new), T.hashtags(old))
        written = counts.member_differences(T.hashtags(old), T.hashtags(new), T.structural(new))
        kept["tags"] = counts.applied(kept["tags"], given, written)
        assert {x.key: x.n for x in kept["sections"].collect()} == {x.section: x["count"] for x in entries.sections(new.entries).groupBy("section").count().collect()}
        assert {x.key: x.n for x in kept["tags"].collect()} == {x.key: x["count"] for x in T.members(new).groupBy("key").count().collect()}
        old = new
        kept = {k: spark.createDataFrame(v.collect(), "key string, n long") for k, v in kept.items()}
