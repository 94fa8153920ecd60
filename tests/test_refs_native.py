"""The grammar in built-in functions against the line walker, on texts of every shape."""

import random

from lodestone.operators import refs as R
from lodestone.operators import refs_native as N
from pyspark.sql import functions as F

PARTS = ["#tag", "#Año", "#no.", "[[Page]]", "[[ Some Page |shown]]", "[[a`b`c]]", "[[]]", "[[x|]]", "`code #no`", "`", "``", "```", "```py", "# ", "## Head", "####### x", "#  ", "#", " ", "  ", "\t", "\xa0", " ", "\x1f", "\n", "\n", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", "word", "x" * 70, "é😀", "#a#b", "x#c", "#d-e'f^g~", "~~~", "---\n", "\n---\n", "#İ", "#ß", "[[STRASSE ß]]", "\\", '"', "$1", "linked: x"]
HEADS = ["", "", "", "---\ntitle: \"A title\"\n---\n", "---\ntitle: x\nlinked: [\"A B\", \"C\"]\n---\n", "---\nlinked: [\"\"]\ntags: y z\n---\n", "---\nlinked: [a, b]\n---\n", "---\nlinked:\n- One\n- Two\n---\n", "---\nbad: [\n---\n", "---\nlinked: \"abc\"\n---\n", "---\n---\n", "---\nlinked: [\"A\"]\nlinked: [\"B\"]\n---\n", "---\nday: 2024-99-99\nlinked: [\"A\"]\n---\n", "--- \n", "---\r\ntitle: x\r\n---\r\n", "---\ntitle: \"a\\q\"\nlinked: [\"A\"]\n---\n"]


def texts(n, seed):
    r = random.Random(seed)
    out = [r.choice(HEADS) + "".join(r.choice(PARTS) for _ in range(r.randrange(14))) for _ in range(n)]
    line = lambda: "".join(r.choice(PARTS[:34]) for _ in range(r.randrange(6)))
    out += [r.choice(HEADS) + "\n".join(line() for _ in range(r.randrange(12))) for _ in range(n)]
    return [*out, None, "", "#", "[[", "a﷐#b #c", "#x﷑ [[y]]", "#t " * 6000, "# H\n" + "y" * 200_000 + " #end", "```\n#in", "#a\n```\n#in\n```"]


def test_same_references(spark):
    rows = list(enumerate(texts(1500, 1)))
    frame = spark.createDataFrame(rows, "entry_id long, markdown string")
    got = {}
    for r in R.parse_refs(frame).collect():
        got.setdefault(r.source_id, []).append((r.ordinal, r.target_text, r.is_hashtag, r.heading, r.pre, r.highlight, r.post))
    for i, text in rows:
        expected = [(k, *ref) for k, ref in enumerate(R.parse(text))] if text else []
        assert sorted(got.get(i, [])) == expected, repr(text)


def test_same_rewriting(spark):
    rows = list(enumerate(texts(700, 2)))
    frame = spark.createDataFrame(rows, "entry_id long, markdown string")
    for key, name in (("tag", "$1 \\new"), ("año", "x"), ("d-e'f^g~", "y"), ("a", "z")):
        out = frame.select("entry_id", R.rename_hashtag(F.col("markdown"), F.lit(key), F.lit(name)).alias("r"), R.neutralize_hashtag(F.col("markdown"), F.lit(key)).alias("n")).select("entry_id", "r.*", F.col("n.markdown").alias("quiet"), F.col("n.changed").alias("m"))
        for r in out.collect():
            text = rows[r.entry_id][1]
            expected = (None, 0) if text is None else R.rewrite(text, key, lambda s: f"#{name}")  # noqa: B023
            assert (r.markdown, r.changed or 0) == expected, repr(text)
            if text is not None:
                assert (r.quiet, r.m) == R.rewrite(text, key, lambda s: f"`{s}`"), repr(text)


def test_most_texts_stay_in_the_jvm(spark):
    rows = [(i, t) for i, t in enumerate(texts(300, 3)) if t]
    frame = spark.createDataFrame(rows, "entry_id long, markdown string")
    kept = {r.entry_id for r in frame.where(N.is_plain(F.col("markdown"))).collect()}
    for i, t in rows:
        plain_head = not any(t.startswith(h) for h in HEADS[6:] if h.startswith("---\n") and h != "---\n---\n")
        assert (i in kept) or not plain_head or "﷐" in t or "﷑" in t or len(t) > 5000 or t.startswith("---\n"), repr(t)
    assert len(kept) > len(rows) / 2
