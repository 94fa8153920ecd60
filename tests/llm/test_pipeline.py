import os
import random
from collections import Counter

import brute
import corpus_pipeline
from lodestone.llm import pieces
from lodestone.sources import shared


def model_of():
    return pieces.pieces(pieces.model_bytes(pieces.MODEL))


def write(spark, path, docs, labels, *items):
    rows = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    rows.selectExpr("*", "1 as score", "2 as h", "3 as n_removed", "4 as fold").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [(1, 1, 0), (2, 1, 1)], "an item")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_each_text_of_an_id_is_judged_by_itself(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda a, n=60: " ".join(words[a : a + n])
    docs = [(1, text(0), "en", "s", 1), (5, text(0), "en", "s", 1), (5, text(100), "en", "s", 1), (7, text(200), "en", "s", 1), (None, text(200), "en", "s", 1), (None, text(300), "en", "s", 1), (5, text(100), "en", "s", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group(spark, frame, "").collect()), key=repr)
    assert got == sorted([(1, text(0)), (5, text(100)), (7, text(200)), (None, text(300))], key=repr)


def test_a_remainder_of_white_space_goes(spark):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    docs = [(1, passage, "en", "s", 1), (2, f"{passage}", "en", "s", 1), (3, " \n", "en", "s", 1), (4, None, "en", "s", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeats(spark, frame, "").collect()}
    assert set(out) >= {1, 3, 4} and (2 not in out or out[2].strip())


def test_a_failed_run_leaves_no_tables(spark, tmp_path, monkeypatch):
    write(spark, tmp_path, [(1, "a b c d e f", "en", "s")], [(1, 1, 0), (2, 1, 1)], "an item")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, f: d), ("two", lambda s, d, f: d.select("no_such_column"))])
    before = set(os.listdir(shared.shared_dir(spark)))
    try:
        corpus_pipeline.run(spark, str(tmp_path))
        raise AssertionError
    except Exception as e:
        assert "no_such_column" in str(e)
    assert set(os.listdir(shared.shared_dir(spark))) == before


def test_stages(spark, tmp_path):
    r = random.Random(13)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = prose(80)
        docs.append((i, " ".join(w + (" vileword" if bad and j % 9 == 0 else "") for j, w in enumerate(text.split())), "en", "s"))
        labels.append((i, 1, int(bad)))
    passage, item, other = prose(60), prose(30), prose(14)
    docs += [(1000, docs[1][1], "en", "s"), (1001, docs[1][1] + " end", "en", "s"), (1002, prose(40) + " " + passage + " " + prose(40), "en", "s"), (1003, prose(40) + " " + passage + " " + prose(40), "en", "s")]
    docs += [(1004, prose(50) + " " + item + " " + prose(20), "en", "s"), (1005, None, None, None), (1006, "", "en", None)]
    # Repeated rows, of which one stays; null ids; two texts of one id, of which one holds an item.
    docs += [docs[2], docs[2], (None, "no id here", "en", "s"), (None, "no id here", "de", "s"), (None, None, None, None), (1007, f"and {other}", "en", "s"), (1007, "quite another text that is clean", "en", "s")]
    write(spark, tmp_path, docs, labels, item, other)
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in rows if x.doc_id in (2, None, 1007)) == {2: 1, None: 2, 1007: 1}
    assert model_of().lib.decode(next(x.ids for x in rows if x.doc_id == 1007)).startswith("quite")
    got = {x.doc_id: x for x in rows if x.doc_id is not None}
    toxic = {d for d, _, t in labels if t}
    assert not toxic & set(got)
    assert set(got) >= {d[0] for d in docs if d[0] not in toxic | {None, 1000, 1001, 1004}}
    assert not {1000, 1001, 1004} & set(got)
    model = model_of()
    texts = {d[0]: d[1] or "" for d in docs}
    assert all(x.ids == model.lib.encode(texts[d]) and x.decoded_sha256 == brute.sha(texts[d]) for d, x in got.items() if d not in (1003, 1007))
    rest = model.lib.decode(got[1003].ids)
    assert rest.startswith(texts[1003][:100]) and len(rest) < len(texts[1003]) - 200
