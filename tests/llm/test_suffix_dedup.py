import random

import brute
import pytest
from lodestone.llm import suffix_dedup as S
from lodestone.llm.suffixes import LoserTree, front_code, front_decode


def test_merge():
    r = random.Random(9)
    for n in (1, 2, 3, 7, 8):
        runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randrange(12))) for _ in range(r.randrange(30))) for _ in range(n)]
        coded = [front_code(x) for x in runs]
        assert [[s for _, s in front_decode(*c)] for c in coded] == runs
        out = list(LoserTree([front_decode(*c) for c in coded]))
        assert [s for _, _, s in out] == sorted(x for run in runs for x in run)
        for (_, _, a), (n_common, _, b) in zip(out, out[1:], strict=False):
            assert a[:n_common] == b[:n_common] and (a[n_common : n_common + 1] != b[n_common : n_common + 1] or n_common == min(len(a), len(b)))


def documents(seed):
    r = random.Random(seed)
    prose = lambda n: "".join(r.choice("abcdefgh é日") for _ in range(n))
    shared = [prose(n) for n in (99, 100, 101, 130, 180, 400)]
    docs = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 400), (4, "ab" * 300), (5, "ab" * 300), (6, "é" * 50), (7, "é" * 51)]
    for i in range(8, 90):
        docs.append((i, prose(r.randrange(80)) + "".join(r.choice(shared)[r.choice([0, 0, 3]) :] + prose(r.randrange(90)) for _ in range(r.randrange(3)))))
    docs += [(90, docs[40][1]), (91, docs[40][1] + "!"), (-5, docs[50][1])]
    return docs


@pytest.mark.parametrize(("hot", "part"), [(50_000, 1 << 19), (1, 1 << 19), (3, 150)])
def test_against_brute_force(spark, monkeypatch, hot, part):
    docs = documents(hot + part)
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "PART", part)
    rows = docs + [docs[30], docs[30]]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as kind", "'x' as home").repartition(3)
    from pyspark.sql import functions as F

    got = S.dedup_suffixes(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    expected = {x[0]: x for x in brute.repeats(docs)}
    assert len(got) == len(rows)
    assert [x for x in got if tuple(x) != expected[x.doc_id]] == []
    assert any(x.n_spans > 1 for x in got)


def test_empty(spark):
    assert S.dedup_suffixes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
