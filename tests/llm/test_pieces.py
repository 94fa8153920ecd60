import random

import pytest
from lodestone.llm import pieces as P

TEXTS = ["", " ", "a", "   ", "hello world", "hello  world \n\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "日本語のテキスト" * 30, "the▁end ▁ of", "\u0000x﻿ \U0001f600\U0001f600 z", "=" * 300, "- " * 200, " " * 333, "thething" * 60]


def random_text(r):
    alphabet = r.choice(["ab", "the inoresta", "01 .,-=", "abcdefghijklmnopqrstuvwxyz      ", "éèüß日本 a", "th"])
    return "".join(r.choice(alphabet) for _ in range(r.randrange(64, 500)))


@pytest.fixture(scope="module")
def model():
    return P.pieces(P.model_bytes(P.MODEL))


def test_scan_equals_library(model):
    r = random.Random(5)
    for text in [*TEXTS, *(random_text(r) for _ in range(150))]:
        assert P.encode_in_chunks(model, text, 64) == model.lib.encode(text), text
        assert P.encode_in_chunks(model, text, 1 << 16) == model.lib.encode(text), text


def test_products():
    r = random.Random(6)
    m = [[r.getrandbits(5) for _ in range(5)] for _ in range(9)]
    out, total = [], m[0]
    for x in [None, *m[1:]]:
        total = P.combine(total, x) if x else total
        out.append(total)
    assert P.prefix_products(m) == out


def test_encode_and_decode(spark, model):
    r = random.Random(7)
    rows = [(i, t) for i, t in enumerate([None, *TEXTS, *(random_text(r) for _ in range(30))])] + [(None, "x y " * 40), (3, "a"), (77, "ab " * 99), (77, "ab " * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as chunk")
    got = P.decode(P.encode(docs, chunk=64)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((x.doc_id, x.ids) for x in got), key=key) == sorted(((d, model.lib.encode(t or "")) for d, t in rows), key=key)
    assert any(x.n_chunks > 1 for x in got)
    plain = {d: t or "" for d, t in rows if d != 9}
    assert all(x.decoded == plain[x.doc_id] for x in got if x.doc_id in plain and "▁" not in plain[x.doc_id])
    both = P.encode(docs, chunk=64, decoded=True).collect()
    assert sorted((repr((x.doc_id, x.ids, x.n_chunks, x.decoded)) for x in both)) == sorted((repr((x.doc_id, x.ids, x.n_chunks, x.decoded)) for x in got))
    assert P.encode(docs.limit(0)).count() == 0


def test_giant_texts(spark, model):
    """Texts of several chunks of the default size: without any space, with few, and with many; one of them twice, and one of the same id."""
    r = random.Random(9)
    solid = "".join(r.choice("abcdefghijklmnoprstuvwxyz") for _ in range(3 * P.CHUNK + 77))
    few = " ".join(solid[i : i + 5000] for i in range(0, len(solid), 5000))
    many = " ".join(r.choice(TEXTS[4:]) for _ in range(2000))
    rows = [(1, solid), (2, few), (2, few), (2, many), (None, "é" * (P.CHUNK + 1)), (3, "short")]
    got = P.encode(spark.createDataFrame(rows, "doc_id long, text string"), decoded=True).collect()
    assert sorted((str(x.doc_id), x.ids) for x in got) == sorted((str(d), model.lib.encode(t)) for d, t in rows)
    assert sorted(x.n_chunks for x in got) == sorted(-(-(len(t) + 1) // P.CHUNK) for _, t in rows)
    assert {x.decoded for x in got} >= {solid, few, "short"}


def test_words_equal_library(model, monkeypatch):
    import numpy as np

    monkeypatch.setattr(P.Words, "LIMIT", 40)
    r = random.Random(8)
    texts = [t for t in [*TEXTS, *(random_text(r) for _ in range(80)), "a" * 3000, " a", "a ", "  a  b  "] if P.MARK not in t]
    words = P.Words(model)
    for low in range(0, len(texts), 7):
        part = [t.encode() for t in texts[low : low + 7]]
        ids, n = words.encode(np.frombuffer(b"".join(part), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in part]))))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == model.lib.encode(texts[low : low + 7])
