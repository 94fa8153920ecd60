import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from lodestone.llm import jaccard
from lodestone.llm.components import connected_components
from lodestone.llm.sketch import signed_counts


def test_components(spark):
    r = random.Random(11)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        return x if up[x] == x else find(up[x])

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(x.node, x.component) for x in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents():
    r = random.Random(12)
    prose = lambda n: [f"w{r.randrange(3000)}" for _ in range(n)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "a b"), (4, "A  b"), (5, "a"), (6, "a b c"), (7, "x " * 500), (8, "x " * 900), (9, "X\tx\nx x")]
    common = prose(60)
    for i in range(10, 60):
        docs.append((i, " ".join(prose(r.randrange(5, 120)) + r.choice([common, []]))))
    # Families whose members lie near the limit, linked in chains.
    for f in range(6):
        now = prose(r.randrange(20, 200))
        for j in range(14):
            docs.append((100 + 20 * f + j, " ".join(now)))
            now = list(now)
            for _ in range(r.randrange(0, max(2, len(now) // 45 + 1))):
                now[r.randrange(len(now))] = f"z{r.randrange(10**6)}"
            if r.random() < 0.3:
                now += prose(r.randrange(1 + len(now) // 9))
    return docs


def test_against_brute_force(spark):
    docs = documents()
    rows = docs + [docs[30], docs[30]]
    frame = spark.createDataFrame([*rows, (None, docs[30][1]), (None, None)], "doc_id long, text string").selectExpr("*", "1 as node", "2 as kind", "'x' as a").repartition(3)
    got = jaccard.jaccard_components(frame).collect()
    assert len(got) == len(rows) + 2
    expected = {x[0]: x for x in brute.components(docs)}
    assert [x for x in got if x.doc_id is not None and tuple(x) != expected[x.doc_id]] == []
    assert all(x.component_id is None for x in got if x.doc_id is None)
    assert any(x.component_id < x.doc_id for x in got if x.doc_id is not None)
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_least_meetings():
    """Linked sets meet at least so often within their prefixes."""
    r = random.Random(14)
    for _ in range(3000):
        n = r.randrange(1, 90)
        a = set(r.sample(range(300), n))
        b = (a - set(r.sample(sorted(a), r.randrange(min(n, 9))))) | {300 + r.randrange(90) * (-1) ** r.randrange(2) for _ in range(r.randrange(9))}
        for percent in (80, 85):
            if b and 100 * len(a & b) >= percent * len(a | b):
                first = lambda s: set(sorted(s)[: len(s) - -(-percent * len(s) // 100) + 1])
                assert len(first(a) & first(b)) >= jaccard.least_meetings(np.int64(len(a)), np.int64(len(b)), percent)


def test_sketches():
    r = np.random.default_rng(15)
    sets = [r.integers(0, 2**63, 40).astype(np.uint64)]
    for i in range(60):
        sets.append(np.concatenate((sets[0][i // 2 :], r.integers(0, 2**63, i // 3).astype(np.uint64))))
    row, key = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
    found = [np.frombuffer(x, np.uint64) for x in jaccard.parity_sketches(row, key, len(sets))]
    for s, f in zip(sets, found, strict=True):
        apart = len(set(s.tolist()) ^ set(sets[0].tolist()))
        assert int(np.bitwise_count(f ^ found[0]).sum()) <= apart
        assert apart < 5 or int(np.bitwise_count(f ^ found[0]).sum()) > apart // 2


def test_wide_sketches_tell_long_sets_apart():
    """Never more bits than elements, at whatever sizes; and two long sets that share two thirds cannot link, which SKETCH bits did not tell."""
    r = np.random.default_rng(17)
    base = r.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [base, base[:2100], np.concatenate((base[:2000], r.integers(0, 2**63, 1000).astype(np.uint64))), base[:40], base[:0], np.concatenate((base, r.integers(0, 2**63, 2000).astype(np.uint64)))]
    n = np.array([len(s) for s in sets])
    row, key = np.repeat(np.arange(len(sets)), n), np.concatenate(sets)
    wide, short = jaccard.wide_sketches(row, key, n), jaccard.parity_sketches(row, key, len(sets))
    for s, v, narrow in zip(sets, wide, short, strict=True):
        assert jaccard.folded(np.frombuffer(v, np.uint8), jaccard.SKETCH // 8).tobytes() == narrow
        for t, w in zip(sets, wide, strict=True):
            assert jaccard.bits_apart(v, w) <= len(set(s.tolist()) ^ set(t.tolist()))
    most = 6000 - 2 * -(-85 * 6000 // 185)
    assert jaccard.bits_apart(wide[0], wide[2]) > most > jaccard.bits_apart(short[0], short[2])


def long_texts():
    """Texts of 2,000 words, all with the same 400 at their beginning: each two share a fifth and cannot link, but two copies with one word changed."""
    r = random.Random(19)
    prose = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    common = prose(400)
    docs = [(i, common + prose(1600)) for i in range(60)]
    docs += [(100 + i, docs[i][1][:-1] + ["changed"]) for i in range(2)]
    return [(i, " ".join(words)) for i, words in docs]


def test_long_texts_that_cannot_link_make_no_pairs(spark, monkeypatch):
    """With the short sketch alone, all pairs of a group of long texts went on from each shingle that they share."""
    made, written = [], jaccard.written
    frame = type(spark.range(0))
    real = frame.mapInArrow

    def counted(self, f, *a, **b):
        out = real(self, f, *a, **b)
        if f.__name__ == "pairs":
            out = written(out, "made")
            made.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    # One level: what all have is no rarer or more common than the rest, so it stands in the prefixes.
    monkeypatch.setattr(jaccard, "levels", lambda counts: np.zeros(2 * len(counts), np.uint8))
    docs = long_texts()
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {i: i % 100 for i, _ in docs}
    assert len(made) == 2 and sum(made) < 60


def test_sketches_of_several_sizes():
    """As bits_apart has it, for sketches of any size, and only pairs within the limit."""
    r = np.random.default_rng(21)
    base = r.integers(0, 2**63, 5000).astype(np.uint64)
    sets = [np.concatenate((base[: r.integers(0, 5000)], r.integers(0, 2**63, r.integers(0, 900)).astype(np.uint64))) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    row, key = np.repeat(np.arange(30), n), np.concatenate(sets)
    short, wide = jaccard.parity_sketches(row, key, 30), jaccard.wide_sketches(row, key, n)
    mixed = [s if i % 3 == 0 else w for i, (s, w) in enumerate(zip(short, wide, strict=True))]
    x, y = (c.ravel() for c in np.meshgrid(np.arange(30), np.arange(30)))
    bits = np.array([jaccard.bits_apart(mixed[i], mixed[j]) for i, j in zip(x, y, strict=True)])
    for most in (np.full(900, 10**6), np.full(900, 240), r.integers(0, 2000, 900)):
        keep, apart = jaccard.Sketches(mixed).within(x, y, most)
        assert keep.tolist() == np.flatnonzero(bits <= most).tolist() and apart.tolist() == bits[keep].tolist()
    assert [len(v) for v in jaccard.Sketches([]).within(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))] == [0, 0]


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """No plan has two Python steps without an exchange between them: executors keep a worker for each."""
    seen, written = [], jaccard.written

    def planned(df, name):
        above = []
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            depth, node = len(line) - len(line.lstrip(" :+-*()0123456789")), line.lstrip(" :+-*()0123456789")
            above = [x for x in above if x[0] < depth]
            if node.startswith("MapInArrow"):
                seen.append(name)
                steps = [x for _, x in above]
                last = max((i for i, x in enumerate(steps) if "Exchange" in x), default=-1)
                assert not any(x.startswith("MapInArrow") for x in steps[last + 1 :]), f"{name}: {node}"
            above.append((depth, node))
        return written(df, name)

    monkeypatch.setattr(jaccard, "written", planned)
    jaccard.jaccard_components(spark.createDataFrame(documents(), "doc_id long, text string")).collect()
    assert {"met", "near", "links"} <= set(seen)


def test_common_shingles_stand_last_in_a_full_table(spark):
    """100 hashes fall into each cell. What comes 500 times stands after nearly all that comes once, but where two such share a cell."""
    once, common = np.random.default_rng(18).integers(0, 2**63, (2, 100 << 12)).astype(np.uint64)
    common = common[:50]
    parts = lambda column: (np.concatenate((once[int(x) :: 20], np.repeat(common, 25))) for x in column.to_pylist())
    level = jaccard.levels(signed_counts(spark.createDataFrame([(str(i),) for i in range(20)], "text string").repartition(3), parts, 1 << 12))
    of = lambda h: level[(h % np.uint64(len(level))).astype(np.int64)]
    assert np.quantile(of(common), 0.1) > np.quantile(of(once), 0.98) and np.median(of(once)) < 8


def test_pairs_of_small_and_large_groups():
    """Each pair across components comes once, however a group is dealt to cells."""
    r = np.random.default_rng(16)
    size = r.integers(2, 30, 40)
    end = np.cumsum(size)
    n = int(size.sum())
    part, node = r.integers(0, 3, n), r.permutation(n)
    main = np.concatenate([np.full(s, np.bincount(part[e - s : e]).argmax()) for s, e in zip(size, end, strict=True)])
    x, y = (np.concatenate(c) for c in zip(*jaccard.small_pairs(end - size, end), strict=True))
    all_pairs = sorted((min(i, j), max(i, j)) for i, j in zip(x.tolist(), y.tolist(), strict=True) if part[i] != part[j])
    found = list(jaccard.large_pairs(end - size, end, part, node, part != main, np.ones(n, bool), 0))
    assert sorted((min(i, j), max(i, j)) for x, y in found for i, j in zip(x.tolist(), y.tolist(), strict=True)) == all_pairs
    kept = jaccard.some_of_each(x, y, r.integers(0, 50, len(x)), r.integers(0, 2**62, len(part)))
    assert 0 < kept.sum() < len(x) and set(np.concatenate([x[kept], y[kept]])) == set(np.concatenate([x, y]))


def test_cells_come_whole_or_with_their_home_rows(monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 50)
    r = np.random.default_rng(20)
    rows = sorted((int(t), int(b), not h, int(i)) for t, b, h, i in zip(r.choice([1, 2, 2, 2, 2, 2, 3], 600), r.integers(0, 2, 600), r.random(600) < 0.1, range(600), strict=True))
    frame = pa.table({"token": [x[0] for x in rows], "block": [x[1] for x in rows], "node": [x[3] for x in rows], "home": [not x[2] for x in rows]})
    met = []
    for got, old in jaccard.cells(iter(frame.to_batches(max_chunksize=17))):
        told = [(x["token"], x["block"], x["node"], x["home"], i >= old) for i, x in enumerate(got.to_pylist())]
        assert len(told) < 150
        met += [(t, b, h, v) for t, b, h, is_home, _ in told if is_home for t2, b2, v, _, new in told if new and (t2, b2) == (t, b)]
    assert sorted(met) == sorted((t, b, h, v) for t, b, away, h in rows if not away for t2, b2, _, v in rows if (t2, b2) == (t, b))


@pytest.mark.parametrize("small", [1, 48])
def test_blocks_and_salts(spark, monkeypatch, small):
    """Blocks of few members, salts of two, and the same components."""
    for name, value in (("LARGE", 3), ("FAMILY", 2), ("SMALL", small)):
        monkeypatch.setattr(jaccard, name, value)
    docs = documents()
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute.components(docs))
