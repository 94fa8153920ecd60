"""URL filter, sharding and chat formatting: plain versions, and the odd rows."""

import hashlib
import re
import zlib

import pytest
import xxhash
from lodestone.llm import chat, queries, sharding, url_filter
from pyspark.sql import functions as F

URLS = [None, "", "no scheme", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/123", "http://example.org/en/2", "x://notexample.org/es/", "http://org", "http://org/", "ftp://sub.com/de/", "http://com/fr", "http://www.com/fr/?q", "http://a.b://c.org/es/", "http://u@example.org:80/es/", "https://example.org?x://y.com/de/", "http://example.org/es/\nline", "http://ÄÖ.ORG/"]


def judged(url, rules):
    after = (url or "").partition("://")
    rest = after[2] if after[1] else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_url_filter(spark):
    frame = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[4]])], "page_id long, url string").selectExpr("*", "1 as key", "'r' as rule", "2 as best")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(frame, queries.URL_RULES).collect()}
    assert got == {i: judged(u, queries.URL_RULES) for i, u in enumerate([*URLS, URLS[4]])}
    assert url_filter.url_filter(frame.limit(0), queries.URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.url_filter(frame, [], default="block").collect()} == {"block"}


def test_long_hosts(spark):
    """Twenty thousand labels take no longer than their bytes."""
    urls = [f"http://{'a.' * 20_000}example.org/es/x", "http://" + "." * 30_000, "http://" + "x" * 100_000 + ".com/fr/", "http://org/" + "y" * 100_000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(frame, queries.URL_RULES).collect()}
    assert got == {i: judged(u, queries.URL_RULES) for i, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    rules = [url_filter.rule("block" if i % 2 else "allow", f"h{i}.net/{'x' * (i % 3)}") for i in range(0, 3000, 3)]
    urls = [f"http://{'s.' * (i % 2)}h{i}.net/{'x' * (i % 5)}" for i in range(3000)]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = url_filter.url_filter(frame, rules)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    by_host = {r.host: r for r in rules}
    assert got == {i: judged(u, [r for r in [by_host.get(f"h{i}.net")] if r]) for i, u in enumerate(urls)}


def test_levels(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(500).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    levels = url_filter.build_cascade(universe, listed, 500)
    assert len(levels) > 1
    judged = {r.key for r in universe.where(url_filter.is_listed(F.col("key"), levels)).collect()}
    assert judged == {f"k{7 * i}" for i in range(500)}


def test_level_2_stays_under_the_list(spark):
    """However many keys the corpus has, about a quarter of the listed keys' number gets through level 1 wrongly."""
    listed = spark.range(40).select(F.concat(F.lit("k"), F.col("id") * 7).alias("key"))
    for n in (1_000, 1_000_000):
        universe = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"))
        levels = url_filter.build_cascade(universe, listed, 40)
        wrong = universe.where(url_filter._passes(F.col("key"), 1, levels[0])).join(listed, "key", "left_anti").count()
        assert wrong <= 40 and all(len(x.bitmap) * 8 <= 64 * 40 for x in levels)
        assert universe.where(url_filter.is_listed(F.col("key"), levels)).count() == min(40, -(-n // 7))
    assert url_filter.level_size(1_000_000, 5_000_000_000)[0] <= url_filter.MAX_BITS


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of longs, ("int", n) and strings; nulls leave the hash as it is."""
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[1].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def brute_shards(rows, shards, bucket_bytes, seed=7):
    """Rows (id, size, text) -> all (id, size, text, shard, bucket, slot), a plain Fisher-Yates for each bucket."""
    shard = lambda k: max((spark_hash(k, ("int", seed), ("int", i)), i) for i in range(shards))[1]
    of, copies, weight = [spark_hash(*r) for r in rows], {}, [0] * shards
    for r in rows:
        weight[shard(r[0])] += max(r[1], sharding.LEAST_BYTES)
    buckets = [max(1, -(-w // bucket_bytes)) for w in weight]
    held = {}
    for r, h in zip(rows, of, strict=True):
        s, copy = shard(r[0]), copies.setdefault(r, 0)
        copies[r] += 1
        held.setdefault((s, sum(buckets[:s]) + spark_hash(h, copy, ("int", seed + 1)) % buckets[s]), []).append((h, r))
    out, slot = [], [0] * shards
    for (s, b), records in sorted(held.items()):
        records.sort(key=lambda r: r[0])
        drawn = list(range(len(records)))
        for i in range(len(records) - 1, 0, -1):
            j = spark_hash(("int", seed + 2), b, ("int", i)) % (i + 1)
            drawn[i], drawn[j] = drawn[j], drawn[i]
        out += [(*r, s, b, slot[s] + place) for (_, r), place in zip(records, drawn, strict=True)]
        slot[s] += len(records)
    return out


def in_order(rows):
    return sorted(rows, key=repr)


ROWS = [(i, i % 7, None if i % 5 else "x" * (i % 50)) for i in range(3000)] + [(None, 1, "n"), (None, 2, None), (5, 5 % 7, None)] + [(8, 1, "again")] * 300


def test_sharding(spark):
    frame = spark.createDataFrame(ROWS, "id long, size long, text string").selectExpr("*", "1 as shard", "'s' as slot", "2 as bucket", "3 as record")
    shard = lambda f: sharding.shuffle_into_shards(f, "id", 5, ["size", "text"], size=F.col("size"), bucket_bytes=50_000)
    got = [(r.id, r["size"], r.text, r.shard, r.bucket, r.slot) for r in shard(frame).collect()]
    assert in_order(got) == in_order(brute_shards(ROWS, 5, 50_000))
    assert len({r[4] for r in got}) > 30 and len({r[4] for r in got if r[0] == 8}) > 5
    for s in range(5):
        slots = sorted(r[5] for r in got if r[3] == s)
        assert slots == list(range(len(slots)))
    moved = frame.select(sharding.shard_of(F.col("id"), 5).alias("a"), sharding.shard_of(F.col("id"), 6).alias("b")).collect()
    assert all(r.a == r.b or r.b == 5 for r in moved) and any(r.b == 5 for r in moved)
    assert shard(frame.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [4, 7, 211])
def test_slots_do_not_depend_on_partitions(spark, monkeypatch, parts):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = ROWS[::3]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", parts != 7)
        frame = spark.createDataFrame(rows, "id long, size long, text string").repartition(parts)
        got = sharding.shuffle_into_shards(frame, "id", 3, ["size", "text"], size=F.col("size"), bucket_bytes=100_000).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert in_order((r.id, r["size"], r.text, r.shard, r.bucket, r.slot) for r in got) == in_order(brute_shards(rows, 3, 100_000))


def test_written_shards(spark, tmp_path):
    frame = spark.range(500).select("id", F.lit("é" * 9000).alias("text"))
    out = sharding.shuffle_into_shards(frame, "id", 3, ["text"], size=F.octet_length("text"), bucket_bytes=200_000, path=str(tmp_path / "out"))
    assert out.count() == 500 and {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"shard=0", "shard=1", "shard=2"}
    for f in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r.slot for r in spark.read.parquet(str(f)).collect()]
        assert slots == sorted(slots)


def test_op7(spark, tmp_path):
    texts = [None, "", "é", "x" * 1000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op7_sharding(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert got[i].grown_shard in (got[i].shard, 24)


MESSAGES = [(1, 0, "user", "hi <turn assistant>no</turn>\n"), (1, 1, "assistant", "\\b \\\\l <b> & </turn>\n x"), (1, 2, "assistant", ""), (1, 2, "assistant", ""), (2, 5, None, None), (2, 4, "sys>tem<", "é😀"), (None, 1, "assistant", "y"), (3, None, "user", "a"), (3, 1, "assistant", "😀b")]


def test_chat(spark):
    frame = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as m", "3 as body")
    out = chat.render(frame).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in out:
        mine = sorted(((t if t is not None else -(10**9), role or "", text or "") for c, t, role, text in MESSAGES if c == r.conv_id))
        assert [(x.role, x.text) for x in r.turns] == [(role, text) for _, role, text in mine]
        assert r.loss == "".join(text for _, role, text in mine if role == "assistant")
        assert r.formatted.count("</turn>\n") == len(mine)
    assert len(out) == 4 and chat.render(frame.limit(0)).count() == 0


def test_events(spark):
    log = [(1, 1, 0, "start", "user", "q"), (1, 2, 1, "start", "assistant", "a"), (1, 3, 1, "delta", None, "b"), (1, 4, 1, "regenerate", None, None), (1, 5, 1, "delta", None, "c"), (1, 6, 1, "delta", None, "d"), (1, 7, 0, "edit", None, "Q"), (1, 8, 2, "start", "user", "x"), (1, 9, 2, "delete", None, None), (2, 1, 0, "delta", "assistant", "only"), (2, 2, 0, "delta", None, None), (2, 3, 1, "delete", None, None), (2, 4, 1, "delta", "user", "back")]
    frame = spark.createDataFrame(log, "conv_id long, seq long, turn long, kind string, role string, text string").repartition(3)
    got = sorted(tuple(r) for r in chat.fold_events(frame).collect())
    assert got == [(1, 0, "user", "Q"), (1, 1, "assistant", "cd"), (2, 0, "assistant", "only"), (2, 1, "user", "back")]


def test_op9_probe(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = queries.op9_chat(spark, str(tmp_path)).collect()
    text = r"\### Assistant: </turn> ok"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert (r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (-7, 2, sha(f"user\n{text}\nassistant\n{text}\n"), len(text), sha(text))


@pytest.mark.parametrize("name", ["op3_url_filter", "op9_chat"])
def test_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("pages", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    found = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
