import random
import sqlite3

import pytest
from lodestone.functions import identity, urls
from lodestone.operators import graph as G
from lodestone.operators import links as L
from lodestone.operators import mutations as M
from lodestone.operators import search as S
from lodestone.operators import tags as T
from lodestone.schemas import ENTRIES, ENTRY_TAGS, TAGS
from lodestone.sources.vault import Vault, read_markdown_files, write_pages
from pyspark.sql import functions as F

NOW = "2024-01-20 12:00:00"


def vault(spark, pages, tags=()):
    """pages: (title, markdown, [tags]) with ids from 1."""
    names = list(dict.fromkeys(t for _, _, given in pages for t in given)) + list(tags)
    entries = [(i + 1, t, f"u{i}", f"pages/{i + 1}.md", "article", None, None, "unread", list(given), [], None, None) for i, (t, _, given) in enumerate(pages)]
    return Vault(
        spark.createDataFrame(entries, ENTRIES),
        spark.createDataFrame([(i, n, n.casefold()) for i, n in enumerate(names)], TAGS),
        spark.createDataFrame([(i + 1, names.index(t)) for i, (_, _, given) in enumerate(pages) for t in given], ENTRY_TAGS),
        spark.createDataFrame([(i + 1, m) for i, (_, m, _) in enumerate(pages)], "entry_id long, markdown string"),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tags_unite_both_ways(spark):
    v = vault(spark, [("A", "#py", ["Py"]), ("B", "#PY x", []), ("C", "", ["Py", "C++"])])
    assert rows(T.tag_counts(v)) == [("C++", "c++", 1), ("Py", "py", 3)]
    assert rows(T.entries_by_tag(v, "pY")) == [(1,), (2,), (3,)]
    assert rows(T.body_hashtag_entries(v, "C++")) == []


def test_links(spark):
    v = vault(spark, [("My Page", "[[other]] #my_page [[nowhere]]", []), ("Other", "[[MY PAGE]] #my_page", []), ("other", "", [])])
    assert [(r.source_id, r.is_hashtag) for r in L.backlinks(v, 1).collect()] == [(2, False), (2, True)]
    assert [r.target_id for r in L.outgoing_links(v, 1).collect()] == [3]  # of equal titles the latest
    edges = rows(G.graph_edges(v))
    assert edges == [("entry:1", "entry:3", 1), ("entry:1", "tag:my_page", 1), ("entry:2", "entry:1", 2), ("entry:2", "tag:my_page", 1)]
    assert rows(G.subgraph_edges(v, 1)) == [("entry:1", "entry:3", 1), ("entry:1", "tag:my_page", 1), ("entry:2", "entry:1", 2), ("entry:2", "tag:my_page", 2)]
    assert rows(G.subgraph_nodes(v, 99)) == []


def test_linked_entries_fold_ascii_only(spark):
    v = vault(spark, [("X", '---\nlinked: ["Élan", "abc", "élan", "ABC"]\n---\n', []), ("Élan", "", []), ("ABC", "", []), ("abc", "", [])])
    assert [(r.ordinal, r.id) for r in L.linked_entries(v, 1).collect()] == [(0, 2), (1, 3), (3, 3)]


def test_rename(spark):
    v = vault(spark, [("A", "#py and #Go", ["Py"]), ("B", "#PY", ["Go", "py"]), ("C", "", ["C++"])])
    v = v.with_(tags=v.tags.where("name <> 'py'"), entry_tags=v.entry_tags.withColumn("tag_id", F.when(F.col("tag_id") == 2, 0).otherwise(F.col("tag_id"))))
    assert M.rename_tag(v, "none", "x") is None
    with pytest.raises(M.Conflict):
        M.rename_tag(v, "py", "go")
    with pytest.raises(M.InvalidTag):
        M.rename_tag(v, "py", "c+ +")
    with pytest.raises(M.InvalidTag):
        M.rename_tag(v, "go", "C++", merge=True)
    plain = M.rename_tag(v, "py", "Rust")
    assert rows(T.tag_counts(plain)) == [("C++", "c++", 1), ("Go", "go", 2), ("Rust", "rust", 2)]
    assert rows(plain.markdown) == [(1, "#Rust and #Go"), (2, "#Rust"), (3, "")]
    merged = M.rename_tag(v, "py", "GO", merge=True)
    assert rows(T.tag_counts(merged)) == [("C++", "c++", 1), ("Go", "go", 2)]
    assert {r.id: r.tags for r in merged.entries.collect()} == {1: ["Go"], 2: ["Go"], 3: ["C++"]}
    recased = M.rename_tag(v, "C++", "c++")
    assert ("c++", "c++", 1) in rows(T.tag_counts(recased))


def test_delete_and_update(spark):
    v = vault(spark, [("A", "#py", ["Py"]), ("B", "#go", ["Go"])])
    gone = M.delete_tag(v, "PY")
    assert rows(T.tag_counts(gone)) == [("Go", "go", 1)] and rows(gone.markdown)[0] == (1, "`#py`")
    with pytest.raises(M.InvalidTag):
        M.update_tags(v, 1, ["ok", "not ok"])
    new = M.update_tags(v, 1, ["PY", "Fresh"])
    assert rows(T.tag_counts(new)) == [("Fresh", "fresh", 1), ("Go", "go", 1), ("Py", "py", 1)]
    assert new.entries.where("id = 1").first().tags == ["PY", "Fresh"]
    assert M.create_tag(v, "pY")[1:] == ("Py", 1)
    assert rows(T.tag_counts(M.create_tag(v, "new")[0]))[2] == ("new", "new", 0)
    rest = M.hard_delete(v, 1)
    assert rows(T.tag_counts(rest)) == [("Go", "go", 1), ("Py", "py", 0)]


def test_names_fold_fully(spark):
    """Identities of names that lower() does not fold, in lists with and without them."""
    v = vault(spark, [("A", "#x", ["Straße", "İx", "ΣΊΣΥΦΟΣ"]), ("B", "", ["STRASSE"]), ("C", "", ["other"])])
    v = v.with_(tags=v.tags.where("name <> 'STRASSE'"), entry_tags=v.entry_tags.withColumn("tag_id", F.when(F.col("tag_id") == 3, 0).otherwise(F.col("tag_id"))))
    gone = M.delete_tag(v, "strasse", NOW)
    tags = {r.id: (r.tags, str(r.updated_at)) for r in gone.entries.collect()}
    assert tags[1] == (["İx", "ΣΊΣΥΦΟΣ"], NOW) and tags[2] == ([], NOW) and tags[3][0] == ["other"] and tags[3][1] != NOW
    moved = M.rename_tag(v, "straSSe", "road", now=NOW)
    assert {r.id: r.tags for r in moved.entries.collect()} == {1: ["road", "İx", "ΣΊΣΥΦΟΣ"], 2: ["road"], 3: ["other"]}
    assert M.rename_tag(v, "σίσυφος", "rock", now=NOW).entries.where("id = 1").first().tags == ["Straße", "İx", "rock"]
    merged = M.rename_tag(v, "other", "STRASSE", merge=True, now=NOW)
    assert {r.id: len(r.tags) for r in merged.entries.collect()} == {1: 3, 2: 1, 3: 1}
    stamped = M.update_flags(v, 2, ["gem"], NOW).entries
    assert [str(r.updated_at) == NOW for r in stamped.orderBy("id").collect()] == [False, True, False]
    typed = M.update_tags(v, 3, ["STRASSE", "straße"], NOW)
    assert str(typed.entries.where("id = 3").first().updated_at) == NOW and typed.entry_tags.where("entry_id = 3").count() == 1


def test_entries_change(spark):
    v = vault(spark, [("A", "---\ntitle: A\n---\n", []), ("B", "---\ntitle: B\n---\n", [])])
    read = M.update_status(v, 1, "read", NOW)
    assert str(read.entries.where("id = 1").first().read_at) == NOW
    back = M.update_status(read, 1, "unread", "2025-01-01 00:00:00").entries.where("id = 1").first()
    assert back.status == "unread" and str(back.read_at) == NOW
    with pytest.raises(M.Conflict):
        M.add_entry(v, {"title": "C", "url": "u0"}, "")
    assert M.add_entry(v, {"title": "C", "url": "u0?"}, "#x").entries.count() == 3
    linked = M.set_link(v, 1, 2)
    assert rows(L.linked_entries(linked, 1)) == [(0, 2, "B")] and rows(L.linked_entries(linked, 2)) == [(0, 1, "A")]
    assert rows(L.linked_entries(M.set_link(linked, 2, 1, on=False), 1)) == []
    with pytest.raises(M.Missing):
        M.set_link(v, 1, 9)


def test_search_like_fts5(spark):
    r = random.Random(1)
    vocabulary = ["cafe", "Café", "foo_bar", "foo", "bar", "barn", "straße", "x1", "the", "then", "a-b"]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(4))), " ".join(r.choices(vocabulary, k=r.randrange(1, 30)))) for i in range(60)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(title, content, tokenize='unicode61')")
    db.executemany("insert into t(rowid, title, content) values (?, ?, ?)", docs)
    frame = spark.createDataFrame(docs, "id long, title string, content string")
    index = S.postings(frame).cache()
    for q in ("cafe", "the", "foo bar", "foo_bar", "ba th", "stra", "x", "zzz"):
        expected = {k: s for k, s in db.execute("select rowid, bm25(t) from t where t match ?", (" ".join(f'"{t}"*' for t in S.query_terms(q)),))}
        got = {x.id: x.score for x in S.search(index, q).collect()}
        assert got.keys() == expected.keys(), q
        assert all(abs(got[k] - expected[k]) < 1e-9 for k in got), q
    assert S.search(index, " ?! ").count() == 0


def test_components_under_change(spark):
    r, edges = random.Random(8), set()
    frame = lambda e: spark.createDataFrame(sorted(e), "source string, target string")
    edges = {(f"n{r.randrange(40):02}", f"n{r.randrange(40):02}") for _ in range(25)}
    now = G.connected_components(frame(edges))
    for _ in range(3):
        gone = set(r.sample(sorted(edges), 6))
        new = {(f"n{r.randrange(44):02}", f"n{r.randrange(44):02}") for _ in range(5)} - edges
        edges = (edges - gone) | new
        now = G.changed_components(now, frame(edges), frame(new), frame(gone))
        assert rows(now) == rows(G.connected_components(frame(edges)))


def test_threads(spark):
    posts = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "gone"), ("y", "x")], "id string, parent_id string")
    assert [tuple(r) for r in G.thread_chain(posts, "c").collect()] == [(0, "a", True), (1, "b", True), (2, "c", True)]
    assert [tuple(r) for r in G.thread_chain(posts, "y").collect()] == [(0, "x", False), (1, "y", False)]
    assert [tuple(r) for r in G.thread_chain(posts, "c", max_hops=2).collect()] == [(0, "b", False), (1, "c", False)]
    assert rows(G.thread_chains(posts)) == [("a", 1, True), ("b", 2, True), ("c", 3, True), ("x", 1, False), ("y", 2, False)]


def test_identity(spark):
    def one(text, f):
        return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]

    assert one(" Große  Straße ", identity.title_key) == "grosse_strasse"
    assert one("Ça va? C'est l'été -- 100%!", identity.slug) == "ca-va-cest-lete-100"
    assert one("日本", identity.slug) == ""
    assert one(None, identity.casefold) is None


def test_urls(spark):
    good = ["http://example.com", "https://8.8.8.8/x", "http://[2606:4700::1111]/", "http://a.local/"]
    bad = ["ftp://example.com", "http://localhost/", "http://127.0.0.1", "http://10.1.1.1", "http://[::1]/", "http://[::ffff:10.0.0.1]/", "http://[64:ff9b::7f00:1]/", "http://224.0.0.1", "http://100.64.0.1", "", "x", "http://"]
    frame = spark.createDataFrame([(u,) for u in good + bad], "u string")
    assert [r[0] for r in frame.select(urls.fetchable_url(F.col("u"))).collect()] == [True] * len(good) + [False] * len(bad)
    links = {"vault://open?id=5": 5, "vault://open?id=%205": 5, "vault://open?id=1_000": 1000, "vault://open?x=1&id=+7": 7, "vault://open?id=7&id=8": 7, "vault://open?id=0": None, "vault://open?id=-1": None, "vault://shut?id=1": None, "vault://open": None, "http://open?id=1": None}
    got = spark.createDataFrame([(u,) for u in links], "u string").select(urls.parse_deep_link(F.col("u"))).collect()
    assert [r[0] for r in got] == list(links.values())
    assert urls.unwrap_proxied("https://a.b/_next/image?url=https%3A%2F%2Fc.d%2Fe.png&w=1") == "https://c.d/e.png"


def test_files(spark, tmp_path):
    pages = spark.createDataFrame([("pages/a.md", "#x\r\n"), ("pages/b/c.md", "é")], "file_path string, markdown string")
    assert write_pages(pages, str(tmp_path)) == 2
    got = read_markdown_files(spark, str(tmp_path))
    assert sorted(r.markdown for r in got.collect()) == ["#x\r\n", "é"]


def test_upgrade(spark):
    from lodestone.sources.versions import upgrade

    v = vault(spark, [("A", "", ["Python"]), ("B", "", ["Python", "python"]), ("C", "", ["python", "x"]), ("D", "", ["Python"])])
    v = v.with_(entries=v.entries.withColumn("status", F.when(F.col("id") == 1, "favorite").otherwise("read")).withColumn("updated_at", F.lit(NOW).cast("timestamp_ntz")))
    new, done = upgrade(v, spark.createDataFrame([], "name string"))
    assert rows(T.tag_counts(new)) == [("Python", "python", 4), ("x", "x", 1)]
    got = {r.id: r for r in new.entries.collect()}
    assert got[2].tags == ["Python"] and got[3].tags == ["x", "Python"]
    assert (got[1].status, got[1].flags, got[1].read_at) == ("unread", ["bookmark"], None) and str(got[2].read_at) == NOW
    assert upgrade(new, done)[0] is new


def test_patch(spark):
    v = vault(spark, [("A", "#old", ["Py"])])
    new = M.patch_entry(v, 1, NOW, status="read", flags=["gem"], tags=["Go"], markdown="#fresh")
    assert rows(T.members(new)) == [(1, "fresh"), (1, "go")] and new.entries.first().flags == ["gem"]
    with pytest.raises(M.Missing):
        M.patch_entry(v, 2, NOW)


def test_frontmatter_properties(spark):
    from lodestone.operators import pages

    text = "---\r\nauthor: \"Me\"\r\nempty:\r\n---\r\nbody\nauthor: no"
    frame = spark.createDataFrame([(text,), ("author: x",)], "t string")
    got = frame.select(pages.frontmatter_property(F.col("t"), "author"), pages.frontmatter_property(F.col("t"), "empty"), pages.without_frontmatter(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("Me", None, "body\nauthor: no"), (None, None, "author: x")]
    assert spark.createDataFrame([("https://substack.com/inbox/post/12?x",), ("https://a.substack.com/p/x",)], "u string").select(urls.inbox_post(F.col("u"))).collect() == [("12",), (None,)]


def test_link_candidates_of_many_results(spark):
    """An entry that links to its 1,200 best results still gets the 8 that come after them."""
    from lodestone.plans import vault_queries as Q

    n, focus = 1200, int(Q.FOCUS)
    page = lambda i: f"{'the ation ' * (3 if i < n else 1)}{'pad ' * (i // n)}"
    others = [i for i in range(1, n + 40) if i != focus]
    pages = [(f"p{i}", page(i), []) for i in range(1, n + 40)]
    pages[focus - 1] = ("me", " ".join(f"[[p{i}]]" for i in others if i < n), [])
    v = vault(spark, pages)
    assert rows(Q.link_candidates(v)) == [(k + 1, n + k) for k in range(8)]


def test_fold_of_all_latin_letters(spark):
    """The fold in the JVM is the one in Python, for every letter."""
    import unicodedata

    from lodestone.functions.identity import fold_diacritics

    letters = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000]
    frame = spark.createDataFrame([(c, f"x{c}Y") for c in letters] + [("", "Ünïcödé ÀÉ ß 日本 é"), (None, None)], "c string, t string")
    plain = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c))
    got = frame.select("t", fold_diacritics(F.col("t")).alias("f")).collect()
    assert [r.t for r in got if r.f != plain(r.t)] == []
