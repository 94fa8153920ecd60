"""Kept references: the same answers as from the texts, from the buckets that are asked for only."""

import random
import re

import pytest
from lodestone.operators import graph as G
from lodestone.operators import links as L
from lodestone.operators import tags as T
from lodestone.sources.refstore import RefStore
from test_vault import rows, vault


def pages():
    r = random.Random(9)
    titles = ["My Page", "my  page", "Other", "Straße", "İx", "tag", "A B"] + [f"Page {i}" for i in range(40)]
    said = ["#tag", "#my_page", "[[My Page]]", "[[my  page]]", "[[Other|x]]", "[[STRASSE]]", "#a", "#b", "[[Page 3]]", "#page_3", "[[İx]]", "[[ A B ]]"]
    return [(t, " ".join(r.choices(said, k=r.randrange(6))), r.choice([[], ["tag"], ["A", "b"]])) for t in titles]


def test_same_answers(spark, tmp_path):
    plain = vault(spark, pages())
    kept = plain.with_(home=str(tmp_path))
    assert rows(kept.refs.select(plain.refs.columns)) == rows(plain.refs)
    assert rows(G.graph_edges(kept)) == rows(G.graph_edges(plain))
    plain = plain.with_(known_refs=plain.refs)
    for i, fs in ((1, (L.backlinks, L.outgoing_links, G.subgraph_edges, L.hashtag_connections)), (4, (L.backlinks, G.subgraph_edges)), (6, (L.hashtag_connections, L.outgoing_links)), (99, (G.subgraph_edges,))):
        for f in fs:
            assert rows(f(kept, i)) == rows(f(plain, i)), (i, f)
    for tag in ("TAG", "My_Page", "no tag"):
        assert rows(T.body_hashtag_entries(kept, tag)) == rows(T.body_hashtag_entries(plain, tag))
    # Another reader of the same home finds it built.
    again = RefStore(spark, f"{tmp_path}/refs")
    assert again.state == kept.store.state and again.manifest.versions() == [1]


@pytest.fixture(autouse=True)
def plans_say_buckets(spark):
    """Plans name the selected buckets only if scans by bucket are not left out where nothing else needs them."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def selected(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [tuple(map(int, m)) for m in re.findall(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)]


def test_buckets_are_pruned(spark, tmp_path):
    kept = vault(spark, pages()).with_(home=str(tmp_path))
    assert kept.store.state["buckets"] == 8
    assert selected(L.refs_to(kept, 1)) == [(1, 8)]
    assert selected(L.refs_from(kept, 1)) == [(1, 8)]
    assert selected(T.body_hashtag_entries(kept, "tag")) == [(1, 8)]


def test_a_new_session_opens_what_is_there(spark, tmp_path):
    kept = vault(spark, pages()).with_(home=str(tmp_path))
    n = kept.refs.count()
    for layout in ("by_source", "by_key", "titles"):
        spark.sql(f"drop table {kept.store._name(kept.store.state[layout])}")
    again = kept.with_(home=str(tmp_path))
    assert again.refs.count() == n and selected(L.refs_from(again, 2)) == [(1, 8)]
