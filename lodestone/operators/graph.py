"""The graph of entries and tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.links import near, refs_from, refs_to, resolved, tag_peers
from lodestone.operators.tags import structural
from lodestone.sources.refstore import slot_of
from lodestone.sources.shared import scope, written
from lodestone.sources.vault import Vault


def entry_node(entry_id: Column) -> Column:
    return F.concat(F.lit("entry:"), entry_id)


def tag_node(key: Column) -> Column:
    return F.concat(F.lit("tag:"), key)


def edges_of(refs: DataFrame, titles: DataFrame) -> DataFrame:
    """(source, target, n): what references stand for. Equal references are counted before they are resolved, so a hashtag of a third of all texts meets the titles once for each of its texts."""
    counted = refs.groupBy("source_id", "target_text", "is_hashtag").agg(F.count(F.lit(1)).alias("n"))
    found = resolved(counted, titles)
    to_entry = F.when(F.col("target_id") != F.col("source_id"), entry_node(F.col("target_id")))
    targets = F.array_compact(F.array(F.when(F.col("is_hashtag"), tag_node(F.col("target_text"))), to_entry))
    return found.select(entry_node(F.col("source_id")).alias("source"), F.explode(targets).alias("target"), "n")


def tag_edges(given: DataFrame) -> DataFrame:
    return given.select(entry_node(F.col("entry_id")).alias("source"), tag_node(F.col("key")).alias("target"), F.lit(1).cast("long").alias("n"))


def weighted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source", "target").agg(F.sum("n").alias("weight"))


def graph_edges(vault: Vault) -> DataFrame:
    return weighted(edges_of(vault.refs, vault.titles).unionByName(tag_edges(structural(vault))))


def nodes_of(node_ids: DataFrame, vault: Vault) -> DataFrame:
    """node_id -> label, kind and type."""
    entries = vault.entries.select(entry_node(F.col("id")).alias("node_id"), F.col("title").alias("label"), F.lit("entry").alias("kind"), "source_type")
    names = vault.tags.select(tag_node(F.col("normalized")).alias("node_id"), "name")
    mine = node_ids.where(F.col("node_id").startswith("entry:")).join(entries, "node_id")
    tags = node_ids.where(F.col("node_id").startswith("tag:")).join(names, "node_id", "left").select("node_id", F.concat(F.lit("#"), F.coalesce("name", F.substring("node_id", 5, 2**31 - 1))).alias("label"), F.lit("tag").alias("kind"), F.lit(None).cast("string").alias("source_type"))
    return mine.unionByName(tags)


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()


def graph_nodes(vault: Vault, edges: DataFrame | None = None) -> DataFrame:
    """Nodes with an edge; others are not in the graph."""
    return nodes_of(endpoints(graph_edges(vault) if edges is None else edges), vault)


def subgraph_edges(vault: Vault, focus: int) -> DataFrame:
    """Edges around an entry: its own references and tags; references to its title; and the others that share its tags, one for each tag."""
    me = F.lit(f"entry:{focus}")
    mine = refs_from(vault, focus)
    own = edges_of(mine, near(vault.titles, mine.select(slot_of(F.col("target_text"), F.col("is_hashtag")).alias("slot"))))
    given = structural(vault).where(F.col("entry_id") == focus)
    entries = vault.entries.select(F.col("id").alias("entry_id"))
    come = refs_to(vault, focus)
    inbound = come.select(entry_node(F.col("source_id")).alias("source"), me.alias("target"), F.lit(1).cast("long").alias("n"))
    # A hashtag that is the title of the focus keeps its own node.
    by_tag = come.where("is_hashtag").select(entry_node(F.col("source_id")).alias("source"), tag_node(F.col("target_text")).alias("target"), F.lit(1).cast("long").alias("n"))
    keys = given.select("key").unionByName(mine.where("is_hashtag").select(F.col("target_text").alias("key"))).distinct()
    shared = tag_edges(tag_peers(vault, focus, keys).join(entries, "entry_id", "left_semi"))
    return weighted(own.unionByName(tag_edges(given)).unionByName(inbound).unionByName(by_tag).unionByName(shared))


def subgraph_nodes(vault: Vault, focus: int) -> DataFrame:
    """The focus, if it exists, and all that an edge of its subgraph touches."""
    me = vault.entries.where(F.col("id") == focus).select(entry_node(F.col("id")).alias("node_id"))
    return nodes_of(endpoints(subgraph_edges(vault, focus)).unionByName(me).distinct(), vault)


def simple_edges(edges: DataFrame) -> DataFrame:
    """Undirected, once each, without loops."""
    return edges.where("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def node_degree(edges: DataFrame) -> DataFrame:
    return simple_edges(edges).select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def node_size(degree: Column) -> Column:
    return F.least(F.lit(26.0), 3 + 5 * F.sqrt(degree))


def node_style(nodes: DataFrame, limit: int = 24) -> DataFrame:
    """node_id, shown label (cut at `limit` characters) and the group that picks its colour."""
    cut = F.when(F.length("label") > limit, F.concat(F.substring("label", 1, limit), F.lit("…"))).otherwise(F.col("label"))
    return nodes.select("node_id", cut.alias("shown"), F.when(F.col("kind") == "tag", F.lit("tag")).otherwise(F.coalesce("source_type", F.lit("article"))).alias("colour"))


def node_search(nodes: DataFrame, typed: str) -> DataFrame:
    return nodes.where(F.contains(F.lower("label"), F.lit(typed.strip().lower()))).select("node_id", "label")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node_id, component): the least node_id that a node is connected with.

    Every round links each node's neighbours to the least of them (those above it, then those below it), so paths shrink by half and more; a round is written to the shared folder, which cuts the lineage.
    """
    def star(now: DataFrame, above: bool) -> DataFrame:
        seen = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if above else now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = seen.join(least, "a")
        to_least = met.where("b > a" if above else "true").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return (to_least if above else to_least.unionByName(least.select("a", F.col("m").alias("b")))).where("a <> b").distinct()

    state, spark = None, edges.sparkSession
    with scope(spark) as tables:
        now = written(simple_edges(edges).select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        while (told := tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != state:
            state, now = told, written(star(star(now, True), False), "edges")
            tables.drop(spark, keep=[now])
    return now.select(F.explode(F.array("a", "b")).alias("node_id"), F.col("b").alias("component")).distinct()


def changed_components(components: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The components (node_id, component) of a graph after edges (source, target) were added and removed, from those before and all edges now.

    Only components that have an end of a changed edge are solved again, from the edges within them; a removed edge may part one, an added one join two. Others are taken over. Nodes without an edge are in none.
    """
    ends = endpoints(added.select("source", "target").unionByName(removed.select("source", "target")))
    touched = written(components.join(ends, "node_id", "left_semi").select("component").distinct(), "touched")
    nodes = components.join(touched, "component", "left_semi").select("node_id").unionByName(ends).distinct()
    mine = edges.join(nodes.select(F.col("node_id").alias("source")), "source", "left_semi")
    return components.join(touched, "component", "left_anti").select("node_id", "component").unionByName(connected_components(mine))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component")


def thread_chain(posts: DataFrame, tail_id: str, max_hops: int = 100) -> DataFrame:
    """posts (id, parent_id): the posts from the root to `tail_id` (position, id, complete), in one recursive query. It is complete if the root has no parent and was reached within max_hops."""
    spark = posts.sparkSession
    chain = spark.sql(
        """with recursive chain(id, parent_id, hop) as (
             select id, parent_id, 1 from {posts} where id = :tail
             union all select p.id, p.parent_id, c.hop + 1 from chain c join {posts} p on p.id = c.parent_id where c.hop < :hops)
           select id, parent_id, hop from chain""",
        args={"tail": tail_id, "hops": max_hops},
        posts=posts.select("id", "parent_id"),
    )
    everything = Window.partitionBy()  # max_hops rows at most
    return chain.select((F.max("hop").over(everything) - F.col("hop")).alias("position"), "id", F.max(F.col("parent_id").isNull()).over(everything).alias("complete")).orderBy("position")


def thread_chains(posts: DataFrame, max_hops: int = 100) -> DataFrame:
    """(tail_id, depth, complete) of every post: how many posts its chain has, root and itself included, by doubling pointers instead of walking.

    A chain of more than max_hops posts counts max_hops and is not complete; nor is one whose next parent is missing.
    """
    now = posts.select("id", F.col("parent_id").alias("next"), F.lit(1).alias("depth"), F.lit(False).alias("lost"))
    for _ in range(max(1, (max_hops - 1).bit_length())):
        far = now.select(F.col("id").alias("at"), F.col("next").alias("then"), F.col("depth").alias("more"), F.col("lost").alias("gone"))
        now = now.join(far, F.col("next") == F.col("at"), "left").select("id", F.when(F.col("at").isNotNull(), F.col("then")).alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), (F.col("lost") | F.coalesce("gone", F.lit(False)) | (F.col("next").isNotNull() & F.col("at").isNull())).alias("lost"))
    return now.select(F.col("id").alias("tail_id"), F.least(F.col("depth"), F.lit(max_hops)).alias("depth"), (~F.col("lost") & F.col("next").isNull() & (F.col("depth") <= max_hops)).alias("complete"))
