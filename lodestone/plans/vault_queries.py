"""Queries over a vault, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import identity, urls
from lodestone.operators import articles as A
from lodestone.operators import counts as C
from lodestone.operators import entries as E
from lodestone.operators import graph as G
from lodestone.operators import links as L
from lodestone.operators import mutations as M
from lodestone.operators import pages as P
from lodestone.operators import refs as R
from lodestone.operators import segments
from lodestone.operators import tags as T
from lodestone.operators.order import with_rank
from lodestone.plans.sql import FOLD, TITLE_KEY, vault_sql
from lodestone.sources.committed import CommittedVault
from lodestone.sources.shared import shared_path, written
from lodestone.sources.vault import Vault, from_tables
from lodestone.streaming import reconcile

#: What the parametrised queries ask for. The day is a Saturday.
FOCUS, TAG, NOTE, WORDS, AS_OF = 22, "EN", "fr-note", "the ation", "2024-01-20 12:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a vault under its name."""

    def register(f: Callable[[Vault], DataFrame]) -> Callable[[Vault], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(from_tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = vault_sql(sql)
        return f

    return register


def shown(entries: DataFrame) -> DataFrame:
    return entries.select("id", "title", "url", "source_type", "created_at", "status", F.array_join("tags", ",").alias("tags"))


SHOWN = "select e.id, e.title, e.url, e.source_type, e.created_at, e.status, coalesce(g.tags, '') as tags from v_entries e left join v_typed g on g.entry_id = e.id"


@query(f"{SHOWN} where e.status = 'read' and e.is_bookmark and not e.is_archive")
def list_entries(v: Vault) -> DataFrame:
    return shown(E.list_entries(v.entries, status="read", flag="bookmark", exclude_flag="archive", sort_by="title", sort_dir="asc"))


@query(f"{SHOWN} where e.status = 'unread'")
def list_by_status(v: Vault) -> DataFrame:
    return shown(E.list_entries(v.entries, status="unread"))


@query(f"{SHOWN} where e.is_gem")
def list_by_flag(v: Vault) -> DataFrame:
    return shown(E.list_entries(v.entries, flag="gem"))


@query(f"{SHOWN} where not e.is_archive")
def list_exclude_flag(v: Vault) -> DataFrame:
    return shown(E.list_entries(v.entries, exclude_flag="archive"))


@query(f"{SHOWN} where not e.is_archive and e.id in (select entry_id from v_members where key = 'en')")
def list_by_tag(v: Vault) -> DataFrame:
    return shown(E.list_by_tag(v.entries, T.entries_by_tag(v, TAG), exclude_flag="archive", sort_by="title", sort_dir="asc"))


@query("select row_number() over (order by created_at desc, id) as rank, id from v_entries where status = 'unread'")
def list_order(v: Vault) -> DataFrame:
    return with_rank(E.list_entries(v.entries, status="unread"), E.order_of()).select("rank", "id")


@query("select row_number() over (order by title, id) as rank, id from v_entries")
def list_order_by_title(v: Vault) -> DataFrame:
    return with_rank(E.list_entries(v.entries, sort_by="title", sort_dir="asc"), E.order_of("title", "asc")).select("rank", "id")


@query("select row_number() over (order by lower(title) desc, id) as rank, id from v_entries where id in (select entry_id from v_members where key = 'en')")
def list_by_tag_order(v: Vault) -> DataFrame:
    found = E.list_by_tag(v.entries, T.entries_by_tag(v, TAG), sort_by="title", sort_dir="DESC")
    return with_rank(found, E.tag_order_of("title", "DESC")).select("rank", "id")


@query("select row_number() over (order by entry_id) as rank, entry_id from v_members where key = 'en'")
def tag_member_order(v: Vault) -> DataFrame:
    return with_rank(T.entries_by_tag(v, TAG), [F.col("entry_id")])


@query(f"{SHOWN} where e.id = {FOCUS}")
def get_entry(v: Vault) -> DataFrame:
    return shown(E.get_entry(v.entries, FOCUS))


@query(f"{SHOWN} where e.id in (3, 5, 8)")
def entries_by_ids(v: Vault) -> DataFrame:
    return shown(E.entries_by_ids(v.entries, [8, 3, 5, 3, -1]))


@query("select id, title from v_entries")
def all_titles(v: Vault) -> DataFrame:
    return E.all_titles(v.entries)


@query(f"""select s.*, coalesce(c.content_tags, '') as content_tags from ({SHOWN}) s left join (
 select entry_id, string_agg(distinct coalesce(t.name, h.key), ',' order by coalesce(t.name, h.key)) as content_tags from v_hashtags h left join v_tags t on t.normalized = h.key group by 1) c on c.entry_id = s.id""")
def entry_out(v: Vault) -> DataFrame:
    out = E.entry_out(v.entries, T.content_hashtags(v))
    return out.select("id", "title", "url", "source_type", "created_at", "status", F.array_join("tags", ",").alias("tags"), F.array_join("content_tags", ",").alias("content_tags"))


@query("""select count(*) filter (where not is_archive) as library, count(*) filter (where not is_archive and status = 'unread') as unread, count(*) filter (where not is_archive and status = 'read') as read,
 count(*) filter (where not is_archive and is_bookmark) as bookmark, count(*) filter (where not is_archive and is_gem) as gem, count(*) filter (where is_archive) as archive from v_entries""")
def section_counts(v: Vault) -> DataFrame:
    return E.section_counts(v.entries)


@query("""select id, 'archive' as section from v_entries where is_archive union all select id, 'library' from v_entries where not is_archive union all select id, status from v_entries where not is_archive
 union all select id, 'bookmark' from v_entries where not is_archive and is_bookmark union all select id, 'gem' from v_entries where not is_archive and is_gem""")
def section_membership(v: Vault) -> DataFrame:
    return E.sections(v.entries)


@query("""select count(*) filter (where read_at >= timestamp '2024-01-14') as week, count(*) filter (where read_at >= timestamp '2024-01-01') as month, count(*) filter (where read_at >= timestamp '2024-01-01') as year from v_entries""")
def read_metrics(v: Vault) -> DataFrame:
    return E.read_metrics(v.entries, AS_OF)


@query("""select coalesce(t.name, c.key) as name, coalesce(t.normalized, c.key) as key, coalesce(c.n, 0)::bigint as n from (select key, count(*) as n from v_members group by 1) c full join v_tags t on t.normalized = c.key""")
def tag_counts(v: Vault) -> DataFrame:
    return T.tag_counts(v)


@query("select entry_id from v_members where key = 'en'")
def entries_by_tag(v: Vault) -> DataFrame:
    return T.entries_by_tag(v, TAG)


@query(f"select entry_id from v_hashtags where key = '{NOTE}'")
def body_hashtag_entries(v: Vault) -> DataFrame:
    return T.body_hashtag_entries(v, NOTE)


@query(f"select count(*) as n from v_hashtags where key = '{NOTE}'")
def tag_body_count(v: Vault) -> DataFrame:
    return T.tag_body_count(v, NOTE)


@query("""select entry_id, string_agg(distinct coalesce(t.name, h.key), ',' order by coalesce(t.name, h.key)) as content_tags from v_hashtags h left join v_tags t on t.normalized = h.key group by 1""")
def content_hashtags(v: Vault) -> DataFrame:
    return T.content_hashtags(v).select("entry_id", F.array_join("content_tags", ",").alias("content_tags"))


@query("""with n as (select name, lower(name) as key, count(*) as n, min(entry_id) as first from v_tag_raw group by 1, 2)
select name as spelling, (first_value(name) over (partition by key order by n desc, name)) as name from n""")
def tag_merge(v: Vault) -> DataFrame:
    spark = v.entries.sparkSession
    raw = spark.table("v_tag_raw")
    # Old vaults had a tag for each spelling; ids in the order of spellings.
    ids = raw.select("name").distinct().withColumn("id", F.when(F.lower("name") == F.col("name"), 2 * F.abs(F.hash(F.lower("name"))).cast("long") + 1).otherwise(2 * F.abs(F.hash(F.lower("name"))).cast("long")))
    merged = T.tag_merge(ids, raw.join(ids, "name").select("entry_id", F.col("id").alias("tag_id")))
    return ids.select(F.col("name").alias("spelling"), "id").join(merged, F.col("id") == F.col("tag_id")).select("spelling", "name")


@query("""select row_number() over (order by lower(name), key) as rank, name from (select coalesce(t.name, m.key) as name, coalesce(t.normalized, m.key) as key from (select distinct key from v_members) m full join v_tags t on t.normalized = m.key)
 where contains(lower(name), 'e') and lower(name) not in ('en') order by 1 limit 6""")
def tag_suggestions(v: Vault) -> DataFrame:
    return T.tag_suggestions(v, "E", v.entries.sparkSession.sql("select 'en' as name"))


@query(rf"select id, regexp_full_match(title, '[{identity.HASHTAG_FIRST}][{identity.HASHTAG_REST.replace(chr(39), chr(39) * 2)}]*') as valid from v_entries")
def valid_tag_name(v: Vault) -> DataFrame:
    return v.entries.select("id", identity.is_hashtag_name(F.col("title")).alias("valid"))


@query(f"select id, {TITLE_KEY.format('title')} as key from v_entries")
def title_key(v: Vault) -> DataFrame:
    return v.entries.select("id", identity.title_key(F.col("title")).alias("key"))


@query(r"""with s as (select id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[^\w\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-{2,}', '-', 'g') as s from v_entries)
select id, trim(substr(trim(s, '-'), 1, 60), '-') as slug from s""")
def slug(v: Vault) -> DataFrame:
    return v.entries.select("id", identity.slug(F.col("title")).alias("slug"))


@query("select source_id, target_text, is_hashtag, heading, count(*) as n from v_refs group by all")
def parse_refs(v: Vault) -> DataFrame:
    return v.refs.groupBy("source_id", "target_text", "is_hashtag", "heading").agg(F.count(F.lit(1)).alias("n"))


#: The vault's texts have no code spans but this one. RE2 has no lookbehind, so what a hashtag follows is part of its find.
CONTEXT_SQL = rf"""with l as (select entry_id, n, heading, line, replace(line, '`#code`', '       ') as shown from (select *, last_value(case when line similar to '#{{{{1,6}}}}\s+.+' then trim(regexp_extract(line, '^#{{{{1,6}}}}\s+(.+)', 1)) end ignore nulls) over (partition by entry_id order by n) as heading_,
   case when line similar to '#{{{{1,6}}}}\s+.+' then regexp_extract(line, '^#{{{{1,6}}}}\s+(.+)', 1) else line end as line_ from v_fenced where not is_fence and not inside) t(entry_id, line0, n, is_fence, inside, heading, line)),
p as (select *, false as is_hashtag, '\[\[[^\[\]|]+?(?:\|[^\[\]]*?)?\]\]' as pattern from l where contains(line, '[[') union all select *, true, '(?:^|\s)#[{identity.HASHTAG_FIRST}][{identity.HASHTAG_REST.replace(chr(39), chr(39) * 2)}]*' from l where contains(line, '#')),
m as (select *, regexp_extract_all(shown, pattern) as found, regexp_split_to_array(shown, pattern) as rest from p),
e as (select *, unnest(range(1, len(found) + 1)) as i from m where len(found) > 0),
f as (select *, found[i] as hit, list_sum(list_transform(rest[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) as pos0 from e),
g as (select *, case when is_hashtag and not starts_with(hit, '#') then 1 else 0 end as skip from f),
h as (select *, (pos0 + skip)::bigint as pos, substr(hit, skip + 1) as highlight from g)
select entry_id as source_id, is_hashtag, heading, trim(substr(line, greatest(pos - 60, 0) + 1, least(pos, 60))) as pre, highlight, trim(substr(line, pos + length(highlight) + 1, 60)) as post, count(*) as n from h group by all
union all select entry_id, false, null, '', '[[' || t || ']]', '', 1 from (select entry_id, regexp_extract(markdown, '\nlinked: \["(.*)"\]\n---\n', 1) as t from v_markdown) where t <> ''"""


@query(CONTEXT_SQL.replace("{{", "{").replace("}}", "}"))
def refs_in_context(v: Vault) -> DataFrame:
    return v.refs.groupBy("source_id", "is_hashtag", "heading", "pre", "highlight", "post").agg(F.count(F.lit(1)).alias("n"))


@query(f"""select entry_id, md5(regexp_replace(markdown, '(^|\\s)#({NOTE})(\\s|$)', '\\1`#\\2`\\3', 'g')) as digest, 1 as changed from v_markdown where contains(markdown, ' #{NOTE}')""")
def neutralize_hashtag(v: Vault) -> DataFrame:
    out = v.markdown.select("entry_id", R.neutralize_hashtag(F.col("markdown"), F.lit(NOTE)).alias("r")).where("r.changed > 0")
    return out.select("entry_id", F.md5("r.markdown").alias("digest"), "r.changed")


@query(f"""select entry_id, md5(regexp_replace(markdown, '(^|\\s)#({NOTE})(\\s|$)', '\\1#Notes\\3', 'g')) as digest, 1 as changed from v_markdown where contains(markdown, ' #{NOTE}')""")
def rename_hashtag(v: Vault) -> DataFrame:
    out = v.markdown.select("entry_id", R.rename_hashtag(F.col("markdown"), F.lit(NOTE), F.lit("Notes")).alias("r")).where("r.changed > 0")
    return out.select("entry_id", F.md5("r.markdown").alias("digest"), "r.changed")


BACK = f"""select r.source_id, s.title as source_title, r.is_hashtag, r.heading, count(*) as n from v_refs r join v_entries e on e.id = {FOCUS}
 and ((not r.is_hashtag and r.target_text = lower(e.title)) or (r.is_hashtag and r.target_text = {TITLE_KEY.format('e.title')})) join v_entries s on s.id = r.source_id where r.source_id <> {FOCUS} group by all"""


@query(BACK)
def backlinks(v: Vault) -> DataFrame:
    return L.backlinks(v, FOCUS).groupBy("source_id", "source_title", "is_hashtag", "heading").agg(F.count(F.lit(1)).alias("n"))


OUT = f"select r.is_hashtag, i.target_id, e.title as target_title, count(*) as n from v_refs r join v_index i on i.h = r.is_hashtag and i.key = r.target_text join v_entries e on e.id = i.target_id where r.source_id = {FOCUS} and i.target_id <> {FOCUS} group by all"


@query(OUT)
def outgoing_links(v: Vault) -> DataFrame:
    return L.outgoing_links(v, FOCUS).groupBy("is_hashtag", "target_id", "target_title").agg(F.count(F.lit(1)).alias("n"))


def ranked(rows: DataFrame, *columns: str) -> DataFrame:
    """The order that rows have, as a column; for the few rows of one entry."""
    return rows.withColumn("at", F.monotonically_increasing_id()).select(F.row_number().over(Window.orderBy("at")).alias("rank"), *columns)


@query(f"""select row_number() over (order by s.title, r.source_id) as rank, r.source_id, s.title as source_title from v_refs r join v_entries e on e.id = {FOCUS}
 and ((not r.is_hashtag and r.target_text = lower(e.title)) or (r.is_hashtag and r.target_text = {TITLE_KEY.format('e.title')})) join v_entries s on s.id = r.source_id where r.source_id <> {FOCUS}""")
def backlinks_order(v: Vault) -> DataFrame:
    return ranked(L.backlinks(v, FOCUS), "source_id", "source_title")


LINKED = 21


@query(f"select row_number() over (order by lower(e.title), i.target_id) as rank, i.target_id from v_refs r join v_index i on i.h = r.is_hashtag and i.key = r.target_text join v_entries e on e.id = i.target_id where r.source_id = {LINKED} and i.target_id <> {LINKED}")
def outgoing_order(v: Vault) -> DataFrame:
    return ranked(L.outgoing_links(v, LINKED), "target_id")


@query(rf"""with l as (select regexp_extract(markdown, '\nlinked: \["(.*)"\]\n---\n', 1) as t from v_markdown where entry_id = {LINKED}), f as (select translate(title, '{identity.UPPER}', '{identity.LOWER}') as key, min(id) as id from v_entries group by 1)
select 0 as ordinal, f.id, e.title from l join f on f.key = translate(l.t, '{identity.UPPER}', '{identity.LOWER}') join v_entries e on e.id = f.id""")
def linked_entries(v: Vault) -> DataFrame:
    return L.linked_entries(v, LINKED)


@query("select id, title from v_entries where id not in (select source_id from v_refs where source_id % 13 <> 0)")
def unindexed_entries(v: Vault) -> DataFrame:
    return L.unindexed_entries(v, v.refs.where("source_id % 13 <> 0"))


@query(f"select distinct 'in' as direction, source_id as id, source_title as title from ({BACK}) union all select distinct 'out', target_id, target_title from ({OUT})")
def direct_links(v: Vault) -> DataFrame:
    return L.direct_links(v, FOCUS)


@query(f"select m.key, m.entry_id as id, e.title from v_members m join v_entries e on e.id = m.entry_id where m.entry_id <> {FOCUS} and m.key in (select key from v_members where entry_id = {FOCUS})")
def hashtag_connections(v: Vault) -> DataFrame:
    return L.hashtag_connections(v, FOCUS)


@query(f"select row_number() over (order by m.key, e.title, m.entry_id) as rank, m.key, m.entry_id as id from v_members m join v_entries e on e.id = m.entry_id where m.entry_id <> {FOCUS} and m.key in (select key from v_members where entry_id = {FOCUS})")
def connection_order(v: Vault) -> DataFrame:
    return with_rank(L.hashtag_connections(v, FOCUS), [F.col(c) for c in ("key", "title", "id")]).select("rank", "key", "id")


@query(f"select count(distinct m.key) as groups, count(*) as n from v_members m where m.entry_id <> {FOCUS} and m.key in (select key from v_members where entry_id = {FOCUS})")
def connection_total(v: Vault) -> DataFrame:
    return L.connection_total(v, FOCUS)


@query(f"select t.name, t.normalized as key, count(m.entry_id) as n from v_tags t left join v_members m on m.key = t.normalized where t.name in (select name from v_tag_raw where entry_id = {LINKED}) group by 1, 2")
def tags_of_entry(v: Vault) -> DataFrame:
    return T.tags_of_entry(v, LINKED)


@query(r"select entry_id, nullif(regexp_extract(markdown, '^---\ntitle: \"(.*)\"\n', 1), '') as title, length(regexp_replace(markdown, '^---\n[\s\S]*?\n---\n', '')) as chars from v_markdown")
def frontmatter_props(v: Vault) -> DataFrame:
    return v.markdown.select("entry_id", P.frontmatter_property(F.col("markdown"), "title").alias("title"), F.length(P.without_frontmatter(F.col("markdown"))).alias("chars"))


@query("select * from v_edges")
def graph_edges(v: Vault) -> DataFrame:
    return G.graph_edges(v)


@query("select * from v_nodes")
def graph_nodes(v: Vault) -> DataFrame:
    return G.graph_nodes(v)


SUB = f"""select source, target, sum(n)::bigint as weight from (
 select 'entry:' || source_id as source, 'tag:' || target_text as target, 1 as n from v_refs where is_hashtag and source_id = {FOCUS}
 union all select 'entry:' || source_id, 'entry:' || target_id, 1 from v_refs r join v_index i on r.is_hashtag = i.h and r.target_text = i.key where target_id <> source_id and source_id = {FOCUS}
 union all select 'entry:' || entry_id, 'tag:' || key, 1 from v_entry_tags where entry_id = {FOCUS}
 union all select 'entry:' || r.source_id, 'entry:' || e.id, 1 from v_refs r join v_entries e on e.id = {FOCUS} and ((not r.is_hashtag and r.target_text = lower(e.title)) or (r.is_hashtag and r.target_text = {TITLE_KEY.format('e.title')})) where r.source_id <> {FOCUS}
 union all select 'entry:' || r.source_id, 'tag:' || r.target_text, 1 from v_refs r join v_entries e on e.id = {FOCUS} and r.is_hashtag and r.target_text = {TITLE_KEY.format('e.title')} where r.source_id <> {FOCUS}
 union all select 'entry:' || entry_id, 'tag:' || key, 1 from v_members where entry_id <> {FOCUS} and key in (select key from v_entry_tags where entry_id = {FOCUS} union select target_text from v_refs where is_hashtag and source_id = {FOCUS}))
group by 1, 2"""


@query(SUB)
def subgraph_edges(v: Vault) -> DataFrame:
    return G.subgraph_edges(v, FOCUS)


@query(f"""with s as ({SUB}), n as (select source as node_id from s union select target from s union select 'entry:{FOCUS}')
select n.node_id, t.title as label, 'entry' as kind, t.source_type from n join v_entries t on n.node_id = 'entry:' || t.id
union all select n.node_id, '#' || coalesce(t.name, substr(n.node_id, 5)), 'tag', null from n left join v_tags t on n.node_id = 'tag:' || t.normalized where n.node_id like 'tag:%'""")
def subgraph_nodes(v: Vault) -> DataFrame:
    return G.subgraph_nodes(v, FOCUS)


@query("select node_id, label from v_nodes where contains(lower(label), 'the')")
def graph_node_search(v: Vault) -> DataFrame:
    return G.node_search(G.graph_nodes(v), " The ")


DEGREE = "select node_id, count(*) as degree from (select distinct unnest([least(source, target), greatest(source, target)]) as node_id, least(source, target) as a, greatest(source, target) as b from v_edges where source <> target) group by 1"


@query(DEGREE)
def node_degree(v: Vault) -> DataFrame:
    return G.node_degree(G.graph_edges(v))


@query(f"select node_id, round(least(26.0, 3 + 5 * sqrt(degree))::double, 6) as size from ({DEGREE})")
def node_size(v: Vault) -> DataFrame:
    return G.node_degree(G.graph_edges(v)).select("node_id", F.round(G.node_size(F.col("degree")), 6).alias("size"))


@query("select node_id, case when length(label) > 24 then substr(label, 1, 24) || '…' else label end as shown, case when kind = 'tag' then 'tag' else source_type end as colour from v_nodes")
def node_style(v: Vault) -> DataFrame:
    return G.node_style(G.graph_nodes(v))


#: Components are told apart by links between entries; tags would tie all together.
LINKS = "select source, target from v_edges where target like 'entry:%'"
REACH = f"""with e as ({LINKS}), b as (select source as x, target as y from e union select target, source from e),
r as (select x, x as y from b union select r.x, b.y from r join b on b.x = r.y), c as (select x as node_id, min(y) as component from r group by 1)"""


def entry_links(v: Vault) -> DataFrame:
    return G.graph_edges(v).where(F.col("target").startswith("entry:"))


@query(f"{REACH} select node_id, component from c")
def connected_components(v: Vault) -> DataFrame:
    return G.connected_components(entry_links(v))


@query(f"{REACH} select component, count(*) as n from c group by 1")
def component_sizes(v: Vault) -> DataFrame:
    return G.component_sizes(G.connected_components(entry_links(v)))


#: Links between entries of one tenth make more components than one.
FEW_LINKS = "select source, target from v_edges where target like 'entry:%' and (substr(source, 7)::bigint + substr(target, 7)::bigint) % 3 = 0"


@query(f"""{REACH.replace(LINKS, FEW_LINKS)} select row_number() over (order by count(*) desc, component) as rank, component, count(*) as n from c group by component""")
def component_order(v: Vault) -> DataFrame:
    number = lambda c: F.substring(c, 7, 20).cast("long")
    few = entry_links(v).where((number(F.col("source")) + number(F.col("target"))) % 3 == 0)
    return with_rank(G.component_sizes(G.connected_components(few)), [F.desc("n"), F.col("component")]).select("rank", "component", "n")


#: Of the few links some come and some go.
OLD_LINKS = f"{FEW_LINKS} and substr(target, 7)::bigint % 5 <> 0"
NEW_LINKS = f"{FEW_LINKS} and substr(target, 7)::bigint % 7 <> 0"


@query(f"{REACH.replace(LINKS, NEW_LINKS)} select node_id, component from c")
def components_after_change(v: Vault) -> DataFrame:
    number = lambda c: F.substring(c, 7, 20).cast("long")
    few = written(entry_links(v).where((number(F.col("source")) + number(F.col("target"))) % 3 == 0).withColumn("t", number(F.col("target"))), "links")
    before = G.connected_components(few.where("t % 5 <> 0"))
    return G.changed_components(before, few.where("t % 7 <> 0"), few.where("t % 5 = 0 and t % 7 <> 0"), few.where("t % 5 <> 0 and t % 7 = 0"))


def documents(v: Vault) -> DataFrame:
    return v.entries.join(v.markdown, F.col("id") == F.col("entry_id")).select("id", "title", F.col("markdown").alias("content"))


FOUND = r"""with d as (select e.id, regexp_extract_all(strip_accents(lower(e.title)), '[\p{L}\p{N}]+') || regexp_extract_all(strip_accents(lower(m.markdown)), '[\p{L}\p{N}]+') as t from v_entries e join v_markdown m on m.entry_id = e.id),
c as (select id, len(t) as size, len(list_filter(t, lambda x: starts_with(x, 'the'))) as a, len(list_filter(t, lambda x: starts_with(x, 'ation'))) as b from d),
s as (select count(*) as total, avg(size) as mean, count(*) filter (where a > 0) as na, count(*) filter (where b > 0) as nb from c),
i as (select *, case when na < total - na then ln((total - na + 0.5) / (na + 0.5)) else 1e-6 end as ia, case when nb < total - nb then ln((total - nb + 0.5) / (nb + 0.5)) else 1e-6 end as ib from s)
select id, -(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * size / mean)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * size / mean))) as score from c, i where a > 0 and b > 0"""


def kept_index(v: Vault) -> segments.SearchIndex:
    """The search index at the vault's home; a vault without one gets an index for this query."""
    spark = v.entries.sparkSession
    return segments.open_or_build(spark, f"{v.home}/search" if v.home else shared_path(spark, "search"), documents(v))


def found(v: Vault) -> DataFrame:
    return kept_index(v).search(WORDS)


@query(f"select id, round(score, 6) as score from ({FOUND})")
def search(v: Vault) -> DataFrame:
    return found(v).select("id", F.round("score", 6).alias("score"))


def changed_index(v: Vault) -> segments.SearchIndex:
    """An index of texts that differ from the vault's: some have an old text, some are not in it, some should not be; then it is brought up to date, a batch at a time."""
    docs = documents(v).withColumn("content", F.coalesce("content", F.lit("")))
    index = segments.SearchIndex(v.entries.sparkSession, shared_path(v.entries.sparkSession, "index"))
    index.replace(docs.where("id % 5 <> 0").withColumn("content", F.when(F.col("id") % 7 == 0, F.lit("the old nation, the ration")).otherwise(F.col("content"))).unionByName(docs.where("id % 50 = 1").withColumn("id", -F.col("id"))))
    index.replace(docs.where("id % 5 = 0"))
    index.replace(docs.where("id % 7 = 0"))
    index.remove(docs.where("id % 50 = 1").select((-F.col("id")).alias("id")))
    index.replace(docs.where(F.col("id") == FOCUS))
    return index


@query(f"select id, round(score, 6) as score from ({FOUND})")
def search_after_replace(v: Vault) -> DataFrame:
    return changed_index(v).search(WORDS).select("id", F.round("score", 6).alias("score"))


@query(f"""select row_number() over (order by round(f.score, 9), f.id) as rank, f.id, e.status from ({FOUND}) f join v_entries e on e.id = f.id where not e.is_archive and f.id in (select entry_id from v_members where key = 'en')""")
def find_entries(v: Vault) -> DataFrame:
    index = kept_index(v)
    return with_rank(segments.find_entries(v, index, WORDS, TAG, "", None, "archive").join(index.search(WORDS), "id"), [F.round("score", 9), F.col("id")]).select("rank", "id", "status")


@query(f"select f.id, round(f.score, 6) as score from ({FOUND}) f join v_entries e on e.id = f.id where e.status = 'read' and not e.is_archive and f.id in (select entry_id from v_members where key = 'en')")
def search_filtered(v: Vault) -> DataFrame:
    kept = E.list_by_tag(v.entries, T.entries_by_tag(v, TAG), status="read", exclude_flag="archive")
    return found(v).join(kept.select("id"), "id", "left_semi").select("id", F.round("score", 6).alias("score"))


CANDIDATES = f"""with f as (select *, row_number() over (order by score, id) as rank from ({FOUND})), o as (select target_id as id from ({OUT}))
select row_number() over (order by rank) as rank, id from (select * from f where id <> {FOCUS} and id not in (select id from o) order by rank limit 8)"""


@query(CANDIDATES)
def link_candidates(v: Vault) -> DataFrame:
    return L.link_candidates(found(v), L.outgoing_links(v, FOCUS).select(F.col("target_id").alias("id")), FOCUS)


@query(CANDIDATES)
def link_candidates_early(v: Vault) -> DataFrame:
    """The same without ranking all results."""
    known = L.outgoing_links(v, FOCUS).select(F.col("target_id").alias("id")).unionByName(v.entries.sparkSession.range(FOCUS, FOCUS + 1))
    return kept_index(v).top(WORDS, 8, known)[0].select("rank", "id")


ODD_URLS = ["https://x.com/a/status/123?s=20", "https://twitter.com/i/web/status/9", "https://x.com:443/a", "http://user@youtube.com/watch?v=1", "https://foo.substack.com/p/x", "https://SUBSTACK.com", "https://youtu.be/abc", "https://mobile.twitter.com/u/statuses/77#x", "notaurl", ""]


def some_urls(v: Vault) -> DataFrame:
    odd = v.entries.sparkSession.createDataFrame([(-1 - i, u) for i, u in enumerate(ODD_URLS)], "id long, url string")
    return v.entries.select("id", "url").unionByName(odd)


URLS_SQL = f"(select id, url from v_entries union all values {', '.join(f'({-1 - i}, {chr(39)}{u}{chr(39)})' for i, u in enumerate(ODD_URLS))})"


@query(rf"""with u as (select id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as h from {URLS_SQL})
select id, case when h in {urls.YOUTUBE} then 'youtube' when h in {urls.X} then 'x' when h in {urls.SUBSTACK} or h like '%.substack.com' then 'substack' else 'article' end as source_type from u""")
def source_type(v: Vault) -> DataFrame:
    return some_urls(v).select("id", urls.source_type(F.col("url")).alias("source_type"))


@query(rf"select id, nullif(regexp_extract(url, '(?i)(?:twitter\.com|x\.com)/(?:[^/?#]+/status(?:es)?|i/web/status)/(\d+)', 1), '') as tweet_id from {URLS_SQL}")
def tweet_id(v: Vault) -> DataFrame:
    return some_urls(v).select("id", urls.tweet_id(F.col("url")).alias("tweet_id"))


@query("select id, 'vault://open?id=' || id as link from v_entries")
def deep_link(v: Vault) -> DataFrame:
    return v.entries.select("id", urls.deep_link(F.col("id")).alias("link"))


@query("select id, case when id % 4 = 0 then id end as parsed from v_entries")
def deep_link_parse(v: Vault) -> DataFrame:
    link = F.when(F.col("id") % 4 == 0, urls.deep_link(F.col("id"))).when(F.col("id") % 4 == 1, F.concat(F.lit("vault://open?id=-"), "id")).when(F.col("id") % 4 == 2, F.concat(F.lit("vault://shut?id="), "id")).otherwise(F.lit("vault://open?id=x"))
    return v.entries.select("id", urls.parse_deep_link(link).alias("parsed"))


@query("select id, id % 3 <> 0 as ok from v_entries")
def fetchable_url(v: Vault) -> DataFrame:
    # Every third url names an address of the private network.
    url = F.when(F.col("id") % 3 == 0, F.concat(F.lit("http://10.0."), F.col("id") % 250, F.lit(".1/x"))).otherwise(F.col("url"))
    return v.entries.select("id", urls.fetchable_url(url).alias("ok"))


@query(r"select entry_id as id, len(list_filter(regexp_split_to_array(markdown, '\s+'), lambda w: w <> '')) as words, length(markdown) as chars, greatest(1, floor(len(list_filter(regexp_split_to_array(markdown, '\s+'), lambda w: w <> '')) / 200.0 + 0.5))::int as minutes from v_markdown")
def reading_stats(v: Vault) -> DataFrame:
    return v.markdown.select(F.col("entry_id").alias("id"), E.reading_stats(F.col("markdown")).alias("s")).select("id", "s.*")


@query("""select entry_id as id, case when entry_id % 3 = 0 then '.png' when entry_id % 3 = 1 then '.jpg' else '.bin' end as ext from v_markdown""")
def image_ext(v: Vault) -> DataFrame:
    kind, url = F.when(F.col("entry_id") % 3 == 0, F.lit("image/PNG; q=1")), F.when(F.col("entry_id") % 3 == 1, F.lit("https://c.example/a.b/x.JPG?y=1.gif")).otherwise(F.lit("https://c.example/x.exe"))
    return v.markdown.select(F.col("entry_id").alias("id"), urls.image_ext(kind, url).alias("ext"))


def with_images(v: Vault) -> DataFrame:
    image = F.concat(F.lit("![alt](https://cdn.example.org/"), F.col("entry_id") % 17, F.lit(".png)"))
    return v.markdown.withColumn("markdown", F.when(F.col("entry_id") % 4 == 0, F.concat("markdown", image)).otherwise(F.col("markdown")))


@query("select entry_id, 'alt' as alt, 'https://cdn.example.org/' || (entry_id % 17) || '.png' as url from v_markdown where entry_id % 4 = 0")
def remote_images(v: Vault) -> DataFrame:
    return P.remote_images(with_images(v))


@query("select id, case when id % 5 = 0 then 'archive' when is_bookmark and is_gem then 'gem' when is_bookmark then '' when is_archive and is_gem then 'gem,bookmark' when is_gem then 'gem,bookmark' else 'bookmark' end as flags from v_entries where not (id % 5 = 0 and is_archive) and not (is_bookmark and is_archive)")
def toggle_flag(v: Vault) -> DataFrame:
    rows = v.entries.where("not (id % 5 = 0 and array_contains(flags, 'archive')) and not (array_contains(flags, 'bookmark') and array_contains(flags, 'archive'))")
    flags = F.when(F.col("id") % 5 == 0, E.toggle_flag(F.col("flags"), "archive")).otherwise(E.toggle_flag(F.col("flags"), "bookmark"))
    return rows.select("id", F.array_join(flags, ",").alias("flags"))


@query("select id, case when id % 3 = 0 then 'unread' else status end as status, case when id % 3 = 0 then 'bookmark' else array_to_string(list_filter([case when is_bookmark then 'bookmark' end, case when is_gem then 'gem' end, case when is_archive then 'archive' end], lambda x: x is not null), ',') end as flags from v_entries")
def migrate_legacy_status(v: Vault) -> DataFrame:
    old = v.entries.withColumn("status", F.when(F.col("id") % 3 == 0, F.lit("favorite")).otherwise(F.col("status")))
    return E.migrate_legacy(old).select("id", "status", F.array_join("flags", ",").alias("flags"))


@query("select id, id % 13 <> 0 as drifted from v_entries where id % 6 = 0 or id % 13 = 0")
def stale_entries(v: Vault) -> DataFrame:
    indexed = v.entries.withColumn("indexed_mtime", F.when(F.col("id") % 13 != 0, F.col("id").cast("double")))
    files = v.entries.select("file_path", (F.col("id") + F.when(F.col("id") % 6 == 0, 5).otherwise(0)).cast("double").alias("mtime"))
    return M.stale_entries(indexed, files)


def after(v: Vault | None) -> DataFrame:
    """(entry_id, key): who has which tag in a new version."""
    return T.members(v)


@query("select entry_id, case when key = 'src0' then 'origin' else key end as key from v_members group by 1, 2")
def rename_tag_simple(v: Vault) -> DataFrame:
    return after(M.rename_tag(v, "SRC0", "origin"))


@query("select distinct entry_id, case when key = 'en' then 'fr' else key end as key from v_members")
def rename_tag_merge(v: Vault) -> DataFrame:
    return after(M.rename_tag(v, "en", "FR", merge=True))


@query("select entry_id, key from v_members where key <> 'de'")
def delete_tag(v: Vault) -> DataFrame:
    return after(M.delete_tag(v, "DE"))


#: Any case of a tag where it stands as a live hashtag in the vault's texts.
LIVE = r"(^|\s)#({0})(\s|$)"
NOW = "2024-02-01 10:00:00"


def texts_and_tags(v: Vault) -> DataFrame:
    return v.markdown.join(v.entries, F.col("entry_id") == F.col("id")).select("entry_id", F.md5("markdown").alias("digest"), F.array_join("tags", ",").alias("tags"), "updated_at")


def with_streets(v: Vault) -> Vault:
    """Every fifth entry has a tag that lower() does not fold: Straße, of the identity strasse."""
    fifth, street = F.col("id") % 5 == 0, F.lit("Straße")
    tag = v.tags.limit(1).select(F.lit(-5).cast("long").alias("id"), street.alias("name"), identity.casefold(street).alias("normalized"))
    entries = v.entries.withColumn("tags", F.when(fifth, F.array_append("tags", street)).otherwise(F.col("tags")))
    return v.with_(tags=v.tags.unionByName(tag), entries=entries, entry_tags=v.entry_tags.unionByName(v.entries.where(fifth).select(F.col("id").alias("entry_id"), F.lit(-5).cast("long").alias("tag_id"))))


@query(f"""select e.id, case when e.id % 5 = 0 then timestamp '{NOW}' else e.created_at end as updated_at, concat_ws(',', g.tags, case when e.id % 5 = 0 then 'road' end) as tags from v_entries e left join v_typed g on g.entry_id = e.id""")
def rename_folded_tag(v: Vault) -> DataFrame:
    out = M.rename_tag(with_streets(v), "STRASSE", "road", now=NOW)
    return out.entries.select("id", "updated_at", F.array_join("tags", ",").alias("tags"))


@query(f"""select e.id, case when e.id % 5 = 0 then timestamp '{NOW}' else e.created_at end as updated_at, coalesce(g.tags, '') as tags from v_entries e left join v_typed g on g.entry_id = e.id""")
def delete_folded_tag(v: Vault) -> DataFrame:
    out = M.delete_tag(with_streets(v), "straSSe", NOW)
    return out.entries.select("id", "updated_at", F.array_join("tags", ",").alias("tags"))


@query(rf"""select m.entry_id, md5(regexp_replace(markdown, '{LIVE.format("[eE][nN]")}', '\1#' || n.name || '\3', 'g')) as digest,
 coalesce((select string_agg(distinct case when lower(r.name) = 'en' then n.name else r.name end, ',' order by case when lower(r.name) = 'en' then n.name else r.name end) from v_tag_raw r where r.entry_id = m.entry_id), '') as tags, (select case when e.id in (select entry_id from v_entry_tags where key = 'en') then timestamp '{NOW}' else e.created_at end from v_entries e where e.id = m.entry_id) as updated_at
 from v_markdown m, (select name from v_tags where normalized = 'fr') n""")
def rename_tag_texts(v: Vault) -> DataFrame:
    out = M.rename_tag(v, "en", "FR", merge=True, now=NOW)
    return texts_and_tags(out.with_(entries=out.entries.withColumn("tags", F.array_sort("tags"))))


@query(rf"""select m.entry_id, md5(regexp_replace(markdown, '{LIVE.format("[dD][eE]")}', '\1`#\2`\3', 'g')) as digest,
 coalesce((select string_agg(r.name, ',' order by r.name) from v_tag_raw r where r.entry_id = m.entry_id and lower(r.name) <> 'de'), '') as tags,
 (select case when e.id in (select entry_id from v_entry_tags where key = 'de') then timestamp '{NOW}' else e.created_at end from v_entries e where e.id = m.entry_id) as updated_at from v_markdown m""")
def delete_tag_texts(v: Vault) -> DataFrame:
    return texts_and_tags(M.delete_tag(v, "DE", NOW))


@query("""select id, title, url, status from v_entries union all select (select max(id) + 1 from v_entries), 'A new page', 'https://new.example.org/', 'unread'""")
def add_entry(v: Vault) -> DataFrame:
    out = M.add_entry(v, {"title": "A new page", "url": "https://new.example.org/", "source_type": "article"}, "# A new page")
    return out.entries.select("id", "title", "url", "status")


@query(f"select id, case when id = {FOCUS} then 'read' else status end as status, case when id = {FOCUS} then timestamp '{NOW}' else read_at end as read_at, case when id = {FOCUS} then timestamp '{NOW}' else created_at end as updated_at from v_entries")
def update_status(v: Vault) -> DataFrame:
    return M.update_status(v, FOCUS, "read", NOW).entries.select("id", "status", "read_at", "updated_at")


FLAGS_SQL = "array_to_string(list_filter([case when is_bookmark then 'bookmark' end, case when is_gem then 'gem' end, case when is_archive then 'archive' end], lambda x: x is not null), ',')"


@query(f"select id, case when id = {FOCUS} then 'gem,archive' else {FLAGS_SQL} end as flags, case when id = {FOCUS} then timestamp '{NOW}' else created_at end as updated_at from v_entries")
def update_flags(v: Vault) -> DataFrame:
    return M.update_flags(v, FOCUS, ["gem", "archive"], NOW).entries.select("id", F.array_join("flags", ",").alias("flags"), "updated_at")


@query(f"""with n as (select * from v_entry_tags where entry_id <> {FOCUS} union all select {FOCUS}, unnest(['en', 'zebra', 'strasse', 'ΣΊΣΥΦΟΣ']))
select n.entry_id, lower(replace(n.key, 'ΣΊΣΥΦΟΣ', 'σίσυφοσ')) as key, coalesce(t.name, case n.key when 'zebra' then 'Zebra' when 'strasse' then 'Straße' else 'Σίσυφος' end) as name,
 case when n.entry_id = {FOCUS} then timestamp '{NOW}' else e.created_at end as updated_at from n join v_entries e on e.id = n.entry_id left join v_tags t on t.normalized = n.key""")
def update_tags(v: Vault) -> DataFrame:
    old = v.with_(tags=v.tags.unionByName(v.tags.limit(1).select(F.lit(-1).cast("long").alias("id"), F.lit("Σίσυφος").alias("name"), identity.casefold(F.lit("Σίσυφος")).alias("normalized")).distinct()))
    old = old.with_(tags=old.tags.unionByName(v.tags.limit(1).select(F.lit(-2).cast("long").alias("id"), F.lit("Straße").alias("name"), identity.casefold(F.lit("Straße")).alias("normalized"))))
    out = M.update_tags(old, FOCUS, ["Zebra", "eN", "zebra", "STRASSE", "ΣΊΣΥΦΟΣ"], NOW)
    named = T.structural(out).join(out.tags.select(F.col("normalized").alias("key"), "name"), "key")
    return named.join(out.entries.select("id", "updated_at"), F.col("entry_id") == F.col("id")).select("entry_id", "key", "name", "updated_at")


@query("select name, normalized from v_tags union all select 'Brand-New', 'brand-new'")
def create_tag(v: Vault) -> DataFrame:
    return M.create_tag(M.create_tag(v, "Brand-New")[0], "EN")[0].tags.select("name", "normalized")


@query(f"select m.entry_id, m.key, (select count(*) from v_entries) - 1 as entries from v_members m where m.entry_id <> {FOCUS}")
def hard_delete(v: Vault) -> DataFrame:
    out = M.hard_delete(v, FOCUS)
    return T.members(out).select("entry_id", "key", out.entries.agg(F.count(F.lit(1))).scalar().alias("entries"))


@query("select source_id, target_text, is_hashtag, count(*) as n from v_refs where source_id % 50 <> 0 group by all union all select id, 'anew', true, 1 from v_entries where id % 50 = 0 union all select id, 'some page', false, 2 from v_entries where id % 50 = 0 union all select id, '', false, 1 from v_entries where id % 50 = 0")
def index_refs(v: Vault) -> DataFrame:
    changed = v.markdown.where("entry_id % 50 = 0").withColumn("markdown", F.lit("#Anew [[Some Page]]\n\n[[some page|x]] `#not` [[ ]]"))
    return M.index_refs(v, changed).groupBy("source_id", "target_text", "is_hashtag").agg(F.count(F.lit(1)).alias("n"))


def replayed(v: Vault) -> str:
    """A change log of all texts, followed by a stream: first every text; then new texts of some, and some files gone; then old versions that come late, and versions that come twice. The folder of what came of it."""
    spark = v.entries.sparkSession
    home = shared_path(spark, "replay")
    told = v.markdown.join(v.entries.select("id", "file_path"), F.col("entry_id") == F.col("id"))
    log = lambda texts, seq, markdown="markdown", gone=False: texts.select("file_path", F.expr(markdown).alias("markdown"), F.lit(float(seq)).alias("mtime"), F.lit(gone).alias("gone"), F.lit(seq).cast("long").alias("seq"))
    for part in (
        log(told, 0),
        log(told.where("entry_id % 50 = 0"), 2, "'#Anew [[Some Page]]'").unionByName(log(told.where("entry_id % 11 = 3"), 2, "cast(null as string)", True)),
        log(told.where("entry_id % 50 = 0"), 1, "'#Late'").unionByName(log(told.where("entry_id % 7 = 0"), 0)),
    ):
        part.write.mode("append").parquet(f"{home}/log")
        reconcile.follow(reconcile.changed_files(spark, f"{home}/log"), v.entries, f"{home}/out", f"{home}/check").awaitTermination()
    reconcile.compact(spark, f"{home}/out")
    part = log(told.where("entry_id % 50 = 25"), 3, "'#Anew #en'")
    part.write.mode("append").parquet(f"{home}/log")
    reconcile.follow(reconcile.changed_files(spark, f"{home}/log"), v.entries, f"{home}/out", f"{home}/check").awaitTermination()
    return f"{home}/out"


REPLAYED = """(select source_id, target_text, is_hashtag from v_refs where source_id % 25 <> 0 and source_id % 11 <> 3
 union all select id, 'anew', true from v_entries where id % 25 = 0 and (id % 11 <> 3 or id % 50 = 25)
 union all select id, 'some page', false from v_entries where id % 50 = 0 and id % 11 <> 3
 union all select id, 'en', true from v_entries where id % 50 = 25)"""


@query(f"select source_id, target_text, is_hashtag, count(*) as n from {REPLAYED} group by all")
def reconciled_refs(v: Vault) -> DataFrame:
    return reconcile.current_refs(v.entries.sparkSession, replayed(v)).groupBy("source_id", "target_text", "is_hashtag").agg(F.count(F.lit(1)).alias("n"))


@query(f"select target_text as key, count(distinct source_id) as n from {REPLAYED} where is_hashtag group by 1")
def reconciled_tag_counts(v: Vault) -> DataFrame:
    return reconcile.current_tag_counts(v.entries.sparkSession, replayed(v)).select("key", "n")


@query("""select 'library' as key, count(*) as n from v_entries where not is_archive and id % 3 <> 0 union all select 'archive', count(*) from v_entries where is_archive or id % 3 = 0
 union all select 'read', count(*) from v_entries where not is_archive and id % 3 <> 0 and (status = 'read' or id % 4 = 0) union all select 'unread', count(*) from v_entries where not is_archive and id % 3 <> 0 and status = 'unread' and id % 4 <> 0
 union all select 'bookmark', count(*) from v_entries where not is_archive and id % 3 <> 0 and is_bookmark union all select 'gem', count(*) from v_entries where not is_archive and id % 3 <> 0 and is_gem""")
def maintained_sections(v: Vault) -> DataFrame:
    """Counts of the sections after two changes, from the counts before and the entries that each change touched."""
    counts = E.sections(v.entries).groupBy(F.col("section").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    archived = lambda e: e.withColumn("flags", F.array(F.lit("archive")))
    read = lambda e: e.withColumn("status", F.lit("read"))
    first, second = v.entries.where("id % 3 = 0"), v.entries.where("id % 4 = 0")
    between = second.withColumn("flags", F.when(F.col("id") % 3 == 0, F.array(F.lit("archive"))).otherwise(F.col("flags")))
    return C.applied(counts, C.section_differences(first, archived(first)), C.section_differences(between, read(between)))


@query("select entry_id, case when key = 'de' then 'deutsch' else key end as key, 3 as version from v_members union all select entry_id, key, 1 from v_members")
def committed_versions(v: Vault) -> DataFrame:
    """Two mutations committed one after the other, and the first version read as it was."""
    kept = CommittedVault(v.entries.sparkSession, shared_path(v.entries.sparkSession, "vault"))
    kept.create(v)
    kept.mutate(lambda x: M.rename_tag(x, "DE", "Deutsch", now=NOW))
    number, new = kept.mutate(lambda x: M.update_flags(x, FOCUS, ["gem"], NOW))
    return T.members(new).withColumn("version", F.lit(number)).unionByName(T.members(kept.open(1)[1]).withColumn("version", F.lit(1)))


@query(rf"""with t as (select entry_id, nullif(regexp_extract(markdown, '\nlinked: \["(.*)"\]\n---\n', 1), '') as l from v_markdown)
select t.entry_id, trim(coalesce(l, '') || '|' || case t.entry_id when {LINKED} then (select title from v_entries where id = {FOCUS}) when {FOCUS} then (select title from v_entries where id = {LINKED}) else '' end, '|') as linked from t where t.entry_id in ({LINKED}, {FOCUS}, {LINKED + 5})""")
def set_link(v: Vault) -> DataFrame:
    texts = M.set_link(v, LINKED, FOCUS).markdown.where(F.col("entry_id").isin(LINKED, FOCUS, LINKED + 5))
    return texts.select("entry_id", F.array_join(R.frontmatter_links("markdown"), "|").alias("linked"))


@query(f"""select e.id, case when e.id = {FOCUS} then 'unread' else e.status end as status, case when e.id = {FOCUS} then 'gem' else {FLAGS_SQL} end as flags,
 case when e.id = {FOCUS} then md5('A new text.') else md5(m.markdown) end as digest, case when e.id = {FOCUS} then 'other' else coalesce(g.tags, '') end as tags
 from v_entries e join v_markdown m on m.entry_id = e.id left join v_typed g on g.entry_id = e.id""")
def patch_entry(v: Vault) -> DataFrame:
    out = M.patch_entry(v, FOCUS, NOW, status="unread", flags=["gem"], tags=["other"], markdown="A new text.")
    return out.entries.join(out.markdown, F.col("id") == F.col("entry_id")).select("id", "status", F.array_join("flags", ",").alias("flags"), F.md5("markdown").alias("digest"), F.array_join("tags", ",").alias("tags"))


THREAD = "select cast(conv_id as varchar) || '/' || turn as id, case when turn > 0 then cast(conv_id as varchar) || '/' || (turn - 1) end as parent_id from conversations"


def thread_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name = lambda turn: F.concat_ws("/", F.col("conv_id").cast("string"), turn.cast("string"))
    return G.thread_chains(posts.select(name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id")))


QUERIES["thread_chain"] = thread_chain
SQL["thread_chain"] = f"with recursive p as ({THREAD}), r as (select id, parent_id, id as tail, 1 as d from p union all select p.id, p.parent_id, r.tail, r.d + 1 from r join p on p.id = r.parent_id where r.d < 100) select tail as tail_id, max(d) as depth, bool_or(parent_id is null) as complete from r group by 1"


def pages_of(f: Callable[[DataFrame], DataFrame], name: str, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    if sql:
        SQL[name] = sql


pages_of(P.link_density, "page_link_density", P.LINK_DENSITY_SQL)
pages_of(P.low_confidence, "low_confidence", P.LOW_CONFIDENCE_SQL)
pages_of(A.page_sources, "page_sources", rf"""with u as (select page_id, url, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as h from pages)
select page_id, case when h in {urls.YOUTUBE} then 'youtube' when h in {urls.X} then 'x' when h in {urls.SUBSTACK} or h like '%.substack.com' then 'substack' else 'article' end as source_type,
 coalesce(nullif(regexp_extract(url, 'youtube\.com/watch\?(?:.*&)?v=([^&]+)', 1), ''), nullif(regexp_extract(url, 'youtu\.be/([^?/]+)', 1), ''), nullif(regexp_extract(url, 'youtube\.com/embed/([^?/]+)', 1), '')) as video_id,
 nullif(regexp_extract(url, '(?i)(?:twitter\.com|x\.com)/(?:[^/?#]+/status(?:es)?|i/web/status)/(\d+)', 1), '') as tweet_id from u""")
pages_of(P.script_ratio, "page_script_ratio", P.SCRIPT_RATIO_SQL)


def thread_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return posts.select("conv_id", "turn", P.short_title(F.col("text"), F.lit("Thread")).alias("title"))


QUERIES["thread_title"] = thread_title
SQL["thread_title"] = r"with c as (select conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from conversations) select conv_id, turn, case when t = '' then 'Thread' when length(t) > 80 then rtrim(substr(t, 1, 80)) || '…' else t end as title from c"


def articles(pages: DataFrame) -> DataFrame:
    return A.article_pages(pages, "2024-01-20T12:00:00+00:00")


UNESCAPED = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"
#: The driver's pages hold one article each, with a heading and paragraphs that are not all closed.
ARTICLES_SQL = rf"""with u as (select *, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as a, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)) as h from pages),
s as (select *, trim({UNESCAPED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) as title, {UNESCAPED.format("regexp_replace(a, '<[^>]*>', '', 'g')")} as said,
 case when h in {urls.YOUTUBE} then 'youtube' when h in {urls.X} then 'x' when h in {urls.SUBSTACK} or h like '%.substack.com' then 'substack' else 'article' end as source_type from u),
c as (select *, len(list_filter(regexp_split_to_array(said, '\s+'), lambda w: w <> '')) as words, length(trim(said)) < 100 as failed from s)"""
pages_of(lambda pages: articles(pages).select("page_id", "url", "source_type", "title", "low_confidence", "words", "failed"), "extract_article", rf"""{ARTICLES_SQL}
select page_id, url, source_type, case when not failed then title end as title, case when not failed then words < 200 end as low_confidence, case when failed then 0 else words end as words, failed from c""")
LINE_SQL = UNESCAPED.format("regexp_replace({0}, '<[^>]*>', '', 'g')")
MARKED_SQL = rf"trim(regexp_replace(replace(replace({LINE_SQL}, '*', '\*'), '_', '\_'), '\s+', ' ', 'g'))"
pages_of(lambda pages: articles(pages).where("not failed").select("page_id", F.md5(F.ltrim(P.without_frontmatter(F.col("markdown")), F.lit("\n"))).alias("digest")), "article_body", rf"""{ARTICLES_SQL},
p as (select page_id, regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1) as h1, list_filter(regexp_split_to_array(regexp_extract(a, '(?s)</h1>(.*)', 1), '</?p>'), lambda x: x <> '') as ps from c where not failed)
select page_id, md5('# ' || {MARKED_SQL.format('h1')} || chr(10) || chr(10) || array_to_string(list_transform(ps, lambda x: case when starts_with(x, '<b>') then '**' || {MARKED_SQL.format('x')} || '**' else {MARKED_SQL.format('x')} end), chr(10) || chr(10)) || chr(10)) as digest from p""")
pages_of(lambda pages: articles(pages).where("not failed").select("page_id", "markdown"), "article_markdown")
