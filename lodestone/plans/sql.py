"""The vault in SQL, for checking queries with another engine."""

from __future__ import annotations

from lodestone.functions.identity import HASHTAG_FIRST, HASHTAG_REST
from lodestone.sources.vault import VIEWS

FOLD = "replace(lower({0}), 'ß', 'ss')"
TITLE_KEY = r"replace(lower(regexp_replace(trim({0}), '\s+', '_', 'g')), 'ß', 'ss')"

CTES = {
    **VIEWS,
    "v_tags": "select min_by(name, entry_id) as name, lower(name) as normalized from v_tag_raw group by 2",
    "v_entry_tags": "select distinct entry_id, lower(name) as key from v_tag_raw",
    "v_typed": "select entry_id, string_agg(name, ',' order by name) as tags from v_tag_raw group by 1",
    "v_lines": r"""
select entry_id, unnest(l) as line, generate_subscripts(l, 1) as n
from (select entry_id, regexp_split_to_array(regexp_replace(markdown, '(?m)^---\n[\s\S]*?\n---\n', ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') as l from v_markdown)""",
    "v_fenced": """
select *, line like '```%' as is_fence, sum(case when line like '```%' then 1 else 0 end) over (partition by entry_id order by n) % 2 = 1 as inside from v_lines""",
    "v_live": r"""
select entry_id, n, last_value(case when line similar to '#{1,6}\s+.+' then trim(regexp_extract(line, '^#{1,6}\s+(.+)', 1)) end ignore nulls) over (partition by entry_id order by n) as heading,
 regexp_replace(case when line similar to '#{1,6}\s+.+' then regexp_extract(line, '^#{1,6}\s+(.+)', 1) else line end, '`[^`\n]+`', ' ', 'g') as line
from v_fenced where not is_fence and not inside""",
    "v_refs": rf"""
select entry_id as source_id, lower(trim(unnest(regexp_extract_all(line, '\[\[([^\[\]|]+?)(?:\|[^\[\]]*?)?\]\]', 1)))) as target_text, false as is_hashtag, heading from v_live
union all select entry_id, {FOLD.format(f"unnest(regexp_extract_all(line, '(?:^|\\s)#([{HASHTAG_FIRST}][{HASHTAG_REST.replace(chr(39), chr(39) * 2)}]*)', 1))")}, true, heading from v_live
union all select entry_id, lower(t), false, null from (select entry_id, regexp_extract(markdown, '\nlinked: \["(.*)"\]\n---\n', 1) as t from v_markdown) where t <> ''""",
    "v_hashtags": "select distinct source_id as entry_id, target_text as key from v_refs where is_hashtag",
    "v_members": "select entry_id, key from v_entry_tags union select entry_id, key from v_hashtags",
    "v_index": f"""
select false as h, lower(title) as key, max(id) as target_id from v_entries group by 2
union all select true, {TITLE_KEY.format('title')}, max(id) from v_entries group by 2""",
    "v_edges": """
select source, target, sum(n)::bigint as weight from (
 select 'entry:' || source_id as source, 'tag:' || target_text as target, 1 as n from v_refs where is_hashtag
 union all select 'entry:' || source_id, 'entry:' || target_id, 1 from v_refs r join v_index i on r.is_hashtag = i.h and r.target_text = i.key where target_id <> source_id
 union all select 'entry:' || entry_id, 'tag:' || key, 1 from v_entry_tags)
group by 1, 2""",
    "v_nodes": """
select e.node_id, t.title as label, 'entry' as kind, t.source_type from (select source as node_id from v_edges union select target from v_edges) e join v_entries t on e.node_id = 'entry:' || t.id
union all select e.node_id, '#' || coalesce(t.name, substr(e.node_id, 5)), 'tag', null from (select distinct target as node_id from v_edges where target like 'tag:%') e left join v_tags t on e.node_id = 'tag:' || t.normalized""",
}


def vault_sql(query: str) -> str:
    """A query with the tables of the vault that it uses, directly or not, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name in text.replace(f"{name}_", "") and name not in needed:
                need(CTES[name])
                needed.append(name)

    need(query)
    if not needed:
        return query
    tables = ", ".join(f"{n} as materialized ({CTES[n]})" for n in needed)
    return f"with recursive {tables}{', ' + query[5:] if query.startswith('with ') else ' ' + query}"
