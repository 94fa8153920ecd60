"""The queries of the operators for training data, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.identity import ascii_lower
from lodestone.llm import chat, chunk_dedup, decontaminate, exact_dedup, infill, jaccard, merkle, pieces, quality, sharding, suffix_dedup, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [url_filter.rule(v, r) for v, r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES).drop("n_levels")


SHARDS = 24


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda: (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 8).cast("long")
    out = sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS, ["text"], size=size())
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", size().alias("size"), crc.alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), SHARDS + 1).alias("grown_shard"), "bucket")


def op8_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


PROBE = r"\### Assistant: </turn> ok"


def as_log(messages: DataFrame) -> DataFrame:
    """The rows of each conversation as the log of a streamed chat, turn by turn, its events not in order.

    A user's turn is streamed in part, edited and streamed on; an answer is begun, regenerated and streamed in two deltas; any other turn is deleted and started again. Rows that repeat a turn are turns of their own, one after another.
    """
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = (F.length("text") / 2).cast("int")
    one, two = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))

    def log(*events: tuple[str, Column | None, Column | None]) -> Column:
        numbered = [F.struct((8 * F.col("place") + i).alias("seq"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text")) for i, (kind, role, text) in enumerate(events)]
        return F.array(*reversed(numbered))

    role, typo = F.col("role"), F.lit("<typo>")
    edited = log(("start", role, None), ("delta", None, typo), ("edit", None, one), ("delta", None, two))
    again = log(("start", role, None), ("delta", None, typo), ("regenerate", None, None), ("delta", None, one), ("delta", None, two))
    deleted = log(("start", role, typo), ("delete", None, None), ("start", role, None), ("delta", None, one), ("delta", None, two))
    events = F.when(role == "user", edited).when(role == "assistant", again).otherwise(deleted)
    return messages.withColumn("place", place).select("conv_id", F.col("place").alias("turn"), F.explode(events).alias("e")).select("conv_id", "turn", "e.*")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"select cast(-7 as bigint) conv_id, cast(t as bigint) turn, r role, r'{PROBE}' text from values (0, 'user'), (1, 'assistant') as v(t, r)")
    out = chat.render(chat.fold_events(as_log(messages.unionByName(probe)))).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", (toxicity.fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pieces.encode(docs, decoded=True)
    return out.select("doc_id", "ids", F.size("ids").alias("n_tokens"), "n_chunks", F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_suffixes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    again = infill.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = merkle.leaf_of([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    claim = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, tampered)
    out = merkle.merkle_manifest(docs, LEAF, "lang", "doc_id", claim).withColumn("folded_root", merkle.fold("claim", "proof"))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP3_SQL = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages),
r(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (
  select p.page_id, max_by(r.host || r.path, length(r.host) + length(r.path)) as rule, max_by(r.verdict, length(r.host) + length(r.path)) as verdict
  from p join r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path)
  group by p.page_id)
select p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') as verdict  from p left join m using (page_id)
"""

UP = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP5_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
i as (select item_id, w, least(len(w), 10) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0),
v as (select distinct item_id, k, array_to_string(w[s:s + k - 1], ' ') as t from i),
o as (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from d, (select distinct k from v) where len(w) >= k),
h as (select o.doc_id, o.s, o.k, v.item_id from o join v on v.k = o.k and v.t = array_to_string(o.w[o.s:o.s + o.k - 1], ' ')),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + k)) as p from h) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as items from h group by 1)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from d left join c using (doc_id) left join t using (doc_id)
"""

OP6_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UP}), '[^\x20\x09-\x0D]+') as w from documents),
g as (select distinct doc_id, array_to_string(w[s:s + 3], ' ') as t from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as s from d where len(w) > 0)),
n as (select doc_id, count(*) as n from g group by 1),
e as (select x.doc_id as a, y.doc_id as b from g x join g y on x.t = y.t and x.doc_id < y.doc_id join n p on p.doc_id = x.doc_id join n q on q.doc_id = y.doc_id group by all having 100 * count(*) >= 85 * (any_value(p.n) + any_value(q.n) - count(*))),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as x, doc_id as y from d union select r.x, u.b from r join u on u.a = r.y),
c as (select x, min(y) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.component_id from d left join n using (doc_id) join c on c.x = d.doc_id
"""

OP9_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (
  select *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', '')) as body,
    length(role) + length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')) as head
  from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(6 + head + 1 + body + 8)::bigint as formatted_chars
from e group by conv_id
"""


OP11_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as t from documents),
g as (select doc_id, t, first_value(doc_id) over (partition by t order by len desc, doc_id) as keep_id, count(*) over (partition by t) as group_size from d)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from g
"""

OP12_SQL = """
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || cast(doc_id as varchar)) as h from documents),
e as (select *, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from e),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from f)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256
from p
"""


def queries() -> dict[str, Query]:
    return {"op1_toxicity": op1_toxicity, "op2_pieces": op2_pieces, "op3_url_filter": op3_url_filter, "op6_jaccard": op6_jaccard, "op7_sharding": op7_sharding, "op8_chunk_dedup": op8_chunk_dedup, "op9_chat": op9_chat, "op4_suffix_dedup": op4_suffix_dedup, "op5_decontaminate": op5_decontaminate, "op10_quality": op10_quality, "op11_exact_dedup": op11_exact_dedup, "op12_infill": op12_infill, "op13_merkle": op13_merkle}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op5_decontaminate": OP5_SQL, "op6_jaccard": OP6_SQL, "op9_chat": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_infill": OP12_SQL}
