"""Statistics of raw pages, and images in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TITLE_LIMIT = 80


def visible(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def link_density(pages: DataFrame) -> DataFrame:
    """(page_id, link_chars, chars, density): how much of the visible text stands in links. A page without text has density 0."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), 1)
    inside = F.aggregate(F.transform(anchors, lambda a: F.length(visible(a))), F.lit(0), lambda x, y: x + y)
    out = pages.select("page_id", inside.alias("link_chars"), F.length(visible(F.col("html"))).alias("chars"))
    return out.withColumn("density", F.when(F.col("chars") > 0, F.round(F.col("link_chars") / F.col("chars"), 6)).otherwise(F.lit(0.0)))


LINK_DENSITY_SQL = r"""
with v as (select page_id, html, list_transform(regexp_extract_all(html, '(?is)<a\b[^>]*>(.*?)</a\s*>', 1), lambda a: length(trim(regexp_replace(regexp_replace(regexp_replace(a, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))) as a,
 length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as chars from pages)
select page_id, coalesce(list_sum(a), 0)::int as link_chars, chars, case when chars > 0 then round(coalesce(list_sum(a), 0) / chars, 6) else 0.0 end as density from v
"""


def script_ratio(pages: DataFrame) -> DataFrame:
    """(page_id, scripts, tags, ratio): script elements among all opening tags."""
    scripts, tags = count_of(F.col("html"), r"(?i)<script\b"), count_of(F.col("html"), r"<[A-Za-z]")
    return pages.select("page_id", scripts.alias("scripts"), tags.alias("tags"), F.round(scripts / F.greatest(tags, F.lit(1)), 6).alias("ratio"))


SCRIPT_RATIO_SQL = r"""
with c as (select page_id, len(regexp_extract_all(html, '(?i)<script\b'))::int as scripts, len(regexp_extract_all(html, '<[A-Za-z]'))::int as tags from pages)
select *, round(scripts / greatest(tags, 1), 6) as ratio from c
"""


LEAST_WORDS, SCRIPT_SHARE = 200, 0.4


def low_confidence(pages: DataFrame) -> DataFrame:
    """(page_id, words, low): pages whose text a browser would have to make: under 200 words, or more than 0.4 scripts among the elements."""
    text = visible(F.col("html"))
    words = F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))
    scripts, tags = count_of(F.col("html"), r"(?i)<script\b"), count_of(F.col("html"), r"<[A-Za-z]")
    return pages.select("page_id", words.alias("words"), ((words < LEAST_WORDS) | (scripts / F.greatest(tags, F.lit(1)) > SCRIPT_SHARE)).alias("low"))


LOW_CONFIDENCE_SQL = r"""
with v as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as t,
 len(regexp_extract_all(html, '(?i)<script\b')) as scripts, len(regexp_extract_all(html, '<[A-Za-z]')) as tags from pages)
select page_id, case when t = '' then 0 else len(string_split(t, ' ')) end as words, (case when t = '' then 0 else len(string_split(t, ' ')) end < 200) or scripts / greatest(tags, 1) > 0.4 as low from v
"""


def frontmatter_property(markdown: Column, name: str) -> Column:
    """A plain property of the leading frontmatter, without one quote on either side; null without."""
    head = F.regexp_extract(markdown, r"(?s)^---\r?\n(.*?)\r?\n---\r?\n", 1)
    found = F.regexp_extract(head, rf"(?m)^{name}:[ \t]*(.*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit(""))


def without_frontmatter(markdown: Column) -> Column:
    """The text as a reader sees it; line ends of either kind around the frontmatter."""
    return F.regexp_replace(markdown, r"\A---\r?\n[\s\S]*?\r?\n---\r?\n", "")


def remote_images(markdown: DataFrame) -> DataFrame:
    """(entry_id, alt, url): images of other hosts, once for each url in a text, in no order."""
    pattern = r'!\[([^\]]*)\]\(((?:https?:)?//[^\s)]+)(?:\s+"[^"]*")?\)'
    both = F.arrays_zip(F.regexp_extract_all("markdown", F.lit(pattern), 1).alias("alt"), F.regexp_extract_all("markdown", F.lit(pattern), 2).alias("url"))
    each = markdown.where(F.col("markdown").contains("![")).select("entry_id", F.posexplode(both).alias("at", "i"))
    return each.groupBy("entry_id", "i.url").agg(F.min_by("i.alt", "at").alias("alt")).select("entry_id", "alt", "url")


def short_title(text: Column, fallback: Column, limit: int = TITLE_LIMIT) -> Column:
    """One line of at most `limit` characters, with an ellipsis where it was cut."""
    one = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")
    cut = F.concat(F.regexp_replace(F.substring(one, 1, limit), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.coalesce(one, F.lit("")) == "", fallback).when(F.length(one) > limit, cut).otherwise(one)
