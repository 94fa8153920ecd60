"""From urls to pages of a vault, by where they come from: articles from HTML, tweets from their JSON, videos from their transcripts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import markdown, social, urls
from lodestone.functions.dom import Node, parse
from lodestone.operators.articles import Article, article_pages, frontmatter, transcript
from lodestone.sources.shared import written

MAX_HOPS = 100
PAGE = "page_id long, url string, source_type string, title string, markdown string, failed boolean"


def chains(posts: DataFrame, tails: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """posts (id, parent_id, json), tails (id) -> (tail, chain: json from the root on, complete). A chain is not complete if a parent is missing or it is longer than max_hops.

    Pointers are doubled: after k rounds each tail has its posts up to 2**k hops back, and each post knows the one 2**k hops above it. Each round is written, so plans stay short.
    """
    above = posts.where("parent_id is not null").select("id", F.col("parent_id").alias("up"))
    met = tails.select(F.col("id").alias("tail")).distinct().select("tail", F.col("tail").alias("at"), F.lit(0).alias("hop"))
    step = 1
    while step < max_hops:
        further = met.join(above, F.col("at") == F.col("id")).select("tail", F.col("up").alias("at"), (F.col("hop") + step).alias("hop")).where(F.col("hop") < max_hops)
        met = written(met.unionByName(further), "hops")
        step *= 2
        if step < max_hops:
            far = above.select(F.col("id").alias("mid"), F.col("up").alias("top"))
            above = written(above.join(far, F.col("up") == F.col("mid")).select("id", F.col("top").alias("up")), "above")
    walked = met.join(posts.select("id", "parent_id", "json"), F.col("at") == F.col("id"))
    grouped = walked.groupBy("tail").agg(F.array_sort(F.collect_list(F.struct((-F.col("hop")).alias("hop"), "json", "parent_id"))).alias("c"))
    return grouped.select("tail", F.transform("c", lambda x: x["json"]).alias("chain"), F.col("c")[0]["parent_id"].isNull().alias("complete"))


def page(page_id: int, url: str, kind: str, title: str, html: str, said: dict, created_at: str) -> tuple:
    head = frontmatter(Article(title, Node(""), url, kind, {k: v for k, v in said.items() if v}), created_at)
    return page_id, url, kind, title, f"{head}\n{markdown.to_markdown(parse(html))}", False


def tweet_pages(pages: DataFrame, posts: DataFrame, created_at: str, oembeds: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url) of tweets with the chain that leads to each; where there is none, what oembeds (id, html, author: one row for each id) have of it. A tweet that nobody has is a failed page."""
    wanted = pages.select("page_id", "url", urls.tweet_id(F.col("url")).alias("id"))
    found = wanted.join(chains(posts, wanted), F.col("id") == F.col("tail"), "left")
    if oembeds is None:
        found = found.withColumns({"oembed": F.lit(None).cast("string"), "oembed_author": F.lit(None).cast("string")})
    else:
        found = found.join(oembeds.select(F.col("id").alias("of"), F.col("html").alias("oembed"), F.col("author").alias("oembed_author")), F.col("id") == F.col("of"), "left")

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, url, tweet_id, chain, complete, oembed, author in zip(*(frame[c] for c in ("page_id", "url", "id", "chain", "complete", "oembed", "oembed_author")), strict=True):
                tweets = [json.loads(x) for x in chain] if chain is not None else []
                if not tweets and oembed:
                    title = social.title(" ".join(social.oembed_paragraphs(oembed)), f"Tweet {tweet_id}")
                    out.append(page(page_id, url, "x", title, social.render_oembed(oembed), {"author": author}, created_at))
                    continue
                if not tweets:
                    out.append((page_id, url, "x", None, None, True))
                    continue
                title = social.title(social.shown_text(tweets[0]), f"Tweet {tweet_id}")
                out.append(page(page_id, url, "x", title, social.render_thread(tweets, bool(complete)), {"author": social.author(tweets[0]), "published": tweets[0].get("created_at")}, created_at))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PAGE.split(", ")])

    return found.select("page_id", "url", "id", "chain", "complete", "oembed", "oembed_author").mapInPandas(render, PAGE)


def preferred_transcripts(transcripts: DataFrame) -> DataFrame:
    """One transcript for each video: of several with a lang the English one, else the Spanish one, else the first by place."""
    if "lang" not in transcripts.columns:
        return transcripts
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "es", 1).otherwise(2)
    said = ["title", "channel", "cues"]
    best = F.min_by(F.struct(*said), F.struct(rank, F.col("place") if "place" in transcripts.columns else F.col("lang")))
    return transcripts.groupBy("video_id").agg(best.alias("best")).select("video_id", "best.*")


def delegated(pages: DataFrame, newsletters: DataFrame) -> DataFrame:
    """pages with the address and html that newsletters (post_id, url, html: one row for each id) know for posts opened from an inbox; others stay."""
    here = pages.withColumn("post", urls.inbox_post(F.coalesce("url", F.lit(""))))
    known = newsletters.select(F.col("post_id").cast("string").alias("of"), F.col("url").alias("own_url"), F.col("html").alias("own_html"))
    met = here.join(known, F.col("post") == F.col("of"), "left")
    return met.withColumn("url", F.coalesce("own_url", "url")).withColumn("html", F.coalesce("own_html", "html")).select(pages.columns)


def video_pages(pages: DataFrame, transcripts: DataFrame, created_at: str) -> DataFrame:
    """pages (page_id, url) of videos; transcripts (video_id, title, channel, cues). Without cues a page fails."""
    wanted = pages.select("page_id", "url", urls.video_id(F.col("url")).alias("video_id")).join(preferred_transcripts(transcripts), "video_id", "left")

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page_id, url, title, channel, cues in zip(frame["page_id"], frame["url"], frame["title"], frame["channel"], frame["cues"], strict=True):
                none = cues is None or not len(cues)
                out.append((page_id, url, "youtube", title, None, True) if none else page(page_id, url, "youtube", title or "", transcript(list(cues)), {"author": channel}, created_at))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PAGE.split(", ")])

    return wanted.select("page_id", "url", "title", "channel", "cues").mapInPandas(render, PAGE)


def ingest(pages: DataFrame, posts: DataFrame, transcripts: DataFrame, created_at: str, oembeds: DataFrame | None = None, newsletters: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> PAGE, each by its source; newsletters are articles with a type of their own, and articles show the tweets they embed, as far as posts have them."""
    pages = pages.select("page_id", "url", "html")
    pages = pages if newsletters is None else delegated(pages, newsletters)
    kind = pages.withColumn("kind", urls.source_type(F.coalesce("url", F.lit(""))))
    articles = article_pages(kind.where("kind in ('article', 'substack')").drop("kind"), created_at, posts).select("page_id", "url", "source_type", "title", "markdown", "failed")
    return articles.unionByName(tweet_pages(kind.where("kind = 'x'"), posts, created_at, oembeds)).unionByName(video_pages(kind.where("kind = 'youtube'"), transcripts, created_at))
