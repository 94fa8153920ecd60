"""From a raw page to an article and its Markdown. One tree for each page, built once; whole pages go through Arrow batches and are never shuffled."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import clean, markdown, social, urls
from lodestone.functions.dom import Node, link_share, parse, words

# When a page is too thin.
LEAST_CHARS, LEAST_WORDS, SCRIPT_SHARE = 100, 200, 0.4
SAME_TITLE, LEAST_DEK, HERO_DEPTH = 0.7, 20, 8
LEAST_STRING, HYDRATION_DEPTH = 50, 6
CONTENT = ("article", "main", "section", "div", "body", "td", "blockquote")


@dataclass
class Article:
    title: str
    body: Node
    url: str
    source_type: str = "article"
    said: dict[str, str | bool] = field(default_factory=dict)


def meta(root: Node, *names: str) -> str | None:
    found = {m.attrs.get("property") or m.attrs.get("name"): m.attrs.get("content", "").strip() for m in reversed(root.all("meta"))}
    return next((found[n] for n in names if found.get(n)), None)


def score(root: Node) -> dict[int, tuple[float, Node]]:
    """Paragraphs give points for length and commas to what they stand in, half to the next above; links and names count against and for."""
    points: dict[int, tuple[float, Node]] = {}
    for p in root.all("p", "pre", "blockquote", "li", "td"):
        said = p.text().strip()
        if len(said) < clean.SHORT or p.inside("nav", "footer", "aside", "form"):
            continue
        worth = 1 + said.count(",") + min(len(said) / 100, 3)
        for n, share in zip((x for x in p.above() if x.tag in CONTENT), (1.0, 0.5, 0.25), strict=False):
            before = points[id(n)][0] if id(n) in points else float(clean.weight(n)) + (5 if n.tag in ("article", "main") else 0)
            points[id(n)] = before + worth * share, n
    return {k: (v * (1 - link_share(n)), n) for k, (v, n) in points.items()}


def find_content(root: Node) -> Node:
    """The element with most points, with those beside it that have a fifth of them or are long paragraphs; without any points, what the page itself calls its article or main part."""
    points = score(root)
    if not points:
        return next((n for tag in ("article", "main", "body") if (n := root.first(tag)) is not None), root)
    best, top = max(points.values(), key=lambda x: x[0])
    if top.parent is None or not top.parent.tag or top.tag == "body":
        return top
    out = Node("div")
    for n in list(top.parent.elements()):
        value = points.get(id(n), (0.0, n))[0]
        long = n.tag == "p" and len(n.text()) > 80 and link_share(n) < 0.25
        if n is top or value >= max(10, best / 5) or long or (n.tag in clean.HEADINGS and n.neighbour(1) is top):
            out.append(n.copy())
    return out


def hydrated(root: Node) -> str | None:
    """Texts of a page's embedded state, if they make up an article: for pages whose text only a browser would show."""
    script = next((s for s in root.all("script") if s.attrs.get("id") == "__NEXT_DATA__"), None)
    try:
        state = json.loads("".join(c for c in script.children if isinstance(c, str)))["props"]["pageProps"] if script else None
    except (ValueError, KeyError, TypeError):
        return None
    found: list[str] = []

    def collect(x, depth: int) -> None:
        if isinstance(x, str):
            found.extend([x] if len(x) > LEAST_STRING else [])
        elif depth < HYDRATION_DEPTH and isinstance(x, (dict, list)):
            for y in x.values() if isinstance(x, dict) else x:
                collect(y, depth + 1)

    collect(state, 0)
    return "".join(f"<p>{s}</p>" for s in found) if sum(map(words, found)) >= LEAST_WORDS else None


def alike(a: str, b: str) -> bool:
    a, b = (" ".join(x.casefold().split()) for x in (a, b))
    return bool(a and b) and (a == b or SequenceMatcher(None, a, b).ratio() >= SAME_TITLE)


def add_header(root: Node, body: Node, title: str) -> None:
    """The line under the title and the large picture over the text, where the content has lost them."""
    h1 = next((h for h in root.all("h1") if alike(h.text(), title)), None)
    if h1 is None:
        return
    have, pictures = " ".join(body.text().split()), {i.attrs.get("src") for i in body.all("img")}
    dek = h1.neighbour(1)
    front: list[Node] = []
    if dek is not None and dek.tag in ("p", "h2") and len(dek.text().strip()) >= LEAST_DEK and " ".join(dek.text().split()) not in have:
        front.append(Node("p", children=[c if isinstance(c, str) else c.copy() for c in dek.children]))
    for _, above in zip(range(HERO_DEPTH), h1.above(), strict=False):
        image = above.first("img")
        if image is not None:
            if image.attrs.get("src") not in pictures and not image.inside("nav"):
                front.append(Node("p", children=[image.copy()]))
            break
    for n in reversed(front):
        n.parent = body
        body.children.insert(0, n)


def low_confidence(root: Node, text: str) -> bool:
    tags = [n.tag for n in root.walk()]
    return words(text) < LEAST_WORDS or tags.count("script") / max(1, len(tags)) > SCRIPT_SHARE


def extract(html: str, url: str, tweets: dict[str, str] | None = None) -> Article | None:
    """The article of a page, or None if there is too little of one. With tweets (id -> JSON) embedded ones are put in their places."""
    root = parse(html)
    if tweets is not None:
        social.resolve_embeds(root, lambda i: json.loads(tweets[i]) if i in tweets else None)
    title = meta(root, "og:title", "twitter:title") or (root.first("title").text().strip() if root.first("title") else "")
    said = {"author": meta(root, "author", "article:author"), "description": meta(root, "description", "og:description"), "published": meta(root, "article:published_time", "date")}
    raw = root.copy()
    body = find_content(clean.clean(root))
    clean.drop_placeholders(body)
    if words(body) < LEAST_WORDS and (other := hydrated(raw)) is not None:
        body = parse(other)
    if len(body.text().strip()) < LEAST_CHARS:
        return None
    add_header(raw, body, title)
    found = {k: v for k, v in said.items() if v}
    return Article(title, body, url, "article", {**found, "low_confidence": low_confidence(raw, body.text())})


def frontmatter(article: Article, created_at: str) -> str:
    """The head of a page's Markdown; what is not known is left out, but not low_confidence."""
    head = {"title": article.title, "url": article.url, "source_type": article.source_type, "created_at": created_at, "tags": [], "status": "unread"}
    head |= {k: article.said[k] for k in ("author", "description", "published", "low_confidence") if k in article.said and (article.said[k] or k == "low_confidence")}
    return f"---\n{yaml.dump(head, allow_unicode=True, sort_keys=False)}---\n"


OUT = "page_id long, url string, source_type string, title string, low_confidence boolean, words long, markdown string, failed boolean"


def embedded_tweets(pages: DataFrame, tweets: DataFrame) -> DataFrame:
    """pages with `embeds`, the JSON by id of the tweets (id, json) that a page names; null for pages without embeds, which are not shuffled."""
    may = F.coalesce(F.col("html").contains("twitter-tweet") | F.col("html").contains("Tweet.html"), F.lit(False))
    some = pages.where(may)
    named = F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit(r"/status(?:es)?/(\d+)"), 1), F.regexp_extract_all("html", F.lit(r"[?&;]id=(\d+)"), 1)))
    met = some.select("page_id", F.explode(named).alias("id")).distinct().join(tweets.select("id", "json"), "id")
    found = met.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("id", "json")))).alias("embeds"))
    none = F.create_map().cast("map<string,string>")
    filled = some.join(found.withColumnRenamed("page_id", "of"), F.col("page_id") == F.col("of"), "left").withColumn("embeds", F.coalesce("embeds", none)).drop("of")
    return pages.where(~may).withColumn("embeds", F.lit(None).cast("map<string,string>")).unionByName(filled)


def article_pages(pages: DataFrame, created_at: str, tweets: DataFrame | None = None) -> DataFrame:
    """pages (page_id, url, html) -> one row for each: its article as Markdown with frontmatter; failed where there is none, or the page cannot be read.

    Pages are cut from their Arrow batches one at a time, so a long one needs memory for itself only. Null html has no article. With tweets (id, json: one row for each id) those that a page embeds are shown in it, or as a link if
    they are not there.
    """
    rows = pages.select("page_id", "url", "html")
    rows = rows.withColumn("embeds", F.lit(None).cast("map<string,string>")) if tweets is None else embedded_tweets(rows, tweets)
    rows = rows.select("page_id", "url", urls.source_type(F.coalesce("url", F.lit(""))).alias("source_type"), "html", "embeds")

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")]
        for batch in batches:
            out = []
            for page_id, url, kind, html, embeds in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = extract(html or "", url or "", None if embeds is None else dict(embeds))
                except RecursionError:  # nested beyond what a tree can hold
                    found = None
                if found is None:
                    out.append((page_id, url, kind, None, None, 0, None, True))
                    continue
                found.source_type = kind
                body = markdown.to_markdown(found.body)
                out.append((page_id, url, kind, found.title, bool(found.said["low_confidence"]), words(found.body), f"{frontmatter(found, created_at)}\n{body}", False))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.bool_())
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(convert, OUT)


def page_sources(pages: DataFrame) -> DataFrame:
    """(page_id, source_type, video_id, tweet_id): where a page comes from, by its url alone."""
    u = F.coalesce("url", F.lit(""))
    return pages.select("page_id", urls.source_type(u).alias("source_type"), urls.video_id(u).alias("video_id"), urls.tweet_id(u).alias("tweet_id"))


def transcript(cues: list[str]) -> str:
    """A paragraph for each cue of a video's transcript."""
    return "".join(f"<p>{c}</p>" for c in cues)


def next_image(url: str) -> str:
    return re.sub(r"^//", "https://", urls.unwrap_proxied(url))
