"""Tweets as HTML: from their JSON, alone, in reply chains, quoted, or embedded in a page."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from html import escape
from string import ascii_lowercase, digits
from urllib.parse import parse_qs, urlparse

from lodestone.functions.dom import Node, parse
from lodestone.functions.urls import TWEET_ID

# Words shown to readers, and hosts of embeds.
INCOMPLETE = "<p><em>Thread may be incomplete — could not fetch earlier tweets in this chain.</em></p>"
FALLBACK = "<p><em>Fetched via oEmbed fallback — media unavailable.</em></p>"
TRUNCATED = "<p><em>Tweet truncated — X's public API doesn't expose the full text of long-form tweets.</em></p>"
VIDEO, VIEW = "View video on X", "View tweet on X"
EMBED_HOSTS = ("platform.twitter.com", "platform.x.com")
STATUS = re.compile(TWEET_ID, re.I)
FRACTION_DIGITS = 30


def token(tweet_id: str) -> str:
    """The request token of a tweet: its id in units of 1e15, times pi, in base 36 without point and zeros."""
    value = int(tweet_id) / 1e15 * math.pi
    fraction, whole = math.modf(value)
    figures, out, n = digits + ascii_lowercase, "", int(whole)
    while n:
        n, r = divmod(n, 36)
        out = figures[r] + out
    for _ in range(FRACTION_DIGITS):
        fraction, digit = math.modf(fraction * 36)
        out += figures[int(digit)]
        if fraction <= 0:
            break
    return out.replace("0", "")


def code_point(text: str, units: int) -> int:
    """The character at which so many UTF-16 units have passed."""
    passed = 0
    for i, c in enumerate(text):
        if passed >= units:
            return i
        passed += 2 if ord(c) > 0xFFFF else 1
    return len(text)


def shown_range(tweet: dict) -> tuple[int, int]:
    """Where the displayed part of a tweet's text begins and ends, in characters; the tweet has it in UTF-16 units."""
    text, units = tweet.get("text") or "", tweet.get("display_text_range")
    return (code_point(text, units[0]), code_point(text, units[1])) if units else (0, len(text))


def shown_text(tweet: dict) -> str:
    begin, end = shown_range(tweet)
    return (tweet.get("text") or "")[begin:end]


def anchor(href: str, label: str) -> str:
    return f'<a href="{escape(href)}">{escape(label)}</a>'


def tweet_text(tweet: dict) -> str:
    """The displayed text as HTML: links and hashtags as anchors, line ends as breaks."""
    begin, end = shown_range(tweet)
    text, said = tweet.get("text") or "", tweet.get("entities") or {}
    marks = []
    for u in said.get("urls") or []:
        href = u.get("expanded_url") or u.get("url") or ""
        marks.append((u.get("indices"), anchor(href, u.get("display_url") or href)))
    for h in said.get("hashtags") or []:
        marks.append((h.get("indices"), anchor(f"https://x.com/hashtag/{h.get('text') or ''}", f"#{h.get('text') or ''}")))
    out, at = [], begin
    for (s, e), html in sorted((m for m in marks if m[0] and begin <= m[0][0] and m[0][1] <= end), key=lambda m: m[0][0]):
        out += [escape(text[at:s]), html]
        at = e
    return "".join([*out, escape(text[at:end])]).replace("\n", "<br>")


def author(tweet: dict) -> str:
    user = tweet.get("user") or {}
    name, handle = user.get("name") or "", user.get("screen_name") or ""
    return f"{name} (@{handle})" if name and handle else name or handle


def permalink(tweet: dict) -> str:
    return f"https://x.com/{(tweet.get('user') or {}).get('screen_name') or 'i'}/status/{tweet.get('id_str', '')}"


def render_tweet(tweet: dict) -> str:
    """A tweet with author, text, notes, pictures and links to videos, then what it quotes."""
    who, handle = author(tweet), (tweet.get("user") or {}).get("screen_name")
    byline = f"<strong>{anchor(f'https://x.com/{handle}', who) if handle else escape(who)}</strong><br>" if who else ""
    out = [f"<p>{byline}{tweet_text(tweet)}</p>"]
    if tweet.get("note_tweet"):
        out.append(TRUNCATED)
    out += [f'<img src="{escape(p["url"])}" alt="">' for p in tweet.get("photos") or [] if p.get("url")]
    out += [f"<p>{anchor(m.get('expanded_url') or permalink(tweet), VIDEO)}</p>" for m in tweet.get("mediaDetails") or [] if m.get("type") in ("video", "animated_gif")]
    if tweet.get("quoted_tweet"):
        out.append(f"<blockquote>{render_tweet(tweet['quoted_tweet'])}</blockquote>")
    return "".join(out)


def title(text: str, fallback: str, limit: int = 80) -> str:
    one = " ".join(text.split())
    return fallback if not one else one if len(one) <= limit else one[:limit].rstrip() + "…"


def render_thread(chain: Iterable[dict], complete: bool) -> str:
    """A reply chain from its root on."""
    return ("" if complete else INCOMPLETE) + "<hr>".join(map(render_tweet, chain))


def oembed_paragraphs(html: str) -> list[str]:
    root = parse(html)
    quote = root.first("blockquote")
    found = [p.text() for p in quote.all("p")] if quote else []
    return found or [t for t in [root.text().strip()] if t]


def render_oembed(html: str) -> str:
    return FALLBACK + "".join(f"<p>{escape(p)}</p>" for p in oembed_paragraphs(html))


def tweet_id(url: str) -> str | None:
    m = STATUS.search(url)
    return m[1] if m else None


def embedded_id(node: Node) -> str | None:
    """The tweet that an iframe or a widget's blockquote stands for."""
    if node.tag == "iframe":
        parts = urlparse(node.attrs.get("src", ""))
        return next(iter(parse_qs(parts.query).get("id", [])), None) if parts.hostname in EMBED_HOSTS and "Tweet.html" in parts.path else None
    return tweet_id(node.html()) if node.tag == "blockquote" and "twitter-tweet" in node.classes else None


def resolve_embeds(root: Node, fetch: Callable[[str], dict | None]) -> None:
    """Put tweets where a page embeds them. One that cannot be had is its embed's own text with a link, or the link alone."""
    for node in root.all("iframe", "blockquote"):
        found = embedded_id(node)
        if found is None or node.parent is None:
            continue
        tweet = fetch(found)
        link = lambda href: f"<p>{anchor(href, VIEW)}</p>"
        if tweet is not None:
            html = f"<blockquote>{render_tweet(tweet)}</blockquote>"
        elif node.tag == "iframe":
            html = link(f"https://x.com/i/web/status/{found}")
        else:
            href = next((a.attrs["href"] for a in reversed(node.all("a")) if tweet_id(a.attrs.get("href", ""))), None)
            html = f"<p>{escape(' '.join(node.text().split()))}</p>" + (link(href) if href else "")
        node.swap(*parse(html).take())
