"""What urls say: sources, deep links, tweets, images, and what may be fetched."""

from __future__ import annotations

import ipaddress
from urllib.parse import parse_qs, unquote, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.functions.identity import ascii_lower

SCHEME = "vault"
# Hosts by source, extensions by content type, and where urls have the ids of tweets and videos.
YOUTUBE = ("youtube.com", "www.youtube.com", "youtu.be", "m.youtube.com")
X = ("twitter.com", "www.twitter.com", "mobile.twitter.com", "x.com", "www.x.com", "mobile.x.com")
SUBSTACK = ("substack.com", "www.substack.com")
IMAGE_EXT = {
    "image/jpeg": ".jpg",
    "image/jpg": ".jpg",
    "image/png": ".png",
    "image/gif": ".gif",
    "image/webp": ".webp",
    "image/svg+xml": ".svg",
    "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/x-icon": ".ico",
    "image/vnd.microsoft.icon": ".ico",
    "image/avif": ".avif",
}
TWEET_ID = r"(?:twitter\.com|x\.com)/(?:[^/?#]+/status(?:es)?|i/web/status)/(\d+)"
VIDEO_IDS = (r"youtube\.com/watch\?(?:.*&)?v=([^&]+)", r"youtu\.be/([^?/]+)", r"youtube\.com/embed/([^?/]+)")


def authority(url: Column) -> Column:
    """Between // and the next / ? or #, user and port included; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


def source_type(url: Column) -> Column:
    host = F.lower(authority(url))
    return F.when(host.isin(*YOUTUBE), F.lit("youtube")).when(host.isin(*X), F.lit("x")).when(host.isin(*SUBSTACK) | host.endswith(".substack.com"), F.lit("substack")).otherwise(F.lit("article"))


def deep_link(entry_id: Column) -> Column:
    return F.concat(F.lit(f"{SCHEME}://open?id="), entry_id)


def parse_deep_link(url: Column) -> Column:
    """The positive id of a deep link, or null. The first id counts; spaces around it, a plus sign and single underscores between digits are allowed."""
    query = F.regexp_extract(url, rf"^(?i:{SCHEME})://open(?:/[^?#]*)?\?([^#]*)", 1)
    first = F.url_decode(F.regexp_extract(query, r"(?:^|&)id=([^&]+)", 1))
    digits = F.regexp_extract(first, r"^(?U:\s*)\+?(\d+(?:_\d+)*)(?U:\s*)$", 1)
    found = F.replace(digits, F.lit("_"), F.lit("")).try_cast("long")
    return F.when(found > 0, found)


def tweet_id(url: Column) -> Column:
    found = F.regexp_extract(url, f"(?i){TWEET_ID}", 1)
    return F.when(found != "", found)


def video_id(url: Column) -> Column:
    every = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in VIDEO_IDS]
    return F.coalesce(*every)


def inbox_post(url: Column) -> Column:
    """The number of a post opened from a newsletter inbox, whose own address is not known from the url."""
    return F.nullif(F.regexp_extract(url, r"^https?://(?:www\.)?substack\.com/inbox/post/(\d+)", 1), F.lit(""))


def image_ext(content_type: Column, url: Column) -> Column:
    """The extension of an image: by its content type, else by a known one in the url's path, else .bin."""
    table = F.create_map(*[F.lit(x) for kv in IMAGE_EXT.items() for x in kv])
    by_type = table[F.lower(F.trim(F.substring_index(content_type, ";", 1)))]
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.coalesce(by_type, F.when(suffix.isin(*sorted(set(IMAGE_EXT.values()))), suffix), F.lit(".bin"))


def original_name(url: Column) -> Column:
    """The file name of a url's path, or image."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    name = F.regexp_extract(path, r"([^/]+)/*$", 1)
    return F.when(name == "", F.lit("image")).otherwise(name)


def unwrap_proxied(url: str) -> str:
    """The image behind an image proxy's url=... parameter."""
    parts = urlparse(url)
    if parts.path.endswith("/_next/image"):
        inner = parse_qs(parts.query).get("url", [""])[0]
        return unquote(inner) or url
    return url


def blocked_address(text: str) -> bool:
    """Addresses that are not of the public network, also when they are wrapped in IPv6."""
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return True
    if a.version == 6:
        for wrapped in ("::ffff:0:0/96", "64:ff9b::/96", "::/96"):
            if a in ipaddress.ip_network(wrapped):
                a = ipaddress.ip_address(int(a) & 0xFFFFFFFF)
                break
    return not a.is_global or a.is_multicast


def fetchable(url: str | None) -> bool:
    """May a url be fetched: http or https, a host, and neither localhost nor an address outside the public network. Names are not resolved here."""
    try:
        parts = urlparse(url or "")
        host = parts.hostname or ""
        parts.port  # noqa: B018  a bad port raises
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost":
        return False
    try:
        ipaddress.ip_address(host)
    except ValueError:
        return True
    return not blocked_address(host)


@F.pandas_udf(BooleanType())
def _fetchable(urls: pd.Series) -> pd.Series:
    return urls.map(fetchable).astype(bool)


def fetchable_url(url: Column) -> Column:
    """Hosts that are plain names are judged in the JVM; the rest (addresses, odd ports) by the full rules."""
    host = ascii_lower(F.regexp_extract(url, r"^https?://([A-Za-z0-9.-]*[A-Za-z][A-Za-z0-9.-]*)(?:[/?#]|$)", 1))
    plain = host.rlike(r"^(?:[a-z0-9-]+\.)+[a-z]{2,}$")
    return F.when(F.coalesce(plain, F.lit(False)), F.lit(True)).otherwise(_fetchable(F.when(~F.coalesce(plain, F.lit(False)), url)))
