"""Pictures of pages: finding them, naming them by content, and letting texts point to the local copies."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from lodestone.functions import urls
from lodestone.functions.dom import Node, parse
from lodestone.sources.sink import write_files

IMAGE = re.compile(r'!\[([^\]]*)\]\(((?:https?:)?//[^\s)]+)(?:\s+"[^"]*")?\)')
# Fixed value: the picture that stands for one that could not be had, and so its name.
PLACEHOLDER = b'<svg xmlns="http://www.w3.org/2000/svg" width="320" height="180"><rect width="100%" height="100%" fill="#ddd"/></svg>'


def normalize_images(root: Node) -> None:
    """graphic elements are pictures; lazily loaded ones take their real address; proxied ones the address behind the proxy."""
    for n in root.all("graphic"):
        n.tag, n.attrs = "img", {"src": n.attrs.get("src", ""), "alt": n.attrs.get("alt", "")}
    for n in root.all("img"):
        src = n.attrs.get("src", "")
        if (not src or src.startswith("data:")) and n.attrs.get("data-src"):
            src = n.attrs["data-src"]
        if src:
            n.attrs["src"] = urls.unwrap_proxied(src)


def image_urls(root: Node, base: str = "") -> list[str]:
    """Addresses of a page's pictures, each once, in order; inline data is none."""
    found = [n.attrs.get("src", "") for n in root.all("img")]
    return list(dict.fromkeys(urljoin(base, u) if base else u for u in found if u and not u.startswith("data:")))


FOUND = StructType().add("url", StringType()).add("name", StringType())


@F.pandas_udf(ArrayType(FOUND))
def _page_images(html: pd.Series, base: pd.Series) -> pd.Series:
    def one(h: str | None, b: str | None) -> list[dict]:
        root = parse(h or "")
        normalize_images(root)
        return [{"url": u, "name": u.split("?")[0].rsplit("/", 1)[-1] or "image"} for u in image_urls(root, b or "")]

    return pd.Series([one(h, b) for h, b in zip(html, base, strict=True)])


def page_images(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> (page_id, ordinal, url, name). Pages without a picture do not leave the JVM."""
    may = F.lower("html").rlike("<(img|graphic)")
    return pages.where(may).select("page_id", F.posexplode(_page_images("html", "url")).alias("ordinal", "i")).select("page_id", "ordinal", "i.*")


def asset_name(content: Column, content_type: Column, url: Column) -> Column:
    """The name of a picture: the beginning of its digest, and its extension."""
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), urls.image_ext(content_type, url))


def named_assets(fetched: DataFrame) -> DataFrame:
    """fetched (url, content_type, content) -> (url, name, content): what is not a picture, or could not be had, is the placeholder."""
    ok = F.col("content").isNotNull() & F.coalesce(F.col("content_type").startswith("image/"), F.lit(False))
    content = F.when(ok, F.col("content")).otherwise(F.lit(PLACEHOLDER))
    kind = F.when(ok, F.col("content_type")).otherwise(F.lit("image/svg+xml"))
    return fetched.select("url", content.alias("content"), kind.alias("kind")).select("url", asset_name(F.col("content"), F.col("kind"), F.col("url")).alias("name"), "content")


def point_to_assets(root: Node, names: dict[str, str], slug: str, base: str = "") -> None:
    """Let a page's pictures show the local copies; one without a description gets its file's name."""
    for n in root.all("img"):
        src = n.attrs.get("src", "")
        name = names.get(urljoin(base, src) if base else src)
        if name:
            n.attrs["src"] = f"../assets/{slug}/{name}"
            if not n.attrs.get("alt"):
                n.attrs["alt"] = src.split("?")[0].rsplit("/", 1)[-1] or "image"


def localized(markdown: str, names: dict[str, str], slug: str) -> tuple[str, int]:
    """Markdown whose remote pictures point to local copies, and how many did."""
    n = 0

    def local(m: re.Match) -> str:
        nonlocal n
        if m[2] not in names:
            return m[0]
        n += 1
        return f"![{m[1]}](../assets/{slug}/{names[m[2]]})"

    return IMAGE.sub(local, markdown), n


LOCAL = "entry_id long, markdown string, changed int, placeholders int"


def localize_images(markdown: DataFrame, assets: DataFrame) -> DataFrame:
    """markdown (entry_id, slug, markdown), assets (url, name) -> LOCAL for texts with remote pictures. Only the (few) urls of a text travel with it."""
    from lodestone.operators.pages import remote_images

    lost = F.concat(F.substring(F.sha2(F.lit(PLACEHOLDER), 256), 1, 16), F.lit(".svg"))
    met = remote_images(markdown).join(assets.select("url", "name"), "url")
    names = met.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("url", "name"))).alias("names"), F.count_if(F.col("name") == lost).alias("lost"))

    def rewrite(batches):
        for frame in batches:
            out = [localized(m, dict(k), s) for m, k, s in zip(frame["markdown"], frame["names"], frame["slug"], strict=True)]
            yield pd.DataFrame({"entry_id": frame["entry_id"], "markdown": [o[0] for o in out], "changed": [o[1] for o in out], "placeholders": frame["lost"]})

    return markdown.join(names, "entry_id").select("entry_id", "slug", "markdown", "names", "lost").mapInPandas(rewrite, LOCAL)


def write_assets(assets: DataFrame, folder: str) -> int:
    """Write (slug, name, content) as assets/SLUG/NAME, each once, all or none. Names are made of contents, so writing again changes nothing."""
    once = assets.dropDuplicates(["slug", "name"]).select(F.concat_ws("/", F.lit("assets"), "slug", "name").alias("path"), "content")
    write_files(once, folder)
    return once.count()
