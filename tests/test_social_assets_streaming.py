import time

from lodestone.functions import social
from lodestone.functions.dom import parse
from lodestone.operators import assets
from lodestone.schemas import ENTRIES
from lodestone.streaming import reconcile

TWEET = {
    "id_str": "7",
    "text": "😀 hi #tag\nsee https://t.co/a & more https://t.co/pic",
    "display_text_range": [0, 36],
    "entities": {"urls": [{"indices": [14, 28], "expanded_url": "https://e.x/?a=1&b", "display_url": "e.x"}], "hashtags": [{"indices": [5, 9], "text": "tag"}]},
    "user": {"name": "A <B>", "screen_name": "ab"},
    "photos": [{"url": "https://p/1.jpg"}],
    "mediaDetails": [{"type": "video"}],
    "quoted_tweet": {"text": "inner", "user": {"name": "Q"}},
}


def test_tweet():
    assert social.shown_text(TWEET) == "😀 hi #tag\nsee https://t.co/a & more"
    html = social.render_tweet(TWEET)
    assert html.startswith('<p><strong><a href="https://x.com/ab">A &lt;B&gt; (@ab)</a></strong><br>😀 hi <a href="https://x.com/hashtag/tag">#tag</a><br>see <a href="https://e.x/?a=1&amp;b">e.x</a> &amp; more</p>')
    assert '<img src="https://p/1.jpg" alt="">' in html and "https://x.com/ab/status/7" in html and html.endswith("<blockquote><p><strong>Q</strong><br>inner</p></blockquote>")
    assert social.render_thread([TWEET, TWEET], False).startswith(social.INCOMPLETE) and "<hr>" in social.render_thread([TWEET, TWEET], True)
    assert social.title("a " * 60, "x").endswith("…") and social.title(" \n", "x") == "x"
    token = social.token("1234567890123456789")
    assert token and set(token) <= set("123456789abcdefghijklmnopqrstuvwxyz")
    assert social.render_oembed("<blockquote><p>a<b>b</b></p></blockquote>").endswith("<p>ab</p>")


def test_embeds():
    page = '<div><blockquote class="twitter-tweet"><p>said</p><a href="https://twitter.com/a/status/7">day</a></blockquote><iframe src="https://platform.twitter.com/embed/Tweet.html?id=9"></iframe><blockquote>plain</blockquote></div>'
    root = parse(page)
    social.resolve_embeds(root, lambda i: TWEET if i == "7" else None)
    html = root.html()
    assert "A &lt;B&gt;" in html and 'href="https://x.com/i/web/status/9"' in html and "<blockquote>plain</blockquote>" in html
    root = parse(page)
    social.resolve_embeds(root, lambda i: None)
    assert "<p>saidday</p>" in root.html() and 'href="https://twitter.com/a/status/7"' in root.html()


def test_assets(spark):
    root = parse("<graphic src='a.png' alt='x'></graphic><img src='data:x' data-src='/b.jpg'><img src='/_next/image?url=https%3A%2F%2Fc%2Fd.webp'><img src='data:y'>")
    assets.normalize_images(root)
    found = assets.image_urls(root, "https://h/p/")
    assert found == ["https://h/p/a.png", "https://h/b.jpg", "https://c/d.webp"]
    assets.point_to_assets(root, {"https://h/b.jpg": "1.jpg"}, "s", "https://h/p/")
    assert '<img src="../assets/s/1.jpg" data-src="/b.jpg" alt="b.jpg">' in root.html()
    pages = spark.createDataFrame([(1, "https://h/", "<p><img src='x.png'><IMG src='x.png'>"), (2, "u", "none"), (3, None, None)], "page_id long, url string, html string")
    assert [tuple(r) for r in assets.page_images(pages).collect()] == [(1, 0, "https://h/x.png", "x.png")]
    fetched = spark.createDataFrame([("u1", "image/png", b"abc"), ("u2", "text/html", b"abc"), ("u3", None, None)], "url string, content_type string, content binary")
    names = {r.url: r.name for r in assets.named_assets(fetched).collect()}
    assert names["u1"] == "ba7816bf8f01cfea.png" and names["u2"] == names["u3"] and names["u2"].endswith(".svg")
    text = spark.createDataFrame([(1, "s", "![a](https://h/1.png) ![b](//h/2.png \"t\") ![c](local.png)"), (2, "t", "none")], "entry_id long, slug string, markdown string")
    local = assets.localize_images(text, spark.createDataFrame([("https://h/1.png", "1.png"), ("//h/2.png", names["u2"])], "url string, name string")).collect()
    assert [tuple(r) for r in local] == [(1, f"![a](../assets/s/1.png) ![b](../assets/s/{names['u2']}) ![c](local.png)", 2, 1)]


def test_reconcile(spark, tmp_path):
    pages, told = tmp_path / "pages", []
    pages.mkdir()
    (pages / "1.md").write_text("#a [[b]]")
    (pages / "2.md").write_text("#c")
    entries = spark.createDataFrame([(i, "t", "u", f"file:{pages}/{i}.md", "article", None, None, "unread", [], [], None, None) for i in (1, 2)], ENTRIES)

    def run():
        reconcile.scan(spark, str(pages), str(tmp_path / "log"))
        q = reconcile.follow(reconcile.changed_files(spark, str(tmp_path / "log")), entries, str(tmp_path / "refs"), str(tmp_path / "check"), lambda *x: told.append(x))
        q.awaitTermination(120)
        return sorted((r.source_id, r.target_text) for r in reconcile.current_refs(spark, str(tmp_path / "refs")).collect())

    assert run() == [(1, "a"), (1, "b"), (2, "c")]
    time.sleep(1.1)
    (pages / "1.md").write_text("nothing")
    assert run() == [(2, "c")]
    assert told == [(0, 2), (1, 1)] and reconcile.scan(spark, str(pages), str(tmp_path / "log")) == 0
