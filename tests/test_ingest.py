import json

from lodestone.operators import ingest

LONG = "This is a sentence, with commas, that goes on for long enough to count as content. " * 4


def test_by_source(spark):
    tweet = lambda i, text: json.dumps({"id_str": i, "text": text, "user": {"name": "N", "screen_name": "n"}})
    posts = spark.createDataFrame([("1", None, tweet("1", "root")), ("2", "1", tweet("2", "reply")), ("9", "8", tweet("9", "lost"))], "id string, parent_id string, json string")
    transcripts = spark.createDataFrame([("abc", "Talk", "Chan", ["hello", "there"])], "video_id string, title string, channel string, cues array<string>")
    rows = [(1, "https://x.com/n/status/2", None), (2, "https://x.com/n/status/9", None), (3, "https://x.com/n/status/7", None), (4, "https://youtu.be/abc", None), (5, "https://youtu.be/none", None), (6, "https://a.substack.com/p/x", f"<article><p>{LONG}</p></article>"), (7, None, None)]
    got = {r.page_id: r for r in ingest.ingest(spark.createDataFrame(rows, "page_id long, url string, html string"), posts, transcripts, "2024").collect()}
    assert len(got) == 7 and {i for i, r in got.items() if r.failed} == {3, 5, 7}
    assert got[1].title == "root" and got[1].markdown.index("root") < got[1].markdown.rindex("reply") and "---\n\n" in got[1].markdown
    assert "may be incomplete" in got[2].markdown and "may be incomplete" not in got[1].markdown
    assert got[4].markdown.endswith("hello\n\nthere\n") and "author: Chan" in got[4].markdown
    assert got[6].source_type == "substack" and LONG.strip() in got[6].markdown


def test_long_chains(spark):
    """Chains of up to a hundred posts are complete, longer ones are cut at their root's end."""
    posts = spark.range(300).selectExpr("cast(id as string) as id", "case when id % 150 > 0 then cast(id - 1 as string) end as parent_id", "cast(id as string) as json")
    got = {r.tail: r for r in ingest.chains(posts, spark.createDataFrame([(str(i),) for i in (0, 99, 100, 149, 151, 777)], "id string")).collect()}
    assert [int(x) for x in got["99"].chain] == list(range(100)) and got["99"].complete
    assert [int(x) for x in got["149"].chain] == list(range(50, 150)) and not got["149"].complete and not got["100"].complete
    assert got["151"].chain == ["150", "151"] and got["0"].chain == ["0"] and "777" not in got


def test_other_ways(spark):
    """A tweet known by its embed code only, tweets embedded in an article, a post opened from an inbox, and a transcript in several languages."""
    tweet = json.dumps({"id_str": "5", "text": "embedded words", "user": {"name": "N", "screen_name": "n"}})
    posts = spark.createDataFrame([("5", None, tweet)], "id string, parent_id string, json string")
    oembeds = spark.createDataFrame([("7", "<blockquote><p>said once</p></blockquote>", "Who")], "id string, html string, author string")
    letters = spark.createDataFrame([(12, "https://a.substack.com/p/own", f"<article><p>{LONG}</p></article>")], "post_id long, url string, html string")
    cues = [("abc", lang, i, "Talk", "Chan", [f"cue {lang}"]) for i, lang in enumerate(["de", "es", "en"])] + [("xyz", lang, i, "Talk", "Chan", [f"cue {lang}"]) for i, lang in enumerate(["fr", "es"])] + [("uvw", lang, i, "Talk", "Chan", [f"cue {lang}"]) for i, lang in enumerate(["fr", "de"])]
    transcripts = spark.createDataFrame(cues, "video_id string, lang string, place int, title string, channel string, cues array<string>")
    quote = '<blockquote class="twitter-tweet"><p>old text</p><a href="https://twitter.com/n/status/{0}">when</a></blockquote>'
    rows = [(1, "https://x.com/n/status/7", None), (2, "https://e.org/a", f"<article><p>{LONG}</p>{quote.format(5)}<p>{LONG}</p>{quote.format(6)}</article>"), (3, "https://substack.com/inbox/post/12", None), (4, "https://youtu.be/abc", None), (5, "https://youtu.be/xyz", None), (6, "https://youtu.be/uvw", None)]
    got = {r.page_id: r for r in ingest.ingest(spark.createDataFrame(rows, "page_id long, url string, html string"), posts, transcripts, "2024", oembeds, letters).collect()}
    assert not any(r.failed for r in got.values()) and len(got) == 6
    assert "said once" in got[1].markdown and "author: Who" in got[1].markdown
    assert "embedded words" in got[2].markdown and "View tweet on X" in got[2].markdown
    assert got[3].url == "https://a.substack.com/p/own" and got[3].source_type == "substack"
    assert [got[i].markdown.strip().rsplit(chr(10), 1)[-1] for i in (4, 5, 6)] == ["cue en", "cue es", "cue fr"]
