from lodestone.functions import clean
from lodestone.functions.dom import parse
from lodestone.functions.markdown import html_to_markdown
from lodestone.operators import articles as A

LONG = "This is a sentence, with commas, that goes on for long enough to count as content. " * 4


def after(step, html):
    root = parse(html)
    step(root)
    return root.html()


def test_tree():
    assert parse("<p>a<p>b<b>c</p>d<br>e &amp; f").html() == "<p>a</p><p>b<b>c</b></p>d<br>e &amp; f"
    assert parse("<ul><li>a<li>b<ul><li>c</ul></ul>").html() == "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"
    assert parse("<table><tr><td>a<td>b<tr><td>c</table>").html() == "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>"
    assert parse("<script>if (a < b) '</p>'</script>x").text() == "x"
    assert parse("</div>x<nosuch").text().startswith("x")


def test_a_reference_that_is_cut_off_is_text():
    """As in the SQL of extract_article and article_body: only whole references are read."""
    page = parse("<title>a &amp;&amp</title><p title='b &amp c' class='d &amp; e'>&lt;&lt b &#x27;&#x27 &am c &quot</p><a href='?a=1&copy=2&b=&amp;lt'>&amp;lt</a><script>a &amp &amp; b</script>")
    assert page.first("title").text() == "a &&amp" and page.first("p").text() == "<&lt b '&#x27 &am c &quot"
    assert page.first("p").attrs == {"title": "b & c", "class": "d & e"} and page.first("a").attrs["href"] == "?a=1&copy=2&b=&lt" and page.first("a").text() == "&lt"
    assert page.first("script").children == ["a &amp &amp; b"]
    assert parse("a &lt; b &").text() == "a < b &" and parse("\ufdd0 &amp").text() == "\ufdd0 &amp"


def test_steps():
    assert after(clean.drop_hidden, '<p class="a hidden">x</p><p class="unhidden">y</p>') == '<p class="unhidden">y</p>'
    assert after(clean.simplify_figures, "<div><figure><a><span><img src='x'></span></a><figcaption>c</figcaption></figure></div>") == '<figure><img src="x"><figcaption>c</figcaption></figure>'
    assert after(clean.unwrap_sections, "<section><p>a</p></section>") == "<p>a</p>"
    assert after(clean.plain_headings, '<h2 id="a" class="b">T<a href="#a">#</a></h2>') == "<h2>T</h2>"
    assert after(clean.rescue_linked_lists, "<ul><li><a>one link</a></li><li>x</li></ul>") == "<p><a>one link</a></p><p>x</p>"
    assert after(clean.rescue_linked_lists, "<nav><ul><li><a>one</a></li></ul></nav>") == "<nav><ul><li><a>one</a></li></ul></nav>"
    assert after(clean.rescue_linked_tables, "<figure><table><tr><th>H</th></tr><tr><td><a>spec</a></td><td>s</td></tr></table></figure>") == "<p><a>spec</a> · s</p>"
    assert after(clean.rescue_linked_tables, '<table class="content"><tr><td><a>x</a></td></tr></table>').startswith("<table")
    assert after(clean.fill_spans, '<table><tr><td rowspan="2">a</td><td colspan="2">b</td></tr><tr><td>c</td><td>d</td></tr></table>') == "<table><tr><td>a</td><td>b</td><td>b</td></tr><tr><td>a</td><td>c</td><td>d</td></tr></table>"
    claimed = '<table><tr><td rowspan="99999999">a</td><td>b</td></tr><tr><td colspan="99999999">c</td></tr></table>'
    assert after(clean.fill_spans, claimed) == "<table><tr><td>a</td><td>b</td></tr><tr><td>a</td><td>c</td></tr></table>"
    assert after(clean.inline_short_lists, "<ul><li>Label:<ul><li>a</li><li>b</li></ul></li></ul>") == "<ul><li>Label: a, b</li></ul>"
    assert after(clean.unwrap_item_paragraphs, "<ul><li><p>a</p></li></ul>") == "<ul><li>a</li></ul>"
    assert after(clean.keep_syntax_notes, "<pre>x</pre><footer>note</footer>") == "<pre>x</pre><p>note</p>"
    assert after(clean.drop_placeholders, "<div><p>Loading the list…</p><p>Loading this is a sentence.</p></div>") == "<div><p>Loading this is a sentence.</p></div>"


def test_markdown():
    assert html_to_markdown("<h2>T</h2><p>a <b>b</b> <a href='u'>c</a></p>") == "## T\n\na **b** [c](u)\n"
    assert html_to_markdown("<ul><li>a</li><li>b<ol><li>c</li></ol></li></ul>") == "- a\n- b\n  1. c\n"
    assert html_to_markdown("<pre><code class='language-Py'>x = 1\n</code></pre>") == "```py\nx = 1\n```\n"
    assert html_to_markdown("<p>python</p><pre>x</pre>") == "```python\nx\n```\n"
    assert html_to_markdown("<p>use <pre>x y</pre> here</p>").startswith("use")
    assert html_to_markdown("<table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table>") == "| a | b |\n| --- | --- |\n| 1\\|2 |  |\n"
    assert html_to_markdown("<blockquote><p>a</p><p>b</p></blockquote>") == "> a\n>\n> b\n"


def test_extract():
    page = f"<html><head><title>Doc</title><meta property='og:title' content='The Title'><meta name='author' content='Me'></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><header><h1>The Title</h1><p>{'A line under the title.' * 2}</p></header><article><p>{LONG}</p><p>{LONG}</p></article><footer>bye</footer></body></html>"
    found = A.extract(page, "u")
    text = found.body.text()
    assert found.title == "The Title" and found.said["author"] == "Me" and "bye" not in text and "Home" not in text
    assert LONG.strip() in text and text.startswith("A line under")
    assert found.said["low_confidence"] is True  # under 200 words
    assert A.extract("<p>too short</p>", "u") is None
    assert A.frontmatter(found, "2024").startswith("---\ntitle: The Title\nurl: u\n")


def test_hydration():
    state = '{"props": {"pageProps": {"body": "' + LONG * 4 + '"}}}'
    page = f"<body><div>Loading...</div><script id='__NEXT_DATA__' type='application/json'>{state}</script></body>"
    assert LONG.strip()[:60] in A.extract(page, "u").body.text()


def test_pages(spark):
    rows = [(1, "https://x.com/a/status/5", f"<article><p>{LONG}</p></article>"), (2, None, None), (3, "u", "<" * 50), (4, "u", "<div>" * 5000)]
    got = {r.page_id: r for r in A.article_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "2024").collect()}
    assert not got[1].failed and got[1].source_type == "x" and got[2].failed and got[3].failed and got[4].failed


def test_every_real_cell_stays():
    row = "".join(f"<td>{i}</td>" for i in range(1200))
    out = after(clean.fill_spans, f"<table><tr>{row}</tr><tr>{row}</tr></table>")
    assert out.count("<td>") == 2400
    claimed = after(clean.fill_spans, "<table><tr><td colspan=999999>a</td><td>b</td></tr><tr><td>c</td></tr></table>")
    assert claimed.count("<td>") <= 1003 and "b</td>" in claimed
