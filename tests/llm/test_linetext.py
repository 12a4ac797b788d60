from jobgrain.llm import linetext

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for everyone.</div>
<article><h1>Of  tea &amp; bread</h1><p>First <b>line<br>goes</b> on.<p>Second&nbsp;one &lt;b&gt; &#233;.
<div class="ad">Buy now, buy here, buy all of it today.</div><ul><li>one<li>two</ul>
<form><p>Your mail: <input name=m></form><blockquote>A last word.</blockquote>
<section id="comments"><p>I read this and I did not like it.</p></section></article>
<aside><p>See also what others have read about this.</p></aside><footer>&copy; nobody</footer></body></html>"""


def test_article_alone():
    assert linetext.main_text(PAGE) == "Of tea & bread\nFirst line goes on.\nSecond one <b> é.\none\ntwo\nA last word."


def test_unmarked_page():
    body = "<div class=menu><a href=/>Home</a></div>" + "<ul>" + "<li><a href=/x>Link</a>" * 9 + "</ul>" + "<div><p>" + "Words of a story that goes on for a while. " * 3 + "</p><p>End.</p></div>" + "<p><a href=/y>More</a></p>" * 6
    assert linetext.main_text(f"<html><body>{body}</body></html>") == ("Words of a story that goes on for a while. " * 3).strip() + "\nEnd."


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain"), (None, "u", PAGE), (4, "u", "<article><p>x < y & z</article"), (4, "u", "<article>" + "<p>long text</p>" * 20000 + "</article>"), (5, "u", "<nav><a href=/>Home</a></nav><!-- <p>no")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, text string, id int")
    got = [(r.page_id, r.text, r.n_chars) for r in linetext.extract_text(df).collect()]
    assert len(got) == len(rows) and all(len(t) == n for _, t, n in got)
    assert [t for i, t, _ in got if i in (1, 2, 5)] == ["", "", ""]
    assert max(n for i, _, n in got if i == 4) == 20000 * 10 - 1
    assert linetext.extract_text(df.where("page_id < 0")).count() == 0


def test_names_that_only_describe():
    html = '<div class="page has-sidebar comments-enabled"><h2 class="section-header">Head</h2><p>' + "A long line of text that stays. " * 4 + '</p><div class="sidebar-right">Out out out out out out out out out out</div></div>'
    assert linetext.main_text(html) == "Head\n" + ("A long line of text that stays. " * 4).strip()
