"""Whole pages: the given ones, whose articles are marked, against a plain reading of the mark; passages that names do not hide."""

from html.parser import HTMLParser

import pytest

from jobgrain.llm import linetext


class Article(HTMLParser):
    """Lines of text inside article, by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.lines, self.inside, self.quiet = [""], 0, 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.lines[-1] += " "
        elif tag in linetext.BLOCKS:
            self.lines.append("")
        self.inside += tag == "article"
        self.quiet += tag in linetext.HIDDEN

    def handle_endtag(self, tag):
        if tag in linetext.BLOCKS:
            self.lines.append("")
        self.inside -= tag == "article"
        self.quiet -= tag in linetext.HIDDEN

    def handle_data(self, data):
        if self.inside and not self.quiet:
            self.lines[-1] += data


def test_given_pages_give_their_articles(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()
    found = {r.page_id: r.text for r in linetext.extract_text(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(found) == len(rows) and any(found.values())
    for r in rows:
        lines = [" ".join(x.split()) for x in Article(r.html).lines]
        assert found[r.page_id] == "\n".join(x for x in lines if x)


PAGE = "<nav><a href='/'>Home</a></nav><article><h1>A title of some length</h1><p>{0}</p>{1}<p>{0}</p></article><footer>Imprint</footer>"
LONG = "A paragraph of an article that has some sentences and goes on for a while, as paragraphs do."


@pytest.mark.parametrize("own", ['<pre><span class="comment"># set x</span> x = 1</pre>', '<p id="privacy">On privacy.</p>', '<section id="notice"><p>Notice this.</p></section>', '<p class="share">A share of it.</p>', '<h2 class="header">Short</h2>', '<blockquote class="comment">Said so.</blockquote>'])
def test_names_inside_an_article_hide_none_of_its_text(own):
    text = linetext.main_text(PAGE.format(LONG, own))
    assert text.startswith("A title of some length\n" + LONG) and text.endswith(LONG) and len(text.split("\n")) == 4
    assert "Imprint" not in text and "Home" not in text


@pytest.mark.parametrize("other", ['<div class="ad">Buy this now, it is good, says everyone who was asked.</div>', '<section class="comments"><p>I read it all and did not like the second half.</p></section>', '<ul class="share-buttons"><li>Share</li></ul>', "<aside>Beside the point</aside>", '<div role="complementary">More to read</div>', "<form><p>Your mail</p></form>", "<p hidden>Not shown</p>"])
def test_boxes_inside_an_article_that_are_not_its_text(other):
    assert linetext.main_text(PAGE.format(LONG, other)) == f"A title of some length\n{LONG}\n{LONG}"
