"""Pages read in one pass: the same cards and fields as a tree of the page gives, in linear time, with ids as they are."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import duckdb
import pytest
from pyspark.sql import functions as F

from jobgrain.plans import catalogue, registry  # noqa: F401  (the catalogue registers)
from jobgrain.sources import pages
from jobgrain.sources.markup import BLOCK, VOID, Page, Selectors


class Tree(HTMLParser):
    """Elements as [tag, attributes, text, ancestors], by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.elements, self.open, self.count = [], [], Counter()
        self.feed(html)
        self.close()

    def add(self, text):
        for e in self.open:
            e[2].append(text)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.add("\n")
        if tag not in VOID:
            self.elements.append([tag, {k: v or "" for k, v in attrs}, [], list(self.open)])
            self.open.append(self.elements[-1])
            self.count[tag] += 1

    def handle_endtag(self, tag):
        while self.count[tag]:
            e = self.open.pop()
            self.count[e[0]] -= 1
            if e[0] in BLOCK:
                self.add("\n")
            if e[0] == tag:
                break

    def handle_data(self, data):
        if not any(e[0] in ("script", "style") for e in self.open):
            self.add(data)


def fits(e, simple):
    head, _, test = simple.partition("[")
    name, *classes = head.split(".")
    key, _, value = test.rstrip("]").partition("=")
    return name in ("*", "", e[0]) and set(classes) <= set(e[1].get("class", "").split()) and (not test or e[1].get(key) == value)


def lines(e):
    return "\n".join(x for x in (" ".join(y.split()) for y in "".join(e[2]).split("\n")) if x)


SELECTORS = ["div", "div.a", "*.b", "span[k=v]", "div span", "ul li.a", "*.b *", "div div.a span", "h3 a", "*[k=v]"]


def odd_page(rng):
    tags = ["div", "span", "ul", "li", "p", "h3", "a", "br", "DIV", "script"]
    out = []
    for _ in range(rng.randrange(60)):
        kind = rng.random()
        tag = rng.choice(tags)
        if kind < 0.45:
            attrs = rng.choice(["", ' class="a"', " class='b  a'", ' k="v"', " k=v class=b", ' title="x > y" class="a"', ' data-x="&lt;" K="v"', " hidden", ' class="a" class="b"'])
            out.append(f"<{tag}{attrs}{rng.choice(['', '', ' /'])}>" if tag != "script" else "<script>if (a < b) { '</div>' }</script>")
        elif kind < 0.75:
            out.append(f"</{tag.lower() if tag != 'script' else 'div'}>")
        else:
            out.append(rng.choice(["text", " two  words ", "a &amp; b", "&nbsp;x", "<!-- <div> -->", "1 < 2", "\n", "&#39;q&#x27;", "<!doctype html>"]))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_selectors_are_those_of_a_tree(seed):
    rng = random.Random(seed)
    compiled = Selectors(SELECTORS)
    for _ in range(300):
        html = odd_page(rng)
        page, tree = Page(html, compiled), Tree(html)
        for s in SELECTORS:
            *outer, last = s.split()
            want = [lines(e) for e in tree.elements if fits(e, last) and all(any(fits(a, o) for a in e[3]) for o in outer)]
            assert [page.text(e) for e in page.elements(s)] == want, (html, s)


@pytest.mark.parametrize("html", ["<div>" * 200_000, "<div class='a'>" * 60_000 + "x" + "</div>" * 60_000, "<a b='" * 150_000, '<p title="' * 100_000 + ">", "<script>" * 100_000, "<!--" * 200_000, "</x" * 300_000, "<li><b>" * 100_000, "< " * 400_000, "&" * 1_000_000])
def test_pages_of_a_megabyte_are_linear(html):
    began = time.time()
    Page(html, Selectors(SELECTORS))
    assert time.time() - began < 10


def test_records_are_fields_of_cards(spark, sf):
    given = spark.read.parquet(f"{sf}/pages.parquet")
    spec = pages.BoardSpec(("section.none", "nav li", "li", "p"), {"title": ("b", "a", "*"), "description": ("li a", "*"), "posted_date": ("ul li",), "url": ("a@href",)}, base="https://x")
    made = spark.createDataFrame([(i, f"u{i}", odd_page(random.Random(i))) for i in range(200)], "page_id long, url string, html string")
    for df, s in ((given, pages.ARTICLE), (given, spec), (made, spec), (made, pages.JORA)):
        one, two = pages.extract_records(df, s), pages.extract_fields(pages.extract_cards(df, s), s)
        assert one.columns == two.columns
        a, b = (sorted(map(str, x.collect())) for x in (one, two))
        assert a == b
    assert pages.extract_records(given, pages.ARTICLE).count() == given.count()


def test_ids_stay_what_they_are(spark):
    big = 2**53 + 1
    html = "<article><h1>T</h1><p>x</p></article>"
    rows = [(None, "u", html), (big, "u", html), (big, "u", html), (5, "u", None), (6, None, ""), (7, "u", "<article>no title")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).withColumns({"page_url": F.lit("clash"), "texts": F.lit(1)})
    want = [None, big, big]
    for named in (df, df.withColumn("page_id", F.concat(F.lit("id "), F.col("page_id").cast("string")))):
        change = (lambda x: x) if named is df else (lambda x: None if x is None else f"id {x}")
        key = lambda rs: sorted((r.page_id for r in rs), key=str)
        assert key(pages.extract_cards(named, pages.ARTICLE).collect()) == sorted([*map(change, want), change(7)], key=str)
        clean = named.drop("page_url")
        assert key(pages.extract_records(clean, pages.ARTICLE).collect()) == sorted(map(change, want), key=str)
        assert key(pages.extract_fields(pages.extract_cards(clean, pages.ARTICLE), pages.ARTICLE).collect()) == sorted(map(change, want), key=str)
        assert key(pages.page_description(named, ("article",), 200).collect()) == sorted((change(r[0]) for r in rows), key=str)
    assert not pages.extract_records(df.drop("page_url").limit(0), pages.ARTICLE).count()


@pytest.mark.parametrize("cut, want", [("and&amp", "and&amp"), ("a &am", "a &am"), ("&amp;&quo", "&&quo"), ("&amp;lt;", "&lt;"), ("a&lt;b&amp;c", "a<b&c"), ("x&#39", "x&#39"), ("&#39;&#x27;&nbsp;y", "'' y"), ("&ampx;", "&ampx;"), ("&middot;&copy;", "\u00b7\u00a9"), ("R&amp D", "R&amp D")])
def test_references_end_with_a_semicolon(spark, cut, want):
    """Titles that were cut inside a reference keep what is left of it, as the SQL of the queries does."""
    df = spark.createDataFrame([(1, "u", f"<article><h1>{cut}</h1><p>x</p></article>")], "page_id long, url string, html string")
    assert pages.extract_records(df, pages.ARTICLE).first().title == want
    assert next(Page('<a href="/?a=1&copy=2&amp;b">', Selectors(["a"])).elements("a")).attributes["href"] == "/?a=1&copy=2&b"


@pytest.mark.parametrize("cut", ["and&amp", "&amp;&quo", "R&amp D"])
def test_descriptions_keep_cut_references(spark, cut):
    df = spark.createDataFrame([(1, f"<article><h1>{cut}</h1><p>x&lt;</p></article>")], "page_id long, html string")
    want = cut.replace("&amp;", "&")
    assert pages.page_description(df, ("div.none", "article"), 200).first().description == f"{want}\nx<"


def test_descriptions_as_their_sql_has_them(spark, tmp_path):
    """Characters that are white space for Python but not for HTML stay, forms and figures part words, a null page has no description."""
    odd = ["a&nbsp;b", "\u00a0a \u00a0 b&nbsp;", "\u3000 a\u200a", "a\u2003\u3000b\u2028c", "\x0b a\x1cb \x85", " a\t\r\n\fb ", "a<form>b</form>c", "a<figure>b<figcaption>c</figcaption>d</figure>e", ""]
    rows = [(i, f"<article><h1>{x}</h1><p>{x}<br>{x}</p></article>") for i, x in enumerate(odd)] + [(len(odd), None), (len(odd) + 1, ""), (len(odd) + 2, "<p>none</p>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = registry.queries()["page_description"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(registry.oracle_sql()["page_description"]).fetchall())
    assert pages.page_description(spark.createDataFrame(rows[:1], "absent long, html string").withColumn("page_id", F.col("absent")), ("article",)).first().description == "a\u00a0b\na\u00a0b\na\u00a0b"


@pytest.mark.parametrize("html", ["&a" * 500_000, "&" + "a" * 1_000_000, "&#" + "1" * 5_000 + ";"])
def test_references_are_linear(html):
    began = time.time()
    Page(f"<p>{html}</p>", Selectors(["p"]))
    assert time.time() - began < 10
