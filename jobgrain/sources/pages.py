"""Posting records from stored web pages."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from jobgrain.functions.names import spare
from jobgrain.functions.text import strip
from jobgrain.sources.markup import Element, Page, Selectors


@dataclass(frozen=True)
class BoardSpec:
    """Where a board's pages keep a card and its fields. A selector is 'tag', 'tag.class', 'tag[attribute=value]', or two of
    these with a space between for an element inside another; '*' is any tag."""

    cards: tuple[str, ...]
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=lambda: {"company": "Unknown", "location": "Australia", "description": ""})
    base: str = ""
    location_differs: bool = False  # a place equal to the company is no place


SEEK = BoardSpec(
    ("article[data-testid=job-card]", "article[data-automation=normalJob]"),
    {"title": ("*[data-automation=jobTitle]", "h3 a"), "company": ("*[data-automation=jobCompany]", "*[data-automation=jobAdvertiser]"), "location": ("*[data-automation=jobLocation]", "*[data-automation=jobSuburb]"),
     "description": ("*[data-automation=jobShortDescription]", "*[data-automation=jobDescription]"), "posted_date": ("*[data-automation=jobListingDate]",), "employment_type": ("*[data-automation=jobWorkType]",), "url": ("a[data-automation=jobTitle]@href", "a@href")},
    base="https://www.seek.com.au")
JORA = BoardSpec(("div.job-card.result", "div.job-card"), {"title": ("h2.job-title a", "h2.job-title"), "company": ("div.job-company", "span.job-company"), "location": ("span.job-location", "div.job-location"), "url": ("h2.job-title a@href", "a@href")}, base="https://au.jora.com")
#: The crawled pages of this repository's tables: one card a page.
ARTICLE = BoardSpec(("article",), {"title": ("h1",), "description": ("article",)}, {"company": "Unknown", "location": "Unknown", "description": ""})


def _read_pages(df: DataFrame, keep: list[str], html: str, selectors: list[str], rows, schema: str) -> DataFrame:
    """Reads html once a row. rows(page) gives tuples of what a row becomes, for the columns of schema; the columns keep go with each,
    as they are and never through Python, so that any type of id stays what it is."""
    compiled = Selectors(selectors)
    added = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields])

    def read(batches):
        for batch in batches:
            source: list[int] = []
            out: list[tuple] = []
            for i, text in enumerate(batch.column(len(keep))):
                new = list(rows(Page(text.as_py() or "", compiled)))
                out += new
                source += [i] * len(new)
            kept = [batch.column(k).take(pa.array(source, pa.int64())) for k in range(len(keep))]
            columns = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*keep, *added.names])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, html).mapInArrow(read, f"{kinds}, {schema}")


def _cards(page: Page, spec: BoardSpec) -> list[Element]:
    """A page's cards by the first selector that finds any."""
    return next((f for f in (list(page.elements(s)) for s in spec.cards) if f), [])


def _fields(page: Page, spec: BoardSpec, card: Element | None) -> list[list[str]]:
    """For each field what each of its selectors finds first that is not empty."""
    out = []
    for selectors in spec.fields.values():
        got = []
        for s in selectors:
            s, _, attribute = s.partition("@")
            got.append(next((t for e in page.elements(s, card) for t in [e.attributes.get(attribute, "").strip() if attribute else page.text(e)] if t), ""))
        out.append(got)
    return out


def _selectors(spec: BoardSpec) -> list[str]:
    return [s.partition("@")[0] for selectors in spec.fields.values() for s in selectors]


def extract_cards(pages: DataFrame, spec: BoardSpec) -> DataFrame:
    """page_id, url, card_idx, html: a page's cards by the first selector that finds any. A null page has none."""
    rows = lambda page: [(i, page.html[e.begin : e.end]) for i, e in enumerate(_cards(page, spec))]
    return _read_pages(pages, ["page_id", "url"], "html", list(spec.cards), rows, "card_idx int, html string")


def _named_fields(raw: DataFrame, spec: BoardSpec) -> DataFrame:
    first = {n: F.get(F.filter(n, lambda x: x != ""), F.lit(0)) for n in spec.fields}
    if spec.location_differs and "company" in first:
        first["location"] = F.get(F.filter("location", lambda x: (x != "") & (x != F.coalesce(first["company"], F.lit("")))), F.lit(0))
    url = first.get("url", F.col("page_url"))
    columns = {n: F.coalesce(first.get(n, F.lit(None).cast("string")), F.lit(d)) for n, d in spec.defaults.items()}
    columns |= {n: c for n, c in first.items() if n not in columns and n != "url"}
    out = raw.select("page_id", "card_idx", canonical_url(url, spec.base).alias("url"), *(c.alias(n) for n, c in columns.items()))
    return out.where("title IS NOT NULL AND url IS NOT NULL")


def extract_fields(cards: DataFrame, spec: BoardSpec) -> DataFrame:
    """page_id, card_idx and a column a field: the first selector whose text is not empty, else the default. A selector ending
    in @name reads an attribute. Cards without a title, or without a url where the board has one, are dropped."""
    fields = ", ".join(f"{n} array<string>" for n in spec.fields)
    raw = _read_pages(cards.withColumnRenamed("url", "page_url"), ["page_id", "page_url", "card_idx"], "html", _selectors(spec), lambda page: [tuple(_fields(page, spec, None))], fields)
    return _named_fields(raw, spec)


def extract_records(pages: DataFrame, spec: BoardSpec) -> DataFrame:
    """extract_fields() of extract_cards(), from one reading of each page: a field counts for a card if it is inside it, and what
    its selector wants around it is inside too."""
    fields = ", ".join(f"{n} array<string>" for n in spec.fields)
    rows = lambda page: [(i, *_fields(page, spec, card)) for i, card in enumerate(_cards(page, spec))]
    raw = _read_pages(pages.withColumnRenamed("url", "page_url"), ["page_id", "page_url"], "html", [*spec.cards, *_selectors(spec)], rows, f"card_idx int, {fields}")
    return _named_fields(raw, spec)


def drop_recommended(cards: DataFrame, words: tuple[str, ...] = ("top-pick", "recommended", "discover", "similar", "might")) -> DataFrame:
    """Cards whose lower-cased HTML has none of the words."""
    low = F.lower("html")
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return cards.where(~F.coalesce(hit, F.lit(False)))


def page_description(pages: DataFrame, containers: tuple[str, ...], least: int = 200) -> DataFrame:
    """page_id, description: the text of the first container longer than least, else of the last one found, else of main. Only white
    space of HTML becomes one space, so no-break spaces stay. A null page has a null description."""

    def texts(page: Page) -> list[tuple]:
        return [([next((page.text(e, whole=True) for e in page.elements(s)), None) for s in (*containers, "main")],)]

    (absent,) = spare(pages, "absent")
    raw = _read_pages(pages.withColumn(absent, F.col("html").isNull()), ["page_id", absent], "html", [*containers, "main"], texts, "texts array<string>")
    tried = F.filter(F.slice("texts", 1, len(containers)), lambda x: x.isNotNull())
    long_ = F.get(F.filter(tried, lambda x: F.length(x) > least), F.lit(0))
    last = F.when(F.size(tried) > 0, F.try_element_at(tried, F.lit(-1)))
    return raw.select("page_id", F.when(~F.col(absent), F.coalesce(long_, last, F.get("texts", F.lit(len(containers))), F.lit(""))).alias("description"))


def canonical_url(url: Column, base: str, job_id: Column | None = None) -> Column:
    """Without its query, absolute, or built from an id where there is no url."""
    plain = F.split_part(url, F.lit("?"), F.lit(1))
    full = F.when(plain.startswith("/"), F.concat(F.lit(base), plain)).otherwise(plain)
    return full if job_id is None else F.coalesce(F.when(full != "", full), F.concat(F.lit(f"{base}/jobs/view/"), job_id.cast("string")))


#: Headings before which a description ends, in order of priority.
REQUIREMENTS = ("Requirements added by the job poster", "Requirements:", "Required Qualifications", "Minimum Qualifications", "Basic Qualifications", "Must Have")


def split_requirements(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds description and requirement_text: the text cut once at the first heading of the list that it holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = lambda h: F.instr(t, h)
    head, tail = t, F.lit(None).cast("string")
    for h in reversed(REQUIREMENTS):
        here = parts(h) > 0
        head = F.when(here, strip(F.substring(t, F.lit(1), parts(h) - 1))).otherwise(head)
        tail = F.when(here, F.concat(F.lit(f"{h}\n"), strip(F.substr(t, parts(h) + len(h))))).otherwise(tail)
    return df.withColumns({"description": head, "requirement_text": tail})


#: By column, words that name it, and labels that are cut from it. The first column that fits takes an item.
CRITERIA = {
    "seniority_level": (("Seniority level", "Entry level", "Mid-Senior", "Associate", "Internship"), ("Seniority level",)),
    "employment_type": (("Employment type", "Full-time", "Part-time", "Contract", "Temporary", "Freelance"), ("Employment type",)),
    "job_function": (("Job function",), ("Job function",)),
    "industries": (("Industries", "Industry"), ("Industries", "Industry")),
}


def classify_criteria(df: DataFrame, criteria: str = "criteria") -> DataFrame:
    """Adds the four columns from an array of criteria; the last item that fits a column stands."""
    fits = lambda x, words: F.coalesce(*(F.when(x.contains(w), F.lit(True)) for w in words), F.lit(False))

    def first_fit(words, taken):
        def own(x):
            cond = fits(x, words)
            for other in taken:
                cond = cond & ~fits(x, other)
            return cond

        return own

    out = {}
    earlier: list[tuple[str, ...]] = []
    for column, (words, labels) in CRITERIA.items():
        taken = tuple(earlier)

        item = F.try_element_at(F.filter(F.coalesce(F.col(criteria), F.array().cast("array<string>")), first_fit(words, taken)), F.lit(-1))
        for label in labels:
            item = F.replace(item, F.lit(label), F.lit(""))
        out[column] = strip(item)
        earlier.append(words)
    return df.withColumns(out)


def _after(lines: Column, test) -> Column:
    """The line after the first one that passes a test."""
    at = F.get(F.filter(F.transform(lines, lambda x, i: F.when(test(F.lower(x)), i)), lambda i: i.isNotNull()), F.lit(0))
    return strip(F.get(lines, at + 1))


def infer_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the same four columns as far as the whole text tells: the line after a label, else words that give it away."""
    t = F.coalesce(F.col(text), F.lit(""))
    low, lines = F.lower(t), F.split(t, "\n")
    has = lambda *w: F.coalesce(*(F.when(low.contains(x), F.lit(True)) for x in w), F.lit(False))
    level = _after(lines, lambda x: x.contains("seniority level") | (x.contains("seniority:") & ~x.contains("level")))
    clean = F.lit(True)
    for w in ("benefits", "salary", "compensation", "pay", "hours"):
        clean = clean & ~F.lower(level).contains(w)
    guess = F.when(has("entry level") | (has("internship") & has("program")), "Entry level").when(has("mid-senior", "senior level"), "Mid-Senior level").when(has("associate") & ~has("degree"), "Associate")
    kind = F.when(has("full-time", "full time"), "Full-time").when(has("contract"), "Contract").when(has("part-time", "part time"), "Part-time")
    return df.withColumns({
        "seniority_level": F.when(has("seniority level:", "seniority:"), F.when((F.length(level) < 50) & clean, level)).otherwise(guess), "employment_type": F.when(has("employment type:"), _after(lines, lambda x: x.contains("employment type"))).otherwise(kind),
        "job_function": F.when(has("job function:"), _after(lines, lambda x: x.contains("job function"))), "industries": F.when(has("industries:", "industry:"), _after(lines, lambda x: x.contains("industries") | x.contains("industry:")))})


def posted_age(text: Column) -> Column:
    """The first line of a card that speaks of an age."""
    has = lambda x, words: F.coalesce(*(F.when(x.contains(w), F.lit(True)) for w in words), F.lit(False))
    low = F.lower(text)
    line = F.get(F.filter(F.split(low, "\n"), lambda x: has(x, ("hour", "day", "week", "month", "ago"))), F.lit(0))
    return F.when(has(low, ("hour", "day", "week", "month")), strip(line))


def join_skills(skills: Column) -> Column:
    """The first ten skills that are not empty."""
    return F.array_join(F.slice(F.filter(F.transform(skills, strip), lambda x: x != ""), 1, 10), ", ")
