"""Search plans: the urls to crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How boards spell places.
PLACES = {
    "linkedin": {"perth": "Perth, Western Australia, Australia", "melbourne": "Melbourne, Victoria, Australia", "sydney": "Sydney, New South Wales, Australia", "brisbane": "Brisbane, Queensland, Australia", "adelaide": "Adelaide, South Australia, Australia",
                 "canberra": "Canberra, Australian Capital Territory, Australia", "remote": "Australia", "australia": "Australia", "all australia": "Australia", "us": "United States", "uk": "United Kingdom", "singapore": "Singapore"},
    "seek": {"perth": "All-Perth-WA", "melbourne": "All-Melbourne-VIC", "sydney": "All-Sydney-NSW", "brisbane": "All-Brisbane-QLD", "adelaide": "All-Adelaide-SA", "canberra": "All-Canberra-ACT", "remote": "All-Australia", "australia": "All-Australia", "all australia": "All-Australia"},
    "jora": {"perth": "Perth WA", "melbourne": "Melbourne VIC", "sydney": "Sydney NSW", "brisbane": "Brisbane QLD", "adelaide": "Adelaide SA", "canberra": "Canberra ACT", "remote": "Australia", "australia": "Australia", "all australia": "Australia"},
}
#: The places that one board searches, as (name, geo id, work type).
LINKEDIN_TARGETS = (("Australia", "101452733", None), ("US", "103644278", "2"))


def board_location(place: Column, board: str, partial: bool = False) -> Column:
    """A place as a board spells it: looked up whole, or with partial by the first known place that it holds."""
    known = PLACES[board]
    other = place if board == "linkedin" else F.lit({"seek": "All-Australia", "jora": "Australia"}[board])
    if partial:
        found = F.coalesce(*(F.when(F.lower(place).contains(k), F.lit(v)) for k, v in known.items()))
    else:
        found = F.try_element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.lower(F.trim(place)))
    return F.coalesce(found, other)


def search_urls(titles: DataFrame, boards: tuple[str, ...] = ("linkedin", "seek", "jora"), regions: tuple[str, ...] = ("australia",), max_age_hours: int = 24) -> DataFrame:
    """titles (title) -> url, source, keyword, location, search_id, one row a title and place of each board."""
    low, home = F.lower("title"), "australia" in [r.lower() for r in regions]
    slug = F.replace(low, F.lit(" "), F.lit("_"))
    rows = []
    entry = lambda url, source, place: F.struct(url.alias("url"), F.lit(source).alias("source"), F.col("title").alias("keyword"), F.lit(place).alias("location"), F.concat(F.lit(f"{source}_"), slug, F.lit(f"_{place.lower()}")).alias("search_id"))
    if "linkedin" in boards:
        for place, geo, kind in LINKEDIN_TARGETS:
            rest = f"&f_TPR=r{max_age_hours * 3600}&geoId={geo}" + (f"&f_WT={kind}" if kind else "")
            rows.append(entry(F.concat(F.lit("https://www.linkedin.com/jobs/search/?keywords="), F.trim("title"), F.lit(rest)), "linkedin", place))
    if "seek" in boards and home:
        words = F.replace(F.replace(F.trim(low), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-"))
        rows.append(entry(F.concat(F.lit("https://www.seek.com.au/"), words, F.lit(f"-jobs/in-All-Australia?daterange={max(1, max_age_hours // 24)}")), "seek", "Australia"))
    if "jora" in boards and home:
        age = "24h" if max_age_hours <= 24 else "7d" if max_age_hours <= 168 else "30d"
        rows.append(entry(F.concat(F.lit(f"https://au.jora.com/j?sp=search&trigger_source=serp&a={age}&q="), F.url_encode(low), F.lit("&l=Australia")), "jora", "Australia"))
    if not rows:
        return titles.where("false").selectExpr("'' AS url", "'' AS source", "title AS keyword", "'' AS location", "'' AS search_id")
    return titles.select("title", F.explode(F.array(*rows)).alias("r")).select("r.*")


def paginate(searches: DataFrame, max_pages: int) -> DataFrame:
    """One row a page of each search, with page (from 1) and its page_url."""
    url, i = F.col("url"), F.col("page") - 1
    start = F.concat(F.lit("start="), (i * 25).cast("string"))
    glue = F.when(url.contains("?"), "&").otherwise("?")
    linkedin = F.when(url.contains("&start="), F.regexp_replace(url, F.lit("&start=[0-9]+"), F.concat(F.lit("&"), start))).otherwise(F.concat(url, glue, start))
    numbered = F.when(i == 0, url).otherwise(F.concat(url, glue, F.lit("page="), F.col("page").cast("string")))
    return searches.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages)))).withColumn("page_url", F.when(F.col("source") == "linkedin", linkedin).otherwise(numbered))
