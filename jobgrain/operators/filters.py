"""The three-tier filter: titles, descriptions, and the rates of both."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Keywords:
    """Keyword lists. Every list is small configuration, and goes into the plan as literals."""

    false_positive_patterns: tuple[str, ...] = ()
    exclude_seniority: tuple[str, ...] = ()
    title_exclude: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    required_phrases: tuple[str, ...] = ()
    standalone: tuple[str, ...] = ()
    domain: tuple[str, ...] = ()
    role: tuple[str, ...] = ()
    acronyms: dict[str, str] = field(default_factory=dict)
    description: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    threshold: int = 2
    min_length: int = 100

    @classmethod
    def from_config(cls, data: dict) -> Keywords:
        """From the keyword file's fields; the domain list falls back to required, then to general title keywords."""
        low = lambda xs: tuple(x.lower() for x in xs or ())
        parts = lambda s: tuple(x.strip().lower() for x in (s or "").split(",") if x.strip())
        domain = data.get("title_domain_keywords") or data.get("title_required_keywords") or data.get("title_keywords")
        return cls(
            tuple(data.get("false_positive_patterns", ())), parts(data.get("dealbreakers", {}).get("exclude_seniority")), low(data.get("title_exclude_keywords")), low(data.get("exclude_keywords")),
            low(data.get("title_required_phrases")), low(data.get("title_standalone_keywords")), low(domain), low(data.get("title_role_keywords")),
            {k.lower(): v.lower() for k, v in data.get("acronym_mappings", {}).items()}, low(data.get("description_required_keywords")), low(data.get("strong_keywords")),
            int(data.get("description_quality_threshold", 2)), int(data.get("description_min_length", 100)))


def word_pattern(word: str) -> str:
    """A word or phrase that stands by itself, accented letters counting as letters."""
    return rf"(?<![\p{{L}}\p{{N}}_])\Q{word}\E(?![\p{{L}}\p{{N}}_])"


def first_in(text: Column, words: tuple[str, ...], match: str = "substring") -> Column:
    """The first of words, in their order, that text holds; null if none."""
    if not words:
        return F.lit(None).cast("string")
    has = (lambda w: text.rlike(word_pattern(w))) if match == "word" else (lambda w: text.contains(w))
    return F.coalesce(*(F.when(has(w), F.lit(w)) for w in words))


def count_in(text: Column, words: tuple[str, ...]) -> Column:
    """How many of words text holds."""
    out = F.lit(0)
    for w in dict.fromkeys(words):
        out = out + text.contains(w).cast("int")
    return out


def expand_acronyms(title: Column, acronyms: dict[str, str]) -> Column:
    """Lower-cased title, and after it the full form of every acronym that it holds as a substring."""
    low = F.lower(title)
    return F.concat(low, *(F.when(low.contains(a), F.lit(" " + full)).otherwise(F.lit("")) for a, full in acronyms.items()))


def title_filter(df: DataFrame, kw: Keywords, title: str = "title", enabled: bool = True, match: str = "substring") -> DataFrame:
    """Adds tier1_pass, tier1_rule and tier1_reason: the first rule that decides, and the first listed word that made it.

    match='word' asks for whole words where the default takes substrings. A null title counts as ''.
    """
    if not enabled:
        return df.withColumns({"tier1_pass": F.lit(True), "tier1_rule": F.lit("disabled"), "tier1_reason": F.lit("Title filtering disabled")})
    raw = F.coalesce(F.col(title), F.lit(""))
    low, full = F.lower(raw), expand_acronyms(raw, kw.acronyms)
    listed = lambda patterns, f: F.coalesce(*(F.when(raw.rlike("(?i)" + f(p)), F.lit(p)) for p in patterns)) if patterns else F.lit(None).cast("string")
    found = F.struct(
        listed(kw.false_positive_patterns, lambda p: p).alias("false_positive"), listed(kw.exclude_seniority, word_pattern).alias("seniority"),
        first_in(low, kw.title_exclude, match).alias("title_exclude"), first_in(low, kw.exclude, match).alias("exclude"), first_in(full, kw.required_phrases, match).alias("phrase"),
        first_in(full, kw.standalone, match).alias("standalone"), first_in(full, kw.domain, match).alias("domain"), first_in(full, kw.role, match).alias("role"))
    t = df.withColumn("tier1_found", found)
    hit = lambda n: F.col(f"tier1_found.{n}")
    say = lambda text, *names: F.concat(F.lit(text), *(x for i, n in enumerate(names) for x in ([F.lit(" + ")] if i else []) + [hit(n)]))
    rules = [(hit(n).isNotNull(), n, say(text, n), ok) for n, text, ok in (
        ("false_positive", "False positive pattern: ", False), ("seniority", "Excluded seniority: ", False), ("title_exclude", "Excluded role type: ", False),
        ("exclude", "Non-technical role: ", False), ("phrase", "Matched required phrase: ", True), ("standalone", "Matched standalone keyword: ", True))]
    domain, role = hit("domain").isNotNull(), hit("role").isNotNull()
    if kw.role:
        rules += [(domain & role, "domain_role", say("Matched domain+role: ", "domain", "role"), True), (domain, "domain_only", F.concat(F.lit("Has domain '"), hit("domain"), F.lit("' but no role keyword")), False),
                  (role, "role_only", F.concat(F.lit("Has role '"), hit("role"), F.lit("' but no domain keyword (generic job)")), False), (F.lit(True), "none", F.lit("No domain or role keywords found"), False)]
    else:
        rules += [(domain, "legacy", say("Matched keyword (legacy): ", "domain"), True), (F.lit(True), "none", F.lit("Title doesn't match required keywords or phrases"), False)]

    def choose(i: int) -> Column:
        out = F.lit(None)
        for rule in reversed(rules):
            out = F.when(rule[0], F.lit(rule[i]) if isinstance(rule[i], (str, bool)) else rule[i]).otherwise(out)
        return out

    return t.withColumns({"tier1_pass": choose(3).cast("boolean"), "tier1_rule": choose(1).cast("string"), "tier1_reason": choose(2).cast("string")}).drop("tier1_found")


def quality_filter(df: DataFrame, kw: Keywords, description: str = "description", enabled: bool = True) -> DataFrame:
    """Adds tier3_pass, tier3_reason and keyword_hits: long enough, and with enough description keywords or a strong one."""
    if not enabled:
        return df.withColumns({"tier3_pass": F.lit(True), "tier3_reason": F.lit("Description filtering disabled"), "keyword_hits": F.lit(0)})
    text = F.coalesce(F.col(description), F.lit(""))
    t = df.withColumns({"keyword_hits": count_in(F.lower(text), kw.description), "tier3_strong": count_in(F.lower(text), kw.strong)})
    short, enough, strong = F.length(text) < kw.min_length, F.col("keyword_hits") >= kw.threshold, F.col("tier3_strong") >= 1
    reason = (F.when(short, F.concat(F.lit("Description too short: "), F.length(text), F.lit(f" chars < {kw.min_length}")))
              .when(enough, F.concat(F.lit("Quality: "), F.col("keyword_hits"), F.lit(f" keyword matches (threshold: {kw.threshold})")))
              .when(strong, F.concat(F.lit("Quality: "), F.col("tier3_strong"), F.lit(" strong keywords")))
              .otherwise(F.concat(F.lit("Insufficient keywords: "), F.col("keyword_hits"), F.lit(f" < {kw.threshold}"))))
    return t.withColumns({"tier3_pass": ~short & (enough | strong), "tier3_reason": reason}).drop("tier3_strong")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal, as text; 0.0 if there is nothing."""
    return F.format_string("%.1f", F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), 1))


def filter_metrics(flags: DataFrame, *keys: str) -> DataFrame:
    """Per group: seen, tier1, tier2, tier3, collected, and their rates. flags has the booleans tier1_cut, tier2_cut, tier3_cut.

    Tier 2 is rated on what tier 1 left (if that is more than one), tier 3 on what was scraped, efficiency on all seen.
    """
    sums = flags.groupBy(*keys).agg(F.count("*").alias("seen"), *(F.count_if(f"{t}_cut").alias(t) for t in ("tier1", "tier2", "tier3")))
    left, scraped = F.col("seen") - F.col("tier1"), F.col("seen") - F.col("tier1") - F.col("tier2")
    cut = F.col("tier1") + F.col("tier2") + F.col("tier3")
    return sums.withColumns({"collected": F.col("seen") - cut, "tier1_rate": percent(F.col("tier1"), F.col("seen")), "tier2_rate": percent(F.when(left > 1, F.col("tier2")), left), "tier3_rate": percent(F.col("tier3"), scraped), "efficiency": percent(cut, F.col("seen"))})


def filter_reason_breakdown(flags: DataFrame, title: str = "title", words: tuple[str, ...] = ("senior", "staff", "principal", "lead", "manager")) -> DataFrame:
    """Rejected rows by the first of words in their title, most frequent first."""
    bucket = F.coalesce(first_in(F.lower(F.coalesce(F.col(title), F.lit(""))), words), F.lit("other"))
    return flags.where(~F.col("tier1_pass")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")
