"""Structured signals from posting text: one column pipeline over the lower-cased description."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.text import strip

# The phrases that each signal listens for. A space stands for any white space.
LETTER = r"[\p{L}\p{N}_]"
SPACE = r"[ \t\n\r\x0B\f]"
GRADUATE = ("graduate program", "grad role", "recent graduate", "fresh graduate", "new graduate", "masters graduate", "graduate position", "graduate opportunity")
ENTRY = ("entry[ -]level", "junior", "associate", "junior level", "entry level position", "early career")
MASTERS = ("masters degree", "masters in", "msc", r"m\.s\.", "masters qualification", "postgraduate degree", "graduate degree")
DOMAINS = {
    "Machine Learning": ("machine learning", "ml engineer", "ml model", "supervised learning", "unsupervised learning", "ml models?"),
    "Deep Learning": ("deep learning", "neural network", "cnn", "rnn", "transformer", "dl model", "deep neural"),
    "Computer Vision": ("computer vision", "cv", "image processing", "object detection", "yolo", "opencv", "image segmentation", "image classification"),
    "Agentic AI": ("langchain", "crewai", "multi[ -]agent", "agentic", "autonomous agent", "agent orchestration", "langgraph", "ai agent"),
    "LLM/RAG": ("llm", "large language model", "rag", "retrieval", "vector database", "embedding", "prompt engineering", "gpt", "claude"),
    "MLOps": ("mlops", "ml[ -]ops", "model deployment", "model serving", "mlflow", "kubeflow", "ci/cd for ml", "model monitoring"),
    "Data Science": ("data scientist", "data science", "statistical analysis", "data analytics"),
}
#: The order in which keywords of domains are listed.
KEYWORD_ORDER = ("Agentic AI", "LLM/RAG", "Computer Vision", "Machine Learning", "Deep Learning", "MLOps")
REMOTE = ("fully remote", "100% remote", "remote[ -]first", "work from home", "wfh", "remote position")
ONSITE = ("onsite", "office[ -]based", "in[ -]office")
OFFICE_DAYS = rf"([0-9]+){SPACE}*days?{SPACE}*(in[ \t\n\r\x0B\f-]office|onsite|office)"
SPONSOR = ("visa sponsorship", "485 visa", "sponsor visa", "sponsorship available", "will sponsor")
MENTOR = ("mentorship", "mentor", "coaching", "learning opportunities", "professional development", "training program")
GROWTH = ("career growth", "progression", "advancement", "learning path", "development opportunities")
STARTUP = ("startup", "early[ -]stage", "series [a-c]", "seed funded")
SCALEUP = ("scale[ -]up", "series [d-f]", "growth stage")
ENTERPRISE = ("enterprise", "fortune 500", "multinational", "global leader", "established")
TEAM = rf"([0-9]+)[ \t\n\r\x0B\f-]?(person|member|engineer)s?{SPACE}+(team|ml|ai|data)"
SENIOR_ROLE = rf"(?=[slph])(?<!{LETTER})(senior|lead|principal|staff|head of){SPACE}+(developer|engineer|analyst|architect|programmer|consultant|designer)"
REQUIRED_CUES = "required|must have|essential|mandatory|necessary"
PREFERRED_CUES = "preferred|nice to have|bonus|desirable|plus"


@dataclass(frozen=True)
class ParserConfig:
    """What a candidate rules out and looks for."""

    exclude_visa: tuple[str, ...] = ("australian pr", "citizenship required", "security clearance")
    exclude_seniority: tuple[str, ...] = ("senior", "lead", "principal", "staff", "manager", "director")
    exclude_education: tuple[str, ...] = ("phd required", "doctorate required")
    max_experience: int = 2
    skills: tuple[str, ...] = ()
    strong: tuple[str, ...] = ()
    cities: tuple[str, ...] = ("Perth", "Melbourne", "Remote")

    @classmethod
    def from_config(cls, data: dict) -> ParserConfig:
        parts = lambda s: tuple(x.strip().lower() for x in (s or "").split(",") if x.strip())
        d, base = data.get("dealbreakers", {}), cls()
        cities = tuple(x.strip() for x in data.get("preferences", {}).get("locations", "Perth, Melbourne, Remote").split(",") if x.strip())
        return cls(parts(d.get("exclude_visa")) or base.exclude_visa, parts(d.get("exclude_seniority")) or base.exclude_seniority, parts(d.get("exclude_education")) or base.exclude_education, int(d.get("max_experience", 2)),
                   tuple(x.lower() for x in data.get("technical_skills", ())), tuple(x.lower() for x in data.get("strong_keywords", ())), cities)


def spaced(phrase: str) -> str:
    """A phrase whose spaces stand for any white space."""
    out = phrase.replace("[ -]", "\0").replace(" ", f"{SPACE}+")
    return out.replace("\0", r"[ \t\n\r\x0B\f-]")


def any_of(phrases) -> str:
    """Whole words or phrases, the earlier ones tried first."""
    return rf"{begins(p[0] for p in phrases)}(?:{'|'.join(map(spaced, phrases))})(?!{LETTER})"


def begins(letters) -> str:
    """The beginning of a word with one of some characters, which are looked at before what stands before them: that is
    cheaper at most places of a text."""
    return rf"(?=[{''.join(sorted(set(map(re.escape, letters))))}])(?<!{LETTER})"


def literal(word: str) -> str:
    return rf"\Q{word}\E"


def holds(text: Column, *words: str) -> Column:
    """A plain search for any of some substrings: much cheaper than a pattern, so it stands before each of them."""
    out = F.lit(False)
    for i, w in enumerate(words):
        out = out | text.contains(w) if i else text.contains(w)
    return out


def names(text: Column, words: tuple[str, ...], then: str = "") -> Column:
    """Whether any of some literal words stands alone in a text; false for no words at all."""
    if not words:
        return F.lit(False)
    return holds(text, *words) & text.rlike(rf"{begins(w[0] for w in words)}(?:{'|'.join(map(literal, words))})(?!{LETTER}){then}")


def hint(text: Column, phrases) -> Column:
    """Whether the first letters of any phrase occur at all."""
    return holds(text, *dict.fromkeys(re.match("[a-z0-9%/]+", p)[0] for p in phrases))


def has(text: Column, phrases) -> Column:
    return hint(text, phrases) & text.rlike(any_of(phrases))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern matches first; null if nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def every(text: Column, pattern: str, group: int, when: Column) -> Column:
    """All matches of a pattern in texts that pass a cheaper test."""
    return F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(F.array().cast("array<string>"))


def around(text: Column, word: str | Column, width: int = 50) -> Column:
    """The text without what stands further than a pattern of width characters on both sides of a word can reach: a newline
    takes its place. Such a pattern finds the same in it, and no longer tries every position of a long text."""
    word = F.lit(word) if isinstance(word, str) else word
    n = F.length(word) + 2 * width
    cut = lambda x: F.when(F.length(x) > 2 * n, F.concat(F.left(x, n), F.lit("\n"), F.right(x, n))).otherwise(x)
    return F.call_function("array_join", F.transform(F.split(text, F.concat(F.lit(r"\Q"), word, F.lit(r"\E"))), cut), word)


def _listed(*columns: Column) -> Column:
    return F.filter(F.array(*columns), lambda x: x.isNotNull())


def _first_word(phrase: str) -> str:
    return phrase.split("[ -]")[0].split(" ")[0]


def alternation(words) -> str:
    """A pattern of any of some literal words, the longest that fits first, with beginnings that they share written once: what a place
    costs follows the length of a word and not the number of words."""
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        options = [(c if c.isalnum() else f"\\{c}") + pattern(node[c]) for c in sorted(node) if c]
        if not options:
            return ""
        return f"(?:{'|'.join(options)})" + ("?" if "" in node else "") if len(options) > 1 or "" in node else options[0]

    return pattern(tree)


#: Where a phrase of any list, a senior role or a number of years can begin, with the five words from there on.
_LISTS = (GRADUATE, ENTRY, MASTERS, *DOMAINS.values(), REMOTE, ONSITE, SPONSOR, MENTOR, GROWTH, STARTUP, SCALEUP, ENTERPRISE, ("senior", "lead", "principal", "staff", "head", "hybrid"))
_STARTS = tuple(sorted({_first_word(p) for phrases in _LISTS for p in phrases}))
_PLAIN = [w for w in _STARTS if re.fullmatch("[a-z0-9%/]+", w)]
_START = "|".join([alternation(_PLAIN), *(w for w in _STARTS if w not in _PLAIN)])
SPOT = rf"{begins([*(w[0] for w in _STARTS), *'jge0123456789'])}(?=((?:(?:{_START})(?!{LETTER})|junior|graduate|entry|[0-9])[^ \t\n\r\x0B\f]{{0,40}}(?:{SPACE}+[^ \t\n\r\x0B\f]{{1,40}}){{0,4}}))"


def spots(low: Column) -> Column:
    """The places of a text where anything listed can begin, each with the words after it, and marks between them. All lists
    of phrases find the same in it, in the same order, as in the whole text, which is so read once for all of them."""
    return F.array_join(F.regexp_extract_all(low, F.lit(SPOT), F.lit(1)), " | ")


def _inline(name: str, column: Column) -> Column:
    return column


class Steps:
    """Columns that are computed first and once, each under a name, for signals that use them in several places."""

    def __init__(self):
        self.columns: dict[str, Column] = {}

    def __call__(self, name: str, column: Column) -> Column:
        self.columns[f"parse_{name}"] = column
        return F.col(f"parse_{name}")


def dealbreakers(low: Column, title: Column, cfg: ParserConfig, step=_inline, near: Column | None = None) -> Column:
    """Reasons to rule a posting out, in order. A senior word counts in a title unless junior or graduate follows it, and
    only if the description speaks of no junior, graduate or entry role. near: the spots() of the text, if at hand."""
    near = low if near is None else near
    in_title = step("in_title", names(title, cfg.exclude_seniority, rf"(?!(?d:.*)(?<!{LETTER})(?:junior|graduate)(?!{LETTER}))"))
    in_text = step("in_text", holds(near, "senior", "lead", "principal", "staff", "head of") & near.rlike(SENIOR_ROLE))
    open_to_juniors = step("open_to_juniors", holds(near, "junior", "graduate", "entry") & near.rlike(rf"{begins('jge')}(junior|graduate|entry)"))
    least = cfg.max_experience + 1
    years = rf"{begins('0123456789')}([0-9]{{1,2}})\+?{SPACE}*years?{SPACE}*(?:of)?{SPACE}*(?:professional{SPACE}+)?experience(?!{LETTER})"
    asked = step("years", every(near, years, 1, holds(near, "experience")))
    told = step("told", F.get(F.filter(asked, lambda y: (y.cast("int") >= least) & (y.cast("int") <= 19) & ~((F.length(y) == 2) & y.startswith("0"))), F.lit(0)))
    return _listed(
        F.when(step("visa", names(low, cfg.exclude_visa)), F.lit("Requires Australian PR/Citizenship/Security Clearance")),
        F.when((in_title | in_text) & ~open_to_juniors, F.when(in_title, F.lit("Senior/Lead level position (in title)")).otherwise(F.lit("Senior/Lead level position (in description)"))),
        F.when(told.isNotNull(), F.concat(F.lit("Requires "), told, F.lit("+ years of experience"))),
        F.when(step("education", names(low, cfg.exclude_education)), F.lit("PhD required")))


def graduate_signals(low: Column, title: Column, step=_inline) -> Column:
    """low: the text, or its spots()."""
    years = rf"{begins('012')}([0-2]|1-2|0-1){SPACE}*years?{SPACE}*(?:of)?{SPACE}*experience(?!{LETTER})"
    said = step("few_years", F.when(holds(low, "experience"), found(low, years)))
    asked = step("asked", F.when(said.isNotNull(), found(said, years, 1)))
    upper = F.element_at(F.split(asked, "-"), -1).cast("int")
    graduate_word, entry_word = step("graduate_word", F.when(hint(low, GRADUATE), found(low, any_of(GRADUATE)))), step("entry_word", F.when(hint(low, ENTRY), found(low, any_of(ENTRY))))
    graduate, entry = step("graduate", graduate_word.isNotNull() | has(title, GRADUATE)), step("entry", entry_word.isNotNull() | has(title, ENTRY))
    level = F.when(graduate, "Graduate").when(entry, "Junior/Entry-level").when(upper <= 1, "Entry-level").otherwise("Unknown")
    return F.struct(
        graduate.alias("explicit_graduate"), entry.alias("entry_level"), upper.alias("years_required"), step("masters", has(low, MASTERS)).alias("masters_mentioned"), level.alias("seniority_level"),
        (graduate | entry | F.coalesce(upper <= 1, F.lit(False))).alias("accepts_fresh_grads"), F.slice(_listed(graduate_word, entry_word, said), 1, 5).alias("keywords"))


def domains(low: Column, step=_inline) -> Column:
    """Domains in their order, and their keywords; a domain is present where any of its keywords is. low: the text, or its spots()."""
    words = {n: step(f"domain_{i}", every(low, any_of(phrases), 0, hint(low, phrases))) for i, (n, phrases) in enumerate(DOMAINS.items())}
    keywords = F.array_distinct(F.concat(*(words[n] for n in KEYWORD_ORDER)))
    listed = step("domains", _listed(*(F.when(F.size(w) > 0, F.lit(n)) for n, w in words.items())))
    return F.struct(F.coalesce(F.get(listed, F.lit(0)), F.lit("Unknown")).alias("primary_domain"), (F.size(listed) > 0).alias("is_ai_ml_role"), listed.alias("domains_present"), F.slice(keywords, 1, 10).alias("domain_keywords"))


def _present(low: Column, universe: tuple[str, ...]) -> Column:
    """Which words of a list stand alone in a text, found in one reading. At a place the longest is found; shorter ones that it begins
    with, up to the end of a word, stand there too."""
    alone = rf"{begins(w[0] for w in universe)}(?=({alternation(universe)})(?!{LETTER}))"
    longest = F.array_distinct(F.regexp_extract_all(low, F.lit(alone), F.lit(1)))
    inside = {w: [v for v in universe if v != w and w.startswith(v) and not re.match(r"\w", w[len(v)])] for w in universe}
    if not any(inside.values()):
        return longest
    of = F.create_map(*(x for w, vs in inside.items() if vs for x in (F.lit(w), F.array(*map(F.lit, (w, *vs))))))
    return F.array_distinct(F.flatten(F.transform(longest, lambda w: F.coalesce(F.try_element_at(of, w), F.array(w)))))


def tech_stack(low: Column, cfg: ParserConfig, required_universe: tuple[str, ...] | None = None, step=_inline) -> Column:
    """Skills that the text mentions; required if a cue of need stands within 50 characters on the line, or no cue at all.
    With required_universe, skills outside the profile count as missing. The text is read once for all skills; what stands
    around a skill is looked at for those that it mentions."""
    universe = tuple(dict.fromkeys(w for w in (cfg.skills if required_universe is None else (*cfg.skills, *required_universe)) if w))
    none = F.array().cast("array<struct<skill:string,required:boolean>>")

    def judged(skill: Column, text: Column) -> Column:
        word = F.concat(F.lit(rf"(?<!{LETTER})\Q"), skill, F.lit(rf"\E(?!{LETTER})"))
        near = F.regexp_extract_all(around(text, skill), F.concat(F.lit("(?d).{0,50}"), word, F.lit(".{0,50}")), F.lit(0))
        cues = F.transform(F.array(near), lambda n: F.exists(n, lambda x: x.rlike(REQUIRED_CUES)) | ~F.exists(n, lambda x: x.rlike(PREFERRED_CUES)))[0]
        return F.struct(skill.alias("skill"), cues.alias("required"))

    present = step("present", _present(low, universe)) if universe else none
    states = F.transform(present, lambda w: judged(w, low)) if universe else none
    all_ = step("skills", states)
    skills = lambda name, cond: step(name, F.sort_array(F.transform(F.filter(all_, cond), lambda x: x["skill"])))
    required, preferred = skills("required", lambda x: x["required"]), skills("preferred", lambda x: ~x["required"])
    own = F.array(*map(F.lit, cfg.skills)) if cfg.skills else F.array().cast("array<string>")
    strong = F.array(*map(F.lit, cfg.strong)) if cfg.strong else F.array().cast("array<string>")
    matched = F.array_intersect(required, own)
    share = F.coalesce(F.floor(F.try_divide(F.size(matched) * 100.0, F.size(required))).cast("int"), F.lit(100))
    return F.struct(F.slice(required, 1, 15).alias("required"), F.slice(preferred, 1, 10).alias("preferred"), F.slice(F.array_except(required, own), 1, 10).alias("missing"), share.alias("match_percentage"),
                    F.array_intersect(F.array_intersect(F.sort_array(F.transform(all_, lambda x: x["skill"])), own), strong).alias("strong_present"))


def location_visa(low: Column, location: Column, cfg: ParserConfig, step=_inline, near: Column | None = None) -> Column:
    near = low if near is None else near
    place = F.lower(F.coalesce(location, F.lit("")))
    in_either = lambda c: names(low, (c,)) | names(place, (c,))  # noqa: E731  (a space stands between the two)
    hits = [step(f"city_{i}", in_either(c.lower())) for i, c in enumerate(cfg.cities)]
    none = F.array().cast("array<struct<city:string,score:int>>")
    cities = step("cities", _listed(*(F.when(hit, F.struct(F.lit(c.title()).alias("city"), F.lit(100 - 10 * i).alias("score"))) for i, (c, hit) in enumerate(zip(cfg.cities, hits, strict=True)))) if hits else none)
    days = step("office_days", F.when(holds(low, "day"), found(low, OFFICE_DAYS)))
    remote = step("remote", has(near, REMOTE))
    hybrid = step("hybrid", holds(near, "hybrid", "day") & near.rlike(rf"{begins('h0123456789')}(?:hybrid|{OFFICE_DAYS})(?!{LETTER})"))
    kind = F.when(remote, "Fully Remote").when(hybrid, "Hybrid").when(has(near, ONSITE), "Onsite").otherwise("Unknown")
    best = F.when(F.size(cities) > 0, F.array_max(F.transform(cities, lambda x: x["score"]))).when(remote & (low.contains("australia") | place.contains("australia")), 80).when(remote, 60).otherwise(0)
    pr, sponsor = step("visa", names(low, cfg.exclude_visa)), step("sponsor", has(near, SPONSOR))
    return F.struct(F.transform(cities, lambda x: x["city"]).alias("cities"), F.get(F.transform(cities, lambda x: x["city"]), F.lit(0)).alias("primary_city"), kind.alias("remote_type"), F.when(~remote & hybrid, F.regexp_extract(days, OFFICE_DAYS, 1).try_cast("int")).alias("remote_days"),
                    best.cast("int").alias("preference"), pr.alias("requires_pr"), sponsor.alias("sponsorship"), (~pr | sponsor).alias("acceptable"), (pr & ~sponsor).alias("blocker"))


def company_signals(low: Column, step=_inline, near: Column | None = None) -> Column:
    near = low if near is None else near
    mentor, growth = step("mentor", has(near, MENTOR)), step("growth", has(near, GROWTH))
    said = step("team", F.when(holds(low, "person", "member", "engineer"), found(low, TEAM)))
    team = F.when(said.isNotNull(), F.concat(F.regexp_extract(said, TEAM, 1), F.lit("-person "), F.regexp_extract(said, TEAM, 3), F.lit(" team")))
    stage = F.when(has(near, STARTUP), "Startup").when(has(near, SCALEUP), "Scale-up").when(has(near, ENTERPRISE), "Enterprise").otherwise("Unknown")
    return F.struct(mentor.alias("mentorship"), growth.alias("growth"), (mentor | growth).alias("learning"), team.alias("team_size"), stage.alias("stage"))


def parse_postings(df: DataFrame, cfg: ParserConfig, description: str = "description", title: str = "title", location: str = "location") -> DataFrame:
    """Adds reasons, graduate, domain, tech, place, company_signals, suitable, confidence, description_length and has_description.

    The text is lower-cased once, each list of phrases is looked for once, and the signals are put together from what was
    found. An empty or null description is ruled out with one fixed reason and confidence 0.
    """
    raw = F.coalesce(F.col(description), F.lit(""))
    t = df.withColumns({"parse_low": F.lower(raw), "parse_head": F.lower(F.coalesce(F.col(title), F.lit("")))})
    t = t.withColumn("parse_spots", spots(F.col("parse_low")))
    low, head, near = F.col("parse_low"), F.col("parse_head"), F.col("parse_spots")
    empty = raw == ""
    step = Steps()
    signals = {"reasons": dealbreakers(low, head, cfg, step, near), "graduate": graduate_signals(near, head, step), "domain": domains(near, step), "tech": tech_stack(low, cfg, step=step), "place": location_visa(low, F.col(location), cfg, step, near), "company_signals": company_signals(low, step, near)}
    signals["reasons"] = F.when(empty, F.array(F.lit("No description provided"))).otherwise(signals["reasons"])
    for name, column in step.columns.items():  # in order, as later ones read earlier ones; Spark merges what it can
        t = t.withColumn(name, column)
    t = t.withColumns(signals).drop(*step.columns)
    ok = (F.size("reasons") == 0) & (F.col("graduate.accepts_fresh_grads") | F.coalesce(F.col("graduate.years_required") <= 2, F.lit(False)))
    add = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0.0))
    sure = F.lit(0.5) + add(F.size("reasons") > 0, 0.2) + add(F.col("graduate.years_required").isNotNull(), 0.15) + add(F.col("graduate.explicit_graduate"), 0.2) + add(F.col("domain.is_ai_ml_role"), 0.1) + add(F.size("tech.required") > 0, 0.15) + add(F.col("place.primary_city").isNotNull(), 0.1)
    return t.withColumns({"suitable": ok & ~empty, "confidence": F.when(empty, 0.0).otherwise(F.round(F.least(F.lit(1.0), sure), 4)), "description_length": F.length(raw), "has_description": F.length(strip(raw)) > 100}).drop("parse_low", "parse_head", "parse_spots")
