"""Text columns: normalised names, hashes and word similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space, written out because engines disagree about \s.
WS = r"[ \t\n\r\x0B\f]"
#: Endings of company names, removed one after the other, once each.
COMPANY_ENDINGS = (
    rf"{WS}+pty\.?{WS}+ltd\.?$", rf"{WS}+pty$", rf"{WS}+ltd\.?$", rf"{WS}+limited$", rf"{WS}+inc\.?$", rf"{WS}+incorporated$", rf"{WS}+corp\.?$",
    rf"{WS}+corporation$", rf"{WS}+llc$", rf"{WS}+llp$", rf"{WS}+plc$", rf"{WS}+gmbh$", rf"{WS}+pty{WS}+limited$",
)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def normalize_company(company: Column, strict: bool = True) -> Column:
    """Lower case, without legal endings, single spaces; null becomes ''. Each ending is removed once, in their order, so
    'X Pty Limited' keeps its 'pty'; strict=False goes over the endings again until nothing is left of them."""
    name = strip(F.lower(F.coalesce(company, F.lit(""))))
    for _ in range(1 if strict else 3):
        for ending in COMPANY_ENDINGS:
            name = F.regexp_replace(name, ending, "")
    return strip(F.regexp_replace(name, rf"{WS}+", " "))


def job_hash(title: Column, company: Column, url: Column | None = None) -> Column:
    """Identity of a posting: sha256 of title, normalised company and url; without url, its identity across boards."""
    parts = [F.coalesce(title, F.lit("")), F.lit("|"), normalize_company(company)]
    if url is not None:
        parts += [F.lit("|"), F.coalesce(url, F.lit(""))]
    return F.sha2(F.lower(F.concat(*parts)), 256)


def legacy_hash(title: Column, company: Column, url: Column) -> Column:
    """md5 of the three as they are, one after the other."""
    return F.md5(F.concat(*(F.coalesce(c, F.lit("")) for c in (title, company, url))))


def content_hash(text: Column, algo: str = "sha256") -> Column:
    """Hash of a whole text, to see whether it has changed."""
    text = F.coalesce(text, F.lit(""))
    return F.md5(text) if algo == "md5" else F.sha2(text, 256)


def cleaned(text: Column) -> Column:
    """Letters, digits, underscores and white space only, stripped; null becomes ''."""
    return strip(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}_ \t\n\r\x0B\f]", ""))


def word_set(clean: Column) -> Column:
    """The distinct words of a cleaned text."""
    return F.array_distinct(F.filter(F.split(clean, rf"{WS}+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both))


def word_jaccard(a: Column, b: Column) -> Column:
    return jaccard(word_set(cleaned(a)), word_set(cleaned(b)))


def fuzzy_match(a: Column, b: Column, basis_points: int = 8500) -> Column:
    """Equal once cleaned, or word sets that share at least basis_points / 10000 (exact in integers)."""
    x, y = word_set(cleaned(a)), word_set(cleaned(b))
    both = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - both
    return (cleaned(a) == cleaned(b)) | ((F.size(x) > 0) & (F.size(y) > 0) & (both * 10000 >= union * basis_points))
