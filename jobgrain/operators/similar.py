"""An exact join of postings whose titles and company names are both alike, by word sets.

Two sets that share a fraction of their words share one of their first words in any one order of words, so only rows meet that
share a first word of the title and of the company, and have sizes that allow it. Before two rows are compared word by
word, the places of the shared words and 64-bit signatures of the sets bound how much they can share. A pair counts where
its first common words meet, so it comes out once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.functions.text import cleaned, normalize_company, word_set

#: Frequent words that are put last in the order, at most; they are named in the plan.
FREQUENT = 200
#: Rows that ask, and bytes of their texts, up to which they are sent to every task; the other side then stays where it is.
ASKING_ROWS, ASKING_BYTES = 100_000, 8 << 20
#: Pairs beyond which a cell of rows that share keys is cut, and rows of one side in a part of it, about.
CELL, PART = 1 << 22, 2_048


@dataclass(frozen=True)
class WordOrder:
    """One order of words for both sides of a join: words that are frequent come last, the others by their hash."""

    title: tuple[str, ...] = ()
    company: tuple[str, ...] = ()

    @classmethod
    def of(cls, texts: DataFrame) -> WordOrder:
        """From columns t and c of some texts; which ones changes the cost of a join, never its rows."""
        found = []
        for c in ("t", "c"):
            words = texts.select(F.explode(word_set(F.col(c))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
            found.append(tuple(r.word for r in words.where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT).collect()))
        return cls(*found)


def _sorted(words: str, frequent: tuple[str, ...]) -> Column:
    """A column of word sets in order: rare words, then the frequent ones, the most frequent last of all. Words are letters, digits
    and underscores, which a literal holds as they are."""
    listed = lambda some: ", ".join(f"'{w}'" for w in some)
    tiers = [f"WHEN w IN ({listed(some)}) THEN {tier}" for tier, some in ((2, frequent[:10]), (1, frequent[10:])) if some]
    tier = f"CASE {' '.join(tiers)} ELSE 0 END" if tiers else "0"
    return F.expr(f"transform(array_sort(transform({words}, w -> struct({tier} AS tier, xxhash64(w) AS h, w AS w))), x -> x.w)")


def _signature(words: Column) -> Column:
    """64 bits, one set for each word."""
    one = F.lit(1).cast("long")
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseOR(F.call_function("shiftleft", one, F.pmod(F.xxhash64(w), F.lit(64)).cast("int"))))


def clean_texts(title: Column, company: Column) -> list[Column]:
    """t and c: what of a posting is compared."""
    return [cleaned(F.lower(title)).alias("t"), cleaned(normalize_company(company)).alias("c")]


def entries(texts: DataFrame, order: WordOrder, basis_points: int) -> DataFrame:
    """texts (t, c and other columns), once for each pair of first words: kt, kc, with places pt, pc, sizes nt, nc, signatures bt, bc and
    the sorted sets tw, cw. A set of n words has n - ceil(n * basis_points / 10000) + 1 first words; an empty one has ''."""

    def firsts(words: str, n: str, key: str, at: str) -> Column:
        keep = F.col(n) - F.expr(f"({n} * {basis_points} + 9999) div 10000").cast("int") + 1
        some = F.transform(F.slice(words, 1, keep), lambda w, i: F.struct(w.alias(key), i.alias(at)))
        return F.when(F.col(n) == 0, F.array(F.struct(F.lit("").alias(key), F.lit(0).alias(at)))).otherwise(some)

    rows = texts.withColumns({"tw": word_set(F.col("t")), "cw": word_set(F.col("c"))})
    rows = rows.withColumns({"tw": _sorted("tw", order.title), "cw": _sorted("cw", order.company)})
    rows = rows.withColumns({"nt": F.size("tw"), "nc": F.size("cw"), "bt": _signature(F.col("tw")), "bc": _signature(F.col("cw"))})
    rows = rows.withColumn("at_t", F.explode(firsts("tw", "nt", "kt", "pt"))).withColumn("at_c", F.explode(firsts("cw", "nc", "kc", "pc")))
    return rows.select(*[c for c in rows.columns if c not in ("at_t", "at_c")], "at_t.*", "at_c.*")


def probes(asking: DataFrame, basis_points: int) -> DataFrame:
    """Entries of the asking side, once for each pair of sizes (mt, mc) that the other side may have; columns begin with q_."""
    sizes = lambda n: F.explode(F.sequence(F.expr(f"CAST(({n} * {basis_points} + 9999) div 10000 AS INT)"), F.expr(f"CAST({n} * 10000 div {basis_points} AS INT)")))
    rows = asking.withColumn("mt", sizes("nt")).withColumn("mc", sizes("nc"))
    return rows.select(*(F.col(c).alias(f"q_{c}") for c in rows.columns))


def _alike(basis_points: int, side: str) -> tuple[Column, Column]:
    """Whether sets can be as alike as asked, by places and signatures, and whether they are and meet at their first common word."""
    n, m, p, r = (F.col(x) for x in (f"q_n{side}", f"n{side}", f"q_p{side}", f"p{side}"))
    need = F.expr(f"({basis_points} * (q_n{side} + n{side}) + {9999 + basis_points}) div {10000 + basis_points}")
    left = F.least(n - p, m - r)
    can = (n == 0) | ((left >= need) & (F.bit_count(F.col(f"q_b{side}").bitwiseXOR(F.col(f"b{side}"))) <= n + m - 2 * need))
    both = F.array_intersect(f"q_{side}w", f"{side}w")
    are = (F.size(both) * 10000 >= (n + m - F.size(both)) * basis_points) & (F.coalesce(F.get(both, F.lit(0)), F.lit("")) == F.col(f"q_k{side}"))
    return can, are


def is_small(asking: DataFrame) -> bool:
    n, size = asking.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t") + F.octet_length("c")), F.lit(0))).first()
    return n <= ASKING_ROWS and size <= ASKING_BYTES


def matches(asking: DataFrame, stored: DataFrame, basis_points: int, small: bool) -> DataFrame:
    """Pairs of probes() and entries() that are alike in both sets, with all columns of both and similarity, the shared fraction of the titles.

    A small asking side goes to every task, and stored rows stay where they are read. Otherwise both sides are dealt by
    their keys, and a cell of very many pairs is cut into parts that meet pairwise, so that no task has more
    than its share.
    """
    keys = ("kt", "kc", "nt", "nc")
    names = {"kt": "q_kt", "kc": "q_kc", "nt": "q_mt", "nc": "q_mc"}
    on = [F.col(names[k]) == F.col(k) for k in keys]
    if small:
        met = stored.join(F.broadcast(asking), on)
    else:
        count = lambda df, by, n: df.groupBy(*(F.col(c).alias(k) for k, c in by)).agg(F.count("*").alias(n))
        cells = count(asking, names.items(), "a").join(count(stored, zip(keys, keys, strict=True), "b"), list(keys)).where(F.col("a") * F.col("b") > CELL)
        cells = cells.select(*(F.col(k).alias(f"hot_{k}") for k in keys), *((F.floor((F.col(n) - 1) / PART) + 1).cast("int").alias(n) for n in ("a", "b")))
        parts = lambda n: F.coalesce(n, F.lit(1))
        nth = lambda t, c, n: F.pmod(F.xxhash64(t, c), parts(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), parts(n) - 1))
        left = asking.join(cells, [F.col(names[k]) == F.col(f"hot_{k}") for k in keys], "left").withColumn("q_i", nth("q_t", "q_c", "a")).withColumn("q_j", every("b")).drop("a", "b", *(f"hot_{k}" for k in keys))
        right = stored.join(cells, [F.col(k) == F.col(f"hot_{k}") for k in keys], "left").withColumn("j", nth("t", "c", "b")).withColumn("i", every("a")).drop("a", "b", *(f"hot_{k}" for k in keys))
        met = left.join(right, [*on, F.col("q_i") == F.col("i"), F.col("q_j") == F.col("j")]).drop("i", "j", "q_i", "q_j")
    can_t, are_t = _alike(basis_points, "t")
    can_c, are_c = _alike(basis_points, "c")
    both = F.size(F.array_intersect("q_tw", "tw"))
    share = F.when(F.col("q_t") == F.col("t"), 1.0).otherwise(both.cast("double") / (F.col("q_nt") + F.col("nt") - both))
    return met.where(can_t & can_c).where(are_c & are_t).withColumn("similarity", share)
