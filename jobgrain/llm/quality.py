"""Quality rules as a bitmask ledger: every rule is evaluated once, policies and ablations only combine bits."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import CONTINUATION, SPACES

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails the rule where the SQL condition over the measurements holds."""

    name: str
    fails: str


#: Bit i of failed_rules belongs to RULES[i]. New rules go to the end, so that stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_lines > 3 AND 2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("shouting", "10 * n_exclamations > 3 * n_words"),
    Rule("repeated_text", "n_words >= 50 AND 100 * n_repeat_words > 50 * n_words"),
    Rule("no_words", "n_words = 0"),
)

#: A policy is a version and the names of the rules it enforces. v3 leaves short texts alone: those labelled good fail no other rule.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"),
    "v3": ("no_words", "repeated_text", "symbols", "repeated_lines", "word_length", "shouting"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_exclamations")


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        until = 0  # the first word that no repeated window has covered yet
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 3 - max(i, until)
                until = i + 3
    return (
        len(words),
        len(text.translate(None, SPACES + CONTINUATION)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        text.count(b"!"),
    )


def mask_of(names) -> int:
    at = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << at[x] for x in set(names))


def _measured(rows: DataFrame) -> DataFrame:
    """rows of two columns, the second a binary text: the first one with the measurements and failed_rules."""
    name = rows.columns[0]

    def batches(it):
        for b in it:
            got = [measure(x or b"") for x in b.column(1).to_pylist()]
            columns = zip(*got, strict=True) if got else ([] for _ in MEASURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=[name, *MEASURES])

    measured = rows.mapInArrow(batches, f"`{name}` {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)]
    return measured.withColumn("failed_rules", sum(bits[1:], bits[0]).cast("int"))


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, the measurements, failed_rules (bit i: it fails RULES[i]).

    A null text has no words. Documents are measured whole, one at a time, where they are read: nothing is shuffled.
    Repeated rows and null ids are rows like any other; other columns are ignored; an empty table gives no rows.
    """
    return _measured(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("binary").alias("text_bytes")))


def apply_policy(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed (a rule of v1 failed) and kept (no rule that the policy enforces failed)."""
    base, mask = mask_of(POLICIES["v1"]), mask_of(POLICIES[version])
    bits = F.col("failed_rules")
    return ledger.withColumns({"base_failed": bits.bitwiseAND(base) != 0, "kept": bits.bitwiseAND(mask) == 0})


def ablate(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of a policy: rule, n_failed, n_only (failed by it alone), n_kept_without (kept if it were dropped).

    The ledger is first counted by failed_rules, of which there are at most 2 ** len(RULES) values, so that only those
    counts are shuffled, however many documents there are.
    """
    mask = mask_of(POLICIES[version])
    bits = F.col("failed_rules").bitwiseAND(mask)
    counts = ledger.select(bits.alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).alias("bit")) for i, r in enumerate(RULES) if mask >> i & 1)))
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return counts.withColumn("r", rules).groupBy(F.col("r.rule").alias("rule")).agg(of(hit)("n_failed"), of(alone)("n_only"), of((F.col("bits") == 0) | alone)("n_kept_without"))


def keep_good(docs: DataFrame, version: str = "v3", text_col: str = "text") -> DataFrame:
    """docs without the rows that the policy rejects, all columns kept, whatever their names.

    The whole row travels through the measuring step, so that no join is needed. A null or empty text has no words and
    goes; repeated rows and null ids stay or go like others; an empty table gives no rows.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    ledger = _measured(docs.select(row.alias("row"), F.col(f"`{text_col}`").cast("binary").alias("text_bytes")))
    return apply_policy(ledger, version).where("kept").select("row.*")
