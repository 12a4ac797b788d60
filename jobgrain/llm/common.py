"""Shared pieces: word splitting, scratch tables in the shared folder, and connected components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.functions.names import spare
from jobgrain.functions.scratch import discard, materialize  # noqa: F401  (the other modules take them from here)

#: The bytes that separate words (space and 0x09-0x0D). bytes.split() splits at exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: Fixed value: a word, as a pattern.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that continue a character in UTF-8; the others each begin one.
CONTINUATION = bytes(range(0x80, 0xC0))


def placed(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs, and where each of its rows is stored: the file and the row's number in it, which parts equal rows and is the same however a
    scan is split. Rows that are not those of Parquet files are written to the shared folder first."""
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        if "_metadata" not in docs.columns:
            docs.select(place)
            return docs, place
    except AnalysisException:
        pass
    (name,) = spare(docs, "stored_row")
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), F.col(name).cast("string")


def count_words(text: Column) -> Column:
    """Words in a text (null: 0): the pieces between runs of space, less an empty one at either end. In linear time."""
    blank = lambda c: c.rlike(r"[\x20\x09-\x0D]").cast("int")
    pieces = F.size(F.split(text, r"[\x20\x09-\x0D]+")) - blank(F.substring(text, 1, 1)) - blank(F.substring(text, -1, 1))
    return F.when(F.coalesce(text, F.lit("")) == "", 0).otherwise(pieces).cast("long")


def numbered(df: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Adds nth: each row's number from 0 among those of equal keys, in the order of `row`, a monotonically increasing id.

    Rows are numbered within the partition that gave the id, after the counts of the partitions before, so no window
    holds more than a partition's rows of a key.
    """
    part = F.shiftright(row, 33)
    inside = df.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "part").orderBy(row)) - 1)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, part.alias("part")).agg(F.count("*").alias("m")).withColumn("ahead", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    counts = counts.select(*(F.col(c).alias(f"key_{c}") for c in keys), F.col("part").alias("key_part"), "ahead")
    met = inside.join(counts, [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in (*keys, "part")])
    return met.withColumn("nth", F.col("nth") + F.col("ahead")).select(*df.columns, "nth")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Columns a, b (long) -> node, component: each node of an edge with the smallest node it can reach.

    Alternates the large-star and small-star steps: every node hooks its larger, then its smaller neighbours to its
    smallest neighbour, until the edges are stars. Minima are partially aggregated before each shuffle, and the join
    that follows has one row a node on one side, so a hub's edges can be split. Rounds grow with the logarithm of the
    longest path. Nulls and loops are left out; repeated edges count once.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        told = mark(after)
        discard(now)
        now, stable, before = after, told == before, told
        if stable:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
