"""A kept index of a posting store: what a batch of postings needs to know of the store, found without reading the store.

Five tables lie under one folder, each dealt into buckets by its key: first words of titles and companies (see similar),
urls, posting hashes with the day they were stored, and the days on which they were seen again. A batch reads the
buckets of its own keys, joins them with its own rows, and adds a delta; deltas are folded into a new base from
time to time. Every write overwrites the folder of its batch, and a batch reads only what earlier ones have written, so
a batch that runs again after a failure sees and leaves the same.

    path/order/base=B                               the order of words that base B and its deltas are written in
    path/<table>/base=B/batch=N/bucket=K            rows of base B (batch = B) and of the batches after it
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.functions import folders
from jobgrain.functions.scratch import discard, materialize
from jobgrain.functions.text import job_hash
from jobgrain.operators import similar

_ROW = "job_id long, job_id_hash string"
_TABLES = {
    "words": (("kt", "kc"), f"t string, c string, tw array<string>, cw array<string>, nt int, nc int, bt long, bc long, kt string, pt int, kc string, pc int, {_ROW}"),
    "urls": (("url",), "url string, job_id_hash string"),
    "stored": (("job_id_hash",), f"{_ROW}, day date"),
    "seen": (("job_id_hash",), "job_id_hash string, day date"),
}
#: The base that is built of a store, before any batch.
FIRST = -1


class StoreIndex:
    """buckets: how finely tables are dealt; a batch of few keys reads few of them. fold_every: batches between two bases."""

    def __init__(self, spark: SparkSession, path: str, basis_points: int = 8500, buckets: int = 64, fold_every: int = 20):
        self.spark, self.path, self.basis_points, self.buckets, self.fold_every = spark, path, basis_points, buckets, fold_every
        self._orders: dict[int, similar.WordOrder] = {}
        self._scratch: list[DataFrame] = []

    # -- writing

    def _bucket(self, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _write(self, name: str, rows: DataFrame, base: int, batch: int) -> None:
        keys, schema = _TABLES[name]
        columns = [c.split()[0] for c in schema.split(", ")]
        rows = rows.select(*columns).withColumn("bucket", self._bucket(*keys))
        folders.by_partition(rows, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/base={base}/batch={batch}")

    def _write_rows(self, rows: DataFrame, day: Column, order: similar.WordOrder, base: int, batch: int) -> None:
        """rows: job_id, title, company, url, job_id_hash."""
        texts = rows.select("job_id", "job_id_hash", *similar.clean_texts(F.col("title"), F.col("company")))
        self._write("words", similar.entries(texts, order, self.basis_points), base, batch)
        self._write("urls", rows.where("url IS NOT NULL"), base, batch)
        self._write("stored", rows.withColumn("day", day), base, batch)

    def _settle(self, order: similar.WordOrder, base: int) -> None:
        """The base counts from now on."""
        self.spark.createDataFrame([(json.dumps(asdict(order)),)], "words string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/order/base={base}")

    def build(self, store: DataFrame) -> None:
        """The first base, from a store (job_id, title, company, url, last_seen_date), unless there is one."""
        if FIRST in folders.numbers(self.spark, f"{self.path}/order", "base"):
            return
        rows = store.select("job_id", "title", "company", "url", "last_seen_date", job_hash(F.col("title"), F.col("company"), F.col("url")).alias("job_id_hash"))
        rows = materialize(rows, "store")  # a store is read once, whatever its columns are made of
        order = similar.WordOrder.of(rows.select(*similar.clean_texts(F.col("title"), F.col("company"))))
        self._write_rows(rows, F.col("last_seen_date").cast("date"), order, FIRST, FIRST)
        self._write("seen", rows.where("false").withColumn("day", F.lit(None).cast("date")), FIRST, FIRST)
        self._settle(order, FIRST)
        discard(rows)

    def add(self, batch: int, taken: DataFrame, touched: DataFrame, as_of) -> None:
        """What a batch has taken (job_id, title, company, url, job_id_hash) and which stored hashes it has seen again, on as_of."""
        base, order = self._base(batch)
        day = F.lit(as_of).cast("date")
        self._write_rows(taken, day, order, base, batch)
        self._write("seen", touched.select("job_id_hash", day.alias("day")), base, batch)
        if batch - base >= self.fold_every:
            self.fold(batch)

    def fold(self, batch: int) -> None:
        """A new base of everything up to a batch, in which each hash has one last day; the word order stays. Bases before the last
        one go."""
        base, order = self._base(batch + 1)
        if base == batch:
            return
        for name in _TABLES:
            rows = self._read(name, base, batch + 1)
            self._write(name, rows.groupBy("job_id_hash").agg(F.max("day").alias("day")) if name == "seen" else rows, batch, batch)
        self._settle(order, batch)
        for old in folders.numbers(self.spark, f"{self.path}/order", "base"):
            if old < base:
                folders.delete(self.spark, f"{self.path}/order/base={old}")
                for name in _TABLES:
                    folders.delete(self.spark, f"{self.path}/{name}/base={old}")

    # -- reading

    def _base(self, before: int) -> tuple[int, similar.WordOrder]:
        """The last base whose rows all come from before a batch, and its order of words."""
        base = max(n for n in folders.numbers(self.spark, f"{self.path}/order", "base") if n < before)
        if base not in self._orders:  # bases do not change
            words = json.loads(self.spark.read.parquet(f"{self.path}/order/base={base}").first().words)
            self._orders = {base: similar.WordOrder(**{k: tuple(v) for k, v in words.items()})}
        return base, self._orders[base]

    def _read(self, name: str, base: int, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table that earlier batches have written; only some buckets of it are read."""
        _, schema = _TABLES[name]
        path = f"{self.path}/{name}/base={base}"
        rows = folders.read_or_empty(self.spark, path, f"{schema}, batch int, bucket int").where(F.col("batch") < before)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets)) if buckets else rows.where("false")
        return rows.drop("batch", "bucket")

    def _buckets(self, keys: dict[str, tuple[DataFrame, tuple[str, ...]]]) -> dict[str, dict[int, int]]:
        """For each name which buckets the keys of some rows fall into, and how many rows: no more than there are buckets."""
        asked = None
        for name, (df, columns) in keys.items():
            one = df.select(F.lit(name).alias("name"), self._bucket(*columns).alias("b"))
            asked = one if asked is None else asked.unionByName(one)
        found: dict[str, dict[int, int]] = {name: {} for name in keys}
        for r in asked.groupBy("name", "b").agg(F.count("*").alias("n")).collect():
            found[r.name][r.b] = r.n
        return found

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        """df, written on the way until release()."""
        self._scratch.append(materialize(df, tag))
        return self._scratch[-1]

    def release(self) -> None:
        """Deletes what look_up() and keep() have written on the way, once nothing reads their results any more."""
        while self._scratch:
            discard(self._scratch.pop())

    def look_up(self, batch: DataFrame, before: int, window_days: int | None, as_of) -> tuple[DataFrame, DataFrame, DataFrame]:
        """What earlier batches and the store know of a batch (job_id, url, job_id_hash, title, company): by_url, by_fuzzy and hashes, as
        ingest.settle takes them. Urls and fuzzy matches count if their rows were seen within the window.

        The batch's keys go to every task that reads their buckets, so the shuffles that follow hold what has matched. A batch of
        very many rows is dealt by its keys instead.
        """
        base, order = self._base(before)
        asking = self.keep(batch.select("job_id", "url", "job_id_hash", *similar.clean_texts(F.col("title"), F.col("company"))), "asking")
        small = similar.is_small(asking)
        send = F.broadcast if small else (lambda df: df)
        classes = asking.select("t", "c").distinct()
        probes = self.keep(similar.probes(similar.entries(classes, order, self.basis_points), self.basis_points), "probes")
        asked = self._buckets({"words": (probes, ("q_kt", "q_kc")), "urls": (asking.where("url IS NOT NULL"), ("url",)), "stored": (asking, ("job_id_hash",))})
        words, urls, stored = (self._read(n, base, before, sorted(asked[n])) for n in ("words", "urls", "stored"))
        pairs = similar.matches(probes, words, self.basis_points, small).select("q_t", "q_c", F.col("job_id").alias("existing_key"), F.col("job_id_hash").alias("met"), "similarity")
        same_url = urls.join(send(asking.select("url").distinct()), "url", "left_semi").select(F.col("url").alias("q_t"), F.lit(None).cast("string").alias("q_c"), F.lit(None).cast("long").alias("existing_key"), F.col("job_id_hash").alias("met"), F.lit(None).cast("double").alias("similarity"))
        found = self.keep(pairs.unionByName(same_url), "found")
        hashes = self.keep(found.select(F.col("met").alias("job_id_hash")).distinct(), "hashes")
        days = self._days(base, before, hashes)
        if window_days is not None:
            days = days.where(F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), window_days))
        days = days.select(F.col("job_id").alias("day_key"), F.col("job_id_hash").alias("day_met"))
        near = found.where("q_c IS NOT NULL").join(days, [F.col("existing_key") == F.col("day_key"), F.col("met") == F.col("day_met")])
        best = near.groupBy("q_t", "q_c").agg(F.max_by("met", F.struct("similarity", (-F.col("existing_key")).alias("k"))).alias("by_fuzzy"))
        by_fuzzy = asking.select("job_id", F.col("t").alias("q_t"), F.col("c").alias("q_c")).join(best, ["q_t", "q_c"]).select("job_id", "by_fuzzy").dropDuplicates(["job_id"])
        by_url = found.where("q_c IS NULL").join(days.select("day_met").distinct(), F.col("met") == F.col("day_met")).groupBy(F.col("q_t").alias("url")).agg(F.min("met").alias("by_url"))
        known = stored.join(send(asking.select("job_id_hash").distinct()), "job_id_hash", "left_semi").select("job_id_hash").distinct()
        return by_url, by_fuzzy, known

    def _days(self, base: int, before: int, hashes: DataFrame | None = None) -> DataFrame:
        """job_id, job_id_hash, day of stored rows (of some distinct hashes alone): the last day on which each was seen."""
        buckets = None if hashes is None else self._buckets({"hashes": (hashes, ("job_id_hash",))})["hashes"]
        seen, stored = (self._read(n, base, before, None if buckets is None else sorted(buckets)) for n in ("seen", "stored"))
        if hashes is not None:
            mine = F.broadcast(hashes) if sum(buckets.values()) <= similar.ASKING_ROWS else hashes
            seen, stored = (df.join(mine, "job_id_hash", "left_semi") for df in (seen, stored))
        again = seen.groupBy("job_id_hash").agg(F.max("day").alias("again"))
        return stored.join(again, "job_id_hash", "left").select("job_id", "job_id_hash", F.greatest("day", "again").alias("day"))

    def states(self, before: int) -> DataFrame:
        """job_id, job_id_hash, day of every stored row, as earlier batches have left it."""
        return self._days(self._base(before)[0], before)
