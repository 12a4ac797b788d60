"""Token ids of a corpus in files that give any token without decoding others."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobgrain.llm.dac import Codes, pack
from jobgrain.llm.tokens import tokenizer

#: Ids of a segment, about: a document is never cut, so its last one may run over.
SEGMENT = 1 << 20
#: Positions looked up by blocks of so many.
BLOCK = 1 << 20


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends end_id, and writes all ids in ascending id order under path.

    The files are Parquet, committed by Spark's writer so that a lost task leaves nothing behind; each row is a segment:
    part, seq and before (its place in the order, and the ids of its part before it), doc_ids, ends (ids up to the end of each document), n_tokens, code (see dac).
    Parts are ranges of id, then of the text's hash and the row's number, so that an id that very many rows repeat
    (null among them) is still several parts; sorted within, so one pass writes them and no task holds more than a segment.

    A null text is empty. Null ids come first, repeated ids in the order of their texts' hash. Ids are integers or strings.
    Other columns are ignored; an empty table gives files without rows.
    """
    id_type = docs.schema[id_col].dataType
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text_bytes"))
    order = ["id", "h", "nth"]
    ordered = slim.withColumns({"h": F.xxhash64("text_bytes"), "nth": F.monotonically_increasing_id()}).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text_bytes")
    kind = pa.int64() if id_type.simpleString() in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def segments(it):
        part, seq = TaskContext.get().partitionId(), 0
        ids, pieces, size, before = [], [], 0, 0

        def full():
            ends = np.cumsum([len(x) for x in pieces])
            code = pack(np.concatenate(pieces))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([int(ends[-1])], pa.int64()), pa.array([code], pa.binary())], names=["part", "seq", "before", "doc_ids", "ends", "n_tokens", "code"])

        for b in it:
            got = tokenizer(tokenizer_path).encode(b.column(1).to_pylist())
            for key, x in zip(b.column(0).to_pylist(), got, strict=True):
                ids.append(key)
                pieces.append(np.append(x, np.uint32(end_id)))
                size += len(pieces[-1])
                if size >= SEGMENT:
                    yield full()
                    ids, pieces, size, seq, before = [], [], 0, seq + 1, before + size
        if ids:
            yield full()

    names = "bigint" if kind == pa.int64() else "string"
    ordered.mapInArrow(segments, f"part int, seq int, before bigint, doc_ids array<{names}>, ends array<bigint>, n_tokens bigint, code binary").write.mode("overwrite").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with base: the ids before each in the whole order. Only the parts' totals meet in one place and are
    broadcast: one number for each partition that wrote the files."""
    rows = spark.read.parquet(path)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    return rows.join(F.broadcast(parts), "part").withColumn("base", F.col("part_base") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Decodes the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers), ids. doc_id is a long or a string, as the files hold it."""
    held = segments(spark, path)
    id_type = held.schema["doc_ids"].dataType.elementType.simpleString()

    def decode(it):
        for b in it:
            for row in b.to_pylist():
                ends, code = np.array(row["ends"]), Codes(row["code"])
                starts = np.concatenate(([0], ends[:-1]))
                texts = [code.slice(s, e).astype("<u4") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64() if id_type == "bigint" else pa.string()), pa.array(starts + row["base"], pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in texts], pa.int64()), pa.array([x.tobytes() for x in texts], pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return held.select("doc_ids", "ends", "base", "code").mapInArrow(decode, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, ids binary")


def tokens_at(positions: DataFrame, path: str) -> DataFrame:
    """positions (position long) -> position, token: ids at places in the whole order, each reached by rank alone.

    Positions outside the corpus and null ones are dropped. Positions meet their segment by block number, an equi-join.
    """
    held = segments(positions.sparkSession, path).withColumn("end", F.col("base") + F.col("n_tokens"))
    held = held.withColumn("block", F.explode(F.sequence(F.expr(f"base div {BLOCK}"), F.expr(f"(end - 1) div {BLOCK}"))))
    asked = positions.select("position", F.expr(f"position div {BLOCK}").alias("block"))
    met = asked.join(held, "block").where("position >= base AND position < end")
    places = met.groupBy("part", "seq").agg(F.sort_array(F.collect_list("position")).alias("positions"))

    def look_up(it):
        for b in it:
            for row in b.to_pylist():
                code = Codes(row["code"])
                yield pa.RecordBatch.from_arrays([pa.array(row["positions"], pa.int64()), pa.array([code[p - row["base"]] for p in row["positions"]], pa.int64())], names=["position", "token"])

    return places.join(segments(positions.sparkSession, path), ["part", "seq"]).select("positions", "base", "code").mapInArrow(look_up, "position long, token long")
