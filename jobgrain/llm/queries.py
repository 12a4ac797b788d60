"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobgrain.functions.scratch import scratch
from jobgrain.llm import chat, embedding, linetext, lm, mixing, packing, pieces, quality, runs, search, simhash, suffixes, token_files
from jobgrain.llm.common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = materialize(quality.rule_ledger(_table(spark, sf_dir, "documents")), "ledger")
    return quality.apply_policy(ledger).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op1_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablate(materialize(quality.rule_ledger(_table(spark, sf_dir, "documents")), "ledger"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "ids")
    token_files.write_ids(_table(spark, sf_dir, "documents"), path, word_tokenizer(), end_id=2)
    return token_files.read_documents(spark, path).drop("ids")


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.preference_pairs(chat.repeat_negatives(_table(spark, sf_dir, "conversations")))
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return pairs.select(F.col("pair_id").alias("conv_id"), "prompt", "n_prompt_turns", "chosen", told("chosen_mask").alias("chosen_mask"), "rejected", told("rejected_mask").alias("rejected_mask"))


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linetext.extract_text(_table(spark, sf_dir, "pages"))


def op8_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_passages(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_config_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), word_tokenizer(), end_id=0)
    return packed.withColumnRenamed("id", "doc_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", runs.looped(F.col("text"), F.col("doc_id")).alias("text"))
    found = runs.collapse_runs(docs).withColumn("best", runs.most_periodic(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    best = [F.col(f"best.{c}") for c in ("start", "length", "period")]
    exponent = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), *best, exponent, F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")


def op13_piece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_pieces(_table(spark, sf_dir, "documents"), piece_model(), decode=True)
    covered = F.aggregate(F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0), lambda x, y: x + y).cast("long").alias("n_bytes")
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), covered)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op1_rule_ablation": op1_rule_ablation,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_token_files": op3_token_files,
    "op4_entropy_mix": op4_entropy_mix,
    "op5_preference_chat": op5_preference_chat,
    "op6_backoff_lm": op6_backoff_lm,
    "op7_line_blocks": op7_line_blocks,
    "op8_sparse_suffixes": op8_sparse_suffixes,
    "op9_config_packing": op9_config_packing,
    "op10_simhash": op10_simhash,
    "op11_reversed_search": op11_reversed_search,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_piece_spans": op13_piece_spans,
}

_OP1 = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs)),
grams AS (SELECT rid, i, w || chr(1) || lead(w) OVER o || chr(1) || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
hits AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams WHERE g IS NOT NULL) WHERE c > 1),
repeats AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS j FROM hits) GROUP BY rid),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS d FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
sizes AS (SELECT rid, count(*) AS n, sum(length(w)) AS c FROM words GROUP BY rid),
ledger AS (
  SELECT d.doc_id, coalesce(s.n, 0) AS n_words, coalesce(s.c, 0) AS word_chars, length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.d, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, length(regexp_replace(d.text, '[^!]', '', 'g')) AS n_exclamations
  FROM docs d LEFT JOIN sizes s USING (rid) LEFT JOIN lines l USING (rid) LEFT JOIN repeats r USING (rid)),
bits AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_lines > 3 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN 10 * n_exclamations > 3 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN n_words >= 50 AND 100 * n_repeat_words > 50 * n_words THEN 64 ELSE 0 END) + (CASE WHEN n_words = 0 THEN 128 ELSE 0 END) AS failed_rules
  FROM ledger)
"""

_TURN = "'<|' || {0}.role || '|>' || chr(10) || {0}.text || '<|end|>' || chr(10)"

ORACLE_SQL = {
    "op1_quality_rules": _OP1 + """SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_rules & 3 <> 0 AS base_failed, failed_rules & 63 = 0 AS kept, CAST(failed_rules AS INTEGER) AS failed_rules FROM bits""",
    "op1_rule_ablation": _OP1 + """SELECT r.rule, CAST(sum(CASE WHEN failed_rules & r.bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_failed, CAST(sum(CASE WHEN failed_rules & 63 = r.bit THEN 1 ELSE 0 END) AS BIGINT) AS n_only,
  CAST(sum(CASE WHEN failed_rules & 63 IN (0, r.bit) THEN 1 ELSE 0 END) AS BIGINT) AS n_kept_without
FROM bits CROSS JOIN (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('shouting', 32)) AS r(rule, bit) GROUP BY r.rule""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component AS component_id, vec_id = c.component AS kept FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a""",
    "op5_preference_chat": f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS n, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
ends AS (SELECT conv_id, max(n) AS last, min(n) AS first FROM t WHERE role = 'assistant' GROUP BY conv_id),
said AS (SELECT t.conv_id, t.text AS said FROM t JOIN ends e ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.n = e.first),
c AS (SELECT t.*, e.last, e.first, s.said FROM t JOIN ends e ON t.conv_id IS NOT DISTINCT FROM e.conv_id JOIN said s ON t.conv_id IS NOT DISTINCT FROM s.conv_id WHERE t.n <= e.last),
both_ AS (SELECT conv_id, n, {{'role': role, 'text': text}} AS a, CASE WHEN n < last THEN {{'role': role, 'text': text}} WHEN first < last THEN {{'role': role, 'text': said}} END AS b FROM c),
forks AS (SELECT conv_id, min(CASE WHEN a IS DISTINCT FROM b THEN n END) AS fork FROM both_ GROUP BY conv_id),
p AS (SELECT x.conv_id, n, a.role AS arole, b.role AS brole, coalesce(n < fork, true) AS shared, {_TURN.format('a')} AS ap, coalesce({_TURN.format('b')}, '') AS bp FROM both_ x JOIN forks f ON x.conv_id IS NOT DISTINCT FROM f.conv_id),
o AS (SELECT *, coalesce(sum(CASE WHEN shared THEN 0 ELSE length(ap) END) OVER w, 0) AS af, coalesce(sum(CASE WHEN shared THEN 0 ELSE length(bp) END) OVER w, 0) AS bf
      FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, coalesce(string_agg(CASE WHEN shared THEN ap END, '' ORDER BY n), '') AS prompt, CAST(sum(CASE WHEN shared THEN 1 ELSE 0 END) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg(CASE WHEN NOT shared THEN ap END, '' ORDER BY n), '') AS chosen,
  coalesce(string_agg(CASE WHEN NOT shared AND arole = 'assistant' THEN CAST(CAST(af AS BIGINT) + length(arole) + 5 AS VARCHAR) || '-' || CAST(CAST(af AS BIGINT) + length(ap) AS VARCHAR) END, ' ' ORDER BY n), '') AS chosen_mask,
  coalesce(string_agg(CASE WHEN NOT shared THEN bp END, '' ORDER BY n), '') AS rejected,
  coalesce(string_agg(CASE WHEN NOT shared AND brole = 'assistant' THEN CAST(CAST(bf AS BIGINT) + length(brole) + 5 AS VARCHAR) || '-' || CAST(CAST(bf AS BIGINT) + length(bp) AS VARCHAR) END, ' ' ORDER BY n), '') AS rejected_mask
FROM o GROUP BY conv_id""",
    "op8_sparse_suffixes": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT rid, doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d)),
dup AS (SELECT rid, doc_id, i, count(*) OVER (PARTITION BY h) AS c, min(doc_id) OVER (PARTITION BY h) AS o FROM win),
runs AS (SELECT rid, doc_id, i, o, i - row_number() OVER (PARTITION BY rid ORDER BY i) AS g FROM dup WHERE c > 1)
SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, min(o) AS first_id FROM runs GROUP BY rid, doc_id, g""",
    "op11_reversed_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
asked AS (SELECT qid, item_id, term, count(*) AS times FROM q GROUP BY ALL),
t AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (SELECT tf.rid, tf.doc_id, tf.term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + CAST((25 * CAST(n AS HUGEINT) * n_docs) // n_terms AS BIGINT)))) AS part
         FROM tf JOIN df USING (term) CROSS JOIN t WHERE tf.term IN (SELECT term FROM asked)),
s AS (SELECT a.qid, a.item_id, p.rid, p.doc_id, CAST(sum(p.part * a.times) AS BIGINT) AS score FROM asked a JOIN part p USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) <= 20""",
}
