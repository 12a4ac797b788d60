import corpus_pipeline
from brute import simhash_components
from jobgrain.llm import quality
from test_suffixes import brute


LONG = " ".join(f"word{i}" for i in range(120))


def test_odd_rows_pass_every_stage(spark, sf, tmp_path):
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, LONG, "en", "a", 1, "x"), (1, LONG, "en", "a", 1, "x"), (None, LONG + " end", None, None, None, "y"), (None, other, "de", None, 5, None), (2, None, "en", "a", 0, "z"), (3, "", "en", "b", 0, "z"), (4, " \n" * 3000, "en", "b", 0, "z"), (9007199254740993, "q" + other[5:] + " " + LONG, "en", "b", 7, "z")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, near_rows string, mix_h string, no_text string, h string, copies string"
    docs = spark.createDataFrame([(*r, None, "n", None, "c") for r in rows], columns)
    step = dict(corpus_pipeline.STAGES)
    for name in ("quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mix_to_weights"):
        docs = step[name](spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
    texts = [r.text for r in docs.collect()]
    assert all(texts) and sum(t.count("word7 ") for t in set(texts)) == 1
    assert step["best_fit_packing"](spark, docs, sf).where("piece = 0").count() == len(texts)


def test_empty_table(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    step = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "mix_to_weights", "best_fit_packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    good = step["quality_rules"](spark, docs, sf).cache()
    kept = {r.doc_id for r in quality.apply_policy(quality.rule_ledger(docs), "v3").where("kept").collect()}
    assert good.columns == names and {r.doc_id: r for r in good.collect()} == {i: rows[i] for i in kept}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0").collect()} & set(rows)
    assert clean and clean <= kept and len(kept) < 0.97 * len(rows)
    lone = step["simhash_near_dedup"](spark, good, sf).cache()
    _, comp = simhash_components({i: rows[i].text for i in kept})
    assert lone.columns == names and sorted(r.doc_id for r in lone.collect()) == sorted(set(comp.values()))
    cut = step["suffix_array_dedup"](spark, lone, sf).cache()
    assert cut.columns == names and brute([(r.doc_id, r.text) for r in cut.collect()]) == []
    assert all(len(r.text) == r.n_chars for r in cut.collect())
    mixed = step["mix_to_weights"](spark, cut, sf).cache()
    assert mixed.columns == names and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    total = lambda df: sum(len(r.text.encode().split()) for r in df.collect())
    assert abs(total(mixed) / total(cut) - 1) < 0.03
    packed = step["best_fit_packing"](spark, mixed, sf)
    assert packed.where("piece = 0").count() == mixed.count()
