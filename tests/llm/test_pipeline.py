import corpus_pipeline

from .helpers import docs_of, odd_pairs

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontaminate", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_against_brute_force(spark):
    """Each document that is left, and each that went, has its reason."""
    import re

    from .test_decontaminate import plain as contaminated
    from .test_ngram_join import plain as classes

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    left = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    best = {}
    for i, t in left:
        best[t] = max(best.get(t, i), i)
    left = [(i, t) for i, t in left if best[t] == i]
    found = {x[0]: x[1] for x in classes(left)}
    left = [(i, t) for i, t in left if found[i] == i]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {x[0] for x in contaminated(left, bench) if x[4]}
    assert got == {i for i, _ in left} - bad and bad


def test_odd_rows_pass_every_stage(spark, tmp_path):
    docs = docs_of(spark, odd_pairs())
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 0 < len(rows) < docs.count() and all(r["n_tokens"] == len(r["ids"]) for r in rows)
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
