"""The pipeline against a stage-by-stage check in plain Python."""

from collections import Counter

import corpus_pipeline
from codeseam.llm import bpe
from tests.llm.test_mixing import WORDS, brute_targets
from tests.llm.test_simhash import brute_components, brute_fp


def test_stages(spark, make_docs):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    df = docs
    for name, f in corpus_pipeline.STAGES:
        df = f(spark, df, sf).cache()
        seen[name] = [r.asDict() for r in df.collect()]
        if name != "byte_level_bpe":
            assert df.columns == docs.columns
        if name == "toxicity":
            assert 0.8 * len(texts) < len(seen[name]) < len(texts)
        if name == "simhash_near_duplicates":
            rows = [(r["doc_id"], brute_fp(r["text"])) for r in seen["toxicity"]]
            assert sorted(r["doc_id"] for r in seen[name]) == sorted(set(brute_components(rows).values()))
        if name == "mixing":
            sizes = Counter()
            for r in seen["pii_pseudonyms"]:
                sizes[r["source"]] += len(WORDS.findall(r["text"]))
            taken = Counter()
            for r in seen[name]:
                taken[r["source"]] += len(WORDS.findall(r["text"]))
            want = brute_targets(sizes)
            assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        if name == "byte_level_bpe":
            c = bpe.codec(*bpe.default_vocabulary())
            assert Counter(r["text"] for r in seen[name]) == Counter(r["text"] for r in seen["mixing"])
            assert all(r["ids"] == c.base.encode_ordinary(r["text"]) for r in seen[name])


def test_stages_on_odd_tables(spark, make_docs, tmp_path):
    """Nulls in any column, repeated rows, clashing columns and an empty table."""
    from pyspark.sql import functions as F

    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, None, None), (None, "one two three four", None), (1, "", "s"), (2, "mail a@b.example.com now please", "s"), (2, "mail a@b.example.com now please", "s"), (3, "word " * 3000, "t"), (4, None, "t")]
    docs = make_docs(rows, extra=True)
    df = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, str(tmp_path)).cache()
        assert df.dtypes == docs.dtypes and {r.key for r in df.collect()} == {"clash"}
        if name == "toxicity":
            assert df.count() == len(rows)
        if name == "simhash_near_duplicates":
            assert sorted((r.doc_id or 0, r.text or "") for r in df.collect()) == sorted([(0, "one two three four"), (1, ""), (2, rows[3][1]), (3, rows[5][1])])
    assert df.filter(F.col("text").contains("a@b")).count() == 0 and df.count() >= 3
    last = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path))
    assert last.columns == [*docs.columns, "ids", "n_tokens"] and last.filter("size(ids) <> n_tokens").count() == 0
    df = make_docs([], extra=True)
    for _, f in corpus_pipeline.STAGES:
        df = f(spark, df, str(tmp_path))
    assert df.count() == 0
