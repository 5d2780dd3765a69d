import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def docs_of(spark):
    a = "the quick brown fox jumps over the lazy dog while the small cat sleeps near the old warm stove all day"
    texts = [a, a, a + " x", None, "", "123", 'one token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" two three four five six seven', "le chat est sur la table et il regarde la rue avec son ami le chien blanc", "some other words that share nothing with anything else in here", "some other words that share nothing with anything else in here"]
    rows = [(i, t, "fr" if t and t.startswith("le") else "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = docs_of(spark)
    out, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, "unused")
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out = corpus_pipeline.stored(out, name)
        kept.append({r.doc_id for r in out.select("doc_id").collect()})
    assert kept[0] == {0, 1, 2, 6, 7, 8, 9}
    assert kept[1] == {0, 6, 7, 8}
    assert kept[2] == kept[1]
    assert kept[3] <= kept[2] and kept[4] == kept[3]


def test_cases(spark):
    docs = docs_of(spark)
    odd = docs.union(docs.limit(2)).withColumn("doc_id", docs.doc_id)
    null_ids = docs.selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    for frame in (docs.limit(0), odd, null_ids, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "cast(null as string) as source", "n_chars", "1 as n", "2 as key", "3 as language")):
        out = frame
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, out, "unused"), name)
        assert (out.count() == 0) == (frame.count() == 0)
    twice = corpus_pipeline.duplicate_stage(spark, odd, "")
    assert twice.count() == len({r.doc_id for r in twice.collect()})
