"""Ids that are null or shared, extra columns with the names of scratch columns, and rounds of packing without end."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallow.llm import common, jaccard_join, language_id, licenses, media, mixing, packing, quality, secrets, spotsigs


def test_every_language_is_learned_where_ids_are_null(spark):
    rows = [(None, f"{w} {i} {w}", lang) for lang, w in (("en", "the house"), ("fr", "la maison"), ("es", "las casas")) for i in range(5000)]
    rows += [(i, f"das Haus {i}", "de") for i in range(50)] + [(None, "un solo", "it")] * 700 + [(None, None, "xx"), (None, "", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("h", "level", "n", "place", "ok")})
    sample = language_id.training_rows(docs, "text", "lang", "doc_id", None, 400)
    assert {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()} == {"en": 400, "fr": 400, "es": 400, "de": 50, "it": 400}
    assert sorted(map(str, sample.collect())) == sorted(map(str, language_id.training_rows(docs.repartition(7), "text", "lang", "doc_id", None, 400).collect()))
    bytes_held = language_id.training_rows(docs, "text", "lang", "doc_id", None, 400, bytes_per_language=100).groupBy("lang").agg(F.sum(F.length("text")).alias("n")).collect()
    assert all(100 <= r.n < 130 for r in bytes_held)
    assert sorted(language_id.fit(docs, docs_per_language=40).languages) == ["de", "en", "es", "fr", "it"]
    assert language_id.fit(docs, docs_per_language=40, most_languages=2).languages == language_id.fit(docs.filter("lang in ('en', 'es')"), docs_per_language=40).languages


@pytest.mark.parametrize("ids", ["one", "null", "few"])
def test_the_mix_meets_its_targets_for_any_ids(spark, ids):
    rng = random.Random(5)
    rows = [({"one": 7, "null": None, "few": i % 3}[ids], " ".join(f"w{rng.randrange(3)}" for _ in range(rng.randrange(0, 6))), rng.choice(["a", "b", None, "c"])) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(docs, rows_a_range=16).collect()
    assert len(got) == 900 and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b", None, "c"):
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(np.floor(own[0].target + 0.5))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3), rows_a_range=16).collect()))
    out = mixing.mixed_documents(docs).select("source", mixing.n_words("text").alias("n")).groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r.source: r.n for r in out} == {s: sum(r.taken for r in got if r.source == s) for s in {r.source for r in got}}


def test_equal_rows_share_a_target_to_the_word(spark):
    docs = spark.createDataFrame([(1, "x y z", "s")] * 1000, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(docs).collect()
    assert (got[0].target, sum(r.taken for r in got)) == (4500.0, 4500) and {r.taken for r in got} == {3, 6}
    nulls = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long"))).agg(F.sum("taken")).first()[0]
    assert nulls == 4500


def test_bins_keep_numbers_of_their_own_for_any_number_of_rounds():
    pieces = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "piece": pa.array([0, 0], pa.int32()), "start": pa.array([0, 0], pa.int64()), "length": pa.array([5, 6], pa.int64()), "ids_crc32": pa.array([0, 0], pa.int64()), "sequence_id": pa.array([1 << 61, (1 << 61) + 1], pa.int64()), "offset": pa.array([0, 0], pa.int64())})

    class Task:
        @staticmethod
        def partitionId():
            return 200_000

    was, packing.TaskContext.get = packing.TaskContext.get, staticmethod(lambda: Task)
    try:
        (out,) = packing._packer(20, (1 << 61) + 2)(iter(pieces.to_batches()))
    finally:
        packing.TaskContext.get = was
    assert out["sequence_id"].to_pylist() == [(1 << 61) + 2 + 200_000 * packing._WIDTH] * 2 and (1 << 61) + 2 + 400_000 * packing._WIDTH < 1 << 63


def test_pack_works_on_pieces_of_any_origin_and_tries_several_deals(spark):
    rng = np.random.default_rng(3)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(rng.integers(300, 1100, 20_000))]
    made = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(made, rows_a_partition=2048).select("sequence_id", "offset", "length", "bins", "bound").toPandas()
    assert len(got) == 20_000 and got.sequence_id.nunique() == got.bins[0]
    ends = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.sum()
    assert ends.max() <= 2048
    whole = len(packing.best_fit([r[3] for r in rows], 2048)[2])
    assert got.bins[0] <= whole + 2


NAMES = ["__found", "__cands", "__parts", "__scores", "__key", "__size", "__part", "__copy", "__scan", "__mix", "__mix_key", "mix_size", "__language", "key", "size", "rank", "h", "digest", "leader", "label"]


def test_columns_named_like_scratch_columns_stay(spark):
    rows = [(i, f"text {i} password = q7!Zr9pLx2vB end", f"s{i % 2}", "kept") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mine string").withColumns({c: F.lit(f"is {c}") for c in NAMES})
    kept = lambda df: df.select(*NAMES).distinct().collect() == [tuple(f"is {c}" for c in NAMES)]
    clean = secrets.redacted(docs, secrets.forest(spark))
    assert clean.columns == docs.columns and kept(clean) and clean.filter("text like '%[SECRET]%'").count() == 40
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and kept(mixed)
    assert mixing.mix(docs).count() == 40 and licenses.scan(docs).count() == 40 and secrets.scan(docs, secrets.forest(spark)).count() == 40
    assert kept(language_id.identify(docs, language_id.ContextTrees({"en": [b"text"]}, 2)))
    assert kept(media.with_media(docs)) and kept(quality.with_scores(docs, quality.AttentionModel()))
    assert jaccard_join.Join(docs).classes().count() == 40
    assert spotsigs.with_edits(docs).count() == 40
    assert common.fresh(docs, "mix") not in NAMES and not any(c.startswith(common.fresh(docs, "mix")) for c in docs.columns)
