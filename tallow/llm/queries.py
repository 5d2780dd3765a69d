"""The queries op1 to op13 over the input tables, each a thin use of its operator, and SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, language_id, licenses, media, mixing, packing, periodic, quality, repair, secrets, spotsigs, toxicity, warc
from ..session import small_batches
from .common import id_crc, new_dir, read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_crc() % 4 == 2
    trees = language_id.fit(docs, where=~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out.alias("held_out"), "language.lang_pred", "language.score", "language.bits_per_byte")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("source")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"), secrets.forest(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_dir(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), base)
    return warc.read(spark, base).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    read_back = media.with_features(media.with_media(docs))
    return read_back.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "features.payload_bytes",
        "features.payload_sha256",
        "features.tail_crc32",
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "features.feature",
    )


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return spotsigs.with_classes(spotsigs.with_edits(docs), docs)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_crc() % 5 == 0
    model = quality.fit(docs, labels, where=~held_out)
    scored = quality.with_scores(docs.select("doc_id", "text"), model)
    score = F.col("quality_score.score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.Join(read_table(spark, sf_dir, "documents")).classes()


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    return repair.report(conversations, repair.damaged(conversations))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.tiled(read_table(spark, sf_dir, "documents")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_crc() % 4 == 2
    model = toxicity.fit(docs, labels, where=~held_out)
    scored = toxicity.with_scores(docs.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    return scored.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"), F.size("toxicity.spans").alias("n_spans"), F.col("toxicity.spans").alias("spans"))


def _frugal(f):
    """The query in a session that has opted in to small batches: long texts, little memory."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _frugal(f)
    for f in (
        op1_language_id,
        op2_best_fit_packing,
        op3_mixing,
        op4_license_scan,
        op5_warc,
        op6_media,
        op7_quality,
        op8_jaccard_join,
        op9_fingerprints,
        op10_secret_scan,
        op11_conversation_repair,
        op12_periodic_runs,
        op13_toxicity,
    )
}
ORACLES = {"op3_mixing": mixing.ORACLE, "op4_license_scan": licenses.oracle(), "op11_conversation_repair": repair.ORACLE}
