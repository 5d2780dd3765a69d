"""A corpus pipeline of five stages; each works on all that its predecessor kept.

1. language_id: documents whose language cannot be told (no text, no letter, or a best guess below LEAST_SCORE) go.
2. near_duplicates: of each component of documents alike in 80 % of their word 5-grams, the one with the smallest id stays
   (a component may join texts that are not alike themselves through others that are).
3. secrets: secrets in the texts become [SECRET]; every document stays.
4. mixing: sources by target weights; a document comes as often as its source's budget takes it.
5. packing: the tokens of what is left, packed into sequences of 2048; `document` numbers the rows of the mix, so that the pieces of
   a document that it takes twice are told apart.

Cases: near_duplicates decides by id and text, so that an id that several texts share loses only those
that others stand for; rows without an id come last in a component and are told apart by their texts; of rows with
the same id and set of shingles one stays, the first by text; texts without a word all stay. Where no row
names its language, texts with a letter stay. An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.llm import jaccard_join, language_id, mixing, packing, secrets
from tallow.llm.common import fresh, read_table, small, stored, sweep, tables
from tallow.session import small_batches

#: Below this posterior a language counts as not told; a few words can fit several languages and still be clean.
LEAST_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = language_id.fit(docs)
    if not trees.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    own = fresh(docs, "language")
    found = language_id.identify(docs, trees, out=own)
    kept = found.filter((F.col(f"{own}.lang_pred") != language_id.UNDETERMINED) & (F.col(f"{own}.score") >= LEAST_SCORE))
    return kept.select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    join = jaccard_join.Join(docs, k=5, percent=80)
    rows = stored(join.members(), "members")
    stays = F.col("leader").isNull() | (F.col("leader.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("leader.digest") == F.col("digest")))
    by_id = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum(stays.cast("int")).alias("stay"))
    by_id = stored(by_id.filter("rows > 1 or stay = 0"), "by_id")
    # ids of which all rows go, and ids of several rows, of which some stay
    going, several = by_id.filter("stay = 0").select("doc_id"), by_id.filter("stay > 0").select("doc_id")
    n, n_several = going.count(), several.count()
    named = docs.filter("doc_id is not null").join(small(going, n, 32), "doc_id", "left_anti")
    some_without = n_several > 0 or not rows.filter("doc_id is null").isEmpty()
    if not some_without:
        return named.select(*docs.columns)
    plain = named.join(small(several, n_several, 32), "doc_id", "left_anti")
    unsure = named.join(small(several, n_several, 32), "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id is null"))
    leaders = stored(rows.filter(stays & F.col("leader").isNotNull()).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct(), "leaders")
    found = unsure.withColumn("__digest", join.digest_of("text"))
    empty = found.filter(F.col("__digest").isNull()).select(*docs.columns)
    met = found.join(leaders, "__digest").filter(F.col("__id").eqNullSafe(F.col("doc_id")))
    whole = F.struct(*docs.columns)
    once = met.groupBy("__id", "__digest").agg(F.min_by(whole, F.struct(F.col("text"), F.to_json(whole))).alias("__row")).select("__row.*")
    return plain.select(*docs.columns).unionByName(empty).unionByName(once)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs, secrets.forest(spark))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), numbered=True))


def _frugal(stage):
    """The stage in a session that has opted in to small batches: long texts, little memory."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    (name, _frugal(stage))
    for name, stage in (
        ("language_id", language_stage),
        ("near_duplicates", duplicate_stage),
        ("secrets", secret_stage),
        ("mixing", mixing_stage),
        ("packing", packing_stage),
    )
]

#: Language scores, verified near duplicates and tokens are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    others = tables()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        sweep(spark, docs, others=others)
    return docs
