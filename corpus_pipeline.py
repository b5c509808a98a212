"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of their
input, whatever those are; the last returns packed pieces. SQL cannot express the learnt
score and the tokenizer, so ``ORACLE_SQL`` is None and the tests compare with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.llm import decontamination, line_dedup, packing, simhash, toxicity
from raceboard.llm.common import id_key, read_table, short_batches, stored


def _packed(docs: DataFrame) -> DataFrame:
    """All columns as ``row`` beside the row's key, so that no name can clash."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"),
                       F.coalesce(doc_id, F.lit(0).cast("long")).alias("d"), F.xxhash64(doc_id.isNull(), text).alias("s"))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash are in ``rejected``."""
    keys = stored(rejected.select(id_key().alias("d"), F.col("h").alias("s")).distinct(), "rejected", sort=["d"])
    return _packed(docs).join(keys, ["d", "s"], "left_anti").select("row.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, in the pass that scores them."""
    short_batches(spark)
    score = toxicity.fitted(docs, read_table(spark, sf_dir, "labels"))
    scored = _packed(docs).select("row", "text", score(F.col("text")).alias("score"))
    return scored.where(F.col("score") < 0.7).select("row.*")


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the boilerplate lines of their source; every document stays."""
    found = line_dedup.drop_boilerplate(docs)
    return found.withColumn("row", F.col("row").withField("text", F.col("clean"))).select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays (of repeated
    rows of that id, those with the smallest text hash)."""
    short_batches(spark)
    found = stored(simhash.near_duplicates(docs), "groups")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = stays.groupBy(F.coalesce("component_id", F.lit(0).cast("long")).alias("c"), F.col("component_id").isNull().alias("n")).agg(F.min("h").alias("first"))
    gone = found.withColumns({"c": F.coalesce("component_id", F.lit(0).cast("long")), "n": F.col("component_id").isNull()}).join(
        stored(first, "first-of-group"), ["c", "n"]).where(~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("h") == F.col("first"))))
    return _without(docs, gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where(F.col("n_hit") > 0))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed."""
    short_batches(spark)
    return packing.pack_documents(docs).drop("h")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack_windows),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
