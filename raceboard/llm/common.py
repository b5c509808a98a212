"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raceboard.session import scratch_path, share_code


def stored(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    The files cut the lineage in a folder that all executors share, so a lost executor
    costs no recomputation of what lies before, and Spark knows the written size when it
    picks a join for what follows. ``sort`` orders the rows within each file.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Whole texts go to Python 1,000 rows at a time, unless the session says otherwise: beside
    the batch itself, both sides keep buffers of the largest batch they have had."""
    if spark.conf.get(_BATCH, "10000") == "10000":  # Spark's default
        spark.conf.set(_BATCH, "1000")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, h, text)``: only the columns an operator needs, whatever else is there.

    ``doc_id`` is cast to long and may be null; ``h`` is a hash of the text and of whether
    the id is null. Rows that agree on id and text share the key ``(doc_id, h)``, and so do
    their results; rows that share an id alone do not mix.
    """
    doc_id = F.col(id_col).cast("long")
    text = F.col(text_col).cast("string")
    return df.select(doc_id.alias("doc_id"), F.xxhash64(doc_id.isNull(), text).alias("h"), text.alias("text"))


def id_key(name: str = "doc_id") -> Column:
    """A join key for a nullable id (``h`` tells a null id from 0)."""
    return F.coalesce(F.col(name), F.lit(0).cast("long"))


def bare_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """The id as a plain long beside the flag ``no_<name>``: a nullable one would become a
    double in pandas."""
    return df.withColumn(f"no_{name}", F.col(name).isNull()).withColumn(name, id_key(name))


def null_id(df: DataFrame, name: str = "doc_id") -> DataFrame:
    """Undo ``bare_id``."""
    return df.withColumn(name, F.when(~F.col(f"no_{name}"), F.col(name))).drop(f"no_{name}")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` by workers that find this package (where the driver has it)."""
    share_code(df.sparkSession)
    return df.mapInPandas(function, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
