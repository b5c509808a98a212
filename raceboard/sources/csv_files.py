"""Staging files: a folder with one CSV per input (``<name>.csv``, header row).

Reading binds columns *by header name*: every file is read as text, NULL spellings
are cleared, and each declared column is ``try_cast`` to its type.  A file may hold
extra columns or a different order; a declared column missing from the file reads
as NULL.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raceboard.functions.columns import null_if_token
from raceboard.sources.schemas import STAGING

NULL_MARKER = "\\N"


def files_with_quoted_newlines(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Files of ``path`` that may hold a cell with a newline, and the others.

    A cell that goes on in the next line leaves an odd number of quotes in the line (a quote
    inside a quoted cell is doubled). Lines are read in splits, so a large file is looked
    through by many tasks; only file names come to the driver.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.where(quotes % 2 == 1).select(F.col("_metadata.file_path").alias("file")).distinct()
    held = {unquote(r["file"]) for r in odd.collect()}
    files = sorted({unquote(f) for f in lines.inputFiles()})
    bare = lambda f: f.split(":", 1)[-1].lstrip("/")  # noqa: E731  one listing writes file:/, another file:///
    names = {bare(f) for f in held}
    return [f for f in files if bare(f) in names], [f for f in files if bare(f) not in names]


def read_staging_file(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool | None = None) -> DataFrame:
    """One staging file; a quote inside a quoted cell is doubled, and a cell may hold newlines.

    Newlines in cells keep Spark from splitting a file. Unless ``multi_line`` says it, a pass
    over the lines finds the files that may have them; all others are split and read in parallel.
    """
    if multi_line is not None:
        return _read(spark, path, schema, multi_line)
    whole, split = files_with_quoted_newlines(spark, path)
    if not whole:
        return _read(spark, path, schema, False)
    parts = _read(spark, whole, schema, True)
    return parts.unionByName(_read(spark, split, schema, False)) if split else parts


def _read(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool) -> DataFrame:
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("nullValue", NULL_MARKER).option("mode", "PERMISSIVE")
           .option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path))
    present = set(raw.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            text = null_if_token(F.col(f"`{f.name}`"))
            value = text if isinstance(f.dataType, T.StringType) else _typed(text, f.dataType)
            cols.append(value.alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def _typed(text, dtype: T.DataType):
    """Text to a number; integer columns also accept float text such as '3.0'."""
    if isinstance(dtype, (T.IntegerType, T.LongType)):
        direct = text.try_cast(dtype)
        via_double = text.try_cast("double")
        whole = F.when(via_double == F.floor(via_double), F.floor(via_double).try_cast(dtype))
        return F.coalesce(direct, whole)
    return text.try_cast(dtype)


def read_staging(spark: SparkSession, folder: str, names: Iterable[str] | None = None, multi_line: bool | None = None) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for each registered staging input found as ``folder/name.csv``
    (``multi_line`` as in ``read_staging_file``)."""
    folder = folder.rstrip("/")
    wanted = list(names) if names is not None else list(STAGING)
    return {n: read_staging_file(spark, f"{folder}/{n}.csv", STAGING[n], multi_line) for n in wanted}


def read_present(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The registered inputs that ``folder`` has a file of."""
    out = {}
    for name in STAGING:
        try:
            out |= read_staging(spark, folder, [name])
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
    return out


def write_staging(tables: Mapping[str, DataFrame], folder: str, append: bool = False) -> None:
    """Write staging DataFrames as CSV folders (``\\N`` for NULL), one per input name.

    ``append`` adds to what is there (a load in parts, with the same columns) instead of
    replacing it.
    """
    folder = folder.rstrip("/")
    for name, df in tables.items():
        (df.write.mode("append" if append else "overwrite").option("header", True).option("nullValue", NULL_MARKER)
         .option("quote", '"').option("escape", '"').option("emptyValue", "").csv(f"{folder}/{name}.csv"))
