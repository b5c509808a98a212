"""Reshape: wide metric columns to (metric, metric_value) rows, and the
"value + running value" double-row layout used by the per-race report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Mapping[str, str],
                    variable: str = "metric", value: str = "metric_value") -> DataFrame:
    """One row per input row and metric, NULL values kept.

    ``metrics`` maps source column -> metric label, in output order.  Values are cast
    to double so counts, flags and points share one column.
    """
    staged = df.select(*ids, *[F.col(src).cast("double").alias(label) for src, label in metrics.items()])
    return staged.unpivot(list(ids), list(metrics.values()), variable, value)


def with_running_variant(df: DataFrame, value: str, running: str, flag: str) -> DataFrame:
    """Emit each row twice, flagged: (value, flag=false) and (running, flag=true).

    One pass over the input instead of a union of two recomputed branches.
    """
    variants = F.array(
        F.struct(F.col(value).cast("double").alias("v"), F.lit(False).alias("f")),
        F.struct(F.col(running).cast("double").alias("v"), F.lit(True).alias("f")),
    )
    rest = [c for c in df.columns if c not in (value, running)]
    return (df.select(*rest, F.explode(variants).alias("__variant"))
            .select(*rest, F.col("__variant.v").alias(value), F.col("__variant.f").alias(flag)))
