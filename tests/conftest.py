from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from raceboard.sources.schemas import STAGING  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from raceboard.session import ensure_checkpoint_dir
    session = (SparkSession.builder.master("local[*]")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.driver.memory", "6g")
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="rb-warehouse-"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session


def staging_df(spark, name, rows):
    """A staging DataFrame from dict rows (absent columns are NULL)."""
    schema = STAGING[name]
    data = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(data, schema)


@pytest.fixture
def make_staging(spark):
    def make(**tables):
        out = {name: staging_df(spark, name, []) for name in STAGING}
        for name, rows in tables.items():
            out[name] = staging_df(spark, name, rows)
        return out
    return make


@pytest.fixture
def materialize(spark, tmp_path):
    """Write tables to Parquet and read them back (the build's stage boundary)."""
    def run(tables):
        out = {}
        for name, df in tables.items():
            path = str(tmp_path / name)
            df.write.mode("overwrite").parquet(path)
            out[name] = spark.read.parquet(path)
        return out
    return run
