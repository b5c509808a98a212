"""Every registered query against its DuckDB oracle on the smallest test tables."""

import hashlib
import math
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="no test tables")


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha1("\n".join(sorted("|".join(norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


DUCK_OF = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck_types(duck, sql):
    """Result column types from the relation's metadata (nothing is executed)."""
    rel = duck.sql(sql)
    return {c: str(t) for c, t in zip(rel.columns, rel.types)}


def test_all_queries_match_oracle(spark, duck):
    import __spark_entry__ as entry
    from raceboard.plans.registry import registry
    qs = {name: fn for name, fn in entry.queries().items() if name in registry()}
    sqls = {name: sql for name, sql in entry.oracle_sql().items() if name in qs}
    assert set(qs) == set(sqls)
    bad = []
    for name, fn in qs.items():
        df = fn(spark, SF)
        rows, cols = [tuple(r) for r in df.collect()], df.columns
        res = duck.execute(sqls[name])
        ocols, orows = [d[0] for d in res.description], res.fetchall()
        if sorted(cols) != sorted(ocols) or digest(rows, cols) != digest(orows, ocols):
            bad.append((name, len(rows), len(orows)))
        types = {f.name: DUCK_OF.get(f.dataType.simpleString()) for f in df.schema.fields}
        if types != duck_types(duck, sqls[name]):
            bad.append((name, "types"))
    assert not bad


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["year", "type", "id", "name", "constructor_name", "constructor_color", "wiki_url",
                          "season_wiki_url", "metric_value", "position"]
