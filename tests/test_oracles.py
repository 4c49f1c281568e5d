"""Every registered query against the same query in SQL on another engine."""

import math
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_queries_agree_with_sql(spark):
    import duckdb

    from hazardry.plans import registry
    from hazardry.session import ship_package

    ship_package(spark)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    wrong = []
    for name, sql in registry.oracle_sql().items():
        df = registry.queries()[name](spark, str(SF))
        columns = sorted(df.columns)
        got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        if sorted(names) != columns:
            wrong.append(f"{name}: columns")
            continue
        place = [names.index(c) for c in columns]
        if got != sorted(repr([_plain(r[k]) for k in place]) for r in cursor.fetchall()):
            wrong.append(name)
    assert not wrong


def test_entry_module_lists_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
