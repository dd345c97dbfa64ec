"""Every query against the SQL that must give the same rows."""

import os
import re
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


CORE = [n for n in entry.queries() if not re.match(r"op[0-9]+_", n) and n != "pipeline"]


def bag(df):
    """Rows as they are: queries round what they compute, so floats are equal to the last bit."""
    out = df[sorted(df)].astype(object).where(df[sorted(df)].notna(), None)
    return Counter(tuple(float(x) if isinstance(x, float) else x for x in r) for r in out.itertuples(index=False))


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    got = entry.queries()[name](spark, D).toPandas()
    assert len(got)
    if name in entry.oracle_sql():
        want = con.sql(entry.oracle_sql()[name]).df()
        assert sorted(want) == sorted(got)
        a, b = bag(want), bag(got)
        assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
