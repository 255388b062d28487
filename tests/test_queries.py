"""Every registered query of the core library: against its SQL where there is one, else rows alone."""

import math
import os

import duckdb
import pytest

from brindle import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(SF, t)}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert found
        if name in ("e2_select_fwe", "e5_select_jmi", "e6_select_mb", "e7_select_smb"):
            assert "l_quantity" in {row[columns.index("feature")] for row in found}
        return
    result = oracle.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert found == sorted(tuple(plain(row[i]) for i in at) for row in result.fetchall())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
