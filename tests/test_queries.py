"""Every query against its SQL form on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from reliefgrid.plans.catalogue import QUERIES
from reliefgrid.plans.oracle import ORACLE
from tools.check_oracle import same_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not present")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, name):
    found = base.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    problem = same_rows(entry.queries()[name](spark, SF), columns, found.fetchall())
    assert problem is None, problem
