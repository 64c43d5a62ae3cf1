"""Every registered query against its DuckDB equivalent; the others must run."""

import pytest

from tests.helpers import duck, same
from tracewright.plans import catalog


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, small, con, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        same(got, con.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"cue_id", "pos", "id", "w", "sim", "score", "active"}
    assert set(e.oracle_sql()) <= set(e.queries())
