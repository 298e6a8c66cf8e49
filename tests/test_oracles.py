"""Every registered query against its SQL, and those without SQL run and give rows."""

import pytest
from compare import connect, rows

from tarn.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(found)
        return
    assert rows(found) == rows(duck.execute(ORACLES[name]).fetchdf())
