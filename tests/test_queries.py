"""Every named query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, difference

from belegwerk.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in catalog.names() if n in catalog.sql()])
def test_same_rows_as_sql(spark, sql, name):
    assert difference(catalog.run(name, spark, FOLDER), sql, catalog.sql()[name]) is None
