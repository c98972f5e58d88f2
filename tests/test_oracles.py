"""Every query with SQL has DuckDB's rows; the others run and return rows."""

from __future__ import annotations

import pytest

from lumenfield import catalog
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert not differences(df, catalog.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0
