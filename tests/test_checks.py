"""Every registered query against its SQL check."""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as registry
from cohortspark.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="shared tables not available")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = registry.queries()[name](spark, SF)
    check = registry.oracle_sql().get(name)
    if check is None:
        assert df.count() > 0
    else:
        assert oracle.differences(df, duck, check) == []


def test_entry(spark):
    assert registry.entry(spark).count() > 0
