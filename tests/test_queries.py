"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import pytest

from palimpsest.checks import ORACLES, QUERIES
from scripts.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    verdict, _, _, rows = compare(name, QUERIES[name], ORACLES.get(name), spark, FOLDER, duck)
    assert verdict in ("ok", "rows-only"), verdict
    assert rows > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
