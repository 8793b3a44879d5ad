"""Every registered query against its SQL twin on the smallest folder; those without one must give rows."""

from __future__ import annotations

import os

import pytest

from tests.check_oracle import compare
from tidegate.catalog.registered import ENTRIES

FOLDER = "/root/testdata/sf0.001"
NAMES = list(ENTRIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not mounted")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    line = compare(spark, name, FOLDER)
    assert line.startswith("ok") or line.startswith("ROWS") and ": 0 rows" not in line, line


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120
