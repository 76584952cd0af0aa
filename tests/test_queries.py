"""Every registered query next to its SQL twin, on the smallest tables."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry
from vigilog.plans import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("key", list(QUERIES))
def test_query(spark, con, key):
    diff, _ = compare(spark, con, key, QUERIES[key], ORACLES.get(key), SF_DIR)
    assert not diff, diff


def test_entry(spark):
    assert entry(spark).columns == ["ssh_ip", "failures", "users"]
