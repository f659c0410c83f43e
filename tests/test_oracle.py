"""Registered queries against their SQL twins on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from workload.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Steps that the twins of win_12, win_16 and plan_6, or txt_13 and txt_14, run through anyway.
COVERED = ("txt_11", "txt_12", "win_10", "win_11", "win_15", "win_17", "set_2", "set_4")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in ORACLE if n not in COVERED])
def test_query_agrees_with_its_twin(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_every_twin_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
