"""The queries against their SQL."""

import compare
import pytest

from factloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf_dir, name):
    assert compare.compare(spark, QUERIES, ORACLES, name, sf_dir)[0].startswith("ok")
