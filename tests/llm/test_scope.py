import os

import pytest
from splitwarden.llm import queries
from splitwarden.sources import shared

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def test_operators_leave_nothing_behind_in_a_scope(spark):
    listed = lambda: set(os.listdir(shared.shared_dir(spark).removeprefix("file://")))
    before = listed()
    for name, query in queries.queries().items():
        with shared.scope(spark):
            assert query(spark, SF).count() > 0
        assert listed() == before, name
