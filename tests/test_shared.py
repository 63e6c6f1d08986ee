import os

import pytest
from splitwarden.plans import catalogue, registry  # noqa: F401
from splitwarden.sources import shared

SF = "/root/testdata/sf0.001"


def listed(spark):
    return set(os.listdir(shared.shared_dir(spark).removeprefix("file://")))


def test_a_scope_owns_what_is_written(spark):
    before = listed(spark)
    with shared.scope(spark):
        one = shared.written(spark.range(5), "one")
        two = shared.written_bucketed(spark.range(5), "two", "id", 2)
        with shared.scope(spark):
            shared.written(spark.range(2), "inner")
            assert len(listed(spark) - before) == 3
        assert one.count() == two.count() == 5 and len(listed(spark) - before) == 2
        shared.remove(one)
    assert listed(spark) == before and not spark.catalog.tableExists(two._table)
    with pytest.raises(RuntimeError, match="on purpose"), shared.scope(spark):
        shared.written(spark.range(2), "lost")
        raise RuntimeError("on purpose")
    assert listed(spark) == before
    shared.remove(shared.written(spark.range(2), "unowned"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_share_a_table_and_leave_nothing(spark):
    before = listed(spark)
    with shared.scope(spark) as own:
        got = {n: registry.QUERIES[n](spark, SF).collect() for n in ("a14_pair_scores", "a17_detection_contingency", "m17_recovery_verdict")}
        assert [k[0] for k in own.kept] == ["sweep"] and sum(x.startswith("sweep-") for x in listed(spark)) == 1
        for n in ("g4_grouping_sensitivity", "k6_cosine_pairs", "s1_scan_dataset", "s15_write_tree", "s18_cached_digests", "a25_value_profile"):
            if n in registry.QUERIES:
                registry.QUERIES[n](spark, SF).collect()
    assert listed(spark) == before
    alone = registry.QUERIES["m17_recovery_verdict"](spark, SF).collect()
    assert sorted(map(str, alone)) == sorted(map(str, got["m17_recovery_verdict"]))
