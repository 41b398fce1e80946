"""Every query that SQL can express, against DuckDB over the smallest tables."""

import pytest

from tests.oracle import same
from weftline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, SF, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", ["upsert_conflicts", "clusters", "hybrid_topk", "related_bfs"])
def test_result_does_not_depend_on_partitions(spark, name):
    got = []
    for n in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(repr, registry.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


def test_queries_without_sql_run(spark):
    for n in sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"stream_upsert"}):
        assert registry.QUERIES[n](spark, SF).count() > 0
