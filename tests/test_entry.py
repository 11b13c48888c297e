import __spark_entry__ as entry
from tidemark.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_of_the_library_has_sql():
    """Training-data queries, where they are present, need not be expressible in SQL."""
    assert set(QUERIES) == set(ORACLE)
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_a_stable_schema(spark):
    first, second = entry.entry(spark), entry.entry(spark)
    assert first.schema == second.schema
    assert first.filter("error_code IS NULL").count() > 0


def test_plans_prune_and_limit_before_the_shuffle(spark):
    def plan(name):
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()

    ranked = plan("rank_partners")
    assert "WindowGroupLimit" in ranked and "CartesianProduct" not in ranked
    assert "BroadcastNestedLoopJoin" not in plan("bm25_topk") + plan("vector_topk")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan("retention")
    assert "Python" not in plan("number_grounding") + plan("bm25_topk") + ranked
