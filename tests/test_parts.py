"""Work that is dealt out by its rows: the same results over a given number of partitions."""

from pyspark.sql import functions as F

from claimloom.operators import aggregates as A
from claimloom.operators import relational as R
from claimloom.sources import fixtures as X
from claimloom.streaming import claims as K

from conftest import DATA

PARTS = 7


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def mentions(spark):
    return X.kg_mentions(spark, DATA)


def test_partitions_follow_the_rows(spark, monkeypatch):
    assert R.parts_for(spark, 10 * R.TASK_ROWS) == 10 and R.parts_for(spark, R.TASK_ROWS) is None
    assert X.parts(spark, DATA) is None
    before = rows(X.kg_claims(spark, DATA))
    monkeypatch.setattr(R, "TASK_ROWS", 1_000)
    n = -(-X.read(spark, DATA, "lineitem").count() // 1_000)
    assert X.parts(spark, DATA) == n > spark.sparkContext.defaultParallelism
    claims = X.kg_claims(spark, DATA)
    assert claims.rdd.getNumPartitions() == n  # the session has 4
    assert rows(claims) == before


def test_entities_of_pages_over_given_partitions(spark):
    out = R.entities_of_page(mentions(spark), X.kg_entities(spark, DATA), PARTS)
    assert rows(out) == rows(R.entities_of_page(mentions(spark), X.kg_entities(spark, DATA)))
    hinted = R.entities_of_page(mentions(spark), X.kg_entities(spark, DATA).hint("merge"), PARTS)
    assert hinted.rdd.getNumPartitions() == PARTS


def test_shared_page_pairs_over_given_partitions(spark):
    out = R.shared_event_pairs(mentions(spark), "entity_id", "page_id", PARTS)
    assert out.rdd.getNumPartitions() == PARTS
    assert rows(out) == rows(R.shared_event_pairs(mentions(spark), "entity_id", "page_id"))


def test_entity_frequency_counts_distinct_ids_that_are_not_null(spark):
    m = spark.createDataFrame([("e", "c", 1), ("e", "c", 1), ("e", "d", 1), ("e", None, 2), ("f", None, None), ("g", "1", 1), (None, "c", 1)], "entity_id string, claim_id string, page_id long")
    want = [("e", 2, 2), ("f", 0, 0), ("g", 1, 1), (None, 1, 1)]
    for n in (None, PARTS):
        assert {tuple(r) for r in A.entity_frequency(m, n).collect()} == set(want)
    plan = A.entity_frequency(m, PARTS)._jdf.queryExecution().toString()
    assert "v#" in plan and f", {PARTS})" in plan


def test_hub_coverage_over_given_partitions(spark):
    assert rows(A.hub_coverage(mentions(spark), 2, PARTS)) == rows(A.hub_coverage(mentions(spark), 2))


def test_actions_over_given_partitions(spark):
    a = K.arrivals(X.read(spark, DATA, "events"))
    act = lambda n: K.actions(a, K.ticks(a, parts=n).select("event_id", "tick"), parts=n)
    assert act(PARTS).rdd.getNumPartitions() == PARTS
    key = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).collect()
    assert key(act(PARTS)) == key(act(None))

