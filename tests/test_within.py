"""Scores within groups against the forms that make pairs and links as tables."""

import random
from datetime import datetime

from pyspark.sql import functions as F

from claimloom.operators import scoring as S
from claimloom.plans import registry

from conftest import DATA


def claims_of(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        event = rng.choice([1, 1, 1, 2, 3, None])
        topic = rng.choice(["a", "a", "b", None])
        day = None if rng.random() < 0.1 else datetime(2020 + rng.randrange(3), 1 + rng.randrange(12), 1)
        rows.append((f"c{i:03}", event, topic, rng.randrange(12), day, rng.randrange(4), rng.choice([0.05, 0.4, 0.7])))
    rows.append(("alone", 9, "a", 4, None, 1, 0.5))
    return spark.createDataFrame(rows, "claim_id string, event_id long, topic_key string, value long, event_time timestamp, reported int, prior double")


def judged(a, b):
    deaths = lambda of: F.when(of("value") % 4 == 0, of("value"))
    sim = F.round((a("value") + b("value")) % 10 / 10, 2)
    return sim, S.relation(deaths(a), deaths(b), a("event_time"), b("event_time"), sim)


def test_posteriors_within_topics_are_those_of_a_table_of_pairs(spark):
    c, group = claims_of(spark), ["event_id", "topic_key"]
    a, b = (c.select(*group, *[F.col(x).alias(f"{x}_{k}") for x in c.columns if x not in group]) for k in "ab")
    sim, rel = judged(lambda x: F.col(f"{x}_a"), lambda x: F.col(f"{x}_b"))
    pairs = a.join(b, group).filter("claim_id_a < claim_id_b").select(F.col("claim_id_a").alias("a"), F.col("claim_id_b").alias("b"), sim.alias("similarity"), rel.alias("relation")).cache()
    want = S.posteriors(c, pairs)
    got = S.posteriors_within(c, group, ["claim_id"], judged)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # no pair is written
    columns = [F.round(x, 5) if t == "double" else F.col(x) for x, t in want.dtypes]
    assert sorted(got.select(want.columns).select(columns).collect(), key=str) == sorted(want.select(columns).collect(), key=str)
    assert got.agg(F.sum("n_against") / 2).first()[0] == pairs.filter("relation = 'contradicts'").count() > 0


def test_superseded_in_order_is_that_of_links(spark):
    from pyspark.sql.window import Window

    rng, group, order = random.Random(5), ["event_id", "topic_key"], ["reported", "claim_id"]
    p = spark.createDataFrame([(r.claim_id, rng.choice([0.3, 0.5, 0.51, 0.9])) for r in claims_of(spark).collect()], "claim_id string, plausibility double")
    scores = claims_of(spark).join(p, "claim_id").cache()
    links = scores.select(F.col("claim_id").alias("older"), F.lead("claim_id").over(Window.partitionBy(*group).orderBy(*order)).alias("newer")).filter("newer IS NOT NULL")
    want = {tuple(r) for r in S.superseded(p, links).select("claim_id", "plausibility").collect()}
    assert {tuple(r) for r in S.superseded_in_order(scores, group, order).select("claim_id", "plausibility").collect()} == want


def test_counted_updates_are_those_of_all_pairs(spark):
    from claimloom.functions import text as T
    from claimloom.operators import aggregates as A

    rng, when = random.Random(8), lambda: rng.choice([None, datetime(2020, 1, 1), datetime(2020, 1, 2), datetime(2020, 1, 3)])
    rows = [(i, rng.choice([1, 1, 2, None]), rng.choice(["a", "a", "b", None]), rng.choice([1, 2, 3, None]), when(), when()) for i in range(150)] + [(900, 7, "a", 1, None, None)]
    c = spark.createDataFrame(rows, "claim_id long, event_id long, topic string, value long, reported_time timestamp, event_time timestamp")
    s = c.select("event_id", "claim_id", F.struct("topic", "value", "reported_time", "event_time").alias("a"))
    j = s.join(s.select("event_id", F.col("claim_id").alias("other"), F.col("a").alias("b")), "event_id").filter("claim_id <> other")
    want = j.groupBy("event_id").agg(F.count("*").alias("pairs"), F.count(F.when(T.is_update_of(F.col("a"), F.col("b")), 1)).alias("updates"))
    assert {tuple(r) for r in A.update_counts(c).collect()} == {tuple(r) for r in want.collect()}


def test_pair_scores_of_groups_are_those_of_pairs(spark):
    from claimloom.operators import aggregates as A

    rng = random.Random(9)
    g = spark.createDataFrame([(i, rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, 4, None])) for i in range(60)], "id long, predicted string, known long")
    made = lambda c: g.select(F.col("id").alias("a"), c).join(g.select(F.col("id").alias("b"), c), c).filter("a < b")
    want = A.pair_scores(made("predicted"), made("known")).first()
    assert A.group_pair_scores(g.unionAll(g.limit(9))).first() == want and want.hits > 0
    none = A.group_pair_scores(g.limit(0)).first()
    assert none[:3] == (0, 0, 0) and none.precision is None


def test_name_index_is_not_sent_to_all(spark, tmp_path):
    from claimloom.operators import relational as R

    spark.createDataFrame([(f"e{i}", f"name {i % 7}", i) for i in range(40)], "entity_id string, canonical_name string, mention_count long").write.parquet(f"{tmp_path}/e")
    e = spark.read.parquet(f"{tmp_path}/e")
    names = e.select(F.lower("canonical_name").alias("name")).distinct()
    got = R.entity_priors(names, e, e.select("entity_id", F.col("canonical_name").alias("claim_id")))
    assert {(r.name, r.entity_id) for r in got.collect()} == {(f"name {i}", f"e{35 + i if i < 5 else 28 + i}") for i in range(7)}
    index = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line and ("[_g#" in line or "[entity_id#" in line)]
    assert not index


def test_best_sub_events_of_a_block_are_those_of_its_pairs(spark):
    rng = random.Random(6)
    vector = lambda: rng.choice([None, [0.0, 0.0], [1.0], [rng.gauss(0, 1), rng.gauss(0, 1)], [rng.gauss(0, 1), rng.gauss(0, 1)]])
    some = lambda n: sorted(rng.sample("ABCDEFG", rng.randrange(n)))
    events = [(f"{e}:{t}", e, some(6), vector()) for e in range(8) for t in range(rng.randrange(1, 6))] + [("none", None, ["A"], None)]
    claims = [(i, i % 9, f"{i % 9}:{i % 4}", some(3), vector()) for i in range(120)] + [(500, None, "x", ["A"], None)]
    c = spark.createDataFrame(claims, "claim_id long, event_id long, own string, entities array<string>, vector array<double>")
    s = spark.createDataFrame(events, "sub_event string, event_id long, entities array<string>, vector array<double>")
    got = S.best_sub_events_within(c, s, "event_id", 0.2)
    unfold = lambda df, k: df.select(k, F.explode("entities").alias("entity_id"))
    pairs = c.join(s.select("sub_event", "event_id"), "event_id").filter("own <> sub_event")
    want = S.best_sub_events(pairs, unfold(c, "claim_id"), unfold(s, "sub_event"), c.select("claim_id", "vector"), s.select("sub_event", "vector"), 0.2)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and 30 < want.count() < 110
    # the query's pairs aren't joined with entities or vectors, and a claim's best is found without a window
    plan = registry.queries()["q094_best_sub_events"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") <= 3
