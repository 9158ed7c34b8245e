"""Jobs over streams of claims: literal cases, and streams against their batch forms."""

import random
from datetime import datetime, timedelta


from claimloom.streaming import claims as K
from tests.conftest import DATA

START = datetime(2024, 1, 1)
ARRIVALS = "event_id long, claim_id long, ts timestamp, kind string, stake int"


def at(hours):
    return START + timedelta(hours=hours)


def arrivals(spark, cases):
    rows = [(e, i, None if h is None else at(h), kind, stake) for e, case in cases.items() for i, (h, kind, stake) in enumerate(case)]
    return spark.createDataFrame(rows, ARRIVALS)


def test_lifecycle_rules(spark):
    n, c, g = "neutral", "contradiction", "corroboration"
    cases = {
        # LIVE cools after an hour, or half an hour where under three claims are left
        1: [(0, n, 0), (0.4, n, 0), (1.0, n, 0)], 2: [(0, n, 0)] * 6 + [(0.9, n, 0), (2.0, n, 0)],
        # an open contradiction keeps it LIVE; closed, it still is over a fifth of the day's claims
        3: [(0, c, 0), (5, n, 0), (6, g, 0), (12, n, 0)],
        # six hours and three days, and waking by stake alone
        4: [(0, n, 0), (7, n, 0), (90, n, 99), (91, n, 100), (92, n, 0), (92.1, n, 0), (92.2, n, 0)],
        # contradictions are counted where they share a fifth at most: one of five, then cooling
        5: [(0, c, 0), (0, g, 0)] + [(0.1, n, 0)] * 4 + [(2, n, 0)],
        6: [(None, n, None), (3, None, None)],
    }
    want = {
        1: ["LIVE", "LIVE", "WARM"], 2: ["LIVE"] * 7 + ["WARM"],
        3: ["LIVE"] * 4,
        4: ["LIVE", "WARM", "DORMANT", "WARM", "WARM", "WARM", "WARM"],
        5: ["LIVE"] * 6 + ["WARM"],
        6: ["LIVE", "LIVE"],
    }
    got = {}
    for r in K.lifecycle(arrivals(spark, cases)).orderBy("event_id", "claim_id").collect():
        got.setdefault(r.event_id, []).append(r.state)
    assert got == want


def test_lifecycle_is_the_same_over_small_batches(spark):
    rng = random.Random(3)
    cases = {e: sorted((round(rng.random() ** 3 * 4000, 1), rng.choice(["neutral"] * 12 + ["contradiction"] + ["corroboration"] * 4), rng.choice([0, 50, 200])) for _ in range(60)) for e in range(5)}
    one = {(r.event_id, r.claim_id): r.state for r in K.lifecycle(arrivals(spark, cases)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {(r.event_id, r.claim_id): r.state for r in K.lifecycle(arrivals(spark, cases)).collect()} == one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for e, case in cases.items():
        life = K.NEWBORN
        for i, (h, kind, stake) in enumerate(case):
            life = K._lived(life, h, kind, stake)
            want[e, i] = life[0]
    assert one == want and set(want.values()) == {"LIVE", "WARM", "DORMANT"}  # a claim makes STABLE WARM


def test_lifecycle_stream_is_the_batch(spark):
    stream = K.run_available(K.lifecycle_stream(K.claim_stream(spark, DATA)))
    batch = K.lifecycle(K.arrivals(spark.read.parquet(f"{DATA}/events.parquet")))
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))


def test_actions(spark):
    cases = {1: [(0, "neutral", 0), (0.5, "contradiction", 0), (0.6, "neutral", 0), (1.5, "neutral", 0), (4, "corroboration", 0)]}
    ticks = spark.createDataFrame([(1, at(h)) for h in (-1, 0, 1, 2, 3, 4, 10, 28, 28.5)], "event_id long, tick timestamp")
    rows = K.actions(arrivals(spark, cases), ticks).collect()
    got = [((r["at"] - START).total_seconds() / 3600, r.claim_id, r.action) for r in rows]
    assert sorted(got, key=lambda r: (r[0], r[1] is None)) == [
        (-1, None, "NO_OP"), (0, 0, "NO_OP"), (0, None, "REGENERATE_NARRATIVE"), (0.5, 1, "EMIT_THOUGHT"), (0.6, 2, "FULL_TOPOLOGY"),
        (1, None, "EMIT_THOUGHT"), (1.5, 3, "INCREMENTAL_TOPOLOGY"), (2, None, "REGENERATE_NARRATIVE"), (3, None, "EMIT_THOUGHT"), (4, 4, "INCREMENTAL_TOPOLOGY"),
        (4, None, "REGENERATE_NARRATIVE"), (10, None, "NO_OP"), (28, None, "NO_OP"), (28.5, None, "HIBERNATE"),
    ]


def test_online_clusters_emit_each_kind_of_change(spark, tmp_path):
    values = [0.0, 4.0, 2.0, 30.0, 31.0, 29.0, 30.0, 13.0, 12.0, 11.0, None, 6.9]
    df = spark.createDataFrame([(1, i, at(i), v) for i, v in enumerate(values)], "event_id long, claim_id long, ts timestamp, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = K.run_available(K.online_clusters(stream, 10.0, 12.0)).orderBy("claim_id", "level").collect()
    assert [(r.claim_id, r.level, r.cluster, r.change, r["size"]) for r in got] == [
        (0, 1, 0, "created", 1), (1, 1, 0, "absorbed", 2), (2, 1, 0, "absorbed", 3), (2, 2, 0, "created", 3),
        (3, 1, 1, "created", 1), (4, 1, 1, "absorbed", 2), (5, 1, 1, "absorbed", 3), (5, 2, 1, "created", 3), (6, 1, 1, "absorbed", 4), (6, 2, 1, "updated", 4),
        (7, 1, 2, "created", 1), (8, 1, 2, "absorbed", 2), (9, 1, 2, "absorbed", 3), (9, 2, 0, "merged", 6), (11, 1, 0, "absorbed", 4), (11, 2, 0, "updated", 7),
    ]
