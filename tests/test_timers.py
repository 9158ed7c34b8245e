"""Streams with timers against their batch forms, over several small and unordered batches."""

import random
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from claimloom.operators import planes
from claimloom.streaming import claims as K
from claimloom.streaming import timers as T
from tests.test_streams import ARRIVALS, START, at


def random_arrivals(seed, events=4, n=60, hours=400):
    rng = random.Random(seed)
    kinds = ["neutral"] * 6 + ["contradiction"] + ["corroboration"] * 4
    return [(e, 1000 * e + i, at(round(rng.random() ** 2 * hours, 3)), rng.choice(kinds), rng.choice([0, 50, 200])) for e in range(events) for i in range(n)]


def streamed(spark, folder, rows, schema, batches=3):
    """A stream that takes a file a batch.  Rows go to the batches by time, but within a batch in no order."""
    rows = sorted(rows, key=lambda r: r[2])
    for k in range(batches):
        part = rows[k * len(rows) // batches : (k + 1) * len(rows) // batches]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def passed(rows, delay=timedelta(hours=1)):
    """What the last watermark has passed."""
    return max(r[2] for r in rows) - delay


def test_ticks_come_from_timers(spark, tmp_path):
    rows = random_arrivals(1)
    got = T.run_with_timers(T.tick_stream(streamed(spark, tmp_path, rows, ARRIVALS)))
    batch = T.sleepless(K.ticks(spark.createDataFrame(rows, ARRIVALS)))
    mark = passed(rows)
    newest = {e: max(r[2] for r in rows if r[0] == e) for e in range(4)}
    want = {tuple(r) for r in batch.collect() if r.tick <= mark}
    rows_of = [tuple(r) for r in got.collect()]
    assert len(set(rows_of)) == len(rows_of)
    # the batch form ends an hour after an event's last claim; timers go on until it hibernates
    assert {r for r in rows_of if r[1] <= newest[r[0]] + timedelta(hours=1)} == want
    ends = {e: [r for r in rows_of if r[0] == e and r[1] > newest[e] + timedelta(hours=1)] for e in newest}
    for e, more in ends.items():
        if newest[e] + timedelta(hours=26) < mark:
            assert sorted(more)[-1][3] and sum(r[3] for r in more) == 1
    assert any(ends.values()) and any(r[3] for r in rows_of)


def test_events_cool_between_claims(spark, tmp_path):
    rows = random_arrivals(2, hours=2500)
    got = sorted((r.event_id, r["at"], r.state, r.cause) for r in T.run_with_timers(T.cooling_stream(streamed(spark, tmp_path, rows, ARRIVALS))).collect())
    frame = spark.createDataFrame(rows, ARRIVALS)
    batch = [(r.event_id, r["at"], r.state, r.cause) for r in T.cooled_timeline(frame).collect()]
    mark = passed(rows)
    newest = {e: max(r[2] for r in rows if r[0] == e) for e in range(4)}
    assert [r for r in got if r[1] <= newest[r[0]]] == sorted(r for r in batch if r[1] <= mark)
    assert {r[3] for r in got} == {"claim", "idle"} and {r[2] for r in got} >= {"LIVE", "WARM", "STABLE"}
    # at each claim the state is that of the lifecycle
    states = {(r.event_id, r.claim_id): r.state for r in K.lifecycle(frame).collect()}
    for e, claim, when, _, _ in rows:
        if when <= mark and sum(r[0] == e and r[2] == when for r in rows) == 1:
            before = [r for r in got if r[0] == e and r[1] <= when]
            assert (before[-1][2] if before else "LIVE") == states[e, claim]


def test_cooling_times_are_those_of_the_rules():
    """Between claims: the state at any time is that of the rules with the idle time until then."""
    machine = T.Cooling()
    for n in (1, 3, 10, 200, 5000):
        memory = machine.load(machine.newborn)
        for i in range(n):
            list(machine.row(memory, 0, (i, "neutral", 0)))
        life = machine._life(memory)
        changes = list(machine.passes(memory, 400 * T.HOUR))
        for minute in range(0, 400 * 60, 7):
            idle = minute / 60
            want = K._cooled(life[0], idle, int(life[1] * 0.5 ** (idle / K.HOUR_HALF_LIFE)))
            now = [s for t, s, _ in changes if t <= idle * T.HOUR]
            assert (now[-1] if now else life[0]) == want, (n, idle)


def test_rings_thoughts_and_versions(spark, tmp_path):
    rows = random_arrivals(3, events=3, n=90)
    got = {r.claim_id: r for r in T.run_with_timers(T.track_stream(streamed(spark, tmp_path, rows, ARRIVALS, 4))).collect()}
    frame = spark.createDataFrame(rows, ARRIVALS)
    mark = passed(rows)
    rates = {r.claim_id: r.merge_rate for r in K.sliding_merge_rate(frame).collect()}
    assert {c: r.merge_rate for c, r in got.items()} == {r[1]: rates[r[1]] for r in rows if r[2] <= mark}
    tenth = {(r.event_id, r.claims): r for r in got.values() if r.claims % 10 == 0}
    thoughts = {(r.event_id, r.claims): r.thought for r in K.anomalies(frame).collect() if (r.event_id, r.claims) in tenth}
    assert {k: r.thought for k, r in tenth.items() if r.thought} == thoughts and thoughts
    versions = {(r.event_id, r.claims): (r.major, r.minor) for r in K.versions(frame).collect() if (r.event_id, r.claims) in tenth}
    assert {k: (r.major, r.minor) for k, r in tenth.items()} == versions
    assert all(r.major is None for r in got.values() if r.claims % 10)


def leaders(rows, least, merge, ready):
    """Online clustering of the rows of a key, one by one."""
    clusters, parents, out = [], [], []
    cosine = lambda a, b: round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
    for claim, v in rows:
        v = np.array(v) / np.linalg.norm(v)
        near = max(((cosine(c["sum"], v), -i) for i, c in enumerate(clusters)), default=(-2, 0))
        if near[0] >= least:
            c, change = clusters[-near[1]], "absorbed"
        else:
            c, change = {"sum": np.zeros(len(v)), "n": 0, "parent": None}, "created"
            clusters.append(c)
        c["sum"] = c["sum"] + v
        c["n"] += 1
        out.append((claim, 1, next(i for i, x in enumerate(clusters) if x is c), change, c["n"]))
        if c["parent"] is not None:
            parents[c["parent"]]["n"] += 1
            out.append((claim, 2, c["parent"], "updated", parents[c["parent"]]["n"]))
        elif c["n"] >= ready:
            centre = c["sum"] / np.linalg.norm(c["sum"])
            near = max(((cosine(p["sum"], centre), -i) for i, p in enumerate(parents)), default=(-2, 0))
            if near[0] >= merge:
                p, change = -near[1], "merged"
            else:
                p, change = len(parents), "created"
                parents.append({"sum": np.zeros(len(v)), "n": 0})
            c["parent"] = p
            parents[p]["sum"] = parents[p]["sum"] + centre
            parents[p]["n"] += c["n"]
            out.append((claim, 2, p, change, parents[p]["n"]))
    return out


def test_vector_leaders_are_those_of_a_loop(spark, tmp_path):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(9, 8))
    rows = [(int(i % 2), i, START + timedelta(minutes=int(i)), [float(x) for x in centres[rng.integers(9)] + rng.normal(size=8) * 0.5]) for i in range(240)]
    rows += [(0, 900, START, None), (1, 901, START, [0.0] * 8)]
    schema = "event_id long, claim_id long, ts timestamp, vector array<double>"
    stream = planes.with_block(streamed(spark, tmp_path, rows, schema, 5), "vector", 8, 2)
    got = [tuple(r) for r in T.run_with_timers(T.leader_stream(stream, "5 minutes", 0.8, 0.5)).select("event_id", "block", "claim_id", "level", "cluster", "change", "size").collect()]
    blocks = {r.claim_id: r.block for r in planes.with_block(spark.createDataFrame(rows, schema), "vector", 8, 2).collect()}
    mark = passed(rows, timedelta(minutes=5))
    want = []
    for key in {(r[0], blocks[r[1]]) for r in rows if r[1] < 900}:
        own = [(r[1], r[3]) for r in sorted(rows, key=lambda r: (r[2], r[1])) if r[1] < 900 and (r[0], blocks[r[1]]) == key and r[2] <= mark]
        want += [(*key, *x) for x in leaders(own, 0.8, 0.5, 3)]
    assert sorted(got) == sorted(want) and {r[5] for r in got} == {"created", "absorbed", "merged", "updated"}
    assert len({r[1] for r in got}) > 2


def test_session_keeps_its_provider(spark, tmp_path):
    before = spark.conf.get(T.PROVIDER)
    rows = random_arrivals(4, events=1, n=5)
    T.run_with_timers(T.tick_stream(streamed(spark, tmp_path, rows, ARRIVALS, 1)))
    assert spark.conf.get(T.PROVIDER) == before
