"""Streams of claims: state per event, actions, rates, sessions, lifecycle (rows 196-208).

Each job has a batch form with the same results; late rows beyond the watermark are dropped by the
streams alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.operators.graph import shared_folder
from claimloom.operators.relational import dealt

# Rules of an event's upkeep.
MIN_CLAIMS_FOR_TOPOLOGY = 5
ACTIVE_HOURS, HIBERNATE_HOURS, NARRATIVE_HOURS = 6, 24, 1
CONTRADICTION_SHARE, COHERENCE_DROP = 0.5, 0.15

# Lifecycle thresholds (idle hours, claims an hour, share of contradictions), half-lives of the
# claim counts of the last hour and day, and the stake that wakes a dormant event.
LIVE_TO_WARM_HOURS, QUIET_HOURS, WARM_TO_STABLE_HOURS, STABLE_TO_DORMANT_HOURS, LIVE_CLAIMS = 1.0, 0.5, 6.0, 72.0, 3
TENSION_SHARE, HOUR_HALF_LIFE, DAY_HALF_LIFE, WAKE_STAKE = 0.2, 1.0, 24.0, 100

CLAIM_STREAM = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def claim_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals as a stream: (event_id, claim_id, ts, kind, stake) from the event table."""
    raw = spark.readStream.schema(CLAIM_STREAM).parquet(f"{sf_dir}/events.parque[t]")
    return arrivals(raw)


def arrivals(raw: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "contradiction").when(F.col("event_type") == "purchase", "corroboration").otherwise("neutral")
    return raw.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("claim_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.get_json_object("props", "$.k").cast("int").alias("stake"))


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there, into a table in the shared folder, and read that."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def action(claims: Column, corroborated: Column, contradicted: Column) -> Column:
    """#197. What the arrival of a claim asks for: topology once there are enough claims, then updates of
    it; a thought where contradictions are over half."""
    share = contradicted / F.greatest(corroborated + contradicted, F.lit(1))
    return F.when(claims < MIN_CLAIMS_FOR_TOPOLOGY, "NO_OP").when(claims == MIN_CLAIMS_FOR_TOPOLOGY, "FULL_TOPOLOGY").when(share > CONTRADICTION_SHARE, "EMIT_THOUGHT").otherwise("INCREMENTAL_TOPOLOGY")


def upkeep(arrived: DataFrame) -> DataFrame:
    """#196, #197 in batch: after each claim its event's counts and the action."""
    w = Window.partitionBy("event_id").orderBy("ts", "claim_id").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).over(w)
    out = arrived.withColumns({"claims": F.count("*").over(w), "corroborated": n("corroboration"), "contradicted": n("contradiction")})
    return out.select("event_id", "claim_id", "claims", "corroborated", "contradicted", action(F.col("claims"), F.col("corroborated"), F.col("contradicted")).alias("action"))


def upkeep_stream(stream: DataFrame) -> DataFrame:
    """#196, #197 as a stream: state per event holds its counts; within a batch claims go by time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, good, bad = state.get if state.exists else (0, 0, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "claim_id"])
        count = np.arange(1, len(pdf) + 1) + n
        c, x = good + (pdf.kind == "corroboration").cumsum().to_numpy(), bad + (pdf.kind == "contradiction").cumsum().to_numpy()
        state.update((int(count[-1]), int(c[-1]), int(x[-1])))
        share = x / np.maximum(c + x, 1)
        what = np.select([count < MIN_CLAIMS_FOR_TOPOLOGY, count == MIN_CLAIMS_FOR_TOPOLOGY, share > CONTRADICTION_SHARE], ["NO_OP", "FULL_TOPOLOGY", "EMIT_THOUGHT"], "INCREMENTAL_TOPOLOGY")
        yield pd.DataFrame({"event_id": key[0], "claim_id": pdf.claim_id.to_numpy(), "claims": count, "corroborated": c, "contradicted": x, "action": what})

    schema = "event_id long, claim_id long, claims long, corroborated long, contradicted long, action string"
    return stream.groupBy("event_id").applyInPandasWithState(update, schema, "n long, good long, bad long", "append", "NoTimeout")


def ticks(arrived: DataFrame, hours: int = 1, parts: int | None = None) -> DataFrame:
    """#198, #199. At each hourly tick of an event's span: idle hours, hibernation (a day idle), activity (6 h)."""
    step = f"INTERVAL {hours} HOURS"
    span = arrived.groupBy("event_id").agg(F.date_trunc("hour", F.min("ts")).alias("lo"), F.max("ts").alias("hi"))
    t = span.select("event_id", F.explode(F.sequence(F.col("lo") + F.expr(step), F.col("hi") + F.expr(step), F.expr(step))).alias("tick"))
    both = t.select("event_id", F.col("tick").alias("at"), F.lit(None).cast("timestamp").alias("ts"), F.lit(1).alias("is_tick")).unionByName(
        arrived.select("event_id", F.col("ts").alias("at"), "ts", F.lit(0).alias("is_tick"))
    )
    w = Window.partitionBy("event_id").orderBy("at", "is_tick").rowsBetween(Window.unboundedPreceding, 0)
    last = dealt(both, parts, "event_id").withColumn("last", F.max("ts").over(w)).filter("is_tick = 1")
    idle = F.round((F.unix_micros("at") - F.unix_micros("last")) / 3.6e9, 6)
    return last.select("event_id", F.col("at").alias("tick"), idle.alias("idle_hours"), (idle >= HIBERNATE_HOURS).alias("hibernate"), (idle < ACTIVE_HOURS).alias("active"))


def lifecycle(arrived: DataFrame) -> DataFrame:
    """#200 in batch: the state of an event after each claim, by time and id, from LIVE.

    While an event is idle its claims of the last hour are halved each hour, those of the last day each day
    (whole numbers, the day's from a day's idleness on), and without tension it cools: LIVE after an hour, or
    half an hour with under three claims left of the last hour; WARM after six hours with under three left;
    STABLE after three days with none left.  Tension is an open contradiction (a corroboration closes one), or
    contradictions of over a fifth of the day's claims.  A claim makes STABLE WARM; three claims left of the last hour,
    or tension, make WARM LIVE.  A claim of a dormant event wakes it, to WARM and at once by the same rules, if its
    stake is enough, else it is ignored.  Null stakes are 0; a null time counts as no time passed and comes first.

    One event's claims go through one task in order, in batches; only its counts are held.
    """
    rows = arrived.select("event_id", "claim_id", "ts", "kind", "stake").repartition("event_id").sortWithinPartitions("event_id", "ts", "claim_id")
    return rows.mapInPandas(_replayed, "event_id long, claim_id long, state string")


#: State, claims of the last hour and day, contradictions in all and open ones, time of the last claim in hours.
Life = tuple[str, int, int, int, int, float | None]
NEWBORN: Life = ("LIVE", 0, 0, 0, 0, None)


def _cooled(state: str, idle: float, hour: int) -> str:
    """The state of an event without tension after ``idle`` hours."""
    if state == "LIVE" and idle > (LIVE_TO_WARM_HOURS if hour >= LIVE_CLAIMS else QUIET_HOURS):
        state = "WARM"
    if state == "WARM" and idle > WARM_TO_STABLE_HOURS and hour < LIVE_CLAIMS:
        state = "STABLE"
    if state == "STABLE" and idle > STABLE_TO_DORMANT_HOURS and not hour:
        state = "DORMANT"
    return state


def _lived(life: Life, at: float | None, kind: str, stake: float) -> Life:
    """An event's life after a claim at ``at``."""
    state, hour, day, bad, open_, last = life
    tense = lambda: open_ > 0 or bad > TENSION_SHARE * max(1, day)
    idle = 0.0 if at is None or last is None else max(0.0, at - last)
    hour = int(hour * 0.5 ** (idle / HOUR_HALF_LIFE))
    day = int(day * 0.5 ** (idle / DAY_HALF_LIFE)) if idle >= 24 else day
    state = state if tense() else _cooled(state, idle, hour)
    if state == "DORMANT":
        if stake < WAKE_STAKE:
            return (state, *life[1:])
        state = "WARM"
    hour, day, last = hour + 1, day + 1, last if at is None else at
    bad += kind == "contradiction"
    open_ = max(0, open_ + (kind == "contradiction") - (kind == "corroboration"))
    if state == "STABLE":
        state = "WARM"
    elif state == "WARM" and (hour >= LIVE_CLAIMS or tense()):
        state = "LIVE"
    return state, hour, day, bad, open_, last


def _facts(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(event, claim, hours, kind, stake) of rows."""
    hours = pdf.ts.to_numpy("datetime64[us]").astype("int64") / 3.6e9
    at = [None if n else h for n, h in zip(pdf.ts.isna(), hours.tolist())]
    return zip(pdf.event_id.tolist(), pdf.claim_id.tolist(), at, pdf.kind.tolist(), pdf.stake.fillna(0).tolist())


def _replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before, life = object(), NEWBORN
    for pdf in batches:
        states = []
        for event, _, at, kind, stake in _facts(pdf):
            life = _lived(life if event == before else NEWBORN, at, kind, stake)
            before = event
            states.append(life[0])
        yield pd.DataFrame({"event_id": pdf.event_id, "claim_id": pdf.claim_id, "state": states})


def lifecycle_stream(stream: DataFrame) -> DataFrame:
    """#200 as a stream, with the life of each event kept; within a batch claims go by time."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        life = state.get if state.exists else NEWBORN
        pdf = pd.concat(list(batches)).sort_values(["ts", "claim_id"], na_position="first")
        states = []
        for _, _, at, kind, stake in _facts(pdf):
            life = _lived(life, at, kind, stake)
            states.append(life[0])
        state.update(life)
        yield pd.DataFrame({"event_id": key[0], "claim_id": pdf.claim_id.to_numpy(), "state": states})

    kept = "state string, hour long, day long, bad long, open long, last double"
    return stream.groupBy("event_id").applyInPandasWithState(update, "event_id long, claim_id long, state string", kept, "append", "NoTimeout")


def anomalies(arrived: DataFrame, every: int = 10) -> DataFrame:
    """#201. Thoughts at every tenth claim of an event: contradictions over half, or coherence down by .15
    since the tenth claim before."""
    u = upkeep(arrived).filter(F.pmod("claims", F.lit(every)) == 0)
    total = F.greatest(F.col("corroborated") + F.col("contradicted"), F.lit(1))
    u = u.withColumn("coherence", F.col("corroborated") / total)
    before = F.lag("coherence").over(Window.partitionBy("event_id").orderBy("claims"))
    kind = F.when(F.col("contradicted") / total > CONTRADICTION_SHARE, "contradiction").when(before - F.col("coherence") > COHERENCE_DROP, "coherence_drop")
    return u.select("event_id", "claims", kind.alias("thought")).filter("thought IS NOT NULL")


def deduplicated(stream: DataFrame, key: str = "claim_id", delay: str = "2 days") -> DataFrame:
    """#203. The first row of each id within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def rates(arrived: DataFrame, window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """#204. Claims per event and window, tumbling or sliding; for streams set a watermark first."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return arrived.groupBy("event_id", w.alias("w")).agg(F.count("*").alias("claims")).select("event_id", F.col("w.start").alias("start"), "claims")


def sliding_merge_rate(arrived: DataFrame, last: int = 20) -> DataFrame:
    """#205. Share of corroborations among an event's last 20 arrivals, at each."""
    w = Window.partitionBy("event_id").orderBy("ts", "claim_id").rowsBetween(-(last - 1), 0)
    return arrived.select("event_id", "claim_id", F.round(F.avg((F.col("kind") == "corroboration").cast("int")).over(w), 6).alias("merge_rate"))


def sessions(arrived: DataFrame, gap: str = "6 hours") -> DataFrame:
    """#206. Runs of an event's claims without an idle gap."""
    g = arrived.groupBy("event_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("claims"))
    return g.select("event_id", F.col("s.start").alias("start"), "claims")


def versions(arrived: DataFrame, rise: float = 0.1) -> DataFrame:
    """#207. Version of an event after each of its tenth claims: major up where coherence rose by ``rise``,
    else minor up; minors start anew with a major."""
    u = upkeep(arrived).filter(F.pmod("claims", F.lit(10)) == 0)
    u = u.withColumn("coherence", F.col("corroborated") / F.greatest(F.col("corroborated") + F.col("contradicted"), F.lit(1)))
    w = Window.partitionBy("event_id").orderBy("claims")
    u = u.withColumn("_up", F.coalesce((F.col("coherence") - F.lag("coherence").over(w) >= rise).cast("int"), F.lit(0)))
    u = u.withColumn("major", F.sum("_up").over(w))
    minor = F.row_number().over(Window.partitionBy("event_id", "major").orderBy("claims")) - 1
    return u.select("event_id", "claims", "major", minor.alias("minor"))


def contributions(stream: DataFrame, events: DataFrame) -> DataFrame:
    """#208. Outcome and reward of contributions (event_id, claim_id, kind, stake) against a static table of
    events: unknown ones are unrelated; contradictions earn half the stake, corroborations a fifth, others a tenth."""
    j = stream.join(events.select("event_id", F.lit(True).alias("_known")), "event_id", "left")
    outcome = F.when(F.col("_known").isNull(), "unrelated").otherwise("accepted")
    rate = F.when(F.col("_known").isNull(), 0.0).when(F.col("kind") == "contradiction", 0.5).when(F.col("kind") == "corroboration", 0.2).otherwise(0.1)
    return j.select("event_id", "claim_id", outcome.alias("outcome"), F.round(rate * F.col("stake"), 6).alias("reward"))


def online_clusters(stream: DataFrame, least: float = 10.0, merge: float = 5.0, ready: int = 3) -> DataFrame:
    """#202. Change events of online clustering by value, in two levels, of claims (event_id, claim_id, ts, value).

    A claim within ``least`` of the nearest running mean of its event's clusters is ``absorbed`` by that (ties: the
    older), another is ``created`` as a cluster.  A cluster of ``ready`` claims without a parent is then ``merged`` into
    the nearest parent whose mean of cluster means is within ``merge``, else a parent is ``created`` (level 2) with it.
    A claim that a cluster with a parent absorbs makes that ``updated``.  Rows carry the claim that caused them,
    the level, the number of the cluster or parent, and its claims so far.  Null values are left out.
    """

    def nearest(means: np.ndarray, value: float, within: float) -> int | None:
        i = int(np.abs(means - value).argmin()) if len(means) else None
        return i if i is not None and abs(means[i] - value) <= within else None

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # per cluster: mean, claims, parent (-1: none); per parent: mean of means, clusters, claims
        kept = state.get if state.exists else ([], [], [], [], [], [])
        (means, counts, parents), (upper, clusters, claims) = ([np.array(x, t) for x, t in zip(kept[i : i + 3], types)] for i, types in ((0, (float, int, int)), (3, (float, int, int))))
        pdf = pd.concat(list(batches)).dropna(subset=["value"]).sort_values(["ts", "claim_id"])
        rows = []
        for claim, value in zip(pdf.claim_id.tolist(), pdf.value.tolist()):
            i = nearest(means, value, least)
            change = "created" if i is None else "absorbed"
            if i is None:
                i, means, counts, parents = len(means), np.append(means, 0.0), np.append(counts, 0), np.append(parents, -1)
            counts[i] += 1
            means[i] += (value - means[i]) / counts[i]
            rows.append((claim, 1, i, change, counts[i]))
            p = parents[i]
            if p >= 0:
                claims[p] += 1
                rows.append((claim, 2, p, "updated", claims[p]))
            elif counts[i] >= ready:
                p = nearest(upper, means[i], merge)
                change = "created" if p is None else "merged"
                if p is None:
                    p, upper, clusters, claims = len(upper), np.append(upper, 0.0), np.append(clusters, 0), np.append(claims, 0)
                parents[i] = p
                clusters[p] += 1
                upper[p] += (means[i] - upper[p]) / clusters[p]
                claims[p] += counts[i]
                rows.append((claim, 2, p, change, claims[p]))
        state.update(tuple(x.tolist() for x in (means, counts, parents, upper, clusters, claims)))
        yield pd.DataFrame(rows, columns=["claim_id", "level", "cluster", "change", "size"]).assign(event_id=key[0])[["event_id", "claim_id", "level", "cluster", "change", "size"]]

    kept = "means array<double>, counts array<long>, parents array<long>, upper array<double>, clusters array<long>, claims array<long>"
    return stream.groupBy("event_id").applyInPandasWithState(update, "event_id long, claim_id long, level int, cluster int, change string, size long", kept, "append", "NoTimeout")


def actions(arrived: DataFrame, ticks: DataFrame, least: int = 3, parts: int | None = None) -> DataFrame:
    """#197 with ticks. What each claim (event_id, claim_id, ts, kind) and tick (event_id, tick) asks for, by the first
    rule that holds: at the ``least``-th claim FULL_TOPOLOGY, after that INCREMENTAL_TOPOLOGY; at a tick
    REGENERATE_NARRATIVE if claims came since the last one, the newest within six hours, and that one, if
    any, is over an hour ago; HIBERNATE after over a day idle; EMIT_THOUGHT where contradictions are over half of the links;
    else NO_OP.  At equal times claims come before ticks; claims before the ``least``-th give a thought or NO_OP.

    Whether a narrative is stale depends on the one before, so an event's rows go through one task in order, in
    batches; the counts come from windows, over the same ``parts``.
    """
    a = arrived.select("event_id", "claim_id", F.col("ts").alias("at"), "kind")
    t = ticks.select("event_id", F.lit(None).cast("long").alias("claim_id"), F.col("tick").alias("at"), F.lit(None).cast("string").alias("kind"))
    w = Window.partitionBy("event_id").orderBy("at", F.col("claim_id").isNull(), "claim_id").rowsBetween(Window.unboundedPreceding, 0)
    n = lambda k: F.count(F.when(F.col("kind") == k, 1)).over(w)
    both = a.unionByName(t)
    rows = (dealt(both, parts, "event_id") if parts else both.repartition("event_id")).withColumns({
        "claims": F.count("claim_id").over(w), "corroborated": n("corroboration"), "contradicted": n("contradiction"), "newest": F.max(F.when(F.col("claim_id").isNotNull(), F.col("at"))).over(w),
    })
    rows = rows.withColumns({"hours": F.unix_micros("at") / 3.6e9, "idle": (F.unix_micros("at") - F.unix_micros("newest")) / 3.6e9})
    share = F.col("contradicted") / F.greatest(F.col("corroborated") + F.col("contradicted"), F.lit(1))
    tick = F.col("claim_id").isNull()
    rest = F.when(tick & (F.col("idle") > HIBERNATE_HOURS), "HIBERNATE").when(share > CONTRADICTION_SHARE, "EMIT_THOUGHT").otherwise("NO_OP")
    action = F.when(F.col("claims") == 0, "NO_OP").when(~tick & (F.col("claims") > least), "INCREMENTAL_TOPOLOGY").when(~tick & (F.col("claims") == least), "FULL_TOPOLOGY").otherwise(rest)
    rows = rows.select("event_id", "claim_id", "at", "claims", "hours", (tick & (F.col("idle") < ACTIVE_HOURS)).alias("active"), action.alias("action"))
    return rows.sortWithinPartitions("event_id", "at", F.col("claim_id").isNull(), "claim_id").mapInPandas(_narrated, "event_id long, claim_id long, at timestamp, action string")


def _narrated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    before, told, told_at = object(), 0, float("-inf")
    for pdf in batches:
        out = pdf.action.tolist()
        for i, (event, n, hours, active) in enumerate(zip(pdf.event_id.tolist(), pdf.claims.tolist(), pdf.hours.tolist(), pdf.active.tolist())):
            if event != before:
                before, told, told_at = event, 0, float("-inf")
            if active and n > told and hours - told_at > NARRATIVE_HOURS:
                out[i], told, told_at = "REGENERATE_NARRATIVE", n, hours
        yield pd.DataFrame({"event_id": pdf.event_id, "claim_id": pdf.claim_id, "at": pdf["at"], "action": out})
