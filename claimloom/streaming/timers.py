"""Streams with timers and structured state: ticks, cooling, rings, versions, leaders, contributions (rows 118, 198-202, 205,
207, 208).

A ``Machine`` says what one row of a key does and what happens by itself as time goes on.  ``Ordered`` keeps a key's
rows until the watermark has passed them, and then lets the machine take them by time, with what time brings in
between.  So the results don't hang on how rows are dealt out over batches, and equal the batch forms for all rows up
to the last watermark.  Rows that are late are dropped by the watermark, rows without a time never leave it.

The streams need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimloom.functions import vectors as V
from claimloom.streaming import claims as K

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000  # in microseconds, as all times here


def run_with_timers(stream: DataFrame) -> DataFrame:
    """``claims.run_available`` with the RocksDB provider for this query alone; a query keeps the provider that it
    was started with."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return K.run_available(stream)
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


class Machine:
    """What a key does.  ``columns`` are the columns of a row besides its time, ``order`` that by which rows of equal times
    go; ``memory`` is the schema of what a key remembers, ``newborn`` its first value; ``out`` the schema of the rows that it emits."""

    columns: str
    order: int = 0
    memory: str
    newborn: tuple
    out: str

    def load(self, kept: tuple) -> Any:
        """What the other methods work on, from the kept values."""
        return list(kept)

    def dump(self, memory: Any) -> tuple:
        """The values to keep."""
        return tuple(memory)

    def row(self, memory: Any, at: int, values: tuple) -> Iterator[tuple]:
        """Take a row; yield rows to emit."""
        raise NotImplementedError

    def wakes(self, memory: Any) -> int | None:
        """When something happens next if no row comes."""
        return None

    def passes(self, memory: Any, until: int) -> Iterator[tuple]:
        """Let time pass up to ``until``; yield rows to emit."""
        yield from ()


def _plain(v: Any) -> Any:
    """A value of a pandas row as the state store takes it: lists for arrays, None for what is missing."""
    if isinstance(v, np.ndarray):
        return v.tolist()
    return None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v


class Ordered(StatefulProcessor):
    """Feeds a machine with rows by time."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("memory", self.machine.memory)
        self.waiting = handle.getListState("waiting", f"at long, {self.machine.columns}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in self.machine.columns.split(", ")]
        first = None
        for pdf in rows:  # a batch at a time: a hot key's rows are never held together
            at = pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            columns = [[_plain(v) for v in pdf[c].tolist()] for c in names]
            self.waiting.appendList(list(zip(at, *columns)))
            first = min(at + ([] if first is None else [first]))
        if first is not None:
            self._wake(first)
        yield from ()

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine, until = self.machine, timerValues.getCurrentWatermarkInMs() * 1000
        due, rest = [], []
        for r in self.waiting.get():
            (due if r[0] <= until else rest).append(tuple(r))
        memory = machine.load(tuple(self.kept.get()) if self.kept.exists() else machine.newborn)
        if not due and (machine.wakes(memory) is None or machine.wakes(memory) > until):
            return  # another timer of this watermark has done it
        due.sort(key=lambda r: (r[0], r[1 + machine.order]))
        out = []
        for at, *values in due:
            out += machine.passes(memory, at - 1)
            out += machine.row(memory, at, tuple(values))
        out += machine.passes(memory, until)
        self.kept.update(machine.dump(memory))
        if due:
            self.waiting.put(rest) if rest else self.waiting.clear()
        nexts = [t for t in (min((r[0] for r in rest), default=None), machine.wakes(memory)) if t is not None]
        if nexts:
            self._wake(max(min(nexts), until + 1))
        if out:
            names = [c.split(" ")[0] for c in machine.out.split(", ")]
            pdf = pd.DataFrame(out, columns=names)
            for c in names:
                if c in ("tick", "at"):
                    pdf[c] = pd.to_datetime(pdf[c], unit="us")
            for n, k in zip(self.keys, key):
                pdf[n] = k
            yield pdf[[*self.keys, *names]]

    keys: tuple[str, ...] = ("event_id",)


def driven(stream: DataFrame, machine: Machine, delay: str, keys: tuple[tuple[str, str], ...] = (("event_id", "long"),)) -> DataFrame:
    """The rows that a machine per key emits; ``stream`` has the keys, ``ts`` and the machine's columns."""
    processor = Ordered(machine)
    processor.keys = tuple(k for k, _ in keys)
    names = [c.split(" ")[0] for c in machine.columns.split(", ")]
    rows = stream.withWatermark("ts", delay).select(*processor.keys, "ts", *names)
    schema = ", ".join([*(f"{k} {t}" for k, t in keys), machine.out])
    return rows.groupBy(*processor.keys).transformWithStateInPandas(processor, schema, "append", "eventTime")


class Ticks(Machine):
    """An event's hourly ticks from the hour of its first claim on, until it has been idle for a day: that tick says
    hibernate, and no more come before the next claim, after which they go on with the next hour."""

    columns, memory, newborn = "claim_id long", "next long, last long", (None, None)
    out = "tick timestamp, idle_hours double, hibernate boolean, active boolean"

    def row(self, memory, at, values):
        memory[1] = at
        if memory[0] is None:
            memory[0] = at // HOUR * HOUR + HOUR
        yield from ()

    def wakes(self, memory):
        return memory[0]

    def passes(self, memory, until):
        while memory[0] is not None and memory[0] <= until:
            tick = memory[0]
            hours = (tick - memory[1]) / HOUR
            idle = round(hours, 6)
            asleep = idle >= K.HIBERNATE_HOURS
            memory[0] = None if asleep else tick + HOUR
            yield tick, hours, asleep, idle < K.ACTIVE_HOURS


class Cooling(Machine):
    """An event's lifecycle (``claims.lifecycle``) with the changes that time alone brings: a row whenever the state has
    changed, at the moment it does, with what changed it (``claim`` or ``idle``)."""

    columns, memory, newborn = "claim_id long, kind string, stake int", "state string, hour long, day long, bad long, open long, last long, now string", (*K.NEWBORN, "LIVE")
    out = "at timestamp, state string, cause string"

    @staticmethod
    def _life(memory):
        state, hour, day, bad, open_, last, _ = memory
        return state, hour, day, bad, open_, None if last is None else last / HOUR

    def row(self, memory, at, values):
        _, kind, stake = values
        before = memory[6]
        life = K._lived(self._life(memory), at / HOUR, kind, stake or 0)
        if life[5] != self._life(memory)[5]:  # a dormant event ignores a claim of little stake
            memory[5] = at
        memory[:5] = life[:5]
        memory[6] = life[0]
        if life[0] != before:
            yield at, life[0], "claim"

    def _step(self, memory):
        """When and to what the state next cools."""
        state, hour, day, bad, open_, last, now = memory
        tense = lambda idle: open_ > 0 or bad > K.TENSION_SHARE * max(1, int(day * 0.5 ** (idle / K.DAY_HALF_LIFE)) if idle >= 24 else day)
        if last is None or now == "DORMANT":
            return None
        few = np.log2(hour / K.LIVE_CLAIMS) if hour >= K.LIVE_CLAIMS else 0.0  # idle hours after which under three claims are left
        none = np.log2(hour) if hour >= 1 else 0.0
        idle, to = {
            "LIVE": (min(K.LIVE_TO_WARM_HOURS, max(K.QUIET_HOURS, few)), "WARM"),
            "WARM": (max(K.WARM_TO_STABLE_HOURS, few), "STABLE"),
            "STABLE": (max(K.STABLE_TO_DORMANT_HOURS, none), "DORMANT"),
        }[now]
        return None if tense(idle) else (last + int(idle * HOUR) + 1, to)

    def wakes(self, memory):
        step = self._step(memory)
        return step and step[0]

    def passes(self, memory, until):
        while (step := self._step(memory)) and step[0] <= until:
            memory[6] = step[1]
            yield step[0], step[1], "idle"


class Track(Machine):
    """After each claim the share of corroborations among the event's last 20 (a ring), and at every tenth claim a
    thought, if there is cause, and the event's version (``claims.sliding_merge_rate``, ``anomalies``, ``versions``)."""

    columns = "claim_id long, kind string"
    memory = "n long, good long, bad long, ring array<int>, before double, major long, minor long"
    newborn = (0, 0, 0, [], None, 0, -1)
    out = "claim_id long, claims long, merge_rate double, thought string, major long, minor long"

    def __init__(self, last: int = 20, every: int = 10, rise: float = 0.1) -> None:
        self.last, self.every, self.rise = last, every, rise

    def row(self, memory, at, values):
        claim, kind = values
        n, good, bad, ring, before, major, minor = memory
        n, good, bad = n + 1, good + (kind == "corroboration"), bad + (kind == "contradiction")
        ring = list(ring)
        if len(ring) < self.last:
            ring.append(int(kind == "corroboration"))
        else:
            ring[(n - 1) % self.last] = int(kind == "corroboration")
        rate = round(sum(ring) / len(ring), 6)
        if n % self.every:
            yield claim, n, rate, None, None, None
        else:
            links = max(good + bad, 1)
            coherence = good / links
            fall = 0.0 if before is None else before - coherence
            thought = "contradiction" if bad / links > K.CONTRADICTION_SHARE else "coherence_drop" if fall > K.COHERENCE_DROP else None
            up = before is not None and coherence - before >= self.rise
            major, minor, before = major + up, 0 if up else minor + 1, coherence
            yield claim, n, rate, thought, major, minor
        memory[:] = [n, good, bad, ring, before, major, minor]


class Leaders(Machine):
    """Online clustering by vectors in two levels, as ``claims.online_clusters`` does by numbers: a claim is absorbed by
    the nearest centroid of cosine ``least`` or more (ties: the older), else it founds a cluster; a cluster of ``ready``
    claims without a parent joins the nearest parent of cosine ``merge``, or founds one.  Centroids are sums of unit vectors.

    A key is an event and a block of hyperplane signs (``planes.block``), so that a key holds the clusters of one
    cone; vectors on both sides of a hyperplane aren't compared.  All vectors of a key have one size; null and zero
    vectors emit nothing.
    """

    columns = "claim_id long, vector array<double>"
    memory = "size long, sums array<double>, counts array<long>, parents array<long>, upper array<double>, claims array<long>"
    newborn = (0, [], [], [], [], [])
    out = "claim_id long, level int, cluster long, change string, size long"

    def __init__(self, least: float = 0.7, merge: float = 0.6, ready: int = 3) -> None:
        self.least, self.merge, self.ready = least, merge, ready

    def load(self, kept):
        size, sums, counts, parents, upper, claims = kept
        return [size, V.Grown(list(sums), size), list(counts), list(parents), V.Grown(list(upper), size), list(claims)]

    def dump(self, memory):
        size, sums, counts, parents, upper, claims = memory
        return size, sums.rows[: sums.n].ravel().tolist(), counts, parents, upper.rows[: upper.n].ravel().tolist(), claims

    def row(self, memory, at, values):
        claim, vector = values
        norm = float(np.linalg.norm(vector)) if vector is not None and len(vector) else 0.0
        if not norm:
            return
        v = np.asarray(vector, float) / norm
        memory[0] = size = len(v)
        _, sums, counts, parents, upper, claims = memory
        i = sums.nearest(v, self.least)
        change = "created" if i is None else "absorbed"
        if i is None:
            i = sums.new(size)
            counts.append(0)
            parents.append(-1)
        sums.rows[i] += v
        counts[i] += 1
        yield claim, 1, i, change, counts[i]
        p = parents[i]
        if p >= 0:
            claims[p] += 1
            yield claim, 2, p, "updated", claims[p]
        elif counts[i] >= self.ready:
            centre = sums.rows[i] / np.linalg.norm(sums.rows[i])
            p = upper.nearest(centre, self.merge)
            change = "created" if p is None else "merged"
            if p is None:
                p = upper.new(size)
                claims.append(0)
            parents[i] = p
            upper.rows[p] += centre
            claims[p] += counts[i]
            yield claim, 2, p, change, claims[p]


class Judge(Machine):
    """Outcomes of contributions with one text to one event: ``duplicate`` if the text is listed as known, or was accepted
    before; else ``unrelated`` below the cosine that its kind of source needs, else ``accepted``.  The reward of an
    accepted one is half the stake for a contradiction, a fifth for a corroboration, a tenth else."""

    columns = "claim_id long, kind string, stake int, cosine double, url boolean, listed boolean"
    memory, newborn = "known boolean", (False,)
    out = "claim_id long, outcome string, reward double"

    def __init__(self, text_least: float = 0.4, url_least: float = 0.5) -> None:
        self.text_least, self.url_least = text_least, url_least

    def row(self, memory, at, values):
        claim, kind, stake, cosine, url, listed = values
        related = cosine is not None and cosine >= (self.url_least if url else self.text_least)
        outcome = "duplicate" if listed or memory[0] else "accepted" if related else "unrelated"
        memory[0] = memory[0] or outcome == "accepted"
        rate = {"contradiction": 0.5, "corroboration": 0.2}.get(kind, 0.1) if outcome == "accepted" else 0.0
        yield claim, outcome, round(rate * (stake or 0), 6)


def judged_stream(stream: DataFrame, known: DataFrame, events: DataFrame, delay: str = "1 hour", text_least: float = 0.4, url_least: float = 0.5) -> DataFrame:
    """#208 as a stream: contributions (event_id, claim_id, ts, kind, stake, text, vector, url) against static tables of known
    texts (event_id, text) and of events (event_id, vector).

    Texts are trimmed and told apart by a fingerprint; texts known and duplicates within the stream are both found by it,
    the latter through state that a key of event and fingerprint keeps.  A null text is empty; without a vector on
    either side a contribution is unrelated.
    """
    mark = F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256)
    listed = known.select("event_id", mark.alias("mark")).distinct().withColumn("_listed", F.lit(True))
    rows = stream.withColumn("mark", mark).join(listed, ["event_id", "mark"], "left").join(events.select("event_id", F.col("vector").alias("_v")), "event_id", "left")
    rows = rows.withColumn("cosine", F.round(V.cosine(F.col("vector"), F.col("_v")), 6)).withColumn("listed", F.coalesce("_listed", F.lit(False)))
    return driven(rows, Judge(text_least, url_least), delay, (("event_id", "long"), ("mark", "string"))).drop("mark")


def tick_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """#198, #199 as a stream: ticks and hibernation from timers, also while no claim comes."""
    return driven(stream, Ticks(), delay).withColumn("idle_hours", F.round("idle_hours", 6))  # halves as the batch form rounds them


def cooling_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """#200 as a stream: changes of state by claims, and between claims by timers."""
    return driven(stream, Cooling(), delay)


def track_stream(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """#201, #205, #207 as a stream."""
    return driven(stream, Track(), delay)


def leader_stream(stream: DataFrame, delay: str = "1 hour", least: float = 0.7, merge: float = 0.6, ready: int = 3) -> DataFrame:
    """#118, #202 as a stream of (event_id, block, claim_id, ts, vector)."""
    return driven(stream, Leaders(least, merge, ready), delay, (("event_id", "long"), ("block", "long")))


def sleepless(ticks: DataFrame) -> DataFrame:
    """The ticks of ``claims.ticks`` that ``tick_stream`` has: of a stretch of idleness none after the first that hibernates."""
    return ticks.filter(F.col("idle_hours") < K.HIBERNATE_HOURS + 1)


def cooled_timeline(arrived: DataFrame) -> DataFrame:
    """#200 in batch: (event_id, at, state, cause), the rows of ``cooling_stream`` up to each event's last claim.
    An event's claims go through one task in order, in batches; only its counts are held."""
    rows = arrived.filter("ts IS NOT NULL").select("event_id", "claim_id", "ts", "kind", "stake").repartition("event_id").sortWithinPartitions("event_id", "ts", "claim_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, event, memory = Cooling(), None, []
        for pdf in batches:
            out = []
            at = pdf["ts"].to_numpy("datetime64[us]").astype("int64").tolist()
            stakes = [0 if v != v else v for v in pdf["stake"].tolist()]
            for e, t, claim, kind, stake in zip(pdf["event_id"].tolist(), at, pdf["claim_id"].tolist(), pdf["kind"].tolist(), stakes):
                if e != event:
                    event, memory = e, machine.load(machine.newborn)
                out += [(e, *r) for r in machine.passes(memory, t - 1)]
                out += [(e, *r) for r in machine.row(memory, t, (claim, kind, stake))]
            made = pd.DataFrame(out, columns=["event_id", "at", "state", "cause"])
            yield made.assign(at=pd.to_datetime(made["at"], unit="us"))

    return rows.mapInPandas(run, "event_id long, at timestamp, state string, cause string")
