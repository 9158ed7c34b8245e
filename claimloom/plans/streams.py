"""Queries of rows 196-208."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import vectors as V
from claimloom.operators import planes as P
from claimloom.plans.clusters import CENTRES, COS, VECS
from claimloom.plans.ctes import with_tables
from claimloom.plans.registry import query
from claimloom.sources import fixtures as X
from claimloom.streaming import claims as K
from claimloom.streaming import timers as T

ARR = "SELECT user_id AS event_id, event_id AS claim_id, ts, CASE event_type WHEN 'error' THEN 'contradiction' WHEN 'purchase' THEN 'corroboration' ELSE 'neutral' END AS kind, CAST(json_extract_string(props, '$.k') AS INTEGER) AS stake, value FROM events"
UP = """SELECT event_id, claim_id, claims, corroborated, contradicted, CASE WHEN claims < 5 THEN 'NO_OP' WHEN claims = 5 THEN 'FULL_TOPOLOGY' WHEN contradicted::DOUBLE / greatest(corroborated + contradicted, 1) > 0.5 THEN 'EMIT_THOUGHT' ELSE 'INCREMENTAL_TOPOLOGY' END AS action FROM (
SELECT event_id, claim_id, count(*) OVER w AS claims, count(*) FILTER (WHERE kind = 'corroboration') OVER w AS corroborated, count(*) FILTER (WHERE kind = 'contradiction') OVER w AS contradicted FROM kg_arr WINDOW w AS (PARTITION BY event_id ORDER BY ts, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
TEN = "SELECT *, corroborated::DOUBLE / greatest(corroborated + contradicted, 1) AS coherence FROM kg_up WHERE claims % 10 = 0"
#: What the last watermark has passed, an hour behind the newest arrival.
MARK = "SELECT (epoch_ms(max(ts)) - 3600000) * 1000 AS mark FROM kg_arr"
MORE = {"kg_arr": ARR, "kg_up": UP, "kg_ten": TEN, "kg_mark": MARK, "kg_vecs": VECS, "kg_centres": CENTRES}


def q(name, body):
    return query(name, with_tables(body, **MORE) if body else None)


def arr(s, d):
    return K.arrivals(X.read(s, d, "events"))


@q("q196_upkeep_stream", "SELECT * FROM kg_up")
def _(s, d):
    return K.run_available(K.upkeep_stream(K.claim_stream(s, d)))


@q("q197_upkeep_batch", "SELECT * FROM kg_up")
def _(s, d):
    return K.upkeep(arr(s, d))


@q("q197_actions", None)
def _(s, d):
    n = X.parts(s, d, "events", 12)  # a user has far more hourly ticks than events
    return K.actions(arr(s, d), K.ticks(arr(s, d), parts=n).select("event_id", "tick"), parts=n)


@q("q198_tick_stream", """SELECT event_id, tick, idle_hours, idle_hours >= 24 AS hibernate, idle_hours < 6 AS active FROM (SELECT event_id, tick, round((epoch_us(tick) - epoch_us(last)) / 3.6e9, 6)::DOUBLE AS idle_hours FROM (
SELECT t.event_id, tick, max(a.ts) AS last FROM (SELECT event_id, unnest(generate_series(date_trunc('hour', min(ts)) + INTERVAL 1 HOUR, max(ts) + INTERVAL 26 HOUR, INTERVAL 1 HOUR)) AS tick FROM kg_arr GROUP BY event_id) t JOIN kg_arr a ON a.event_id = t.event_id AND a.ts <= t.tick GROUP BY ALL)
WHERE epoch_us(tick) <= (SELECT mark FROM kg_mark)) WHERE idle_hours < 25""")
def _(s, d):
    return T.run_with_timers(T.tick_stream(K.claim_stream(s, d)))


@q("q199_ticks", """SELECT event_id, tick, round((epoch_us(tick) - epoch_us(last)) / 3.6e9, 6)::DOUBLE AS idle_hours, round((epoch_us(tick) - epoch_us(last)) / 3.6e9, 6) >= 24 AS hibernate, round((epoch_us(tick) - epoch_us(last)) / 3.6e9, 6) < 6 AS active FROM (
SELECT t.event_id, tick, max(a.ts) AS last FROM (SELECT event_id, unnest(generate_series(date_trunc('hour', min(ts)) + INTERVAL 1 HOUR, max(ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS tick FROM kg_arr GROUP BY event_id) t JOIN kg_arr a ON a.event_id = t.event_id AND a.ts <= t.tick GROUP BY ALL)""")
def _(s, d):
    return K.ticks(arr(s, d))


@q("q200_lifecycle_stream", None)
def _(s, d):
    return K.run_available(K.lifecycle_stream(K.claim_stream(s, d)))


@q("q200_lifecycle_batch", None)
def _(s, d):
    return K.lifecycle(arr(s, d))


@q("q200_cooled_timeline", None)
def _(s, d):
    return T.cooled_timeline(arr(s, d))


@q("q200_cooling_stream", None)
def _(s, d):
    return T.run_with_timers(T.cooling_stream(K.claim_stream(s, d)))


@q("q201_anomalies", """SELECT event_id, claims, thought FROM (SELECT event_id, claims, CASE WHEN contradicted::DOUBLE / greatest(corroborated + contradicted, 1) > 0.5 THEN 'contradiction' WHEN lag(coherence) OVER (PARTITION BY event_id ORDER BY claims) - coherence > 0.15 THEN 'coherence_drop' END AS thought FROM kg_ten) WHERE thought IS NOT NULL""")
def _(s, d):
    return K.anomalies(arr(s, d))


@q("q202_online_clusters", None)
def _(s, d):
    raw = s.readStream.schema(K.CLAIM_STREAM).parquet(f"{d}/events.parque[t]")
    stream = raw.select(F.col("user_id").alias("event_id"), F.col("event_id").alias("claim_id"), "ts", "value")
    return K.run_available(K.online_clusters(stream))


@q("q202_leader_stream", None)
def _(s, d):
    rows = s.readStream.schema(X.read(s, d, "embeddings").schema).parquet(f"{d}/embeddings.parque[t]")
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.col("vec_id"), F.lit(100_000)) * 60)
    stream = rows.select(F.col("label").cast("long").alias("event_id"), F.col("vec_id").alias("claim_id"), at.alias("ts"), F.col("embedding").cast("array<double>").alias("vector"))
    return T.run_with_timers(T.leader_stream(P.with_block(stream, "vector", 64, 1), "1 minute", 0.3, 0.2, 2))


@q("q203_stream_dedup", "SELECT claim_id, event_id FROM kg_arr")
def _(s, d):
    return K.run_available(K.deduplicated(K.claim_stream(s, d))).select("claim_id", "event_id")


@q("q204_rates", "SELECT event_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS claims FROM kg_arr GROUP BY ALL")
def _(s, d):
    return K.rates(arr(s, d), "1 day")


@q("q204_rates_stream", "SELECT event_id, start, claims FROM (SELECT event_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS claims FROM kg_arr GROUP BY ALL) WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM kg_arr)")
def _(s, d):
    return K.run_available(K.rates(K.claim_stream(s, d).withWatermark("ts", "1 hour"), "1 day"))


@q("q205_sliding_merge_rate", "SELECT event_id, claim_id, round(avg((kind = 'corroboration')::INT) OVER (PARTITION BY event_id ORDER BY ts, claim_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS merge_rate FROM kg_arr")
def _(s, d):
    return K.sliding_merge_rate(arr(s, d))


@q("q206_sessions", """SELECT event_id, min(ts) AS start, count(*) AS claims FROM (SELECT *, sum(fresh) OVER (PARTITION BY event_id ORDER BY ts, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_id ORDER BY ts, claim_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM kg_arr)) GROUP BY event_id, n""")
def _(s, d):
    return K.sessions(arr(s, d))


@q("q207_versions", """SELECT event_id, claims, major, row_number() OVER (PARTITION BY event_id, major ORDER BY claims) - 1 AS minor FROM (SELECT event_id, claims, CAST(sum(up) OVER (PARTITION BY event_id ORDER BY claims) AS BIGINT) AS major FROM (SELECT *, COALESCE((coherence - lag(coherence) OVER (PARTITION BY event_id ORDER BY claims) >= 0.1)::INT, 0) AS up FROM kg_ten))""")
def _(s, d):
    return K.versions(arr(s, d)).withColumn("minor", F.col("minor").cast("long"))


@q("q208_contributions", """SELECT event_id, claim_id, CASE WHEN c_custkey IS NULL THEN 'unrelated' ELSE 'accepted' END AS outcome, round(CASE WHEN c_custkey IS NULL THEN 0 WHEN kind = 'contradiction' THEN 0.5 WHEN kind = 'corroboration' THEN 0.2 ELSE 0.1 END * stake, 6)::DOUBLE AS reward FROM kg_arr LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) ON event_id = c_custkey""")
def _(s, d):
    known = X.read(s, d, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("event_id"))
    return K.run_available(K.contributions(K.claim_stream(s, d), known))


@q("q207_track_stream", """SELECT a.event_id, a.claim_id, u.claims, a.merge_rate, t.thought, v.major, v.minor FROM (
SELECT event_id, claim_id, ts, round(avg((kind = 'corroboration')::INT) OVER (PARTITION BY event_id ORDER BY ts, claim_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS merge_rate FROM kg_arr) a JOIN kg_up u ON a.event_id = u.event_id AND a.claim_id = u.claim_id
LEFT JOIN (SELECT event_id, claims, CASE WHEN contradicted::DOUBLE / greatest(corroborated + contradicted, 1) > 0.5 THEN 'contradiction' WHEN lag(coherence) OVER (PARTITION BY event_id ORDER BY claims) - coherence > 0.15 THEN 'coherence_drop' END AS thought FROM kg_ten) t ON t.event_id = a.event_id AND t.claims = u.claims
LEFT JOIN (SELECT event_id, claims, major, row_number() OVER (PARTITION BY event_id, major ORDER BY claims) - 1 AS minor FROM (SELECT event_id, claims, CAST(sum(up) OVER (PARTITION BY event_id ORDER BY claims) AS BIGINT) AS major FROM (SELECT *, COALESCE((coherence - lag(coherence) OVER (PARTITION BY event_id ORDER BY claims) >= 0.1)::INT, 0) AS up FROM kg_ten))) v ON v.event_id = a.event_id AND v.claims = u.claims
WHERE epoch_us(a.ts) <= (SELECT mark FROM kg_mark)""")
def _(s, d):
    return T.run_with_timers(T.track_stream(K.claim_stream(s, d)))


@q("q208_judged_stream", f"""SELECT event_id, claim_id, outcome, round(CASE WHEN outcome <> 'accepted' THEN 0 WHEN kind = 'contradiction' THEN 0.5 WHEN kind = 'corroboration' THEN 0.2 ELSE 0.1 END * stake, 6)::DOUBLE AS reward FROM (SELECT *,
CASE WHEN event_id % 3 = 0 AND txt = 1 OR count(*) FILTER (WHERE related) OVER (PARTITION BY event_id, txt ORDER BY ts, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 THEN 'duplicate' WHEN related THEN 'accepted' ELSE 'unrelated' END AS outcome FROM (
SELECT r.event_id, r.claim_id, r.ts, r.kind, COALESCE(r.stake, 0) AS stake, r.claim_id % 40 AS txt, COALESCE({COS} >= CASE WHEN r.claim_id % 4 = 0 THEN 0.1 ELSE 0.05 END, FALSE) AS related
FROM kg_arr r LEFT JOIN kg_vecs a ON a.vec_id = r.claim_id % 500 LEFT JOIN kg_centres b ON b.label = r.event_id % 10)) WHERE epoch_us(ts) <= (SELECT mark FROM kg_mark)""")
def _(s, d):
    vectors = X.read(s, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    text = lambda n: F.concat(F.lit(" claim "), n.cast("string"))
    stream = K.claim_stream(s, d).withColumns({"text": text(F.col("claim_id") % 40), "url": F.col("claim_id") % 4 == 0, "vec_id": F.col("claim_id") % 500})
    stream = stream.join(vectors.select("vec_id", "vector"), "vec_id", "left")
    ids = X.read(s, d, "events").select(F.col("user_id").alias("event_id")).distinct()
    centres = V.mean_vectors(vectors, "label", "vector").select(F.col("label").alias("_l"), F.col("centroid").alias("vector"))
    events = ids.join(centres, F.col("event_id") % 10 == F.col("_l")).select("event_id", "vector")
    known = ids.filter("event_id % 3 = 0").select("event_id", F.lit("claim 1 ").alias("text"))
    return T.run_with_timers(T.judged_stream(stream, known, events, text_least=0.05, url_least=0.1))
