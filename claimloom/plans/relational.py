"""Queries of rows 9-28, 35-42, 180-186, 209-214 and 221."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.operators import overlap as O
from claimloom.operators import relational as R
from claimloom.plans.ctes import with_tables
from claimloom.plans.registry import query
from claimloom.sources import fixtures as X


def q(name, body, **more):
    return query(name, with_tables(body, **more))


@q("q009_claims_of_pages", """SELECT claim_id, page_id, confidence, 'observation' AS modality FROM kg_claims WHERE page_id IN (SELECT page_id FROM kg_pages WHERE status = 'P')""")
def _(s, d):
    ids = X.kg_pages(s, d).filter("status = 'P'")
    return R.claims_of(X.kg_claims(s, d), "page_id", ids).select("claim_id", "page_id", "confidence", "modality")


@q("q010_claims_of_entity", """SELECT m.entity_id, m.claim_id, p.title, p.pub_time FROM kg_mentions m LEFT JOIN kg_pages p ON m.page_id = p.page_id WHERE m.entity_id IN ('S1', 'S7', 'P12')""")
def _(s, d):
    return R.claims_of_entity(X.kg_mentions(s, d), X.kg_claims(s, d), X.kg_pages(s, d), ["S1", "S7", "P12"]).select("entity_id", "claim_id", "title", "pub_time")


@q("q011_entities_of_pages", """SELECT DISTINCT m.page_id, m.entity_id, e.canonical_name, e.entity_type, e.mention_count FROM kg_mentions m JOIN kg_entities e ON m.entity_id = e.entity_id""")
def _(s, d):
    return R.entities_of_page(X.kg_mentions(s, d), X.kg_entities(s, d), X.parts(s, d)).select("page_id", "entity_id", "canonical_name", "entity_type", "mention_count")


@q("q012_root_events", """SELECT e.event_id, e.name, e.scale, (SELECT count(*) FROM kg_events c WHERE c.parent_id = e.event_id) AS child_count
FROM kg_events e WHERE status = 'active' AND NOT EXISTS (SELECT 1 FROM kg_events p WHERE p.event_id = e.parent_id)""")
def _(s, d):
    return R.root_events(X.kg_events(s, d), status="active").select("event_id", "name", "scale", "child_count")


@q("q013_event_cards", """SELECT e.event_id, e.name, COALESCE(c.claim_count, 0) AS claim_count, COALESCE(c.page_count, 0) AS page_count, t.thumbnails, h.thought_id FROM kg_events e
LEFT JOIN (SELECT event_id, count(*) AS claim_count, count(DISTINCT page_id) AS page_count FROM kg_claims GROUP BY ALL) c ON e.event_id = c.event_id
LEFT JOIN (SELECT event_id, string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY r) AS thumbnails FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY pub_time DESC, page_id) AS r FROM kg_pages) WHERE r <= 5 GROUP BY event_id) t ON e.event_id = t.event_id
LEFT JOIN (SELECT event_id, thought_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acknowledged, created_at DESC, thought_id DESC) AS r FROM kg_thoughts) WHERE r = 1) h ON e.event_id = h.event_id
WHERE e.coherence IS NULL OR e.coherence >= 0.3""")
def _(s, d):
    return R.event_cards(X.kg_events(s, d), X.kg_claims(s, d), X.kg_pages(s, d), X.kg_thoughts(s, d), 0.3).select("event_id", "name", "claim_count", "page_count", "thumbnails", "thought_id")


@q("q014_event_tree", """SELECT e.event_id, p.name AS parent_name, COALESCE(k.n, 0) AS n_children, COALESCE(m.n, 0) AS n_entities, COALESCE(c.n, 0) AS n_claims, c.first_claim FROM kg_events e
LEFT JOIN kg_events p ON e.parent_id = p.event_id LEFT JOIN (SELECT parent_id, count(*) AS n FROM kg_events GROUP BY ALL) k ON e.event_id = k.parent_id
LEFT JOIN (SELECT event_id, count(DISTINCT entity_id) AS n FROM kg_mentions GROUP BY ALL) m ON e.event_id = m.event_id
LEFT JOIN (SELECT event_id, count(*) AS n, min(claim_id) AS first_claim FROM kg_claims GROUP BY ALL) c ON e.event_id = c.event_id""")
def _(s, d):
    t = R.event_tree(X.kg_events(s, d), X.kg_mentions(s, d), X.kg_claims(s, d))
    n = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return t.select("event_id", "parent_name", n("children").alias("n_children"), n("entities").alias("n_entities"), n("claims").alias("n_claims"), F.col("claims")[0]["claim_id"].alias("first_claim"))


@q("q015_event_timeline", """SELECT claim_id, c.event_id, event_time, pub_time, CAST(row_number() OVER (PARTITION BY c.event_id ORDER BY event_time NULLS LAST, pub_time NULLS LAST, claim_id) AS INTEGER) AS position
FROM kg_claims c LEFT JOIN kg_pages p ON c.page_id = p.page_id""")
def _(s, d):
    return R.event_timeline(X.kg_claims(s, d), X.kg_pages(s, d)).select("claim_id", "event_id", "event_time", "pub_time", "position")


@q("q016_events_of_entities", """SELECT entity_id, event_id, name, n_claims FROM (SELECT g.*, e.name, row_number() OVER (PARTITION BY entity_id ORDER BY updated_at DESC NULLS LAST, g.event_id) AS r
FROM (SELECT entity_id, event_id, count(DISTINCT claim_id) AS n_claims FROM kg_mentions GROUP BY ALL) g JOIN kg_events e ON g.event_id = e.event_id) WHERE r <= 10""")
def _(s, d):
    return R.events_of_entity(X.kg_mentions(s, d), X.kg_events(s, d), 10).select("entity_id", "event_id", "name", F.size("claim_ids").cast("long").alias("n_claims"))


@q("q017_recent_pages", """SELECT page_id, title, pub_time, (SELECT count(*) FROM kg_pages WHERE status = 'O') AS total FROM kg_pages WHERE status = 'O' ORDER BY pub_time DESC, page_id LIMIT 50 OFFSET 100""")
def _(s, d):
    p = X.kg_pages(s, d).filter("status = 'O'")
    total = p.agg(F.count("*").alias("total"))
    return R.page(p, [F.desc("pub_time"), F.asc("page_id")], 50, 100).join(F.broadcast(total)).select("page_id", "title", "pub_time", "total")


@q("q018_search_events", """SELECT event_id, name, coherence FROM kg_events WHERE contains(lower(name), 'machinery') OR contains(lower(summary), 'machinery') ORDER BY coherence DESC NULLS LAST, event_id LIMIT 25""")
def _(s, d):
    return R.search_events(X.kg_events(s, d), "Machinery", 25).select("event_id", "name", "coherence")


@q("q019_coherence_feed", """SELECT e.event_id, e.name, e.coherence, COALESCE(n, 0) AS claim_count FROM kg_events e LEFT JOIN (SELECT event_id, count(*) AS n FROM kg_claims GROUP BY ALL) c ON e.event_id = c.event_id
WHERE summary IS NOT NULL AND coherence >= 0.4 ORDER BY coherence DESC, updated_at DESC, e.event_id LIMIT 50 OFFSET 10""")
def _(s, d):
    return R.coherence_feed(X.kg_events(s, d), X.kg_claims(s, d), 0.4, 50, 10).select("event_id", "name", "coherence", "claim_count")


@q("q020_page_summary", """SELECT p.page_id, COALESCE(ne, 0) AS entity_count, COALESCE(nv, 0) AS event_count, COALESCE(nc, 0) AS claim_count FROM kg_pages p
LEFT JOIN (SELECT page_id, count(DISTINCT entity_id) AS ne FROM kg_mentions GROUP BY ALL) m ON p.page_id = m.page_id
LEFT JOIN (SELECT page_id, count(*) AS nc, count(DISTINCT event_id) AS nv FROM kg_claims GROUP BY ALL) c ON p.page_id = c.page_id""")
def _(s, d):
    return R.page_summary(X.kg_pages(s, d), X.kg_mentions(s, d), X.kg_claims(s, d)).select("page_id", "entity_count", "event_count", "claim_count")


@q("q021_page_submissions", """SELECT p.page_id, p.title, t.status AS task_status FROM kg_pages p LEFT JOIN (SELECT * FROM kg_tasks WHERE status <> 'failed') t ON p.page_id = t.task_id""")
def _(s, d):
    t = X.kg_tasks(s, d).filter("status <> 'failed'").select(F.col("task_id").alias("page_id"), F.col("status").alias("task_status"))
    return X.kg_pages(s, d).join(t, "page_id", "left").select("page_id", "title", "task_status")


@q("q022_claim_flags", """SELECT claim_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short_text, confidence >= 0.7 AS is_factual, event_time IS NOT NULL AS is_timestamped,
date_diff('day', event_time, TIMESTAMP '1998-06-01') BETWEEN 0 AND 7 AS is_current FROM kg_claims""")
def _(s, d):
    f = R.claim_flags(X.kg_claims(s, d), F.lit("1998-06-01").cast("timestamp"), shown=40)
    return f.select("claim_id", "short_text", "is_factual", "is_timestamped", "is_current")


@q("q023_comment_threads", """SELECT c.comment_id, c."user", COALESCE(n, 0) AS replies FROM kg_comments c LEFT JOIN (SELECT parent_id, count(*) AS n FROM kg_comments WHERE parent_id IS NOT NULL GROUP BY ALL) r ON c.comment_id = r.parent_id""")
def _(s, d):
    return R.comment_threads(X.kg_comments(s, d)).select("comment_id", "user", "replies")


INTAKES = "SELECT claim_id, event_id, round((value % 20)::DOUBLE / 20, 2) AS affinity FROM kg_claims"


def _intakes(s, d):
    return X.kg_claims(s, d).select("claim_id", "event_id", F.round(F.pmod("value", F.lit(20)) / 20, 2).alias("affinity"))


@q("q024_low_affinity", "SELECT claim_id, event_id, affinity FROM kg_intakes WHERE affinity < 0.2", kg_intakes=INTAKES)
def _(s, d):
    return R.low_affinity(_intakes(s, d)).select("claim_id", "event_id", "affinity")


@q("q025_latest_thoughts", """SELECT event_id, thought_id, acknowledged FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY acknowledged, created_at DESC, thought_id DESC) AS r FROM kg_thoughts) WHERE r = 1""")
def _(s, d):
    return R.latest_thought(X.kg_thoughts(s, d)).select("event_id", "thought_id", "acknowledged")


@q("q026_claim_priors", """SELECT claim_id, publisher, COALESCE(source_type, 'unknown') AS source_type, COALESCE(base_prior, 0.5) AS base_prior FROM kg_claims c LEFT JOIN kg_pages p ON c.page_id = p.page_id LEFT JOIN kg_publishers b ON p.publisher_id = b.publisher_id""")
def _(s, d):
    return R.claim_priors(X.kg_claims(s, d), X.kg_pages(s, d), X.kg_publishers(s, d)).select("claim_id", "publisher", "source_type", "base_prior")


@q("q027_page_title_of_claim", "SELECT claim_id, title FROM kg_claims c JOIN kg_pages p ON c.page_id = p.page_id")
def _(s, d):
    return X.kg_claims(s, d).join(X.kg_pages(s, d).select("page_id", "title"), "page_id").select("claim_id", "title")


@q("q028_candidates_by_entities", """SELECT page_id, event_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY overlap DESC, event_id) AS r FROM (
SELECT p.page_id, e.event_id, count(*) AS overlap FROM (SELECT DISTINCT page_id, entity_id FROM kg_mentions) p JOIN (SELECT DISTINCT event_id, entity_id FROM kg_mentions) e ON p.entity_id = e.entity_id GROUP BY ALL)) WHERE r <= 20""")
def _(s, d):
    m = X.kg_mentions(s, d)
    return O.candidates_by_entities(m, m).select("page_id", "event_id", "overlap")


@q("q035_orphaned_involves", """SELECT DISTINCT event_id, entity_id FROM kg_mentions m WHERE NOT EXISTS (SELECT 1 FROM kg_mentions r JOIN kg_claims c ON r.claim_id = c.claim_id WHERE r.event_id = m.event_id AND r.entity_id = m.entity_id AND c.value > 10)""")
def _(s, d):
    m = X.kg_mentions(s, d)
    left = m.join(X.kg_claims(s, d).filter("value > 10").select("claim_id"), "claim_id", "left_semi")
    return R.orphaned_involves(R.involves(m), left).select("event_id", "entity_id")


@q("q036_unseen_claims", """SELECT claim_id FROM kg_claims WHERE page_id NOT IN (SELECT page_id FROM kg_pages WHERE status = 'F')""")
def _(s, d):
    c = X.kg_claims(s, d)
    known = c.join(X.kg_pages(s, d).filter("status = 'F'").select("page_id"), "page_id", "left_semi")
    return R.not_yet_seen(c, known, "claim_id").select("claim_id")


@q("q037_updates_on_topic", """SELECT n.claim_id AS newer, o.claim_id AS older, n.event_id, n.topic_key FROM kg_claims n JOIN kg_claims o ON n.event_id = o.event_id AND n.topic_key = o.topic_key AND n.value <> o.value
AND (n.reported_time > o.reported_time OR (n.reported_time = o.reported_time AND n.event_time >= o.event_time))""")
def _(s, d):
    return R.newer_on_topic(X.kg_claims(s, d))


STARTS = "SELECT event_id, min(event_time) AS event_start, max(reported_time) AS event_end FROM kg_claims GROUP BY ALL"


def _starts(s, d):
    return X.kg_claims(s, d).groupBy("event_id").agg(F.min("event_time").alias("event_start"), F.max("reported_time").alias("event_end"))


@q("q038_near_event_start", "SELECT claim_id, c.event_id FROM kg_claims c JOIN kg_starts s ON c.event_id = s.event_id WHERE date_diff('day', event_start, event_time) BETWEEN -2 AND 2", kg_starts=STARTS)
def _(s, d):
    return R.within_days(X.kg_claims(s, d), _starts(s, d), -2, 2, "event_start").select("claim_id", "event_id")


@q("q039_aftermath_claims", "SELECT claim_id, c.event_id FROM kg_claims c JOIN kg_starts s ON c.event_id = s.event_id WHERE date_diff('day', event_end, event_time) BETWEEN 2 AND 14", kg_starts=STARTS)
def _(s, d):
    return R.within_days(X.kg_claims(s, d), _starts(s, d), 2, 14, "event_end").select("claim_id", "event_id")


@q("q040_shared_page_pairs", "SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS shared FROM kg_on x JOIN kg_on y ON x.page_id = y.page_id AND x.entity_id < y.entity_id GROUP BY ALL", kg_on="SELECT DISTINCT entity_id, page_id FROM kg_mentions")
def _(s, d):
    return R.shared_event_pairs(X.kg_mentions(s, d), "entity_id", "page_id", X.parts(s, d, times=2))


@q("q041_named_edges", """SELECT src, dst, a.canonical_name AS src_name, b.canonical_name AS dst_name, confidence FROM kg_entity_edges JOIN kg_entities a ON src = a.entity_id JOIN kg_entities b ON dst = b.entity_id""")
def _(s, d):
    names = X.kg_entities(s, d).select(F.col("entity_id").alias("id"), F.col("canonical_name").alias("name"))
    return R.named_edges(X.kg_entity_edges(s, d), names).select("src", "dst", "src_name", "dst_name", "confidence")


@q("q180_sort_dated_first", """SELECT claim_id, event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, t IS NULL, t, claim_id) AS INTEGER) AS position
FROM (SELECT *, CASE WHEN value % 3 <> 0 THEN event_time END AS t FROM kg_claims)""")
def _(s, d):
    c = X.kg_claims(s, d).withColumn("t", F.when(F.pmod("value", F.lit(3)) != 0, F.col("event_time")))
    w = Window.partitionBy("event_id").orderBy(F.desc("confidence"), F.asc_nulls_last("t"), "claim_id")
    return c.select("claim_id", "event_id", F.row_number().over(w).alias("position"))


@q("q181_top_claims_per_event", "SELECT event_id, claim_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY value DESC, claim_id) AS r FROM kg_claims) WHERE r <= 5")
def _(s, d):
    return R.top_k(X.kg_claims(s, d), ["event_id"], [F.desc("value"), F.asc("claim_id")], 5).select("event_id", "claim_id", "rank")


@q("q182_paged_events", "SELECT event_id, name FROM kg_events ORDER BY name, event_id LIMIT 30 OFFSET 60")
def _(s, d):
    return R.page(X.kg_events(s, d), [F.asc("name"), F.asc("event_id")], 30, 60).select("event_id", "name")


@q("q183_task_batch", """SELECT task_id, status, status = 'processing' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 2 HOUR AS stuck FROM kg_tasks WHERE status <> 'failed' ORDER BY started_at, task_id LIMIT 100""")
def _(s, d):
    t = R.page(X.kg_tasks(s, d).filter("status <> 'failed'"), [F.asc("started_at"), F.asc("task_id")], 100)
    return t.select("task_id", "status", F.expr("status = 'processing' AND started_at < TIMESTAMP '1998-01-01' - INTERVAL 2 HOURS").alias("stuck"))


@q("q184_second_best", "SELECT event_id, claim_id, value, lead(value) OVER (PARTITION BY event_id ORDER BY value DESC, claim_id) AS second FROM kg_claims QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY value DESC, claim_id) = 1")
def _(s, d):
    w = Window.partitionBy("event_id").orderBy(F.desc("value"), "claim_id")
    c = X.kg_claims(s, d).select("event_id", "claim_id", "value", F.lead("value").over(w).alias("second"), F.row_number().over(w).alias("r"))
    return c.filter("r = 1").drop("r")


@q("q185_ledger_balance", "SELECT event_id, user_id, round(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS balance FROM kg_ledger")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return X.kg_ledger(s, d).select("event_id", "user_id", F.round(F.sum("delta").over(w), 2).alias("balance"))


@q("q186_set_operations", """SELECT 'both' AS kind, count(*) AS n FROM (SELECT event_id FROM kg_pages INTERSECT SELECT event_id FROM kg_claims)
UNION ALL SELECT 'pages only', count(*) FROM (SELECT event_id FROM kg_pages EXCEPT SELECT event_id FROM kg_claims)
UNION ALL SELECT 'either', count(*) FROM (SELECT event_id FROM kg_pages UNION SELECT event_id FROM kg_claims)""")
def _(s, d):
    p, c = X.kg_pages(s, d).select("event_id"), X.kg_claims(s, d).select("event_id")
    n = lambda kind, df: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("both", p.intersect(c)).unionByName(n("pages only", p.subtract(c))).unionByName(n("either", p.union(c).distinct()))


@q("q209_involves", "SELECT DISTINCT event_id, entity_id FROM kg_mentions")
def _(s, d):
    return R.involves(X.kg_mentions(s, d))


@q("q210_pruned_claims", """SELECT l.event_id, l.n AS pruned, COALESCE(o.n, 0) AS orphaned FROM (SELECT event_id, count(*) AS n FROM kg_intakes WHERE affinity < 0.2 GROUP BY ALL) l
LEFT JOIN (SELECT event_id, count(*) AS n FROM (SELECT DISTINCT event_id, entity_id FROM kg_mentions EXCEPT SELECT m.event_id, m.entity_id FROM kg_mentions m JOIN kg_intakes i ON m.claim_id = i.claim_id WHERE affinity >= 0.2) GROUP BY ALL) o ON l.event_id = o.event_id""", kg_intakes=INTAKES)
def _(s, d):
    return R.pruned(_intakes(s, d), X.kg_mentions(s, d))


DEGREE = "SELECT dst AS claim_id, count(*) AS in_degree FROM kg_claim_edges WHERE rel = 'CORROBORATES' GROUP BY ALL"


def _degree(s, d):
    return X.kg_claim_edges(s, d).filter("rel = 'CORROBORATES'").groupBy(F.col("dst").alias("claim_id")).agg(F.count("*").alias("in_degree"))


@q("q211_evidence_search", """SELECT c.claim_id, c.text, COALESCE(in_degree, 0) AS in_degree FROM kg_claims c LEFT JOIN kg_degree g ON c.claim_id = g.claim_id
WHERE c.claim_id IN (SELECT claim_id FROM kg_mentions m JOIN kg_entities e ON m.entity_id = e.entity_id WHERE contains(lower(canonical_name), 'ring')) ORDER BY COALESCE(in_degree, 0) DESC, confidence DESC, c.claim_id LIMIT 20""", kg_degree=DEGREE)
def _(s, d):
    return R.evidence_search(X.kg_entities(s, d), X.kg_mentions(s, d), X.kg_claims(s, d), _degree(s, d), "ring").select("claim_id", "text", "in_degree")


@q("q212_entity_priors", """SELECT n.name, b.entity_id, s.samples, b.entity_id IS NOT NULL AS known FROM (SELECT DISTINCT lower(p_type) AS name FROM part UNION SELECT DISTINCT lower(p_name) FROM part) n
LEFT JOIN (SELECT * FROM (SELECT m.name, e.entity_id, row_number() OVER (PARTITION BY m.name ORDER BY mention_count DESC, entity_id) AS r FROM (SELECT DISTINCT lower(p_type) AS name FROM part UNION SELECT DISTINCT lower(p_name) FROM part) m JOIN kg_entities e ON contains(lower(canonical_name), m.name)) WHERE r = 1) b ON n.name = b.name
LEFT JOIN (SELECT entity_id, string_agg(claim_id, ',' ORDER BY claim_id) AS samples FROM (SELECT DISTINCT entity_id, claim_id, dense_rank() OVER (PARTITION BY entity_id ORDER BY claim_id) AS r FROM kg_mentions) WHERE r <= 5 GROUP BY ALL) s ON b.entity_id = s.entity_id""")
def _(s, d):
    p = X.read(s, d, "part")
    names = p.select(F.lower("p_type").alias("name")).union(p.select(F.lower("p_name"))).distinct()
    return R.entity_priors(names, X.kg_entities(s, d), X.kg_mentions(s, d))


@q("q221_event_structure", """SELECT e.event_id, COALESCE(k.n, 0) AS child_count, COALESCE(c.n, 0) AS claims, CAST(date_diff('day', lo, hi) AS INTEGER) AS days FROM kg_events e
LEFT JOIN (SELECT parent_id, count(*) AS n FROM kg_events GROUP BY ALL) k ON e.event_id = k.parent_id LEFT JOIN (SELECT event_id, count(*) AS n, min(event_time) AS lo, max(event_time) AS hi FROM kg_claims GROUP BY ALL) c ON e.event_id = c.event_id""")
def _(s, d):
    return R.event_structure(X.kg_events(s, d), X.kg_claims(s, d)).select("event_id", "child_count", "claims", "days")
