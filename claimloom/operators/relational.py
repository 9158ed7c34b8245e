"""Point, list and join queries over claim, event, page and entity tables (rows 9-28, 35-42, 209-214, 221).

Arguments are the tables of FIXTURES.md or any with the same columns; nothing here collects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import text as T

DEFAULT_CONFIDENCE, DEFAULT_MODALITY = 0.8, "observation"


#: Rows that a task of a join or grouping should get.
TASK_ROWS = 150_000


def parts_for(spark: SparkSession, rows: int) -> int | None:
    """Over how many partitions to deal out ``rows`` rows; None for few, which Spark's own number serves."""
    n = -(-rows // TASK_ROWS)
    return n if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``df`` dealt out by its keys over ``parts`` partitions before a join or grouping by them, so that a task's memory hangs
    on rows, not on the session's number of partitions or on how well a shuffle packs; None leaves that to Spark."""
    return df.repartition(parts, *keys) if parts else df


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """#181. The first ``k`` rows of each key, numbered from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """#182. A page of the ordered rows."""
    return df.orderBy(*order).offset(offset).limit(limit)


def claims_of(claims: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """#9. Claims of pages or events: with the default confidence and modality where these are null."""
    modality = F.coalesce(F.col("modality"), F.lit(DEFAULT_MODALITY)) if "modality" in claims.columns else F.lit(DEFAULT_MODALITY)
    kept = claims.join(ids.select(key).distinct(), key, "left_semi")
    return kept.withColumns({"confidence": F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)), "modality": modality})


def claims_of_entity(mentions: DataFrame, claims: DataFrame, pages: DataFrame, entity_ids: list[str]) -> DataFrame:
    """#10. Claims that mention one of the entities, with their page."""
    m = mentions.filter(F.col("entity_id").isin(entity_ids)).select("entity_id", "claim_id")
    return m.join(claims, "claim_id").join(pages.select("page_id", "title", "pub_time"), "page_id", "left")


def entities_of_page(mentions: DataFrame, entities: DataFrame, parts: int | None = None) -> DataFrame:
    """#11. The distinct entities that a page's claims mention; the join is dealt out over ``parts``."""
    return dealt(mentions.select("page_id", "entity_id").distinct(), parts, "entity_id").join(entities, "entity_id")


def children_count(events: DataFrame) -> DataFrame:
    """(event_id, child_count) of events with children."""
    return events.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("event_id")).agg(F.count("*").alias("child_count"))


def root_events(events: DataFrame, status: str | None = None, scale: str | None = None) -> DataFrame:
    """#12. Events that no event of the table has as a child, with the number of their own children."""
    own = events.select(F.col("event_id").alias("parent_id"))
    roots = events.join(own, "parent_id", "left_anti")
    for column, value in (("status", status), ("scale", scale)):
        if value is not None:
            roots = roots.filter(F.col(column) == value)
    return roots.join(children_count(events), "event_id", "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))


def event_cards(events: DataFrame, claims: DataFrame, pages: DataFrame, thoughts: DataFrame, min_coherence: float | None = None, thumbnails: int = 5) -> DataFrame:
    """#13. Events with claim and page counts, their newest pages and latest thought.  A null coherence
    passes the filter."""
    e = events if min_coherence is None else events.filter(F.col("coherence").isNull() | (F.col("coherence") >= min_coherence))
    counts = claims.groupBy("event_id").agg(F.count("*").alias("claim_count"), F.countDistinct("page_id").alias("page_count"))
    newest = top_k(pages, ["event_id"], [F.desc("pub_time"), F.asc("page_id")], thumbnails)
    thumbs = newest.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "page_id"))), lambda x: x["page_id"].cast("string")), ",").alias("thumbnails"))
    out = e.join(counts, "event_id", "left").join(thumbs, "event_id", "left").join(latest_thought(thoughts).select("event_id", "thought_id"), "event_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("claim_count", "page_count")})


def latest_thought(thoughts: DataFrame) -> DataFrame:
    """#25. The newest unacknowledged thought of each event, or else the newest."""
    return top_k(thoughts, ["event_id"], [F.asc("acknowledged"), F.desc("created_at"), F.desc("thought_id")], 1).drop("rank")


def event_tree(events: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """#14. A nested row per event: parent, children, entities and claims as sorted arrays."""
    kids = events.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("event_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("event_id").alias("id"), "name"))).alias("children"))
    parent = events.select(F.col("event_id").alias("parent_id"), F.col("name").alias("parent_name"))
    ents = mentions.groupBy("event_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    cl = claims.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", "confidence"))).alias("claims"))
    return events.join(parent, "parent_id", "left").join(kids, "event_id", "left").join(ents, "event_id", "left").join(cl, "event_id", "left")


def event_timeline(claims: DataFrame, pages: DataFrame) -> DataFrame:
    """#15. Claims of events with their page's time, numbered by (event time with nulls last, page time)."""
    j = claims.join(pages.select("page_id", "pub_time"), "page_id", "left")
    w = Window.partitionBy("event_id").orderBy(F.asc_nulls_last("event_time"), F.asc_nulls_last("pub_time"), "claim_id")
    return j.withColumn("position", F.row_number().over(w))


def events_of_entity(mentions: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """#16. Each entity's newest events, with the ids of its claims in them."""
    per = mentions.filter("claim_id IS NOT NULL").groupBy("entity_id", "event_id").agg(F.array_sort(F.collect_set("claim_id")).alias("claim_ids"))
    j = per.join(events.select("event_id", "name", "updated_at"), "event_id")
    return top_k(j, ["entity_id"], [F.desc_nulls_last("updated_at"), F.asc("event_id")], limit)


def search_events(events: DataFrame, text: str, limit: int) -> DataFrame:
    """#18. Events whose name or summary contains ``text`` in any case; none for under 2 characters."""
    if len(text) < 2:
        return events.limit(0)
    t = text.lower()
    found = events.filter(F.lower("name").contains(t) | F.lower("summary").contains(t))
    return page(found, [F.desc_nulls_last("coherence"), F.asc("event_id")], limit)


def coherence_feed(events: DataFrame, claims: DataFrame, min_coherence: float = 0.0, limit: int = 20, offset: int = 0, most: int = 50) -> DataFrame:
    """#19. Events with a summary and enough coherence, most coherent first, with their claim counts."""
    e = events.filter(F.col("summary").isNotNull() & (F.col("coherence") >= min_coherence))
    counts = claims.groupBy("event_id").agg(F.count("*").alias("claim_count"))
    j = e.join(counts, "event_id", "left").withColumn("claim_count", F.coalesce("claim_count", F.lit(0)))
    return page(j, [F.desc("coherence"), F.desc("updated_at"), F.asc("event_id")], min(limit, most), offset)


def page_summary(pages: DataFrame, mentions: DataFrame, claims: DataFrame) -> DataFrame:
    """#20. Distinct entities, events and claims per page; each bridge is counted before it is joined."""
    ents = mentions.groupBy("page_id").agg(F.countDistinct("entity_id").alias("entity_count"))
    cl = claims.groupBy("page_id").agg(F.count("*").alias("claim_count"), F.countDistinct("event_id").alias("event_count"))
    out = pages.join(ents, "page_id", "left").join(cl, "page_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("entity_count", "claim_count", "event_count")})


def claim_flags(claims: DataFrame, as_of: Column, days: int = 7, shown: int = 100) -> DataFrame:
    """#22. Short text and flags: factual (confidence .7), timestamped, current at ``as_of``."""
    short = F.when(F.length("text") > shown, F.concat(F.substring("text", 1, shown - 3), F.lit("..."))).otherwise(F.col("text"))
    return claims.withColumns({
        "short_text": short,
        "is_factual": F.col("confidence") >= 0.7,
        "is_timestamped": F.col("event_time").isNotNull(),
        "is_current": F.coalesce(F.datediff(as_of, F.col("event_time")).between(0, days), F.lit(False)),
    })


def comment_threads(comments: DataFrame) -> DataFrame:
    """#23. Comments with the number of their direct replies."""
    replies = comments.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("comment_id")).agg(F.count("*").alias("replies"))
    return comments.join(replies, "comment_id", "left").withColumn("replies", F.coalesce("replies", F.lit(0)))


def low_affinity(intakes: DataFrame, threshold: float = 0.2, column: str = "affinity") -> DataFrame:
    """#24. Rows with an affinity below the threshold."""
    return intakes.filter(F.col(column).isNotNull() & (F.col(column) < threshold))


def claim_priors(claims: DataFrame, pages: DataFrame, publishers: DataFrame, prior: float = 0.5) -> DataFrame:
    """#26. Each claim's publisher, source type and prior; ``prior`` and 'unknown' without a publisher."""
    p = pages.select("page_id", "publisher_id").join(publishers, "publisher_id", "left")
    j = claims.select("claim_id", "event_id", "page_id").join(p.select("page_id", "publisher", "source_type", "base_prior"), "page_id", "left")
    return j.withColumns({"source_type": F.coalesce("source_type", F.lit("unknown")), "base_prior": F.coalesce("base_prior", F.lit(prior))})


def involves(mentions: DataFrame) -> DataFrame:
    """#209. Distinct (event, entity)."""
    return mentions.select("event_id", "entity_id").distinct()


def orphaned_involves(involved: DataFrame, mentions: DataFrame) -> DataFrame:
    """#35. (event, entity) links that no remaining claim of the event backs."""
    return involved.join(involves(mentions), ["event_id", "entity_id"], "left_anti")


def pruned(intakes: DataFrame, mentions: DataFrame, threshold: float = 0.2) -> DataFrame:
    """#210. Per event: claims pruned for low affinity, and entities that this leaves without a claim."""
    low = low_affinity(intakes, threshold).select("event_id", "claim_id")
    left = mentions.join(low, ["event_id", "claim_id"], "left_anti")
    orphans = orphaned_involves(involves(mentions), left).groupBy("event_id").agg(F.count("*").alias("orphaned"))
    gone = low.groupBy("event_id").agg(F.count("*").alias("pruned"))
    return gone.join(orphans, "event_id", "left").withColumn("orphaned", F.coalesce("orphaned", F.lit(0)))


def not_yet_seen(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """#36. Incoming rows whose key is not known, one per key."""
    return incoming.join(known.select(key), key, "left_anti").dropDuplicates([key])


def newer_on_topic(claims: DataFrame) -> DataFrame:
    """#37. Pairs (newer, older) of an event's claims on one topic with another value, reported later (or
    at the same time of an event not earlier)."""
    c = claims.filter("reported_time IS NOT NULL")
    side = lambda name: c.select("event_id", "topic_key", F.col("claim_id").alias(name), F.struct(F.col("topic_key").alias("topic"), "value", "reported_time", "event_time").alias(f"_{name}"))
    met = side("newer").join(side("older"), ["event_id", "topic_key"]).filter(T.is_update_of(F.col("_newer"), F.col("_older")))
    return met.select("newer", "older", "event_id", "topic_key")


def within_days(claims: DataFrame, events: DataFrame, low: int, high: int, anchor: str) -> DataFrame:
    """#38, #39. Claims whose time lies ``low`` to ``high`` days after an event's ``anchor`` date."""
    j = claims.join(events.select("event_id", anchor), "event_id")
    return j.filter(F.datediff(F.col("event_time"), F.col(anchor)).between(low, high))


def shared_event_pairs(links: DataFrame, node: str, group: str, parts: int | None = None) -> DataFrame:
    """#40. Pairs of nodes that share groups, with how many; the pairs are dealt out over ``parts``."""
    x = links.select(node, group).distinct()
    a, b = x.select(F.col(node).alias("a"), group), x.select(F.col(node).alias("b"), group)
    met = a.join(b, group).filter(F.col("a") < F.col("b")).select("a", "b")
    return dealt(met, parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def named_edges(edges: DataFrame, names: DataFrame) -> DataFrame:
    """#41. Edges with the names of both ends."""
    a = names.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    b = names.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    return edges.join(a, "src").join(b, "dst")


def evidence_search(entities: DataFrame, mentions: DataFrame, claims: DataFrame, in_degree: DataFrame, text: str, k: int = 20) -> DataFrame:
    """#211. Claims of entities whose name contains ``text``, best backed first (in-degree, then confidence)."""
    found = entities.filter(F.lower("canonical_name").contains(text.lower())).select("entity_id")
    c = mentions.join(found, "entity_id", "left_semi").select("claim_id").distinct().join(claims, "claim_id").join(in_degree, "claim_id", "left")
    return page(c.withColumn("in_degree", F.coalesce("in_degree", F.lit(0))), [F.desc("in_degree"), F.desc("confidence"), F.asc("claim_id")], k)


def names_within(names: DataFrame, entities: DataFrame, gram: int = 3) -> DataFrame:
    """(name, entity_id) where the entity's name contains ``name``, both lower-cased: an index of n-grams in place of
    comparing all.  A name is looked up under the one of its n-grams that is in fewest entities, or under itself if it is shorter,
    and what is there is verified.  The empty name is in every entity's; null ones are in none.  The index is many times
    its source, by whose size Spark would send it to all executors: the joins are hinted to shuffle it."""
    low = entities.filter("canonical_name IS NOT NULL").select("entity_id", F.lower("canonical_name").alias("_full"))
    cut = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *[cut(F.col("_full"), n) for n in range(1, gram + 1)]))
    index = low.select("entity_id", "_full", F.explode(grams).alias("_g"))
    sizes = index.groupBy("_g").agg(F.count("*").alias("_n"))
    wanted = names.filter("name IS NOT NULL").select("name").distinct()
    own = F.when(F.length("name") < gram, F.array(F.lower("name"))).otherwise(cut(F.lower("name"), gram))
    keyed = wanted.select("name", F.explode(F.array_distinct(own)).alias("_g")).join(sizes.hint("merge"), "_g")
    # a name with an n-gram that no entity has is in none
    total = wanted.select("name", F.size(F.array_distinct(own)).alias("_k"))
    rarest = keyed.groupBy("name").agg(F.min(F.struct("_n", "_g")).alias("_r"), F.count("*").alias("_got")).join(total, "name").filter("_got = _k").select("name", F.col("_r._g").alias("_g"))
    return rarest.join(index.hint("merge"), "_g").filter(F.contains(F.col("_full"), F.lower("name"))).select("name", "entity_id")


def entity_priors(names: DataFrame, entities: DataFrame, mentions: DataFrame, samples: int = 5) -> DataFrame:
    """#212. For each searched name the entity that contains it (most mentioned, smallest id), with sample
    claims and whether it is known."""
    found = names_within(names, entities).join(entities.select("entity_id", "mention_count").hint("merge"), "entity_id")
    best = names.select("name").join(top_k(found, ["name"], [F.desc_nulls_last("mention_count"), F.asc("entity_id")], 1).select("name", "entity_id"), "name", "left")
    claims = top_k(mentions.select("entity_id", "claim_id").distinct(), ["entity_id"], [F.asc("claim_id")], samples)
    s = claims.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list("claim_id")), ",").alias("samples"))
    return best.join(s.hint("merge"), "entity_id", "left").select("name", "entity_id", "samples", F.col("entity_id").isNotNull().alias("known"))


def event_structure(events: DataFrame, claims: DataFrame) -> DataFrame:
    """#221. Sub-events, direct claims and the time span of dated claims per event, in days."""
    c = claims.groupBy("event_id").agg(F.count("*").alias("claims"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
    j = events.join(children_count(events), "event_id", "left").join(c, "event_id", "left")
    return j.withColumns({"child_count": F.coalesce("child_count", F.lit(0)), "claims": F.coalesce("claims", F.lit(0)), "days": F.datediff("last_time", "first_time")})
