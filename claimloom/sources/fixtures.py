"""Domain tables built from the supplied star tables: claims, pages, events, entities, edges (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.operators.relational import dealt, parts_for

#: Event ids of the two upper levels of the event tree.
NATION_EVENTS, REGION_EVENTS = 1_000_000, 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, d: str, name: str = "lineitem", times: int = 1) -> int | None:
    """``parts_for`` of what has some ``times`` as many rows as a source table: a task's share doesn't grow with the table."""
    return parts_for(spark, read(spark, d, name).count() * times)


def kg_pages(spark: SparkSession, d: str) -> DataFrame:
    o = dealt(read(spark, d, "orders"), parts(spark, d, "orders"), "o_custkey").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("page_id"),
        F.col("o_custkey").alias("event_id"),
        F.col("o_orderdate").alias("pub_time"),
        F.col("o_orderstatus").alias("status"),
        F.col("c_nationkey").alias("publisher_id"),
        F.concat(F.lit("Report "), F.col("o_orderkey").cast("string")).alias("title"),
        F.pmod(F.col("o_orderkey") * 13, F.lit(400)).alias("word_count"),
    )


def kg_publishers(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("wire", "newspaper", "broadcaster", "magazine", "official")))
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(
        n.alias("publisher_id"),
        F.col("n_name").alias("publisher"),
        F.element_at(kinds, F.pmod(n, F.lit(5)) + 1).alias("source_type"),
        F.round(F.lit(0.5) + F.lit(0.01) * F.pmod(n, F.lit(11)), 2).alias("base_prior"),
    )


def kg_claims(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct line: the star table repeats (order, line number).  Lines are dealt out by part, which serves
    the grouping and the join with parts, and then by order: what goes on by ``page_id`` needs no further shuffle."""
    n = parts(spark, d)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    line = read(spark, d, "lineitem").select(*keys, "l_quantity", "l_discount")
    line = dealt(line, n, "l_partkey") if n else line.repartition("l_partkey")
    line = line.groupBy(*keys).agg(F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    j = dealt(line.join(p, F.col("l_partkey") == F.col("p_partkey")), n, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.col("q").cast("long")
    text = (
        F.when(F.pmod(value, F.lit(4)) == 0, F.concat(value.cast("string"), F.lit(" people were killed near "), F.col("p_name")))
        .when(F.pmod(value, F.lit(4)) == 1, F.concat(F.lit("at least "), value.cast("string"), F.lit(" people were injured by "), F.col("p_name")))
        .when(F.pmod(value, F.lit(4)) == 2, F.concat(value.cast("string"), F.lit(" people are missing, officials said of "), F.col("p_name")))
        .otherwise(F.concat(F.lit("alarm raised to level "), value.cast("string"), F.lit(" at "), F.col("p_name")))
    )
    return j.select(
        F.concat_ws("-", *[F.col(k).cast("string") for k in keys[:4]], F.date_format("l_shipdate", "yyyyMMdd")).alias("claim_id"),
        F.col("l_orderkey").alias("page_id"),
        F.col("o_custkey").alias("event_id"),
        F.col("l_shipdate").alias("event_time"),
        F.col("o_orderdate").alias("reported_time"),
        value.alias("value"),
        F.round(1 - F.col("disc"), 2).alias("confidence"),
        F.col("p_brand").alias("topic_key"),
        text.alias("text"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_entity"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("supp_entity"),
    )


def kg_mentions(spark: SparkSession, d: str) -> DataFrame:
    return kg_claims(spark, d).select("claim_id", "event_id", "page_id", F.explode(F.array("part_entity", "supp_entity")).alias("entity_id"))


def kg_entities(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("canonical_name"),
        F.lit("PRODUCT").alias("entity_type"),
        F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.concat(F.lit("Q"), F.col("p_size").cast("string"))).alias("wikidata_qid"),
        F.pmod(F.col("p_partkey") * 7, F.lit(50)).alias("mention_count"),
    )
    s = read(spark, d, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("entity_id"),
        F.col("s_name").alias("canonical_name"),
        F.lit("ORGANIZATION").alias("entity_type"),
        F.lit(None).cast("string").alias("wikidata_qid"),
        F.pmod(F.col("s_suppkey") * 7, F.lit(50)).alias("mention_count"),
    )
    return p.unionByName(s)


def kg_events(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    start = F.timestamp_seconds(F.lit(1_704_067_200))
    leaf = read(spark, d, "customer").select(
        c.alias("event_id"),
        F.col("c_name").alias("name"),
        (F.lit(NATION_EVENTS) + F.col("c_nationkey")).cast("long").alias("parent_id"),
        F.when(F.col("c_acctbal") < 0, "provisional").otherwise("active").alias("status"),
        F.lit("micro").alias("scale"),
        F.when(F.pmod(c, F.lit(7)) != 0, F.round(F.pmod(c * 37, F.lit(100)) / 100, 2)).alias("coherence"),
        F.when(F.pmod(c, F.lit(5)) != 0, F.col("c_mktsegment")).alias("summary"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(c, F.lit(365)) * 86_400).alias("updated_at"),
    )
    upper = lambda df, key, name, base, parent, scale: df.select(
        (F.lit(base) + F.col(key)).cast("long").alias("event_id"), F.col(name).alias("name"), parent.cast("long").alias("parent_id"),
        F.lit("active").alias("status"), F.lit(scale).alias("scale"), F.lit(0.5).alias("coherence"), F.col(name).alias("summary"), start.alias("updated_at"),
    )
    n = upper(read(spark, d, "nation"), "n_nationkey", "n_name", NATION_EVENTS, F.lit(REGION_EVENTS) + F.col("n_regionkey"), "meso")
    r = upper(read(spark, d, "region"), "r_regionkey", "r_name", REGION_EVENTS, F.lit(None), "macro")
    return leaf.unionByName(n).unionByName(r)


def kg_claim_edges(spark: SparkSession, d: str, claims: DataFrame | None = None) -> DataFrame:
    """Pairs of claims of one event and topic: (src, dst, rel), src the smaller id; ``claims`` are the claims, if they
    are there already."""
    c = (kg_claims(spark, d) if claims is None else claims).select("claim_id", "event_id", "topic_key", "event_time", "value")
    c = dealt(c, parts(spark, d), "event_id", "topic_key")
    a = c.select(F.col("claim_id").alias("src"), "event_id", "topic_key", F.col("event_time").alias("ta"), F.col("value").alias("va"))
    b = c.select(F.col("claim_id").alias("dst"), "event_id", "topic_key", F.col("event_time").alias("tb"), F.col("value").alias("vb"))
    later = ((F.col("tb") > F.col("ta")) & (F.col("vb") > F.col("va"))) | ((F.col("ta") > F.col("tb")) & (F.col("va") > F.col("vb")))
    rel = F.when(F.col("va") == F.col("vb"), "CORROBORATES").when(later, "UPDATES").otherwise("CONTRADICTS")
    return a.join(b, ["event_id", "topic_key"]).filter(F.col("src") < F.col("dst")).select("src", "dst", rel.alias("rel"), "event_id")


def kg_entity_edges(spark: SparkSession, d: str) -> DataFrame:
    """part -> supplier by shared claims, supplier -> nation, nation -> region."""
    c = kg_claims(spark, d)
    ps = c.groupBy("part_entity", "supp_entity").count()
    a = ps.select(F.col("part_entity").alias("src"), F.col("supp_entity").alias("dst"), F.least(F.lit(1.0), F.round(F.lit(0.52) + F.lit(0.1) * F.col("count"), 2)).alias("confidence"), F.col("count").alias("evidence_count"))
    s = read(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dst"), F.lit(0.9).alias("confidence"), F.lit(1).cast("long").alias("evidence_count"))
    n = read(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("dst"), F.lit(0.9).alias("confidence"), F.lit(1).cast("long").alias("evidence_count"))
    return a.unionByName(s).unionByName(n)


def kg_thoughts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").filter(F.col("event_type") == "error")
    return e.select(F.col("event_id").alias("thought_id"), F.col("user_id").alias("event_id"), F.col("ts").alias("created_at"), (F.pmod("event_id", F.lit(2)) == 0).alias("acknowledged"))


def kg_comments(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations")
    return c.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"),
        F.col("conv_id").alias("event_id"), "turn", F.col("role").alias("user"), "text",
        F.when(F.col("turn") > 0, F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))).alias("parent_id"),
    )


def kg_tasks(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "processing").otherwise("failed")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))


def kg_ledger(spark: SparkSession, d: str) -> DataFrame:
    delta = F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", F.lit(-1.0)).otherwise(F.lit(0.0))
    return read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", F.round(delta, 2).alias("delta"))
