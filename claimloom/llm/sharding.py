"""Sharding by longest-processing-time scheduling: equal texts stay together, shards get equal bytes.

Groups go from the largest down to the least-loaded shard, through a heap.  Only groups above a
share of the total are scheduled one by one, which bounds their number; smaller ones are first
gathered into a fixed number of bundles by hash, and bundles are scheduled like groups.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm import common

SHARDS = 16
#: Bundles for each shard; a group larger than the mean bundle is scheduled on its own.
BUNDLES_PER_SHARD = 512
#: Rows of a shard that get their slots in one task, on average.
SLOT_ROWS = 50_000


def schedule(sizes: list[tuple[int, int]], shards: int) -> dict[int, int]:
    """The shard of each (key, size): largest first, each to the least-loaded shard."""
    loads = [(0, s) for s in range(shards)]
    out = {}
    for key, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(loads)
        out[key] = s
        heapq.heappush(loads, (load + size, s))
    return out


def row_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none for null, plus 1."""
    return (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")


def _group(text: str = "text") -> Column:
    """Equal texts have equal groups; null and empty texts make one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def assign(docs: DataFrame, shards: int = SHARDS, bundles_per_shard: int = BUNDLES_PER_SHARD) -> DataFrame:
    """The columns of ``docs`` and size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    Slots number the rows of a shard from 0 without gaps, by bundle, doc_id and text; rows equal in
    these take their slots in any order.  Columns of ``docs`` with a name of the result give way.
    What reaches the driver: up to ``shards * bundles_per_shard`` bundles, as many large groups, and
    a row count for each cell of slots.
    """
    spark = docs.sparkSession
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    names = [c for c in docs.columns if c not in made]
    n_bundles = shards * bundles_per_shard
    g = docs.select(_group().alias("g"), row_bytes().alias("size"))
    groups = common.stored(g.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "shard-groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    least = max(1, total // n_bundles)
    large = groups.filter(F.col("bytes") > least).select("g", "bytes").toArrow().to_pylist()  # fewer than n_bundles
    bundle = F.pmod(F.xxhash64("g", F.lit(1)), F.lit(n_bundles))
    small = groups.filter(F.col("bytes") <= least).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).toArrow().to_pylist()
    where = schedule([(-1 - k, r["bytes"]) for k, r in enumerate(large)] + [(r["b"], r["bytes"]) for r in small], shards)
    own = spark.createDataFrame([(r["g"], where[-1 - k]) for k, r in enumerate(large)], "g long, own int")
    bundles = spark.createDataFrame([(r["b"], where[r["b"]]) for r in small], "b long, bundled int")

    # both tables have at most n_bundles rows
    d = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), "doc_id", F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), row_bytes().alias("size"), _group().alias("g"))
    d = d.withColumn("b", bundle).join(F.broadcast(own), "g", "left").join(F.broadcast(bundles), "b", "left")
    d = d.withColumn("shard", F.coalesce("own", "bundled"))
    cells = max(1, int(n_rows) // (shards * SLOT_ROWS))
    d = d.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int"))
    counts = d.groupBy("shard", "cell").count()
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    offsets = common.stored(offsets, "shard-offsets")
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "g")
    d = d.withColumn("at", F.row_number().over(within)).join(offsets, ["shard", "cell"])
    slot = (F.col("base") + F.col("at") - 1).cast("long").alias("slot")
    keep = [F.col(f"_row.`{c}`").alias(c) for c in names]
    return d.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
