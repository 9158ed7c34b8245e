"""Graph operators as loops of joins: components, reachability, chains and levels (rows 66, 70, 71, 109, 129, 130)."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; where that is unset, as in
    tests, a temporary one of this process.  Raises if it is unset and executors run elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="claimloom-"))
        base = _OWN_FOLDER[0]
    return base.rstrip("/")


def cut_lineage(df: DataFrame, name: str = "loop") -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _lookup(df: DataFrame, key: str, names: DataFrame, name_key: str, value: str, out: str) -> DataFrame:
    """Left join with one row a key, dealt out anew on both sides so that a hot key can be split."""
    r = names.select(F.col(name_key).alias("_k"), F.col(value).alias(out))
    hot = (df[key] == r["_k"]) & (F.xxhash64(df[key]) == F.xxhash64(r["_k"]))
    return df.join(r, hot, "left").drop("_k")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """#109. (id, component): the smallest id of the component for each end of an undirected edge.

    Each round takes the smallest label of a vertex's neighbours for the vertex and for its old
    label (hooking), then jumps labels to their labels.  Edges inside a component are dropped as
    labels replace their ends, so that rounds shrink.  Rows with a null end and self-loops only name
    their vertex.  Raises if ``max_rounds`` don't suffice.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ids = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).distinct()
    label = cut_lineage(ids.withColumn("component", F.col("id")), "components")
    live = cut_lineage(e.filter(F.col("a") != F.col("b")).distinct(), "components")
    for _ in range(max_rounds):
        if live.isEmpty():
            return label
        # in the contracted graph each vertex hooks onto its smallest neighbour, if that is smaller
        low = live.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        parent = cut_lineage(low.groupBy("hi").agg(F.min("lo").alias("to")), "components")
        while True:  # to the roots: a parent is always smaller, so there is no cycle
            up = _lookup(parent, "to", parent, "hi", "to", "above")
            parent = cut_lineage(up, "components")
            if parent.filter(F.col("above").isNotNull()).isEmpty():
                parent = parent.select("hi", "to")
                break
            parent = parent.select("hi", F.coalesce("above", "to").alias("to"))
        label = cut_lineage(_lookup(label, "component", parent, "hi", "to", "up").select("id", F.coalesce("up", "component").alias("component")), "components")
        both = _lookup(_lookup(live, "a", parent, "hi", "to", "ra"), "b", parent, "hi", "to", "rb")
        both = both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        live = cut_lineage(both.filter(F.col("a") != F.col("b")).distinct(), "components")
    if live.isEmpty():
        return label
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def reachable(edges: DataFrame, max_depth: int = 2, least: float = 0.7) -> DataFrame:
    """#129. (start, node, depth, confidence) of nodes reached over edges (src, dst, confidence) of at least
    ``least``: the distinct paths by their product of confidences, up to ``max_depth`` edges."""
    e = edges.filter(F.col("confidence") >= least).select("src", "dst", "confidence")
    front = cut_lineage(e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("depth"), "confidence"), "reach")
    found = front
    for depth in range(2, max_depth + 1):
        step = e.select(F.col("src").alias("node"), F.col("dst").alias("_n"), F.col("confidence").alias("_c"))
        nxt = front.join(step, "node").select("start", F.col("_n").alias("node"), F.lit(depth).alias("depth"), (F.col("confidence") * F.col("_c")).alias("confidence"))
        front = cut_lineage(nxt.distinct(), "reach")
        if front.isEmpty():
            break
        found = found.union(front)
    return found.distinct()


def decayed(confidence, last_seen, as_of, rate, kind: str = "exponential"):
    """#130. Confidence after the days since ``last_seen``: exp(-rate days), or 1 - rate days, 0 at least."""
    days = F.greatest(F.datediff(as_of, last_seen), F.lit(0))
    if kind == "linear":
        return confidence * F.greatest(F.lit(0.0), 1 - rate * days)
    return confidence * F.exp(-rate * days)


def cross_group_components(links: DataFrame, members: DataFrame) -> DataFrame:
    """#123. Claims that leave their page's unit: components of links between claims of different pages.
    Returns per page how many of its claims migrate and remain.  ``members`` (claim_id, page_id)."""
    a, b = members.select(F.col("claim_id").alias("src"), F.col("page_id").alias("_pa")), members.select(F.col("claim_id").alias("dst"), F.col("page_id").alias("_pb"))
    cross = links.select("src", "dst").join(a, "src").join(b, "dst").filter(F.col("_pa") != F.col("_pb"))
    comp = connected_components(cross, "src", "dst").withColumnRenamed("id", "claim_id")
    j = members.join(comp, "claim_id", "left")
    return j.groupBy("page_id").agg(F.count("component").alias("migrated"), F.count(F.when(F.col("component").isNull(), 1)).alias("remaining"))
