"""Clusters of claims, units and events (rows 111-128, 217-218, 222-224).

Greedy methods use a strict total order (score, then id), so that results don't hang on row order.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import vectors as V
from claimloom.operators.graph import connected_components, cut_lineage
from claimloom.operators.overlap import Cell, affine_pairs, counted, dots, in_cells, judged_pairs, overlaps, padded
from claimloom.operators.planes import pairs as vector_pairs
from claimloom.operators.relational import top_k
from claimloom.operators.scoring import mean_entropy
from claimloom.operators.similarity import PIECE_ROWS, near_later, pairs_within


def _rounds(max_rounds: int | None) -> Iterator[int]:
    """Numbers of rounds, without end; raises after ``max_rounds`` if that is given."""
    yield from itertools.count() if max_rounds is None else range(max_rounds)
    raise RuntimeError(f"rows are left after {max_rounds} rounds")


def _fewer(live: DataFrame, before: int | None, why: str) -> int:
    """The number of rows that are left; raises if a round has taken none."""
    n = live.count()
    if n == before:
        raise RuntimeError(f"a round settled nothing: {why}")
    return n


def _gather(parts: list[DataFrame], more: DataFrame, name: str) -> list[DataFrame]:
    """``parts`` and ``more``, written as one table every 50 rounds so that plans stay short."""
    parts = [*parts, more]
    return parts if len(parts) < 50 else [cut_lineage(reduce(DataFrame.unionByName, parts), name)]


def exclusive_topics(candidates: DataFrame, min_claims: int, min_pages: int, max_rounds: int | None = None) -> DataFrame:
    """#111-#113. Greedy exclusive assignment: anchors by their order, each takes its claims that are still
    free if these are enough, on enough pages.  ``candidates`` (anchor, claim_id, page_id, score).

    The anchors that no better live anchor shares a free claim with are settled together, which gives the
    result of going through them one by one.  Goes on until no anchor has enough; raises if ``max_rounds``
    is given and doesn't suffice, or if an anchor's rows differ in score so that none can be settled.
    """
    live = cut_lineage(candidates.select("anchor", "claim_id", "page_id", "score").distinct(), "topics")
    out, left = [], None
    for _ in _rounds(max_rounds):
        counts = live.groupBy("anchor").agg(F.countDistinct("claim_id").alias("_c"), F.countDistinct("page_id").alias("_p"))
        good = counts.filter((F.col("_c") >= min_claims) & (F.col("_p") >= min_pages)).select("anchor")
        live = cut_lineage(live.join(good, "anchor", "left_semi"), "topics")
        left = _fewer(live, left, "anchors have more than one score")
        if not left:
            break
        best = live.groupBy("claim_id").agg(F.max_by("anchor", F.struct("score", "anchor")).alias("_best"))
        contested = live.join(best, "claim_id").filter(F.col("anchor") != F.col("_best")).select("anchor").distinct()
        won = cut_lineage(live.join(contested, "anchor", "left_anti"), "topics")
        out = _gather(out, won, "topics")
        live = cut_lineage(live.join(won.select("anchor").distinct(), "anchor", "left_anti").join(won.select("claim_id").distinct(), "claim_id", "left_anti"), "topics")
    return reduce(DataFrame.unionByName, out) if out else candidates.select("anchor", "claim_id", "page_id", "score").limit(0)


def gravity_topics(mentions: DataFrame, min_claims: int = 3, min_pages: int = 2) -> DataFrame:
    """#111. Topics around entities by gravity, claims times pages."""
    g = mentions.groupBy("entity_id").agg(F.countDistinct("claim_id").alias("_c"), F.countDistinct("page_id").alias("_p"))
    g = g.filter((F.col("_c") >= min_claims) & (F.col("_p") >= min_pages)).select("entity_id", (F.col("_c") * F.col("_p")).alias("score"))
    c = mentions.join(g, "entity_id").select(F.col("entity_id").alias("anchor"), "claim_id", "page_id", "score")
    return exclusive_topics(c, min_claims, min_pages)


def constellations(mentions: DataFrame, min_claims: int = 3, min_pages: int = 2) -> DataFrame:
    """#112. Topics around pairs of entities that occur together."""
    m = mentions.select("claim_id", "page_id", "entity_id").distinct()
    p = m.withColumnRenamed("entity_id", "_a").join(m.select("claim_id", F.col("entity_id").alias("_b")), "claim_id").filter("_a < _b")
    p = p.select(F.concat_ws("|", "_a", "_b").alias("anchor"), "claim_id", "page_id")
    n = p.groupBy("anchor").agg(F.countDistinct("claim_id").alias("score"))
    return exclusive_topics(p.join(n, "anchor"), min_claims, min_pages)


def anchor_context(mentions: DataFrame, min_claims: int = 5, min_pages: int = 3, links: DataFrame | None = None, left_claims: int = 3, left_pages: int = 2, shared: int = 2) -> DataFrame:
    """#113. Topics around anchors: entities in ``min_claims`` claims on ``min_pages`` pages, by claims times
    concentration (claims per page).  An anchor takes its free claims if ``left_claims`` on ``left_pages`` are left.

    With ``links`` (src, dst), topics then absorb free claims that link to one of their claims and share
    ``shared`` entities with their context, all entities of their claims but the anchor; a claim goes to the best
    anchor, and what it brings counts from the next round on, until no claim is absorbed.
    """
    g = mentions.groupBy("entity_id").agg(F.countDistinct("claim_id").alias("_c"), F.countDistinct("page_id").alias("_p"))
    g = g.filter((F.col("_c") >= min_claims) & (F.col("_p") >= min_pages)).select("entity_id", (F.col("_c") * F.col("_c") / F.col("_p")).alias("score"))
    topics = exclusive_topics(mentions.join(g, "entity_id").select(F.col("entity_id").alias("anchor"), "claim_id", "page_id", "score"), left_claims, left_pages)
    return topics if links is None else _absorbed(topics, mentions, links, shared)


def _absorbed(topics: DataFrame, mentions: DataFrame, links: DataFrame, shared: int) -> DataFrame:
    """``topics`` with the linked claims that share ``shared`` entities with their context."""
    page = mentions.groupBy("claim_id").agg(F.min("page_id").alias("page_id"))
    both = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()
    entities = mentions.select("claim_id", "entity_id").distinct()
    score = cut_lineage(topics.select("anchor", "score").distinct(), "absorbed")
    context = lambda got: got.join(entities, "claim_id").select("anchor", "entity_id").filter("anchor <> entity_id").distinct()
    free = cut_lineage(both.join(topics.select(F.col("claim_id").alias("dst")), "dst", "left_anti"), "absorbed")
    known, new, out = None, cut_lineage(topics.select("anchor", "claim_id"), "absorbed"), [topics]
    reached = None
    while True:
        known = cut_lineage(context(new) if known is None else known.unionByName(context(new)).distinct(), "absorbed")
        touched = free.join(new.select(F.col("claim_id").alias("src"), "anchor"), "src").select(F.col("dst").alias("claim_id"), "anchor")
        # a claim linked to a topic may come to share enough later
        reached = cut_lineage((touched if reached is None else reached.unionByName(touched)).distinct(), "absorbed")
        met = reached.join(entities, "claim_id").join(known, ["anchor", "entity_id"], "left_semi").groupBy("claim_id", "anchor").agg(F.count("*").alias("_k")).filter(F.col("_k") >= shared)
        best = met.join(score, "anchor").groupBy("claim_id").agg(F.max(F.struct("score", "anchor")).alias("_b")).select("_b.anchor", "claim_id", "_b.score")
        new = cut_lineage(best, "absorbed")
        if new.isEmpty():
            break
        out = _gather(out, new.join(page, "claim_id").select("anchor", "claim_id", "page_id", "score"), "absorbed")
        taken = new.select("claim_id")
        free = cut_lineage(free.join(taken.withColumnRenamed("claim_id", "dst"), "dst", "left_anti"), "absorbed")
        reached = cut_lineage(reached.join(taken, "claim_id", "left_anti"), "absorbed")
        new = new.select("anchor", "claim_id")
    return reduce(DataFrame.unionByName, out)


def seeded_clusters(mentions: DataFrame, least: int, size: int) -> DataFrame:
    """#114. (id, member): claims of each entity mentioned ``least`` times, in clusters of ``size`` at least."""
    g = mentions.groupBy("entity_id").agg(F.count("*").alias("_n"), F.countDistinct("claim_id").alias("_s")).filter((F.col("_n") >= least) & (F.col("_s") >= size)).select("entity_id")
    return mentions.join(g, "entity_id", "left_semi").select(F.col("entity_id").alias("id"), F.col("claim_id").alias("member")).distinct()


def merged_clusters(members: DataFrame, jaccard: float = 0.5, contained: float = 0.5) -> DataFrame:
    """#115. Clusters (id, member) merged where they overlap by Jaccard or by share of the smaller one;
    merging is transitive, and a merged cluster has the smallest id."""
    m = members.select("id", "member").distinct()
    sets = m.join(m.groupBy("id").agg(F.count("*").alias("n")), "id").select("id", F.col("member").alias("token"), "n")
    alike = lambda k, x, y: (k / (x["n"] + y["n"] - k) >= jaccard) | (k / np.minimum(x["n"], y["n"]) >= contained)
    near = judged_pairs(sets, lambda *of: alike(*of).astype(float), 1.0)
    comp = connected_components(near.select("a", "b"), "a", "b")
    return m.join(comp, "id", "left").select(F.coalesce("component", "id").alias("id"), "member").distinct()


def cluster_scores(members: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """#116. Coherence of clusters: half the share of entities that two or more members have, half the inner
    links over members, at most 1."""
    e = members.join(mentions.select(F.col("claim_id").alias("member"), "entity_id"), "member").groupBy("id", "entity_id").agg(F.countDistinct("member").alias("_m"))
    shared = e.groupBy("id").agg(F.avg((F.col("_m") >= 2).cast("int")).alias("_s"))
    a, b = members.select("id", F.col("member").alias("src")), members.select(F.col("id").alias("_j"), F.col("member").alias("dst"))
    inner = edges.join(a, "src").join(b, "dst").filter(F.col("id") == F.col("_j")).groupBy("id").agg(F.count("*").alias("links"))
    n = members.groupBy("id").agg(F.count("*").alias("size"))
    j = n.join(shared, "id", "left").join(inner, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return j.select("id", "size", "links", F.round(0.5 * F.coalesce("_s", F.lit(0.0)) + 0.5 * F.least(F.lit(1.0), F.col("links") / F.col("size")), 6).alias("coherence"))


def average_link(df: DataFrame, group: str, key: str, vector: str, distance: float = 0.3, most: int = 2_000) -> DataFrame:
    """#117. (group, key, theme): average-link clusters of each group's vectors, cut at cosine ``distance``.

    The theme is the cluster's smallest key; similarities count to 9 decimals, and ties go by key.  Groups of
    up to ``most`` rows are clustered in a task each, larger ones by rounds of joins with the same result.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    sized = df.join(sizes, group)
    key_type, group_type = df.schema[key].dataType.simpleString(), df.schema[group].dataType.simpleString()

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.array(pdf[vector].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        n, sims = len(x), x @ x.T
        size, alive, theme = np.ones(n), list(range(n)), np.arange(n)
        while len(alive) > 1:
            s = sims[np.ix_(alive, alive)].copy()
            s = s.round(9)
            np.fill_diagonal(s, -2)
            i, j = divmod(int(s.argmax()), len(alive))
            if s[i, j] < 1 - distance:
                break
            a, b = sorted((alive[i], alive[j]))
            mean = (size[a] * sims[a] + size[b] * sims[b]) / (size[a] + size[b])
            sims[a], sims[:, a] = mean, mean
            size[a] += size[b]
            theme[theme == b] = a
            alive.remove(b)
        return pd.DataFrame({group: pdf[group], key: pdf[key], "theme": [pdf[key][t] for t in theme]})

    small = sized.filter(F.col("_n") <= most).select(group, key, vector).groupBy(group).applyInPandas(cut, f"{group} {group_type}, {key} {key_type}, theme {key_type}")
    large = sized.filter(F.col("_n") > most).select(group, key, vector)
    if large.isEmpty():
        return small
    rows = large.select(F.col(group).alias("g"), F.col(key).alias("c"), F.col(vector).alias("v"))
    return small.unionByName(_average_link_rounds(rows, 1 - distance).select(F.col("g").alias(group), F.col("k").alias(key), F.col("c").alias("theme")))


def _average_link_rounds(rows: DataFrame, least: float) -> DataFrame:
    """(g, k, c): the average-link clusters of ``rows`` (g, c, v), by rounds that merge all pairs of clusters
    that are each other's nearest.  A merged cluster is nowhere nearer than its nearer half was, so this
    gives the clusters of merging one pair at a time, and pairs under ``least`` never come back.
    """
    norm = F.greatest(F.sqrt(V.dot(F.col("v"), F.col("v"))), F.lit(1e-12))
    unit = rows.select("g", "c", norm.alias("_n"), F.col("v").cast("array<double>").alias("v"))
    # the mean of all cosines of two clusters is the product of their sums of unit vectors over n m
    clusters = cut_lineage(unit.select("g", "c", F.lit(1).cast("long").alias("n"), F.transform("v", lambda x: x / F.col("_n")).alias("s")), "links")
    themes = clusters.select("g", F.col("c").alias("k"), "c")
    side = lambda c: clusters.select("g", F.col("c").alias(c), F.col("n").alias(f"n{c}"), F.col("s").alias(f"s{c}"))
    cosine = F.round(V.dot(F.col("sa"), F.col("sb")) / (F.col("na") * F.col("nb")), 9).alias("e")
    near = lambda met: met.select("g", "a", "b", cosine).filter(F.col("e") >= least)
    pairs = cut_lineage(near(side("a").join(side("b"), "g").filter("a < b")), "links")
    left = None
    while left := _fewer(pairs, left, "no pair is the nearest of both"):
        ends = pairs.select("g", F.col("a").alias("v"), "a", "b", "e").unionByName(pairs.select("g", F.col("b").alias("v"), "a", "b", "e"))
        best = ends.groupBy("g", "v").agg(F.min(F.struct((-F.col("e")).alias("e"), "a", "b")).alias("p")).select("g", "p.a", "p.b")
        won = cut_lineage(best.groupBy("g", "a", "b").agg(F.count("*").alias("_n")).filter("_n = 2").select("g", "a", "b"), "links")
        moved = won.select("g", F.col("a").alias("c"), F.col("a").alias("_to")).unionByName(won.select("g", F.col("b").alias("c"), F.col("a").alias("_to")))
        both = won.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"])
        both = both.select("g", F.col("a").alias("c"), (F.col("na") + F.col("nb")).alias("n"), F.zip_with("sa", "sb", lambda x, y: x + y).alias("s"))
        clusters = cut_lineage(clusters.join(moved, ["g", "c"], "left_anti").unionByName(both), "links")
        themes = cut_lineage(themes.join(moved, ["g", "c"], "left").select("g", "k", F.coalesce("_to", "c").alias("c")), "links")
        to = lambda c: moved.select("g", F.col("c").alias(c), F.col("_to").alias(f"t{c}"))
        named = pairs.join(to("a"), ["g", "a"], "left").join(to("b"), ["g", "b"], "left")
        same = named.filter("ta IS NULL AND tb IS NULL").select("g", "a", "b", "e")
        x, y = F.coalesce("ta", "a"), F.coalesce("tb", "b")
        again = named.filter("ta IS NOT NULL OR tb IS NOT NULL").select("g", F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()
        pairs = cut_lineage(same.unionByName(near(again.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]))), "links")
    return themes


def leader_clusters(df: DataFrame, key: str, order: list[Column], vector: str, shard: Column, least: float = 0.70) -> DataFrame:
    """#118. (key, leader): online leader clustering in the given order within each shard: a row joins the
    nearest centroid of cosine ``least`` or more (to 9 decimals; ties: the older), else it leads; centroids are running means.

    A shard's rows go through one task in order, since each row's place hangs on those before; they pass in batches,
    and its centroids alone are held.  Rows without a vector lead themselves.  ``timers.leader_stream`` is the form for streams.
    """
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, leaders, sums = None, [], V.Grown([], 0)
        for pdf in batches:
            out = []
            for place, k, v in zip(pdf["_shard"].tolist(), pdf[key].tolist(), pdf[vector].tolist()):
                if place != now:
                    now, leaders, sums = place, [], V.Grown([], 0)
                v = np.zeros(0) if v is None else np.asarray(v, float)
                norm = float(np.linalg.norm(v))
                i = sums.nearest(v / norm, least) if norm else None
                if norm and i is None:
                    i = sums.new(len(v))
                    leaders.append(k)
                if norm:
                    sums.rows[i] += v
                out.append(leaders[i] if norm else k)
            yield pd.DataFrame({key: pdf[key], "leader": out})

    orders = [f"_o{i}" for i in range(len(order))]
    placed = df.select(key, vector, F.coalesce(shard.cast("string"), F.lit("")).alias("_shard"), *[o.alias(n) for o, n in zip(order, orders)])
    return placed.repartition("_shard").sortWithinPartitions("_shard", *orders, key).select(key, vector, "_shard").mapInPandas(run, f"{key} {key_type}, leader {key_type}")


def merged_units(units: DataFrame, least: float = 0.60, min_size: int = 3, size: int | None = None) -> DataFrame:
    """#119. (id, event): units (id, size, group, vector) of a group with ``min_size`` members whose centroids
    have a cosine over ``least``, by components.  All pairs of a group are compared; with ``size`` (of the vectors) those that
    hyperplanes bring together, with a recall of .95 a pair at the threshold, where groups are too large for that."""
    big = units.filter(F.col("size") >= min_size)
    near = pairs_within(big, "id", "group", "vector", least) if size is None else vector_pairs(big, "id", "vector", least, size, group="group")
    comp = connected_components(near, "a", "b")
    return units.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("event"))


#: Pairs that one task takes to the end.
MATCHED_AT_ONCE = 1_000_000


def greedy_matching(edges: DataFrame, max_rounds: int | None = None, scattered: bool = False, at_once: int = 0) -> DataFrame:
    """Best-first disjoint pairs of (a, b, score): pairs that are the best of both ends are taken, their ends
    leave, and so on until none is left; the same as going through all pairs from the best down.
    A row with a null end or equal ends is no pair.  Ties go by (a, b), so that n tied units take up to n / 2
    rounds; with ``scattered`` by a hash of (a, b) before, which takes few.  Once ``at_once`` pairs or fewer are
    left, one task takes these from the best down, with the same result.  Raises if ``max_rounds`` is given and
    doesn't suffice."""
    tie = F.xxhash64("a", "b") if scattered else F.lit(0).cast("long")
    live = cut_lineage(edges.select("a", "b", "score", tie.alias("_t")).filter("a <> b"), "matching")
    out, left = [], None

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        taken: set = set()
        for pdf in batches:  # sorted, the best first
            keep = []
            for n, (x, y) in enumerate(zip(pdf["a"].tolist(), pdf["b"].tolist())):
                if x not in taken and y not in taken:
                    taken.update((x, y))
                    keep.append(n)
            yield pdf.iloc[keep]

    for _ in _rounds(max_rounds):
        left = _fewer(live, left, "no pair is the best of both ends")
        if not left:
            break
        if left <= at_once:
            ordered = live.orderBy(F.desc("score"), "_t", "a", "b").coalesce(1).select("a", "b", "score")
            out.append(cut_lineage(ordered.mapInPandas(rest, ordered.schema), "matching"))
            break
        ends = live.select(F.col("a").alias("v"), "a", "b", "score", "_t").unionByName(live.select(F.col("b").alias("v"), "a", "b", "score", "_t"))
        best = ends.groupBy("v").agg(F.min(F.struct((-F.col("score")).alias("s"), "_t", "a", "b")).alias("p")).select("v", "p.a", "p.b")
        both = best.groupBy("a", "b").agg(F.count("*").alias("_n")).filter("_n = 2").select("a", "b")
        won = cut_lineage(both.join(live, ["a", "b"]).select("a", "b", "score"), "matching")
        out = _gather(out, won, "matching")
        gone = won.select(F.col("a").alias("v")).union(won.select("b"))
        live = live.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti")
        live = cut_lineage(live.select("a", "b", "score", "_t"), "matching")
    return reduce(DataFrame.unionByName, out) if out else edges.select("a", "b", "score").limit(0)


def unit_sets(units: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, token): the distinct entities of units (id, member), told apart by 64-bit hashes."""
    return units.select("id", "member").join(mentions.select(F.col("claim_id").alias("member"), F.xxhash64("entity_id").alias("token")), "member").select("id", "token").distinct()


def cross_links(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, corr, contra): the links between members of different units (id, member), a < b."""
    m = units.select("id", "member")
    x = edges.select("src", "dst", "rel").join(m.select(F.col("member").alias("src"), F.col("id").alias("_a")), "src").join(m.select(F.col("member").alias("dst"), F.col("id").alias("_b")), "dst").filter("_a <> _b")
    n = lambda r: F.count(F.when(F.col("rel") == r, 1))
    return x.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(n("CORROBORATES").alias("corr"), n("CONTRADICTS").alias("contra"))


def _linked(cross: DataFrame, sets: DataFrame, alike: DataFrame) -> DataFrame:
    """(a, b, corr, contra, shared): linked pairs with all that they share, and the pairs (a, b, shared) of ``alike``."""
    own = sets.groupBy("id").agg(F.collect_list("token").alias("_e"))
    side = lambda c: own.select(F.col("id").alias(c), F.col("_e").alias(f"_{c}"))
    shared = F.coalesce(F.size(F.array_intersect("_a", "_b")), F.lit(0)).cast("long")
    linked = cross.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", "corr", "contra", shared.alias("shared"))
    none = F.lit(0).cast("long")
    rest = alike.join(cross.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", none.alias("corr"), none.alias("contra"), "shared")
    return linked.unionByName(rest)


def unit_links(units: DataFrame, edges: DataFrame, mentions: DataFrame, least_shared: int = 1) -> DataFrame:
    """(a, b, corr, contra, shared) of pairs of units (id, member) with links across, or with at least
    ``least_shared`` entities in common."""
    sets = cut_lineage(unit_sets(units, mentions), "units")
    return _linked(cross_links(units, edges), sets, overlaps(sets, sets, least_shared).filter("a < b"))


def _least_shared(least: float, weight: float) -> int:
    """How many shared entities alone give energy ``least``."""
    return max(1, math.ceil(least / weight - 1e-9))


# Energy weights (corroborations, contradictions, shared entities), thresholds by layer, layers.
CRITERIA = {
    "entropy": ((2.0, 0.0, 0.5), (0.5,), 8),
    "progressive": ((2.0, 1.0, 0.5), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0), 6),
    "metabolic": ((2.0, 1.5, 0.3), (0.5,), 8),
}


#: How much a merge may raise entropy over that of its halves.
ENTROPY_SLACK = 0.05


def layered_matching(units: DataFrame, edges: DataFrame, mentions: DataFrame, criterion: str = "progressive", layers: int | None = None, threshold: float | None = None) -> DataFrame:
    """#122. (id, member, unit): layers of greedy matching over the energy of pairs of units; merged units have
    the smaller id.  Ties go by a hash of the pair.  Stops when a layer merges nothing.

    ``entropy`` merges pairs of enough energy whose entropy together is at most that of both by claims and
    .05, those first that it falls most for; ``mentions`` then has ``page_id`` too.

    The links across units and the pairs with enough entities in common are kept from layer to layer: links of merged
    units add up, and only pairs of which a merge touched an end are counted anew.  Thresholds don't fall, so that a
    pair that isn't kept can't come back untouched.
    """
    (wc, wx, ws), steps, most = CRITERIA[criterion]
    by_entropy = criterion == "entropy"
    now = cut_lineage(units.select("id", "member", F.col("id").alias("unit")), "layers")
    as_units = units.select("id", "member")
    sets = cut_lineage(_counted_sets(as_units, mentions) if by_entropy else unit_sets(as_units, mentions), "layers")
    cross = cut_lineage(cross_links(as_units, edges), "layers")
    own = cut_lineage(_unit_sums(as_units, edges, mentions, sets), "layers") if by_entropy else None
    alike, touched = None, sets
    for layer in range(layers or most):
        least = threshold if threshold is not None else steps[min(layer, len(steps) - 1)]
        enough = 1 if by_entropy else _least_shared(least, ws)
        new = dots(touched, sets) if by_entropy else overlaps(touched, sets, enough)
        if alike is None:
            alike = new.filter("a < b")
        else:  # of two touched units each finds the other
            new = new.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *new.columns[2:]).distinct()
            alike = alike.filter(F.col("shared") >= enough).unionByName(new)
        alike = cut_lineage(alike, "layers")
        energy = wc * F.col("corr") + wx * F.col("contra") + ws * F.col("shared")
        if by_entropy:
            none = F.lit(0).cast("long")
            known = cross.join(alike, ["a", "b"], "full").select("a", "b", *[F.coalesce(c, none).alias(c) for c in ("corr", "contra", "shared", "dot")])
            scored = cut_lineage(_entropy_falls(known.filter(energy >= least), own), "layers")
        else:
            scored = _linked(cross, sets, alike).withColumn("score", energy).filter(F.col("score") >= least)
        won = greedy_matching(scored, scattered=True, at_once=MATCHED_AT_ONCE).select("a", "b")
        if won.isEmpty():
            break
        if by_entropy:
            own = cut_lineage(_merged_sums(own, won.join(scored, ["a", "b"])), "layers")
        to = won.select(F.col("b").alias("_from"), F.col("a").alias("_to"))
        moved = lambda df, c: df.join(to, F.col(c) == F.col("_from"), "left").withColumn(c, F.coalesce("_to", c)).drop("_from", "_to")
        now = cut_lineage(moved(now, "unit"), "layers")
        sets = moved(sets, "id")
        sets = cut_lineage(sets.groupBy("id", "token").agg(F.sum("n").alias("n")) if by_entropy else sets.distinct(), "layers")
        both = moved(moved(cross, "a"), "b").filter("a <> b")
        cross = both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("corr").alias("corr"), F.sum("contra").alias("contra"))
        cross = cut_lineage(cross, "layers")
        ends = won.select(F.col("a").alias("_v")).union(won.select("b"))
        for c in ("a", "b"):
            alike = alike.join(ends, F.col(c) == F.col("_v"), "left_anti")
        touched = sets.join(won.select(F.col("a").alias("id")), "id", "left_semi")
    return now


def _counted_sets(units: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, token, n): how often units (id, member) mention their entities."""
    said = units.join(mentions.select(F.col("claim_id").alias("member"), F.xxhash64("entity_id").alias("token")), "member")
    return said.groupBy("id", "token").agg(F.count("*").alias("n"))


def _unit_sums(units: DataFrame, edges: DataFrame, mentions: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, u): what a unit's entropy hangs on.  Its claims, inner links, mentions (t) and sum of squares of entities' mentions
    (q) add up where units merge; of its pages (p) five say as much as all."""
    sums = sets.groupBy("id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"))
    said = units.join(mentions.select(F.col("claim_id").alias("member"), "page_id"), "member").select("id", "page_id").distinct()
    pages = top_k(said.filter("page_id IS NOT NULL"), ["id"], [F.asc("page_id")], 5).groupBy("id").agg(F.collect_list("page_id").alias("p"))
    none = F.lit(0).cast("long")
    own = inner_links(units, edges).join(sums, "id", "left").join(pages, "id", "left")
    empty = F.array().cast(pages.schema["p"].dataType)
    return own.select("id", F.struct("claims", "corr", "contra", F.coalesce("t", none).alias("t"), F.coalesce("q", none).alias("q"), F.coalesce("p", empty).alias("p")).alias("u"))


def _sum_entropy(u: Column) -> Column:
    """Entropy of a unit with the sums ``u``."""
    return mean_entropy(u["claims"], u["corr"], u["contra"], F.coalesce(1 - u["q"] / F.when(u["t"] > 0, u["t"] * u["t"]), F.lit(0.0)), F.size(u["p"]))


def _together(a: Column, b: Column) -> Column:
    """The sums of two units as one; links across and the product of their mentions stand beside them."""
    add = lambda c, more=F.lit(0).cast("long"): (a[c] + b[c] + more).alias(c)
    return F.struct(
        add("claims"), add("corr", F.col("corr")), add("contra", F.col("contra")), add("t"), add("q", (2 * F.col("dot")).cast("long")),
        F.slice(F.array_sort(F.array_union(a["p"], b["p"])), 1, 5).alias("p"),
    )


def _entropy_falls(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """(a, b, corr, contra, dot, score): the pairs that may merge, with the fall of entropy."""
    j = pairs.join(own.select(F.col("id").alias("a"), F.col("u").alias("_a")), "a").join(own.select(F.col("id").alias("b"), F.col("u").alias("_b")), "b")
    j = j.withColumn("_ab", _together(F.col("_a"), F.col("_b")))
    before = (_sum_entropy(F.col("_a")) * F.col("_a.claims") + _sum_entropy(F.col("_b")) * F.col("_b.claims")) / F.col("_ab.claims")
    fall = F.round(before - _sum_entropy(F.col("_ab")), 9)
    return j.select("a", "b", "corr", "contra", "dot", fall.alias("score")).filter(F.col("score") >= -ENTROPY_SLACK)


def _merged_sums(own: DataFrame, won: DataFrame) -> DataFrame:
    """``own`` after the pairs of ``won`` (a, b, corr, contra, dot) have merged."""
    side = lambda c: own.select(F.col("id").alias(c), F.col("u").alias(f"_{c}"))
    new = won.join(side("a"), "a").join(side("b"), "b").select(F.col("a").alias("id"), _together(F.col("_a"), F.col("_b")).alias("u"))
    gone = won.select(F.col("a").alias("id")).union(won.select("b"))
    return own.join(gone, "id", "left_anti").unionByName(new)


def inner_links(units: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, claims, corr, contra): the claims of units (id, member) and the links among them."""
    m = units.select("id", "member").distinct()
    x = edges.select("src", "dst", "rel").join(m.select(F.col("member").alias("src"), "id"), "src").join(m.select(F.col("member").alias("dst"), "id"), ["dst", "id"])
    n = lambda r: F.count(F.when(F.col("rel") == r, 1))
    inner = x.groupBy("id").agg(n("CORROBORATES").alias("corr"), n("CONTRADICTS").alias("contra"))
    none = F.lit(0).cast("long")
    return m.groupBy("id").agg(F.count("*").alias("claims")).join(inner, "id", "left").select("id", "claims", *[F.coalesce(c, none).alias(c) for c in ("corr", "contra")])


def unit_mass(units: DataFrame, edges: DataFrame) -> DataFrame:
    """#222. (id, claims, corr, contra, mass) of units (id, member): a tenth a claim, times 1 + coherence (inner
    corroborations over pairs of claims) + .05 a contradiction, .5 at most."""
    n = F.col("claims")
    coherence = F.col("corr") / F.greatest(n * (n - 1) / 2, F.lit(1.0))
    mass = 0.1 * n * (1 + coherence + F.least(F.lit(0.5), 0.05 * F.col("contra")))
    return inner_links(units, edges).withColumn("mass", F.round(mass, 6))


def layered_components(units: DataFrame, edges: DataFrame, mentions: DataFrame, least: tuple[float, ...] = (1.0, 2.0, 3.0, 4.0, 5.0)) -> DataFrame:
    """#222. (id, member, unit): components of units by energy, then those of what they became at the next
    threshold of ``least``, until a layer merges nothing."""
    now = cut_lineage(units.select("id", "member", F.col("id").alias("unit")), "layers")
    for e in least:
        to = energy_components(now.select(F.col("unit").alias("id"), "member"), edges, mentions, e).filter("id <> unit")
        to = cut_lineage(to.select(F.col("id").alias("unit"), F.col("unit").alias("_to")), "layers")
        if to.isEmpty():
            break
        now = cut_lineage(now.join(to, "unit", "left").select("id", "member", F.coalesce("_to", "unit").alias("unit")), "layers")
    return now


def alike_claims(pairs: DataFrame, mentions: DataFrame, near: float = 0.75, sharing: float = 0.60) -> DataFrame:
    """#217. The pairs (a, b, cosine) of cosine ``near``, or of ``sharing`` with an entity in common, for
    ``seed_clusters``.  Entities are looked up for the pairs in between alone."""
    between = pairs.filter((F.col("cosine") >= sharing) & (F.col("cosine") < near)).select("a", "b")
    e = mentions.select("claim_id", "entity_id").distinct()
    met = between.join(e.withColumnRenamed("claim_id", "a"), "a").join(e.withColumnRenamed("claim_id", "b"), ["b", "entity_id"])
    return pairs.filter(F.col("cosine") >= near).select("a", "b").unionByName(met.select("a", "b")).distinct()


def _specific_entities(mentions: DataFrame, events: DataFrame) -> DataFrame:
    """(id, entity_id, _s): the entities of ``events`` with their specificity, 1 - claims over the most of any entity."""
    f = mentions.groupBy("entity_id").agg(F.countDistinct("claim_id").alias("_f"))
    f = f.join(F.broadcast(f.agg(F.max("_f").alias("_m")))).select("entity_id", (1 - F.col("_f") / F.col("_m")).alias("_s"))
    return mentions.select(F.col("event_id").alias("id"), "entity_id").distinct().join(events.select("id"), "id", "left_semi").join(f, "entity_id")


def event_merges(events: DataFrame, mentions: DataFrame, least: float = 0.55, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), min_claims: int = 2) -> DataFrame:
    """#120. (a, b, score): pairs of events (id, claims, vector) of ``min_claims`` that should merge, by cosine, Jaccard
    of their entities and the mean specificity (1 - mentions over the most of any entity) of shared ones.
    ``mentions`` (event_id, claim_id, entity_id).  Pairs that share an entity meet; those that share none would need the cosine
    alone to reach ``least``, and are to be added from a vector join.  ``connected_components`` of the pairs are the
    merged events.
    """
    big = events.filter(F.col("claims") >= min_claims).select("id", "vector")
    e = cut_lineage(_with_sizes(_specific_entities(mentions, big)), "merges")
    unit = cut_lineage(big.select("id", V.unit(F.col("vector")).alias("vector")), "merges")
    return affine_pairs(e, e, (unit, unit), least, weights, stored=True)


def _with_sizes(sets: DataFrame) -> DataFrame:
    """(id, token, n, w) of (id, entity_id, _s): n is the number of an id's entities."""
    n = sets.groupBy("id").agg(F.count("*").alias("n"))
    return sets.join(n, "id").select("id", F.col("entity_id").alias("token"), "n", F.col("_s").alias("w"))


def _affinities(left: DataFrame, left_sets: DataFrame, right: DataFrame, right_sets: DataFrame, least: float, weights: tuple[float, float, float], size: int | None, apart: bool) -> DataFrame:
    """(a, b) of affinity ``least``, a < b, between events (id, vector) of two sides with their sets (``_with_sizes``), those of
    the right side a stored table: those that share an entity, with ``apart`` all that share none, and with ``size`` those of
    them whose vectors lie in one block."""
    wc = weights[0]
    unit = lambda e: e.select("id", V.unit(F.col("vector")).alias("vector"))
    found = cut_lineage(affine_pairs(left_sets, right_sets, (unit(left), unit(right)), least, weights, stored=True).select("a", "b"), "merges")
    if not (apart or size) or wc < least:
        return found
    if apart:
        near = near_later(left, right, least / wc).filter(F.round(wc * F.col("cosine"), 6) >= least).select("a", "b")
    else:
        near = vector_pairs(right, "id", "vector", least / wc - 1e-6, size, queries=left).select("a", "b")
    # what shares an entity, too, is in ``found``, since its other terms only add to the cosine's
    return found.union(near.join(found, ["a", "b"], "left_anti"))


def merged_events(events: DataFrame, mentions: DataFrame, least: float = 0.55, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), min_claims: int = 2, size: int | None = None, apart: bool = False) -> DataFrame:
    """#120. (id, event): events (id, claims, vector) merged by affinity, as in ``event_merges``.  One after the other by id,
    an event that none has taken goes through the later ones and takes those of enough affinity to what it is by then: with
    the entities of all that it took, and their mean vector by claims.  A merged event has the first one's id.

    Rounds give the result of that scan: the pairs merge that come first, by (a, b), among the pairs of both their
    ends.  Where an event grows towards one that a later event has taken, or that has taken others, what
    events after it have done is undone and done again.  What an event reaches is made anew only when it has grown.
    With ``apart`` pairs that share no entity meet as well, all of them: an event's vector meets every later one, as products of
    matrices.  With ``size`` (of the vectors) alone they meet by hyperplanes, with a recall of .95 at the threshold.
    Null ids are none, of repeated ids one counts; without a vector, or with vectors of two sizes, the cosine is 0 and the
    first one's vector stays.
    """
    known = events.filter("id IS NOT NULL").dropDuplicates(["id"])
    big = known.filter(F.col("claims") >= min_claims).select("id", F.col("claims").cast("double").alias("claims"), F.col("vector").cast("array<double>").alias("vector"))
    base = cut_lineage(big.withColumn("last", F.lit(None).cast(events.schema["id"].dataType)), "merges")
    base_sets = cut_lineage(_with_sizes(_specific_entities(mentions, base)), "merges")
    reach = cut_lineage(_affinities(base, base_sets, base, base_sets, least, weights, size, apart), "merges")
    # events that took others, their entities, what they reach by now, and who took whom
    grown, sets, wide, held = base.limit(0), base_sets.limit(0), reach.limit(0), reach.select(F.col("b").alias("id"), F.col("a").alias("by")).limit(0)
    while True:
        now = reach.join(grown.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b").union(wide)
        now = now.join(held.select(F.col("id").alias("a")), "a", "left_anti").join(held.withColumnRenamed("id", "b"), "b", "left")
        now = now.join(grown.select(F.col("id").alias("b"), F.lit(True).alias("_took")), "b", "left").filter("by IS NULL OR by > a")
        live = cut_lineage(now.select("a", "b", (F.col("by").isNotNull() | F.col("_took").isNotNull()).alias("late")), "merges")
        if live.isEmpty():
            break
        pair = F.struct("a", "b", "late")
        first = live.select(F.col("a").alias("v"), pair.alias("_p")).union(live.select(F.col("b").alias("v"), pair.alias("_p"))).groupBy("v").agg(F.min("_p").alias("_p"))
        won = cut_lineage(first.groupBy("_p").agg(F.count("*").alias("_n")).filter("_n = 2").select("_p.*"), "merges")
        late = won.filter("late").agg(F.min("a")).head()[0]
        if late is not None:
            grown, sets = grown.filter(F.col("id") <= F.lit(late)), sets.filter(F.col("id") <= F.lit(late))
            wide, won, held = wide.filter(F.col("a") <= F.lit(late)), won.filter(F.col("a") <= F.lit(late)), held.filter(F.col("by") <= F.lit(late))
        leaders = won.select(F.col("a").alias("id"))
        before = grown.join(leaders, "id", "left_semi").unionByName(base.join(leaders, "id", "left_semi").join(grown, "id", "left_anti"))
        side = lambda df, c: df.select(F.col("id").alias(c), F.col("claims").alias(f"_c{c}"), F.col("vector").alias(f"_v{c}"))
        claims = F.col("_ca") + F.col("_cb")
        mean = F.zip_with("_va", "_vb", lambda x, y: (x * F.col("_ca") + y * F.col("_cb")) / claims)
        both = won.join(side(before, "a"), "a").join(side(base, "b"), "b")
        new = both.select(F.col("a").alias("id"), claims.alias("claims"), F.when(F.size("_va") == F.size("_vb"), mean).otherwise(F.col("_va")).alias("vector"), F.col("b").alias("last"))
        new = cut_lineage(new, "merges")
        brought = base_sets.withColumnRenamed("id", "b").join(won.select("a", "b"), "b").select(F.col("a").alias("id"), "token", "w")
        own = sets.unionByName(base_sets).join(leaders, "id", "left_semi").select("id", "token", "w")
        all_sets = own.unionByName(brought).distinct().select("id", F.col("token").alias("entity_id"), F.col("w").alias("_s"))
        new_sets = cut_lineage(_with_sizes(all_sets), "merges")
        more = _affinities(new, new_sets, base, base_sets, least, weights, size, apart).join(new.select(F.col("id").alias("a"), "last"), "a").filter(F.col("b") > F.col("last"))
        wide = cut_lineage(wide.join(leaders.withColumnRenamed("id", "a"), "a", "left_anti").select("a", "b").union(more.select("a", "b")), "merges")
        grown = cut_lineage(grown.join(leaders, "id", "left_anti").unionByName(new), "merges")
        sets = cut_lineage(sets.join(leaders, "id", "left_anti").unionByName(new_sets), "merges")
        held = cut_lineage(held.union(won.select(F.col("b").alias("id"), F.col("a").alias("by"))), "merges")
    return known.select("id").join(held, "id", "left").select("id", F.coalesce("by", "id").alias("event"))


def energy_components(units: DataFrame, edges: DataFrame, mentions: DataFrame, least: float = 2.0) -> DataFrame:
    """#222. (id, unit): components of units over pairs with energy 2 corr + contra + .5 shared of ``least``."""
    links = unit_links(units, edges, mentions, _least_shared(least, 0.5)).filter(2 * F.col("corr") + F.col("contra") + 0.5 * F.col("shared") >= least)
    comp = connected_components(links.select("a", "b"), "a", "b")
    return units.select("id").distinct().join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("unit"))


def best_pair_agglomeration(units: DataFrame, edges: DataFrame, mentions: DataFrame, merges: int = 20, weights: tuple[float, float, float] = (2.0, 1.0, 0.3), least: float = 1.0) -> DataFrame:
    """#223, #224. (id, unit): one merge a round, of the pair with most energy, up to ``merges`` (a budget)."""
    return _agglomerated(units, edges, mentions, merges, weights, least)[0]


def unit_coherence(units: DataFrame, edges: DataFrame) -> DataFrame:
    """#223. (id, claims, corr, contra, coherence) of units (id, member): corroborations over all inner links, 1 without links."""
    links = F.col("corr") + F.col("contra")
    return inner_links(units, edges).withColumn("coherence", F.round(F.coalesce(F.col("corr") / F.when(links > 0, links), F.lit(1.0)), 6))


def coherent_units(units: DataFrame, edges: DataFrame, mentions: DataFrame, merges: int = 20, weights: tuple[float, float, float] = (2.0, 1.0, 0.3), least: float = 1.0) -> DataFrame:
    """#223. (id, claims, corr, contra, coherence) of the units that ``best_pair_agglomeration`` leaves of units (id, member)."""
    to = best_pair_agglomeration(units, edges, mentions, merges, weights, least)
    return unit_coherence(units.join(to, "id").select(F.col("unit").alias("id"), "member"), edges)


def layered_masses(units: DataFrame, edges: DataFrame, mentions: DataFrame, budget: int = 10, weights: tuple[float, float, float] = (1.0, 0.5, 0.3), least: float = 1.0) -> DataFrame:
    """#224. (id, layer, claims, corr, contra, mass) of the units that ``budget`` merges, at one each, leave of units (id, member).

    A unit starts with a tenth a claim, at layer 0.  A merged unit's layer is one above the higher of its two, its mass the
    sum of theirs, times 1, its inner corroborations (1 at most) and a tenth of its inner contradictions (.5 at most).  A null id
    is no unit.
    """
    to, steps = _agglomerated(units, edges, mentions, budget, weights, least)
    spark, known = units.sparkSession, units.filter("id IS NOT NULL")
    kind = units.schema["id"].dataType.simpleString()
    # the budget bounds the steps: what they touch is small next to the units, so that their sums fit in the driver
    parts = spark.createDataFrame([(x,) for x in dict.fromkeys(x for pair in steps for x in pair)], f"id {kind}")
    few = known.join(F.broadcast(parts), "id", "left_semi").select("id", "member").distinct()
    own = {r.id: (r.claims, r.corr, r.contra) for r in inner_links(few, edges).collect()}
    across = {(r.a, r.b): (r.corr, r.contra) for r in cross_links(few, edges).collect()}
    made = {x: (0, 0.1 * n, {x}, corr, contra) for x, (n, corr, contra) in own.items()}
    for a, b in steps:
        (la, ma, xs, ca, da), (lb, mb, ys, cb, db) = made[a], made.pop(b)
        met = [across.get((min(x, y), max(x, y)), (0, 0)) for x in xs for y in ys]
        corr, contra = ca + cb + sum(m[0] for m in met), da + db + sum(m[1] for m in met)
        made[a] = (max(la, lb) + 1, (ma + mb) * (1 + min(1.0, corr) + min(0.5, 0.1 * contra)), xs | ys, corr, contra)
    masses = spark.createDataFrame([(x, m[0], float(m[1])) for x, m in made.items()], f"id {kind}, layer int, _mass double")
    sums = inner_links(known.join(to, "id").select(F.col("unit").alias("id"), "member"), edges)
    j = sums.join(F.broadcast(masses), "id", "left")
    return j.select("id", F.coalesce("layer", F.lit(0)).alias("layer"), "claims", "corr", "contra", F.round(F.coalesce("_mass", 0.1 * F.col("claims")), 6).alias("mass"))


def _agglomerated(units: DataFrame, edges: DataFrame, mentions: DataFrame, merges: int, weights: tuple[float, float, float], least: float) -> tuple[DataFrame, list[tuple]]:
    """(id, unit), and the merges (a, b) in their order."""
    wc, wx, ws = weights
    # pairs under ``least`` stay so until one of them merges, and then all pairs of the merged one are made anew
    links = cut_lineage(unit_links(units, edges, mentions, _least_shared(least, ws)), "pairs")
    ents = cut_lineage(units.join(mentions.select(F.col("claim_id").alias("member"), "entity_id"), "member").select("id", "entity_id").distinct(), "pairs")
    to: dict = {}
    steps: list[tuple] = []
    for _ in range(merges):
        e = links.withColumn("e", wc * F.col("corr") + wx * F.col("contra") + ws * F.col("shared")).filter(F.col("e") >= least)
        top = e.orderBy(F.desc("e"), "a", "b").select("a", "b").head()
        if top is None:
            break
        a, b = top
        to[b] = a
        steps.append((a, b))
        into = lambda c: F.when(F.col(c) == F.lit(b), F.lit(a)).otherwise(F.col(c))
        touched = F.col("a").isin(a, b) | F.col("b").isin(a, b)
        ents = cut_lineage(ents.select(into("id").alias("id"), "entity_id").distinct(), "pairs")
        moved = links.filter(touched).select(into("a").alias("x"), into("b").alias("y"), "corr", "contra").filter("x <> y")
        moved = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("corr").alias("corr"), F.sum("contra").alias("contra"))
        own = ents.filter(F.col("id") == F.lit(a)).select("entity_id")
        shared = ents.filter(F.col("id") != F.lit(a)).join(own, "entity_id", "left_semi").groupBy("id").agg(F.count("*").alias("shared"))
        shared = shared.select(F.least(F.col("id"), F.lit(a)).alias("a"), F.greatest(F.col("id"), F.lit(a)).alias("b"), "shared")
        new = moved.join(shared, ["a", "b"], "full").select("a", "b", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("corr", "contra", "shared")])
        links = cut_lineage(links.filter(~touched).unionByName(new), "pairs")
    spark = units.sparkSession

    def end(x):
        while x in to:
            x = to[x]
        return x

    kind = units.schema["id"].dataType.simpleString()
    names = spark.createDataFrame([(b, end(b)) for b in to], f"id {kind}, _to {kind}")
    return units.select("id").distinct().join(F.broadcast(names), "id", "left").select("id", F.coalesce("_to", "id").alias("unit")), steps


def seed_clusters(pairs: DataFrame, weights: DataFrame, size: int = 2, max_rounds: int | None = None) -> DataFrame:
    """#217. (id, seed): greedy seeds by weight (most entities first, then id) take their unassigned
    neighbours among ``pairs`` (a, b), until no id is free; clusters of under ``size`` are dropped.  Null ids
    are none.  Raises if ``max_rounds`` is given and doesn't suffice."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    rank = lambda c: F.struct(-F.col("weight"), F.col(c))
    free = cut_lineage(weights.select("id", "weight").filter("id IS NOT NULL"), "seeds")
    e = cut_lineage(both, "seeds")
    out, left = [], None
    for _ in _rounds(max_rounds):
        left = _fewer(free, left, "no id is a seed")
        if not left:
            break
        w = free.select(F.col("id").alias("b"), F.col("weight").alias("_wb"))
        near = e.join(free.withColumnRenamed("id", "a"), "a").join(w, "b")
        better = near.filter(F.struct(-F.col("_wb"), F.col("b")) < rank("a")).select(F.col("a").alias("id")).distinct()
        seeds = free.join(better, "id", "left_anti").select("id")
        taken = near.join(seeds.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        got = cut_lineage(seeds.withColumn("_seed", F.lit(True)).unionByName(taken.join(seeds, "id", "left_anti").withColumn("_seed", F.lit(False))), "seeds")
        out = _gather(out, got.filter("_seed").select("id"), "seeds")
        free = cut_lineage(free.join(got.select("id"), "id", "left_anti"), "seeds")
    if not out:
        return weights.select("id", F.col("id").alias("seed")).limit(0)
    # who takes an id is known when all seeds are: a better one may come out in a later round
    seeds = reduce(DataFrame.unionByName, out)
    known = weights.select("id", "weight").filter("id IS NOT NULL")
    others = known.select(F.col("id").alias("b")).join(seeds.withColumnRenamed("id", "b"), "b", "left_anti")
    met = e.join(known.join(seeds, "id", "left_semi").withColumnRenamed("id", "a"), "a").join(others, "b")
    taken = met.groupBy("b").agg(F.min(rank("a")).alias("_s")).select(F.col("b").alias("id"), F.col("_s.a").alias("seed"))
    return _of_size(seeds.select("id", F.col("id").alias("seed")).unionByName(taken), size)


def _of_size(clusters: DataFrame, size: int) -> DataFrame:
    keep = clusters.groupBy("seed").agg(F.count("*").alias("_n")).filter(F.col("_n") >= size).select("seed")
    return clusters.join(keep, "seed", "left_semi").select("id", "seed")


#: Rows of a group that one task goes through in a round.
HEAD_ROWS = 512


def vector_seed_clusters(df: DataFrame, key: str, vector: str, group: str, weight: str, least: float, size: int = 2, head_rows: int = HEAD_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """#217. (id, seed): the ``seed_clusters`` of the pairs of a group with cosine over ``least``, without making these.  Keys are
    unique, null ones are none.

    A round goes through the first ``head_rows`` free rows of each group in order, which gives all seeds among them; a later row goes to
    the first of these that it is near.  Rows meet seeds alone, so that work is the number of rows times that of seeds.
    """
    rows = df.select(F.col(key).alias("id"), F.col(group).alias("g"), F.col(weight).alias("weight"), V.unit(F.col(vector)).alias("v")).filter("id IS NOT NULL")
    kind, group_kind, weight_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "g", "weight"))
    free, alone = cut_lineage(rows.filter("g IS NOT NULL AND v IS NOT NULL"), "seeds"), rows.filter("g IS NULL OR v IS NULL")
    out, left = [alone.select("id", F.col("id").alias("seed"))], None

    def near(x: pa.Table, y: pa.Table) -> np.ndarray:
        width = max(pc.max(pc.list_value_length(z.column("v"))).as_py() for z in (x, y))
        (a, n), (b, m) = (padded(z.column("v"), width) for z in (x, y))
        return ~(np.round(a @ b.T, 6) <= least) & (n[:, None] == m)

    def scan(head: pa.Table) -> pa.Table:
        head = head.sort_by("rank")
        met, seed = near(head, head), np.full(head.num_rows, -1)
        for i in range(head.num_rows):
            if seed[i] < 0:
                seed[met[i] & (seed < 0)] = i
                seed[i] = i
        return head.append_column("seed", head.column("id").take(pa.array(seed))).select(["g", "id", "seed", "rank", "v"])

    def take(rest: pa.Table, seeds: pa.Table) -> pa.Table:
        if not rest.num_rows:
            return pa.table({c: rest.column(c) for c in ("g", "id", "weight", "v")} | {"seed": seeds.column("seed").slice(0, 0)})
        seeds = seeds.sort_by("rank")
        met = near(rest, seeds)
        first = pa.array(met.argmax(1), mask=~met.any(1))
        return pa.table({c: rest.column(c) for c in ("g", "id", "weight", "v")} | {"seed": seeds.column("seed").take(first)})

    for _ in _rounds(None):
        left = _fewer(free, left, "no id is a seed")
        if not left:
            break
        head = top_k(free, ["g"], [(-F.col("weight")).asc_nulls_first(), F.asc("id")], head_rows).select("g", "id", "v", "rank")
        head = cut_lineage(head.groupBy("g").applyInArrow(lambda x: scan(x), f"g {group_kind}, id {kind}, seed {kind}, rank int, v array<double>"), "seeds")
        rest = free.join(head.select("id"), "id", "left_anti")
        pieces = rest.groupBy("g").agg(F.ceil(F.count("*") / piece_rows).cast("long").alias("_n"))
        seeds = head.filter("id = seed").join(pieces, "g").select("g", "seed", "rank", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_p"))
        dealt = rest.join(pieces, "g").select("g", "id", "weight", "v", F.pmod(F.xxhash64("id"), "_n").alias("_p"))
        met = dealt.groupBy("g", "_p").cogroup(seeds.groupBy("g", "_p")).applyInArrow(lambda x, y: take(x, y), f"g {group_kind}, id {kind}, weight {weight_kind}, v array<double>, seed {kind}")
        met = cut_lineage(met, "seeds")
        out = _gather(out, head.select("id", "seed").unionByName(met.filter("seed IS NOT NULL").select("id", "seed")), "seeds")
        free = met.filter("seed IS NULL").drop("seed")
    return _of_size(reduce(DataFrame.unionByName, out), size)


def parent_units(units: DataFrame, key: str) -> DataFrame:
    """#125. (key, centroid): mass-weighted mean vector of the units (mass, vector) of each parent."""
    return V.mean_vectors(units, key, "vector", "mass")


def sub_event_gate(groups: DataFrame, siblings: DataFrame, least: int = 3, similar: float = 0.70) -> DataFrame:
    """#124. For groups (id, size, vector) of at least ``least`` claims: merge into the most similar sibling
    (id, vector) of their event if its cosine is ``similar``, else new.  Both have ``event_id``."""
    g = groups.filter(F.col("size") >= least)
    s = siblings.select("event_id", F.col("id").alias("sibling"), F.col("vector").alias("_sv"))
    j = g.join(s, "event_id", "left").withColumn("cosine", F.round(V.cosine(F.col("vector"), F.col("_sv")), 6))
    best = top_k(j, ["id"], [F.desc_nulls_last("cosine"), F.asc("sibling")], 1)
    ok = F.coalesce(F.col("cosine") >= similar, F.lit(False))
    return best.select("id", F.when(ok, F.col("sibling")).alias("sibling"), F.when(ok, "merge").otherwise("create").alias("action"))


def independent_frames(mentions: DataFrame, least: float = 0.5) -> DataFrame:
    """#128. Entities in two or more events with 1 - Jaccard of the event's entity sets: least and mean over
    all pairs, and whether the mean is over ``least``.  Pairs are judged in cells, and sums by entity alone leave."""
    e = mentions.select(F.col("event_id").alias("id"), F.col("entity_id").alias("token")).distinct()
    e = e.join(e.groupBy("id").agg(F.count("*").alias("n")), "id")

    def judge(cell: Cell) -> dict:
        n, later, of = len(cell.names), cell.later(), cell.known["n"]
        apart, sums = np.empty(n), {}
        for i, _, tokens, at, (own,) in cell.rows():
            met = cell.after(at, later[i])
            ids, k = counted(met, [], n)
            apart[ids] = 1 - k / (own[0] + of[ids] - k)
            for t, ids in zip(tokens, met):
                if len(ids):
                    low, total, pairs = sums.get(t, (np.inf, 0.0, 0))
                    sums[t] = min(low, apart[ids].min()), total + apart[ids].sum(), pairs + len(ids)
        return dict(zip(("entity_id", "low", "total", "pairs"), map(pa.array, zip(*((t, *v) for t, v in sums.items()))))) if sums else {}

    met, _ = in_cells(e, e, judge, f"entity_id {mentions.schema['entity_id'].dataType.simpleString()}, low double, total double, pairs bigint")
    g = met.groupBy("entity_id").agg(F.round(F.min("low"), 6).alias("least"), F.round(F.sum("total") / F.sum("pairs"), 6).alias("mean"))
    return g.withColumn("frame", F.col("mean") > least)
