"""Column functions and operators on literal rows: worked examples and edge cases."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.functions import vectors as V
from claimloom.operators import aggregates as A
from claimloom.operators import clustering as C
from claimloom.operators import entities as N
from claimloom.operators import graph as G
from claimloom.operators import planes as P
from claimloom.operators import relational as R
from claimloom.operators import scoring as S
from claimloom.plans import clusters as plans_clusters
from claimloom.plans import registry
from claimloom.sources import tables as IO


def value(spark, column, **names):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in names.items()] or [F.lit(1)])
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://www.Example.com/a/?utm_source=x#top", "https://example.com/a/"),
        ("https://example.com/a/", "https://example.com/a"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com/case/?id=2&b=1&fbclid=9&b=7", "https://example.com/case/?b=1&id=2"),
        ("HTTP://x.org", "http://x.org"),
    ],
)
def test_canonical_url(spark, url, want):
    assert value(spark, T.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(
    "text, topic, number",
    [
        ("5 people died in the fire", "casualty_count", 5), ("Death toll rises to 128", "casualty_count", 128), ("10 missing after flood", "missing_count", 10),
        ("alarm raised to Level 3", "alarm_level", 3), ("40 residents rescued", "evacuated_count", 40), ("12 people wounded", "injured_count", 12), ("nothing", None, None),
    ],
)
def test_topics(spark, text, topic, number):
    assert value(spark, T.topic_of(F.col("t")), t=text) == topic
    assert value(spark, T.topic_value(F.col("t"), T.topic_of(F.col("t"))), t=text) == number


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("At least 36 people were killed in Hong Kong fire", "36 people died in the Hong Kong blaze", "CORROBORATES"),
        ("At least 36 people were killed in the fire", "Death toll rises to 128 in Hong Kong fire", "UPDATES"),
        ("Police confirm 12 dead in incident", "Officials report only 8 casualties", "INDEPENDENT"),
        ("Fire broke out at Wang Fuk Court", "Blaze engulfed Wang Fuk Court apartments", "CORROBORATES"),
        ("Fire at Wang Fuk Court", "Fire in Tai Po", "CONTRADICTS"),
    ],
)
def test_structural_relations(spark, a, b, want):
    assert value(spark, T.relate_by_structure(F.col("a"), F.col("b")), a=a, b=b) == want


def test_html_fields(spark):
    html = '<head><meta property="og:site_name" content="The Paper"><meta property="article:published_time" content="2024-05-01T10:00:00Z"></head>'
    ld = '<script type="application/ld+json">{"datePublished": "2023-02-03T04:05:06Z", "publisher": {"name": "Daily"}}</script>'
    assert str(value(spark, T.published(F.col("h")), h=html)).startswith("2024-05-01 10:00")
    assert str(value(spark, T.published(F.col("h")), h=ld)).startswith("2023-02-03 04:05")
    assert value(spark, T.site_name(F.col("h")), h=html) == "The Paper"
    assert value(spark, T.site_name(F.col("h")), h=ld) == "Daily"
    assert value(spark, T.published(F.col("h")), h="<p>") is None


def test_roles_citations_and_markers(spark):
    role = lambda t: value(spark, T.role(F.col("t"), F.lit(0), F.lit(0)), t=t)
    assert [role(t) for t in ("He denied it", "Police confirmed it", "A judge ruled", "She said so", "It rained")] == ["denial", "confirmation", "institutional", "assertion", "occurrence"]
    assert value(spark, T.citations(F.col("t")), t="according to the BBC, Reuters said nothing") == ["BBC", "Reuters"]
    assert value(spark, T.cited_claims(F.col("t")), t="a [cl_abc1] b [cl_abc1] [cl_z9]") == ["cl_abc1", "cl_z9"]
    assert value(spark, T.lexical_relation(F.col("a"), F.col("b"), F.lit(0.5)), a="it is not so", b="it is so") == "CONTRADICTS"


def test_premises(spark):
    failed = T.premise_checks(F.lit("Man allegedly killed"), F.array(F.lit("person: A")), F.lit(None).cast("string"), F.lit("opinion"), F.array().cast("array<string>"))
    assert value(spark, failed) == ["temporal", "evidence", "hedging", "controversy"]
    assert value(spark, T.premise_score(F.lit(0.9), failed)) == pytest.approx(0.25)


def test_sources_and_ids(spark):
    kind = lambda d: value(spark, T.source_type(F.col("d"), F.lit(None).cast("string")), d=d)
    assert [kind(d) for d in ("reuters.com", "data.gov.uk", "msn.com", "dailynews.net", "x.org", "")] == ["wire", "official", "aggregator", "newspaper", "unknown", "unknown"]
    assert value(spark, S.class_type(F.array(F.lit("Q1"), F.lit("Q41298"), F.lit("Q11032")))) == "magazine"
    assert value(spark, T.is_uuid(F.lit("123e4567-e89b-12d3-a456-426614174000"))) is True
    assert value(spark, T.is_short_id(T.short_id("ev", F.lit("123e4567-e89b-12d3-a456-426614174000")))) is True
    assert value(spark, T.time_precision(F.lit("last month"), F.lit("2024"))) == "month"


def test_event_reference(spark):
    f = lambda t, shared=0, days=9.0: value(spark, S.references_event(F.col("t"), F.lit("Wang Fuk Court Fire"), F.lit(None).cast("string"), F.lit(shared), F.lit(days)), t=t)
    assert f("the Wang Fuk Court fire spread") and f("near wang fuk estate") and f("the blaze grew", shared=1) and f("the blaze grew", days=1.0)
    assert not f("the blaze grew") and not f("a court in wang")


def test_cosine_and_means(spark):
    assert value(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.70710678)
    assert value(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert value(spark, V.parse(F.lit("[1,2.5]"))) == [1.0, 2.5]


def components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in parent}


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r.id: r.component for r in G.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == components(edges)
    assert G.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_greedy_matching_is_that_of_a_sorted_scan(spark):
    rng = random.Random(6)
    edges = list({tuple(sorted(rng.sample(range(25), 2))) for _ in range(90)})
    edges = [(a, b, float(rng.randrange(4))) for a, b in edges]
    used, want = set(), set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if a not in used and b not in used:
            want.add((a, b))
            used |= {a, b}
    got = {(r.a, r.b) for r in C.greedy_matching(spark.createDataFrame(edges, "a long, b long, score double")).collect()}
    assert got == want


def test_exclusive_topics_are_those_of_a_sorted_scan(spark):
    rng = random.Random(8)
    rows = [(f"e{rng.randrange(8)}", c, c % 5, 0.0) for c in range(40) for _ in range(3)]
    score = {f"e{i}": float(i % 3) for i in range(8)}
    rows = sorted({(e, c, p, score[e]) for e, c, p, _ in rows})
    taken, want = set(), set()
    for e in sorted(score, key=lambda e: (-score[e], [-ord(x) for x in e])):
        free = {c for x, c, _, _ in rows if x == e} - taken
        if len(free) >= 3 and len({c % 5 for c in free}) >= 2:
            taken |= free
            want |= {(e, c) for c in free}
    got = {(r.anchor, r.claim_id) for r in C.exclusive_topics(spark.createDataFrame(rows, "anchor string, claim_id long, page_id long, score double"), 3, 2).collect()}
    assert got == want


def test_seed_clusters_are_those_of_a_sorted_scan(spark):
    rng = random.Random(9)
    pairs = list({tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)})
    weight = {i: rng.randrange(4) for i in range(30)}
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(30)}
    free, want = set(range(30)), {}
    for i in sorted(free, key=lambda i: (-weight[i], i)):
        if i in free:
            got = {i} | (near[i] & free)
            free -= got
            want |= {x: i for x in got if len(got) > 1}
    w = spark.createDataFrame(list(weight.items()), "id long, weight long")
    got = {r.id: r.seed for r in C.seed_clusters(spark.createDataFrame(pairs, "a long, b long"), w).collect()}
    assert got == want


def test_greedy_matching_goes_on_until_no_pair_is_left(spark):
    """A tied clique and a tied path of over 200 units give one pair a round."""
    clique = [(a, b, 1.0) for a in range(206) for b in range(a + 1, 206)]
    path = [(a, a + 1, 1.0) for a in range(1000, 1205)]
    odd = [(7, 7, 9.0), (None, 3, 9.0), (3, None, 9.0)]
    got = {(r.a, r.b) for r in C.greedy_matching(spark.createDataFrame(clique + path + odd, "a long, b long, score double").coalesce(1)).collect()}
    assert got == {(a, a + 1) for a in [*range(0, 206, 2), *range(1000, 1205, 2)]}


def test_greedy_loops_raise_where_a_bound_leaves_rows(spark):
    path = spark.createDataFrame([(a, a + 1, 1.0) for a in range(9)], "a long, b long, score double")
    with pytest.raises(RuntimeError, match="rows are left"):
        C.greedy_matching(path, max_rounds=2)
    chain = spark.createDataFrame([(a, c, c, float(-a)) for a in range(9) for c in (2 * a, 2 * a + 1, 2 * a + 2)], "anchor long, claim_id long, page_id long, score double")
    with pytest.raises(RuntimeError, match="rows are left"):
        C.exclusive_topics(chain, 2, 2, max_rounds=2)
    assert C.exclusive_topics(chain, 2, 2).select("anchor").distinct().count() == 9
    weights = spark.createDataFrame([(i, 1) for i in range(10)], "id long, weight long")
    with pytest.raises(RuntimeError, match="rows are left"):
        C.seed_clusters(path, weights, max_rounds=2)
    two = spark.createDataFrame([("x", 1, 1, 5.0), ("x", 2, 2, 1.0), ("y", 1, 1, 1.0), ("y", 2, 2, 5.0)], "anchor string, claim_id long, page_id long, score double")
    with pytest.raises(RuntimeError, match="settled nothing"):
        C.exclusive_topics(two, 1, 1)


def page_units_of(spark, monkeypatch, units, edges, mentions):
    """Let the registered queries run over these rows."""
    frames = (
        spark.createDataFrame(units, "id long, member long"),
        spark.createDataFrame(edges, "src long, dst long, rel string"),
        spark.createDataFrame(mentions, "claim_id long, entity_id string"),
    )
    monkeypatch.setattr(plans_clusters, "_page_units", lambda s, d, keep: tuple(f.coalesce(1) for f in frames))


def energies(unit, edges, mentions, wc, wx, ws):
    """Energy of pairs of units, by (smaller, larger)."""
    out, entities = {}, {}
    for a, b, rel in edges:
        if unit[a] != unit[b]:
            p = tuple(sorted((unit[a], unit[b])))
            out[p] = out.get(p, 0) + {"CORROBORATES": wc, "CONTRADICTS": wx}[rel]
    for c, e in mentions:
        entities.setdefault(unit[c], set()).add(e)
    for p in itertools.combinations(sorted(entities), 2):
        if k := len(entities[p[0]] & entities[p[1]]):
            out[p] = out.get(p, 0) + ws * k
    return out


def by_hash(spark, pairs):
    """The hash that breaks ties between pairs, for each pair."""
    rows = spark.createDataFrame(sorted(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    return {(r.a, r.b): r.h for r in rows}


def test_matching_of_scattered_ties_and_in_one_task(spark):
    rng = random.Random(16)
    edges = [(a, b, float(rng.randrange(2))) for a, b in {tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)}]
    frame = spark.createDataFrame(edges, "a long, b long, score double")
    for scattered in (False, True):
        h = by_hash(spark, [e[:2] for e in edges]) if scattered else {}
        used, want = set(), set()
        for a, b, s in sorted(edges, key=lambda e: (-e[2], h.get(e[:2], 0), e[0], e[1])):
            if not used & {a, b}:
                want.add((a, b))
                used |= {a, b}
        for at_once in (0, 100, 10_000):
            assert {(r.a, r.b) for r in C.greedy_matching(frame, scattered=scattered, at_once=at_once).collect()} == want


def test_layers_of_matching_are_those_of_brute_force(spark, monkeypatch):
    """Claims that merge along another bit of their number in each of six layers."""
    edges = [(i, i ^ 1 << k, "CORROBORATES") for k in range(6) for i in range(64) if i < i ^ 1 << k for _ in range(6 - k)] + [(3, 60, "CONTRADICTS")]
    mentions = [(i, f"P{i % 7}") for i in range(0, 64, 9)]
    unit = {i: i for i in range(64)}
    for least in (1, 2, 3, 4, 5, 6):
        used, to = set(), {}
        now = energies(unit, edges, mentions, 2, 1, 0.5)
        h = by_hash(spark, now)
        for (a, b), e in sorted(now.items(), key=lambda x: (-x[1], h[x[0]], x[0])):
            if e >= least and a not in used and b not in used:
                used |= {a, b}
                to[b] = a
        unit = {c: to.get(u, u) for c, u in unit.items()}
    page_units_of(spark, monkeypatch, [(i, i) for i in range(64)], edges, mentions)
    got = {r.member: r.unit for r in registry.queries()["q122_layered_matching"](spark, "").collect()}
    assert got == unit and set(unit.values()) == {0}


def entropy_of(claims, edges, mentions):
    """Entropy of a set of claims, from the formula."""
    if len(claims) < 2:
        return 0.0
    n = lambda rel: sum(a in claims and b in claims and r == rel for a, b, r in edges)
    coherence = min(1.0, max(0.0, (n("CORROBORATES") - 0.5 * n("CONTRADICTS")) / (len(claims) * (len(claims) - 1) / 2) + 0.1))
    counts = Counter(e for c, e, _ in mentions if c in claims)
    total = sum(counts.values())
    diversity = 1 - sum((k / total) ** 2 for k in counts.values()) if total else 0.0
    return diversity - 2 * coherence - 0.5 * min(1.0, len({p for c, _, p in mentions if c in claims}) / 5)


def test_layers_over_random_units_are_those_of_brute_force(spark):
    """Many ties; pairs that share enough only after merges; units without entities or links."""
    rng = random.Random(33)
    edges = sorted({(*sorted(rng.sample(range(50), 2)), rng.choice(["CORROBORATES", "CONTRADICTS"])) for _ in range(30)})
    mentions = sorted({(c, f"P{min(rng.randrange(12), rng.randrange(12))}") for c in range(45) for _ in range(3)})
    unit, sizes = {i: i // 2 for i in range(50)}, []
    for least in (1, 2, 3, 4, 5, 6):
        used, to = set(), {}
        now = energies(unit, edges, mentions, 2, 1, 0.5)
        h = by_hash(spark, now)
        for (a, b), e in sorted(now.items(), key=lambda x: (-x[1], h[x[0]], x[0])):
            if e >= least and not used & {a, b}:
                used |= {a, b}
                to[b] = a
        unit = {c: to.get(u, u) for c, u in unit.items()}
        sizes.append(len(to))
        if not to:
            break
    frames = (
        spark.createDataFrame([(i // 2, i) for i in range(50)], "id long, member long"),
        spark.createDataFrame(edges, "src long, dst long, rel string"),
        spark.createDataFrame(mentions, "claim_id long, entity_id string"),
    )
    got = {r.member: r.unit for r in C.layered_matching(*frames).collect()}
    assert got == unit and sum(n > 0 for n in sizes) > 2


def test_matching_by_entropy_is_that_of_brute_force(spark):
    rng = random.Random(21)
    edges = sorted({(*sorted(rng.sample(range(24), 2)), rng.choice(["CORROBORATES"] * 3 + ["CONTRADICTS"])) for _ in range(40)})
    mentions = sorted({(c, f"P{rng.randrange(9)}", c // 3) for c in range(22) for _ in range(2)})
    unit, merged, refused = {i: i for i in range(24)}, 0, 0
    for _ in range(8):
        of = {}
        for c, u in unit.items():
            of.setdefault(u, set()).add(c)
        falls = {}
        for (a, b), e in energies(unit, edges, [m[:2] for m in mentions], 2, 0, 0.5).items():
            before = sum(len(of[u]) * entropy_of(of[u], edges, mentions) for u in (a, b)) / len(of[a] | of[b])
            fall = round(before - entropy_of(of[a] | of[b], edges, mentions), 9)
            if e >= 0.5 and fall >= -0.05:
                falls[a, b] = fall
            refused += e >= 0.5 and fall < -0.05
        used, to = set(), {}
        h = by_hash(spark, falls) if falls else {}
        for (a, b), _ in sorted(falls.items(), key=lambda x: (-x[1], h[x[0]], x[0])):
            if not used & {a, b}:
                used |= {a, b}
                to[b] = a
        merged += len(to)
        unit = {c: to.get(u, u) for c, u in unit.items()}
    units = spark.createDataFrame([(i, i) for i in range(24)], "id long, member long")
    e, m = spark.createDataFrame(edges, "src long, dst long, rel string"), spark.createDataFrame(mentions, "claim_id long, entity_id string, page_id long")
    got = {r.member: r.unit for r in C.layered_matching(units, e.coalesce(1), m.coalesce(1), "entropy").collect()}
    assert got == unit and merged and refused


def test_layers_of_components_are_those_of_brute_force(spark):
    rng = random.Random(22)
    edges = sorted({(*sorted(rng.sample(range(40), 2)), rng.choice(["CORROBORATES", "CONTRADICTS"])) for _ in range(22)})
    mentions = sorted({(c, f"P{rng.randrange(30)}") for c in range(40) for _ in range(2)})
    unit = {i: i for i in range(40)}
    for least in (1, 2, 3, 4, 5):
        pairs = {p for p, e in energies(unit, edges, mentions, 2, 1, 0.5).items() if e >= least}
        for _ in range(40):
            for a, b in pairs:
                low = min(unit[a], unit[b])
                unit = {c: low if u in (unit[a], unit[b]) else u for c, u in unit.items()}
        if not pairs:
            break
    units = spark.createDataFrame([(i, i) for i in range(40)], "id long, member long")
    e, m = spark.createDataFrame(edges, "src long, dst long, rel string"), spark.createDataFrame(mentions, "claim_id long, entity_id string")
    got = {r.id: r.unit for r in C.layered_components(units, e.coalesce(1), m.coalesce(1)).collect()}
    assert got == unit and 1 < len(set(unit.values())) < 40


def test_anchors_absorb_linked_claims_of_their_context(spark):
    """Anchor A has claims 0-4, anchor B 5-9; then by rounds: 10 (two of A's context, linked), 11 by what 10
    brought, 12 is linked to both and goes to the better anchor, 13 shares one entity, 14 has no link."""
    said = {**{i: "A x y" for i in range(6)}, **{i: "B x z" for i in range(6, 11)}, 11: "x y u v", 12: "u v", 13: "x z y", 14: "x w", 15: "x y"}
    mentions = [(c, e, c % 3) for c, es in said.items() for e in es.split()]
    links = [(0, 11), (11, 12), (1, 13), (7, 13), (0, 14), (15, 15)]
    m = spark.createDataFrame(mentions, "claim_id long, entity_id string, page_id long")
    frames = m.filter("entity_id in ('A', 'B')"), spark.createDataFrame(links, "src long, dst long")
    topics = C.anchor_context(frames[0])
    got = {r.claim_id: r.anchor for r in C._absorbed(topics, m, frames[1], 2).collect()}
    assert got == {**{i: "A" for i in range(6)}, **{i: "B" for i in range(6, 11)}, 11: "A", 12: "A", 13: "A"}
    # an anchor of enough claims in all takes three free ones on two pages, not two
    left = [(c, "A", c % 3) for c in range(9)] + [(c, "B", c % 3) for c in (*range(4), 9, 10, 11)] + [(c, "C", c % 3) for c in (*range(4, 9), 12, 13)]
    got = C.anchor_context(spark.createDataFrame(left, "claim_id long, entity_id string, page_id long")).collect()
    assert {(r.anchor, r.claim_id) for r in got} == {("A", c) for c in range(9)} | {("B", c) for c in (9, 10, 11)}


def test_agglomeration_is_that_of_brute_force(spark, monkeypatch):
    """A chain and pairs of units; 20 merges of the 26 that have enough energy."""
    edges = [(2 * i, 2 * i + 1, "CORROBORATES") for i in range(20) for _ in range(1 + i % 3)] + [(i, i + 1, "CONTRADICTS") for i in range(40, 46)]
    mentions = [(40, "P1"), (43, "P1"), (44, "P1"), (0, "P2"), (3, "P2")]
    unit = {i: i for i in range(47)}
    for _ in range(20):
        (a, b), e = min(energies(unit, edges, mentions, 2, 1, 0.3).items(), key=lambda x: (-x[1], x[0]))
        assert e >= 1
        unit = {c: a if u == b else u for c, u in unit.items()}
    page_units_of(spark, monkeypatch, [(i, i) for i in range(47)], edges, mentions)
    got = {r.id: r.unit for r in registry.queries()["q223_best_pair_agglomeration"](spark, "").collect()}
    assert got == unit


def test_chains_and_levels(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "id long, next long")
    got = {r.id: (r.last, r.steps) for r in A.follow_chains(links).collect()}
    assert got == {1: (3, 2), 2: (3, 1), 5: (None, None), 6: (None, None)}
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 9)], "id long")
    levels = {r.id: r.level for r in A.support_levels(spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long"), nodes).collect()}
    assert levels == {1: 0, 2: 1, 3: 2, 9: 0}


def linked(rows, distance):
    """Average-link clusters of the (key, vector) of a group: of all pairs of clusters the nearest merges, until none is near."""
    unit = {k: np.array(v) / max(np.linalg.norm(v), 1e-12) for k, v in rows}
    clusters = {k: [k] for k in unit}
    while True:
        near = [(-round(float(np.mean([[unit[x] @ unit[y] for y in clusters[b]] for x in clusters[a]])), 9), a, b) for a, b in itertools.combinations(sorted(clusters), 2)]
        near = [n for n in near if -n[0] >= 1 - distance - 1e-12]
        if not near:
            return {x: k for k, xs in clusters.items() for x in xs}
        _, a, b = min(near)
        clusters[a] += clusters.pop(b)


@pytest.mark.parametrize("most", [2_000, 1])
def test_average_link_is_that_of_a_plain_loop(spark, most):
    rng = np.random.default_rng(31)
    rows = [(g, 100 * g + k, [float(x) for x in rng.normal(size=3)]) for g in range(4) for k in range(14)]
    rows += [(9, 900 + k, [1.0, float(k % 2), 0.0]) for k in range(6)]  # ties
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, k): theme for k, theme in linked([r[1:] for r in rows if r[0] == g], 0.4).items()}
    got = C.average_link(spark.createDataFrame(rows, "g long, k long, v array<double>"), "g", "k", "v", 0.4, most=most)
    assert {(r.g, r.k): r.theme for r in got.collect()} == want and len(set(want.values())) < len(rows) - 10


def test_average_link_of_large_groups_is_that_of_small_ones(spark):
    """A chain on which single link gives one theme, and random vectors in two groups."""
    chain = [(0, i, [math.cos(a), math.sin(a)]) for i, a in enumerate(math.radians(40 * i) for i in range(4))]
    rng = random.Random(12)
    rows = chain + [(g, 10 + i, [rng.gauss(0, 1) for _ in range(3)]) for g in (1, 2) for i in range(30)]
    df = spark.createDataFrame(rows, "g long, k long, v array<double>").coalesce(1)
    small = {(r.g, r.k): r.theme for r in C.average_link(df, "g", "k", "v", 0.3).collect()}
    large = {(r.g, r.k): r.theme for r in C.average_link(df, "g", "k", "v", 0.3, most=1).collect()}
    assert small == large and len(large) == 64
    assert [large[0, i] for i in range(4)] == [0, 0, 2, 2]


def test_authors(spark):
    rows = [
        (1, "By Jane Roe and John Doe, Reuters"), (2, "Jane Roe width: 1"), (3, None), (4, "Ann Poe covers trade in Bonn"), (5, "jane roe, Jane Roe"), (6, ""),
        (7, "Ann and Bob"), (8, "Li Wei Chen; Mary-Ann O'Neil | A B | Prince"), (9, "Jane Roe, editor for news since 2020"), (10, "Joined Up, Ann Poe graduated 2020"),
        (11, "More Jane Roe. (Bonn) x@y.de & STAFF"), (12, "Jane van der Roe, Jane X9, A Very Long Name Of Six Words"), (13, "Jane Roe, M.A. and Bob Poe"),
    ]
    got = {}
    for r in N.authors(spark.createDataFrame(rows, "id long, byline string")).collect():
        got.setdefault(r.id, []).append((r.author, r.is_organisation, r.confidence))
    assert got == {
        1: [("Jane Roe", False, 0.95), ("John Doe", False, 0.95), ("Reuters", True, 0.9)], 4: [("Ann Poe", False, 0.95)],
        7: [("Ann and Bob", False, 0.8)], 8: [("Li Wei Chen", False, 0.95), ("Mary-Ann O'Neil", False, 0.95), ("A B", False, 0.95)],
        9: [("Jane Roe", False, 0.95)], 11: [("Jane Roe.", False, 0.95), ("STAFF", True, 0.9)], 12: [("Jane van der Roe", False, 0.8)], 13: [("Jane Roe", False, 0.95)],
    }


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_name_ratios_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc ", k=rng.randrange(1, 12))).strip() for _ in "ab")
        a, b = " ".join(a.split()), " ".join(b.split())
        x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        want = 100.0 if not x and not y else 200 * brute_lcs(x, y) / (len(x) + len(y))
        assert abs(N.name_ratio(a, b, False) - want) < 1e-9
    assert N.name_ratio("michael mo", "michael mo kwan tai", True) == 100
    assert N.name_ratio("a b", "c d", True) == N.name_ratio("a b", "c d", False) and N.name_ratio("", "a", True) == 0


def test_fuzzy_matches_over_labels_and_aliases(spark):
    entities = spark.createDataFrame(
        [("E1", "PERSON", "Michael Mo", "Michael Mo Kwan Tai", ["M. Mo"]), ("E2", "ORGANIZATION", "Acme Corp", None, ["Acme Corporation", None]), ("E3", "ORGANIZATION", None, None, None)],
        "entity_id string, entity_type string, canonical_name string, wikidata_label string, aliases array<string>",
    )
    mentions = spark.createDataFrame([(1, "Kwan Tai Michael Mo", "PERSON"), (2, "corporation acme", "ORGANIZATION"), (3, "Corporation Acme", "PERSON"), (4, "Acme Ltd", "ORGANIZATION"), (5, None, "PERSON")], "mention_id long, name string, kind string")
    got = {r.mention_id: (r.entity_id, r.score) for r in N.fuzzy_matches(mentions, entities).collect()}
    assert got == {1: ("E1", 100.0), 2: ("E2", 100.0)}
    assert N.fuzzy_matches(mentions, entities.drop("wikidata_label", "aliases")).count() == 1


def test_superseded_is_the_loop_in_chain_order(spark):
    rng = random.Random(4)
    scores = {f"c{i:02}": round(rng.uniform(0.1, 0.95), 6) for i in range(30)}
    links = sorted({tuple(sorted(rng.sample(sorted(scores), 2))) for _ in range(40)})  # older first
    want = dict(scores)
    for older, newer in links:
        if want[newer] > 0.5:
            want[older] = min(want[older], 0.45)
            want[newer] = min(0.95, want[newer] * 1.1)
    got = S.superseded(spark.createDataFrame(sorted(scores.items()), "claim_id string, plausibility double"), spark.createDataFrame(links, "older string, newer string"))
    assert {r.claim_id: round(r.plausibility, 5) for r in got.collect()} == {k: round(v, 5) for k, v in want.items()}


def test_current_value_is_the_last_that_none_supersedes(spark):
    rows = [(1, "t", "a", 5, 1, False), (1, "t", "b", 6, 2, None), (1, "t", "c", 7, 3, True), (2, "t", "d", 8, 1, True), (2, "t", "e", 9, 2, True)]
    c = spark.createDataFrame(rows, "event_id long, topic_key string, claim_id string, value long, k long, is_superseded boolean").withColumn("reported_time", F.timestamp_seconds("k")).withColumn("event_time", F.timestamp_seconds("k"))
    assert {r.event_id: (r.chain, r.current) for r in A.update_chains(c).collect()} == {1: ("5>6>7", 6), 2: ("8>9", 9)}


def test_is_update_of(spark):
    kind = "struct<topic:string,value:long,reported_time:int,event_time:int>"
    cases = [
        (("t", 2, 2, 0), ("t", 1, 1, 0), True), (("t", 2, 1, 0), ("t", 1, 2, 0), False), (("t", 1, 2, 0), ("t", 1, 1, 0), False), (("u", 2, 2, 0), ("t", 1, 1, 0), False),
        (("t", 2, 1, 0), ("t", 1, 1, 1), False), (("t", 2, 1, 1), ("t", 1, 1, 0), True), (("t", 2, 1, None), ("t", 1, 1, 0), True), (("t", 2, None, 0), ("t", 1, 1, 0), True),
        ((None, 2, 2, 0), (None, 1, 1, 0), False), (("t", None, 2, 0), ("t", 1, 1, 0), False),
    ]
    got = spark.createDataFrame(cases, f"a {kind}, b {kind}, want boolean").select("want", T.is_update_of(F.col("a"), F.col("b")).alias("got")).collect()
    assert all(r.got == r.want for r in got)


@pytest.mark.parametrize("tag, want", [
    ("""<META name='dcterms.created' content='2024-05-01'>""", "2024-05-01 00:00"), ('<meta content="2024-05-02T10:00:00Z" name="dc.date">', "2024-05-02 10:00"),
    ('<time datetime="2024-05-03 07:00">', "2024-05-03 07:00"), ('<meta name="date" content="2024-05-04">', "None"), ('<meta name="dc.date" content="x"><time datetime="May 5, 2024">', "2024-05-05 00:00"), ('<time datetime="Sun, 5 May 2024 10:00:00 +0200">', "2024-05-05 08:00"),
    ('<script type="application/ld+json">{"a": 1}</script><script type="application/ld+json">[{"uploadDate": "2024-05-06", "publishDate": "?"}]</script>', "2024-05-06 00:00"),
    ('<time datetime="2024-05-07"><meta property="article:published_time" content="2024-05-08">', "2024-05-08 00:00"),
])
def test_published_in_order(spark, tag, want):
    assert str(value(spark, T.published(F.col("h")), h=tag)).startswith(want)


def test_direction_of_structural_updates(spark):
    for a, b, want in [("36 people were killed", "Death toll rises to 128", "b"), ("40 people died", "36 people died", "a"), ("40 died", "now 36 died", "b"), ("5 died", "5 died", None), ("5 died", "6 missing", None)]:
        assert value(spark, T.newer_by_structure(F.col("a"), F.col("b")), a=a, b=b) == want
    assert value(spark, T.relate_by_structure(F.col("a"), F.col("b")), a="Wang Fuk Court in Tai Po", b="Tai Po") == "CORROBORATES"


def test_snapshot_round_trip(spark, tmp_path):
    claims = spark.createDataFrame([("a", 1, 1, "x", 0.5), ("b", 1, 1, "y", 0.6)], "claim_id string, page_id long, event_id long, text string, confidence double")
    mentions = spark.createDataFrame([("a", "E")], "claim_id string, entity_id string")
    edges = spark.createDataFrame([("a", "b", "UPDATES")], "src string, dst string, rel string")
    snap = IO.build_snapshot(claims, mentions, edges)
    for end in ("s.parquet", "s.json"):
        IO.save_snapshot(snap, f"{tmp_path}/{end}")
        back, again = IO.load_snapshot(spark, f"{tmp_path}/{end}")
        assert [tuple(r) for r in again.select("src", "dst", "rel").collect()] == [("a", "b", "UPDATES")]
        assert back.count() == 2


def test_hyperplane_pairs_find_nine_of_ten(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(500, 16))
    x[250:] = x[:250] + rng.normal(size=(250, 16)) * rng.uniform(0.1, 0.9, (250, 1))
    rows = [(i, i % 2 if i < 250 else (i - 250) % 2, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, 0, None), (901, 0, [1.0]), (902, 1, [0.0] * 16)]
    df = spark.createDataFrame(rows, "k long, g long, v array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = unit @ unit.T
    want = {(a, b) for a in range(500) for b in range(a + 1, 500) if rows[a][1] == rows[b][1] and round(cosine[a, b], 6) > 0.7}
    for size in (2_000, 5):  # blocks whole and in pieces
        got = [(r.a, r.b) for r in P.pairs(df, "k", "v", 0.7, 16, "g", bits=6, block_rows=size).collect()]
        assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want) > 90
    exact = spark.createDataFrame(sorted(want), "a long, b long")
    r = P.recall(P.pairs(df, "k", "v", 0.7, 16, "g", bits=6), exact).first()
    assert (r.exact, r.found) == (len(want), len(got)) and r.recall >= 0.9
    assert P.recall(exact.limit(0), exact.limit(0)).first().recall is None


def test_longest_chains_with_and_without_cycles(spark):
    rng = random.Random(40)
    for cyclic in (False, True):
        edges = {(a, b) for a, b in ((rng.randrange(18), rng.randrange(18)) for _ in range(40)) if cyclic or a < b}
        edges = {(f"n{a:02d}", f"n{b:02d}") for a, b in edges}
        after = {}
        for a, b in edges:
            after.setdefault(a, []).append(b)

        def paths(p):
            yield p
            if len(p) <= 6:
                for b in after.get(p[-1], []):
                    if b not in p:
                        yield from paths([*p, b])

        want = {}
        for a in after:
            best = min((p for p in paths([a]) if len(p) > 1), key=lambda p: (-len(p), p), default=None)
            if best:
                want[a] = (">".join(best), len(best) - 1)
        got = {r.start: (r.path, r.length) for r in A.longest_chains(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
        assert got == want


def test_names_are_found_by_their_rarest_gram(spark):
    entities = ["Acme Steel", "Steelworks", "ab", "É", None, "", "x steel y"]
    names = ["steel", "STEEL", "ee", "a", "", "acme steel corp", "zzz", "é", None, "Acme Steel", "eeee", "st y"]
    frame = spark.createDataFrame([(f"e{i}", n, i) for i, n in enumerate(entities)], "entity_id string, canonical_name string, mention_count long")
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(n, f"e{i}") for n in names for i, e in enumerate(entities) if n is not None and e is not None and n.lower() in e.lower()}
    got = [tuple(r) for r in R.names_within(asked, frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in R.entity_priors(asked, frame, frame.select("entity_id", F.lit("c").alias("claim_id")))._jdf.queryExecution().toString()


def test_upserts_have_an_order(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k long, v string, at long")
    new = [(1, "b", 7), (1, "c", 6), (3, "x", 1), (3, "y", 1), (None, "n", 1)]
    for rows in (new, new[::-1]):
        frame = spark.createDataFrame(rows, old.schema).repartition(3)
        assert sorted(map(tuple, IO.upsert(old, frame, ["k"], ["at"]).collect()), key=str) == [(1, "b", 7), (2, "b", 5), (3, "y", 1), (None, "n", 1)]
        assert {r.v for r in IO.upsert(old, frame.filter("k = 1"), ["k"]).filter("k = 1").collect()} == {"b"}


def test_upsert_sink_over_batches_and_a_replay(spark, tmp_path):
    schema = "k long, v string, at long"
    batches = [[(i, f"first {i}", 1) for i in range(20)], [(3, "second", 2), (3, "third", 3), (40, "new", 1)], [(40, "newer", 2), (7, "last", 9)]]
    table = IO.UpsertTable(spark, f"file://{tmp_path}/table", ["k"], ["at"], buckets=4)
    assert table.read() is None and table.versions() == []
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(table.sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = None
    for part in batches:
        frame = spark.createDataFrame(part, schema)
        want = IO.upsert(frame.limit(0) if want is None else want, frame, ["k"], ["at"])
    plain = lambda df: sorted(map(tuple, df.select("k", "v", "at").collect()))
    assert plain(table.read()) == plain(want) and table.versions() == [0, 1, 2]
    table.sink(spark.createDataFrame(batches[1], schema), 1)  # a batch that is run again changes nothing
    assert plain(table.read()) == plain(want) and plain(table.read(0)) == sorted(batches[0])
    assert table.folders(2) != table.folders(1) and set(table.folders(2).values()) & set(table.folders(1).values())  # other buckets stay as they were
    table.sink(spark.createDataFrame([], schema), 3)
    table.vacuum()
    assert plain(table.read()) == plain(want) and table.versions() == [3]


def test_leaders_are_those_of_a_loop(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 5))
    rows = [(i, i % 3, [float(x) for x in centres[rng.integers(6)] + 0.4 * rng.normal(size=5)]) for i in range(120)] + [(900, 0, None), (901, 1, [0.0] * 5)]
    want = {900: 900, 901: 901}
    for shard in range(3):
        leaders = []
        for k, _, v in sorted((r for r in rows if r[1] == shard and r[0] < 900), key=lambda r: -r[0]):
            v = np.array(v)
            cosine = [round(float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)), 9) for _, s in leaders]
            i = int(np.argmax(cosine)) if cosine else -1
            if i >= 0 and cosine[i] >= 0.8:
                leaders[i] = (leaders[i][0], leaders[i][1] + v)
            else:
                i = len(leaders)
                leaders.append((k, v))
            want[k] = leaders[i][0]
    df = spark.createDataFrame(rows, "k long, s long, v array<double>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        got = {r.k: r.leader for r in C.leader_clusters(df, "k", [-F.col("k")], "v", F.col("s"), 0.8).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and len(set(want.values())) < 60


def test_merged_units_are_components_of_near_centroids(spark):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(1, 6)), i % 2, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    big = [r for r in rows if r[1] >= 3]
    unit = {r[0]: np.array(r[3]) / np.linalg.norm(r[3]) for r in big}
    edges = [(a[0], b[0]) for a, b in itertools.combinations(big, 2) if a[2] == b[2] and round(float(unit[a[0]] @ unit[b[0]]), 6) > 0.6]
    want = {r[0]: r[0] for r in rows} | components(edges)
    got = C.merged_units(spark.createDataFrame(rows, "id long, size long, group long, vector array<double>"), 0.6, 3)
    assert {r.id: r.event for r in got.collect()} == want and edges


def test_constellations_are_pairs_that_occur_together(spark):
    rng = random.Random(14)
    rows = sorted({(c, c % 4, f"e{rng.randrange(5)}") for c in range(30) for _ in range(3)})
    said = {}
    for c, _, e in rows:
        said.setdefault(c, set()).add(e)
    having = {}
    for c, es in said.items():
        for p in itertools.combinations(sorted(es), 2):
            having.setdefault("|".join(p), set()).add(c)
    taken, want = set(), {}
    for anchor in sorted(having, key=lambda a: (len(having[a]), a), reverse=True):
        free = having[anchor] - taken
        if len(free) >= 3 and len({c % 4 for c in free}) >= 2:
            taken |= free
            want |= dict.fromkeys(free, anchor)
    got = C.constellations(spark.createDataFrame(rows, "claim_id long, page_id long, entity_id string"))
    assert {r.claim_id: r.anchor for r in got.collect()} == want and len(set(want.values())) > 2


def test_cascade_of_identification(spark):
    entities = spark.createDataFrame([("e1", "Acme Steel Works", "ORG"), ("e2", "Acme Steel Works", "ORG"), ("e3", "Ann Poe", "PERSON"), ("e4", "Northern Harbour Authority", "ORG")], "entity_id string, canonical_name string, entity_type string")
    aliases = spark.createDataFrame([("e3", "A. Poe"), ("e4", "The Harbour")], "entity_id string, alias string")
    external = spark.createDataFrame([(5, "Q2", 0.8), (5, "Q1", 0.8), (6, "Q9", 0.5), (1, "Q5", 0.9)], "mention_id long, qid string, score double")
    mentions = [(1, "acme steel works", "ORG"), (2, "The Harbour", "ORG"), (3, "Acme Steel Works", "PERSON"), (4, "Northern Harbour Authorty", "ORG"), (5, "zzz qqq", "ORG"), (6, "x", "ORG"), (7, "Unheard Of", "PERSON")]
    got = {r.mention_id: (r.target, r.method, r.confidence) for r in N.identify(spark.createDataFrame(mentions, "mention_id long, name string, kind string"), entities, aliases, external).collect()}
    assert got[1] == ("e1", "exact", 1.0) and got[2] == ("e4", "alias", 0.95)
    assert got[4][:2] == ("e4", "fuzzy") and 0.9 < got[4][2] < 1
    assert got[5] == ("Q1", "external", 0.8) and got[7] == (None, "new", 0.7) and 6 not in got
    assert got[3][1] != "exact"  # kinds are told apart


def test_main_text_of_a_page(spark):
    long = "word " * 30
    pages = [
        (1, f"<nav><p>{long}</p></nav><p>{long}</p>x<script>{long}</script><p>end</p>"), (2, f"<div>{long}</div><p>short</p>"), (3, f'<meta name="description" content="{long}"><p>no</p>'),
        (4, "<p>no</p>"), (5, None), (6, ""), (7, f"<p>{long}<style>p</style></p></p><p>{long}"),
    ]
    got = {r.page_id: (r.method, r.content) for r in IO.main_texts(spark.createDataFrame(pages, "page_id long, html string")).collect()}
    text = long.strip()
    assert got == {1: ("paragraphs", f"{text}\nend"), 2: ("text", f"{text}\nshort"), 3: ("description", long), 4: ("none", None), 5: ("none", None), 6: ("none", None), 7: ("paragraphs", f"{text}\n{text}")}


def test_budget_of_merges_is_that_of_brute_force(spark, monkeypatch):
    rng = random.Random(24)
    edges = sorted({(*sorted(rng.sample(range(30), 2)), rng.choice(["CORROBORATES", "CONTRADICTS"])) for _ in range(25)})
    mentions = sorted({(c, f"P{rng.randrange(12)}") for c in range(30) for _ in range(3)})
    unit = {i: i for i in range(30)}
    for _ in range(10):
        (a, b), e = min(energies(unit, edges, mentions, 1, 0.5, 0.3).items(), key=lambda x: (-round(x[1], 9), x[0]))
        assert e >= 1
        unit = {c: a if u == b else u for c, u in unit.items()}
    page_units_of(spark, monkeypatch, [(i, i) for i in range(30)], edges, mentions)
    assert {r.id: r.unit for r in registry.queries()["q224_budgeted_agglomeration"](spark, "").collect()} == unit
