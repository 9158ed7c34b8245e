"""Vector joins in cells against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import clustering as C
from claimloom.operators import planes as P
from claimloom.operators import similarity as M
from claimloom.plans import registry

from conftest import DATA


def rows_of(n, seed, name=int):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6)).round(2).tolist()
    v[3], v[4], v[5], v[6], v[9] = v[2], [0.0] * 6, None, [1.0, 2.0], v[2]
    return [(name(i), i % 3 if i % 11 else None, x) for i, x in enumerate(v)]


def cosine(x, y):
    if x is None or y is None or len(x) != len(y):
        return None
    n = np.linalg.norm(x) * np.linalg.norm(y)
    return round(float(np.dot(x, y) / n), 6) if n else 0.0


@pytest.mark.parametrize("piece_rows", [4_096, 5])
@pytest.mark.parametrize("kind,name", [("long", int), ("string", "k{}".format)])
def test_near_pairs_are_all_pairs(spark, piece_rows, kind, name):
    rows = rows_of(70, 1, name)
    df = spark.createDataFrame(rows, f"k {kind}, g long, v array<double>")
    want = {(a, b, g): c for a, g, x in rows for b, h, y in rows if g is not None and g == h and a < b and (c := cosine(x, y)) is not None and c > 0.1}
    got = M.near_pairs(df, "k", "v", 0.1, ["g"], piece_rows=piece_rows).collect()
    assert len(got) == len(want) and all(abs(want[r.a, r.b, r.g] - r.cosine) < 2e-6 for r in got)


@pytest.mark.parametrize("piece_rows", [4_096, 7])
def test_nearest_are_those_of_all_pairs(spark, piece_rows):
    rows = [(i, x) for i, _, x in rows_of(60, 2)]
    index = spark.createDataFrame(rows, "id long, v array<double>")
    queries = index.filter("id % 4 = 0 OR id IN (2, 3)").select(F.col("id").alias("q"), "v")
    left_out = queries.select("q", F.col("q").alias("id")).union(queries.select("q", (F.col("q") + 1).alias("id")))
    for out in (None, left_out):
        gone = set() if out is None else {tuple(r) for r in out.collect()}
        want = set()
        for q, x in ((i, x) for i, x in rows if i % 4 == 0 or i in (2, 3)):
            met = sorted((-c, i) for i, y in rows if (q, i) not in gone and (c := cosine(x, y)) is not None and c >= 0.2)
            want |= {(q, i, k + 1) for k, (_, i) in enumerate(met[:3])}
        got = M.against(queries, index, "v", 3, 0.2, out, piece_rows=piece_rows)
        assert {(r.q, r.id, r["rank"]) for r in got.collect()} == want


def test_no_pair_is_joined(spark):
    df = spark.createDataFrame(rows_of(20, 3), "k long, g long, v array<double>")
    plan = M.pairs_within(df, "k", "g", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(zip_with" not in plan.split("FlatMapGroupsInArrow")[0] and "FlatMapGroupsInArrow" in plan


def test_queries_keep_weak_pairs_in_their_cells(spark, monkeypatch):
    asked, near = [], M.near_pairs
    monkeypatch.setattr(M, "near_pairs", lambda df, key, vector, least, group: asked.append(least) or near(df, key, vector, least, group))
    for name in ("q126_peer_candidates", "q217_alike_claims", "q219_related_but_distinct"):
        registry.queries()[name](spark, DATA)
    assert [round(x, 3) for x in asked] == [0.18, 0.2, 0.2]


@pytest.mark.parametrize("piece_rows", [4_096, 9])
def test_recall_in_cells_is_that_of_the_pairs(spark, piece_rows):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3 if i % 11 else None, x) for i, x in enumerate(rng.normal(size=(120, 6)).tolist())] + [(200, 0, None), (201, 1, [1.0, 2.0]), (202, 1, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "k long, g long, v array<double>")
    want = P.recall(P.pairs(df, "k", "v", 0.3, 6, "g", bits=4, tables=3), M.near_pairs(df, "k", "v", 0.3, ["g"])).first()
    got = P.recall_within(df, "k", "v", 0.3, 6, "g", bits=4, tables=3, piece_rows=piece_rows)
    assert tuple(got.first()) == tuple(want) and 0 < want.found < want.exact
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert tuple(P.recall_within(df.limit(0), "k", "v", 0.3, 6, "g").first()) == (0, 0, None)


def seeds_of(order, near):
    """One id after the other takes those of its neighbours that are free."""
    free, to = set(order), {}
    for i in order:
        if i in free:
            got = {i} | (near[i] & free)
            free -= got
            to |= {x: i for x in got if len(got) > 1}
    return to


def test_an_id_goes_to_the_best_of_all_its_seeds(spark):
    # 3 is a seed at once, 2 only when 0 has taken 1; then 2 comes first and takes 5
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 5), (3, 5)], "a long, b long")
    weights = spark.createDataFrame([(i, 1) for i in range(6)], "id long, weight long")
    assert {r.id: r.seed for r in C.seed_clusters(pairs, weights).collect()} == {0: 0, 1: 0, 2: 2, 5: 2}


@pytest.mark.parametrize("head_rows,piece_rows", [(512, 4_096), (3, 7)])
def test_seeds_of_vectors_are_those_of_a_sorted_scan(spark, head_rows, piece_rows):
    rows = [(i, g, x, i * 7 % 5) for i, g, x in rows_of(90, 4)]
    known = {i: (g, x) for i, g, x, _ in rows if g is not None and x is not None}
    near = {a: {b for b, (h, y) in known.items() if b != a and h == g and (c := cosine(x, y)) is not None and c > 0.5} for a, (g, x) in known.items()}
    want = seeds_of(sorted(known, key=lambda i: (-(i * 7 % 5), i)), near)
    df = spark.createDataFrame(rows, "k long, g long, v array<double>, w long")
    got = C.vector_seed_clusters(df, "k", "v", "g", "w", 0.5, head_rows=head_rows, piece_rows=piece_rows).collect()
    assert {r.id: r.seed for r in got} == want and len(got) == len(want) > 50 and len(set(want.values())) > 8


def test_seed_clusters_of_vectors_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "near_pairs", None)
    assert registry.queries()["q217_seed_clusters"](spark, DATA).count() > 100
