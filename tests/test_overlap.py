"""Set joins against all pairs."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from claimloom.operators import aggregates as A
from claimloom.operators import clustering as C
from claimloom.operators import overlap as O
from claimloom.operators import similarity as M


def sets_of(rng, n, name):
    """Sets with one member in nearly all of them, one in a third, empty ones, and repeats."""
    out = {}
    for i in range(n):
        s = {f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(6))}
        s |= {"hot"} if rng.random() < 0.9 else set()
        s |= {"warm"} if rng.random() < 0.3 else set()
        out[name(i)] = s
    return out


def frame(spark, sets, kind):
    rows = [(i, t) for i, s in sets.items() for t in s]
    return spark.createDataFrame([*rows, *rows[:9], (None, "hot"), (rows[0][0], None)], f"id {kind}, token string")


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 7, "cell_members": 20}])
@pytest.mark.parametrize("kind,name", [("long", int), ("string", "c-{}".format)])
def test_top_overlaps(spark, cells, kind, name):
    rng = random.Random(4)
    left, right = sets_of(rng, 60, name), sets_of(rng, 90, name)
    for same in (False, True):
        other = left if same else right
        want = set()
        for a, s in left.items():
            met = sorted((-len(s & o), b) for b, o in other.items() if s & o and not (same and a == b))
            want |= {(a, b, -n, k + 1) for k, (n, b) in enumerate(met[:5])}
        got = O.top_overlaps(frame(spark, left, kind), frame(spark, other, kind), 5, distinct=same, **cells)
        assert {tuple(r) for r in got.select("a", "b", "shared", "rank").collect()} == want


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 7, "cell_members": 20}])
def test_overlaps_of_some_size(spark, cells):
    rng = random.Random(5)
    left, right = sets_of(rng, 50, int), sets_of(rng, 70, int)
    for least in (1, 2, 3):
        want = {(a, b, len(s & o)) for a, s in left.items() for b, o in right.items() if a != b and len(s & o) >= least}
        got = [tuple(r) for r in O.overlaps(frame(spark, left, "long"), frame(spark, right, "long"), least, **cells).collect()]
        assert len(got) == len(want) and set(got) == want
    empty = frame(spark, left, "long").limit(0)
    assert O.overlaps(empty, frame(spark, right, "long")).count() == 0 and O.overlaps(frame(spark, left, "long"), empty).count() == 0
    assert O.top_overlaps(empty, empty, 3).count() == 0 and O.partner_counts(empty).count() == 0


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 7, "cell_members": 20}])
def test_dots(spark, cells):
    rng = random.Random(7)
    left, right = ({i: {t: rng.randrange(1, 5) for t in s} for i, s in sets_of(rng, n, int).items()} for n in (40, 60))
    table = lambda x: spark.createDataFrame([(i, t, n) for i, s in x.items() for t, n in s.items()], "id long, token string, n long")
    want = {(a, b, len(s.keys() & o.keys()), float(sum(n * o[t] for t, n in s.items() if t in o))) for a, s in left.items() for b, o in right.items() if a != b and s.keys() & o.keys()}
    got = [tuple(r) for r in O.dots(table(left), table(right), **cells).collect()]
    assert len(got) == len(want) and set(got) == want


def test_all_pairs_of_a_token_are_dealt_out_over_cells(spark):
    """One task made all pairs of up to 16,384 rows."""
    made = O.dots(*[spark.createDataFrame([(i, "hot", 1) for i in range(900)], "id long, token string, n long")] * 2)
    assert re.search(r"RepartitionByExpression \[block#\d+L?, part#\d+L?\], 8", made._jdf.queryExecution().optimizedPlan().toString())
    assert made.count() == 900 * 899


@pytest.mark.parametrize("kind,name", [("long", int), ("string", "c-{:02d}".format)])
def test_partner_counts_and_pairs_that_share_two(spark, kind, name):
    sets = sets_of(random.Random(6), 80, name)
    keys = frame(spark, sets, kind)
    later = {a: [b for b, o in sets.items() if b > a and s & o] for a, s in sets.items()}
    got = {r.a: (r.partners, r["last"]) for r in O.partner_counts(keys).collect()}
    assert got == {a: (len(bs), max(bs)) for a, bs in later.items() if bs}
    known = keys.filter("id IS NOT NULL AND token IS NOT NULL").distinct()
    twice = [tuple(r) for r in O.twice_sharing(known).collect()]
    assert sorted(twice) == sorted((a, b, len(s & o)) for a, s in sets.items() for b, o in sets.items() if a < b and len(s & o) > 1)
    ranks = {(r.id, r.token): r.after for r in O.rank_in_token(known, parts=5).collect()}
    assert ranks == {(a, t): sum(b > a and t in o for b, o in sets.items()) for a, s in sets.items() for t in s}


def test_hot_token_makes_no_pairs(spark):
    """30,000 ids share one token: their number is counted, and no pair is made."""
    keys = spark.range(30_000).select("id", F.lit("hot").alias("token")).unionByName(spark.createDataFrame([(0, "x"), (29_999, "x")], "id long, token string"))
    got = O.partner_counts(keys)
    assert got.agg(F.sum("partners")).first()[0] == 30_000 * 29_999 // 2 and got.filter("last <> 29999").count() == 0
    best = {r.a: (r.b, r.shared) for r in O.top_overlaps(keys, keys, 1, distinct=True).collect()}
    assert best[0] == (29_999, 2) and best[1] == (0, 1) and len(best) == 30_000


def test_judged_pairs(spark):
    rng = random.Random(9)
    sets = sets_of(rng, 70, "c-{}".format)
    rows = spark.createDataFrame([(i, t, len(s)) for i, s in sets.items() for t in s], "id string, token string, n long")
    jaccard = lambda x, y: len(x & y) / len(x | y)
    want = {(a, b, len(s & o), round(jaccard(s, o), 9)) for a, s in sets.items() for b, o in sets.items() if a < b and s & o and jaccard(s, o) >= 0.4}
    for cells in ({}, {"cell_rows": 7, "cell_members": 20}):
        got = O.judged_pairs(rows, lambda k, x, y: k / (x["n"] + y["n"] - k), 0.4, **cells).collect()
        assert len(got) == len(want) and {(r.a, r.b, r.shared, round(r.score, 9)) for r in got} == want


def test_rows_that_share_a_frequent_token_stand_in_one_block(spark, monkeypatch):
    """What moves are a token's ids to the blocks that ask for it: with rows dealt out by hash each block asked for each frequent token."""
    rows = [(f"c{i}", t) for i in range(400) for t in (f"S{i % 8}", f"P{i}")]
    keys = spark.createDataFrame(rows, "id string, token string")
    seen, write = {}, O.cut_lineage
    monkeypatch.setattr(O, "cut_lineage", lambda df, name="loop": seen.setdefault(name, write(df, name)))
    O.overlaps(keys, keys, cell_rows=50, cell_members=700).count()
    asked = seen["overlap-wanted"].filter("token LIKE 'S%'").count()
    assert seen["overlap-wanted"].select("block").distinct().count() >= 8 and asked <= 24


def test_postings_move_in_few_bytes(spark):
    """A list of ids took 16 bytes an id and more, and each fact 8 beside it."""
    ids = {"bigint": [-(2**40), 0, 2**62], "long": [*range(2**40, 2**40 + 600, 3)], "string": ["", "c-é", *(f"c-{i:06}" for i in range(300))], "date": [datetime.date(2020, 1, 1), datetime.date(2021, 2, 3)]}
    for kind, of in ids.items():
        facts = [[3, -1, 300, 70_000, 2**40][i % 5] for i in range(len(of))], [[0.5, 2.0, None, float("nan")][i % 4] for i in range(len(of))], [2.0] * len(of)
        rows = spark.createDataFrame([("x", sorted(of), *facts), ("y", sorted(of)[:1], *(f[:1] for f in facts))], f"token string, ids array<{kind}>, n array<long>, w array<double>, v array<double>")
        x, y = O._packed(rows, ["n", "w", "v"]).orderBy("token").collect()
        back, sizes = O._unpacked_ids([bytes(x.ids), bytes(y.ids)], to_arrow_schema(rows.select(F.explode("ids").alias("id")).schema).field("id").type)
        assert back.to_pylist() == [*sorted(of), sorted(of)[0]] and sizes.tolist() == [len(of), 1]
        assert O._wide(x.n).tolist() == facts[0] and O._wide(x.n).dtype == np.int64
        assert np.array_equal(O._wide(x.w), np.array(facts[1], float), equal_nan=True) and O._wide(x.v).tolist() == facts[2]
        assert len(x.v) <= len(of) + 1 and (kind in ("bigint", "date") or len(x.ids) < 5 * len(of))
    made = O.judged_pairs(spark.createDataFrame([(i, t, 2) for i in range(3_000) for t in (i % 50, 100 + i % 7)], "id long, token long, n long"), lambda k, x, y: k / (x["n"] + y["n"] - k), 0.9)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # few rows stand in several blocks, each a task's, whatever the session's number of partitions
    assert "MapInArrow" in plan and re.search(r"RepartitionByExpression \[block#\d+L?, part#\d+L?\], [6-9]", plan)
    assert made.count() == sum(1 for i in range(3_000) for j in range(i % 350, i, 350))


def mentioned(spark):
    rng = random.Random(11)
    rows = [(f"c{i:03}", rng.randrange(25), e) for i in range(150) for e in {f"P{rng.randrange(30)}", f"S{rng.randrange(6)}"}]
    return rows, spark.createDataFrame(rows, "claim_id string, event_id long, entity_id string")


def test_frames_leave_as_sums(spark):
    rows, mentions = mentioned(spark)
    events, holders = {}, {}
    for _, e, t in rows:
        events.setdefault(e, set()).add(t)
        holders.setdefault(t, set()).add(e)
    want = {}
    for t, es in holders.items():
        apart = [1 - len(events[a] & events[b]) / len(events[a] | events[b]) for a in es for b in es if a < b]
        if apart:
            want[t] = (round(min(apart), 6), round(sum(apart) / len(apart), 6))
    made = C.independent_frames(mentions, 0.5)
    got = {r.entity_id: (r.least, r.mean, r.frame) for r in made.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[t][0] - lo) < 2e-6 and abs(got[t][1] - mean) < 2e-6 and got[t][2] == (got[t][1] > 0.5) for t, (lo, mean) in want.items())
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_relations_are_counted_where_the_pairs_are(spark):
    rows, mentions = mentioned(spark)
    claims = sorted({c for c, *_ in rows})
    facts = spark.createDataFrame([(c, i % 7 if i % 3 == 0 else None, i) for i, c in enumerate(claims)], "id string, number long, value long")
    side = lambda k: facts.select(F.col("id").alias(k), F.col("number").alias(f"n{k}"), F.col("value").alias(f"v{k}"))
    pairs = M.shared_specificity(mentions).join(side("a"), "a").join(side("b"), "b")
    relation = M.relate(F.col("na"), F.col("nb"), F.pmod(F.col("va") * F.col("vb"), F.lit(10)) / 10, F.col("specificity"))
    want = pairs.select("a", "b", relation.alias("relation")).groupBy("a", "relation").agg(F.count("*").alias("pairs"), F.max("b").alias("last"))
    made = M.relation_counts(mentions, facts, lambda x, y: x["value"] * y["value"] % 10 / 10)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_gravity_leaves_as_sums(spark):
    """Each pair left the join with its entities, and met two further tables."""
    _, mentions = mentioned(spark)
    sizes = mentions.groupBy(F.col("claim_id").alias("id")).agg(F.countDistinct("entity_id").alias("n"))
    pairs = M.gravity(M.shared_specificity(mentions).withColumn("cosine", F.lit(0.2)), sizes)
    want = {r.a: (r.pairs, r.g, r.b) for r in pairs.groupBy("a").agg(F.count("*").alias("pairs"), F.max("gravity").alias("g"), F.max("boosted").alias("b")).collect()}
    made = M.gravity_sums(mentions, 0.2)
    got = {r.a: (r.pairs, r.gravity, r.boosted) for r in made.collect()}
    assert got.keys() == want.keys() and all(got[a][0] == want[a][0] and got[a][1:] == pytest.approx(want[a][1:], abs=2e-6) for a in want)
    assert len({r[1] for r in want.values()}) > 5
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]


def test_merges_and_overlaps_are_judged_where_the_pairs_are(spark):
    _, mentions = mentioned(spark)
    members = mentions.select(F.col("event_id").alias("id"), F.col("entity_id").alias("member"))
    plan = A.group_overlap(members, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapCoGroupsInArrow")[0]
    sets = {}
    for i, t in members.collect():
        sets.setdefault(i, set()).add(t)
    near = [(a, b) for a in sets for b in sets if a < b and (k := len(sets[a] & sets[b])) and (k / len(sets[a] | sets[b]) >= 0.45 or k / min(len(sets[a]), len(sets[b])) >= 0.8)]
    name = {i: i for i in sets}
    for _ in sets:
        for a, b in near:
            name[a] = name[b] = min(name[a], name[b])
    assert len(set(name.values())) < len(sets)
    assert {tuple(r) for r in C.merged_clusters(members, 0.45, 0.8).collect()} == {(name[i], t) for i, s in sets.items() for t in s}
