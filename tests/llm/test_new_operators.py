"""Prefix trie, toxicity and spelling variants against brute force, held-out rows and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimloom.llm import mixing, prefix_trie, queries, spelling, token_ids, toxicity, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")

# 11 -----------------------------------------------------------------------------------------------


def brute_trie(rows):
    """All nodes of the rebuilt conversations; turns with equal numbers mustn't differ."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {k: [x[2:] for x in sorted(v)] for k, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += not children[p]
    return sorted(
        (min(who), len(p), min(members[p[:-1]]) if p else -1, len(who), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(who) if len(built[c]) == len(p)).encode()).hexdigest())
        for p, who in members.items()
    )


def trie(frame, **more):
    got = prefix_trie.trie_of(prefix_trie.rebuilt(frame), **more).select(*TRIE)
    return sorted(tuple(-1 if v is None else v for v in r) for r in got.collect())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("shard_turns", [7, 100_000])
def test_trie_against_brute_force(spark, shard_turns):
    rng = random.Random(5)
    rows = []
    for c in range(80):
        rows += [(c, t, "ua"[t % 2], rng.choice(["x", "yé", "", None])) for t in range(rng.choice([1, 2, 3, 4, 6]))]
    for c in (200, 205, 210):  # long copies, over several blocks of columns
        rows += [(c, t, "u", f"t{t}") for t in range(prefix_trie.WIDTH * 2 + 3)]
    for c in range(300, 340):  # one conversation many times
        rows += [(c, t, "u", "same") for t in range(3)]
    frame = conversations(spark, rows).repartition(5)
    assert trie(frame, shard_turns=shard_turns) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [
        (None, 0, "u", "nobody"), (1, None, "u", "first"), (1, 0, None, None), (1, 0, None, None), (1, 3, "a", "é" * 50_000), (-7, 1, "u", "x"), (5, None, None, None),
        (6, 0, "u", "own"), (2**62, 0, "u", "own"),
    ]
    frame = conversations(spark, rows)
    got = trie(frame.withColumn("hi", F.lit(1)).withColumn("path", F.lit("p")))
    assert got == trie(frame, shard_turns=1) and sum(r[1] == 0 for r in got) == 1
    known = [r for r in rows if r[0] is None or r[0] >= 0]  # the remainder of a negative id is Python's own there
    assert trie(conversations(spark, known)) == brute_trie(known)
    assert trie(conversations(spark, [])) == [] and trie(conversations(spark, rows[:1])) == []


def test_trie_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    want = c.sql(f"SELECT {', '.join(TRIE)} FROM ({queries.OP11_SQL})").fetchall()
    got = queries.op11_prefix_trie(spark, DATA).select(*TRIE).collect()
    plain = lambda rows: sorted(tuple(-1 if v is None else v for v in r) for r in rows)
    assert plain(got) == plain(want) and len(got) > 10


# 12 -----------------------------------------------------------------------------------------------


def made_documents(spark, n, rng, strange=("zorkel", "blemfit", "quaxo")):
    """Texts, a tenth of them with words that no list has; labels for two thirds, one in fifty of them wrong."""
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.12
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(2 + len(words) // 30):
                words.insert(rng.randrange(len(words)), rng.choice(strange) + rng.choice(["", "s", "ed"]))
        rows.append((i, " ".join(words), "en", "a", 0))
        if rng.random() < 0.66:
            labels.append((i, int(toxic) ^ (rng.random() < 0.02), int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([x[:2] for x in labels], "doc_id long, toxic int"), {x[0]: x[2] for x in labels}


def test_toxicity_learns_strange_words(spark):
    docs, labels, truth = made_documents(spark, 1500, random.Random(3))
    train = F.pmod(F.col("doc_id"), F.lit(4)) != 2
    got = toxicity.score_toxicity(docs, labels, train).collect()
    assert len(got) == 1500
    held = [(r, truth[r.doc_id]) for r in got if r.doc_id % 4 == 2 and r.doc_id in truth]
    hits = [(r.predicted, y) for r, y in held]
    assert hits.count((0, 1)) <= 1 and hits.count((1, 0)) <= 2 and sum(y for _, y in hits) > 15
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    wrong = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))  # held-out labels aren't read
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, wrong, train).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) < 1e-9


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    m, n = len(toxicity.VOTERS), 40_000
    y = rng.random(n) < 0.15
    votes = np.zeros((n, m), np.int8)
    votes[:, 0] = np.where(rng.random(n) < np.where(y, 0.8, 0.02), toxicity.TOXIC, toxicity.CLEAN)
    votes[:, 3] = np.where(rng.random(n) < 0.95, votes[:, 0], toxicity.ABSTAIN)  # a copy of voter 0
    votes[:, 6] = np.where(rng.random(n) < np.where(y, 0.7, 0.05), toxicity.TOXIC, toxicity.CLEAN)
    votes[:, -1] = np.where(rng.random(n) < 0.3, 1 + y, toxicity.ABSTAIN)
    model = toxicity.LabelModel.start(0.15)
    first = np.where(votes[:, -1] != toxicity.ABSTAIN, 1.0, 0.0)
    for weight in (first, np.ones(n), np.ones(n), np.ones(n)):
        model = toxicity.LabelModel.fitted(model.joint(votes, weight), 0.15)
    assert {model.parent[0], model.parent[3]} & {0, 3} and (model.parent[3] == 0 or model.parent[0] == 3)
    assert model.parent[6] == 6
    assert abs(model.tables[6, 1, 0, toxicity.TOXIC] - 0.7) < 0.03 and abs(model.tables[6, 0, 0, toxicity.TOXIC] - 0.05) < 0.02
    free = votes[:, -1] == toxicity.ABSTAIN
    q = model.posterior(votes)[free]
    assert abs(q.mean() - y[free].mean()) < 0.02
    sure = q > 0.9
    assert y[free][sure].mean() > 0.9


def test_terms_are_those_of_single_words():
    texts = ["Idiots, Été2 x", "", "ab abc" * 3, "ß" * 30 + " \U0001d400bc", "\n\n"]
    n, kinds = toxicity.terms_of(texts)
    assert n.tolist() == [3, 0, 4, 2, 0]
    for i, text in enumerate(texts):
        for k, size in enumerate((3, 4, 5, 6, 1)):
            words = [w for w in re.findall(r"[^\W\d_]+", text.lower()) if len(w) >= size]
            want = [b for w in words for b in toxicity.terms_of([w[:size] if k < 4 else w])[1][k][1].tolist()]
            assert kinds[k][1][kinds[k][0] == i].tolist() == want


def test_toxicity_of_odd_rows(spark):
    long = "word " * 30_000 + "idiot"
    rows = [(1, None, None, None, None), (None, "you idiot!", "en", "a", 1), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, long, "en", "a", 1), (4, "<|x|> ＡＢＣ \U0001f600", "xx", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("s")).withColumn("y", F.lit(1)).withColumn("terms", F.lit(2))
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (4, None), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = toxicity.score_toxicity(docs, known, F.lit(True)).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert toxicity.score_toxicity(docs.limit(0), labels, F.lit(True)).count() == 0


# 13 -----------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute_forms(n):
    """Candidates by deletion: two words one edit apart share a word, or one with a letter less."""
    by = collections.defaultdict(set)
    for w in n:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by[cut].add(w)
    near = {w: {v for c in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in by[c] if one_edit(v, w)} for w in n}
    form = {}
    for w, k in n.items():
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * k else None
    out = []
    for w, k in n.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, k, len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def forms(frame, **more):
    return sorted(map(tuple, spelling.spelling_forms(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_spelling_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op13_spelling(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == brute_forms(brute_words(rows)) and any(r[1] for r in got)


@pytest.mark.parametrize("symbols", [1, 2, 7, None])
def test_spelling_of_dense_words(spark, symbols):
    rng = random.Random(2)
    words = {"".join(rng.choice("abÿ") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 30, 30, 400, 5000, 70_000]) for _ in range(500)}
    words["x" * 3000] = 5
    words["x" * 1500 + "y" + "x" * 1500] = 60
    words["x" * 2999] = 900
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = forms(frame, symbols=symbols)
    assert got == brute_forms(words)
    assert any(r[2] not in (r[0], r[1]) for r in got)  # chains of more than one form


def test_neighbourhoods_are_complete_and_single():
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(0, 6))) for _ in range(300)})
    for symbols in (2, 3, 5):
        reduced, keys = spelling.reduced_words(words, symbols), spelling.reduced_keys(words, symbols).tolist()
        name = dict(zip(keys, reduced))
        assert len(name) == len(set(reduced))
        found = collections.defaultdict(int)
        for i, near in spelling.neighbourhoods(words, symbols):
            for a, b in zip(i.tolist(), near.tolist()):
                if b in name:
                    found[a, b] += 1
        assert set(found.values()) == {1}
        pairs = {frozenset((reduced[a], name[b])) for a, b in found}
        assert pairs == {frozenset((a, b)) for a in set(reduced) for b in set(reduced) if a != b and one_edit(a, b)}


def test_spelling_of_odd_rows(spark):
    long = "Abcdefgh" * 20_000
    rows = [(1, None), (None, "letters letters LETTERS"), (2, ""), (3, long), (3, long), (4, "×÷×÷×÷× naïvetés 中文中文中文中文 letterſs"), (5, "no"), (6, "\U0001f600letters\U0001f600")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("w")).withColumn("n", F.lit(1))
    got = {r.word: r.n for r in spelling.slipped_words(frame).filter("n >= 2").collect()}
    assert got == brute_words(rows)
    assert spelling.slipped_words(frame.limit(0)).count() == 0
    assert forms(spark.createDataFrame([], "word string, n long")) == []
    odd = spark.createDataFrame([(None, 3), ("lettera", None), ("letters", 3), ("", 40), ("x", 4)], "word string, n long").withColumn("key", F.lit(0))
    assert forms(odd) == sorted([("", None, "", 40, 1, None), ("letters", None, "letters", 3, 0, None), ("x", "", "", 4, 1, 40)], key=str)
    with pytest.raises(ValueError):
        spelling.spelling_forms(odd, ratio=1)


# 1, 5, 6 ------------------------------------------------------------------------------------------


def test_mix_prefers_documents_of_quality(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), "id").alias("text"), F.lit("one").alias("source"), (F.col("id") % 2).cast("double").alias("score"))
    weights = (F.col("score"), F.lit(None), F.lit(7))
    good, null, high = (dict(mixing.mix(docs, share=0.25, quality=q).groupBy("score").agg(F.count(F.when(F.col("taken") > 0, 1))).collect()) for q in weights)
    assert 0.2 * good[1.0] < good[0.0] < 0.4 * good[1.0]  # the least weight is a quarter
    for same in (null, high):
        assert abs(same[0.0] - same[1.0]) < 100
    assert abs(sum(good.values()) - 1000) < 5


def test_tries_of_a_task_write_archives_of_their_own(spark, tmp_path):
    """local masters don't try tasks again, so the job is run again, with the order of rows turned."""
    rows = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string").withColumn("refers_to", F.lit(None).cast("long"))
    tries = [warc.write_archives(rows.orderBy(order).coalesce(1), f"file://{tmp_path}/{k}") for k, order in enumerate((F.asc("page_id"), F.desc("page_id")))]
    names = [{r.path.rsplit("/", 1)[1] for r in t.collect()} for t in tries]
    assert names[0].isdisjoint(names[1])
    for t in tries:
        assert sorted(int(r.record_id) for r in warc.read_archives(spark, t).collect()) == list(range(50))


def test_files_of_ids_have_the_number_of_the_try(spark, tmp_path):
    import public_tokenizers

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    tries = [token_ids.write_ids(docs, f"file://{tmp_path}/{k}", public_tokenizers.path("byte_bpe_50k.json")).collect() for k in range(2)]
    names = [{r.path.rsplit("/", 1)[1] for r in t} for t in tries]
    assert names[0].isdisjoint(names[1]) and [sum(r.docs for r in t) for t in tries] == [20, 20]
