"""Corpus operators against brute force, round trips and edge cases."""

import base64
import gzip
import hashlib
import heapq
import io
import itertools
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimloom.llm import decontaminate, fertility, mixing, near_dedup, quality_gam, queries, sharding, token_counts, token_ids, url_filter, warc

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, **more):
    rows = [(i, t, more.get("lang", "en"), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long = "word " * 30_000 + "ende"
    rows = [
        (1, None, None, None, None), (None, "one two three", "en", "a", 13), (None, None, None, None, None), (3, "", "xx", "b", 0), (4, long, "en", "a", len(long)),
        (5, "same text here again and again", "en", "a", 1), (5, "same text here again and again", "en", "a", 1), (6, "same text here again and again", "de", None, 1),
        (7, " \t\n ", "en", "b", 4), (8, "é ü  x\tlast\r\n", "fr", "é", 9), (9, "<|endoftext|> it's 2's\n\n  done", "en", "a", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").orderBy("doc_id").collect()]


# 1 ------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x"), (2, "http://b/\nz", "y"), (3, None, "x"), (4, "u", None), (5, "u", ""), (3, None, "x"), (7, "u", "é" * 100_000), (None, "u", "x"), (0, "u", "q")]
    got = {}
    for r in warc.archive_pages(pages(spark, rows)).collect():
        got.setdefault(r.page_id, []).append(r)
    for page_id, _, html in rows:
        body = (html or "").encode()
        r = got[page_id][0]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        firsts = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        assert r.record_type == ("response" if page_id == min(firsts) else "revisit")
        assert r.refers_to == (None if page_id == min(firsts) else min(firsts))
    assert sum(map(len, got.values())) == len(rows)
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_warc_archives_are_bounded(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    records = pages(spark, [(i, "u", f"page {i}") for i in range(40)]).coalesce(1).withColumn("refers_to", F.lit(None).cast("long"))
    manifest = warc.write_archives(records, f"file://{tmp_path}/warc")
    assert manifest.count() > 5 and manifest.agg(F.max("bytes")).first()[0] < 3000
    back = warc.read_archives(spark, manifest).collect()
    assert sorted((int(r.record_id), r.payload.decode()) for r in back) == [(i, f"page {i}") for i in range(40)]


def test_warc_small_payloads_stay_responses(spark):
    got = warc.archive_pages(pages(spark, [(1, "u", "ab"), (2, "u", "ab")]), min_payload_bytes=3).collect()
    assert [r.record_type for r in got] == ["response"] * 2


def test_warc_is_one_member_a_record_and_damage_is_found():
    good = b"".join(warc.gzip_member(warc.record_bytes(str(i), "u", b"payload" * i, None)) for i in range(3))
    assert len(list(warc.read_archive(io.BytesIO(good)))) == 3
    assert gzip.decompress(good).count(b"WARC/1.1\r\n") == 3
    bad = warc.record_bytes("1", "u", b"payload", None).replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    for data in (warc.gzip_member(bad), good[:-9], warc.gzip_member(good[:40])):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(data)))


# 2 ------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_quality_gam(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9
    bad, good = got[got.quality == 0].score, got[got.quality == 1].score
    auc = np.mean([np.mean((good > b) + 0.5 * (good == b)) for b in bad])
    assert auc > 0.93


def test_quality_interactions_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x, y, rounds=20, pairs=2)
    assert ((m.score(x) > 0.5) == y).mean() > 0.9  # no single feature says anything
    scored = quality_gam.score_quality(odd_documents(spark), spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert scored.count() == 11 and scored.filter("score IS NULL OR score NOT BETWEEN 0 AND 1").count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_gam.score_quality(odd_documents(spark).limit(0), none, F.lit(True)).count() == 0


# 3 ------------------------------------------------------------------------------------------------


def brute_jaccard(a, b):
    def weigh(text):
        w = SPACES.findall(text)
        k = min(5, len(w))
        out = {}
        for i in range(len(w) - k + 1 if w else 0):
            out[tuple(w[i : i + k])] = out.get(tuple(w[i : i + k]), 0) + 1
        return {s: 1 + np.log(n) for s, n in out.items()}

    x, y = weigh(a), weigh(b)
    every = set(x) | set(y)
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in every) for d in set(x) & set(y))


def brute_classes(texts, least=0.8):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if texts[i] == texts[j] or (texts[i] and texts[j] and brute_jaccard(texts[i], texts[j]) >= least - 1e-9):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_classes_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice((12, 60, 120)))]
        out.append(" ".join(base))
        for _ in range(9):
            w = list(base)
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += ["", "a b", "a b", " ", None, None, "one two three four five " * 4, "one two three four five " * 9]
    rng.shuffle(out)
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(documents(spark, out)).collect()}
    assert [got[i] for i in range(len(out))] == brute_classes(out)
    kept = {r.doc_id for r in near_dedup.deduplicated(documents(spark, out)).collect()}
    assert kept == set(got.values())


def test_near_members_of_a_bucket_apart_from_its_centre(spark):
    """A long chain: neighbours are alike, the ends are not."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[i : i + 160]) for i in range(0, 60, 4)]
    got = {r.class_id for r in near_dedup.near_classes(documents(spark, chain)).collect()}
    assert got == {0}


def test_signatures_estimate_similarity():
    a, b = "a b c d e f g h i j k l m n o p q r s t", "a b c d e f g h i j k l m n o p q r s x"
    s = near_dedup.signatures([near_dedup.shingles(a), near_dedup.shingles(b)], 4000)
    assert abs((s[0] == s[1]).mean() - brute_jaccard(a, b)) < 0.03
    assert abs(near_dedup.probability_jaccard(near_dedup.shingles(a * 3), near_dedup.shingles(b)) - brute_jaccard(a * 3, b)) < 1e-9


def test_near_odd_rows(spark):
    got = near_dedup.near_classes(odd_documents(spark)).collect()
    assert len(got) == 11 and len({r.class_id for r in got if r.doc_id in (5, 6)}) == 1
    extra = odd_documents(spark).withColumn("node", F.lit("x")).withColumn("text_hash", F.lit(1))
    assert near_dedup.deduplicated(extra).columns == extra.columns
    assert near_dedup.near_classes(odd_documents(spark).limit(0)).count() == 0


def test_near_keeps_one_row_a_class(spark):
    """Equal rows, null doc_ids and near copies under one doc_id."""
    odd = near_dedup.deduplicated(odd_documents(spark)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text and r.text[:1]) for r in odd) == [
        (-1, "o"), (1, None), (3, ""), (4, "w"), (5, "s"), (7, " "), (8, "é"), (9, "<"),
    ]
    words = [f"w{i}" for i in range(100)]
    near = [" ".join([*words[:-1], f"x{i}"]) for i in range(4)]
    rows = [(5, t, "en", s, 1) for t in near for s in "ab"] + [(None, f"only null ids {i}", "en", "a", 1) for i in (0, 0, 1)] + [(None, near[0], "en", "a", 1)]
    got = near_dedup.deduplicated(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "None", "None"]
    assert {r.text for r in got if r.doc_id is None} == {"only null ids 0", "only null ids 1"}


# 4 and 5 ------------------------------------------------------------------------------------------


def tokenizer(special_as_text=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = special_as_text
    return t


def test_edited_counts_match_full_encoding(texts):
    rng = random.Random(4)
    counter, full = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken")), tokenizer(special_as_text=True)
    spices = ["", "x", " ", "  \n", "'s", "12 a", "é ü", "word word ", "\t\n  q", "!!!"]
    for text in [t[:3000] for t in texts[:40]] + ["", " ", "\n\n", "a", "it's  2 b"]:
        tree = token_counts.Tree(text, counter)
        for _ in range(25):
            at, gone, new = rng.randrange(len(text) + 2), rng.choice((0, 0, 1, 3, 40)), rng.choice(spices)
            tree.replace(at, gone, new)
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text
            assert tree.tokens == len(full.encode(text, add_special_tokens=False).ids)


def test_kept_trees_through_rounds_of_edits(spark, texts):
    """Trees are stored after each round; what an edit doesn't touch isn't read."""
    rng, file, full = random.Random(6), public_tokenizers.path("byte_bpe_50k.tiktoken"), tokenizer(special_as_text=True)
    now = {i: t[:4000] for i, t in enumerate(texts[:20])} | {20: "", 21: "\n\nab \n\n" * 40, 22: "x" * 5000 + " y"}
    trees = token_counts.common.stored(token_counts.build_trees(documents(spark, list(now.values())).withColumn("cuts", F.lit(1)), file), "trees")
    for _ in range(3):
        rows = []
        for i in rng.sample(sorted(now), 8):
            for seq in range(rng.randrange(1, 5)):
                at, gone, new = rng.randrange(len(now[i]) + 2), rng.choice((0, 2, 30, 700)), rng.choice(["", "q", "  ", "\n", "é'll 12", "new words " * 600])
                rows.append((i, seq, at, gone, new))
                at = min(at, len(now[i]))
                now[i] = now[i][:at] + new + now[i][at + gone :]
        rng.shuffle(rows)
        edits = spark.createDataFrame([*rows, (None, 0, 0, 0, "x"), (99, 0, 0, 0, "x")], "doc_id long, seq int, pos int, deleted int, inserted string")
        trees = token_counts.common.stored(token_counts.apply_edits(trees, edits, file), "trees")
        got = {r.doc_id: r for r in trees.collect()}
        assert len(got) == len(now)
        for i, text in now.items():
            assert "".join(got[i].leaves) == text and got[i].n_tokens == len(full.encode(text, add_special_tokens=False).ids) == sum(got[i].tokens)
            assert got[i].n_edits == sum(r[0] == i for r in rows) and (got[i].n_edits or not got[i].n_reencoded)
    tree = token_counts.Tree("many words in a text " * 2000, token_counts.Counter(file))
    chars, tokens, leaves, cuts = tree.row()
    kept = token_counts.Tree.kept(chars, tokens, list(zip(pa.array(leaves), pa.array(cuts))), tree.counter)
    for at in (0, 20_000, 20_010, 41_000):
        kept.replace(at, 3, "edited")
    assert sum(x is not None for x in kept.leaves) <= 8 and kept.encoded < 60


def test_edited_counts_of_odd_rows(spark):
    d = odd_documents(spark).withColumn("edits", F.when(F.col("doc_id") != 3, token_counts.derived_edits()))
    got = token_counts.count_edits(d, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == 11
    assert token_counts.count_edits(d.limit(0), public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def expected_ids(rows):
    t, start, out = tokenizer(), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def check_encoder(encode, texts):
    t = tokenizer()
    ids, n = encode(pa.array(texts, pa.string()))
    ends = np.cumsum(n)
    assert len(ids) == (ends[-1] if len(texts) else 0)
    for text, a, b in zip(texts, ends - n, ends):
        assert list(ids[a:b]) == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encoder_is_the_library(texts, monkeypatch):
    """Words encoded once against whole texts: all kinds of characters and of white space."""
    encode = token_ids.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(encode(pa.array(["hello <|endoftext|> world"]))[0]) == [31373, 220, 50256, 995]
    check_encoder(encode, texts[:60])
    rng = random.Random(5)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    marks = ["a", "it's", "12", "!!", "<|endoftext|>", "é", "ß,", "don't", "x\n", " ", " ", "\n", "  ", "\n\n", " \n", "\n ", "\t", "\r"]
    check_encoder(encode, ["", None, " ", "\n", " a", "\na", "a ", "a\n", "\n\n", " \n", "\ra", "  a", "a  b"])
    check_encoder(encode, ["".join(rng.choice(rng.choice((marks, [" "], every))) for _ in range(rng.randrange(12))) for _ in range(3000)])
    monkeypatch.setattr(token_ids, "CACHE_WORDS", 300)  # forgets, and keeps what is frequent
    for i in range(0, 60, 10):
        check_encoder(encode, texts[i : i + 10])
    monkeypatch.setattr(token_ids, "CACHE_CHARS", 10)
    check_encoder(encode, texts[:3])
    check_encoder(encode, texts[:3])


def test_long_texts_are_put_together():
    starts, lengths = np.array([4, 0, 2, 2]), np.array([2, 1, 0, 3])
    for step in (1, 2, 100):
        assert list(token_ids._gather(np.arange(10), starts, lengths, step)) == [4, 5, 0, 2, 3, 4]


def test_ids_themselves(spark, texts, monkeypatch, tmp_path):
    monkeypatch.setattr(token_ids, "FILE_IDS", 3000)
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 1000)
    manifest = token_ids.write_ids(documents(spark, texts[:40]), f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"), end_id=7, partitions=2)
    assert manifest.count() > 4 and manifest.agg(F.sum("docs")).first()[0] == 40
    t = tokenizer()
    for r in token_ids.read_ids(spark, manifest, "bigint", ids=True).collect():
        assert r.ids == [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 7]


@pytest.mark.parametrize("odd", [False, True])
def test_ids_round_trip(spark, texts, odd, monkeypatch, tmp_path):
    monkeypatch.setattr(token_ids, "BLOCK_IDS", 5000)
    docs = odd_documents(spark) if odd else documents(spark, texts[:120])
    manifest = token_ids.write_ids(docs, f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"), partitions=3)
    got = token_ids.read_ids(spark, manifest, "bigint", blocks_per_task=2).collect()
    want = expected_ids([(r.doc_id, r.text) for r in docs.collect()])
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == want


def test_ids_of_nothing(spark, tmp_path):
    manifest = token_ids.write_ids(documents(spark, []), f"file://{tmp_path}/ids", public_tokenizers.path("byte_bpe_50k.json"))
    assert token_ids.read_ids(spark, manifest, "bigint").count() == 0


def test_blocks_and_damage():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.geometric(0.01, 9000), 50_000).astype(np.uint32)
    table = token_ids.Frequencies.counted(*np.unique(ids, return_counts=True))
    again = token_ids.Frequencies.from_bytes(table.to_bytes())
    for n in (1, 5, 1023, 1024, 1025, 9000):
        assert (token_ids.decode_block(token_ids.encode_block(ids[:n], table), n, again) == ids[:n]).all()
    out = io.BytesIO()
    w = token_ids.FileWriter(out, table)
    w.add(token_ids._ipc(pa.table({"doc": [1, 2], "n": [8000, 1000]})), ids)
    assert w.close() == (2, 9000)
    data = bytearray(out.getvalue())

    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    ((docs, back),) = token_ids.decode_groups(Source(bytes(data)))
    assert (back == ids).all() and docs.to_pydict() == {"doc": [1, 2], "n": [8000, 1000]}
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError):
        list(token_ids.decode_groups(Source(bytes(data))))


# 6 ------------------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * w[s] / sum(w[t] for t in free) for s in free}
        over = [s for s in free if got[s] > cap * sizes[s]]
        if not over:
            return fixed | got
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.orderBy(F.desc("doc_id"))).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    assert list(got.sort_values("doc_id")["size"]) == [len(SPACES.findall(t)) for t in docs.orderBy("doc_id").toPandas().text]
    got["source"] = got.source.where(got.source.notna(), None)
    sizes = {(None if s is None or s != s else s): int(g["size"].sum()) for s, g in got.groupby("source", dropna=False)}
    want = brute_targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert abs(g.target.iloc[0] - want[s]) < 1e-6 * want[s] + 1e-9
        assert abs(g.taken.sum() - want[s]) <= g["size"].max()
        assert (g.taken <= 2 * g["size"]).all()
        assert (g.taken % g["size"].clip(lower=1) == 0).all()


def test_mix_odd_rows(spark):
    extra = odd_documents(spark).withColumn("size", F.lit("x")).withColumn("_key", F.lit(1))
    assert mixing.mixed(extra).columns == extra.columns
    got = mixing.mix(extra).collect()
    assert len(got) == 11 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(odd_documents(spark).limit(0)).count() == 0 and mixing.mixed(odd_documents(spark).limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------


def test_url_filter_against_brute_force(spark):
    rng = random.Random(7)
    hosts = ["a.com", "www.a.com", "x.a.com", "y.x.a.com", "b.org", "c.net:80", "user@d.io"]
    caps = [(i, rng.choice(["http://", "https://"]) + rng.choice(hosts) + rng.choice(["", "/", "/p/q", "/r?x"]), rng.randrange(100)) for i in range(200)] + [(200, None, 5), (201, "nohost", 5), (202, "http://a.com/", None)]
    entries = [(rng.choice(["a.com", "x.a.com", "b.org", "b.org/p", "c.net", "d.io", None]), rng.choice(["allow", "block", "remove"]), rng.randrange(100)) for _ in range(40)]
    day = lambda c: F.timestamp_seconds(c * 86_400)
    cdf = spark.createDataFrame(caps, "page_id long, url string, t long").select("page_id", "url", day(F.col("t")).alias("fetched_at"))
    edf = spark.createDataFrame(entries, "pattern string, action string, t long").select("pattern", "action", day(F.col("t")).alias("listed_at"))
    got = {r.page_id: r for r in url_filter.filter_urls(cdf, edf).collect()}

    def brute(url, t):
        m = re.match(r"[A-Za-z]\w*://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(/[^/?#]+)?", url or "")
        if not m or t is None:
            return None
        host = m[1].removeprefix("www.")
        labels = host.split(".")
        keys = ([host + m[2]] if m[2] else []) + [host] + [".".join(labels[i:]) for i in range(1, len(labels) - 1)]
        for k in keys:
            past = [(at, act) for p, act, at in entries if p == k and at <= t]
            if past and max(past)[1] != "remove":
                return k, max(past)[1]
        return None

    for i, url, t in caps:
        want = brute(url, t)
        assert (got[i].pattern, got[i].action) == (want or (None, None)), (url, t)
        assert got[i].kept == (not want or want[1] != "block")
    assert url_filter.filter_urls(cdf.limit(0), edf).count() == 0
    assert url_filter.filter_urls(cdf, edf.limit(0)).filter("kept").count() == len(caps)


def test_url_filter_of_repeated_captures_and_clashing_columns(spark):
    """A row per row, also of equal ones and of one page at two times; other columns of both sides don't count."""
    day = lambda c: F.timestamp_seconds(c * 86_400)
    caps = [(1, "http://a.com/", 5), (1, "http://a.com/", 5), (1, "http://a.com/", 1), (1, "http://b.org/", 5), (None, "http://a.com/", 5), (None, "http://a.com/", 5), (2, "", 5)]
    entries = [("a.com", "block", 3), ("a.com", "block", 3), ("a.com", "allow", 3), ("b.org", "block", 5), ("", "block", 1)]
    own = ("pattern", "action", "listed_at", "valid_from", "valid_to", "period", "rank", "_row", "_end", "best", "kept")
    cdf = spark.createDataFrame(caps, "page_id long, url string, t long").select("page_id", "url", day(F.col("t")).alias("fetched_at"), *[F.lit(i).alias(c) for i, c in enumerate(own)])
    edf = spark.createDataFrame(entries, "pattern string, action string, t long").select("pattern", "action", day(F.col("t")).alias("listed_at"), *[F.lit("x").alias(c) for c in ("page_id", "url", "fetched_at", "period", "valid_to", "_end")])
    found = url_filter.filter_urls(cdf, edf)
    assert found.columns == ["page_id", "url", "fetched_at", "pattern", "action", "listed_at", "kept"]
    got = sorted((r.page_id or 0, r.url, r.fetched_at.day - 1, r.pattern, r.action, r.kept) for r in found.collect())
    # of two entries of one time the greatest action holds; an entry holds from its own time on
    blocked = ("a.com", "block", False)
    want = [(0, "http://a.com/", 5, *blocked)] * 2 + [(1, "http://a.com/", 5, *blocked)] * 2 + [(1, "http://a.com/", 1, None, None, True), (1, "http://b.org/", 5, "b.org", "block", False), (2, "", 5, None, None, True)]
    assert got == sorted(want, key=lambda r: r[:3])


# 8 ------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = SPACES.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if SPACES.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(inside)


def test_base_counts(spark, texts):
    for t in [*(t for t in texts if len(t) < 4000), None, "", "a a a a", "a\na\n \n \n \n ", "x\x1cy\x85z", "|<>#"]:
        assert fertility.base_counts(t) == brute_counts(t)
    got = fertility.judge(odd_documents(spark).withColumn("kept", F.lit(5)), public_tokenizers.path("piece_bpe_32k.model"))
    rows = got.collect()
    assert len(rows) == 11 and not any(r.kept for r in rows if not r.text)
    assert fertility.judge(odd_documents(spark).limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_fertility_measures_are_those_of_the_whole_text(texts):
    f = fertility.Fertility(public_tokenizers.path("piece_bpe_32k.model"))
    for t in texts[:60]:
        ids = f.model.encode(" ".join(SPACES.findall(t)))
        chars, share, _ = f.measure(t)
        assert abs(chars - sum(map(len, SPACES.findall(t))) / len(ids)) < 1e-9
        assert abs(share - sum(f.model.is_byte(i) for i in ids) / len(ids)) < 1e-9


def test_script_is_that_of_the_whole_text(spark):
    """A layout in step with a stride: each third character is of another script."""
    text = "жab" * 2000
    assert fertility.script_of(text) == fertility.script_of("жab") == "latin"
    assert fertility.script_of("aжж" * 2000) == fertility.script_of("aжж") == "other"
    assert fertility.script_of("aж" * 5000) == fertility.script_of("") == "latin"  # half is enough


def test_fertility_keeps_good_and_rejects_marked_texts(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_fertility(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.9


# 9 ------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = low(text), set(), set()
    for item, t in items:
        b = low(t)
        m = min(13, len(b))
        for i in range(len(b) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == b[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("group_chars", [10**9, 60])
def test_contamination_against_brute_force(spark, group_chars):
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choices(["aa", "B", "cé", "d9"], k=n))
    items = [(i, make(n)) for i, n in enumerate((1, 2, 3, 12, 13, 14, 20, 30, 30))] + [(9, None), (10, "..."), (11, "aa B, aa-cé")]
    items += [(12, items[7][1]), (12, items[4][1]), (5, None)]
    texts = [make(rng.randrange(60)) for _ in range(30)] + [None, "", f"x {items[6][1].upper()}, y", f"{items[7][1]} {items[8][1]}"]
    items = [x for x in items if x[0] not in (0, 1)] + [(13, "zz"), (14, "aa zz")]
    docs = documents(spark, texts).withColumn("n_hit", F.lit("clash"))
    items = [(f"{i},{i}" if i % 2 else str(i), t) for i, t in items] + [(None, texts[0])]  # ids with commas
    got = {r.doc_id: r for r in decontaminate.find_contamination(docs, spark.createDataFrame(items, "item_id string, text string"), group_chars=group_chars).collect()}
    items.pop()
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_hits(t, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(odd_documents(spark), none).count() == 11
    assert decontaminate.find_contamination(docs, none).filter("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


def test_search_skips_and_compares():
    """Long items among frequent words, against all windows."""
    rng = random.Random(10)
    make = lambda n: " ".join(rng.choices(["of", "the", "a", "x", "y9"], k=n))
    items = [(str(i), make(40)) for i in range(30)] + [("again", "of the " * 40), ("again", make(13))]
    texts = [make(300) for _ in range(20)] + [f"{make(20)} {t[4:60]} {make(20)}" for _, t in items]
    found = decontaminate.Searches(items).search([t.encode() for t in texts])
    for text, (n, hit, own) in zip(texts, found):
        want = brute_hits(text, items)
        assert (n, int(hit.sum()), len(own)) == want[:3] and hashlib.sha256(",".join(sorted(own)).encode()).hexdigest() == want[3]


def test_search_tables_are_small():
    """Memory of the tables per character of a benchmark of different words, measured."""
    rng = random.Random(11)
    items = [(str(i), " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(200))) for i in range(500)]
    s = decontaminate.Searches(items)
    arrays = sum(a.nbytes for t in s.tables for a in (t.suffix, t.whole, t.at, t.items, t.keys, t.shift)) + s.tables[0].ids.nbytes
    assert arrays / sum(len(t) for _, t in items) < 12


# 10 -----------------------------------------------------------------------------------------------


def test_shards(spark, texts):
    docs = documents(spark, texts + texts[:7] + [None, ""])
    got = sharding.assign(docs, bundles_per_shard=64).toPandas()
    assert (got["size"] == [len((t or "").encode()) + 1 for t in got.text]).all()
    assert (got.text_crc32 == [zlib.crc32((t or "").encode()) for t in got.text]).all()
    assert (got.groupby(got.text.fillna("")).shard.nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    loads = got.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() <= loads.mean() + got.groupby(got.text.fillna(""))["size"].sum().max()


def test_schedule_is_longest_first():
    sizes = [(i, s) for i, s in enumerate([7, 5, 5, 4, 4, 3, 1])]
    loads = [0] * 3
    for _, s in sizes:
        loads[loads.index(min(loads))] += s
    where = sharding.schedule(sizes, 3)
    got = [sum(s for k, s in sizes if where[k] == x) for x in range(3)]
    assert sorted(got) == sorted(loads)
    assert heapq.nsmallest(1, got)


def test_shards_of_odd_rows(spark):
    assert sharding.assign(odd_documents(spark).withColumn("slot", F.lit("x")).withColumn("g", F.lit(1))).count() == 11
    assert sharding.assign(odd_documents(spark).limit(0)).count() == 0


# pipeline -----------------------------------------------------------------------------------------


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter(F.length("text") < 4000)
    rows = docs.collect()
    model = fertility.Fertility(public_tokenizers.path("piece_bpe_32k.model"))
    keep = [r for r in rows if (c := brute_counts(r.text))[0] >= 50 and 100 * c[4] <= 50 * c[0] and fertility.accepted(model.measure(r.text), fertility.BANDS[r.lang])]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_rules"](spark, docs, DATA)
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in keep} and one.columns == docs.columns
    classes = brute_classes([r.text for r in keep])
    two = stage["near_duplicates"](spark, one, DATA)
    firsts = {}
    for r, c in zip(keep, classes):
        firsts[c] = min(firsts.get(c, r.doc_id), r.doc_id)
    assert {r.doc_id for r in two.collect()} == set(firsts.values())
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in keep if r.doc_id in set(firsts.values()) and not brute_hits(r.text, items)[4]}
    three = stage["decontamination"](spark, two, DATA)
    assert {r.doc_id for r in three.collect()} == clean
    four = stage["source_mix"](spark, three, DATA)
    words = four.agg(F.sum(mixing.word_count())).first()[0]
    total = three.agg(F.sum(mixing.word_count())).first()[0]
    assert abs(words - 1.5 * total) < 0.2 * total
    five = stage["shards"](spark, four, DATA)
    assert five.count() == four.count()
