"""Near-duplicate documents by ProbMinHash on weighted word shingles, banding and verification.

1. A text's shingles (five words) weigh 1 + ln(count).  Each shingle sends points of its own Poisson
   process, of rate its weight, to random signature slots; a slot keeps the shingle whose point came
   first.  Arrivals stop when every slot has a point that no later arrival can beat.  Two signatures
   agree in a slot with the probability Jaccard similarity.
2. Slots are banded; texts that agree in a band are candidates.  A bucket isn't expanded into pairs:
   its members are compared with its smallest member.  Members that this leaves apart are compared
   with the bucket's others block by block, inside a task, and only links leave it.
3. Candidates are verified on whole texts, by the exact probability Jaccard similarity.
4. Classes are the connected components; equal texts are one node from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common
from claimloom.operators.graph import connected_components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 32 bands of 6 slots miss a pair at similarity 0.8 with a chance of 6e-5, and at 0.85 of 3e-7.
BANDS, BAND_SLOTS = 32, 6
#: Bytes of shingles, on average, of a block of members that are compared in one task.
BLOCK_BYTES = 256_000

#: Texts that a task remembers as signed already, so that copies in its rows are signed once.
SEEN = 200_000

#: What rounding may take from a similarity.
SLACK = 1e-9

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: 64 well-mixed bits for each 64-bit number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words as bytes, kept for up to ``most`` words."""

    most = 100_000

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        self[word] = out = hashlib.blake2b(word, digest_size=8).digest()
        return out


_HASHES = _WordHashes()


def shingles(text: str | bytes | None, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text (or its UTF-8 bytes) as sorted 64-bit hashes, and their weights.  A
    text of fewer than k words, but not none, is one shingle; null or a text without words has none."""
    words = (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").split()  # at ASCII white space
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    w = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64)
    k = min(k, len(w))
    h = mixed_bits(w[: len(w) - k + 1])
    for i in range(1, k):
        h = mixed_bits(h + w[i : len(w) - k + 1 + i])
    distinct, counts = np.unique(h, return_counts=True)
    return distinct, 1 + np.log(counts)


def _times_gold(r: np.ndarray) -> np.ndarray:
    return r.astype(np.uint64) * _GOLD


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], slots: int) -> np.ndarray:
    """A row of ``slots`` shingle hashes for each weighted set; sets must not be empty.

    All sets advance together: each round draws the next arrivals of every shingle still in play, at
    its time so far plus exponential gaps, for slots drawn by hash.  A shingle is out once its time
    passes the latest first arrival among the set's slots.  Few shingles draw more at a time.
    """
    d = np.concatenate([s for s, _ in sets])
    rate = np.concatenate([w for _, w in sets])
    owner = np.repeat(np.arange(len(sets)) * slots, [len(s) for s, _ in sets])
    best = np.full(len(sets) * slots, np.inf)
    kept = np.zeros(len(sets) * slots, np.uint64)
    time = np.zeros(len(d))
    drawn = 0
    while len(d):
        n = max(1, min(64, 4096 // len(d)))
        r = np.arange(drawn + 1, drawn + 1 + n)
        drawn += n
        bits = mixed_bits(d[:, None] + _times_gold(2 * r))
        gaps = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / rate[:, None]
        times = time[:, None] + np.cumsum(gaps, 1)
        slot = ((mixed_bits(d[:, None] + _times_gold(2 * r + 1)) >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        at = (owner[:, None] + slot.astype(np.int64)).reshape(-1)
        flat = times.reshape(-1)
        np.minimum.at(best, at, flat)
        won = np.flatnonzero(best[at] == flat)
        kept[at[won]] = d[won // n]
        time = times[:, -1]
        still = np.flatnonzero(time < best.reshape(-1, slots).max(1)[owner // slots])
        d, rate, owner, time = d[still], rate[still], owner[still], time[still]
    return kept.reshape(-1, slots)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The exact probability Jaccard similarity of two weighted sets: the sum over shared d of
    1 / sum over all e of max(a_e / a_d, b_e / b_d).  Two empty sets have 0."""
    (ka, wa), (kb, wb) = a, b
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia], wb[ib]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    ratio, x, y = ratio[order], x[order], y[order]
    # for a shared d with ratio t = b_d / a_d, e counts a_e if b_e / a_e <= t and b_e / t otherwise
    upto = np.searchsorted(ratio, ratio, side="right")
    cx, cy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    total = (only_a + cx[upto]) + (only_b + cy[-1] - cy[upto]) / ratio
    return float((x / total).sum())


def _signed(batch: pa.RecordBatch, slots: int, seen: set) -> Iterator[tuple[list, list, np.ndarray]]:
    """(nodes, weighted sets, signatures) of the texts with words in a batch of (node, text), copies once.
    ``seen`` has the nodes of the task's batches before, and is emptied once it is full."""
    nodes, texts, at = batch.column(0), batch.column(1).cast(pa.binary()), 0
    while at < len(nodes):
        sets, own, held = [], [], 0
        while at < len(nodes) and held < 200_000:
            node = nodes[at].as_py()
            if node not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                s = shingles(texts[at].as_py())
                if len(s[0]):
                    sets.append(s)
                    own.append(node)
                    held += len(s[0]) + slots
            at += 1
        if sets:
            yield own, sets, signatures(sets, slots)


def _band_hashes(signed: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit hash for each text and band."""
    sig = signed.reshape(len(signed), bands, -1)
    h = np.broadcast_to(_times_gold(np.arange(1, bands + 1)), sig.shape[:2])
    for i in range(sig.shape[2]):
        h = mixed_bits(h + sig[:, :, i])
    return h.view(np.int64)


def bands_of(texts: DataFrame, bands: int, band_slots: int) -> DataFrame:
    """(bucket, node): a row per band of each text of (node, text) that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for own, _, signed in _signed(batch, bands * band_slots, seen):
                which = pa.array(np.repeat(np.arange(len(own), dtype=np.int32), bands))
                yield pa.RecordBatch.from_arrays([pa.array(_band_hashes(signed, bands).reshape(-1)), pa.array(own, pa.binary()).take(which)], ["bucket", "node"])

    common.bounded_batches(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(run, "bucket long, node binary")


def sketches_of(texts: DataFrame, bands: int, band_slots: int) -> DataFrame:
    """(node, sketch, bands, shingles, counts): a byte for each slot, the band hashes, and the weighted set
    as arrays of 64-bit hashes and 64-bit weights, all as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, sets, signed in _signed(batch, bands * band_slots, set()):
                parts = [own, [x.tobytes() for x in mixed_bits(signed).astype(np.uint8)], [x.tobytes() for x in _band_hashes(signed, bands)], [d.tobytes() for d, _ in sets], [w.tobytes() for _, w in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in parts], ["node", "sketch", "bands", "shingles", "weights"])

    common.bounded_batches(texts.sparkSession)
    return texts.select("node", "text").mapInArrow(run, "node binary, sketch binary, bands binary, shingles binary, weights binary")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose texts are at least as similar.  A text may be in many pairs:
    both joins have one text a node on the right, and split a node with very many pairs."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sb = None, None
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("_ta"), batch.column("_tb")):
                tb = tb.as_py()
                if tb != last:
                    last, sb = tb, shingles(tb)
                keep.append(probability_jaccard(shingles(ta.as_py()), sb) >= similarity - SLACK)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    one = common.spread_join(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("_ta")), "a")
    two = common.spread_join(one, texts.select(F.col("node").alias("b"), F.col("text").alias("_tb")), "b")
    return two.select(*names, "_ta", "_tb").mapInArrow(run, pairs.schema)


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, band_slots: int = BAND_SLOTS) -> DataFrame:
    """(doc_id, class_id, class_size, node): a row per row of ``docs``; class_id is the smallest doc_id of the class.

    Equal texts share a class whatever they hold; other texts are linked at ``similarity`` or more.
    A text without words has no links.  Null texts count as equal to each other and to no other.
    A null doc_id gets its class by its text; a class of null doc_ids alone has a null class_id.
    Rows that repeat a doc_id with another text are classed by text.
    """
    return _classes(docs, similarity, bands, band_slots).select("doc_id", "class_id", "class_size", "node")


def _classes(docs: DataFrame, similarity: float, bands: int, band_slots: int) -> DataFrame:
    """``near_classes`` and the component, which tells classes of null doc_ids apart."""
    node = F.unhex(F.md5(F.col("text")))
    d = docs.select("doc_id", F.coalesce(node, F.unhex(F.lit("00"))).alias("node"), "text")
    ids = common.stored(d.select("doc_id", "node"), "near-ids")

    found = bands_of(d.filter(F.col("text").isNotNull()), bands, band_slots)
    found = common.stored(found.distinct(), "near-bands")
    buckets = found.groupBy("bucket").agg(F.min("node").alias("centre"), F.count("*").alias("members")).filter("members > 1")
    shared = common.stored(common.spread_join(found, buckets, "bucket"), "near-buckets")
    star = shared.filter(F.col("node") != F.col("centre"))
    nodes = shared.select("node").distinct()
    texts = common.spread_join(d.drop("doc_id"), nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = common.stored(texts, "near-texts")

    # each text and the centre that it meets most often
    first = star.groupBy("node", "centre").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("centre", F.struct("n", "centre")).alias("centre"))
    tried = common.stored(first.select(F.col("node").alias("a"), F.col("centre").alias("b")), "near-tried")
    label = common.stored(connected_components(common.stored(verified(tried, texts, similarity), "near-edges"), "a", "b"), "near-labels")

    # the other centres, then members of a bucket that are still apart
    rest = star.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    label = _joined(label, verified(_apart(rest, label), texts, similarity))
    label = _joined(label, _links_within(shared, label, texts, similarity, bands, band_slots))

    firsts = ids.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    named = common.stored(_component(firsts, "node", label, "component"), "near-named")
    classes = named.groupBy("component").agg(F.min("first").alias("class_id"), F.sum("rows").alias("class_size"))
    named = common.spread_join(named.select("node", "component"), classes, "component").select("node", "component", "class_id", "class_size")
    return common.spread_join(ids, named, "node")


def _component(df: DataFrame, column: str, label: DataFrame, out: str) -> DataFrame:
    names = label.select(F.col("id").alias(column), F.col("component").alias(out))
    joined = common.spread_join(df, names, column, "left")
    return joined.withColumn(out, F.coalesce(out, column))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` after ``links`` between its components (ca, cb): only these are put together anew."""
    links = common.stored(links.select("ca", "cb").distinct(), "near-edges")
    if links.isEmpty():
        return label
    more = connected_components(links, "ca", "cb")
    moved = _component(label, "component", more, "_up").select("id", F.col("_up").alias("component"))
    return common.stored(moved.unionByName(more.join(label, "id", "left_anti")), "near-labels")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``label`` has not in one component, and their components (ca, cb)."""
    both = _component(_component(pairs, "a", label, "ca"), "b", label, "cb")
    return both.filter(F.col("ca") != F.col("cb")).select("a", "b", "ca", "cb")


def _links_within(shared: DataFrame, label: DataFrame, texts: DataFrame, similarity: float, bands: int, band_slots: int) -> DataFrame:
    """Links between members of a bucket that lie in different components, as pairs of these (ca, cb).

    Of a bucket in several components, blocks of the members outside the largest one meet blocks of
    all; a row is a pair of blocks, and pairs of blocks are dealt out one by one.  Inside, a pair of
    members is looked at in the first band that it shares; where signatures agree to within 4
    standard deviations of ``similarity``, the sets decide.
    """
    slots = bands * band_slots
    near = similarity - 4 * (similarity * (1 - similarity) / slots) ** 0.5
    own = common.stored(_component(shared.filter("members > 2"), "node", label, "part"), "near-parts")
    parts = own.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    split = parts.groupBy("bucket").agg(F.max_by("part", F.struct("n", "part")).alias("largest"), F.count("*").alias("k")).filter("k > 1")
    own = common.stored(common.spread_join(own, split.select("bucket", "largest"), "bucket"), "near-split")
    needed = common.spread_join(texts, own.select("node").distinct(), "node", "left_semi")
    sketches = common.stored(sketches_of(needed, bands, band_slots), "near-sketches")
    sizes = common.spread_join(own.select("bucket", "node"), sketches.select("node", F.octet_length("shingles").alias("bytes")), "node")
    blocks = sizes.groupBy("bucket").agg(F.greatest(F.ceil(F.sum("bytes") / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    own = common.spread_join(common.spread_join(own, blocks, "bucket"), sketches, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")
    member = F.struct("node", "part", "sketch", "bands", "shingles", "weights").alias("m")
    own = common.stored(own.select("bucket", block, "part", "largest", member), "near-members")
    few = own.filter(F.col("part") != F.col("largest")).groupBy("bucket", F.col("block").alias("x")).agg(F.collect_list("m").alias("few"))
    many = own.groupBy("bucket", F.col("block").alias("y")).agg(F.collect_list("m").alias("many"))
    meet = own.filter(F.col("part") != F.col("largest")).select("bucket", F.col("block").alias("x")).distinct()
    meet = meet.join(own.select("bucket", F.col("block").alias("y")).distinct(), "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, left, right in zip(*batch.columns):
                a, b = _Members(left.values), _Members(right.values)
                band = int(np.flatnonzero(b.bands[0] == bucket.as_py())[0])
                found = set()
                for i, part in enumerate(a.parts):
                    agree = ((b.sketch == a.sketch[i]).mean(1) * 256 - 1) / 255
                    at = np.flatnonzero(agree >= near)
                    at = at[(b.bands[at] == a.bands[i]).argmax(1) == band]
                    for j in at:
                        link = (max(part, b.parts[j]), min(part, b.parts[j]))
                        if part != b.parts[j] and link not in found and probability_jaccard(a.set(i), b.set(j)) >= similarity - SLACK:
                            found.add(link)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], ["ca", "cb"])

    # wide rows go from the last join straight into Python, a few at a time
    pairs = meet.join(few, ["bucket", "x"]).join(many, ["bucket", "y"])
    return pairs.select("bucket", "few", "many").mapInArrow(run, "ca binary, cb binary")


class _Members:
    """A block of members, as arrays."""

    def __init__(self, members: pa.StructArray) -> None:
        rows = lambda name, kind: np.frombuffer(b"".join(members.field(name).to_pylist()), kind).reshape(len(members), -1)
        self.nodes, self.parts = members.field("node").to_pylist(), members.field("part").to_pylist()
        self.sketch, self.bands = rows("sketch", np.uint8), rows("bands", np.int64)
        self.shingles, self.weights = members.field("shingles"), members.field("weights")

    def set(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self.shingles[i].as_py(), np.uint64), np.frombuffer(self.weights[i].as_py(), np.float64)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class of ``docs``: of the smallest doc_id (null if there is no other), of its texts the
    first by MD5, and of rows equal in both the first by the MD5 of the row as JSON.  Null texts are a class
    like any other."""
    classes = _classes(docs, similarity, BANDS, BAND_SLOTS)
    rows = classes.groupBy("component", "doc_id", "node").agg(F.count("*").alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("f"))
    keep = common.stored(first.select("f.doc_id", "f.node", "f.n"), "near-kept")
    names = docs.columns
    d = docs.select(F.struct(*[f"`{c}`" for c in names]).alias("_row"), "doc_id", F.coalesce(F.unhex(F.md5("text")), F.unhex(F.lit("00"))).alias("node"))
    k = keep.select(F.col("doc_id").alias("_d"), F.col("node").alias("_n"), "n")
    kept = d.join(k, d["doc_id"].eqNullSafe(k["_d"]) & (d["node"] == k["_n"]))
    if not keep.filter("n > 1").isEmpty():
        again = kept.filter("n > 1").groupBy("_d", "_n").agg(F.min_by("_row", F.md5(F.to_json("_row"))).alias("_row"))
        kept = kept.filter("n = 1").select("_row").unionByName(again.select("_row"))
    return kept.select([F.col(f"_row.`{c}`").alias(c) for c in names])
