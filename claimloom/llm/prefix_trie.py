"""The prefix trie of conversations: which turns they share, and what storing shared turns once would save.

Turns become ids.  Conversations are dealt out as ranges of their sequences of ids, so that a node's
conversations stand side by side, in one shard or in neighbouring ones.  In a shard, matrices of padded
ids are sorted column by column; where a column or one before it changes, a node starts, and reduceat adds
up each depth.  Only the nodes on the paths of a shard's first and last conversation can go on in
another shard; these few are put together in a second step.

One conversation is one row: 20 bytes a turn have to fit into a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm import common

#: Turns of a shard, about; a conversation counts one more.
SHARD_TURNS = 50_000
#: Columns of a matrix.
WIDTH = 32
#: Conversations in a chunk of those that end at a node of several shards.
CHUNK_IDS = 4_096

NO_ENDS = hashlib.sha256(b"").hexdigest()
PATH = "array<struct<hi:bigint,lo:bigint,bytes:bigint>>"
INNER, SHARED, ENDS = 0, 1, 2
_PARTS = (
    "kind int, shard int, side int, depth long, conv_id long, parent_conv_id long, key string, parent_key string, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends string"
)


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): a row per conversation with its turns in order, each a 128-bit id and its text's bytes.

    Turns go by number, null first; turns with equal numbers by their ids.  A null role or text is empty.
    Rows with a null conv_id belong to no conversation.  Repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    c = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("hi"), F.xxhash64(F.lit(11), text, F.length(role), role).alias("lo"), F.octet_length(text).cast("long").alias("bytes")
    )
    turns = F.sort_array(F.collect_list(F.struct("turn", "hi", "lo", "bytes")))
    return c.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"), t["bytes"].alias("bytes"))).alias("path"))


def rebuilt(conversations: DataFrame, family: int = 5, spread: int = 9) -> DataFrame:
    """(conv_id, path): each conversation c begins with the first h turns of conversation c - c % ``family`` and goes
    on with its own after its first h; h is crc32(c) % ``spread``."""
    own = common.stored(turn_paths(conversations), "trie-paths")
    heads = own.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, spread - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % spread).cast("int")
    base = own.withColumn("_of", F.col("conv_id") - F.col("conv_id") % family).join(heads, F.col("_of") == F.col("_base"), "left")
    none = F.array().cast(PATH)
    head = F.when(h > 0, F.slice(F.coalesce("_head", none), F.lit(1), F.greatest(h, F.lit(1)))).otherwise(none)
    rest = F.slice("path", h + 1, F.greatest(F.size("path") - h, F.lit(0)))
    return base.select("conv_id", F.concat(head, rest).alias("path"))


def _ordered(conv: np.ndarray, length: np.ndarray, first: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order of rows by their sequences of ranks, shorter ones first, then by conversation: blocks of
    columns are sorted from the last to the first, each stable, each over the rows that reach it."""
    order = np.argsort(conv, kind="stable")
    for start in range((int(length.max(initial=0)) - 1) // WIDTH * WIDTH, -1, -WIDTH):
        reach = length[order] > start
        rows = order[reach]
        at = first[rows][:, None] + start + np.arange(WIDTH)
        inside = np.arange(start, start + WIDTH) < length[rows][:, None]
        padded = np.where(inside, rank[np.where(inside, at, 0)] if len(rank) else -1, -1)
        order = np.concatenate([order[~reach], rows[np.lexsort(padded.T[::-1])]])
    return order


def _path_keys(hi: np.ndarray, lo: np.ndarray) -> list[str]:
    """A key for each prefix of a sequence of ids, the empty one included."""
    keys, last = [hashlib.blake2b(b"root", digest_size=16).digest()], b""
    for a, b in zip(hi.tolist(), lo.tolist()):
        last = keys[-1]
        keys.append(hashlib.blake2b(last + a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True), digest_size=16).digest())
    return [k.hex() for k in keys]


def shard_nodes(conv: np.ndarray, length: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard: those inside it whole, those on the paths of its first and last row in parts, and the
    conversations that end at the latter in chunks."""
    ids = np.empty(len(hi), dtype=[("hi", np.int64), ("lo", np.int64)])
    ids["hi"], ids["lo"] = hi, lo
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    first = np.cumsum(length) - length
    order = _ordered(conv, length, first, rank)
    conv, length, first = conv[order], length[order], first[order]
    n = len(conv)

    levels = []
    rows, node = np.arange(n), np.zeros(n, np.int64)
    for depth in range(int(length.max()) + 1):
        if depth:
            reach = length[rows] >= depth
            rows, node = rows[reach], node[reach]
            value = rank[first[rows] + depth - 1]
            begins = np.ones(len(rows), bool)
            begins[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])  # a change in this column or one before
        else:
            begins = np.arange(n) == 0
        starts = np.flatnonzero(begins)
        levels.append((rows, starts, node[starts]))
        node = np.cumsum(begins) - 1

    keys = [_path_keys(hi[first[r] : first[r] + length[r]], lo[first[r] : first[r] + length[r]]) for r in (0, n - 1)]
    leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64)
    below = np.zeros(0, np.int64)  # of the nodes one deeper, those inside the shard: their parents
    some_below = np.zeros(0, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        rows, starts, parent = levels[depth]
        count = len(starts)
        convs = np.diff(np.append(starts, len(rows)))
        least = np.minimum.reduceat(conv[rows], starts)
        last_bytes = size[first[rows[starts]] + depth - 1] if depth else np.zeros(1, np.int64)
        side = np.full(count, -1, np.int32)
        if rows[-1] == n - 1:
            side[-1] = 1
        if rows[0] == 0:
            side[0] = 0
        both = bool(rows[0] == 0 and rows[-1] == n - 1 and count == 1)
        inner = side < 0
        children = np.bincount(below, minlength=count)
        childless = np.bincount(some_below, minlength=count) == 0
        saved[rows[starts[inner]]] += ((convs - 1) * last_bytes)[inner]
        leaves[rows[starts[inner & childless]]] += 1
        all_leaves, all_saved = np.add.reduceat(leaves[rows], starts), np.add.reduceat(saved[rows], starts)
        ending = np.add.reduceat((length[rows] == depth).astype(np.int64), starts)
        ends = np.full(count, NO_ENDS, object)
        chunks = []
        for k in np.flatnonzero(ending).tolist():
            who = conv[rows[starts[k] : starts[k] + ending[k]]]
            if inner[k]:
                ends[k] = hashlib.sha256(",".join(map(str, who.tolist())).encode()).hexdigest()
            else:
                chunks += [(keys[side[k]][depth], part) for part in np.array_split(who, -(-len(who) // CHUNK_IDS))]
        for k in np.flatnonzero(~inner).tolist():  # what hangs below is accounted for; the second step adds these nodes
            span = rows[starts[k] : starts[k] + convs[k]]
            leaves[span] = saved[span] = 0

        up_rows, up_starts, _ = levels[depth - 1] if depth else (rows, starts, parent)
        if depth:
            up_count = len(up_starts)
            up_side = np.full(up_count, -1, np.int32)
            if up_rows[-1] == n - 1:
                up_side[-1] = 1
            if up_rows[0] == 0:
                up_side[0] = 0
            up_least = np.minimum.reduceat(conv[up_rows], up_starts)
        else:
            up_side, up_least = np.full(1, -1, np.int32), np.zeros(1, np.int64)
        above = up_side[parent]
        yield _rows(
            INNER, shard, int(inner.sum()), side=pa.array(above[inner], mask=above[inner] < 0), depth=depth, conv_id=least[inner],
            parent_conv_id=pa.array(up_least[parent][inner], mask=above[inner] >= 0), n_convs=convs[inner], n_children=children[inner],
            n_leaves=all_leaves[inner], saved_tokens=all_saved[inner], ends=pa.array(ends[inner].tolist(), pa.string()),
        )
        for s, k in ((0, 0), (1, count - 1)):
            if side[k] != s and not (both and s == 1):
                continue
            part = 0 if both and s == 1 else 1  # a node on both paths counts once
            yield _rows(
                SHARED, shard, 1, side=s, depth=depth, conv_id=least[k], key=keys[s][depth], parent_key=keys[s][depth - 1] if depth else None, n_convs=part * convs[k],
                n_children=part * children[k], n_leaves=part * all_leaves[k], saved_tokens=part * all_saved[k], bytes=last_bytes[k],
            )
        for key, who in chunks:
            yield _rows(ENDS, shard, 1, conv_id=who[0], key=key, ends=",".join(map(str, who.tolist())))
        below, some_below = parent[inner], parent


def _rows(kind: int, shard: int, n: int, **columns) -> pa.RecordBatch:
    """A batch of ``_PARTS``; a single value stands for all n rows, columns that aren't given are null."""
    out = []
    for name, sort in (x.split(" ") for x in _PARTS.split(", ")):
        arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[sort]
        v = {"kind": kind, "shard": shard, **columns}.get(name)
        if not isinstance(v, (pa.Array, np.ndarray)):
            v = pa.array([v.item() if hasattr(v, "item") else v] * n, arrow)
        out.append(v.cast(arrow) if isinstance(v, pa.Array) else pa.array(v, arrow))
    return pa.RecordBatch.from_arrays(out, [x.split(" ")[0] for x in _PARTS.split(", ")])


def _hashed(chunks: DataFrame) -> DataFrame:
    """(key, ends): the hash over all chunks (key, conv_id, ends) of a key by conv_id, fed chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        for b in batches:
            for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist()):
                if k != key:
                    if h:
                        yield pa.RecordBatch.from_pydict({"key": [key], "ends": [h.hexdigest()]})
                    key, h = k, hashlib.sha256(text.encode())
                else:
                    h.update(b"," + text.encode())
        if h:
            yield pa.RecordBatch.from_pydict({"key": [key], "ends": [h.hexdigest()]})

    return chunks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key string, ends string")


def trie_of(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of ``paths`` (conv_id, path; a conv_id stands once).

    conv_id is the smallest member, parent_conv_id the parent's (null for the root, at depth 0), n_convs the
    members, n_children the children, n_leaves the childless nodes of the subtree, the node itself included;
    saved_tokens adds up (members - 1) times the bytes of the last text over the subtree; ends_sha256 is the hash
    of the ascending conv_ids that end here, joined by commas.  No conversation, no node.
    """
    spark = paths.sparkSession
    common.bounded_batches(spark)
    paths = common.stored(paths, "trie-rebuilt")
    turns = paths.agg(F.sum(F.size("path") + 1)).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches), schema=None) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        path = t.column("path").combine_chunks()
        path = path.chunk(0) if isinstance(path, pa.ChunkedArray) else path
        flat = path.flatten()
        hi, lo, size = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        length = np.diff(path.offsets.to_numpy()).astype(np.int64)
        yield from shard_nodes(t.column("conv_id").to_numpy(), length, hi, lo, size, TaskContext.get().partitionId())

    dealt = paths.repartitionByRange(int(-(-turns // shard_turns)), "path", "conv_id")
    parts = common.stored(dealt.select("conv_id", "path").mapInArrow(run, _PARTS), "trie-parts")
    inner, shared, chunks = (parts.filter(F.col("kind") == k) for k in (INNER, SHARED, ENDS))

    whole = shared.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("bytes").alias("bytes"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.min(F.struct("shard", "side")).alias("home"),
    )
    whole = common.stored(whole, "trie-shared")
    more = whole.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("_more"))
    whole = whole.join(more, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_more", F.lit(0))).drop("_more")
    hung = whole.select(
        "key", "home", (F.col("n_leaves") + (F.col("n_children") == 0).cast("long")).alias("_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("_saved")
    )
    # each node hands what hangs on it alone to the nodes above it, along one of the paths that it is on
    at_home = F.struct("shard", "side") == F.col("home")
    path = shared.select("shard", "side", "depth", "key").join(hung, "key")
    up = Window.partitionBy("shard", "side").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = path.select("key", *(F.sum(F.when(at_home, F.col(c)).otherwise(F.lit(0))).over(up).alias(c) for c in ("_leaves", "_saved")))
    sums = sums.groupBy("key").agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    whole = whole.drop("n_leaves", "saved_tokens").join(sums, "key").join(_hashed(chunks.select("key", "conv_id", "ends")), "key", "left")
    names = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    across = whole.join(names, "parent_key", "left")

    least = shared.select("shard", "side", (F.col("depth") + 1).alias("depth"), "key").join(whole.select("key", F.col("conv_id").alias("parent_conv_id")), "key").drop("key")
    under = inner.filter("side IS NOT NULL").drop("parent_conv_id").join(least, ["shard", "side", "depth"])
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))
    return inner.filter("side IS NULL").select(*columns).unionByName(under.select(*columns)).unionByName(across.select(*columns))
