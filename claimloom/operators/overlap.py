"""Exact set joins without all pairs: the rows that share most members, and how many share any (rows 28, 33, 34).

Two facts save the pairs that share a single, frequent member, which are most of all pairs.  Rows that share two
members share one besides the most frequent member of either.  And of the rows that share the most frequent member
alone, only the k smallest can be among a row's k best.
"""

from __future__ import annotations

import pickle
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from claimloom.operators.graph import cut_lineage
from claimloom.operators.relational import dealt, parts_for, top_k

#: Rows of the left side that a task takes at a time at most, and where there are few rows at least, and members of the right side that it meets.
CELL_ROWS, LEAST_ROWS = 65_536, 1_024
CELL_MEMBERS = 8_000_000


Found = tuple[np.ndarray, np.ndarray]


def counted(routes: list[np.ndarray], rest: list[np.ndarray], n: int) -> Found:
    """The ids of ``routes`` among n, and how often each is in these and in ``rest``; all are sorted without repeats."""
    if not routes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    met = np.concatenate(routes) if len(routes) > 1 else routes[0]
    if 16 * len(met) >= n:  # a table of all ids is shorter than sorting
        table = np.bincount(met, minlength=n)
        ids = np.flatnonzero(table)
        count = table[ids]
    else:
        ids, count = np.unique(met, return_counts=True)
    for long in rest:
        count = count + (long[np.minimum(np.searchsorted(long, ids), len(long) - 1)] == ids)
    return ids, count


def padded(vectors: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sizes): vectors as rows of ``width`` numbers, 0 beyond their size; the size of a null is -1."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy().astype(np.int64)
    rows = np.zeros((len(sizes), width))
    rows[np.arange(width) < sizes[:, None]] = pc.list_flatten(vectors).to_numpy()
    return rows, sizes


def _narrow(v: np.ndarray) -> bytes:
    """Numbers in the fewest bytes that hold them exactly; the first byte says how."""
    whole = v.dtype.kind in "iub"
    with np.errstate(invalid="ignore"):
        for k in (1, 2, 4):
            w = v.astype(f"<i{k}")
            if (w == v).all():
                return bytes([k if whole else k + 16]) + w.tobytes()
    return bytes([8 if whole else 24]) + v.astype("<i8" if whole else "<f8").tobytes()


def _wide(b: bytes) -> np.ndarray:
    """The numbers of ``_narrow``, as long or double."""
    code = b[0]
    return np.frombuffer(b, "<f8" if code == 24 else f"<i{code % 16}", offset=1).astype(np.float64 if code > 16 else np.int64)


#: Texts of fewer bytes aren't compressed.
COMPRESSED_FROM = 128


def _packed_ids(ids: pa.Array) -> bytes:
    """Sorted ids in few bytes: whole numbers as differences, strings as lengths and their bytes, others as they are."""
    if pa.types.is_integer(ids.type):
        v = ids.to_numpy().astype(np.int64)
        return v[:1].tobytes() + _narrow(np.diff(v))
    if not pa.types.is_string(ids.type):
        return pickle.dumps(ids.to_pylist())
    texts = [x.encode() for x in ids.to_pylist()]
    sizes, text = _narrow(np.array([len(x) for x in texts])), b"".join(texts)
    small = pa.compress(text, "zstd", asbytes=True) if len(text) >= COMPRESSED_FROM else text
    return struct.pack("<iiI", len(texts), len(text), len(sizes)) + sizes + small


def _unpacked_ids(packed: list[bytes], kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """The ids of all of ``packed``, one after the other, and how many each has."""
    if pa.types.is_integer(kind):
        each = [np.cumsum(np.concatenate([np.frombuffer(b, "<i8", 1), _wide(b[8:])])) for b in packed]
        return pa.array(np.concatenate(each)).cast(kind), np.array([len(x) for x in each])
    if not pa.types.is_string(kind):
        lists = [pickle.loads(b) for b in packed]
        return pa.array([x for y in lists for x in y], kind), np.array([len(x) for x in lists])
    sizes, texts = [], []
    for b in packed:
        n, size, at = struct.unpack_from("<iiI", b)
        sizes.append(_wide(b[12 : 12 + at]) if n else np.zeros(0, np.int64))
        text = b[12 + at :]
        texts.append(text if size < COMPRESSED_FROM else pa.decompress(text, size, "zstd", asbytes=True))
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    ids = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype("<i8").tobytes()), pa.py_buffer(b"".join(texts)))
    return ids, np.array([len(x) for x in sizes])


#: Left rows that stand as Python objects at a time.
ROWS_AT_ONCE = 2_048


class Cell:
    """A block of left rows, and the postings of their tokens: ``names`` are the right ids in order, a posting is their places."""

    def __init__(self, rows: pa.Table, lists: pa.Table, mine: list[str], theirs: list[str], kind: pa.DataType):
        if "_w" in lists.column_names:  # vectors stand in rows of their own
            self._vectors, lists = lists.filter(pc.is_null(lists.column("token"))), lists.filter(pc.is_valid(lists.column("token")))
        self.ids, self._rows, self._mine = rows.column("id").combine_chunks(), rows, mine
        flat, sizes = _unpacked_ids(lists.column("ids").to_pylist(), kind)
        coded = flat.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        self.names, rank = coded.dictionary.take(order).cast(kind), np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        self.place = rank[coded.indices.to_numpy()]
        ends = [0, *np.cumsum(sizes).tolist()]
        self._of = {t: slice(a, b) for t, a, b in zip(lists.column("token").to_pylist(), ends, ends[1:])}
        #: facts of the right side as they stand beside the postings, and by place
        self.beside = {c: np.concatenate([_wide(b) for b in lists.column(c).to_pylist()]) for c in theirs}
        self.known = {c: np.zeros(len(self.names), v.dtype) for c, v in self.beside.items()}
        for c, v in self.beside.items():
            self.known[c][self.place] = v

    def rows(self) -> Iterator[tuple]:
        """(i, own, tokens, slices, facts) of each left row that meets any: its number, its own place, its tokens with their slices of
        ``place``, and its facts beside them."""
        own = pc.index_in(self.ids, self.names).to_pylist() if self.ids.type == self.names.type else [None] * len(self.ids)
        for start in range(0, len(self.ids), ROWS_AT_ONCE):
            some = self._rows.slice(start, ROWS_AT_ONCE)
            facts = [some.column(c).to_pylist() for c in self._mine]
            for i, tokens in enumerate(some.column("tokens").to_pylist()):
                at = [n for n, t in enumerate(tokens) if t in self._of]
                if at:
                    yield start + i, own[start + i], [tokens[n] for n in at], [self._of[tokens[n]] for n in at], [[f[i][n] for n in at] for f in facts]

    def after(self, at: list[slice], first: int) -> list[np.ndarray]:
        """Postings from place ``first`` on."""
        return [p[np.searchsorted(p, first) :] for p in (self.place[x] for x in at)]

    def cosines(self) -> Callable[[int], np.ndarray]:
        """What gives for a left row's number the products of its vector with those of all places; 0 where one is missing, or
        their sizes differ.  Rows are multiplied some at a time."""
        n, vectors = len(self.names), self._vectors.filter(pc.is_in(self._vectors.column("_id"), value_set=self.names))
        at = pc.index_in(vectors.column("_id"), value_set=self.names).to_numpy()
        width = max(pc.max(pc.list_value_length(x.column("_w"))).as_py() or 0 for x in (self._rows, vectors))
        (mine, sizes), (theirs, others) = padded(self._rows.column("_w"), width), padded(vectors.column("_w"), width)
        strip, known = max(1, min(256, 4_000_000 // max(1, n))), {}

        def of(i: int) -> np.ndarray:
            start = i - i % strip
            if start not in known:
                known.clear()
                known[start] = mine[start : start + strip] @ theirs.T
            out = np.zeros(n)
            out[at] = np.where(others == sizes[i], known[start][i - start], 0.0)
            return out

        return of

    def later(self) -> list[int]:
        """For each left row the place from which on right ids are after its own."""
        n = len(self.names)
        order = pc.sort_indices(pa.concat_arrays([self.names, self.ids])).to_numpy()  # stable: of equal ids the name is first
        before, at = np.cumsum(order < n), order >= n
        out = np.empty(len(self.ids), np.int64)
        out[order[at] - n] = before[at]
        return out.tolist()


def _packed(postings: DataFrame, facts: list[str]) -> DataFrame:
    """Postings with their ids and facts in few bytes: they are shuffled to each block that has their token."""
    more = [c for c in postings.columns if c not in ("ids", *facts)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = {c: x.column(c) for c in more}
            for c in ("ids", *facts):
                values, ends = x.column(c).flatten(), x.column(c).offsets.to_numpy() - x.column(c).offsets[0].as_py()
                flat = values if c == "ids" else values.to_numpy(zero_copy_only=False)
                each = (flat[i:j] for i, j in zip(ends, ends[1:]))
                made[c] = pa.array([_packed_ids(v) if c == "ids" else _narrow(v) for v in each], pa.binary())
            yield pa.RecordBatch.from_pydict(made)

    kept = ", ".join(f"{c} {postings.schema[c].dataType.simpleString()}" for c in more)
    return postings.select(*more, "ids", *facts).mapInArrow(pack, ", ".join([kept, "ids binary", *(f"{c} binary" for c in facts)]))


def in_cells(left: DataFrame, right: DataFrame, judge: Callable[[Cell], dict], schema: str, cell_rows: int = CELL_ROWS, cell_members: int = CELL_MEMBERS, vectors: tuple[DataFrame, DataFrame] | None = None, stored: bool = False) -> tuple[DataFrame, bool]:
    """What ``judge`` makes of each cell, columns as in ``schema``, and whether each left row has all its partners in one cell; both
    sides are (id, token) and facts of these, which then stand once.

    Blocks of left rows meet the postings (token, ids) of their tokens.  Rows that have their most frequent token in common stand in
    one block, so that its posting goes to few blocks, and what moves hangs on the rarer ones.  Postings move in few bytes
    (``_packed``), and over as many partitions as there are cells.  Where a block has more than ``cell_members`` members, its right
    ids are dealt out in parts, so that what a task holds is bounded.  No pair is shuffled but what is
    made.  Without facts repeated rows count once; null ids and tokens share nothing.

    ``vectors`` of the left and the right ids, (id, vector) with a row an id, are too wide to stand beside each token: a cell
    gets one of each of its ids (``Cell.cosines``).  ``stored``: ``right`` is read from a table and isn't written again.
    """
    mine, theirs = ([c for c in df.columns if c not in ("id", "token")] for df in (left, right))
    spark, kind, by_vectors = left.sparkSession, to_arrow_schema(right.schema).field("id").type, vectors is not None

    def known(df: DataFrame, more: list[str]) -> DataFrame:
        rows = df.filter("id IS NOT NULL AND token IS NOT NULL").select("id", "token", *more)
        return rows if more else rows.distinct()

    members = known(right, theirs) if stored else cut_lineage(known(right, theirs), "overlap-right")
    own = members if left is right else known(left, mine)
    total = members.count()
    n = parts_for(spark, total)
    counts = dealt(members, n, "token").groupBy("token").agg(F.count("*").alias("_n"))
    small = total <= cell_members  # then no block has more
    counts = counts if small else cut_lineage(counts, "overlap-tokens")
    # a row's tokens, the most frequent one last
    sets = dealt(dealt(own, n, "token").join(counts, "token"), n, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_n", "token", *mine))).alias("_s"))
    sets = sets.select("id", F.col("_s.token").alias("tokens"), *[F.col(f"_s.{c}").alias(c) for c in mine])
    if vectors:
        here, others = (v.toDF("id", "_w").filter("id IS NOT NULL AND _w IS NOT NULL").withColumn("_w", F.col("_w").cast("array<double>")) for v in vectors)
        sets = sets.join(here, "id", "left")
    sets = cut_lineage(sets, "overlap-left")
    rows = sets.count()
    # few rows are dealt out over all cores
    cell_rows = max(1, min(cell_rows, max(LEAST_ROWS, -(-rows // (2 * spark.sparkContext.defaultParallelism)))))
    blocks = -(-rows // cell_rows)
    if blocks > 1:
        ordered = sets.withColumn("_long", F.element_at("tokens", -1)).repartitionByRange(min(2_000, blocks), "_long", "id")
        numbered = ordered.sortWithinPartitions("_long", "id").withColumn("block", F.expr(f"monotonically_increasing_id() div {cell_rows}")).drop("_long")
        sets = cut_lineage(numbered, "overlap-blocks")
    else:
        sets = sets.withColumn("block", F.lit(0).cast("long"))
    wanted = sets.select("block", F.explode("tokens").alias("token")).distinct()
    kinds = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def cell(rows: pa.Table, lists: pa.Table) -> pa.Table:
        some = rows.num_rows and lists.num_rows - (lists.column("token").null_count if by_vectors else 0)
        made = judge(Cell(rows, lists, mine, theirs, kind)) if some else {}
        return pa.table(made).select(kinds.names).cast(kinds) if made else kinds.empty_table()

    zero, part_of = F.lit(0).cast("long"), lambda c, parts: F.pmod(F.xxhash64(F.col(c), F.lit(1)), F.lit(parts)).cast("long")
    lists = [F.col("_l.id").alias("ids"), *[F.col(f"_l.{c}").alias(c) for c in theirs]]
    listed = F.array_sort(F.collect_list(F.struct("id", *theirs))).alias("_l")

    def postings(parts: int) -> DataFrame:
        """The postings of all tokens, in so many parts by the right ids."""
        part = part_of("id", parts) if parts > 1 else zero
        return _packed(dealt(members, n, "token").groupBy("token", part.alias("part")).agg(listed).select("token", "part", *lists), theirs)

    def with_vectors(met: DataFrame, of: DataFrame, parts: int) -> DataFrame:
        """``met``, and a row without a token for each vector that may be among a cell's ids."""
        if not vectors:
            return met
        part = part_of("id", parts) if parts > 1 else zero
        wide = others.join(members.select("id").distinct(), "id", "left_semi").withColumn("part", part).crossJoin(F.broadcast(of.select("block").distinct()))
        return met.unionByName(wide.withColumnRenamed("id", "_id"), allowMissingColumns=True)

    if small:
        met, cells, count, whole = with_vectors(wanted.join(postings(1), "token"), sets, 1), sets.withColumn("part", zero), blocks, True
    else:
        wanted = cut_lineage(dealt(wanted, n, "token").join(counts, "token"), "overlap-wanted")
        sums = cut_lineage(wanted.groupBy("block").agg(F.sum("_n").alias("_sum")), "overlap-sums")
        most, heavy = sums.agg(F.max("_sum"), F.count(F.when(F.col("_sum") > cell_members, 1))).head() or (None, 0)
        wide, narrow = (sums.filter(F.coalesce(F.col("_sum") > cell_members, F.lit(False)) == x).select("block") for x in (True, False))
        parts = -(-(most or 0) // cell_members)
        whole, count, met, cells = not heavy, blocks + heavy * (parts - 1), None, None
        for of, k in ((narrow, 1), (wide, parts)):
            if (k == 1 and heavy == blocks) or (of is wide and not heavy):
                continue
            some, here = (x if heavy in (0, blocks) else x.join(F.broadcast(of), "block", "left_semi") for x in (wanted.select("block", "token"), sets))
            lot = with_vectors(some.join(postings(k), "token"), of, k)
            each = here.withColumn("part", F.explode(F.sequence(zero, F.lit(k - 1).cast("long"))))
            met, cells = (lot, each) if met is None else (met.unionByName(lot), cells.unionByName(each))
    met = met.select(*[F.col(c).alias(c) for c in met.columns])  # both sides come from one table: other names of its columns
    cells, met = (x.repartition(min(4_000, max(1, 2 * count)), "block", "part") for x in (cells, met))
    return cells.groupBy("block", "part").cogroup(met.groupBy("block", "part")).applyInArrow(lambda x, y: cell(x, y), schema), whole


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _sides(left: DataFrame, right: DataFrame, *columns) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``columns``; one table remains one, which ``in_cells`` reads once."""
    of = left.select(*columns)
    return of, of if left is right else right.select(*columns)


def _pairs(cell: Cell, chosen: list[tuple[np.ndarray, ...]], made: list[str]) -> dict:
    """Columns a, b and ``made`` of what was chosen: numbers of rows, places, values."""
    if not chosen:
        return {}
    a, b, *values = (np.concatenate(x) for x in zip(*chosen))
    return {"a": cell.ids.take(pa.array(a)), "b": cell.names.take(pa.array(b))} | dict(zip(made, map(pa.array, values)))


def top_overlaps(left: DataFrame, right: DataFrame, k: int, distinct: bool = False, cell_rows: int = CELL_ROWS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """(a, b, shared, rank): for each row a of ``left`` (id, token) the ``k`` rows b of ``right`` (id, token) with most tokens in
    common, ties by b; with ``distinct`` a row isn't its own partner.

    A row counts the ids of all its tokens but the most frequent one, looks these up in that one's, and adds the
    ``k`` first ids of that.  Where no row's partners are in several cells, ranks are taken there.
    """

    def judge(cell: Cell) -> dict:
        chosen, n = [], len(cell.names)
        for i, own, _, at, _ in cell.rows():
            *routes, longest = sorted((cell.place[x] for x in at), key=len)
            ids, count = counted(routes, [longest], n)
            first = longest[: k + distinct]
            first = first[~np.isin(first, ids)]
            ids, count = np.concatenate([ids, first]), np.concatenate([count, np.ones(len(first), np.int64)])
            if distinct and own is not None:
                ids, count = ids[ids != own], count[ids != own]
            order = ids - count * (n + 1)  # more tokens first, then smaller ids
            if len(ids) > k:
                keep = np.argpartition(order, k - 1)[:k]
                ids, count, order = ids[keep], count[keep], order[keep]
            order = np.argsort(order)
            chosen.append((np.full(len(ids), i), ids[order], count[order], np.arange(1, len(ids) + 1)))
        return _pairs(cell, chosen, ["shared", "rank"])

    sides = _sides(left, right, "id", "token")
    met, whole = in_cells(*sides, judge, f"a {_kind(left)}, b {_kind(right)}, shared bigint, rank int", cell_rows, cell_members)
    return met if whole else top_k(met.drop("rank"), ["a"], [F.desc("shared"), F.asc("b")], k)


def overlaps(left: DataFrame, right: DataFrame, least: int = 1, cell_rows: int = CELL_ROWS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """(a, b, shared): the rows a of ``left`` and b of ``right`` (id, token), other than a, that share ``least`` tokens or more.

    Of two sets with ``least`` members in common each has one of them besides its ``least`` - 1 most frequent ones: the
    others route pairs, these are looked up.
    """

    def judge(cell: Cell) -> dict:
        chosen, n = [], len(cell.names)
        for i, own, _, at, _ in cell.rows():
            found = sorted((cell.place[x] for x in at), key=len)
            cut = len(found) - (least - 1)
            ids, count = counted(found[: max(0, cut)], found[max(0, cut) :], n)
            keep = count >= least
            if own is not None:
                keep &= ids != own
            chosen.append((np.full(int(keep.sum()), i), ids[keep], count[keep]))
        return _pairs(cell, chosen, ["shared"])

    sides = _sides(left, right, "id", "token")
    return in_cells(*sides, judge, f"a {_kind(left)}, b {_kind(right)}, shared bigint", cell_rows, cell_members)[0]


def judged_pairs(rows: DataFrame, score: Callable[..., np.ndarray], least: float, cell_rows: int = CELL_ROWS, cell_members: int = CELL_MEMBERS) -> DataFrame:
    """(a, b, shared, score): the pairs a < b of ``rows`` (id, token, facts) that share a token and have a score of ``least`` or
    more.  ``score(shared, mine, theirs)`` gets how many tokens are shared, a's facts, and those of each b, and is taken where
    the pairs are, so that the others don't leave.  Facts are numbers of an id, a row per (id, token)."""
    facts = [c for c in rows.columns if c not in ("id", "token")]

    def judge(cell: Cell) -> dict:
        chosen, n, later = [], len(cell.names), cell.later()
        for i, _, _, at, own in cell.rows():
            ids, count = counted(cell.after(at, later[i]), [], n)
            got = score(count, {c: v[0] for c, v in zip(facts, own)}, {c: cell.known[c][ids] for c in facts})
            keep = got >= least
            chosen.append((np.full(int(keep.sum()), i), ids[keep], count[keep], got[keep]))
        return _pairs(cell, chosen, ["shared", "score"])

    return in_cells(rows, rows, judge, f"a {_kind(rows)}, b {_kind(rows)}, shared bigint, score double", cell_rows, cell_members)[0]


#: Rows and members of a cell all of whose pairs leave it: most ids may be partners of each row.
PAIR_ROWS, PAIR_MEMBERS = 256, 1_000_000


def dots(left: DataFrame, right: DataFrame, cell_rows: int = PAIR_ROWS, cell_members: int = PAIR_MEMBERS) -> DataFrame:
    """(a, b, shared, dot): the rows a of ``left`` and b of ``right`` (id, token, n), other than a, that share a token, how many
    they share, and the sum of the products of their n.  A row per (id, token)."""

    def judge(cell: Cell) -> dict:
        chosen, n, heavy = [], len(cell.names), cell.beside["n"]
        for i, own, _, at, (weights,) in cell.rows():
            met, products = np.concatenate([cell.place[x] for x in at]), np.concatenate([heavy[x] * w for x, w in zip(at, weights)])
            if 16 * len(met) >= n:
                table = np.bincount(met, minlength=n)
                ids = np.flatnonzero(table)
                count, dot = table[ids], np.bincount(met, weights=products, minlength=n)[ids]
            else:
                ids, back, count = np.unique(met, return_inverse=True, return_counts=True)
                dot = np.bincount(back, weights=products)
            keep = ids != (-1 if own is None else own)
            chosen.append((np.full(int(keep.sum()), i), ids[keep], count[keep], dot[keep]))
        return _pairs(cell, chosen, ["shared", "dot"])

    sides = _sides(left, right, "id", "token", F.col("n").cast("double").alias("n"))
    return in_cells(*sides, judge, f"a {_kind(left)}, b {_kind(right)}, shared bigint, dot double", cell_rows, cell_members)[0]


def summed(routes: list[np.ndarray], weights: list[float], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of ``routes`` among n, how often each is in these, and the sum of the weights of the routes that it is in."""
    met, heavy = np.concatenate(routes), np.repeat(np.asarray(weights, float), [len(x) for x in routes])
    if 16 * len(met) >= n:
        table = np.bincount(met, minlength=n)
        ids = np.flatnonzero(table)
        return ids, table[ids], np.bincount(met, weights=heavy, minlength=n)[ids]
    ids, back, count = np.unique(met, return_inverse=True, return_counts=True)
    return ids, count, np.bincount(back, weights=heavy, minlength=len(ids))


#: Rows and members of a cell whose ids have vectors.
VECTOR_ROWS, VECTOR_MEMBERS = 32_768, 8_000_000


def affine_pairs(left: DataFrame, right: DataFrame, vectors: tuple[DataFrame, DataFrame], least: float, weights: tuple[float, float, float], stored: bool = False, cell_rows: int = VECTOR_ROWS, cell_members: int = VECTOR_MEMBERS) -> DataFrame:
    """(a, b, score): the ids a of ``left`` and b > a of ``right`` that share a token and have a score of ``least`` or more, of
    their cosine, the Jaccard of their tokens and the mean weight of the shared ones.  Both sides are (id, token, n), n the
    number of an id's tokens, ``left`` also w, a token's weight; ``vectors`` (id, vector) are of unit length.  Pairs are judged
    in cells, vectors included, and the others don't leave."""
    wc, wj, ws = weights

    def judge(cell: Cell) -> dict:
        chosen, n, later, cosine = [], len(cell.names), cell.later(), cell.cosines()
        for i, _, _, at, (own, rarity) in cell.rows():
            ids, k, s = summed(cell.after(at, later[i]), rarity, n)
            score = wc * cosine(i)[ids] + wj * k / (own[0] + cell.known["n"][ids] - k) + ws * s / k
            keep = ~(score < least - 1e-6)
            chosen.append((np.full(int(keep.sum()), i), ids[keep], score[keep]))
        return _pairs(cell, chosen, ["score"])

    sides = left.select("id", "token", "n", F.col("w").cast("double").alias("w")), right.select("id", "token", "n")
    met, _ = in_cells(*sides, judge, f"a {_kind(left)}, b {_kind(right)}, score double", cell_rows, cell_members, vectors, stored)
    return met.withColumn("score", F.round("score", 6)).filter(F.col("score") >= least)


def candidates_by_entities(page_entities: DataFrame, event_entities: DataFrame, k: int = 20) -> DataFrame:
    """#28. For each page the ``k`` events with most entities in common, ties by event."""
    pages = page_entities.select(F.col("page_id").alias("id"), F.col("entity_id").alias("token"))
    events = event_entities.select(F.col("event_id").alias("id"), F.col("entity_id").alias("token"))
    return top_overlaps(pages, events, k).select(F.col("a").alias("page_id"), F.col("b").alias("event_id"), F.col("shared").alias("overlap"))


def rank_in_token(keys: DataFrame, parts: int | None = None) -> DataFrame:
    """(id, token, after): how many ids of the same token of distinct (id, token) come after a row's id.

    Rows are dealt out as ranges of (token, id), so that a frequent token's rows stand in several parts: a row is
    ranked in its part, and the sizes of the token's later parts are added.
    """
    n = parts or max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut_lineage(keys.repartitionByRange(n, "token", "id").withColumn("_part", F.spark_partition_id()), "overlap-ranks")
    inside = Window.partitionBy("_part", "token").orderBy(F.desc("id"))
    sizes = dealt.groupBy("token", "_part").agg(F.count("*").alias("_n"))
    later = Window.partitionBy("token").orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("token", "_part", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    return dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(sizes, ["token", "_part"]).select("id", "token", (F.col("_rank") + F.col("_later")).alias("after"))


def partner_counts(keys: DataFrame) -> DataFrame:
    """(a, partners, last): for each id of (id, token) with a later id that shares a token, how many later ids do, and the
    largest.  Counted from the tokens' ranks: a partner counts once for each shared token, and pairs that share several are
    found (``twice_sharing``) and taken off."""
    known = cut_lineage(keys.select("id", "token").filter("id IS NOT NULL AND token IS NOT NULL").distinct(), "overlap-keys")
    most = known.groupBy("token").agg(F.max("id").alias("_last"))
    ranked = rank_in_token(known).join(most, "token").filter("after > 0")
    sums = ranked.groupBy(F.col("id").alias("a")).agg(F.sum("after").alias("_sum"), F.max("_last").alias("last"))
    more = twice_sharing(known).groupBy("a").agg(F.sum(F.col("shared") - 1).alias("_more"))
    return sums.join(more, "a", "left").select("a", (F.col("_sum") - F.coalesce("_more", F.lit(0))).alias("partners"), "last")


def twice_sharing(keys: DataFrame) -> DataFrame:
    """(a, b, shared): the pairs a < b of distinct (id, token) that share two tokens or more.  Each is made once, at the
    rarest token that it shares; a set's most frequent token makes no pair."""
    n = keys.groupBy("token").agg(F.count("*").alias("_n"))
    sets = keys.join(n, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_n", "token"))).alias("_s"))
    sets = sets.filter(F.size("_s") > 1).select("id", F.transform("_s", lambda x: x["token"]).alias("_all"))
    rows = sets.select("id", "_all", F.explode(F.slice("_all", F.lit(1), F.size("_all") - 1)).alias("token"))
    left, right = (rows.select(F.col("id").alias(c), F.col("_all").alias(f"_{c}"), "token") for c in "ab")
    met = left.join(right, "token").filter("a < b").select("a", "b", "token", F.array_intersect("_a", "_b").alias("_c"))
    return met.filter((F.size("_c") > 1) & (F.get("_c", F.lit(0)) == F.col("token"))).select("a", "b", F.size("_c").cast("long").alias("shared"))
