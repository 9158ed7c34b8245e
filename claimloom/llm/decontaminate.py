"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of 13 consecutive words of the benchmark's items; an item of fewer words is one
pattern.  The search looks at the last block of words in a window of the text: a shift table says how
far every pattern lets it skip; where none does, the bucket of patterns with that last block is asked
for the window's hash, and words are compared one by one.  Patterns are searched length by length, so
that a short item doesn't spoil the skips.

Tables are arrays of numbers, about 50 bytes a word of the benchmark, built once for a group of items of
bounded size and broadcast; each further group is a further pass over the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common
from claimloom.llm.near_dedup import mixed_bits

WINDOW = 13
#: Patterns of the benchmark are searched in groups of items with so many characters at most (or one item).
GROUP_CHARS = 16_000_000
#: Bytes of documents that are searched at a time.
SEARCH_BYTES = 4 << 20

# Words are runs of a-z, 0-9 and what isn't ASCII, after A-Z are lower-cased; in UTF-8 that is a rule on bytes.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))
#: Stands between texts, and for words that the benchmark doesn't have.
NO_WORD = -1


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text (or its UTF-8 bytes), as UTF-8."""
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b"").translate(_WORD_BYTES).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return NO_WORD


def _window_hashes(ids: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of each window of m numbers."""
    w = ids.astype(np.uint64)
    n = len(w) - m + 1
    h = mixed_bits(w[:n])
    for i in range(1, m):
        h = mixed_bits(h + w[i : n + i])
    return h


class WuManber:
    """Patterns of one length: where windows of ``m`` numbers in ``ids`` start, and the item of each."""

    def __init__(self, m: int, ids: np.ndarray, at: np.ndarray, items: np.ndarray, n_words: int) -> None:
        self.m, self.block, self.ids, self.n_words = m, min(2, m), ids, n_words
        self.far = m - self.block + 1
        # patterns sorted by last block and hash: a bucket a block; equal ones, which may be of several items, in a row
        whole = _window_hashes(ids, m)[at]
        blocks = self._blocks(ids)
        suffix = blocks[at + m - self.block]
        order = np.lexsort((items, whole, suffix))
        again = np.zeros(len(order), bool)  # a pattern that its item has already
        again[1:] = (whole[order[1:]] == whole[order[:-1]]) & (items[order[1:]] == items[order[:-1]])
        for k in range(m):
            again[1:] &= ids[at[order[1:]] + k] == ids[at[order[:-1]] + k]
        order = order[~again]
        self.suffix, self.whole, self.at, self.items = suffix[order], whole[order], at[order], items[order]
        # the least distance of each block from the end of a pattern
        ends = [np.stack([blocks[at + k], np.full(len(at), self.far - 1 - k)]) for k in range(self.far)]
        keys, far = np.concatenate(ends, 1)
        order = np.lexsort((far, keys))
        self.keys, first = np.unique(keys[order], return_index=True)
        self.shift = far[order][first].astype(np.int16)

    def _blocks(self, ids: np.ndarray) -> np.ndarray:
        """A number for each block of consecutive words; -1 where it has a word that is unknown."""
        if self.block == 1:
            return ids.astype(np.int64)
        a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        return np.where((a < 0) | (b < 0), -1, a * self.n_words + b)

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence in ``ids``."""
        m, far = self.m, self.far
        if len(ids) < m:
            return
        blocks = self._blocks(ids)
        found = np.minimum(np.searchsorted(self.keys, blocks), len(self.keys) - 1)
        shifts = np.where(self.keys[found] == blocks, self.shift[found], far).tolist()
        stops, at, last = [], m - self.block, len(shifts)  # shifts[at] is that of the window whose last block is there
        while at < last:
            s = shifts[at]
            if s:
                at += s
            else:
                stops.append(at)
                at += 1
        if not stops:
            return
        stops = np.array(stops)
        starts = stops + self.block - m
        whole = _window_hashes(ids, m)[starts]
        lo, hi = np.searchsorted(self.suffix, blocks[stops]), np.searchsorted(self.suffix, blocks[stops], "right")
        for start, h, a, b in zip(starts.tolist(), whole, lo.tolist(), hi.tolist()):
            bucket = self.whole[a:b]
            k = int(np.searchsorted(bucket, h))
            if k < b - a and bucket[k] == h:
                text = ids[start : start + m]
                same = range(a + k, a + int(np.searchsorted(bucket, h, "right")))
                own = [self.items[j] for j in same if np.array_equal(self.ids[self.at[j] : self.at[j] + m], text)]
                if own:
                    yield start, own


class Searches:
    """The tables of a group of items (item id, text)."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.names = [name for name, _ in items]
        self.vocabulary = _Vocabulary()
        ids, starts = [], []
        n = 0
        for _, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            starts.append(n)
            ids.append(np.array([*own, NO_WORD], np.int32))  # a gap between items
            n += len(own) + 1
        lengths = np.array([len(x) - 1 for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        self.tables = []
        for m in np.unique(np.minimum(lengths, window)):
            of = np.flatnonzero(np.minimum(lengths, window) == m)
            if m:
                n = lengths[of] - m + 1
                at = np.repeat(np.array(starts)[of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                self.tables.append(WuManber(int(m), flat, at, np.repeat(of, n), len(self.vocabulary)))

    def search(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, set[str]]]:
        """For each text the number of words, the words that are hit (a byte each), and the items found."""
        words = [words_of(t) for t in texts]
        get = self.vocabulary.__getitem__
        ids = np.full(sum(map(len, words)) + len(words), NO_WORD, np.int32)
        starts, at = [], 0
        for w in words:
            starts.append(at)
            ids[at : at + len(w)] = np.fromiter(map(get, w), np.int32, len(w))
            at += len(w) + 1
        hit, items = np.zeros(len(ids), np.int8), {}
        for table in self.tables:
            for start, own in table.search(ids):
                hit[start : start + table.m] = 1
                items.setdefault(int(np.searchsorted(starts, start, "right")) - 1, set()).update(self.names[j] for j in own)
        for k, (w, start) in enumerate(zip(words, starts)):
            yield len(w), hit[start : start + len(w)], items.get(k, set())


def _groups(benchmark: DataFrame, group_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in groups of bounded size, streamed through the driver one group at a time; an empty one
    if there are none."""
    group, held, n = [], 0, 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        if group and held + len(text) > group_chars:
            yield group
            group, held, n = [], 0, n + 1
        group.append((name, text))
        held += len(text)
    if group or not n:
        yield group


MADE = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, group_chars: int = GROUP_CHARS) -> DataFrame:
    """The columns of ``docs`` and n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of a pattern; contaminated: some word is hit, and at least
    one in ``share``.  Null and empty texts have no words and aren't contaminated; neither null item
    ids nor null item texts find anything.  Rows of one item_id are one item.  Columns of ``docs``
    with a name of the result give way; each row is judged alone, repeated ones alike.

    The driver holds the tables of one group of items; a benchmark of more groups than one takes a pass
    over the documents for each, with the documents and what was found in them written in between.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in MADE]
    out = docs.select(*[F.col(f"`{c}`") for c in names], F.lit(None).cast("binary").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    common.bounded_batches(spark)
    groups = _groups(benchmark, group_chars)
    group = next(groups)
    while group is not None:
        following = next(groups, None)
        tables = spark.sparkContext.broadcast(Searches(group, window))
        search = _searching(tables, share, names.index("text"), following is None)
        if following is None:
            kinds = out.drop("_hits", "_items").withColumns({c: F.lit(0).cast("long") for c in MADE[:3]} | {"items_sha256": F.lit(""), "contaminated": F.lit(False)})
            return out.mapInArrow(search, kinds.schema)
        out = common.stored(out.mapInArrow(search, out.schema), "contamination")
        tables.unpersist()
        group = following
    raise AssertionError("the last group returns")


def _searching(tables, share: int, k: int, final: bool):
    """A task's search of column ``k``; the last two columns are the words hit so far (as bits) and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = tables.value
        for cols, names in _pieces(batches):
            hits, found, counts = [], [], []
            for (n, hit, own), old_hit, old in zip(searches.search(cols[k].cast(pa.binary()).to_pylist()), cols[-2].to_pylist(), cols[-1].to_pylist()):
                if old_hit is not None:
                    hit = hit | np.unpackbits(np.frombuffer(old_hit, np.uint8), count=n).view(np.int8)
                hits.append(hit)
                found.append(sorted(own.union(old)))
                counts.append((n, int(hit.sum()), len(found[-1])))
            if not final:
                made = [pa.array([np.packbits(h).tobytes() for h in hits], pa.binary()), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols[:-2], *made], names)
                continue
            made = [pa.array([c[j] for c in counts], pa.int64()) for j in range(3)]
            made.append(pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()))
            made.append(pa.array([h > 0 and share * h >= n for n, h, _ in counts], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*cols[:-2], *made], [*names[:-2], *MADE])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.Array], list[str]]]:
    """Batches cut to about ``SEARCH_BYTES``, but for single rows that are longer."""
    for b in batches:
        step = max(1, min(b.num_rows, b.num_rows * SEARCH_BYTES // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            piece = b.slice(at, step)
            yield piece.columns, b.schema.names
