"""Edit-aware token counts: a segment tree of pre-tokens per document, kept between rounds of edits.

A document's leaves are runs of pre-tokens (the pieces that a byte-level BPE encodes one by one), with
their characters and tokens; inner nodes hold the sums of their subtrees.  An edit finds its leaves
from the root, splits only the touched region and some pre-tokens around it anew, until its cuts
meet the old ones, and updates the sums on the way up.  Counts are those of encoding the edited text.

``build_trees`` makes a table of trees from documents, to be written by the caller; ``edit_trees`` and
``apply_edits`` make the next version of such a table.  A leaf that no edit touches isn't decoded,
split or encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common

#: Fixed value: the pattern at which byte-level vocabularies of this kind split texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens in a leaf of a new tree; a leaf that grows to 8 times as many makes the tree new.
LEAF = 32
#: Pre-tokens before an edit whose cuts it can change: a piece looks at two characters after its end.
CONTEXT = 3
CACHE_PIECES = 300_000

_SPLIT = regex.compile(PATTERN)


class Counter(dict):
    """Tokens of a pre-token, under a rank file for tiktoken."""

    def __init__(self, rank_file: str) -> None:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHE_PIECES:
            self[piece] = n
        return n


class Tree:
    """The segment tree of a text; ``replace`` edits it, ``tokens`` is its count."""

    def __init__(self, text: str, counter: Counter) -> None:
        self.counter, self.encoded = counter, 0
        pieces = _SPLIT.findall(text)
        self.leaves: list[list[str] | None] = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.stored: list[tuple | None] = [None] * len(self.leaves)
        self._sum([sum(map(len, leaf)) for leaf in self.leaves], [self._count(leaf) for leaf in self.leaves])

    @classmethod
    def kept(cls, chars: list[int], tokens: list[int], stored: list[tuple], counter: Counter) -> Tree:
        """A tree from its leaves' sums and their (text, lengths of pieces), which are read when touched."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded, tree.leaves, tree.stored = counter, 0, [None] * len(chars), stored
        tree._sum(chars, tokens)
        return tree

    def _count(self, pieces: list[str]) -> int:
        count = self.counter
        return sum([count[p] for p in pieces])

    def _sum(self, chars: list[int], tokens: list[int]) -> None:
        """Inner nodes over the leaves' sums."""
        n = 1
        while n < len(chars):
            n *= 2
        self.width, rest = n, [0] * (n - len(chars))
        self.chars, self.sums = [0] * n + chars + rest, [0] * n + tokens + rest
        for i in range(n - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def _leaf(self, i: int) -> list[str]:
        """The pieces of a leaf."""
        got = self.leaves[i]
        if got is None:
            text, lengths = (x.as_py() for x in self.stored[i])
            ends = np.cumsum(np.frombuffer(lengths, "<u4")).tolist()
            got = self.leaves[i] = [text[a:b] for a, b in zip([0, *ends], ends)]
        return got

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def __len__(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for i in range(len(self.leaves)) for p in self._leaf(i))

    def row(self) -> tuple[list, list, list, list]:
        """Characters, tokens, texts and lengths of pieces of the leaves; those that weren't read as they were."""
        n, k = self.width, len(self.leaves)
        texts = [self.stored[i][0].as_py() if x is None else "".join(x) for i, x in enumerate(self.leaves)]
        cuts = [self.stored[i][1].as_py() if x is None else np.fromiter(map(len, x), "<u4", len(x)).tobytes() for i, x in enumerate(self.leaves)]
        return self.chars[n : n + k], self.sums[n : n + k], texts, cuts

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with character ``at`` (the last one for the end of the text), and where it starts."""
        node, start = 1, 0
        if at >= self.chars[1]:
            last = len(self.leaves) - 1
            while last and not self.chars[self.width + last]:
                last -= 1
            return last, self.chars[1] - self.chars[self.width + last]
        while node < self.width:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def replace(self, at: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters at ``at`` (both clipped to the text) by ``inserted``."""
        size = len(self)
        at = min(max(at, 0), size)
        end = min(size, at + max(deleted, 0))
        if at == end and not inserted:
            return
        lo, start = self._find(at)
        after = start + self.chars[self.width + lo]  # where the leaf behind those in hand starts
        k, pos = 0, start
        leaf = self._leaf(lo)
        hi = lo
        while k < len(leaf) and pos + len(leaf[k]) <= at:
            pos += len(leaf[k])
            k += 1
        old = leaf[k:]
        for _ in range(CONTEXT):  # back over pieces whose cuts may change
            while k == 0 and lo > 0:
                lo -= 1
                leaf = self._leaf(lo)
                k = len(leaf)
            if k == 0:
                break
            k -= 1
            pos -= len(leaf[k])
            old = [leaf[k], *old]
        head = leaf[:k]
        # old pieces from pos on, leaf by leaf, until new cuts meet old ones behind the edit
        delta = len(inserted) - (end - at)

        def following() -> None:
            nonlocal hi, after
            hi += 1
            old.extend(self._leaf(hi))
            after += self.chars[self.width + hi]

        while True:
            while after < end:
                following()
            region = "".join(old)
            changed = region[: at - pos] + inserted + region[end - pos :]
            new, met = self._meet(changed, old, pos, end, delta, after == size)
            if met is not None:
                break
            following()
        self.encoded += len(new)
        self._store(lo, hi, head + new + old[met:])

    def _meet(self, changed: str, old: list[str], pos: int, end: int, delta: int, last: bool) -> tuple[list[str], int | None]:
        """New pieces up to the first cut that is an old one behind the edit, and the old piece there.

        What follows an old cut is cut as before.  A piece is sure only if two characters follow it.
        """
        cuts, x = {}, pos
        for i, p in enumerate(old):
            if x >= end:
                cuts[x + delta] = i
            x += len(p)
        new, y = [], pos
        for m in _SPLIT.finditer(changed):
            if y in cuts and new:
                return new, cuts[y]
            if not last and m.end() + 2 > len(changed):
                return new, None
            new.append(m.group())
            y += len(m.group())
        return (new, len(old)) if last else (new, None)

    def _store(self, lo: int, hi: int, pieces: list[str]) -> None:
        """Put ``pieces`` in place of leaves lo to hi, and update the sums above them.  Leaves that become
        too long are split, which moves sums but no pieces of other leaves."""
        n, old = self.width, hi - lo + 1
        size = LEAF if len(pieces) > 8 * LEAF * old else max(1, -(-len(pieces) // old))
        parts = [pieces[i : i + size] for i in range(0, max(len(pieces), size * old), size)]
        chars, sums = [sum(map(len, x)) for x in parts], [self._count(x) for x in parts]
        self.leaves[lo : hi + 1], self.stored[lo : hi + 1] = parts, [None] * len(parts)
        if len(parts) > old:
            k = len(self.leaves) - len(parts) + old
            self._sum(self.chars[n : n + lo] + chars + self.chars[n + hi + 1 : n + k], self.sums[n : n + lo] + sums + self.sums[n + hi + 1 : n + k])
            return
        self.chars[n + lo : n + hi + 1], self.sums[n + lo : n + hi + 1] = chars, sums
        a, b = (n + lo) // 2, (n + hi) // 2
        while a:
            for i in range(a, b + 1):
                self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]
            a, b = a // 2, b // 2


EDITS = "array<struct<pos:int,deleted:int,inserted:string>>"
#: Columns of a tree besides its doc_id: the counts, and the leaves' characters, tokens, texts and the
#: lengths of their pieces as 32-bit numbers; n_edits and n_reencoded are those of the last round.
TREE = "n_tokens long, n_pretokens long, n_edits long, n_reencoded long, chars array<int>, tokens array<int>, leaves array<string>, cuts array<binary>"
_NAMES = [x.split()[0] for x in TREE.split(", ")]
_KINDS = [pa.int64()] * 4 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.string()), pa.list_(pa.binary())]


def _as_row(tree: Tree, edits: int) -> tuple:
    chars, tokens, texts, cuts = tree.row()
    return tree.tokens, sum(len(c) // 4 for c in cuts), edits, tree.encoded, chars, tokens, texts, cuts


def _counter(rank_file: str) -> Counter:
    """The worker's one counter for a file."""
    return _COUNTERS.get(rank_file) or _COUNTERS.setdefault(rank_file, Counter(rank_file))


_COUNTERS: dict[str, Counter] = {}


def _map_rows(df: DataFrame, names: list[str], taken: list[str], rank_file: str, made) -> DataFrame:
    """The columns ``names`` of ``df`` and those of ``TREE``, as ``made(counter, *values of taken)`` gives them;
    rows of a tree whose edits are null go through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(rank_file)
        for b in batches:
            if taken[0] == "edits":
                idle = b.filter(pc.is_null(b.column("edits")))
                if idle.num_rows:
                    none = pa.array(np.zeros(idle.num_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([none if c in ("n_edits", "n_reencoded") else idle.column(c) for c in (*names, *_NAMES)], [*names, *_NAMES])
                b = b.filter(pc.is_valid(b.column("edits")))
            rows = [made(counter, *values) for values in zip(*(b.column(c) for c in taken))]
            cols = list(zip(*rows)) or [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(c, k) for c, k in zip(cols, _KINDS))], [*names, *_NAMES])

    common.bounded_batches(df.sparkSession)
    kind = df.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(x.split(" ", 1)[1]).alias(x.split()[0]) for x in TREE.split(", ")]).schema
    return df.mapInArrow(run, kind)


def build_trees(docs: DataFrame, rank_file: str) -> DataFrame:
    """The columns of ``docs`` but its text, and the tree of each row (see ``TREE``).

    A null text is empty.  Columns of ``docs`` with the name of one of a tree give way.  Each row has a
    tree of its own, also where a doc_id repeats.
    """
    names = [c for c in docs.columns if c not in (*_NAMES, "text")]
    df = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    return _map_rows(df, names, ["text"], rank_file, lambda counter, text: _as_row(Tree(text.as_py() or "", counter), 0))


def edit_trees(trees: DataFrame, rank_file: str) -> DataFrame:
    """The next version of ``trees`` that have their edits beside them in a column ``edits`` (see ``EDITS``),
    without that column.

    Edits are made one after the other, each on the text that the last one left; positions are in
    characters and are clipped to the text.  Null edits, and null parts of one, are none.
    """
    names = [c for c in trees.columns if c not in (*_NAMES, "edits")]

    def edited(counter: Counter, edits, chars, tokens, leaves, cuts) -> tuple:
        tree = Tree.kept(chars.as_py(), tokens.as_py(), list(zip(leaves.values, cuts.values)), counter)
        made = [e for e in edits.as_py() or [] if e]
        for e in made:
            tree.replace(e["pos"] or 0, e["deleted"] or 0, e["inserted"] or "")
        return _as_row(tree, len(made))

    return _map_rows(trees, names, ["edits", "chars", "tokens", "leaves", "cuts"], rank_file, edited)


def apply_edits(trees: DataFrame, edits: DataFrame, rank_file: str) -> DataFrame:
    """The next version of ``trees`` after ``edits`` (doc_id, seq, pos, deleted, inserted), in the order of seq.

    Trees without edits go through as they are, with n_edits and n_reencoded 0.  Edits of a doc_id that
    several trees have are made in each; those of a null or unknown doc_id in none.  All edits of a
    document are made by one task, since each stands on the last one.
    """
    trees = trees.drop("edits")
    e = F.struct("seq", "pos", "deleted", "inserted")
    own = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(e)).alias("_e"))
    own = own.select("doc_id", F.transform("_e", lambda x: F.struct(x["pos"].cast("int").alias("pos"), x["deleted"].cast("int").alias("deleted"), x["inserted"].alias("inserted"))).alias("edits"))
    return edit_trees(trees.join(own, "doc_id", "left"), rank_file).select([F.col(f"`{c}`") for c in trees.columns])


def count_edits(docs: DataFrame, rank_file: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_edits, n_reencoded, n_pretokens) from (doc_id, text, edits): trees
    are built and written to the shared folder, and edited from there."""
    trees = common.stored(build_trees(docs.select("doc_id", "text", "edits"), rank_file), "token-trees", "zstd")
    before = trees.select("*", F.col("n_tokens").alias("_before"), F.col("n_pretokens").alias("_pretokens"))
    return edit_trees(before, rank_file).select("doc_id", F.col("_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", "n_reencoded", F.col("_pretokens").alias("n_pretokens"))


def derived_edits(n: int = 3, text: str = "text") -> Column:
    """``n`` edits of a text that hang on its row alone: at a hashed place, up to 15 characters give way
    to 24 characters from another place of the text."""
    size = F.greatest(F.length(text), F.lit(1))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), size.cast("long")).cast("int")
    one = lambda k: F.struct(
        place(3 * k).alias("pos"),
        F.pmod(F.xxhash64("doc_id", F.lit(3 * k + 1)), F.lit(16)).cast("int").alias("deleted"),
        F.substring(F.col(text), place(3 * k + 2) + 1, F.lit(24)).alias("inserted"),
    )
    return F.array(*[one(k) for k in range(n)])
