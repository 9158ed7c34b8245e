"""Spelling variants: words one edit apart, found over a reduced alphabet.

Letters are hashed to a few symbols, so that a word becomes a short reduced word.  Two words one edit
apart have reduced words that are equal or one edit apart; the full one-edit neighbourhood of a reduced
word is small, since few symbols can be put in.  Neighbourhoods are joined with the reduced vocabulary,
and what meets is verified on the original strings.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common

#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Neighbours that a task computes at a time.
CELLS = 1 << 21

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


def slipped_words(docs: DataFrame, least_length: int = 7, every: int = 31) -> DataFrame:
    """(word, n): the words of the texts, with slips.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased.  h is the crc32 of
    ``<doc_id>:<run>``; where ``every`` divides it, the run loses its code point h % length.  Words of
    fewer than ``least_length`` code points go.  Null texts have no words; a null doc_id counts as
    empty; rows that repeat count again.
    """
    runs = re.compile(rb"[a-z\xc0-\xff]{%d,}" % max(1, least_length))

    def flush(held: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in held], pa.string())
        out = pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], ["word", "n"])
        held.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = Counter(runs.findall(text.as_py().encode("latin-1", "replace").lower()))
                start = zlib.crc32(f"{doc_id or ''}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    held[w] += n
                if len(held) > HELD_WORDS:
                    yield flush(held)
        if held:
            yield flush(held)

    common.bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("string"), "text")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols_for(n_words: int) -> int:
    """How many symbols keep both the neighbourhoods and the words that share a reduced word few: about
    the tenth root of the number of words.  The result doesn't hang on it, only the work does."""
    return int(min(64, max(3, np.ceil(max(1, n_words) ** 0.1))))


def _symbols(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols (1 to ``symbols``) of all words in a row, and each word's length."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = (codes + np.uint64(1)) * np.uint64(_BASE)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(32)) % np.uint64(symbols) + np.uint64(1), np.fromiter(map(len, words), np.int64, len(words))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def reduced_keys(words: list[str], symbols: int) -> np.ndarray:
    """A 64-bit key of each reduced word: a polynomial over its symbols.  Equal reduced words have equal
    keys; unequal ones that have, too, only add candidates."""
    s, lengths = _symbols(words, symbols)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(s)) - np.repeat(starts, lengths)
    out = np.zeros(len(words), np.uint64)
    full = lengths > 0
    if full.any():
        out[full] = np.add.reduceat(s * _powers(int(lengths.max()))[at], starts[full])
    return out.view(np.int64)


def reduced_words(words: list[str], symbols: int) -> list[str]:
    """The reduced words, a character for a symbol."""
    s, lengths = _symbols(words, symbols)
    text = (s + np.uint64(47)).astype(np.uint8).tobytes().decode("ascii")
    ends = np.cumsum(lengths).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def neighbourhoods(words: list[str], symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, key) of all reduced words one edit away from the word's reduced word whose key is
    greater than its own, each once; so that of two neighbours just one finds the other."""
    s, lengths = _symbols(words, symbols)
    starts = np.cumsum(lengths) - lengths
    put = np.arange(1, symbols + 1, dtype=np.uint64)
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        power = _powers(n + 1)
        step = max(1, CELLS // max(1, (2 * symbols + 1) * (n + 1)))
        for part in (rows[i : i + step] for i in range(0, len(rows), step)):
            m = s[starts[part][:, None] + np.arange(n)] if n else np.zeros((len(part), 0), np.uint64)
            term = m * power[:n]
            before = np.zeros((len(part), n + 1), np.uint64)
            np.add.accumulate(term, axis=1, out=before[:, 1:])
            own = before[:, -1:]
            after = own - before  # of the symbols from a place on
            shorter = before[:, :-1] + after[:, 1:] * np.uint64(_INVERSE)
            changed = own[:, :, None] + (put - m[:, :, None]) * power[:n, None]
            longer = (before + after * np.uint64(_BASE))[:, :, None] + put * power[:, None]
            keys = np.concatenate([shorter, changed.reshape(len(part), n * symbols), longer.reshape(len(part), (n + 1) * symbols)], 1).view(np.int64)
            keys.sort(axis=1)
            new = keys > own.view(np.int64)
            new[:, 1:] &= keys[:, 1:] != keys[:, :-1]
            i, j = np.nonzero(new)
            yield part[i], keys[i, j]


def near_pairs(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """(a, b, a_n, b_n): the pairs of distinct words of ``vocabulary`` (word, n) that differ by exactly one inserted,
    deleted or replaced code point, each once."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reduced_keys(plain, symbols)), pa.array(reduced_words(plain, symbols))], ["word", "n", "key", "reduced"])

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy()
            for i, keys in neighbourhoods(b.column(1).to_pylist(), symbols):
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(keys)], ["key", "other"])

    common.bounded_batches(vocabulary.sparkSession)
    words = common.stored(vocabulary.select("word", "n").mapInArrow(reduce, "word string, n long, key long, reduced string"), "spelling-words")
    forms = words.groupBy("key", "reduced").agg(F.min("word").alias("word"))
    reached = forms.select("key", "word").mapInArrow(widen, "key long, other long")
    pairs = reached.join(words.select(F.col("key").alias("other")).distinct(), "other")
    left = words.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = words.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    apart = left.join(pairs, "key").join(right, "other")
    alike = left.join(right, F.col("key") == F.col("other")).filter(F.col("a") < F.col("b"))
    columns = ("a", "b", "a_n", "b_n")
    both = apart.select(*columns).union(alike.select(*columns))
    return both.filter(F.levenshtein("a", "b", 1) == 1).distinct()  # a pair comes twice only where keys collide


def spelling_forms(vocabulary: DataFrame, ratio: int = 10, symbols: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary`` (word, n; a word stands once).

    A word's form is its near word of the largest n (ties: the smallest in code-point order), if that n is at
    least ``ratio`` times its own.  Its root follows forms to the last one; each step multiplies n, so that
    chains are short.  ``symbols`` is the size of the reduced alphabet, by default ``symbols_for`` the vocabulary.
    Words with a null n, and null words, are left out.  An empty vocabulary gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 at least, else chains of forms may have no end")
    known = common.stored(vocabulary.filter("word IS NOT NULL AND n IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-vocabulary")
    pairs = common.stored(near_pairs(known, symbols or symbols_for(known.count())), "spelling-pairs")
    ends = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    ends = ends.union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    out = known.join(best, "word", "left")
    has = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    out = out.select(
        "word", F.when(has, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("best.n")).alias("form_n"),
    )
    out = common.stored(out, "spelling-forms")
    follows = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps that a root has gone; a form's n grows by ratio each step
        on = follows.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        jumped = common.stored(follows.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "spelling-roots")
        follows = jumped.select("word", "root")
        if jumped.filter("moved").isEmpty():
            break
    return out.join(follows, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
