"""Quality rules: base counts of a text, and the fertility of a public tokenizer on its words.

Words are encoded with a sentencepiece vocabulary that falls back to bytes.  Measured
are characters per token, the share of byte tokens, and the entropy of the text's tokens.  A text
outside the band of its language, or else of its script, is rejected.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimloom.llm import common
from claimloom.llm.near_dedup import mixed_bits


@dataclass(frozen=True)
class Band:
    """What a text may have: characters per token, share of byte tokens, and token entropy in bits over
    the entropy of as many different tokens (with ``full`` tokens as the most that count)."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float
    entropy_high: float = 1.01


#: Bands by language, and for other languages by script.
BANDS = {
    "en": Band(1.5, 5.5, 0.05, 0.68),
    "de": Band(1.5, 5.5, 0.05, 0.67),
    "fr": Band(1.3, 5.5, 0.05, 0.66),
    "es": Band(1.3, 5.5, 0.05, 0.66),
    "latin": Band(1.2, 5.5, 0.10, 0.64),
    "other": Band(0.3, 5.0, 0.60, 0.40),
}
#: Entropy is measured against that of this many equally frequent tokens, or of the text's own number if less.
FULL_TOKENS = 512

MIN_WORDS = 50
#: Words whose tokens a worker keeps: the first ones seen.
CACHE_WORDS = 150_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts named in ``COUNTS``.  Words are runs without ASCII white space."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.encode().split(b"\n") if x.strip()]
    repeated = 0
    if n >= 3:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        windows = mixed_bits(mixed_bits(h[:-2]) + h[1:-1]) + h[2:]
        order = np.argsort(windows)
        same = windows[order[1:]] == windows[order[:-1]]
        at = np.concatenate([order[1:][same], order[:-1][same]])
        inside = np.zeros(n, bool)
        for i in range(3):
            inside[at + i] = True
        repeated = int(inside.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


class Fertility:
    """Measures of texts under a sentencepiece vocabulary, word by word."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])
        self.words: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        """The tokens of words; a word's tokens don't hang on its neighbours."""
        known = self.words
        new = [w for w in words if w not in known]
        if not new:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint16)
        now = dict(zip(new, (array("H", x).tobytes() for x in self.model.encode([w.decode() for w in new], num_threads=1))))
        out = b"".join([known.get(w) or now[w] for w in words])
        if len(known) < CACHE_WORDS:
            known.update(now)
        return np.frombuffer(out, np.uint16)

    def measure(self, text: str | None) -> tuple[float, float, float]:
        """(characters per token, share of byte tokens, entropy over its full value); 0 without words."""
        text = text or ""
        words = text.encode().split()
        if not words:
            return 0.0, 0.0, 0.0
        counts = np.zeros(self.size, np.int64)
        for at in range(0, len(words), 50_000):
            counts += np.bincount(self._ids(words[at : at + 50_000]), minlength=self.size)
        distinct = np.flatnonzero(counts)
        counts = counts[distinct]
        n = int(counts.sum())
        if not n:
            return 0.0, 0.0, 0.0
        chars = len(text) - sum(map(text.count, _SPACES))
        p = counts / n
        entropy = float(-(p * np.log2(p)).sum()) / np.log2(max(2, min(n, FULL_TOKENS)))
        return chars / n, float(counts[self.is_byte[distinct]].sum()) / n, entropy


def script_of(text: str) -> str:
    """"latin" if at least half of the text's letters are below U+0250, else "other"."""
    letters = {c: n for c, n in Counter(text).items() if c.isalpha()}
    return "latin" if 2 * sum(n for c, n in letters.items() if c < "ɐ") >= sum(letters.values()) else "other"


def accepted(measures: tuple[float, float, float], band: Band) -> bool:
    chars, share, entropy = measures
    return band.chars_low <= chars <= band.chars_high and share <= band.bytes_high and band.entropy_low <= entropy <= band.entropy_high


def judge(docs: DataFrame, model_file: str, bands: dict[str, Band] = BANDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, chars_per_token, byte_share, token_entropy, kept.

    Null and empty texts have no words and fail.  A null or unknown lang (or no such column) goes by
    the script.  Columns of ``docs`` with a name of the result give way.  Each row is judged alone.
    """
    made = T.StructType(
        [T.StructField(c, T.LongType()) for c in COUNTS]
        + [T.StructField("base_failed", T.BooleanType())]
        + [T.StructField(c, T.DoubleType()) for c in MEASURES]
        + [T.StructField("kept", T.BooleanType())]
    )
    names = [c for c in docs.columns if c not in made.names]
    out = docs.select([F.col(f"`{c}`") for c in names])
    text_at, lang_at = names.index("text"), names.index("lang") if "lang" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Fertility(model_file)
        for b in batches:
            rows = []
            langs = b.column(lang_at).to_pylist() if lang_at is not None else [None] * b.num_rows
            for text, lang in zip(b.column(text_at), langs):
                text = text.as_py()
                counts = base_counts(text)
                failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
                measures = tokens.measure(text)
                band = bands.get(lang) or bands[script_of(text or "")]
                rows.append((*counts, failed, *measures, not failed and accepted(measures, band)))
            cols = list(zip(*rows)) or [()] * len(made)
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], [*names, *made.names])

    common.bounded_batches(docs.sparkSession)
    return out.mapInArrow(run, T.StructType(out.schema.fields + made.fields))
