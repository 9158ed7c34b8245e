"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature, in cycles, on binned features; each tree is added to
its feature's lookup table.  Then the pairs of features that explain most of what is left get
tables of their own.  A score is the sum of one lookup per feature and pair, through a logistic.

Features come from the text alone.  All texts are scored; the fit uses at most
``max_train_rows`` labelled rows, chosen by hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common

FEATURES = (
    "log_words", "word_len", "upper", "digit", "marks", "bangs", "pipes", "stops", "high_bytes", "line_words",
    "distinct", "twins", "dup_lines", "odd_ends", "top_word", "caps_words",
)

_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_MARKS, _BANGS = np.zeros(256, bool), np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&<>@^~_=+\\/{}[]"]] = True
_BANGS[[ord(c) for c in "!?"]] = True


def features_of(text: str | None) -> list[float]:
    """The features of a text; null and empty texts have none of anything."""
    text = text or ""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = max(1, int(counts.sum()))
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    letters = max(1, int(counts[_UPPER].sum() + counts[_LOWER].sum()))
    m = max(1, n)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / m,
        counts[_UPPER].sum() / letters,
        counts[_DIGIT].sum() / size,
        counts[_MARKS].sum() / size,
        counts[_BANGS].sum() / size,
        counts[ord("|")] / size,
        (counts[ord(".")] + counts[ord(",")]) / size,
        counts[128:].sum() / size,
        float(np.log1p(n / max(1, len(lines)))),
        len(seen) / m,
        sum(map(str.__eq__, words[1:], words)) / m,
        1 - len(set(lines)) / max(1, len(lines)),
        sum(1 for w in seen if not (w[-1].isalnum() or w[-1] in ".,;:!?)\"'")) / max(1, len(seen)),
        max(seen.values(), default=0) / m,
        sum(1 for w in seen if len(w) > 1 and w.isupper()) / max(1, len(seen)),
    ]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, f): a row per document with its features, in the order of ``FEATURES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "f"])

    common.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {kind}, f array<float>")


@dataclass
class Model:
    """Lookup tables of an additive model: ``edges`` cut a feature into bins, ``tables`` has a value
    per bin, ``pairs`` one per pair of coarse bins."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.intercept)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for (i, j), t in self.pairs.items():
            out += t[self.coarse[i][bins[:, i]], self.coarse[j][bins[:, j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.bins(x))))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Newton steps of a tree with few leaves over ordered bins with gradients g and Hessians h."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + 1.0)
    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            at = np.arange(a + 1, b)
            if len(at):
                ok = (hs[at] - hs[a] >= least) & (hs[b] - hs[at] >= least)
                won = np.where(ok, gain(a, at) + gain(at, b) - gain(a, b), -1)
                if won.max() > best[0]:
                    best = (won.max(), int(at[won.argmax()]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 32, leaves: int = 4, pairs: int = 6, pair_rounds: int = 60, pair_bins: int = 8) -> Model:
    """Fit on rows x with labels y (0 or 1).  Without rows of both labels the model is a constant."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = Model(edges)
    base = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(base / (1 - base)))
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    model.coarse = [np.minimum(np.arange(len(e) + 1) * pair_bins // max(1, len(e) + 1), pair_bins - 1) for e in edges]
    if len(set(y.tolist())) < 2:
        return model
    b = model.bins(x)
    m = np.full(len(y), model.intercept)

    def grads() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-m))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = grads()
            step = rate * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), leaves, 1.0)
            table += step
            m += step[b[:, k]]
    c = np.stack([model.coarse[k][b[:, k]] for k in range(x.shape[1])], 1)
    g, h = grads()
    worth = {}
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            cell = c[:, i] * pair_bins + c[:, j]
            gg, hh = np.bincount(cell, g, pair_bins**2), np.bincount(cell, h, pair_bins**2)
            worth[i, j] = float((gg**2 / (hh + 5.0)).sum())
    chosen = sorted(worth, key=lambda p: (-worth[p], p))[:pairs]
    model.pairs = {p: np.zeros((pair_bins, pair_bins)) for p in chosen}
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            g, h = grads()
            cell = c[:, i] * pair_bins + c[:, j]
            gg, hh = (np.bincount(cell, v, pair_bins**2).reshape(pair_bins, pair_bins) for v in (g, h))
            rows = _tree(gg.sum(1), hh.sum(1), 2, 1.0)
            step = np.zeros_like(table)
            for part in (rows == rows[0], rows != rows[0]):  # a split of the first feature, then one of the second in each half
                if part.any():
                    step[part] = _tree(gg[part].sum(0), hh[part].sum(0), 2, 1.0)
            table += rate * step
            m += rate * step[c[:, i], c[:, j]]
    return model


def fit_on(features: DataFrame, labels: DataFrame, label: str, train: Column, max_train_rows: int) -> Model:
    """Fit on the labelled rows where ``train`` holds; of more than ``max_train_rows``, those whose
    hash of doc_id falls in the share that makes as many.  A doc_id with several labels, or several
    texts, gives a row for each; null labels and null doc_ids give none."""
    known = labels.filter(F.col(label).isNotNull()).select("doc_id", F.col(label).alias("y")).filter(train)
    n = known.count()
    if n > max_train_rows:
        share = int(max_train_rows / n * 1_000_000)
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < share)
    rows = features.join(known, "doc_id")
    got = rows.select("doc_id", "f", "y").toArrow().sort_by("doc_id")
    x = np.array(got.column("f").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(got.column("y").to_pylist(), np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", threshold: float = 0.7, max_train_rows: int = 40_000) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    Each text is read once; what is shuffled and stored are 16 numbers a document.  Null and empty
    texts get a score like any other.  Rows that repeat a doc_id are scored one by one.
    """
    features = common.stored(with_features(docs.select("doc_id", "text")), "quality-features")
    model = fit_on(features, labels, label, train, max_train_rows)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, len(FEATURES))
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return features.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
