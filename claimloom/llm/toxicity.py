"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model of their
accuracies and correlations, and a linear classifier trained on the model's posterior labels.

1. Terms are hashed word starts of 3 to 6 letters and whole words.  Terms that toxic rows of a bounded
   labelled sample have far more often than others become lexicons, by kind and strength.
2. Each document gets votes (toxic, clean, none): of every lexicon, of a short list of insults, of
   patterns of writing, and, where it is known for training, of the label itself.
3. The label model takes the true class as hidden.  Given the class, voters form a forest: each depends on
   at most one other, namely where their votes are correlated within the classes over all documents.  It is
   fitted by expectation and maximisation over the votes of all documents, counted by pattern.
4. A logistic regression on terms and patterns is trained on the posteriors of the sample.

Texts are read twice: the sample for the terms, then all once for the hits, which are stored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.llm import common

#: Words that insult, as a person would list them.
INSULTS = (
    "idiot", "idiots", "moron", "stupid", "dumb", "scum", "trash", "loser", "losers", "pathetic", "worthless", "disgusting", "clown", "imbecile", "fool", "ugly",
    "freak", "jerk", "bastard", "bitch", "crap", "damn", "shit", "fuck", "fucking", "asshole", "dummkopf", "arschloch", "idiota", "estúpido", "imbécil", "connard", "salaud",
)
KINDS = 5  # word starts of 3, 4, 5 and 6 letters; whole words
BITS = 18
BUCKETS = 1 << BITS
#: Terms that lexicons and classifier take at most, the strongest first.
MAX_TERMS = 2_048
PATTERNS = ("upper", "bangs", "marks", "digits", "masked", "repeats", "second_person", "log_words")
_PATTERN_BOUNDS = (0.5, 0.02, 0.05, 0.05, 0.0, 0.2, 0.0)  # what a pattern must exceed to vote
_MASKED = re.compile(r"[A-Za-z][*#@$]{2,}[A-Za-z]?")
_ADDRESS = re.compile(r"\b(?:you|your|du|dein|tu|vous)\b[^.!?\n]{0,40}!", re.IGNORECASE)
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
#: A kind's strongest terms make its first lexicon, as long as they are in so many of the clean rows together; the
#: next make its second.  The rest don't vote, but the classifier sees them: together they would tell long texts.
LEXICON_RATES = (0.003, 0.012)
STRENGTHS = len(LEXICON_RATES)
VOTERS = (
    *(f"{kind}_{band}" for kind in ("start3", "start4", "start5", "start6", "word") for band in ("strong", "middle")),
    "insults", "several_terms", *PATTERNS[:-1], "label",
)

_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint64(kind + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    return (h * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


def terms_of(texts: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words a text, and for each kind the (index of the text, bucket) of its terms, in text order.

    A word is a run of letters, lower-cased.  A kind that takes k letters skips shorter words; a whole word is
    told by its first 8 letters, its last 4 and its length.
    """
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered))
    codes = np.frombuffer(("\n".join(lowered) + "\n" if lowered else "").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.concatenate([[False], _LETTER[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF), [False]])
    turn = np.flatnonzero(letter[1:] != letter[:-1])
    start, length = turn[::2], turn[1::2] - turn[::2]
    of = np.repeat(np.arange(len(texts)), sizes)[start] if len(start) else np.zeros(0, np.int64)
    padded = np.concatenate([codes, np.zeros(8, np.uint32)]).astype(np.uint64)
    out, h = [], np.zeros(len(start), np.uint64)
    for k in range(8):
        h = np.where(length > k, (h + padded[start + k] + np.uint64(1)) * _BASE, h)
        if 2 <= k <= 5:
            long = length > k
            out.append((of[long], _mixed(h[long], k).astype(np.int64)))
    for k in range(4):
        h = (h + padded[start + np.maximum(length - 1 - k, 0)]) * _BASE
    out.append((of, _mixed(h + length.astype(np.uint64), 9).astype(np.int64)))
    return np.bincount(of, minlength=len(texts)), out


def patterns_of(text: str, n_words: int) -> list[float]:
    """How a text is written, in the order of ``PATTERNS``."""
    n = max(1, len(text))
    letters = max(1, sum(map(text.count, "aeiou")) + (upper := sum(map(text.count, "AEIOU"))))
    bangs = text.count("!")
    return [
        upper / letters, bangs / n, sum(map(text.count, "#*$%&@")) / n, sum(map(text.count, "0123456789")) / n,
        float(bool(_MASKED.search(text))), (text.count("!!") + text.count("??")) / max(1, n_words), float(bangs and bool(_ADDRESS.search(text))), float(np.log1p(n_words)),
    ]


@dataclass
class Terms:
    """The chosen terms: ``index`` of a (kind, bucket), or -1; ``kind`` and lexicon (``band``) of an index."""

    index: np.ndarray
    kind: np.ndarray
    band: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[int, int, float]]) -> Terms:
        """From (kind, bucket, share of clean rows), the strongest first."""
        index = np.full((KINDS, BUCKETS), -1, np.int32)
        kinds, rates = np.array([x[0] for x in found], np.int32), np.array([x[2] for x in found])
        band = np.zeros(len(found), np.int32)
        for kind in range(KINDS):
            band[kinds == kind] = np.searchsorted(np.cumsum(LEXICON_RATES), np.cumsum(rates[kinds == kind]))
        index[kinds, np.array([x[1] for x in found], np.int32)] = np.arange(len(found))
        return cls(index, kinds, band)


_INSULT_BUCKETS = np.zeros(BUCKETS, bool)
_INSULT_BUCKETS[terms_of(list(INSULTS))[1][4][1]] = True


def _term_counts(rows: DataFrame) -> DataFrame:
    """(kind, bucket, toxic, clean): sample rows (text, y) that have a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((KINDS, 2, BUCKETS), np.int32)
        for b in batches:
            y = b.column(1).to_numpy()
            _, kinds = terms_of([t.as_py() or "" for t in b.column(0)])
            for k, (of, bucket) in enumerate(kinds):
                once = np.unique(of * BUCKETS + bucket)
                for label in (0, 1):
                    held[k, label] += np.bincount(once[y[once // BUCKETS] == label] % BUCKETS, minlength=BUCKETS).astype(np.int32)
        for k in range(KINDS):
            at = np.flatnonzero(held[k].any(0))
            columns = [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[k, 1, at].astype(np.int64)), pa.array(held[k, 0, at].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "bucket", "toxic", "clean"])

    parts = rows.mapInArrow(run, "kind int, bucket int, toxic long, clean long")
    return parts.groupBy("kind", "bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_terms(rows: DataFrame, n_toxic: int, n_clean: int, least_ratio: float = 4.0, least_z: float = 5.0) -> Terms:
    """Terms that toxic rows have at least ``least_ratio`` times as often, beyond chance by ``least_z`` deviations."""
    t, c = F.col("toxic") + F.lit(0.0), F.col("clean") + F.lit(0.0)
    p, q = t / max(1, n_toxic), (c + 0.5) / (n_clean + 1)
    both = (t + c) / max(1, n_toxic + n_clean)
    z = (t / max(1, n_toxic) - c / max(1, n_clean)) / F.sqrt(both * (1 - both) * (1 / max(1, n_toxic) + 1 / max(1, n_clean)) + F.lit(1e-12))
    found = _term_counts(rows).filter(t >= 3).withColumn("odds", F.log(p / q)).withColumn("z", z)
    found = found.filter((F.col("odds") >= float(np.log(least_ratio))) & (F.col("z") >= least_z))
    best = found.orderBy(F.desc("z"), "kind", "bucket").limit(MAX_TERMS).select("kind", "bucket", c / max(1, n_clean)).collect()
    return Terms.of([tuple(r) for r in best])


HITS = "doc_id {}, terms array<int>, counts array<int>, insults int, patterns array<float>"


def with_hits(docs: DataFrame, terms: Terms) -> DataFrame:
    """(doc_id, terms, counts, insults, patterns): the chosen terms that a text has, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            n_words, kinds = terms_of(texts)
            of, got = [], []
            for k, (doc, bucket) in enumerate(kinds):
                at = terms.index[k, bucket]
                of.append(doc[at >= 0])
                got.append(at[at >= 0])
            insults = np.bincount(kinds[4][0][_INSULT_BUCKETS[kinds[4][1]]], minlength=len(texts)).astype(np.int32)
            keys, counts = np.unique(np.concatenate(of) * MAX_TERMS + np.concatenate(got), return_counts=True)
            ends = pa.array(np.searchsorted(keys // MAX_TERMS, np.arange(len(texts) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (keys % MAX_TERMS, counts)]
            marks = pa.array([patterns_of(t, int(n)) for t, n in zip(texts, n_words)], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *lists, pa.array(insults), marks], ["doc_id", "terms", "counts", "insults", "patterns"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, HITS.format(kind))


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and index of each hit, its count; insults and patterns a row."""
    lists = b.column("terms")
    row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
    return row, lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy(), b.column("insults").to_numpy(), b.column("patterns").flatten().to_numpy().reshape(-1, len(PATTERNS))


def votes_of(b: pa.RecordBatch, terms: Terms, label: np.ndarray) -> np.ndarray:
    """A row per document, a column per voter.  ``label`` is 0, 1, or -1 where it isn't known for training."""
    row, term, _, insults, marks = _columns(b)
    out = np.zeros((b.num_rows, len(VOTERS)), np.int8)
    voting = terms.band[term] < STRENGTHS
    out[row[voting], (terms.kind[term] * STRENGTHS + terms.band[term])[voting]] = TOXIC
    n = KINDS * STRENGTHS
    none = (out == ABSTAIN).all(1) & (insults == 0)
    for k in range(0, n, STRENGTHS):  # a kind of which no lexicon has a hit says clean, by its strong one
        out[(out[:, k : k + STRENGTHS] == ABSTAIN).all(1), k] = CLEAN
    out[:, n] = np.where(insults > 0, TOXIC, ABSTAIN)
    out[:, n + 1] = np.where(np.bincount(row[voting], minlength=b.num_rows) >= 3, TOXIC, np.where(none, CLEAN, ABSTAIN))
    out[:, n + 2 : -1] = np.where(marks[:, :-1] > np.array(_PATTERN_BOUNDS), TOXIC, ABSTAIN)
    out[:, -1] = np.where(label < 0, ABSTAIN, label + 1)
    return out


@dataclass
class LabelModel:
    """P(class) and, for each voter, P(vote | vote of its parent, class); roots have themselves as parent."""

    prior: float
    parent: np.ndarray
    tables: np.ndarray  # (voter, class, parent's vote, vote)

    @classmethod
    def start(cls, prior: float) -> LabelModel:
        """Voters are independent and a little better than chance; the label nearly always right."""
        m = len(VOTERS)
        t = np.zeros((m, 2, 3, 3))
        t[:, 0], t[:, 1] = (0.6, 0.36, 0.04), (0.6, 0.1, 0.3)
        t[-1, 0], t[-1, 1] = (0.6, 0.399, 0.001), (0.6, 0.001, 0.399)
        return cls(prior, np.arange(m), t)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic) of each row of votes."""
        logs = np.log(self.tables)
        at = np.arange(votes.shape[1])
        up = np.where(self.parent == at, 0, votes[:, self.parent])
        odds = np.log(self.prior) - np.log(1 - self.prior) + (logs[at, 1, up, votes] - logs[at, 0, up, votes]).sum(1)
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def joint(self, votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts (class, voter, vote, voter, vote) of rows of votes."""
        m = votes.shape[1]
        hot = np.zeros((len(votes), m, 3))
        hot[np.arange(len(votes))[:, None], np.arange(m), votes] = 1
        hot = hot.reshape(len(votes), m * 3)
        q = self.posterior(votes) * weight
        return np.stack([hot.T @ (hot * w[:, None]) for w in (weight - q, q)]).reshape(2, m, 3, m, 3)

    @classmethod
    def fitted(cls, joint: np.ndarray, prior: float, least: float = 0.01) -> LabelModel:
        """From expected counts; the prior stays.  Voters whose votes tell most of each other within the classes
        (conditional mutual information of ``least`` bits or more) are linked, as a forest."""
        m = joint.shape[1]
        at = np.arange(m)
        per_class = joint[:, 0, :, 0, :].sum((1, 2))
        single = joint[:, at, :, at, :].transpose(1, 0, 2, 3).diagonal(axis1=2, axis2=3)  # class, voter, vote
        parent = at.copy()
        p = (joint + 1e-9) / max(1.0, float(per_class.sum()))
        ps = (single + 1e-9) / max(1.0, float(per_class.sum()))
        pc = ps.sum(2)
        told = (p * np.log2(p * pc[:, :, None, None, None] / (ps[:, :, :, None, None] * ps[:, None, None, :, :]))).sum((0, 2, 4))
        group = at.copy()
        order = sorted(((float(told[i, j]), i, j) for i in range(m - 1) for j in range(i + 1, m - 1)), reverse=True)  # the label's voter stays free
        links: dict[int, list[int]] = {k: [] for k in range(m)}
        for bits, i, j in order:
            if bits >= least and group[i] != group[j]:
                group[group == group[j]] = group[i]
                links[i].append(j)
                links[j].append(i)
        seen: set[int] = set()
        for root in range(m):
            todo = [] if root in seen else [root]
            while todo:
                seen.add(k := todo.pop())
                for child in links[k]:
                    if child not in seen:
                        parent[child] = k
                        todo.append(child)
        tables = np.empty((m, 2, 3, 3))
        for k in range(m):
            free = single[:, k] + 0.5
            free /= free.sum(1, keepdims=True)
            if parent[k] == k:
                tables[k] = free[:, None, :]
            else:  # shrunk to the vote's own share, as if seen four times more
                c = joint[:, parent[k], :, k, :] + 4 * free[:, None, :]
                tables[k] = c / c.sum(2, keepdims=True)
        tables[-1] = _label_table(single[:, -1])
        return cls(prior, parent, tables)


def _label_table(counts: np.ndarray) -> np.ndarray:
    """The label's own table: whether a row is labelled says nothing; a label is wrong in a hundredth at most."""
    seen = counts[:, 1:] + np.array([[19, 1], [1, 19]])
    right = np.clip(np.array([seen[0, 0] / seen[0].sum(), seen[1, 1] / seen[1].sum()]), 0.99, 0.9995)
    share = np.clip(counts[:, 1:].sum() / max(1.0, counts.sum()), 0.01, 0.99)
    out = np.array([[1 - share, share * right[0], share * (1 - right[0])], [1 - share, share * (1 - right[1]), share * right[1]]])
    return np.repeat(out[:, None, :], 3, 1)


def fit_label_model(patterns: DataFrame, prior: float, rounds: int = 5, labelled: bool = True) -> LabelModel:
    """Fit on (votes, n), a row per pattern of votes, in ``rounds`` rounds; each links the voters anew.  If there are
    labelled rows, the first round counts these alone, so that the hidden class starts as theirs.  Tasks add up
    expected counts; a few thousand sums reach the driver."""
    m = len(VOTERS)
    model = LabelModel.start(prior)
    for k in range(rounds):
        now, first = model, labelled and not k

        def run(batches: Iterator[pa.RecordBatch], now: LabelModel = now, first: bool = first) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * m * 3 * m * 3)
            for b in batches:
                votes = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int8).reshape(-1, m)
                n = b.column(1).to_numpy().astype(float)
                total += now.joint(votes, n * (votes[:, -1] != ABSTAIN) if first else n).ravel()
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "sum"])

        sums = patterns.mapInArrow(run, "at int, sum double").groupBy("at").agg(F.sum("sum").alias("sum")).toPandas()
        joint = np.zeros(2 * m * 3 * m * 3)
        joint[sums["at"].to_numpy()] = sums["sum"].to_numpy()
        model = LabelModel.fitted(joint.reshape(2, m, 3, m, 3), prior)
    return model


def term_values(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the classifier sees: row, place and value of the hits (1 and log(count) more for a term; in a second
    block its share of the words), and the patterns, the log of the words apart."""
    row, term, counts, _, marks = _columns(b)
    words = np.expm1(marks[:, -1].astype(float)) + 20
    share = np.minimum(300 * counts / words[row], 5.0)
    return np.concatenate([row, row]), np.concatenate([term, term + MAX_TERMS]), np.concatenate([1 + np.log(counts), share]), np.minimum(marks[:, :-1] / (np.array(_PATTERN_BOUNDS) + 0.05), 4.0)


@dataclass
class Linear:
    """Logistic regression over terms and patterns."""

    terms: np.ndarray
    marks: np.ndarray
    bias: float

    def score(self, b: pa.RecordBatch) -> np.ndarray:
        row, at, x, m = term_values(b)
        margin = self.bias + m @ self.marks + np.bincount(row, self.terms[at] * x, minlength=b.num_rows)
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def fit_linear(b: pa.RecordBatch, q: np.ndarray, rounds: int = 400, ridge: float = 0.5) -> Linear:
    """Fit to posteriors q by gradient steps with a step per weight; weights are drawn to 0 by ``ridge``."""
    row, at, x, m = term_values(b)
    n, size = max(1, len(q)), 2 * MAX_TERMS
    base = float(np.clip(q.mean() if len(q) else 0.05, 1e-3, 0.5))
    model = Linear(np.zeros(size), np.zeros(m.shape[1]), float(np.log(base / (1 - base))))
    seen = [np.full(size, 1e-6), np.full(m.shape[1], 1e-6), 1e-6]
    for _ in range(rounds if len(q) else 0):
        margin = model.bias + m @ model.marks + np.bincount(row, model.terms[at] * x, minlength=len(q))
        miss = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - q
        grads = [np.bincount(at, miss[row] * x, minlength=size) + ridge * model.terms, m.T @ miss + ridge * model.marks, float(miss.sum())]
        for k, g in enumerate(grads):
            seen[k] = seen[k] + (g / n) ** 2
        model.terms -= 0.3 * grads[0] / n / np.sqrt(seen[0])
        model.marks -= 0.3 * grads[1] / n / np.sqrt(seen[1])
        model.bias -= 0.3 * grads[2] / n / np.sqrt(seen[2])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", threshold: float = 0.3, max_train_rows: int = 40_000) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``.

    ``train`` says of a row of ``labels`` whether it may be learned from.  Of more than ``max_train_rows`` such
    rows, those with the smallest hash of doc_id are the sample that terms are mined from and the classifier is
    trained on; the label model is fitted over the votes of all documents.  Null and empty texts score like
    any text without words.  Rows that repeat a doc_id are scored one by one; one of its labels counts (the
    largest); null labels and null doc_ids give none.  Without any label, ``INSULTS`` and patterns vote alone, and
    all scores are the label model's prior.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(train)
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id", F.lit(12)), "doc_id").limit(max_train_rows)
    sample = common.stored(sample, "toxicity-sample")
    common.bounded_batches(spark)
    plain = docs.select("doc_id", "text")
    # at most max_train_rows rows of two numbers: bounded, whatever the input's size
    rows = plain.join(F.broadcast(sample), "doc_id").select("text", "y")
    sizes = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    terms = choose_terms(rows, sizes.get(1, 0), sizes.get(0, 0))
    hits = common.stored(with_hits(plain, terms), "toxicity-hits")

    in_sample = F.broadcast(sample.select(F.col("doc_id").alias("_id"), "y"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = votes_of(b, terms, b.column("y").fill_null(-1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in v], pa.binary())], ["votes"])

    labelled = hits.join(in_sample, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    patterns = common.stored(labelled.mapInArrow(vote, "votes binary").groupBy("votes").agg(F.count("*").alias("n")), "toxicity-votes")
    prior = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 20)
    model = fit_label_model(patterns, float(np.clip(prior, 0.005, 0.5)), labelled=bool(sizes))

    taught = labelled.filter("y IS NOT NULL").toArrow().sort_by("doc_id").combine_chunks()
    batch = taught.to_batches()[0] if taught.num_rows else pa.RecordBatch.from_pylist([], taught.schema)
    q = model.posterior(votes_of(batch, terms, batch.column("y").to_numpy())) if len(batch) else np.zeros(0)
    linear = fit_linear(batch, q) if len(batch) else Linear(np.zeros(2 * MAX_TERMS), np.zeros(len(PATTERNS) - 1), float(np.log(model.prior / (1 - model.prior))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = linear.score(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return hits.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
