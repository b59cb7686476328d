"""Quality classifier: a linear-chain conditional random field over a text's lines.

Every line with a word is described by a few shares of its words and bytes, beside
those of the line before and after it. The field labels the lines good or bad; its
forward-backward marginals, weighted by the lines' words, are averaged to a
document's share of good text, and a logistic curve fitted on the training
documents turns that into the probability of label 1.

Training takes about ``sample_docs`` labelled documents at most, chosen by a hash of
their id; every line of one takes its document's label. Scoring uses texts alone,
whole, and goes through all chains of a slice of documents together.

Defined cases: a text without a line (null, empty, blank) is scored as one line of
no words; labels other than 0 and 1 are left out, and of several labels of one
document the smaller counts; without training rows every score is 0.5; repeated
rows repeat; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import is_held_out
from eventloom.llm.quality_rules import SENTENCE_ENDS, SEPARATORS, SYMBOL_ENDS, words_of

#: Features of a line by itself; a line also has its neighbours', and whether it has any.
OWN = 11
FEATURES = 3 * OWN + 2


def _byte_classes() -> np.ndarray:
    """Capital letters, digits, symbols and bytes beyond ASCII."""
    table = np.zeros((256, 4), np.float32)
    table[ord("A") : ord("Z") + 1, 0] = 1
    table[ord("0") : ord("9") + 1, 1] = 1
    table[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:!?'\"()-"], 2] = 1
    table[128:, 3] = 1
    return table


BYTE_CLASSES = _byte_classes()


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line with a word and of its neighbours, words of each line)."""
    text = text or ""
    separators = [x for x in SEPARATORS if x in text]
    ends = tuple(x for x in SYMBOL_ENDS if x in text)
    kept, own, seen = [], [], set()
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            continue
        n = len(words)
        own.append(
            (
                n,
                sum(w.endswith(ends) for w in words) / n if ends else 0.0,
                min(1.0, sum(map(line.count, separators)) / n) if separators else 0.0,
                len(set(words)) / n,
                line in seen,
                words[-1].endswith(SENTENCE_ENDS),
            )
        )
        seen.add(line)
        kept.append(line.encode("utf-8", "surrogatepass"))
    if not own:
        return np.zeros((1, FEATURES)), np.ones(1)
    found = np.array(own, float)
    sizes = np.array([len(x) for x in kept], float)
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    classes = np.add.reduceat(BYTE_CLASSES[np.frombuffer(b"".join(kept), np.uint8)], starts, axis=0) / sizes[:, None]
    n = found[:, 0]
    line = np.column_stack([np.log1p(n), np.log1p(sizes / n), found[:, 1:], classes])
    before, after = np.zeros_like(line), np.zeros_like(line)
    before[1:], after[:-1] = line[:-1], line[1:]
    edge = np.zeros((len(line), 2))
    edge[0, 0] = edge[-1, 1] = 1
    return np.hstack([line, before, after, edge]), n


def _log_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


class Chains:
    """Lines of several documents, laid out so that all chains advance together."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.starts = starts[self.order]
        self.active = [int((lengths > t).sum()) for t in range(int(lengths.max(initial=0)))]

    def marginals(self, good: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, expected transitions, log of the partition functions' product.

        ``good`` is each line's score of the label good (bad scores 0).
        """
        n = len(good)
        unary = np.stack([np.zeros(n), good], axis=1)
        forward, backward = unary.copy(), np.zeros((n, 2))
        for t in range(1, len(self.active)):
            at = self.starts[: self.active[t]] + t
            before = forward[at - 1]
            for y in (0, 1):
                forward[at, y] += _log_add(before[:, 0] + transition[0, y], before[:, 1] + transition[1, y])
        last = self.starts + self.lengths[self.order] - 1
        log_z = _log_add(forward[last, 0], forward[last, 1])
        of_line = np.empty(n)
        for t in range(len(self.active) - 1, -1, -1):
            k = self.active[t]
            at = self.starts[:k] + t
            of_line[at] = log_z[:k]
            if t:
                after = backward[at] + unary[at]
                for y in (0, 1):
                    backward[at - 1, y] = _log_add(after[:, 0] + transition[y, 0], after[:, 1] + transition[y, 1])
        p = np.exp(forward[:, 1] + backward[:, 1] - of_line)
        inner = np.ones(n, bool)
        inner[self.starts] = False
        at = np.flatnonzero(inner)
        pairs = np.zeros((2, 2))
        for x in (0, 1):
            for y in (0, 1):
                pairs[x, y] = np.exp(forward[at - 1, x] + transition[x, y] + unary[at, y] + backward[at, y] - of_line[at]).sum()
        return p, pairs, float(log_z.sum())


@dataclass
class LineField:
    """Weights of the field and of the curve over a document's share of good text."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transition: np.ndarray
    curve: tuple[float, float]

    def good_share(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Word-weighted mean of the lines' marginals."""
        lengths = np.array([len(n) for _, n in docs])
        x = (np.vstack([f for f, _ in docs]) - self.mean) / self.scale
        p, _, _ = Chains(lengths).marginals(x @ self.weights[1:] + self.weights[0], self.transition)
        words = np.concatenate([n for _, n in docs])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        return np.add.reduceat(p * words, starts) / np.add.reduceat(words, starts)

    def score(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        share = np.clip(self.good_share(docs), 1e-6, 1 - 1e-6)
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.log(share / (1 - share)) + b)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> LineField:
    """Maximise the conditional likelihood of the line labels (gradient steps with momentum)."""
    if not docs:
        return LineField(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), np.zeros((2, 2)), (1.0, 0.0))
    lengths = np.array([len(n) for _, n in docs])
    raw = np.vstack([f for f, _ in docs])
    mean, scale = raw.mean(axis=0), raw.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([np.ones(len(raw)), (raw - mean) / scale])
    y = np.repeat(labels, lengths)
    chains = Chains(lengths)
    inner = np.ones(len(y), bool)
    inner[chains.starts] = False
    at = np.flatnonzero(inner)
    seen_pairs = np.array([[((y[at - 1] == a) & (y[at] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    w, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = v = np.zeros(len(w) + 4)
    for step in range(1, steps + 1):
        p, pairs, _ = chains.marginals(x @ w, transition)
        gradient = np.concatenate([x.T @ (y - p), (seen_pairs - pairs).ravel()]) / len(y) - ridge * np.concatenate([w, transition.ravel()])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, transition = w + move[:-4], transition + move[-4:].reshape(2, 2)
    field = LineField(mean, scale, w, transition, (1.0, 0.0))
    share = np.clip(field.good_share(docs), 1e-6, 1 - 1e-6)
    z, a, b = np.log(share / (1 - share)), 0.5, 0.0
    for _ in range(500):
        error = labels - 1 / (1 + np.exp(-(a * z + b)))
        a, b = max(1e-3, a + 0.02 * ((error * z).mean() - 1e-3 * a)), b + 0.1 * error.mean()
    field.curve = (float(a), float(b))
    return field


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 2000) -> LineField:
    """Fit on a hash sample of about ``sample_docs`` labelled documents.

    Documents are drawn by id and text, and equal pairs are one document, so neither
    repeated rows nor an id with many texts pass the bound of the sample.
    """
    learnable = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    # Only id and text of the documents: a column of theirs may be called quality.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    by_text = F.xxhash64("doc_id", "text")
    there = texts.select("doc_id", by_text.alias("pair")).join(learnable, "doc_id").select("pair").distinct().count()
    drawn = F.pmod(by_text, F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = texts.filter(drawn < float(sample_docs) / max(1, there)).join(learnable, "doc_id").select("doc_id", "quality", "text").distinct()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f.ravel() for f, _ in found], pa.list_(pa.float64())), pa.array([n for _, n in found], pa.list_(pa.float64()))],
                names=["quality", "features", "words"],
            )

    found = sample.select("quality", "text").mapInArrow(rows, "quality int, features array<double>, words array<double>").toPandas()
    # In a fixed order, so that the same rows give the same sums.
    chains = sorted(((np.array(f).reshape(-1, FEATURES), np.array(n), q) for q, f, n in found.itertuples(index=False)), key=lambda d: (d[2], len(d[1]), d[0].tobytes()))
    return fit([(f, n) for f, n, _ in chains], np.array([q for _, _, q in chains], float))


def score(docs: DataFrame, field: LineField, rows_at_once: int = 256) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, rows_at_once) for i in range(0, len(whole), rows_at_once)):
                found = shared.value.score([line_features(t.as_py()) for t in batch.column(2)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
