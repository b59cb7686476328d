"""Language identification by prediction by partial matching over bytes.

Training counts, per language, every byte in its context of ``order`` bytes. The
shorter contexts are suffixes of the longest one, so their counts are sums of its
counts. Scoring is PPM with escape method C and exclusions under these frozen
counts: at a context with T occurrences of q different bytes (without the bytes
already ruled out by the longer context) a byte seen n times costs
-log2(n / (T + q)), an escape -log2(q / (T + q)); below order 0 all bytes not yet
ruled out are equally likely. The language with the shortest code wins.

A byte's cost depends on it and the ``order`` bytes before it alone. So costs of
all (order + 1)-grams known from training are tabulated once, and a text's code
length is a sum of table entries; other grams are scored as they come. Texts are
read in slices of bounded size, whole.

The counts come from at most about ``sample_docs`` documents per language, chosen
by a hash of their id and text; this bounds the model that is sent to the tasks.

Defined cases: null text, or one without a letter, gives ``und`` and score 0; ties
go to the smallest language; without any training row everything is ``und``;
repeated rows repeat; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import is_held_out

UNKNOWN = "und"
#: Stands for the bytes before a text.
PAD = b"\n"
SLICE_BYTES = 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter by its Unicode category; number characters such as a half are none."""
    return bool(text) and any(map(str.isalpha, text))


def grams(data: bytes, order: int) -> np.ndarray:
    """The (order + 1)-gram that ends at each byte from ``order`` on, as integers."""
    own = np.frombuffer(data, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(own) - order), np.uint64)
    for i in range(order + 1):
        out = (out << np.uint64(8)) | own[i : i + len(out)]
    return out


@dataclass
class Level:
    """Counts of one order: sorted contexts and sorted context-byte pairs."""

    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray
    #: Per context: occurrences, in the context one byte shorter, of the bytes seen here.
    ruled_out: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Ppm:
    """Frozen statistics of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        for o in range(order + 1):
            low = keys & np.uint64((1 << (8 * (o + 1))) - 1)
            pairs, at = np.unique(low, return_inverse=True)
            n = np.bincount(at, weights=counts)
            contexts, of = np.unique(pairs >> np.uint64(8), return_inverse=True)
            ruled_out = np.zeros(len(contexts))
            if o:
                shorter = self.levels[-1]
                i, _ = _find(shorter.pairs, pairs & np.uint64((1 << (8 * o)) - 1))
                ruled_out = np.bincount(of, weights=shorter.counts[i])
            self.levels.append(Level(contexts, np.bincount(of, weights=n), np.bincount(of).astype(float), pairs, n, ruled_out))

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after its other bytes."""
        out = np.zeros(len(wanted))
        open_, gone_n, gone_kinds = np.arange(len(wanted)), np.zeros(len(wanted)), np.zeros(len(wanted))
        for o in range(self.order, -1, -1):
            level = self.levels[o]
            pair = wanted[open_] & np.uint64((1 << (8 * (o + 1))) - 1)
            c, known = _find(level.contexts, pair >> np.uint64(8))
            p, seen = _find(level.pairs, pair)
            total, kinds = level.total[c] - gone_n, level.kinds[c] - gone_kinds
            coded = known & (kinds > 0)
            whole = np.where(coded, total + kinds, 1.0)
            out[open_] -= np.where(coded, np.log2(np.where(seen, level.counts[p], kinds) / whole, where=coded, out=np.zeros(len(open_))), 0.0)
            left = ~seen
            gone_n = np.where(known, level.ruled_out[c], 0.0)[left]
            gone_kinds = np.where(known, level.kinds[c], 0.0)[left]
            open_ = open_[left]
        out[open_] += np.log2(256.0 - self.levels[0].kinds[0])
        return out


class Scorer:
    """Code lengths of texts in all languages."""

    def __init__(self, languages: list[str], models: list[Ppm], order: int):
        self.languages, self.models, self.order = languages, models, order
        known = np.unique(np.concatenate([m.levels[-1].pairs for m in models])) if models else np.zeros(0, np.uint64)
        self.log_slots = max(10, int(len(known)).bit_length() + 3)
        # Gram -> row of costs; a gram that finds both its slots taken is scored as it comes.
        self.slots = np.zeros(1 << self.log_slots, np.uint32)
        self.known = np.concatenate([np.zeros(1, np.uint64), known])
        rest = np.arange(1, len(self.known), dtype=np.uint32)
        for mix in _MIX:
            at = self._slot(self.known[rest], mix)
            free = self.slots[at] == 0
            self.slots[at[free][::-1]] = rest[free][::-1]
            rest = rest[self.slots[at] != rest]
        self.costs = np.column_stack([m.bits(self.known) for m in models]).astype(np.float32) if models else np.zeros((1, 0), np.float32)

    def _slot(self, wanted: np.ndarray, mix: np.uint64) -> np.ndarray:
        return ((wanted * mix) >> np.uint64(64 - self.log_slots)).astype(np.int64)

    def bits(self, wanted: np.ndarray) -> np.ndarray:
        """Cost of each gram in each language."""
        row = self.slots[self._slot(wanted, _MIX[0])]
        for mix in _MIX[1:]:
            miss = np.flatnonzero((self.known[row] != wanted) | (row == 0))
            row[miss] = self.slots[self._slot(wanted[miss], mix)]
        out = self.costs[row].astype(np.float64)
        miss = np.flatnonzero((self.known[row] != wanted) | (row == 0))
        if len(miss):
            new, at = np.unique(wanted[miss], return_inverse=True)
            out[miss] = np.column_stack([m.bits(new) for m in self.models])[at]
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Matrix text x language of code lengths in bits."""
        sums, pad = np.zeros((len(texts), len(self.languages))), PAD * self.order
        parts, owners, size = [], [], 0

        def flush() -> None:
            starts = np.cumsum([0, *map(len, parts)])
            costs = self.bits(grams(b"".join(parts), self.order))
            # A part's first `order` bytes are context; its own costs follow.
            ends = np.stack([starts[:-1], starts[1:] - self.order], axis=1).ravel()
            costs = np.vstack([costs, np.zeros((1, costs.shape[1]))])
            np.add.at(sums, owners, np.add.reduceat(costs, ends, axis=0)[::2])

        for i, text in enumerate(texts):
            whole = pad + text
            for a in range(0, len(text), SLICE_BYTES):
                parts.append(whole[a : a + SLICE_BYTES + self.order])
                owners.append(i)
                size += len(parts[-1])
                if size >= SLICE_BYTES:
                    flush()
                    parts, owners, size = [], [], 0
        if parts:
            flush()
        return sums


def training_counts(labelled: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n) over the given rows (text, lang)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(PAD * order + text.encode())
            for lang, texts in by_lang.items():
                found, n = np.unique(np.concatenate([grams(t, order) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = labelled.select("text", "lang").mapInArrow(rows, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, order: int = 4, sample_docs: int = 400) -> Scorer:
    """Fit on a hash sample of about ``sample_docs`` learnable documents per language."""
    learnable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id")))
    there = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().collect()}
    if not there:
        return Scorer([], [], order)
    chance = F.create_map(*[F.lit(x) for lang, n in there.items() for x in (lang, float(sample_docs) / n)])[F.col("lang")]
    # By id and text, and each pair once: rows with a null id or repeated rows neither crowd the sample nor pass its bound.
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    found = training_counts(learnable.filter(drawn < chance).distinct(), order).toPandas()
    languages = sorted(found["lang"].unique())
    models = []
    for lang in languages:
        own = found[found["lang"] == lang]
        models.append(Ppm(own["gram"].to_numpy().astype(np.uint64), own["n"].to_numpy().astype(float), order))
    return Scorer(languages, models, order)


def choose(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of code lengths: the shortest, and its share of the likelihoods."""
    best = lengths.argmin(axis=1)
    more = lengths - lengths.min(axis=1, keepdims=True)
    return best, 1.0 / np.exp2(-np.minimum(more, 1000.0)).sum(axis=1)


def identify(docs: DataFrame, scorer: Scorer, rows_at_once: int = 256) -> DataFrame:
    """Per document: doc_id, lang_pred, score, bits_per_byte."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for batch in (whole.slice(i, rows_at_once) for i in range(0, len(whole), rows_at_once)):
                texts = [t if has_letter(t) else "" for t in batch.column(1).to_pylist()]
                data = [t.encode() for t in texts]
                if own.languages:
                    lengths = own.code_lengths(data)
                    best, score = choose(lengths)
                    lang = [own.languages[k] if d else UNKNOWN for k, d in zip(best, data, strict=True)]
                    rate = lengths.min(axis=1) / np.maximum(1, [len(d) for d in data])
                    score = np.where([bool(d) for d in data], score, 0.0)
                else:
                    lang, score, rate = [UNKNOWN] * len(data), np.zeros(len(data)), np.zeros(len(data))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, lang_pred string, score double, bits_per_byte double")


def keep_languages(docs: DataFrame, scorer: Scorer, least_score: float = 0.4) -> DataFrame:
    """The documents, with their own columns, whose language is known and clear enough."""
    accepted = accept_column(docs.sparkSession, scorer, least_score)
    return docs.filter(accepted(F.col("text").cast("string")))


def accept_column(spark: SparkSession, scorer: Scorer, least_score: float):
    """A vectorised predicate over a text column, so that no row has to be joined back."""
    shared = spark.sparkContext.broadcast(scorer)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        own = shared.value
        data = [t.encode() if has_letter(t) else b"" for t in texts]
        if not own.languages:
            return pd.Series([False] * len(data))
        score = np.concatenate([choose(own.code_lengths(data[i : i + 256]))[1] for i in range(0, len(data), 256)]) if data else np.zeros(0)
        return pd.Series((score >= least_score) & np.array([bool(d) for d in data], bool))

    return accepted

