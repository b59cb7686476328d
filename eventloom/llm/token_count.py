"""Token counts of a unigram vocabulary without building the tokens.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each
character; dynamic programming keeps, per character, the best score of a
segmentation so far and its number of pieces. Ties follow the tokeniser: of equal
scores the one whose last piece is longest stays, since starts are tried from left
to right and only a strictly better score replaces another. A character that is
no piece scores the smallest score less 10 and counts as its UTF-8 bytes (byte
fallback). Scores are doubles.

The counts are a tokenizer's own only where the file is a unigram vocabulary. No
public file is; for a BPE file, whose scores are merge ranks, ``n_tokens`` is the
length of the best-score segmentation under those ranks and not what BPE encodes to.

White space is written as U+2581 before the pieces are looked up. Where no piece
has that mark after another character, the best segmentation falls apart at every
mark that follows another character; so it does between any two characters that
no piece has side by side. Words, and the parts between such places at marks of
punctuation, are therefore counted one by one, and those seen lately are
remembered, up to a bound.

Defined cases: null and empty text have no token; repeated rows repeat; an empty
table gives an empty result; extra columns are ignored; memory per word grows with
the longest piece, not with the word.
"""

from __future__ import annotations

import re
import string
from collections import deque
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: A word is its marks and the characters up to the next mark.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
UNKNOWN_PENALTY = 10.0


#: Characters beside which a word is tried for falling apart.
BREAKS = re.compile(f"[{re.escape(string.punctuation)}\n\r\t]")


def side_by_side(pieces) -> set[str]:
    """All pairs of neighbouring characters within a piece."""
    return {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1)}


class UnigramCounter:
    """Counts pieces of texts under a table piece -> score."""

    def __init__(self, scores: dict[str, float], remembered: int = 300_000):
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        if scores:
            self.automaton.make_automaton()
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.singles = {p for p in scores if len(p) == 1}
        self.longest = max(map(len, scores), default=1)
        self.by_word = not any(MARK in p.lstrip(MARK) for p in scores)
        self.pairs = side_by_side(scores)
        self.known: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.remembered = remembered

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation."""
        # states[-k]: the segmentation that ends k - 1 characters before the current end.
        states: deque[tuple[float, int]] = deque([(0.0, 0)], maxlen=self.longest + 1)
        singles, unknown = self.singles, self.unknown
        at = 0

        def ended(matches: list[tuple[int, float]], char: str) -> None:
            top, n = None, 0
            for length, score in matches:  # longest first
                before = states[-length]
                if top is None or before[0] + score > top:
                    top, n = before[0] + score, before[1] + 1
            if char not in singles:
                before = states[-1]
                if top is None or before[0] + unknown > top:
                    top, n = before[0] + unknown, before[1] + len(char.encode("utf-8", "surrogatepass"))
            states.append((top, n))

        matches: list[tuple[int, float]] = []
        for end, match in self.automaton.iter(word) if len(self.automaton) else ():
            while at < end:
                ended(matches, word[at])
                matches, at = [], at + 1
            matches.append(match)
        while at < len(word):
            ended(matches, word[at])
            matches, at = [], at + 1
        return states[-1]

    def _remember(self, known: dict[str, int], key: str, n: int) -> int:
        if len(known) >= self.remembered:
            known.clear()
        if len(key) <= 64:
            known[key] = n
        return n

    def _parts(self, word: str) -> Iterator[str]:
        """The word, cut beside its punctuation where no piece has both characters."""
        start = 0
        for found in BREAKS.finditer(word):
            for at in (found.start(), found.end()):
                if start < at < len(word) and word[at - 1 : at + 1] not in self.pairs:
                    yield word[start:at]
                    start = at
        yield word[start:]

    def _count_word(self, word: str) -> int:
        total = 0
        for part in self._parts(word):
            n = self.parts.get(part)
            total += self._remember(self.parts, part, self.best(part)[1]) if n is None else n
        return self._remember(self.known, word, total)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return self.best(marked)[1]
        known, total = self.known, 0
        for word in WORD.findall(marked):
            n = known.get(word)
            total += self._count_word(word) if n is None else n
        return total


def piece_scores(model_path: str) -> dict[str, float]:
    """Pieces and scores of a public vocabulary file, without control and byte pieces."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = range(own.get_piece_size())
    return {own.id_to_piece(i): own.get_score(i) for i in pieces if not (own.is_control(i) or own.is_byte(i) or own.is_unknown(i) or own.is_unused(i))}


_loaded: dict[str, UnigramCounter] = {}


def counter(model_path: str) -> UnigramCounter:
    """The counter of a task, built once per Python worker."""
    if model_path not in _loaded:
        _loaded[model_path] = UnigramCounter(piece_scores(model_path))
    return _loaded[model_path]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_chars, n_tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            chars, tokens = [], []
            for text in batch.column(1):
                own = text.as_py() or ""
                chars.append(len(own))
                tokens.append(count(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_chars", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, n_chars long, n_tokens long")
