"""Benchmark decontamination: documents are streamed through a suffix automaton of the test items.

Items and documents are normalised to words (A-Z lower-cased, ASCII letters, digits and
all characters beyond ASCII). The items' words form one generalised suffix automaton,
which knows every run of words of every item. A document's words move through it one
by one; the state names the longest run of item words that ends at the present word,
so overlaps of any length are seen in one pass. A run of ``window`` words, or a whole
shorter item, is a hit: its words form the document's spans.

Items are cut into blocks of about ``block_words`` words, whose size is checked before
anything is sent; one automaton per block is what a task holds. Each block is one pass
over the documents, so a benchmark of any size is matched whole.

Defined cases:

* null and empty texts have no words, no hit and stay as they are;
* items without a word match nothing; a null ``item_id`` is reported as the empty string;
* items with one id are one item, whatever texts they have; equal texts are matched once and
  reported under all their ids;
* an item longer than a block is cut into overlapping parts: no window is lost, but
  ``longest`` counts runs within a part;
* every row of ``docs`` has its own result, repeated rows too; an empty table of either
  kind gives an empty result or no hit;
* other columns of the documents are kept by :func:`clean` and not looked at.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import arrow_rows, keep, lower_ascii, text_of

#: Words of a text whose A-Z are lower-cased; the second form is for UTF-8 bytes.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_word = re.compile(rb"[0-9a-z\x80-\xff]+")

_FOUND = "n_words long, spans array<struct<start:long,stop:long>>, items array<string>, longest long"


class Automaton:
    """Generalised suffix automaton of word lists, each known under several item ids."""

    def __init__(self, texts: list[tuple[list[bytes], list[str]]], window: int) -> None:
        self.window = window
        self.number: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        for words, _ in texts:
            last = 0
            for w in words:
                last = self._extended(last, self.number.setdefault(w, len(self.number)))
        #: Items by the state of a window of theirs, or of their whole text where that is shorter.
        self.windows: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        for words, ids in texts:
            state = 0
            for n, w in enumerate(words, 1):
                state = self.go[state][self.number[w]]
                if n >= window:
                    self.windows.setdefault(self._window_state(state), set()).update(ids)
            if 0 < len(words) < window:
                self.whole.setdefault(state, set()).update(ids)
        #: Per state the longest whole short item that ends there: the state itself or one that it links to.
        self.near = [-1] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.near[state] = state if state in self.whole else self.near[self.link[state]]

    def _state(self, size: int, link: int, go: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.go.append(go)
        return len(self.size) - 1

    def _split(self, state: int, after: int, word: int) -> int:
        """The state of the run ``state`` + ``word``, taken out of ``after``, which also holds longer ones."""
        own = self._state(self.size[state] + 1, self.link[after], dict(self.go[after]))
        self.link[after] = own
        while state >= 0 and self.go[state].get(word) == after:
            self.go[state][word] = own
            state = self.link[state]
        return own

    def _extended(self, last: int, word: int) -> int:
        """The state after one more word of the present text."""
        after = self.go[last].get(word)
        if after is not None:
            return after if self.size[after] == self.size[last] + 1 else self._split(last, after, word)
        own = self._state(self.size[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.go[state]:
            self.go[state][word] = own
            state = self.link[state]
        if state >= 0:
            after = self.go[state][word]
            self.link[own] = after if self.size[after] == self.size[state] + 1 else self._split(state, after, word)
        return own

    def _window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a run at least that long."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Spans of hit words (start, stop), ids of the items with occurring windows, longest matching run."""
        go, link, size, near, window = self.go, self.link, self.size, self.near, self.window
        spans: list[tuple[int, int]] = []
        windows, whole = set(), set()
        state = length = longest = 0
        for i, word in enumerate(map(self.number.get, words), 1):
            if word is None:
                state = length = 0
                continue
            after = go[state].get(word)
            while after is None:  # the root knows every numbered word
                state = link[state]
                length = size[state]
                after = go[state].get(word)
            state = after
            length += 1
            if length > longest:
                longest = length
            if length >= window:
                windows.add(self._window_state(state))
                _add_span(spans, i - window, i)
            short = near[state]
            if short == state and length < size[state]:
                short = near[link[state]]
            while short > 0:
                whole.add(short)
                _add_span(spans, i - size[short], i)
                short = near[link[short]]
        items: set[str] = set()
        for found, ids in ((windows, self.windows), (whole, self.whole)):
            for s in found:
                items |= ids[s]
        return spans, items, longest


def _add_span(spans: list[tuple[int, int]], start: int, stop: int) -> None:
    """Add a span that ends last, joined with those that it touches."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, stop))


def _joined(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((x for spans in lists for x in spans), key=lambda x: (x[1], x[0])):
        _add_span(out, start, stop)
    return out


def _words_of(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0))


def _blocks(items: DataFrame, window: int, block_words: int) -> Iterator[tuple[list[tuple[list[bytes], list[str]]], bool]]:
    """The items' distinct texts with their ids, in blocks of at most 2 * ``block_words`` words; whether it is the last block."""
    listed = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), _words_of(text_of()).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(block_words))
    parts = F.transform(starts, lambda i: F.slice("words", i + 1, block_words + window - 1))
    cut = keep(listed.distinct().select("item", F.explode(parts).alias("words")), "benchmark-items")
    total = cut.agg(F.sum(F.size("words"))).first()[0] or 0
    n = -(-total // block_words)
    while n:
        placed = cut.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n)))
        if n == 1 or placed.groupBy("block").agg(F.sum(F.size("words")).alias("held")).filter(F.col("held") > 2 * block_words).isEmpty():
            break
        n *= 2
    for k in range(n):
        texts = placed.filter(F.col("block") == k).groupBy("words").agg(F.collect_set("item").alias("items")).collect()
        yield [([w.encode() for w in r["words"]], r["items"]) for r in texts], k == n - 1


def _matched(docs: DataFrame, items: DataFrame, window: int, block_words: int, text_rows: int, with_text: bool) -> DataFrame:
    """The documents with ``__found``: words, spans, items and longest run over all blocks; the last pass writes the text only if asked."""
    spark = docs.sparkSession
    found_type = T.StructType.fromDDL(_FOUND)
    schema = T.StructType([*docs.schema.fields, T.StructField("__found", found_type)])
    at = docs.columns.index("text")
    blocks = 0
    for texts, last in _blocks(items, window, block_words):
        sent = spark.sparkContext.broadcast(texts)
        matched = docs.mapInArrow(_pass(sent, window, at, blocks > 0), schema)
        with arrow_rows(spark, text_rows):
            docs = keep(matched if with_text or not last else matched.drop("text"), "matched")
        blocks += 1
    if blocks:
        return docs
    empty = F.array().cast("array<struct<start:long,stop:long>>")
    n_words = F.regexp_count(lower_ascii(text_of()), F.lit(WORD)).cast("long")
    return docs.withColumn("__found", F.struct(n_words.alias("n_words"), empty.alias("spans"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("longest")))


#: The automaton that this Python worker built last, by the name of its pass.
_built: dict[str, Automaton] = {}


def _automaton(name: str, sent, window: int) -> Automaton:
    if name not in _built:
        _built.clear()
        _built[name] = Automaton(sent.value, window)
    return _built[name]


def _pass(sent, window: int, at: int, again: bool):
    """One block against all documents; ``again``: the last column holds what earlier blocks found."""
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    name = uuid.uuid4().hex
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string())), ("longest", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, sent, window)
        for batch in batches:
            before = batch.column(batch.num_columns - 1).to_pylist() if again else [None] * batch.num_rows
            rows = []
            for text, old in zip(batch.column(at).cast(pa.binary()), before, strict=True):
                words = _word.findall((text.as_py() or b"").lower())
                spans, items, longest = automaton.scan(words)
                if old:
                    spans = _joined(spans, [(s["start"], s["stop"]) for s in old["spans"]])
                    items, longest = items.union(old["items"]), max(longest, old["longest"])
                rows.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": sorted(items), "longest": longest})
            columns = batch.columns[:-1] if again else batch.columns
            names = batch.schema.names[:-1] if again else batch.schema.names
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, kind)], [*names, "__found"])

    return run


def _n_hit() -> Column:
    return F.aggregate("__found.spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def audit(docs: DataFrame, items: DataFrame, window: int = 10, block_words: int = 200_000, text_rows: int = 1_000) -> DataFrame:
    """What of the items each document holds.

    Returns doc_id, n_words, n_hit (words within an occurring window), n_items and
    items (ids of items with occurring windows), contaminated, longest (matching run of
    any length), spans (of hit words, counted from 0).
    """
    found = _matched(docs.select("doc_id", "text"), items, window, block_words, text_rows, with_text=False)
    return found.select(
        "doc_id",
        "__found.n_words",
        _n_hit().alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        F.array_sort("__found.items").alias("items"),
        (F.size("__found.spans") > 0).alias("contaminated"),
        "__found.longest",
        "__found.spans",
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 10, least_span: int = 10, most_coverage: float = 0.5, block_words: int = 200_000, text_rows: int = 1_000) -> DataFrame:
    """The documents, all their columns, without the spans that they share with items.

    Spans of at least ``least_span`` words, and whole items shorter than the window, are
    cut out of the text, what stands between their first and last word included;
    documents of which more than ``most_coverage`` of the words are hit are left out.
    """
    found = _matched(docs, items, window, block_words, text_rows, with_text=True)
    kept = found.filter(_n_hit() <= F.col("__found.n_words") * most_coverage)
    at = docs.columns.index("text")

    def goes(words: int) -> bool:
        return words >= least_span or words < window

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            texts = [
                _without(text, [(s["start"], s["stop"]) for s in own["spans"] if goes(s["stop"] - s["start"])])
                for text, own in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist(), strict=True)
            ]
            columns = batch.columns[:last]
            columns[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last])

    return kept.mapInArrow(cut, docs.schema)


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not text or not spans:
        return text
    raw = text.encode()
    places = [m.span() for m in _word.finditer(raw.lower())]
    out, past = [], 0
    for start, stop in spans:
        out.append(raw[past : places[start][0]])
        past = places[stop - 1][1]
    return b"".join([*out, raw[past:]]).decode()
