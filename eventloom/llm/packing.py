"""Best-fit packing planned on the length histogram.

1. Documents are tokenised in tasks; a document longer than a sequence is cut from
   its end into full pieces, so that only its first piece may be shorter.
2. Lengths are counted. The histogram has at most ``capacity`` rows whatever the
   corpus, and best-fit decreasing runs over those counts: it moves whole groups
   of equal sequences, never single documents.
3. The plan says which ranks of a length go to which run of sequences at which
   offset. Pieces are ranked within their length and join the plan on it.

The rank is a sum of block counts and a row number inside a block of a bounded
number of rows, so a length that a third of all pieces share is still spread over
many tasks. The plan's size depends on ``capacity`` alone.

Defined cases: null text is empty, and an empty document is its end token alone;
repeated rows are packed each; ties in rank are broken by id, piece and content,
and rows equal in all of them are interchangeable; an empty table gives no piece;
extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import arrow_rows, keep, text_of

CAPACITY = 2048
END = np.zeros(1, "<u4").tobytes()

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Punctuation that ends a word; the pre-tokeniser parts it from the letters before it.
WORD_ENDS = ".,;:!?"
#: A line break between two visible characters is a token run of its own. It stands first, so that the search goes from break to break.
LONE_BREAK = re.compile(r"\n(?<=\S\n)(?=\S)")


class Remembered(dict):
    """Results of a function: those of the last ``limit`` keys and those that were asked for again since the ``limit`` before."""

    def __init__(self, compute, limit: int = 200_000):
        super().__init__()
        self.compute, self.limit, self.before = compute, limit, {}

    def __missing__(self, key: str) -> bytes:
        found = self.before.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.before = dict(self)
                self.clear()
            self[key] = found
        return found


class TextIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level pre-tokeniser never joins what lies on both sides of a space that
    follows a visible character, of a lone line break, or of a word's end and the
    punctuation after it; so a text is encoded in such parts, and parts that occur
    again are not encoded again.
    """

    def __init__(self, encode, encode_word):
        self.encode = encode
        self.words = Remembered(encode_word)
        self.after_space = Remembered(lambda chunk: self._chunk(" ", chunk))
        self.after_break = Remembered(lambda chunk: self._chunk("", chunk))
        self.line_break = encode("\n")

    def _chunk(self, lead: str, chunk: str) -> bytes:
        word = chunk.rstrip(WORD_ENDS)
        if word.isalpha():
            return self.words[lead + word] + (self.words[chunk[len(word) :]] if len(word) < len(chunk) else b"")
        return self.encode(lead + chunk)

    def _line(self, line: str) -> bytes:
        first, *rest = chunks(line)
        return self.after_break[first] + b"".join(map(self.after_space.__getitem__, rest))

    def of(self, text: str) -> bytes:
        return self.line_break.join(map(self._line, LONE_BREAK.split(text)))


def chunks(text: str) -> list[str]:
    """Cut before every space that follows a visible character; the space itself goes."""
    parts = text.split(" ")
    # Single spaces between words, and no other white space: none of that can be printed.
    if len(parts) < 2 or (text.isprintable() and "  " not in text and parts[0] and parts[-1]) or parts == text.split():
        return parts
    joined = parts[:1]
    for part in parts[1:]:
        if joined[-1] and not joined[-1][-1].isspace():
            joined.append(part)
        else:
            joined[-1] += " " + part
    return joined


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if visible, else one from 256 on."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_loaded: dict[str, TextIds] = {}


def tokenizer(path: str) -> TextIds:
    """The tokeniser of a task, loaded once per Python worker."""
    if path not in _loaded:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        letters, pack_ids = byte_letters(), lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        space = letters[ord(" ")]
        # Of a word's ASCII bytes, only the space before it is hidden.
        spelt = lambda word: word.replace(" ", space) if word.isascii() else word.encode().decode("latin-1").translate(letters)
        _loaded[path] = TextIds(
            lambda text: pack_ids(own.encode(text, add_special_tokens=False).ids),
            # What is one run for the pre-tokeniser goes to its model at once.
            lambda word: pack_ids([t.id for t in own.model.tokenize(spelt(word))]),
        )
    return _loaded[path]


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, the first possibly shorter."""
    first = n_ids % capacity or capacity
    bounds = [0, *range(first, n_ids + 1, capacity)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(tokenizer_path).of
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = of(text.as_py()) + END
                out += [(doc_id, i, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(rows, PIECES)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram.

    Returns rows (length, first rank, last rank, first sequence, offset): the
    pieces of these ranks go to consecutive sequences, one each, at the offset.
    """
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences
    rooms: list[int] = []  # rooms with a run, ascending
    plan, opened = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not runs[room]:
                insort(rooms, room)
            runs[room].append((first, n))

    def take(room: int) -> tuple[int, int]:
        run = runs[room].pop()
        if not runs[room]:
            rooms.pop(bisect_left(rooms, room))
        return run

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # as many new sequences as these pieces fill
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                continue
            room = rooms[at]
            first, n = take(room)
            used = min(n, left)
            plan.append((length, rank, rank + used - 1, first, capacity - room))
            put(room - length, first, used)
            put(room, first + used, n - used)
            rank, left = rank + used, left - used
    return plan


def ranked(cut_pieces: DataFrame, lengths: DataFrame, block_rows: int) -> DataFrame:
    """Add ``rank`` (from 0) within length, with no task holding more than a few blocks.

    ``cut_pieces`` is a written table: rows are dealt by their place in it, so that equal ones are dealt too.
    """
    blocks = lengths.select(F.col("length").alias("__length"), F.ceil(F.col("n") / block_rows).alias("__blocks"))
    key = F.xxhash64("__file", "__at")
    placed = cut_pieces.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    dealt = placed.join(F.broadcast(blocks), F.col("length") == F.col("__length")).withColumn("__block", F.pmod(key, F.col("__blocks"))).drop("__length", "__blocks")
    sizes = dealt.groupBy("length", "__block").count()
    before = Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "__block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__block").orderBy("__file", "__at")
    numbered = dealt.withColumn("__row", F.row_number().over(within) - 1)
    return numbered.join(starts, ["length", "__block"]).withColumn("rank", F.col("__before") + F.col("__row")).drop("__block", "__before", "__row", "__file", "__at")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_rows: int = 20_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    with arrow_rows(spark, 1000):
        cut_pieces = keep(pieces(docs, tokenizer_path, capacity), "pieces")
    lengths = cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in lengths.collect()}  # at most `capacity` rows
    histogram = spark.createDataFrame(list(counts.items()), "length long, n long")
    slots = spark.createDataFrame(best_fit(counts, capacity), "slot_length long, first_rank long, last_rank long, first_sequence long, offset long")
    placed = ranked(cut_pieces, histogram, block_rows).join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank"))
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )
