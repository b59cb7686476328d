"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from eventloom.sources.tables import delete, discard, exists, keep, passing, shared_dir

__all__ = ["BLANKS", "WORDS", "arrow_rows", "light_driver", "delete", "discard", "exists", "is_held_out", "keep", "lower_ascii", "passing", "shared_dir", "text_of", "word_count"]

#: White space and words of the digest contracts: ASCII blanks only.
BLANKS = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What runs within this block gives Python at most so many rows at a time: rows of long texts or sets need memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Tables of more bytes are not sent through the driver; in its memory they take about ten times as much as written.
MOST_SENT = 256 * 1024
#: Keys by which the driver finds each range of a sorted table.
SAMPLED = 10


@contextmanager
def light_driver(spark: SparkSession) -> Iterator[None]:
    """What runs within this block sends only small tables through the driver, and sorts by few sampled keys a partition."""
    sent, sampled, later = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.rangeExchange.sampleSizePerPartition", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    before = {name: spark.conf.get(name) for name in (sent, sampled)}
    if (own := spark.conf.get(later, None)) is not None:
        before[later] = own
    try:
        for name, value in before.items():
            spark.conf.set(name, str(min(SAMPLED, int(value)) if name == sampled else min(MOST_SENT, as_bytes(value))))
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def word_count(text: Column) -> Column:
    """Number of blank-separated words of a text, as long."""
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def is_held_out(doc_id: Column) -> Column:
    """Whether a document's labels must not be learned from: crc32 of its id mod 3 is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
