"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index lies under a path of its own, in files bucketed and sorted by digest, with a
manifest of the batches that it holds. A batch of documents is reduced to one row per
digest before anything is shuffled by digest, the known digests are removed with a
sort-merge anti-join that reads the index without shuffling it, what is left is
appended, and every row's answer is read from the index. Any session that opens the
path goes on from there.

A batch has a name, by default a fingerprint of its rows, and the index notes with each
digest the batch that brought it. So a batch that is fed again, as after a failure,
gets its first answers again. The manifest's row is written last; rows of an append
that did not get so far are never read.

Texts are equal when identical after each run of ASCII blanks is replaced by one
space. Defined cases:

* null text counts as the empty text; all such documents form one group;
* of equal texts the smallest non-null ``doc_id`` stays; if all ids are null, the
  null row stays;
* rows repeating both id and text are one document: all carry the same answer in
  :func:`resolve`, and :func:`deduplicate` returns one of them;
* an empty table gives an empty result; other columns are never looked at;
* one writer at a time; a name given to two different batches is the caller's mistake.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import BLANKS, delete, exists, keep, shared_dir, text_of


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " "), 256))


@dataclass(frozen=True)
class DigestIndex:
    """One row per known digest: ``digest``, ``keep_id`` and the ``batch`` that brought it, in files under ``path``."""

    spark: SparkSession
    path: str
    buckets: int = 32

    def _manifest(self) -> list:
        """Batches that are in, with the name of their append and the number of buckets."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return []
        return self.spark.read.schema("batch string, append string, buckets int").parquet(f"{self.path}/manifest").collect()

    def batches(self) -> set[str]:
        return {r["batch"] for r in self._manifest()}

    def _table(self, buckets: int) -> str:
        """The name by which this session reads the bucketed files; they and the manifest are all that lasts."""
        name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, batch STRING, append STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}/digests'"
        )
        return name

    def rows(self) -> DataFrame:
        known = self._manifest()
        if not known:
            return self.spark.createDataFrame([], "digest binary, keep_id long, batch string")
        name = self._table(known[0]["buckets"])
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).filter(F.col("append").isin([r["append"] for r in known])).select("digest", "keep_id", "batch")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Add a batch's (digest, keep_id): one sorted file per bucket, then the manifest's row."""
        known = self._manifest()
        buckets = known[0]["buckets"] if known else self.buckets
        own = uuid.uuid4().hex
        named = rows.select("digest", "keep_id", F.lit(batch).alias("batch"), F.lit(own).alias("append"))
        (
            named.repartition(buckets, "digest")
            .write.mode("append")
            .format("parquet")
            .bucketBy(buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self._table(buckets))
        )
        entry = self.spark.range(1).select(F.lit(batch).alias("batch"), F.lit(own).alias("append"), F.lit(buckets).alias("buckets"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def drop(self) -> None:
        """Delete the index."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(self.buckets)}")
        delete(self.spark, self.path)


def _digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(text_of()).alias("digest"))


def _learn(groups: DataFrame, index: DigestIndex, batch: str) -> None:
    """Append to the index the digests of (digest, first_id) that it lacks; nothing where it has the batch already."""
    if batch in index.batches():
        return
    fresh = groups.select("digest", F.col("first_id").alias("keep_id")).join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    # Written before the append, which changes what the index holds.
    index.append(keep(fresh, "fresh"), batch)


def _fingerprint(groups: DataFrame) -> str:
    """A name for a batch that follows from its rows, in whatever order they come."""
    row = F.xxhash64("digest", "first_id", "group_size")
    found = groups.agg(F.count(F.lit(1)), F.bit_xor(row), F.sum(row.cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.reverse(F.hex("digest"))))).first()
    return hashlib.sha256(repr(tuple(found)).encode()).hexdigest()


def resolve(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """Add the batch's unseen digests to the index; one row per document of the batch.

    Returns doc_id, keep_id (of the row that stays, which may be from an earlier
    batch), group_size (equal rows in this batch), kept, digest.
    """
    digests = keep(_digests(docs), "digests")
    groups = keep(digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
    batch = batch or _fingerprint(groups)
    _learn(groups, index, batch)
    known = groups.join(index.rows().hint("merge"), "digest")
    return _answers(digests, known.select("digest", "keep_id", "group_size", (F.col("batch") == batch).alias("own")))


def _answers(digests: DataFrame, verdicts: DataFrame) -> DataFrame:
    # A plain join of two tables: a digest with very many copies is split at run time.
    return digests.join(keep(verdicts, "verdicts"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("own") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "digest",
    )


def resolve_table(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """The rows of a whole table as :func:`resolve` gives them, fed to a new index in batches of ascending doc_id.

    Every batch is anti-joined with what the earlier ones left in the index, so the
    smallest id of each digest is the one that it keeps; null ids come last. The
    answers are read from the filled index.
    """
    digests = keep(_digests(docs), "digests")
    low, high = digests.agg(F.min("doc_id"), F.max("doc_id")).first()
    bounds = [] if low is None else [low + (high - low + 1) * k // batches for k in range(1, batches)]
    batch = F.when(F.col("doc_id").isNull(), F.lit(batches - 1))
    for k, bound in enumerate(bounds):
        batch = batch.when(F.col("doc_id") < bound, F.lit(k))
    grouped = digests.groupBy("digest", batch.otherwise(F.lit(batches - 1)).alias("batch"))
    groups = keep(grouped.agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "digest-groups")
    for k in range(batches):
        _learn(groups.filter(F.col("batch") == k), index, str(k))
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    known = sizes.join(index.rows().hint("merge"), "digest")
    return _answers(digests, known.select("digest", "keep_id", "group_size", F.lit(True).alias("own")))


def _row_key(doc_id: Column, digest: Column) -> Column:
    """Names a row by its id and text: one column, so that what is joined by it is also grouped by it."""
    return F.unhex(F.md5(F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents, all their columns, that no earlier or equal document replaces."""
    kept = resolve(docs, index).filter("kept").select(_row_key(F.col("doc_id"), F.col("digest")).alias("__row"))
    tagged = docs.withColumn("__row", _row_key(F.col("doc_id").cast("long"), digest_of(text_of())))
    return tagged.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")


def new_index(spark: SparkSession) -> DigestIndex:
    """An index in a folder of its own within the shared one."""
    return DigestIndex(spark, f"{shared_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}")
