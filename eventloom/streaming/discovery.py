"""The discovery stream: frames to three sinks that hold the same rows however often a batch is replayed.

Every micro-batch is judged by :func:`eventloom.operators.discovery.discover` and written to
folders named by its batch id, accepted, rejected and metrics, and its searches for later
batches. A replayed batch overwrites its own folders. A batch counts from the moment its
commit is written, after all of its folders; readers see no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from eventloom.operators import discovery
from eventloom.sources.tables import file_system

SINKS = ("accepted", "rejected", "metrics", "searches")
_SEARCHES = "run_id string, pos long, payload string"


def _committed(spark: SparkSession, path: str) -> dict[int, int]:
    """Batches that count, with the microsecond of their newest frame."""
    fs, log = file_system(spark, f"{path}/_batches")
    names = [s.getPath().getName() for s in fs.listStatus(log)] if fs.exists(log) else []
    return {int(batch): int(newest) for batch, newest in (n.split(".") for n in names)}


def _folder(path: str, sink: str, batch: int) -> str:
    return f"{path}/{sink}/batch-{batch}"


def read(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """The rows of one sink over all batches that count; metrics are added up per run."""
    rows = spark.read.parquet(*[_folder(path, sink, b) for b in sorted(_committed(spark, path))])
    return discovery.run_metrics(rows) if sink == "metrics" else rows


def _earlier_searches(spark: SparkSession, path: str, batch: int, oldest: int | None) -> DataFrame | None:
    """Searches of earlier batches that a run of this batch may have made: none is older than the wall clock allows."""
    since = (oldest or 0) - discovery.WALL_CLOCK * 1_000_000
    folders = [_folder(path, "searches", b) for b, newest in _committed(spark, path).items() if b < batch and newest >= since]
    return spark.read.schema(_SEARCHES).parquet(*folders) if folders else None


def write_batch(frames: DataFrame, batch: int, runs: DataFrame, fetched: DataFrame, path: str) -> None:
    """Judge one batch of frames and write its folders, then its commit."""
    spark = frames.sparkSession
    frames.persist()
    try:
        oldest, newest = frames.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).first()
        found = discovery.discover(frames, runs, fetched, _earlier_searches(spark, path, batch, oldest))
        searches = discovery.timely(frames, runs).filter("kind = 'web_search'").select("run_id", "pos", "payload")
        for sink, rows in zip(SINKS, (found.accepted, found.rejected, found.metrics, searches), strict=True):
            rows.write.mode("overwrite").parquet(_folder(path, sink, batch))
        fs, entry = file_system(spark, f"{path}/_batches/{batch}.{newest or 0}")
        fs.create(entry, True).close()
    finally:
        frames.unpersist()


def start(frames: DataFrame, runs: DataFrame, fetched: DataFrame, path: str, **trigger) -> StreamingQuery:
    """Run the stream of frames into the sinks under ``path``, with its checkpoint beside them."""
    writer = frames.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, runs, fetched, path))
    return writer.option("checkpointLocation", f"{path}/_checkpoint").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
