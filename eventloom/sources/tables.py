"""Intermediate tables in the shared folder, and upserts on plain Parquet.

Tables that a later step reads more than once are written under the folder that
the session names in ``spark.checkpoint.dir`` (all executors share it), so a lost
executor costs a re-read and never a recomputation of the whole lineage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, from the session's settings.

    A session on one machine (tests) that names none gets a temporary one; on a
    cluster, whose machines do not share such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="eventloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def file_system(spark: SparkSession, path: str):
    """The store that holds a path, and the path in it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    fs, folder = file_system(spark, path)
    return fs.exists(folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds."""
    fs, folder = file_system(spark, path)
    fs.delete(folder, True)


#: Per open `passing` block, the paths of the tables kept in it.
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables kept within this block are deleted at its end; those kept as lasting go with the block around it, if there is one."""
    _passing.append([])
    try:
        yield
    finally:
        for path in _passing.pop():
            delete(spark, path)


def keep(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    blocks = _passing[:-1] if lasting else _passing
    if blocks:
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of kept tables that nothing reads any more."""
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            delete(table.sparkSession, path)


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of every key; rows with a null key never meet another."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("__nth", nth).filter(~known | (F.col("__nth") == 1)).drop("__nth")


def upserted(table: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] = ()) -> DataFrame:
    """The table after inserting the batch or overwriting the columns that the batch has.

    Of several batch rows with one key the last by ``order`` counts. Columns that the
    batch lacks keep their values. Rows with a null key are always inserted.
    """
    batch = latest(batch, keys, list(order)) if order else batch
    mine = batch.select(*[F.col(c).alias(f"__{c}") for c in batch.columns], F.lit(True).alias("__new"))
    same = F.lit(True)
    for k in keys:
        same = same & (table[k] == mine[f"__{k}"])
    joined = table.join(mine, same, "full_outer")
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in batch.columns else F.col(c) for c in table.columns])


class Conflict(RuntimeError):
    """Another writer committed the version that this one was to become."""


def _log_folder(path: str) -> str:
    return f"{path.rstrip('/')}/_log"


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Folder of every committed version, by its number; one small file names each."""
    fs, log = file_system(spark, _log_folder(path))
    found = {}
    for status in fs.listStatus(log) if fs.exists(log) else ():
        number, _, folder = status.getPath().getName().partition(".")
        found[int(number)] = folder
    return found


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the newest committed version; 0 where nothing was committed."""
    return max(_commits(spark, path), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest committed version of a table, or the one asked for. What is written but not committed is never seen."""
    commits = _commits(spark, path)
    return spark.read.parquet(f"{path.rstrip('/')}/{commits[max(commits) if version is None else version]}")


def commit_version(path: str, rows: DataFrame, after: int) -> int:
    """Write ``rows`` as the version that follows ``after``; readers see it whole or not at all.

    The rows go to a folder of their own first; then one file is created in the log, which
    fails where it exists. A writer that stops before that leaves the old version in place,
    and of two writers from one version the second gets :class:`Conflict`.
    """
    spark = rows.sparkSession
    folder = f"v{after + 1}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{folder}")
    fs, log = file_system(spark, f"{_log_folder(path)}/{after + 1}.{folder}")
    taken = [n for n in _commits(spark, path) if n > after]
    claim = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_claims/{after + 1}")
    if taken or not fs.createNewFile(claim):
        delete(spark, f"{path.rstrip('/')}/{folder}")
        raise Conflict(f"version {after + 1} of {path} exists already")
    fs.create(log, False).close()
    return after + 1


def vacuum(spark: SparkSession, path: str, versions: int = 2) -> None:
    """Delete all but the newest ``versions`` versions, and folders that no commit names; no writer may be at work."""
    commits = _commits(spark, path)
    kept = {commits[n] for n in sorted(commits)[-versions:]}
    fs, root = file_system(spark, path)
    for status in fs.listStatus(root) if fs.exists(root) else ():
        name = status.getPath().getName()
        if re.match(r"v\d+-", name) and name not in kept:
            fs.delete(status.getPath(), True)
    for n, folder in commits.items():
        if folder not in kept:
            fs.delete(file_system(spark, f"{_log_folder(path)}/{n}.{folder}")[1], False)


def write_upsert(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[Column] = (), attempts: int = 3) -> int:
    """Upsert into a table of versions; returns the number of the new version.

    The batch meets the newest version, and the result becomes the next one by
    :func:`commit_version`; where another writer was faster, it meets that one's rows.
    """
    for left in reversed(range(attempts)):
        version = current_version(spark, path)
        if version:
            result = upserted(read_version(spark, path, version), batch, keys, order)
        else:
            result = latest(batch, keys, list(order)) if order else batch
        try:
            return commit_version(path, result, version)
        except Conflict:
            if not left:
                raise
    raise ValueError("no attempt was asked for")


def append(path: str, rows: DataFrame) -> None:
    """Append-only logs."""
    rows.write.mode("append").parquet(path)
