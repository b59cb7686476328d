"""A feed laid out by cells: rows near each other in the same files, and searches that open only the cells of their circle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import geo

#: Cells that a search may name; beyond, shorter prefixes stand for their parts.
MOST_CELLS = 512


def write_cells(events: DataFrame, path: str, precision: int = 4, file_rows: int = 1_000_000) -> None:
    """Write events (lat, lng) in folders by ``cell``, the first letters of their geohash; those without a place in one of their own.

    A cell of many rows becomes several files: rows are dealt by cell and by a hash, which
    is as wide as Spark finds the data large, so no task holds a whole hot cell.
    """
    cells = events.withColumn("cell", F.coalesce(geo.geohash(F.col("lat"), F.col("lng"), precision), F.lit("none")))
    spread = cells.hint("rebalance", "cell")
    spread.write.option("maxRecordsPerFile", file_rows).partitionBy("cell").parquet(path)


def _ranges(low: float, high: float, first: float, last: float, cells: int) -> list[int]:
    """Numbers of the cells of an axis from ``first`` to ``last`` that touch [low, high]."""
    at = lambda x: min(cells - 1, max(0, math.floor((x - first) / (last - first) * cells)))
    return list(range(at(low), at(high) + 1))


def _name(row: int, column: int, precision: int) -> str:
    """The geohash of a cell by its row and column."""
    letters, bits = [], 5 * precision
    n_lng = (bits + 1) // 2
    n_lat = bits - n_lng
    for letter in range(precision):
        code = 0
        for bit in range(5 * letter, 5 * letter + 5):
            source, n = (column, n_lng) if bit % 2 == 0 else (row, n_lat)
            code = code * 2 + (source >> (n - 1 - bit // 2) & 1)
        letters.append(geo.BASE32[code])
    return "".join(letters)


def covering_cells(origin: tuple[float, float], miles: float, precision: int = 4, most: int = MOST_CELLS) -> list[str]:
    """Prefixes of geohashes that together hold the whole circle: of the precision, or shorter ones where it takes too many."""
    lat, lng = origin
    d_lat = math.degrees(miles / geo.RADIUS_MILES) * 1.0001
    south, north = max(-90.0, lat - d_lat), min(90.0, lat + d_lat)
    # As wide as the circle is anywhere; with a pole inside it goes all the way round.
    ratio = math.sin(min(math.pi / 2, miles / geo.RADIUS_MILES)) / max(1e-12, math.cos(math.radians(lat)))
    d_lng = math.degrees(math.asin(ratio)) * 1.0001 if ratio < 1 and south > -90 and north < 90 else 180.0
    parts = [(-180.0, 180.0)] if d_lng >= 180 else [(max(-180.0, lng - d_lng), min(180.0, lng + d_lng))]
    if d_lng < 180 and lng - d_lng < -180:
        parts.append((lng - d_lng + 360, 180.0))
    if d_lng < 180 and lng + d_lng > 180:
        parts.append((-180.0, lng + d_lng - 360))
    n_lng = (5 * precision + 1) // 2
    rows = _ranges(south, north, -90, 90, 1 << (5 * precision - n_lng))
    columns = sorted({c for low, high in parts for c in _ranges(low, high, -180, 180, 1 << n_lng)})
    if len(rows) * len(columns) > most and precision > 1:
        return covering_cells(origin, miles, precision - 1, most)
    return [_name(r, c, precision) for r in rows for c in columns]


def read_near(spark: SparkSession, path: str, origin: tuple[float, float], miles: float, precision: int = 4) -> DataFrame:
    """The stored events whose cell the circle may touch; other cells' folders are not listed as input. The distance is still to be checked."""
    cells = covering_cells(origin, miles, precision)
    own = spark.read.parquet(path)
    # Names on the folder column: Spark drops the others before it opens a file.
    named = F.col("cell").isin(cells) if len(cells[0]) == precision else F.substring("cell", 1, len(cells[0])).isin(cells)
    return own.filter(named).drop("cell")
