"""Which places' pages to scan next, and when a cell was last synced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import geo, score
from eventloom.functions import classify as cl


def budget(fast_events: int, thin: bool) -> int:
    """Scans that a cell may cost: most where the last sync was thin, fewer the more events came from fast sources."""
    if thin:
        return 45
    # Events from fast sources, and the scans left to such a cell.
    return next((scans for events, scans in ((40, 18), (20, 28)) if fast_events >= events), 40)


def due(venues: DataFrame, health: DataFrame, origin: tuple[float, float], miles: float, now: Column, most: int) -> DataFrame:
    """The places around a point that are due, with ``priority``, best first, the smaller id first among equals.

    A place without health, or whose health names no next scan, is due. Numbers that
    the health lacks count as 0.
    """
    near = venues.filter(geo.rough_box(F.col("lat"), F.col("lng"), origin, miles) & ~cl.is_adult_venue(F.col("name")))
    known = health.withColumnRenamed("venue_id", "id").withColumn("known", F.lit(True))
    joined = near.join(known, "id", "left").filter(F.col("next_scan_at").isNull() | (F.col("next_scan_at") <= now))
    number = lambda c: F.coalesce(F.col(c), F.lit(0))
    points = score.scan_priority(
        F.col("category"), F.col("website"), number("total_events_passed"), number("avg_quality_score"), number("consecutive_empty"), number("consecutive_errors"), F.coalesce("known", F.lit(False))
    )
    return joined.withColumn("priority", points).orderBy(F.col("priority").desc(), "id").limit(most)


def latest_sync(syncs: DataFrame, geohash: str, grid_key: str) -> DataFrame:
    """The newest sync of a cell, known by either key; the larger id of two at once."""
    return syncs.filter((F.col("geohash") == geohash) | (F.col("grid_key") == grid_key)).orderBy(F.col("synced_at").desc(), F.col("id").desc()).limit(1)


def unchanged_pages(scans: DataFrame) -> DataFrame:
    """Scans (venue_id, seq, page_hash, outcome, found, passed) whose page is the one read last: outcome ``unchanged``, nothing found.

    The page read last is the newest with a hash before this scan; a scan without a hash keeps its outcome.
    """
    before = Window.partitionBy("venue_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    same = F.coalesce(F.col("page_hash") == F.last("page_hash", ignorenulls=True).over(before), F.lit(False))
    own = scans.withColumn("__same", same & (F.col("outcome") != "error"))
    none = lambda c: F.when(F.col("__same"), F.lit(0)).otherwise(F.col(c))
    return own.withColumns({"outcome": F.when(F.col("__same"), "unchanged").otherwise(F.col("outcome")), "found": none("found"), "passed": none("passed")}).drop("__same")
