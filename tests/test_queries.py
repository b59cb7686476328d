"""Every core query runs; those with SQL give DuckDB's rows."""

import re

import pytest

from eventloom.plans import catalog
from tests.conftest import SF, duck, same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        same_rows(df, duck(), catalog.ORACLE_SQL[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["feed_event_by_id"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[In\(event_id, \[([\d,]+)\]\)\]", plan)  # Spark may list the values in any order
    assert pushed and set(pushed[1].split(",")) == {"7", "42", "100"}


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_numbered_counts_on_across_ranges(spark, rows):
    from pyspark.sql import functions as F

    from eventloom.operators import feed

    own = spark.range(rows).select((F.col("id") * 7919 % 1009).alias("k"), "id")
    found = feed.numbered(own, [F.col("k").desc(), F.col("id")], "n").collect()
    wanted = sorted(((r["k"], r["id"]) for r in found), key=lambda r: (-r[0], r[1]))
    assert len(found) == rows and {(r["k"], r["id"]): r["n"] for r in found} == {r: n for n, r in enumerate(wanted, 1)}


def test_scan_budget_and_health_without_numbers(spark):
    from pyspark.sql import functions as F

    from eventloom.operators import scans

    assert [scans.budget(n, thin) for n, thin in ((0, True), (99, True), (0, False), (19, False), (20, False), (39, False), (40, False))] == [45, 45, 40, 40, 28, 28, 18]
    venues = spark.createDataFrame([(1, "Hall", "bar", None, 26.0, -80.0), (2, "Hall", "bar", None, 26.0, -80.0), (3, "Hall", "bar", None, 26.0, -80.0), (4, None, None, None, None, None)], "id long, name string, category string, website string, lat double, lng double")
    health = spark.createDataFrame([(2, None, None, None, None, None), (3, 1, 0.0, 0, 0, "2030-01-01 00:00:00")], "venue_id long, total_events_passed long, avg_quality_score double, consecutive_empty long, consecutive_errors long, next_scan_at string")
    found = scans.due(venues, health.withColumn("next_scan_at", F.col("next_scan_at").cast("timestamp")), (26.0, -80.0), 5.0, F.lit("2024-01-01 00:00:00").cast("timestamp"), 9)
    assert [(r["id"], r["priority"]) for r in found.collect()] == [(1, 34.0), (2, 26.0)]


def test_whole_spatial_join(spark):
    from math import asin, cos, radians, sin

    from eventloom.functions import geo
    from eventloom.plans.views import feed_events

    def miles(a, b):
        h = sin(radians(a[1] - b[1]) / 2) ** 2 + cos(radians(a[1])) * cos(radians(b[1])) * sin(radians(a[2] - b[2]) / 2) ** 2
        return 2 * geo.RADIUS_MILES * asin(min(1, h**0.5))

    own = feed_events(spark, SF)
    points, places = ([tuple(r) for r in df.select("id", "lat", "lng").collect()] for df in (own, own.filter("source = 'university'")))
    found = {(r["id"], r["place_id"]): r["miles"] for r in catalog.QUERIES["geo_spatial_join"](spark, SF).collect()}
    wanted = {(a[0], b[0]): miles(a, b) for a in points for b in places if None not in (*a, *b) and miles(a, b) <= 2}
    assert set(found) == set(wanted) and all(abs(found[k] - wanted[k]) < 1e-5 for k in wanted)


def test_feed_pipeline_shows_the_whole_feed(spark):
    assert {r["id"] % 4 for r in catalog.QUERIES["feed_pipeline"](spark, SF).collect()} == {0, 1, 2, 3}
