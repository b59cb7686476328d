"""Queries of schools near requests: the nearest eight, their pages' games, and stored cells of the feed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.operators import nearest, stored
from eventloom.plans.feed_queries import TS, _discover_sql, _discovered, now_column
from eventloom.plans.views import ORIGIN, feed_events, pick, sql_pick, table
from eventloom.sources import connectors, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
MOST_SCHOOLS = 8
_RADIUS = 40.0
_TOWNS = ["Palm", "Cedar", "Lake", "St. Mary's", "North"]


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _schools(spark, sf_dir):
    """Schools made from customers: spread over a region, one in seven without a website."""
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        i.alias("place_id"), F.concat(pick(_TOWNS, i), F.lit(" High "), i.cast("string")).alias("name"), F.concat(i.cast("string"), F.lit(" School Road")).alias("address"),
        (F.lit(25.0) + (i * 7919 % 30011) / F.lit(10000.0)).alias("plat"), (F.lit(-82.0) + (i * 104729 % 30013) / F.lit(10000.0)).alias("plng"),
        F.when(i % 7 != 0, F.concat(F.lit("https://school"), i.cast("string"), F.lit(".example.edu/"))).alias("website"),
    )


def _requests(spark, sf_dir):
    i = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(i.alias("id"), (F.lit(24.5) + (i * 6053 % 40009) / F.lit(10000.0)).alias("lat"), (F.lit(-82.5) + (i * 5479 % 40013) / F.lit(10000.0)).alias("lng"))


_NEAR_SQL = f"""schools AS (
  SELECT c_custkey AS place_id, {sql_pick(_TOWNS, "c_custkey")} || ' High ' || c_custkey AS name, c_custkey || ' School Road' AS address, 25.0::DOUBLE + (c_custkey * 7919 % 30011) / 10000.0::DOUBLE AS plat, -82.0::DOUBLE + (c_custkey * 104729 % 30013) / 10000.0::DOUBLE AS plng FROM customer WHERE c_custkey % 7 <> 0
), requests AS (
  SELECT s_suppkey AS id, 24.5::DOUBLE + (s_suppkey * 6053 % 40009) / 10000.0::DOUBLE AS lat, -82.5::DOUBLE + (s_suppkey * 5479 % 40013) / 10000.0::DOUBLE AS lng FROM supplier
), pairs AS (
  SELECT r.id, s.*, 2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * pow(sin(radians(plng - lng) / 2), 2)))) AS miles FROM requests r, schools s
), near AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY miles, place_id) AS INTEGER) AS rank FROM pairs WHERE miles <= {_RADIUS}::DOUBLE QUALIFY rank <= {MOST_SCHOOLS}
)"""


def _near(spark, sf_dir):
    schools = _schools(spark, sf_dir).filter("website IS NOT NULL")
    return nearest.nearest(_requests(spark, sf_dir), schools, MOST_SCHOOLS, _RADIUS), schools


@query("source_nearest_schools", f"WITH {_NEAR_SQL} SELECT id, place_id, rank, round(miles, 6) AS miles FROM near")
def source_nearest_schools(spark, sf_dir):
    """The eight schools with a website nearest to each request."""
    return _near(spark, sf_dir)[0].select("id", "place_id", "rank", F.round("miles", 6).alias("miles"))


_GAME = '[{"title": "%s Football vs %s", "subcategory": %s, "start_time": "2024-01-%02dT19:00:00Z"%s}, {"title": "", "start_time": "2024-01-20T19:00:00Z"}, {"title": "Old game", "start_time": "2024-01-02T19:00:00Z"}]'


@query(
    "source_school_games",
    f"""WITH {_NEAR_SQL}, chosen AS (SELECT DISTINCT place_id, name, address, plat, plng FROM near), games AS (
  SELECT *, name || ' Football vs ' || {sql_pick(_TOWNS, "place_id // 5")} AS title, CASE WHEN place_id % 4 <> 0 THEN 'football' END AS sub, make_timestamp(2024, 1, 10 + place_id % 19, 19, 0, 0) AS start_time FROM chosen)
SELECT 'hs-' || left(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), 40) || '-' || left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 60) || '-' || strftime(start_time, '%Y-%m-%d') AS source_id, title,
  coalesce(sub, 'Sports') || ' at ' || name || '.' AS description, coalesce(sub, 'sports_event') AS subcategory, plat AS lat, plng AS lng, name || ', ' || address AS address, start_time, place_id % 3 <> 0 AS is_free
FROM games WHERE start_time > {TS} - INTERVAL 1 HOUR""",
)
def source_school_games(spark, sf_dir):
    """Games that a model read on the chosen schools' pages, at the schools' coordinates."""
    near, schools = _near(spark, sf_dir)
    # Equal rows are one, and all are dealt anew: few tasks may have read them, and reading pages takes longer.
    chosen = schools.join(near.select("place_id").distinct(), "place_id", "left_semi").distinct()
    i = F.col("place_id")
    sub = F.when(i % 4 == 0, "null").otherwise('"football"')
    output = F.concat(F.lit("Found: "), F.format_string(_GAME, "name", pick(_TOWNS, F.floor(i / 5)), sub, 10 + i % 19, F.when(i % 3 == 0, ', "is_free": false').otherwise("")))
    games = connectors.school_games(chosen.withColumn("output", output), now_column())
    return games.select("source_id", "title", "description", "subcategory", "lat", "lng", "address", "start_time", "is_free")


@query("feed_discover_cells", _discover_sql(5.0))
def feed_discover_cells(spark, sf_dir):
    """the ranked feed around a point from a feed stored by cells, of which only those of the circle are read."""
    path = f"{tables.shared_dir(spark).rstrip('/')}/feed-cells-{uuid.uuid4().hex}"
    stored.write_cells(feed_events(spark, sf_dir), path)
    return _discovered(spark, sf_dir, 5.0, stored.read_near(spark, path, ORIGIN, 5.0))
