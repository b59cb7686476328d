"""Queries of tables kept by upserts: two batches committed after each other, then the newest version read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.operators import profile
from eventloom.plans.feed_queries import TS, now_column
from eventloom.plans.profile_queries import _ANSWERS_SQL, _answers
from eventloom.plans.views import FEED_SQL, feed_events, table
from eventloom.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _kept(spark, name, batches, keys, order=()):
    """The newest version of a table after upserts of the batches."""
    path = f"{tables.shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for batch in batches:
        tables.write_upsert(spark, path, batch, keys, order)
    return tables.read_version(spark, path)


_KEY = "CASE WHEN floor(@ * 10 + 0.5::DOUBLE) = 0 THEN '0' ELSE regexp_replace(CAST(floor(@ * 10 + 0.5::DOUBLE) / 10 AS VARCHAR), '\\.0$', '') END"


@query(
    "upsert_sync_log",
    f"""WITH {FEED_SQL}, syncs AS (SELECT id, {_KEY.replace("@", "lat")} || ',' || {_KEY.replace("@", "lng")} AS grid_key, start_time AS synced_at, id % 40 AS event_count, id % 6 = 0 AS second FROM feed)
SELECT grid_key, last(synced_at ORDER BY second, id) AS synced_at, last(event_count ORDER BY second, id) AS event_count, CASE WHEN bool_or(NOT second) THEN last(id ORDER BY id) FILTER (NOT second) END AS first_id FROM syncs GROUP BY grid_key""",
)
def upsert_sync_log(spark, sf_dir):
    """K3: the sync log keyed by cell; a later batch overwrites the columns that it has."""
    i = F.col("id")
    syncs = feed_events(spark, sf_dir).select("id", geo.grid_key(F.col("lat"), F.col("lng")).alias("grid_key"), F.col("start_time").alias("synced_at"), (i % 40).alias("event_count"), i.alias("first_id"))
    kept = _kept(spark, "sync-log", [syncs.filter("id % 6 <> 0"), syncs.filter("id % 6 = 0").drop("first_id")], ["grid_key"], [i])
    return kept.select("grid_key", "synced_at", "event_count", "first_id")


@query(
    "upsert_scan_health",
    """WITH scans AS (SELECT event_id AS id, user_id % 60 AS venue_id, event_id % 9 AS total_scans, (event_id % 50) / 2.0::DOUBLE AS avg_quality, event_id % 4 = 0 AND user_id % 60 < 45 AS second FROM events WHERE user_id % 60 < 45 OR event_id % 4 <> 0)
SELECT venue_id, last(total_scans ORDER BY second, id) AS total_scans, last(avg_quality ORDER BY id) FILTER (NOT second) AS avg_quality FROM scans GROUP BY venue_id""",
)
def upsert_scan_health(spark, sf_dir):
    """K3: scan health keyed by venue; what a batch lacks stays."""
    i, v = F.col("event_id"), F.col("user_id") % 60
    scans = table(spark, sf_dir, "events").select(i.alias("id"), v.alias("venue_id"), (i % 9).alias("total_scans"), (i % 50 / F.lit(2.0)).alias("avg_quality"))
    batches = [scans.filter("id % 4 <> 0"), scans.filter("id % 4 = 0 AND venue_id < 45").drop("avg_quality")]
    return _kept(spark, "scan-health", batches, ["venue_id"], [F.col("id")]).select("venue_id", "total_scans", "avg_quality")


@query(
    "upsert_profiles",
    f"""WITH {_ANSWERS_SQL} SELECT user_id AS id, array_to_string(coalesce(goals, []), ',') AS goals, CASE WHEN user_id % 3 = 0 THEN 'free' ELSE budget END AS budget, coalesce(happy_hour, 'true') AS happy_hour, CASE WHEN user_id % 3 = 0 THEN {TS} + INTERVAL 1 DAY ELSE {TS} END AS updated_at FROM answers""",
)
def upsert_profiles(spark, sf_dir):
    """Profile rows keyed by user; a later change of the budget leaves the rest."""
    none = F.lit(None).cast("string")
    lists = {c: F.lit(None).cast("array<string>") for c in ("hidden_categories", "hidden_tags")}
    given = profile.preferences(_answers(spark, sf_dir)).withColumns({"vibe": none, "schedule": none, **lists, "lat": none.cast("double"), "lng": none.cast("double")})
    rows = profile.profile_rows(given, now_column())
    changed = rows.filter("id % 3 = 0").select("id", F.lit("free").alias("budget"), (now_column() + F.expr("INTERVAL '1' DAY")).alias("updated_at"))
    return _kept(spark, "profiles", [rows, changed], ["id"]).select("id", F.array_join("goals", ",").alias("goals"), "budget", "happy_hour", "updated_at")


@query(
    "upsert_venues",
    f"""WITH {FEED_SQL}, found AS (SELECT id, 'p' || (id % 997) AS google_place_id, title AS name, id % 3 = 0 AS second FROM feed WHERE id % 11 <> 0) SELECT google_place_id, last(name ORDER BY second, id) AS name, last(id ORDER BY second, id) AS id FROM found GROUP BY google_place_id""",
)
def upsert_venues(spark, sf_dir):
    """K2: places keyed by their id at the source."""
    found = feed_events(spark, sf_dir).filter("id % 11 <> 0").select("id", F.concat(F.lit("p"), (F.col("id") % 997).cast("string")).alias("google_place_id"), F.col("title").alias("name"))
    return _kept(spark, "venues", [found.filter("id % 3 <> 0"), found.filter("id % 3 = 0")], ["google_place_id"], [F.col("id")]).select("google_place_id", "name", "id")


@query("append_logs", "SELECT event_type AS endpoint, 2 * count(*) AS calls, max(event_id) AS newest FROM events GROUP BY event_type")
def append_logs(spark, sf_dir):
    """K4: two batches appended to a log; nothing is overwritten."""
    path = f"{tables.shared_dir(spark).rstrip('/')}/calls-{uuid.uuid4().hex}"
    calls = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("endpoint"))
    for _ in range(2):
        tables.append(path, calls)
    return spark.read.schema(calls.schema).parquet(path).groupBy("endpoint").agg(F.count(F.lit(1)).alias("calls"), F.max("event_id").alias("newest"))
