"""Domain views derived from the driver's tables by integer arithmetic on keys.

Each view is built twice from the same lists: with DataFrame expressions here, and
as SQL text for DuckDB (``*_SQL``). All timestamps are instants shown in UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-15 18:00:00"
ORIGIN = (26.3587, -80.0831)

# Enumerations of the data model.
CATEGORIES = ["nightlife", "sports", "food", "outdoors", "arts", "music", "community", "movies", "fitness"]
SOURCES = ["ticketmaster", "eventbrite", "meetup", "scraped", "reddit", "university", "espn", "claude", "community"]
VENUE_CATEGORIES = ["bar", "restaurant", "club", "park", "cinema", "stadium", "gym", "venue", "other"]

# Templates of the derived events.
TITLES = [
    "Trivia Night",
    "Brews & Tunes at Harbor Hall",
    "Brews and Tunes",
    "Sunset Yoga on the Beach",
    "Happy Hour Special",
    "Open",
    "Singles Mixer: Speed Dating",
    "Jazz Concert at Vixens Cabaret",
    "Family Storytime",
    "Farmers Market and Food Trucks",
    "Pickleball Pickup Games",
    "Weekly Event",
    "Live Music Night",
    "Comedy Open Mic",
    "College Basketball vs. Rivals",
    "Gallery Opening and Wine Tasting",
    "Salsa Night",
    "Kayak Tour of the Park",
    "21+ Bar Crawl",
    "Every Wednesday",
    "Evening at Cheetah Lounge",
]
DESCRIPTIONS = [
    "Join us every Friday night for live music, drinks specials and good company. Doors open at 7 pm, tickets at the door.",
    None,
    "Recurring event.",
    "<p>Bring your own <b>paddle</b> &amp; shoes</p> https://example.com/x",
    "A short one",
    "Kids and all ages welcome; free parking near the beach garden.",
    "[caption id=1]photo[/caption] Wine and paint for couples &nbsp; with dinner show on January 20.",
    "Club de striptease",
    "An acoustic band plays blues under the stars, rooftop patio, 18+ only, admission at the gate.",
    "Date night cooking class with a chef: tacos, sushi and dessert included in the price.",
    "Networking workshop and lecture for students, see calendar for dates and times on campus.",
]
RULES = [
    "every monday", "Every Tues", "every WED", "every thursdays", "Every  fri", "every saturday", "every sun", "every blursday",
    "weekly", None, "every Monday evening", "EVERY TUESDAY", "every weds", "every thu", "", "every sat", "every sunday",
    "first monday", "every wednesdays", "every thur", "every friday",
]
SUBCATEGORIES = ["concert", None, "happy hour", "comedy", "", "basketball", "trivia"]
TAG_CHOICES = [
    ("free", 5), ("active", 7), ("live-music", 6), ("21+", 8), ("singles", 13), ("outdoor", 9), ("date-night", 10),
    ("happy-hour", 17), ("family", 14), ("adult", 23), ("social", 12), ("drinking", 15),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; instants are read and shown in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """The value at a zero-based index that wraps around."""
    return F.get(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int"))


def sql_text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_pick(values: list, index: str) -> str:
    """SQL of :func:`pick`."""
    return f"[{', '.join(map(sql_text, values))}][1 + ({index}) % {len(values)}]"


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the feed with an explicit input order ``pos``."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    start = F.col("ts").cast("timestamp")
    hours = lambda n: F.make_dt_interval(F.lit(0), n.cast("int"))
    tags = F.array_compact(F.array(*[F.when(i % n == k % n, F.lit(t)) for k, (t, n) in enumerate(TAG_CHOICES)]))
    return e.select(
        i.alias("id"),
        i.alias("pos"),
        F.when(i % 6 != 0, F.col("user_id") % 40).alias("venue_id"),
        pick(SOURCES, i * 5).alias("source"),
        F.concat(F.lit("s-"), (i % 9973).cast("string")).alias("source_id"),
        pick(TITLES, i).alias("title"),
        pick(DESCRIPTIONS, i * 3).alias("description"),
        pick(CATEGORIES, i * 7).alias("category"),
        pick(SUBCATEGORIES, i).alias("subcategory"),
        (F.lit(ORIGIN[0]) + ((i * 7919) % 4001 - 2000) / F.lit(10000.0)).alias("lat"),
        (F.lit(ORIGIN[1]) + ((i * 104729) % 4001 - 2000) / F.lit(10000.0)).alias("lng"),
        F.concat(F.lit("Hall "), (i % 50).cast("string"), F.lit(", Main Street")).alias("address"),
        F.when(i % 3 == 0, F.lit("https://img.example.com/a.jpg")).alias("image_url"),
        start.alias("start_time"),
        F.when(i % 4 != 0, start + hours(1 + i % 14)).alias("end_time"),
        (i % 7 == 0).alias("is_recurring"),
        F.when(i % 7 == 0, pick(RULES, i)).alias("recurrence_rule"),
        (i % 5 == 0).alias("is_free"),
        F.when(i % 5 != 0, (i % 40).cast("double")).alias("price_min"),
        F.when(i % 10 != 0, (i % 40 + i % 3 * 10).cast("double")).alias("price_max"),
        F.when(i % 8 != 0, F.lit("https://tickets.example.com/t")).alias("ticket_url"),
        F.when(i % 9 != 0, pick(["https://www.eventbrite.com/e/123", "https://www.reddit.com/r/x", "not a url", "https://meetup.com/g?x=1"], i)).alias("source_url"),
        F.when(i % 11 != 0, tags).alias("tags"),
    )


FEED_SQL = f"""
feed AS (
  SELECT event_id AS id, event_id AS pos,
    CASE WHEN event_id % 6 <> 0 THEN user_id % 40 END AS venue_id,
    {sql_pick(SOURCES, "event_id * 5")} AS source,
    's-' || CAST(event_id % 9973 AS VARCHAR) AS source_id,
    {sql_pick(TITLES, "event_id")} AS title,
    {sql_pick(DESCRIPTIONS, "event_id * 3")} AS description,
    {sql_pick(CATEGORIES, "event_id * 7")} AS category,
    {sql_pick(SUBCATEGORIES, "event_id")} AS subcategory,
    {ORIGIN[0]}::DOUBLE + ((event_id * 7919) % 4001 - 2000) / 10000.0::DOUBLE AS lat,
    {ORIGIN[1]}::DOUBLE + ((event_id * 104729) % 4001 - 2000) / 10000.0::DOUBLE AS lng,
    'Hall ' || CAST(event_id % 50 AS VARCHAR) || ', Main Street' AS address,
    CASE WHEN event_id % 3 = 0 THEN 'https://img.example.com/a.jpg' END AS image_url,
    CAST(ts AS TIMESTAMP) AS start_time,
    CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS TIMESTAMP) + to_hours(1 + event_id % 14) END AS end_time,
    event_id % 7 = 0 AS is_recurring,
    CASE WHEN event_id % 7 = 0 THEN {sql_pick(RULES, "event_id")} END AS recurrence_rule,
    event_id % 5 = 0 AS is_free,
    CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 40 AS DOUBLE) END AS price_min,
    CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 40 + event_id % 3 * 10 AS DOUBLE) END AS price_max,
    CASE WHEN event_id % 8 <> 0 THEN 'https://tickets.example.com/t' END AS ticket_url,
    CASE WHEN event_id % 9 <> 0 THEN {sql_pick(["https://www.eventbrite.com/e/123", "https://www.reddit.com/r/x", "not a url", "https://meetup.com/g?x=1"], "event_id")} END AS source_url,
    CASE WHEN event_id % 11 <> 0 THEN list_filter([{", ".join(f"CASE WHEN event_id % {n} = {k % n} THEN '{t}' END" for k, (t, n) in enumerate(TAG_CHOICES))}], lambda x: x IS NOT NULL) END AS tags
  FROM events
)"""


VENUE_NAMES = ["Harbor Hall", "Cheetah Lounge", "The Blue Door", "Vixens Cabaret", "City Park", "Supper Cabaret", "Corner Pub", "Main Stage"]


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues named by the feed's venue ids."""
    e = table(spark, sf_dir, "events")
    v = F.col("id")
    return e.select((F.col("user_id") % 40).alias("id")).distinct().filter("id % 13 <> 5").select(
        "id",
        pick(VENUE_NAMES, v).alias("name"),
        pick(VENUE_CATEGORIES, v * 2).alias("category"),
        F.when(v % 3 != 0, F.concat(F.lit("https://venue"), v.cast("string"), F.lit(".example.com"))).alias("website"),
        F.when(v % 4 == 0, F.lit("p.jpg")).alias("photo_url"),
        (v % 50 / F.lit(10.0)).alias("rating"),
        (v % 100).cast("int").alias("live_busyness"),
    )


VENUES_SQL = f"""
venues AS (
  SELECT id, {sql_pick(VENUE_NAMES, "id")} AS name, {sql_pick(VENUE_CATEGORIES, "id * 2")} AS category,
    CASE WHEN id % 3 <> 0 THEN 'https://venue' || CAST(id AS VARCHAR) || '.example.com' END AS website,
    CASE WHEN id % 4 = 0 THEN 'p.jpg' END AS photo_url, (id % 50) / 10.0::DOUBLE AS rating, CAST(id % 100 AS INTEGER) AS live_busyness
  FROM (SELECT DISTINCT user_id % 40 AS id FROM events) WHERE id % 13 <> 5
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry of discovery runs; costs are whole ten-thousandths, so sums are exact."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    start = F.col("ts").cast("timestamp")
    reasons = ["schema", "grounding", "head", "content", "geo"]
    rejections = F.transform(F.sequence(F.lit(0).cast("long"), i % 4), lambda k: F.struct(pick(reasons, i + k).alias("reason"), F.lit("t").alias("title")))
    return e.select(
        i.alias("id"),
        F.when(i % 3 == 0, "rank").otherwise("discover").alias("phase"),
        F.col("user_id"),
        F.concat(F.lit("cell"), (i % 20).cast("string")).alias("geohash"),
        start.alias("started_at"),
        (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (i % 90).cast("decimal(18,6)"))).alias("finished_at"),
        pick(["ok", "partial", "error", "ok", "timeout"], i).alias("status"),
        (i % 12).alias("events_emitted"),
        (i % 7).alias("events_persisted"),
        F.when(i % 5 != 0, F.to_json(rejections)).alias("rejections"),
        (i % 2500).cast("decimal(10,4)").alias("cost_units"),
    )


RUNS_SQL = """
runs AS (
  SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'rank' ELSE 'discover' END AS phase, user_id, 'cell' || CAST(event_id % 20 AS VARCHAR) AS geohash,
    CAST(ts AS TIMESTAMP) AS started_at, CAST(ts AS TIMESTAMP) + to_seconds(event_id % 90) AS finished_at,
    ['ok', 'partial', 'error', 'ok', 'timeout'][1 + event_id % 5] AS status, event_id % 12 AS events_emitted, event_id % 7 AS events_persisted,
    CASE WHEN event_id % 5 <> 0 THEN list_transform(range(0, event_id % 4 + 1), lambda k: ['schema', 'grounding', 'head', 'content', 'geo'][1 + (event_id + k) % 5]) END AS reasons,
    event_id % 2500 AS cost_units
  FROM events
)"""
