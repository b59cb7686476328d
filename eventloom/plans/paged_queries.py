"""Queries of connectors over a table of fetched pages, made from the feed: each page holds some of its events as the source writes them."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans.content_queries import _THEATRES, _any_language, _first_brand
from eventloom.plans.feed_queries import TS, now_column
from eventloom.plans.views import FEED_SQL, feed_events, pick, sql_pick
from eventloom.sources import paged

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _id():
    return F.col("id")


def _iso():
    return F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _pages(feed, request, query_no, page_no, event, wrap):
    """Pages of the feed's events in the order of their ids: ``event`` as one entry, ``wrap`` around a page's entries."""
    keyed = feed.select(request.cast("string").alias("request_id"), query_no.cast("int").alias("query_no"), page_no.cast("int").alias("page_no"), "id", event.alias("e"))
    grouped = keyed.groupBy("request_id", "query_no", "page_no").agg(F.array_sort(F.collect_list(F.struct("id", "e"))).alias("rows"))
    return grouped.withColumn("payload", wrap(F.col("rows.e")))


_SAID = "title || ' ' || coalesce(description, '')"
_NOT_ADULT = f"NOT ({_any_language(_SAID)}) AND {_first_brand('title')} IS NULL AND lower(trim(regexp_extract(title, '(?i)\\bat\\s+([a-z''\\s]+\\s+cabaret)\\b', 1))) IN ('', {_THEATRES})"


@query(
    "source_eventbrite",
    f"""WITH {FEED_SQL}, listed AS (
  SELECT *, id // 700 AS request, id % 4 AS q, 1 + id // 4 % 5 AS page, 'e' || (id % 311) AS eid FROM feed
), pages AS (
  SELECT request, q, page, (request + q + page) % 11 <> 0 AS ok, (request + page) % 6 <> 0 AS more FROM listed GROUP BY ALL
), read AS (
  SELECT p.request, p.q, p.page FROM pages p LEFT JOIN pages b ON b.request = p.request AND b.q = p.q AND b.page < p.page AND b.ok AND b.more WHERE p.page <= 4 AND p.ok GROUP BY ALL HAVING count(b.page) = p.page - 1
), firsts AS (
  SELECT *, date_trunc('second', start_time) AS start FROM listed JOIN read USING (request, q, page) QUALIFY row_number() OVER (PARTITION BY request, eid ORDER BY q, page, id) = 1
)
SELECT CAST(request AS VARCHAR) AS request_id, 'eb-' || eid AS source_id, title, left(description, 500) AS description, lat, lng, address || ', Boca' AS address, start AS start_time, is_free, ticket_url
FROM firsts WHERE id % 13 <> 0 AND start BETWEEN {TS} AND CASE WHEN request % 2 = 1 THEN {TS} + INTERVAL 30 DAY ELSE date_trunc('week', {TS}) + INTERVAL 7 DAY END AND {_NOT_ADULT}""",
)
def source_eventbrite(spark, sf_dir):
    """Four queries of up to four pages, where reading ends, the first of every id, the window of the request."""
    i, iso = _id(), _iso()
    feed, request, page = feed_events(spark, sf_dir), F.floor(i / 700), 1 + F.floor(i / 4) % 5
    text = lambda c: F.struct(F.col(c).alias("text"))
    address = F.struct(F.col("address").alias("address_1"), F.lit("Boca").alias("city"))
    venue = F.struct(F.lit("Hall").alias("name"), F.when(i % 13 == 0, "0").otherwise(F.col("lat").cast("string")).alias("latitude"), F.col("lng").cast("string").alias("longitude"), address.alias("address"))
    event = F.struct(F.concat(F.lit("e"), (i % 311).cast("string")).alias("id"), text("title").alias("name"), text("description").alias("description"), F.col("ticket_url").alias("url"), "is_free", F.struct(iso.alias("utc")).alias("start"), venue.alias("venue"))
    more = ((F.col("request_id").cast("long") + F.col("page_no")) % 6 != 0).alias("has_more_items")
    pages = _pages(feed, request, i % 4, page, event, lambda rows: F.to_json(F.struct(rows.alias("events"), F.struct(more).alias("pagination"))))
    pages = pages.withColumn("ok", (F.col("request_id").cast("long") + F.col("query_no") + F.col("page_no")) % 11 != 0)
    requests = feed.select(request.alias("n")).distinct().select(F.col("n").cast("string").alias("request_id"), now_column().alias("at"), (F.col("n") % 2 == 1).alias("expand"))
    return paged.eventbrite(pages, requests).select("request_id", "source_id", "title", "description", "lat", "lng", "address", "start_time", "is_free", "ticket_url")


@query(
    "source_seatgeek",
    f"""WITH {FEED_SQL}, shown AS (SELECT *, id // 120 AS request, row_number() OVER (PARTITION BY id // 120 ORDER BY id) AS nth FROM feed)
SELECT CAST(request AS VARCHAR) AS request_id, CAST(id AS VARCHAR) AS source_id, CASE WHEN id % 3 = 0 THEN title ELSE 'Short ' || id END AS title, {sql_pick(["music", "sports", "arts", "nightlife"], "id")} AS category,
  lat, lng, address || ', Boca, ' AS address, CASE WHEN id % 3 = 0 THEN 'p.jpg' END AS image_url, nullif(price_min, 0) AS price_min, nullif(price_max, 0) AS price_max, date_trunc('second', start_time) AS start_time
FROM shown WHERE nth <= 100 AND request % 9 <> 4""",
)
def source_seatgeek(spark, sf_dir):
    """The first hundred rows of one page, short titles first, prices of 0 as none."""
    i, iso = _id(), _iso()
    feed, request = feed_events(spark, sf_dir), F.floor(i / 120)
    venue = F.struct("address", F.lit("Boca").alias("city"), F.struct("lat", F.col("lng").alias("lon")).alias("location"))
    event = F.struct(
        "id", "title", F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("Short "), i.cast("string"))).alias("short_title"), "description", pick(["concert", "nba", "theater", "comedy"], i).alias("type"), F.lit("https://s.example.com").alias("url"),
        iso.alias("datetime_utc"), F.struct(F.col("price_min").alias("lowest_price"), F.col("price_max").alias("highest_price")).alias("stats"), F.when(i % 3 == 0, F.array(F.struct(F.lit("p.jpg").alias("image")))).alias("performers"), venue.alias("venue"),
    )
    pages = _pages(feed, request, F.lit(0), F.lit(1), event, lambda rows: F.to_json(F.struct(rows.alias("events")))).withColumn("ok", F.col("request_id").cast("long") % 9 != 4)
    return paged.seatgeek(pages).select("request_id", "source_id", "title", "category", "lat", "lng", "address", "image_url", "price_min", "price_max", "start_time")


_BUCKETS = [b[1] for b in paged.MEETUP_BUCKETS]


@query(
    "source_meetup",
    f"""WITH {FEED_SQL}, listed AS (SELECT *, id // 90 AS request, id % 9 AS q, date_trunc('second', start_time) AS start FROM feed), api AS (
  SELECT request, id, title, start, {sql_pick(_BUCKETS, "q")} AS subcategory, CASE WHEN id % 2 = 0 THEN 'A walk in the park.' ELSE {sql_pick([b[0] for b in paged.MEETUP_BUCKETS], "q")} || ' via Meetup' END AS description, id % 4 = 0 OR id % 3 = 0 AS is_free, 'Hall, 1 Main St, Boca' AS address
  FROM listed WHERE request % 3 <> 0 AND id % 17 <> 0
), pages AS (
  SELECT request, id, 'Found ' || title AS title, start, {sql_pick(_BUCKETS, "q")} AS subcategory, {sql_pick([b[0] for b in paged.MEETUP_BUCKETS], "q")} || ' via Meetup' AS description, true AS is_free, 'Court, By the lake' AS address FROM listed WHERE request NOT IN (SELECT request FROM api)
)
SELECT CAST(request AS VARCHAR) AS request_id, 'meetup-' || left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 40) || '-' || strftime(start, '%Y%m%d') AS source_id, title, description, subcategory, address, start AS start_time, is_free FROM (FROM api UNION ALL FROM pages)""",
)
def source_meetup(spark, sf_dir):
    """Nine keyword buckets of the API, or of pages for requests to which the API gave nothing."""
    i, iso = _id(), _iso()
    feed, request = feed_events(spark, sf_dir), F.floor(i / 90)
    fee = F.when(i % 4 != 0, F.struct(F.lit("cash").alias("accepts"), (i % 3).cast("double").alias("amount")))
    venue = F.struct(F.lit("Hall").alias("name"), F.lit("1 Main St").alias("address"), F.lit("Boca").alias("city"), F.lit("").alias("state"))
    result = F.struct(F.when(i % 17 == 0, "").otherwise(i.cast("string")).alias("id"), "title", F.when(i % 2 == 0, "A walk in the park.").alias("description"), iso.alias("dateTime"), fee.alias("isAttendingFree"), venue.alias("venue"))
    edge = F.struct(F.struct(result.alias("result")).alias("node"))
    within = lambda rows: F.to_json(F.struct(F.struct(F.struct(rows.alias("edges")).alias("keywordSearch")).alias("data")))
    api = _pages(feed, request, i % 9, F.lit(1), edge, within).withColumn("ok", F.col("request_id").cast("long") % 3 != 0)
    row = F.struct(F.concat(F.lit("Found "), "title").alias("title"), iso.alias("start_time"), F.lit("Court").alias("venue_name"), F.lit("By the lake").alias("address_hint"))
    scraped = _pages(feed, request, i % 9, F.lit(1), row, lambda rows: F.concat(F.lit("I found: "), F.to_json(rows))).withColumn("ok", F.lit(True))
    return paged.meetup(api, scraped).select("request_id", "source_id", "title", "description", "subcategory", "address", "start_time", "is_free")


@query(
    "source_localist",
    f"""WITH {FEED_SQL}, listed AS (
  SELECT *, id // 60 AS request, id % 2 AS q, row_number() OVER (PARTITION BY id // 60, id % 2 ORDER BY id) AS nth, CASE WHEN id // 60 % 3 = 0 AND id % 2 = 0 THEN NULL ELSE 'A talk about number ' || id || '.' END AS info FROM feed
), given AS (SELECT * FROM listed WHERE nth <= 25 AND NOT (request % 5 = 0 AND q = 0) AND info IS NOT NULL AND id % 19 <> 0)
SELECT CAST(request AS VARCHAR) AS request_id, 'uni-' || CASE WHEN id % 7 = 0 THEN left(regexp_replace(lower('State ' || request || '-' || title), '[^a-z0-9]+', '-', 'g'), 80) ELSE CAST(id AS VARCHAR) END AS source_id, title, info AS description,
  CASE WHEN id % 4 = 0 THEN 25.5::DOUBLE ELSE lat END AS lat, CASE WHEN id % 4 = 0 THEN -80.5::DOUBLE ELSE lng END AS lng, date_trunc('second', start_time) AS start_time, CASE WHEN id % 6 <> 0 THEN date_trunc('second', start_time) END AS end_time, id % 5 <> 0 AS is_free,
  CASE WHEN id % 3 = 0 THEN 'https://state.example.edu' ELSE 'https://l.example.edu/' || id END AS source_url, CASE WHEN id % 3 = 0 THEN 'State ' || request || ', Campus' ELSE 'Room, Campus' END AS address
FROM given QUALIFY q = min(q) OVER (PARTITION BY request)""",
)
def source_localist(spark, sf_dir):
    """The first candidate address of a university that gives events, 25 entries of it."""
    i, iso = _id(), _iso()
    feed, request = feed_events(spark, sf_dir), F.floor(i / 60)
    known = ~((request % 3 == 0) & (i % 2 == 0))
    instance = F.array(F.struct(F.struct(iso.alias("start"), iso.alias("end")).alias("event_instance")))
    event = F.struct(
        F.when(i % 7 != 0, i).alias("id"), "title", F.when(known, F.concat(F.lit("A talk about number "), i.cast("string"), F.lit("."))).alias("description"), F.when((i % 6 == 0) & (i % 19 != 0), iso).alias("first_date"),
        F.when((i % 6 != 0) & (i % 19 != 0), instance).alias("event_instances"), F.when(i % 3 != 0, "Room").alias("venue_name"), F.when(i % 5 == 0, "$5").alias("ticket_cost"),
        F.when(i % 3 != 0, F.concat(F.lit("https://l.example.edu/"), i.cast("string"))).alias("localist_url"), F.when(i % 4 != 0, F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))).alias("geo"),
    )
    pages = _pages(feed, request, i % 2, F.lit(1), F.struct(event.alias("event")), lambda rows: F.to_json(F.struct(rows.alias("events"))))
    pages = pages.withColumn("ok", ~((F.col("request_id").cast("long") % 5 == 0) & (F.col("query_no") == 0)))
    own = feed.select(request.cast("string").alias("request_id")).distinct()
    universities = own.select("request_id", F.concat(F.lit("State "), "request_id").alias("name"), F.lit("Campus").alias("address"), F.lit(25.5).alias("lat"), F.lit(-80.5).alias("lng"), F.lit("https://state.example.edu").alias("website"))
    return paged.localist(pages, universities).select("request_id", "source_id", "title", "description", "lat", "lng", "start_time", "end_time", "is_free", "source_url", "address")
