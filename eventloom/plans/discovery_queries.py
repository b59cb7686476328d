"""Queries of discovery runs made from the feed: every 25 events in order are the frames of one run."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import discovery
from eventloom.plans.feed_queries import TS, now_column
from eventloom.plans.views import FEED_SQL, ORIGIN, feed_events, pick, sql_pick

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_PAGES = ["https://www.eventbrite.com:443/e/", "https://Tickets.example.com:8443/t/", "https://meetup.com/g/", "https://unknown.example.com/", "http://x.example.com/"]
_RESULTS = ["results: HTTPS://WWW.EVENTBRITE.COM/e/1 and tickets.example.com", "tickets.example.com:8443/t, meetup.com"]
_MILES = 12.0


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _tables(spark, sf_dir):
    """Frames, runs and fetched pages of the feed."""
    i = F.col("id")
    nth, run = i % 25, F.floor(i / 25)
    own = feed_events(spark, sf_dir).withColumns({"page": F.concat(pick(_PAGES, i), i.cast("string")), "run_id": F.concat(F.lit("run-"), run.cast("string"))})
    kind = F.when(nth.isin(0, 9), "web_search").when(nth == 1, "usage").when(nth == 2, "note").otherwise("emit_event")
    event = F.struct(
        F.when(i % 29 != 0, F.col("title")).alias("title"), F.lit("Hall").alias("venue_name"), "address", "lat", "lng", F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_iso"),
        F.when(i % 43 == 0, "bowling").otherwise(F.col("category")).alias("category"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.when(i % 47 == 0, -1.0).otherwise(F.col("price_min")).alias("price_min"),
        "is_free", F.col("page").alias("source_url"), F.coalesce("description", F.lit("A show.")).alias("description"),
    )
    usage = F.to_json(F.struct(i.alias("input_tokens"), (i % 300).alias("output_tokens"), F.when(i % 2 == 0, i % 50).alias("cache_read_input_tokens")))
    payload = F.when(kind == "web_search", F.when(nth == 0, pick(_RESULTS, run)).otherwise(_RESULTS[1])).when(kind == "usage", usage).when(i % 31 == 0, "no json").otherwise(F.to_json(event))
    at = now_column() + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (nth * 4).cast("decimal(18,6)"))
    frames = own.select("run_id", i.alias("pos"), at.alias("at"), kind.alias("kind"), payload.alias("payload"))
    runs = own.select("run_id").distinct().select("run_id", now_column().alias("started_at"), F.lit(ORIGIN[0]).alias("lat"), F.lit(ORIGIN[1]).alias("lng"), F.lit(_MILES).alias("miles"))
    status = pick([200, 301, 405, 404, 200], i)
    html = F.concat(F.lit("<p>Trivia and brews in the "), F.when(i % 11 == 0, "room, ").otherwise("hall, "), F.when(i % 13 == 0, "soon").otherwise(F.date_format("start_time", "yyyy-MM-dd")), F.lit("</p>"))
    fetched = own.select(F.col("page").alias("source_url"), status.alias("http_status"), F.when(i % 2 == 0, 206).otherwise(500).alias("ranged_status"), html.alias("html"))
    return frames, runs, fetched


_MILES_SQL = f"2 * 3958.8 * asin(sqrt(least(1, pow(sin(radians(lat - {ORIGIN[0]}::DOUBLE) / 2), 2) + cos(radians({ORIGIN[0]}::DOUBLE)) * cos(radians(lat)) * pow(sin(radians(lng - {ORIGIN[1]}::DOUBLE) / 2), 2))))"
_FRAMES_SQL = f"""{FEED_SQL}, frames AS (
  SELECT *, id % 25 AS nth, id // 25 AS run, {TS} + to_seconds((id % 25) * 4) AS seen_at, {sql_pick(_PAGES, "id")} || CAST(id AS VARCHAR) AS page,
    CASE WHEN id % 25 IN (0, 9) THEN 'web_search' WHEN id % 25 = 1 THEN 'usage' WHEN id % 25 = 2 THEN 'note' ELSE 'emit_event' END AS kind
  FROM feed WHERE (id % 25) * 4 <= 90
), emit AS (
  SELECT id, run, nth, seen_at, page, start_time, lat, lng, id % 31 <> 0 AS valid, CASE WHEN id % 29 <> 0 THEN title END AS title, address, CASE WHEN id % 43 = 0 THEN 'bowling' ELSE category END AS category,
    CASE WHEN id % 47 = 0 THEN -1.0::DOUBLE ELSE price_min END AS price_min, is_free, coalesce(description, 'A show.') AS description,
    ['www.eventbrite.com', 'tickets.example.com:8443', 'meetup.com', 'unknown.example.com', 'x.example.com'][1 + id % 5] AS host,
    [200, 301, CASE WHEN id % 2 = 0 THEN 206 ELSE 500 END, 404, 200][1 + id % 5] AS status,
    'trivia and brews in the ' || CASE WHEN id % 11 = 0 THEN 'room, ' ELSE 'hall, ' END || CASE WHEN id % 13 = 0 THEN 'soon' ELSE strftime(start_time, '%Y-%m-%d') END AS shown,
    regexp_extract_all(lower(title), '[a-z][a-z''-]{{2,}}') AS words
  FROM frames WHERE kind = 'emit_event'
), judged AS (
  SELECT *, CASE WHEN NOT valid OR title IS NULL OR length(title) NOT BETWEEN 1 AND 200 THEN 'title' WHEN start_time < seen_at - INTERVAL 6 HOUR THEN 'start_iso past' WHEN start_time > seen_at + INTERVAL 60 DAY THEN 'start_iso future'
      WHEN category = 'bowling' THEN 'category' WHEN price_min < 0 THEN 'price_min' WHEN page LIKE 'http://%' THEN 'source_url' END AS detail,
    contains(lower('{_RESULTS[0]}') , host) AND run % 2 = 0 OR contains('{_RESULTS[1]}', host) AND (run % 2 = 1 OR nth > 9) AS grounded,
    len(list_filter(words, lambda x: contains(shown, x))) >= 3 OR (len(words) < 3 AND len(list_filter(words, lambda x: contains(shown, x))) = len(words)) OR contains(shown, 'hall') AS named, id % 13 <> 0 AS dated
  FROM emit
), verdicts AS (
  SELECT *, CASE WHEN detail IS NOT NULL THEN 'schema' WHEN NOT grounded THEN 'grounding' WHEN status NOT BETWEEN 200 AND 399 THEN 'head' WHEN NOT (named AND dated) THEN 'content' WHEN NOT {_MILES_SQL} <= {_MILES}::DOUBLE * 1.2::DOUBLE THEN 'geo' END AS reason FROM judged
)"""


@query("discovery_accepted", f"WITH {_FRAMES_SQL} SELECT 'run-' || run AS run_id, id AS pos, 'claude' AS source, sha1(page) AS source_id, title, category, lat, lng, address, date_trunc('second', start_time) AS start_time, is_free, price_min, page AS source_url, description FROM verdicts WHERE reason IS NULL")
def discovery_accepted(spark, sf_dir):
    """Events that passed all gates of their run."""
    found = discovery.discover(*_tables(spark, sf_dir)).accepted
    return found.select("run_id", "pos", "source", "source_id", "title", "category", "lat", "lng", "address", "start_time", "is_free", "price_min", "source_url", "description")


@query("discovery_rejected", f"WITH {_FRAMES_SQL} SELECT 'run-' || run AS run_id, id AS pos, reason, CASE WHEN valid THEN title END AS title, CASE WHEN valid THEN page END AS source_url, detail FROM verdicts WHERE reason IS NOT NULL")
def discovery_rejected(spark, sf_dir):
    """The others, with the first gate that failed."""
    return discovery.discover(*_tables(spark, sf_dir)).rejected


@query(
    "discovery_metrics",
    f"""WITH {_FRAMES_SQL}, sums AS (
  SELECT f.run, count(*) FILTER (kind = 'emit_event') AS events_emitted, count(*) FILTER (kind = 'emit_event' AND reason IS NULL) AS events_persisted, count(reason) AS events_rejected, count(*) FILTER (kind = 'web_search') AS web_searches,
    CAST(sum(CASE WHEN kind = 'usage' THEN f.id ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN kind = 'usage' THEN f.id % 300 ELSE 0 END) AS BIGINT) AS output_tokens,
    CAST(sum(CASE WHEN kind = 'usage' AND f.id % 2 = 0 THEN f.id % 50 ELSE 0 END) AS BIGINT) AS cached_input_tokens, 0 AS errors
  FROM frames f LEFT JOIN verdicts v USING (id) GROUP BY f.run)
SELECT 'run-' || run AS run_id, * EXCLUDE (run, errors), CAST(errors AS BIGINT) AS errors, round((input_tokens * 3.0::DOUBLE + cached_input_tokens * 0.3::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000 + web_searches * 0.01::DOUBLE, 8) AS cost_usd FROM sums""",
)
def discovery_metrics(spark, sf_dir):
    """What each run emitted, kept, rejected, searched and cost."""
    return discovery.run_metrics(discovery.discover(*_tables(spark, sf_dir)).metrics).withColumn("cost_usd", F.round("cost_usd", 8))
