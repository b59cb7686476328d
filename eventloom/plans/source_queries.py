"""Queries of connectors and generators over payloads made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.plans.feed_queries import now_column
from eventloom.plans.views import FEED_SQL, feed_events, sql_text, table
from eventloom.sources import connectors, generators

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _links_sql(more: str) -> str:
    """Links of pages with something appended; the pages' own are all of the form /path."""
    html, a = f"(html || '{more}')", "'(?is)<a[^>]*href=[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>'"
    return f"""links AS (
  SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, unnest(regexp_extract_all({html}, {a}, 1)) AS href, unnest(regexp_extract_all({html}, {a}, 2)) AS label, generate_subscripts(regexp_extract_all({html}, {a}, 1), 1) AS pos FROM pages
), texts AS (SELECT *, lower(href || ' ' || trim(regexp_replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS t FROM links WHERE origin <> '')"""


_POINTS = " + ".join([f"CASE WHEN regexp_matches(regexp_replace(href, '[?#].*$', ''), '{generators.EVENT_PATH}') THEN 6 ELSE 0 END", *[f"CASE WHEN contains(t, {sql_text(w)}) THEN {4 if ' ' in w else 3} ELSE 0 END" for w in generators.LINK_WORDS]])


@query(
    "source_event_pages",
    f"""WITH {_links_sql('<a href="/calendar/">Events calendar</a><a href="/shows">Shows</a>')}, scored AS (SELECT page_id, origin || href AS event_url, pos, {_POINTS} AS score FROM texts WHERE NOT regexp_matches(t, '{"|".join(generators.NO_LINK_WORDS)}'))
SELECT page_id, event_url, CAST(score AS INTEGER) AS score FROM scored WHERE score >= 4 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) = 1""",
)
def source_event_pages(spark, sf_dir):
    """The best event link per page."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit('<a href="/calendar/">Events calendar</a><a href="/shows">Shows</a>')))
    return generators.event_pages(pages)


@query("source_athletics_pages", f"""WITH {_links_sql('<a href="/team/athletics">Teams</a>')} SELECT page_id, arg_min(origin || href, pos) AS athletics_url FROM texts WHERE regexp_matches(t, 'athletic|sports') GROUP BY page_id""")
def source_athletics_pages(spark, sf_dir):
    """G5."""
    pages = table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit('<a href="/team/athletics">Teams</a>')))
    return generators.athletics_pages(pages)


_LD = '<script type="application/ld+json">{"@graph": [{"@type": ["Event"], "name": "Show %d", "startDate": "2024-01-20T19:00:00Z", "image": ["/i.jpg"], "offers": {"price": "12.5"}}]}</script><script type="application/ld+json">{bad</script>'


@query("source_schema_events", "SELECT page_id, 'Show ' || page_id AS title, 12.5::DOUBLE AS price_min, TIMESTAMP '2024-01-20 19:00:00' AS start_time FROM pages WHERE page_id % 3 = 0")
def source_schema_events(spark, sf_dir):
    """Events declared in pages; bad JSON is skipped."""
    pages = table(spark, sf_dir, "pages")
    made = pages.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.format_string(_LD, "page_id"))).otherwise(F.col("html")))
    return generators.schema_events(made).select("page_id", "title", "price_min", "start_time")


@query("source_page_images", "SELECT page_id, 'https://cdn.example.com/a.jpg' AS image_url FROM pages WHERE page_id % 2 = 0")
def source_page_images(spark, sf_dir):
    """G2, X31, X32."""
    meta = '<meta property="og:image" content="https://cdn.example.com/logo.svg"><meta name="twitter:image" content="https://cdn.example.com/a.jpg">'
    pages = table(spark, sf_dir, "pages").withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit(meta))).otherwise(F.col("html")))
    return generators.page_images(pages)


_ICAL = "BEGIN:VCALENDAR\nBEGIN:VEVENT\nSUMMARY:Talk %d\nDTSTART;TZID=UTC:20240120T130000Z\nDESCRIPTION:long\\n li\n ne\nLOCATION:Hall\nEND:VEVENT\nBEGIN:VEVENT\nSUMMARY:no start\nEND:VEVENT\n"


@query("source_ical", "SELECT event_id AS calendar_id, 'Talk ' || event_id AS summary, '20240120T130000Z' AS dtstart, 'long  line' AS description FROM events")
def source_ical(spark, sf_dir):
    """G3, S16."""
    calendars = table(spark, sf_dir, "events").select(F.col("event_id").alias("calendar_id"), F.format_string(_ICAL, "event_id").alias("text"))
    return generators.ical_events(calendars).select("calendar_id", "summary", "dtstart", "description")


@query("source_frames", "SELECT event_id AS run_id, 0 AS pos, 'found' AS event, '{\"id\": ' || event_id || '}' AS data FROM events UNION ALL SELECT event_id, 2, 'done', '{}' FROM events")
def source_frames(spark, sf_dir):
    """Frames of an event stream."""
    logs = table(spark, sf_dir, "events").select(F.col("event_id").alias("run_id"), F.format_string('event: found\ndata: {"id": %d}\n\nevent: bad\ndata: {x\n\nevent: done\ndata: {}\n\n', "event_id").alias("text"))
    return generators.stream_frames(logs)


_TM = '{"_embedded":{"events":[{"id":"t%d","name":"Rock Show","info":"An evening","url":"https://t.example.com","images":[{"url":"s","width":10},{"url":"w","width":90}],"dates":{"start":{"dateTime":"2024-01-20T23:00:00Z"}},"classifications":[{"segment":{"name":"Music"},"genre":{"name":"Rock"}}],"priceRanges":[{"min":0,"max":30}],"_embedded":{"venues":[{"name":"Main Stage","location":{"latitude":"26.3","longitude":"-80.1"},"city":{"name":"Boca"}}]}},{"id":"x","name":"Night at Vixens Cabaret","_embedded":{"venues":[{"name":"Vixens Cabaret","location":{"latitude":"26.3","longitude":"-80.1"}}]}}]}}'


@query("source_ticketmaster", "SELECT 't' || event_id AS source_id, 'music' AS category, 'rock' AS subcategory, 26.3::DOUBLE AS lat, 'Boca' AS address, 'w' AS image_url, NULL::DOUBLE AS price_min, 30.0::DOUBLE AS price_max, 'live-music,late-night,ticketed' AS tags FROM events")
def source_ticketmaster(spark, sf_dir):
    """Nested payloads, adult guard, widest image, a price of 0 as none."""
    payloads = table(spark, sf_dir, "events").select(F.format_string(_TM, "event_id").alias("payload"))
    return connectors.ticketmaster(payloads).select("source_id", "category", "subcategory", "lat", "address", "image_url", "price_min", "price_max", F.array_join("tags", ",").alias("tags"))


_ES = '{"events":[{"id":"%d","name":"","date":"2024-01-20T19:00:00Z","competitions":[{"venue":{"fullName":"Arena","address":{"city":"C","state":"GA"}},"competitors":[{"homeAway":"home","team":{"displayName":"Owls"}},{"homeAway":"away","team":{"displayName":"Gators"}}]}]},{"id":"9","date":"2024-01-20T19:00:00Z","competitions":[{"venue":{"fullName":"Far","address":{"city":"C","state":"WA"}}}]}]}'


@query("source_espn", "SELECT 'espn-ncaa-' || event_id AS source_id, 'Gators at Owls' AS title, 'Gators travels to Arena to face Owls. NCAA basketball.' AS description FROM events")
def source_espn(spark, sf_dir):
    """S14, F21, J14."""
    payloads = table(spark, sf_dir, "events").select(F.lit("ncaa").alias("league"), F.lit("basketball").alias("subcategory"), F.format_string(_ES, "event_id").alias("payload"))
    return connectors.espn(payloads, "FL", now_column()).select("source_id", "title", "description")


@query("source_places", "SELECT 'p' || user_id AS google_place_id, 'bar' AS category, 2 AS price_level FROM (SELECT DISTINCT user_id FROM events)")
def source_places(spark, sf_dir):
    """The first of repeated places, adult types dropped."""
    form = '{"places":[{"id":"p%d","displayName":{"text":"Corner Pub"},"location":{"latitude":26.3,"longitude":-80.1},"types":["bar"],"priceLevel":"PRICE_LEVEL_MODERATE"},{"id":"a%d","displayName":{"text":"X"},"types":["strip_club"]}]}'
    payloads = table(spark, sf_dir, "events").select(F.col("event_id").alias("type_no"), F.format_string(form, "user_id", "user_id").alias("payload"))
    return connectors.places(payloads).select("google_place_id", "category", "price_level")


_ONE = '{"title": "Pickup Game %d", "description": "Open play for all levels at the courts", "start_time": "2024-01-20T19:00:00Z"}'


@query("source_model_listings", "SELECT 'rd-o' || event_id || '-pickup-game-' || event_id AS source_id, 26.3::DOUBLE AS lat FROM events")
def source_model_listings(spark, sf_dir):
    """JSON within text, gates, coordinates of the request."""
    outputs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("o"), "event_id").alias("origin"), F.lit(26.3).alias("lat"), F.lit(-80.1).alias("lng"), F.format_string('Here: [' + _ONE + ', {"title": "Open"}] done', "event_id").alias("output")
    )
    return connectors.model_listings(outputs, "reddit", "rd").select("source_id", "lat")


@query("source_forums", f"WITH {FEED_SQL} SELECT id, 'pickleball,PickupBasketball,RunningClub,Volleyball,tennis' || CASE WHEN lat > 25.7 AND lat < 26.8 AND lng > -80.5 AND lng < -79.8 THEN ',BocaRaton,southflorida,florida,FAU,Miami,MiamiHurricanes' ELSE '' END AS forums FROM feed")
def source_forums(spark, sf_dir):
    """X66."""
    return feed_events(spark, sf_dir).select("id", F.array_join(connectors.forums(F.col("lat"), F.col("lng")), ",").alias("forums"))

