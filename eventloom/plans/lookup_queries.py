"""Queries of lookups, exact counts, what a map lists, forum posts, ranking answers and attributes, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import text
from eventloom.operators import feed, telemetry
from eventloom.plans.feed_queries import TS, now_column
from eventloom.plans.views import FEED_SQL, ORIGIN, feed_events, pick, sql_pick, table
from eventloom.sources import connectors

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


@query(
    "feed_lookup",
    f"""WITH {FEED_SQL}, asked AS (SELECT id // 150 AS request_id, id * 7 % 1009 AS id, row_number() OVER (PARTITION BY id // 150 ORDER BY id) AS nth FROM feed)
SELECT DISTINCT a.request_id, f.id, title, category, start_time FROM asked a JOIN feed f USING (id) WHERE nth <= 60""",
)
def feed_lookup(spark, sf_dir):
    """S3: the events of each request's first sixty ids."""
    own, i = feed_events(spark, sf_dir), F.col("id")
    rows = own.groupBy(F.floor(i / 150).alias("request_id")).agg(F.array_sort(F.collect_list("id")).alias("all"))
    requests = rows.select("request_id", F.transform("all", lambda x: x * 7 % 1009).alias("ids"))
    return feed.looked_up(own, requests).select("request_id", "id", "title", "category", "start_time")


_CALLS_SQL = f"SELECT 'c' || user_id AS client_id, CASE WHEN event_id % 5 = 0 THEN 'rank' ELSE 'sync' END AS endpoint, {TS} - to_minutes(event_id % 75) AS called_at FROM events"


@query(
    "telemetry_calls_left",
    f"WITH calls AS ({_CALLS_SQL}), used AS (SELECT client_id, count(*) AS used FROM calls WHERE endpoint = 'sync' AND called_at >= {TS} - INTERVAL 60 MINUTE GROUP BY client_id) SELECT *, used < 10 AS allowed, CASE WHEN used < 10 THEN 10 - used - 1 ELSE 0 END AS remaining FROM used",
)
def telemetry_calls_left(spark, sf_dir):
    """An exact count of a client's calls, without their rows."""
    i = F.col("event_id")
    at = now_column() - F.make_dt_interval(F.lit(0), F.lit(0), (i % 75).cast("int"))
    calls = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"), F.when(i % 5 == 0, "rank").otherwise("sync").alias("endpoint"), at.alias("called_at"))
    return telemetry.calls_left(calls, now_column(), "sync")


@query(
    "feed_in_view",
    f"""WITH {FEED_SQL} SELECT 'cluster' AS shown, id FROM feed WHERE id IN (SELECT id FROM feed WHERE source = 'meetup' AND category = 'music')
UNION ALL SELECT 'window', id FROM feed WHERE abs(lat - {ORIGIN[0]}::DOUBLE) < 0.15 AND abs(lng - {ORIGIN[1]}::DOUBLE) < 0.1 UNION ALL SELECT 'all', id FROM feed""",
)
def feed_in_view(spark, sf_dir):
    """an opened cluster before the map's window, and all without either."""
    own = feed_events(spark, sf_dir)
    cluster = own.filter("source = 'meetup' AND category = 'music'").select("id")
    views = {"cluster": feed.in_view(own, ORIGIN, (0.3, 0.2), cluster), "window": feed.in_view(own, ORIGIN, (0.3, 0.2)), "all": feed.in_view(own)}
    parts = [df.select(F.lit(name).alias("shown"), "id") for name, df in views.items()]
    return parts[0].union(parts[1]).union(parts[2])


_SUBS = ["pickleball", "PickupBasketball", "RunningClub"]


@query(
    "source_forum_texts",
    f"""WITH {FEED_SQL}, posts AS (SELECT id // 120 AS request_id, {sql_pick(_SUBS, "id")} AS sub, id, title, repeat(coalesce(description, ''), 6) AS body, row_number() OVER (PARTITION BY id // 120, id % 3 ORDER BY id) AS nth FROM feed WHERE id // 120 % 8 <> 5 OR id % 120 < 3),
shown AS (SELECT * FROM posts WHERE nth <= 15 AND sub <> 'RunningClub')
SELECT request_id, sub, CAST(count(*) AS INTEGER) AS n_posts, string_agg('TITLE: ' || title || chr(10) || 'BODY: ' || left(body, 500) || chr(10) || 'URL: https://reddit.com/r/' || id, chr(10) || '---' || chr(10) ORDER BY nth) AS text FROM shown GROUP BY ALL HAVING length(text) >= 100""",
)
def source_forum_texts(spark, sf_dir):
    """The first two forums of a place, fifteen posts of each, bodies cut."""
    own, i = feed_events(spark, sf_dir), F.col("id")
    request = F.floor(i / 120)
    posts = own.filter((request % 8 != 5) | (i % 120 < 3)).select(
        request.alias("request_id"), pick(_SUBS, i).alias("sub"), i.alias("pos"), "title", F.repeat(F.coalesce("description", F.lit("")), 6).alias("selftext"), F.concat(F.lit("/r/"), i.cast("string")).alias("permalink")
    )
    requests = own.select(request.alias("request_id")).distinct().select("request_id", F.lit(ORIGIN[0]).alias("lat"), F.lit(ORIGIN[1]).alias("lng"))
    return connectors.forum_texts(requests, posts)


@query(
    "source_ranked_rows",
    f"""WITH {FEED_SQL} SELECT id AS run_id, 'e' || id AS event_id, CASE WHEN id % 4 = 0 THEN 7.0::DOUBLE ELSE id % 100 / 8.0::DOUBLE END AS rank_score, CASE WHEN id % 3 = 0 THEN '' ELSE left(repeat(title || ' ', 5), 80) END AS blurb
FROM feed WHERE id % 7 <> 0""",
)
def source_ranked_rows(spark, sf_dir):
    """Answers of a ranking model: strict JSON, typed entries, blurbs cut."""
    i = F.col("id")
    score = F.when(i % 4 == 0, "7").otherwise((i % 100 / F.lit(8.0)).cast("string"))
    blurb = F.when(i % 3 == 0, "null").otherwise(F.concat(F.lit('"'), F.repeat(F.concat("title", F.lit(" ")), 5), F.lit('"')))
    entry = F.concat(F.lit('{"event_id": "e'), i.cast("string"), F.lit('", "rank_score": '), score, F.lit(', "blurb": '), blurb, F.lit("}"))
    bad = F.lit(', {"event_id": 5, "rank_score": 1}, {"event_id": "x", "rank_score": "9"}, {"rank_score": 2}, "text", null')
    whole = F.concat(F.lit("["), entry, bad, F.lit("]"))
    outputs = feed_events(spark, sf_dir).select(i.alias("run_id"), F.when(i % 7 == 0, F.concat(F.lit("Here: "), whole)).otherwise(whole).alias("output"))
    return connectors.ranked_rows(outputs)


_ATTR = r"""([\w:-]+)\s*=\s*["'']([^"'']*)["'']"""
_DECODED = "list_transform(regexp_extract_all(tag, '" + _ATTR + "', 2), lambda v: trim(" + "regexp_replace(" * len(text.ATTRIBUTE_ENTITIES) + "v" + "".join(f", '{e}', '{c.replace(chr(39), chr(39) * 2)}', 'gi')" for e, c in text.ATTRIBUTE_ENTITIES) + "))"


@query(
    "page_attributes",
    f"""WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '<[a-zA-Z][^>]*>'), 1) - 1 AS pos FROM (SELECT page_id, html || '<a HREF="/x?a=1&amp;b=2" title= ''one'' Title="two &QUOT;" data-n="&lt;' || page_id || '&gt; ">' AS html FROM pages)),
found AS (SELECT page_id, pos, unnest(list_transform(regexp_extract_all(tag, '{_ATTR}', 1), lambda n: lower(n))) AS name, unnest({_DECODED}) AS value, generate_subscripts(regexp_extract_all(tag, '{_ATTR}', 1), 1) AS nth FROM tags)
SELECT page_id, pos, name, value FROM found QUALIFY row_number() OVER (PARTITION BY page_id, pos, name ORDER BY nth DESC) = 1""",
)
def page_attributes(spark, sf_dir):
    """The attributes of every tag of a page, five entities decoded, the last of repeated names."""
    more = F.concat(F.lit("<a HREF=\"/x?a=1&amp;b=2\" title= 'one' Title=\"two &QUOT;\" data-n=\"&lt;"), F.col("page_id").cast("string"), F.lit('&gt; ">'))
    html = F.concat("html", more)
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit("<[a-zA-Z][^>]*>"), F.lit(0))).alias("pos", "tag"))
    return tags.select("page_id", F.col("pos").cast("long").alias("pos"), F.explode(text.attributes(F.col("tag"))).alias("name", "value"))
