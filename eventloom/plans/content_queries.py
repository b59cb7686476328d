"""Queries of text, classification, gates and geography, each with DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from eventloom.functions import classify as cl
from eventloom.functions import geo, score, text
from eventloom.operators import feed, resolve, spatial, validate
from eventloom.plans.feed_queries import TS, _haversine, now_column
from eventloom.sources.tables import keep
from eventloom.plans.views import FEED_SQL, ORIGIN, VENUES_SQL, feed_events, pick, sql_pick, table, venues

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _rx(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', '{flags}')"


def _chain(x: str, *steps: tuple[str, str, str]) -> str:
    for pattern, by, flags in steps:
        x = _rx(x, pattern, by, flags)
    return x


def _norm(x: str) -> str:
    return "trim(" + _chain(f"lower({x})", ("&", " and ", "g"), (r"[^A-Za-z0-9_\s]", " ", "g"), (r"\s+", " ", "g")) + ")"


_TAGS = "coalesce(tags, [])"


@query(
    "text_labels",
    f"""
WITH {FEED_SQL}, far AS (SELECT *, {_haversine(str(ORIGIN[0]), str(ORIGIN[1]))} AS d,
  nullif(lower(regexp_extract(source_url, '^https?://(?:[^/?#@]*@)?([^/?#:\\s]+)', 1)), '') AS h, list_filter({_TAGS}, lambda t: t IN ('free', 'active', 'social'))[1:2] AS m FROM feed)
SELECT id, {_norm("title")} AS normal, {_norm("split_part(address, ',', 1)")} AS place,
  left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 20) AS slug, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS trimmed_slug,
  'meetup-' || left(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 40) || '-' || strftime(start_time, '%Y%m%d') AS made_id, sha1(coalesce(source_url, '')) AS url_sha1,
  CASE WHEN source = 'scraped' THEN coalesce(regexp_replace(h, '^www\\.', ''), 'source') ELSE CASE source {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SOURCE_NAMES.items())} END END AS source_name,
  CASE source {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.SOURCE_LABELS.items())} END AS source_label,
  CASE WHEN d < 0.1 THEN 'Right here' WHEN d < 1 THEN printf('%.0f', floor(d * 5280 + 0.5)) || ' ft' ELSE printf('%.1f', floor(d * 10 + 0.5) / 10.0::DOUBLE) || ' mi' END AS distance_label,
  CASE WHEN is_free THEN 'Free' WHEN price_min IS NOT NULL AND price_max IS NOT NULL AND price_max > price_min THEN '$' || CAST(price_min AS BIGINT) || '–$' || CAST(price_max AS BIGINT)
    WHEN price_min IS NOT NULL THEN '$' || CAST(price_min AS BIGINT) || '+' END AS price_label,
  CASE WHEN category IN ('food', 'music') OR len(m) > 0 OR is_free OR source = 'claude' THEN 'Matches you on: ' || array_to_string(list_filter([
      CASE WHEN category IN ('food', 'music') THEN 'matches your ' || CASE category WHEN 'food' THEN 'food & drink' ELSE 'music' END || ' interest' END, CASE WHEN len(m) > 0 THEN 'tagged ' || array_to_string(list_transform(m, lambda t: CASE t WHEN 'free' THEN 'Free' WHEN 'active' THEN 'Active' ELSE t END), ' + ') END,
      CASE WHEN is_free THEN 'free entry' END, CASE WHEN source = 'claude' THEN 'hand-picked by your AI' END], lambda x: x IS NOT NULL), ', ') || '.'
    ELSE 'Showing because it''s nearby and on your radar.' END AS why
FROM far
""",
)
def text_labels(spark, sf_dir):
    """X20, X21, X29, X30, X33-X37, X45, X63."""
    own = feed_events(spark, sf_dir).withColumn("d", geo.haversine_miles(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lat"), F.col("lng")))
    return own.select(
        "id", text.normalized(F.col("title")).alias("normal"), text.venue_word(F.col("address")).alias("place"), text.slug(F.col("title"), 20).alias("slug"),
        text.slug(F.col("title"), 50, trim=True).alias("trimmed_slug"), text.source_id("meetup", text.slug(F.col("title"), 40), F.date_format("start_time", "yyyyMMdd")).alias("made_id"),
        F.sha1(score.text_or_empty("source_url").cast("binary")).alias("url_sha1"), text.source_name(F.col("source"), F.col("source_url")).alias("source_name"),
        text.source_label(F.col("source")).alias("source_label"), text.distance_label(F.col("d")).alias("distance_label"),
        text.price_label(F.col("is_free"), F.col("price_min"), F.col("price_max")).alias("price_label"),
        text.why_this(F.lit(None).cast("string"), F.col("category"), score.tags(), F.col("is_free"), F.col("source"), ["food", "music"], ["free", "active", "social"]).alias("why"),
    )


_DROP = [("<script.*?</script>", "", "gis"), ("<style.*?</style>", "", "gis")]
_CLEAN = [*_DROP, (r"\[caption.*?\[/caption\]", "", "gis"), (r"\[/?[A-Za-z0-9_]+[^\]]*\]", "", "g"), ("<[^>]+>", " ", "g"), ("&nbsp;", " ", "gi"), ("&amp;", "&", "gi"), ("&lt;", "<", "gi"), ("&gt;", ">", "gi"), ("&quot;", '"', "gi"), ("&#?[A-Za-z0-9_]+;", "", "g"), (r"https?://\S+", "", "g"), (r"\s+", " ", "g")]
_PAGE = [*_DROP, ("<noscript.*?</noscript>", "", "gis"), ("<[^>]+>", " ", "g"), ("&nbsp;", " ", "gi"), ("&amp;", "&", "gi"), ("&quot;", '"', "gi"), ("&#?[A-Za-z0-9_]+;", " ", "g"), (r"\s+", " ", "g")]
_NO_TAGS = [("<script[^>]*>.*?</script>", " ", "gis"), ("<style[^>]*>.*?</style>", " ", "gis"), ("<[^>]+>", " ", "g"), (r"\s+", " ", "g")]


@query(
    "text_pages",
    f"""
WITH c AS (SELECT page_id, html, trim({_chain("html", *_CLEAN)}) AS t FROM pages)
SELECT page_id, CASE WHEN t <> '' THEN CASE WHEN length(t) <= 500 THEN t ELSE trim(left(t, 500)) || '…' END END AS cleaned, left(trim({_chain("html", *_PAGE)}), 9000) AS page_text, {_chain("html", *_NO_TAGS)} AS untagged FROM c
""",
)
def text_pages(spark, sf_dir):
    """X25-X27 over raw pages."""
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(html).alias("cleaned"), text.page_text(html).alias("page_text"), text.without_tags(html).alias("untagged"))


def _kw(kind: str) -> str:
    return "|".join(re.escape(k) for k in cl.KEYWORDS[kind]).replace("\\ ", " ").replace("'", "''")


def _has(kind: str) -> str:
    return f"regexp_matches(low, '\\b(?:{_kw(kind)})\\b')"


@query(
    "classify_tags",
    f"""
WITH {FEED_SQL}, {VENUES_SQL}, t AS (
  SELECT f.id, f.category, f.is_free, f.ticket_url, coalesce(v.category, '') AS place, hour(start_time) AS hr, lower(title || ' ' || coalesce(description, '') || ' ' || coalesce(subcategory, '')) AS low
  FROM feed f LEFT JOIN venues v ON f.venue_id = v.id
), k AS (
  SELECT *, place IN ('bar', 'club') OR category = 'nightlife' AS bar, {_has("family")} AS fam, {_has("singles")} AS sing FROM t
), n AS (SELECT *, bar OR contains(low, '21+') AS of_age, fam OR category = 'community' AS all_ages FROM k)
SELECT id, array_to_string(list_filter([
  CASE WHEN of_age THEN '21+' WHEN contains(low, '18+') THEN '18+' END, CASE WHEN all_ages THEN 'all-ages' END, CASE WHEN all_ages THEN 'family' END,
  CASE WHEN bar OR {_has("drinking")} THEN 'drinking' END, CASE WHEN category = 'music' OR {_has("music")} THEN 'live-music' END,
  CASE WHEN place = 'park' OR category = 'outdoors' OR {_has("outdoor")} THEN 'outdoor' END, CASE WHEN category = 'food' OR place = 'restaurant' OR {_has("food")} THEN 'food' END,
  CASE WHEN category IN ('sports', 'fitness') OR {_has("active")} THEN 'active' END, CASE WHEN is_free THEN 'free' END, CASE WHEN sing THEN 'singles' END, CASE WHEN sing THEN 'date-night' END,
  CASE WHEN sing AND NOT of_age AND NOT contains(low, '18+') AND NOT all_ages THEN '21+' END,
  CASE WHEN NOT sing AND (category IN ('nightlife', 'arts') OR {_has("date")} OR (category = 'food' AND NOT fam)) THEN 'date-night' END,
  CASE WHEN hr >= 22 OR hr < 4 THEN 'late-night' WHEN hr < 17 THEN 'daytime' END, CASE WHEN ticket_url IS NOT NULL AND NOT is_free THEN 'ticketed' END], lambda x: x IS NOT NULL), ',') AS tags
FROM n
""",
)
def classify_tags(spark, sf_dir):
    """Twelve tag rules with the joined venue category."""
    own = feed_events(spark, sf_dir).join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("category").alias("place")), "venue_id", "left")
    tags = cl.generate_tags(F.col("title"), F.col("description"), F.col("subcategory"), F.col("category"), F.col("is_free"), F.hour("start_time"), F.col("ticket_url"), F.col("place"))
    return own.select("id", F.array_join(tags, ",").alias("tags"))


def _any_language(x: str) -> str:
    return "(" + " OR ".join("regexp_matches({}, '{}', 'i')".format(x, p.replace("'", "''")) for p in cl.ADULT_PATTERNS) + ")"


_BRANDS = "|".join(re.escape(n).replace("\\ ", " ") for n in cl.ADULT_NAMES).replace("'", "''")


def _first_brand(x: str) -> str:
    q = lambda n: n.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '\\b{q(n)}\\b', 'i') THEN '{q(n)}'" for n in cl.ADULT_NAMES) + " END"


_THEATRES = ", ".join(f"'{n}'" for n in cl.CABARET_THEATRES)


@query(
    "classify_adult",
    f"""
WITH {FEED_SQL}, {VENUES_SQL}, t AS (
  SELECT f.id, title, coalesce(description, '') AS d, coalesce(v.name, '') AS vn, lower(trim(regexp_extract(title, '(?i)\\bat\\s+([a-z''\\s]+\\s+cabaret)\\b', 1))) AS phrase
  FROM feed f LEFT JOIN venues v ON f.venue_id = v.id
), a AS (
  SELECT *, regexp_matches(vn, '\\b(?:{_BRANDS})\\b', 'i') OR {_any_language("vn")} OR (regexp_matches(vn, '\\b[a-z]{{3,}}\\s+cabaret\\b', 'i') AND lower(trim(vn)) NOT IN ({_THEATRES})) AS adult_venue, {_first_brand("title")} AS brand FROM t
)
SELECT id, adult_venue, CASE WHEN adult_venue THEN 'adult venue: ' || vn WHEN {_any_language("title || ' ' || d")} THEN 'hard adult pattern in title/desc'
  WHEN brand IS NOT NULL THEN 'adult brand in title: ' || brand WHEN phrase <> '' AND phrase NOT IN ({_THEATRES}) THEN 'cabaret venue in title: ' || phrase END AS reason FROM a
""",
)
def classify_adult(spark, sf_dir):
    """F29, F30."""
    own = feed_events(spark, sf_dir).join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("place")), "venue_id", "left")
    return own.select("id", cl.is_adult_venue(F.col("place")).alias("adult_venue"), cl.adult_reason(F.col("title"), F.col("description"), F.col("place")).alias("reason"))


_GENERIC = " OR ".join(f"regexp_matches(t, '{p}', 'i')" for p in cl.GENERIC_TITLES)
_NIGHTS = ", ".join(f"'{n}'" for n in cl.GOOD_NIGHTS)


@query(
    "gate_scraped",
    f"""
WITH {FEED_SQL}, {VENUES_SQL}, x AS (SELECT f.id, trim(title) AS t, trim(coalesce(description, '')) AS d, coalesce(v.name, '') AS vn FROM feed f LEFT JOIN venues v ON f.venue_id = v.id),
y AS (SELECT *, trim(regexp_replace(d, '^\\s*(recurring|weekly|nightly|special)\\s+event\\.?\\s*$', '', 'i')) AS said FROM x)
SELECT id, CASE WHEN t = '' THEN 'empty title' WHEN length(t) < 6 THEN 'title too short: "' || t || '"' WHEN vn <> '' AND lower(t) = lower(vn) THEN 'title is just the venue name'
  WHEN lower(t) NOT IN ({_NIGHTS}) AND ({_GENERIC}) THEN 'generic title: "' || t || '"' WHEN length(said) < 24 THEN 'description too short: "' || CASE WHEN said <> '' THEN said ELSE d END || '"' END AS reason FROM y
""",
)
def gate_scraped(spark, sf_dir):
    """F28, X39."""
    own = feed_events(spark, sf_dir).join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("place")), "venue_id", "left")
    return own.select("id", cl.scraped_reason(F.col("title"), F.col("description"), F.col("place")).alias("reason"))


_SIGNAL = " + ".join(f"CASE WHEN contains(low, '{s}') THEN {2 if ' ' in s else 1} ELSE 0 END" for s in cl.LOCAL_SIGNALS)


@query(
    "gate_local_signal",
    f"""
WITH t AS (SELECT page_id, lower(left(trim({_chain("html", *_PAGE)}), 9000)) || ' live music every friday 7 pm' AS low FROM pages)
SELECT page_id, {_SIGNAL} + CASE WHEN regexp_matches(low, '\\b(?:mon|tue|wed|thu|fri|sat|sun)(?:day)?s?\\b') AND regexp_matches(low, '\\b(?:am|pm)\\b') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(low, '\\b\\d{{1,2}}/\\d{{1,2}}\\b') OR regexp_matches(low, '\\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\\s+\\d{{1,2}}\\b') THEN 2 ELSE 0 END AS points FROM t
""",
)
def gate_local_signal(spark, sf_dir):
    """F31."""
    own = F.concat(text.page_text(F.col("html")), F.lit(" live music every friday 7 pm"))
    return table(spark, sf_dir, "pages").select("page_id", cl.local_signal(own).alias("points"))


def _ladder(low: str, rules, other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({low}, '\\b(?:{p})\\b') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"


_TYPES = [["bar", "restaurant"], ["restaurant"], ["movie_theater"], ["amusement_park", "gym"], ["concert_hall"], ["shop"]]


@query(
    "classify_categories",
    f"""
WITH {FEED_SQL}, t AS (SELECT id, lower(title || ' ' || coalesce(description, '')) AS low, lower(title || ' ' || coalesce(description, '') || ' ' || array_to_string({_TAGS}, ' ')) AS low_tags,
  {sql_pick(["Music", "Sports", "Arts & Theatre", "Film", "Other", None], "id")} AS seg, {sql_pick(["Rock", "", "Stand-up Comedy"], "id")} AS genre, {sql_pick(["concert", "nba_playoffs", "broadway", "comedy show", "festival", "other"], "id")} AS kind, id FROM feed)
SELECT id, {_ladder("low_tags", cl.CATEGORY_RULES, "community")} AS category, {_ladder("low", cl.SUBCATEGORY_RULES, "event")} AS subcategory,
  CASE WHEN seg = 'Music' THEN 'music/' || coalesce(nullif(lower(genre), ''), 'concert') WHEN seg = 'Sports' THEN 'sports/' || coalesce(nullif(lower(genre), ''), 'sports_event')
    WHEN seg = 'Arts & Theatre' THEN 'arts/' || coalesce(nullif(lower(genre), ''), 'theater') WHEN seg = 'Film' THEN 'movies/screening' WHEN contains(lower(genre), 'comedy') THEN 'nightlife/comedy'
    ELSE 'community/' || coalesce(nullif(lower(genre), ''), 'event') END AS ticketing,
  ['music/concert', 'sports/nba_playoffs', 'arts/theater', 'nightlife/comedy', 'community/festival', 'community/other'][1 + id % 6] AS seats,
  ['bar', 'restaurant', 'cinema', 'park', 'venue', 'other'][1 + id % 6] AS place, CASE id % 6 WHEN 5 THEN NULL ELSE id % 6 END AS price_level
FROM t
""",
)
def classify_categories(spark, sf_dir):
    """X47-X51."""
    i = F.col("id")
    joined = lambda s: F.concat(s["category"], F.lit("/"), s["subcategory"])
    types = F.get(F.array(*[F.array(*map(F.lit, t)) for t in _TYPES]), (i % 6).cast("int"))
    return feed_events(spark, sf_dir).select(
        "id", cl.category_of(F.col("title"), F.col("description"), score.tags()).alias("category"), cl.subcategory_of(F.col("title"), F.col("description")).alias("subcategory"),
        joined(cl.ticket_category(pick(["Music", "Sports", "Arts & Theatre", "Film", "Other", None], i), pick(["Rock", "", "Stand-up Comedy"], i))).alias("ticketing"),
        joined(cl.seat_category(pick(["concert", "nba_playoffs", "broadway", "comedy show", "festival", "other"], i))).alias("seats"), cl.venue_category(types).alias("place"),
        cl.price_level(pick([*cl.PRICE_LEVELS, "UNKNOWN"], i)).cast("long").alias("price_level"),
    )


def _cells(lat: str, lng: str, precision: int) -> tuple[str, str, str]:
    total = 5 * precision
    n_lng, n_lat = (total + 1) // 2, total // 2
    x = f"CAST(least(greatest(floor(({lng} + 180.0) / {360.0 / (1 << n_lng)!r}::DOUBLE), 0), {(1 << n_lng) - 1}) AS BIGINT)"
    y = f"CAST(least(greatest(floor(({lat} + 90.0) / {180.0 / (1 << n_lat)!r}::DOUBLE), 0), {(1 << n_lat) - 1}) AS BIGINT)"
    letters = []
    for letter in range(precision):
        bits = []
        for bit in range(5):
            k = 5 * letter + bit
            source, n = ("gx", n_lng) if k % 2 == 0 else ("gy", n_lat)
            bits.append(f"(({source} >> {n - 1 - k // 2}) & 1) * {1 << (4 - bit)}")
        letters.append(f"substr('{geo.BASE32}', CAST({' + '.join(bits)} + 1 AS BIGINT), 1)")
    return x, y, " || ".join(letters)


_X, _Y, _HASH = _cells("lat", "lng", 5)


@query(
    "geo_keys",
    f"""
WITH {FEED_SQL}, c AS (SELECT *, {_X} AS gx, {_Y} AS gy, floor(lat * 10 + 0.5) / 10.0::DOUBLE AS la, floor(lng * 10 + 0.5) / 10.0::DOUBLE AS ln FROM feed)
SELECT id, {_HASH} AS geohash, regexp_replace(CAST(la AS VARCHAR), '\\.0$', '') || ',' || regexp_replace(CAST(ln AS VARCHAR), '\\.0$', '') AS grid_key,
  round({_haversine(str(ORIGIN[0]), str(ORIGIN[1]))}, 6) AS miles, {_haversine(str(ORIGIN[0]), str(ORIGIN[1]))} <= 6 * 1.2 AS sane FROM c
""",
)
def geo_keys(spark, sf_dir):
    """X41-X43, F27."""
    lat, lng = F.col("lat"), F.col("lng")
    miles = geo.haversine_miles(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), lat, lng)
    return feed_events(spark, sf_dir).select("id", geo.geohash(lat, lng).alias("geohash"), geo.grid_key(lat, lng).alias("grid_key"), F.round(miles, 6).alias("miles"), validate.geo_sane(lat, lng, ORIGIN, 6.0).alias("sane"))


@query("geo_spheroid")
def geo_spheroid(spark, sf_dir):
    """Distance on the ellipsoid; within half a percent of the sphere (tested)."""
    own = geo.spheroid_miles(feed_events(spark, sf_dir), F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lat"), F.col("lng"), "miles")
    return own.select("id", F.round("miles", 6).alias("miles"))


@query(
    "geo_spatial_join",
    f"""WITH {FEED_SQL}, p AS (SELECT id AS place_id, lat AS plat, lng AS plng FROM feed WHERE source = 'university')
SELECT id, place_id, round({_haversine("plat", "plng")}, 6) AS miles FROM feed, p WHERE {_haversine("plat", "plng")} <= 2.0""",
)
def geo_spatial_join(spark, sf_dir):
    """All events with all of the university within two miles, through cells."""
    own = feed_events(spark, sf_dir)
    places = own.filter("source = 'university'").select(F.col("id").alias("place_id"), F.col("lat").alias("plat"), F.col("lng").alias("plng"))
    found = spatial.within_distance(own.select("id", "lat", "lng"), places, 2.0, 6)
    return found.select("id", "place_id", "miles")


@query(
    "resolve_pairs",
    f"""
WITH {FEED_SQL}, b AS (SELECT id, lower(title) AS t, id % 5 AS hall, CAST(start_time AS DATE) AS day FROM feed),
w AS (SELECT *, list_distinct(list_filter(string_split({_norm("t")}, ' '), lambda x: length(x) >= 2 AND x NOT IN ({", ".join(f"'{s}'" for s in text.STOP_WORDS)}))) AS tk, {_norm("t")} AS n FROM b)
SELECT a.id AS id, c.id AS other_id FROM w a JOIN w c ON a.hall = c.hall AND a.day = c.day AND a.id < c.id
WHERE a.n = c.n OR (least(len(a.tk), len(c.tk)) >= 2 AND (len(list_intersect(a.tk, c.tk)) = least(len(a.tk), len(c.tk)) OR len(list_intersect(a.tk, c.tk)) / len(list_distinct(list_concat(a.tk, c.tk)))::DOUBLE >= 0.65))
""",
)
def resolve_pairs(spark, sf_dir):
    """Similar titles on the same day in the same hall."""
    own = feed_events(spark, sf_dir).select("id", "title", (F.col("id") % 5).alias("hall"), F.to_date("start_time").alias("day"))
    return resolve.similar_pairs(own, ["hall", "day"], F.lit(""))


@query("resolve_clusters")
def resolve_clusters(spark, sf_dir):
    """Greedy same-day clusters with alternate showtimes."""
    from eventloom.functions import timewin as tw

    own = tw.with_times(feed_events(spark, sf_dir), now_column())
    named = own.join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")), "venue_id", "left")
    found = resolve.merge_same_day(named, now_column())
    return found.select("id", "cluster_size", F.size("additional_starts").alias("n_more"))


@query("feed_pipeline")
def feed_pipeline(spark, sf_dir):
    """The whole feed: hide, merge, diversify, balance, in the order that counts."""
    from eventloom.functions import timewin as tw

    now = now_column()
    own = tw.with_times(feed_events(spark, sf_dir), now).filter(~tw.is_past(now))
    named = own.join(venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("venue_name")), "venue_id", "left")
    shown = feed.hide(named, ["movies"], ["adult"])
    # What several steps read is written once.
    merged = keep(resolve.merge_same_day(shown, now).drop("additional_starts", "cluster_size"), "merged")
    spread = keep(feed.diversify(merged), "diversified")
    balanced = feed.balance(keep(feed.balance(spread, merged, "source"), "balanced"), merged, "category", 3)
    return balanced.select("id", "pos")


_EMIT = f"""
emit AS (
  SELECT id, CASE WHEN id % 29 = 0 THEN '' ELSE title END AS title, CASE WHEN id % 31 = 0 THEN NULL ELSE 'Hall' END AS venue_name, address, CASE WHEN id % 37 = 0 THEN 999.0::DOUBLE ELSE lat END AS lat, lng,
    start_time, CASE WHEN id % 41 = 0 THEN start_time - INTERVAL 1 HOUR ELSE end_time END AS end_time, CASE WHEN id % 43 = 0 THEN 'bowling' ELSE category END AS category, {_TAGS} AS tags,
    CASE WHEN id % 47 = 0 THEN -1.0::DOUBLE ELSE price_min END AS price_min, price_max, is_free, image_url, CASE WHEN id % 53 = 0 THEN 'http://x.example.com' ELSE source_url END AS source_url, description
  FROM feed
)"""


@query(
    "validate_schema",
    f"""WITH {FEED_SQL}, {_EMIT}
SELECT id, CASE WHEN title IS NULL OR length(title) NOT BETWEEN 1 AND 200 THEN 'title' WHEN venue_name IS NULL THEN 'venue_name' WHEN address IS NULL THEN 'address' WHEN NOT lat BETWEEN -90 AND 90 THEN 'lat' WHEN NOT lng BETWEEN -180 AND 180 THEN 'lng'
  WHEN start_time IS NULL THEN 'start_iso fmt' WHEN start_time < {TS} - INTERVAL 6 HOUR THEN 'start_iso past' WHEN start_time > {TS} + INTERVAL 60 DAY THEN 'start_iso future' WHEN end_time < start_time THEN 'end before start'
  WHEN category NOT IN ('nightlife', 'sports', 'food', 'outdoors', 'arts', 'music', 'community', 'movies', 'fitness') THEN 'category' WHEN price_min NOT BETWEEN 0 AND 100000 THEN 'price_min' WHEN price_max NOT BETWEEN 0 AND 100000 THEN 'price_max'
  WHEN is_free IS NULL THEN 'is_free' WHEN image_url IS NOT NULL AND NOT regexp_matches(image_url, '^https://\\S+$', 'i') THEN 'image_url' WHEN source_url IS NULL OR NOT regexp_matches(source_url, '^https://\\S+$', 'i') THEN 'source_url'
  WHEN description IS NULL OR length(description) NOT BETWEEN 1 AND 500 THEN 'description' END AS detail FROM emit""",
)
def validate_schema(spark, sf_dir):
    """F22."""
    i = F.col("id")
    own = feed_events(spark, sf_dir).withColumns(
        {
            "title": F.when(i % 29 == 0, "").otherwise(F.col("title")), "venue_name": F.when(i % 31 != 0, "Hall"), "lat": F.when(i % 37 == 0, 999.0).otherwise(F.col("lat")),
            "end_time": F.when(i % 41 == 0, F.col("start_time") - F.expr("INTERVAL '1' HOUR")).otherwise(F.col("end_time")), "category": F.when(i % 43 == 0, "bowling").otherwise(F.col("category")),
            "tags": score.tags(), "price_min": F.when(i % 47 == 0, -1.0).otherwise(F.col("price_min")), "source_url": F.when(i % 53 == 0, "http://x.example.com").otherwise(F.col("source_url")),
        }
    )
    return own.select("id", validate.schema_detail(now_column()).alias("detail"))


@query(
    "validate_gates",
    f"""
WITH {FEED_SQL}, p AS (
  SELECT *, CASE id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 405 ELSE 301 END AS status, CASE WHEN id % 2 = 0 THEN 206 ELSE 500 END AS ranged, 'results: https://www.EVENTBRITE.com/e/1 and meetup.com' AS blob,
    lower('<p>Trivia and brews at the hall, ' || strftime(start_time, '%B') || ' 20; tomorrow friday</p>') AS page, day(start_time) AS d,
    CAST(floor((epoch_us(start_time) - epoch_us({TS})) / 86400000000.0::DOUBLE + 0.5) AS BIGINT) AS ahead
  FROM feed
), w AS (SELECT *, regexp_extract_all(lower(title), '[a-z][a-z''-]{{2,}}') AS words, ' trivia and brews at the hall, ' || lower(strftime(start_time, '%B')) || ' 20; tomorrow friday ' AS txt FROM p)
SELECT id, coalesce(contains(lower(blob), lower(regexp_extract(source_url, '^https?://([^/?#]+)', 1))) AND regexp_extract(source_url, '^https?://([^/?#]+)', 1) <> '', false) AS grounded,
  CASE WHEN status = 405 THEN ranged BETWEEN 200 AND 399 ELSE status BETWEEN 200 AND 399 END AS reachable,
  len(list_filter(words, lambda x: contains(txt, x))) >= 3 OR (len(words) < 3 AND len(list_filter(words, lambda x: contains(txt, x))) = len(words)) AS title_found,
  contains(txt, strftime(start_time, '%Y-%m-%d')) OR contains(txt, lower(strftime(start_time, '%B')) || ' ' || d) OR contains(txt, month(start_time) || '/' || d)
    OR (ahead BETWEEN 0 AND 7 AND (contains(txt, 'tonight') OR (ahead = 1 AND contains(txt, 'tomorrow')) OR contains(txt, lower(strftime(start_time, '%A'))))) AS date_found
FROM w
""",
)
def validate_gates(spark, sf_dir):
    """F23-F26 over fetched status, search results and page."""
    i = F.col("id")
    page = F.concat(F.lit("<p>Trivia and brews at the hall, "), F.date_format("start_time", "MMMM"), F.lit(" 20; tomorrow friday</p>"))
    status = F.when(i % 4 == 0, 200).when(i % 4 == 1, 404).when(i % 4 == 2, 405).otherwise(301)
    shown = F.lower(text.without_tags(page))
    return feed_events(spark, sf_dir).select(
        "id", validate.grounded(F.col("source_url"), F.lit("results: https://www.EVENTBRITE.com/e/1 and meetup.com")).alias("grounded"),
        validate.reachable(status, F.when(i % 2 == 0, 206).otherwise(500)).alias("reachable"), validate.title_found(F.col("title"), shown).alias("title_found"),
        validate.date_found(shown, F.col("start_time"), now_column()).alias("date_found"),
    )


@query(
    "hash_event_ids",
    """SELECT user_id, printf('%08x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, x: xor(h, x) * 16777619 % 4294967296)) AS ids_hash
FROM (SELECT user_id, string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR)) AS s FROM events GROUP BY user_id)""",
)
def hash_event_ids(spark, sf_dir):
    """One hash per user's events."""
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.col("event_id").cast("string")).alias("ids"))
    return own.select("user_id", text.ids_hash(F.col("ids")).alias("ids_hash"))
