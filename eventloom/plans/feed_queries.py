"""Queries of the feed and of time windows, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.functions import geo, score
from eventloom.functions import timewin as tw
from eventloom.operators import feed
from eventloom.plans.views import FEED_SQL, NOW, ORIGIN, VENUES_SQL, feed_events, venues

TS = f"TIMESTAMP '{NOW}'"

_DAY = "CASE lower(regexp_extract(recurrence_rule, '(?i)every\\s+(\\w+)', 1)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tw.WEEKDAYS.items()) + " END"

TIMED_SQL = f"""
{FEED_SQL}, dated AS (
  SELECT *, {_DAY} AS target, CASE WHEN end_time IS NULL THEN INTERVAL 3 HOUR ELSE greatest(end_time - start_time, INTERVAL 0 SECOND) END AS lasts,
    date_trunc('day', {TS}) + (date_trunc('minute', start_time) - date_trunc('day', start_time)) AS today
  FROM feed
), shifted AS (
  SELECT *, (target - dayofweek({TS}) + 7) % 7 AS ahead FROM dated
), timed AS (
  SELECT * EXCLUDE (target, today, ahead), CASE WHEN is_recurring AND coalesce(recurrence_rule, '') <> '' AND start_time < {TS} AND target IS NOT NULL
      THEN today + to_days(CAST(CASE WHEN ahead = 0 AND today + lasts <= {TS} THEN 7 ELSE ahead END AS INTEGER)) ELSE start_time END AS eff_start,
    eff_start + lasts AS eff_end
  FROM shifted
)"""


def _haversine(lat: str, lng: str, lat2: str = "lat", lng2: str = "lng") -> str:
    h = f"pow(sin(radians({lat2} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng}) / 2), 2)"
    return f"{2 * geo.RADIUS_MILES} * asin(sqrt(least({h}, 1.0)))"


def now_column():
    return tw.at(NOW)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tw.with_times(feed_events(spark, sf_dir), now_column())


def with_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", geo.haversine_miles(F.lit(ORIGIN[0]), F.lit(ORIGIN[1]), F.col("lat"), F.col("lng")))


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


_QUALITY_SQL = (
    "(CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in score.SOURCE_POINTS.items()) + " ELSE 10 END"
    " + CASE WHEN source_url IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN image_url IS NOT NULL THEN 8 ELSE 0 END"
    " + CASE WHEN length(coalesce(description, '')) >= 80 THEN 8 WHEN length(coalesce(description, '')) >= 32 THEN 4 ELSE -8 END"
    " + CASE WHEN venue_id IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN is_recurring THEN -3 ELSE 4 END)"
)


def _discover_sql(miles: float, more: str = "") -> str:
    return f"""
WITH {FEED_SQL}, {VENUES_SQL}, near AS (
  SELECT e.*, {_haversine(str(ORIGIN[0]), str(ORIGIN[1]), "e.lat", "e.lng")} AS distance, {_QUALITY_SQL.replace("source_url", "e.source_url")} AS quality,
    v.name AS venue_name, v.rating AS venue_rating
  FROM feed e LEFT JOIN venues v ON e.venue_id = v.id
  WHERE (is_recurring OR end_time IS NULL OR end_time > {TS} - INTERVAL 1 HOUR) AND (is_recurring OR start_time < {TS} + INTERVAL 7 DAY)
    AND NOT list_contains(coalesce(tags, []), 'adult') {more}
)
SELECT id, source, title, round(distance, 6) AS distance, quality, array_to_string(coalesce(tags, []), ',') AS tags, venue_name, venue_rating,
  row_number() OVER (ORDER BY CASE WHEN start_time <= {TS} AND (end_time IS NULL OR end_time > {TS}) THEN 0 ELSE 1 END,
    CASE WHEN start_time < {TS} + INTERVAL 48 HOUR THEN 0 ELSE 1 END, quality DESC, start_time, distance, id) AS rank
FROM near WHERE distance <= {miles}
"""


def _discovered(spark: SparkSession, sf_dir: str, miles: float, events: DataFrame | None = None, **filters) -> DataFrame:
    now = now_column()
    events = feed_events(spark, sf_dir) if events is None else events
    found = feed.numbered(feed.discover(events, venues(spark, sf_dir), ORIGIN, miles, now, **filters), feed.rank_keys(now), "rank")
    return found.select(
        "id", "source", "title", F.round("distance", 6).alias("distance"), F.col("quality").cast("int").alias("quality"), F.array_join("tags", ",").alias("tags"),
        F.col("venue.name").alias("venue_name"), F.col("venue.rating").alias("venue_rating"), "rank",
    )


@query("feed_discover", _discover_sql(5.0))
def feed_discover(spark, sf_dir):
    """G7 with F1-F3, F6, J1, P1, L1, L2, X41."""
    return _discovered(spark, sf_dir, 5.0)


@query("feed_discover_filtered", _discover_sql(12.0, "AND e.category IN ('food', 'music', 'nightlife') AND list_has_all(coalesce(tags, []), ['free'])"))
def feed_discover_filtered(spark, sf_dir):
    """category and all-tags filters."""
    return _discovered(spark, sf_dir, 12.0, categories=["food", "music", "nightlife"], tags=["free"])


@query("feed_event_by_id", f"WITH {FEED_SQL}, {VENUES_SQL} SELECT e.id, e.title, v.name AS venue_name, v.category AS venue_category FROM feed e LEFT JOIN venues v ON e.venue_id = v.id WHERE e.id IN (7, 42, 100)")
def feed_event_by_id(spark, sf_dir):
    """Primary-key lookups with the venue."""
    own = feed_events(spark, sf_dir).filter(F.col("id").isin(7, 42, 100))
    return own.join(feed.venue_struct(venues(spark, sf_dir)), "venue_id", "left").select("id", "title", F.col("venue.name").alias("venue_name"), F.col("venue.category").alias("venue_category"))


_WINDOWS_SQL = f"""
WITH {TIMED_SQL}
SELECT id, eff_start, eff_end, eff_start <= {TS} AND eff_end <= {TS} AS past,
  eff_end > {TS} AND eff_start <= date_trunc('day', {TS}) + INTERVAL 27 HOUR AS tonight,
  CAST(eff_start AS DATE) = CAST({TS} AS DATE) + 1 AS tomorrow,
  eff_start >= TIMESTAMP '2024-01-20' AND eff_start < TIMESTAMP '2024-01-22' AS weekend,
  eff_start BETWEEN {TS} AND {TS} + INTERVAL 5 HOUR AS within_5h,
  eff_start <= {TS} AND eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} AS live,
  CASE WHEN eff_start > {TS} THEN eff_start <= {TS} + INTERVAL 12 HOUR ELSE eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} END AS live_or_soon,
  CAST(eff_start AS DATE) = CAST({TS} AS DATE) AS same_day,
  eff_start >= {TS} AND eff_start < {TS} + INTERVAL 7 DAY AS this_week
FROM timed
"""


@query("time_windows", _WINDOWS_SQL)
def time_windows(spark, sf_dir):
    """Recurrence and wall-clock predicates."""
    now = now_column()
    return timed(spark, sf_dir).select(
        "id", "eff_start", "eff_end", tw.is_past(now).alias("past"), tw.is_tonight(now).alias("tonight"), tw.is_tomorrow(now).alias("tomorrow"), tw.is_weekend(now).alias("weekend"),
        tw.is_within_hours(now, 5).alias("within_5h"), tw.is_live(now).alias("live"), tw.is_live_or_soon(now, 12).alias("live_or_soon"), tw.is_same_day(now).alias("same_day"),
        tw.matches_when("week", now).alias("this_week"),
    )


_LABELS_SQL = f"""
WITH {TIMED_SQL}, ahead AS (
  SELECT *, CAST(epoch_us(eff_start) - epoch_us({TS}) AS DOUBLE) / 60000000 AS m FROM timed
), whole AS (
  SELECT *, CAST(floor(m + 0.5) AS BIGINT) AS mins, CAST(floor(floor(m + 0.5) / 60 + 0.5) AS BIGINT) AS hrs, greatest(0, CAST(floor(m + 0.5) AS BIGINT)) AS um FROM ahead
), uh AS (SELECT *, CAST(floor(um / 60.0::DOUBLE + 0.5) AS BIGINT) AS uhrs FROM whole)
SELECT id,
  CASE WHEN eff_end <= {TS} THEN 'Ended' WHEN eff_start <= {TS} THEN 'HAPPENING NOW' WHEN mins <= 60 THEN 'Starts in ' || mins || ' min'
    WHEN hrs < 24 THEN 'In ' || hrs || 'h' ELSE 'In ' || CAST(floor(hrs / 24.0::DOUBLE + 0.5) AS BIGINT) || 'd' END AS time_label,
  CASE WHEN eff_start <= {TS} AND eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} THEN 'Happening now' WHEN um < 60 THEN 'Starts in ' || um || ' min'
    WHEN uhrs <= 6 THEN 'Starts in ' || uhrs || 'h' WHEN eff_end > {TS} AND eff_start <= date_trunc('day', {TS}) + INTERVAL 27 HOUR THEN 'Tonight' ELSE 'Next up' END AS urgent_label
FROM uh
"""


@query("time_labels", _LABELS_SQL)
def time_labels(spark, sf_dir):
    """X10, X11."""
    now = now_column()
    return timed(spark, sf_dir).select("id", tw.time_label(now).alias("time_label"), tw.urgent_label(now).alias("urgent_label"))


_REMIND_SQL = f"""
WITH {TIMED_SQL}, one AS (
  SELECT id, eff_start, eff_start - INTERVAL 24 HOUR AS d, date_trunc('day', eff_start) + INTERVAL 9 HOUR AS morning FROM timed
), moved AS (
  SELECT id, eff_start, morning, CASE WHEN hour(d) >= 22 THEN date_trunc('day', d) + INTERVAL 32 HOUR WHEN hour(d) < 8 THEN date_trunc('day', d) + INTERVAL 8 HOUR ELSE d END AS d FROM one
), both_ AS (
  SELECT id, 'day-ahead' AS kind, d AS remind_at, eff_start FROM moved UNION ALL SELECT id, 'morning', CASE WHEN morning > d THEN morning END, eff_start FROM moved
)
SELECT id, kind, remind_at FROM both_ WHERE remind_at > {TS} + INTERVAL 30 SECOND AND remind_at < eff_start
"""


@query("time_reminders", _REMIND_SQL)
def time_reminders(spark, sf_dir):
    """Reminders outside the quiet hours."""
    return tw.reminders(timed(spark, sf_dir), now_column())


@query(
    "time_misc",
    f"""
WITH {FEED_SQL}
SELECT id, CASE WHEN end_time - start_time > INTERVAL 12 HOUR AND NOT is_recurring THEN start_time + INTERVAL 3 HOUR ELSE end_time END AS capped_end,
  date_trunc('day', {TS}) + to_days(CAST(([2, 5, 1, 0][1 + id % 4] - dayofweek({TS}) + 7) % 7 AS INTEGER))
    + CASE id % 3 WHEN 0 THEN INTERVAL 19 HOUR + INTERVAL 30 MINUTE WHEN 1 THEN INTERVAL 19 HOUR ELSE INTERVAL 18 HOUR END AS next_at,
  ['tuesday', 'friday', 'monday', 'sunday'][1 + id % 4] AS canonical_day,
  CASE id % 4 WHEN 0 THEN TIMESTAMP '2024-01-20 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-20 13:14:15' WHEN 2 THEN TIMESTAMP '2024-01-20 13:14:15' END AS ical_at,
  array_to_string(list_transform(range(0, 14), lambda k: strftime(CAST(start_time AS DATE) + CAST(k AS INTEGER), '%Y%m%d')), ',') AS day_keys
FROM feed
""",
)
def time_misc(spark, sf_dir):
    """X12-X14, X18, X19."""
    i = F.col("id")
    from eventloom.plans.views import pick

    day = pick(["Tues", "friday", "MON", "sundays"], i)
    clock = pick(["7:30 PM", "", "late"], i)
    ical = pick(["20240120", "20240120T131415Z", "20240120T131415", "Jan 20"], i)
    return feed_events(spark, sf_dir).select(
        "id", tw.capped_end(F.col("start_time"), F.col("end_time"), F.col("is_recurring")).alias("capped_end"), tw.next_occurrence(day, clock, now_column()).alias("next_at"),
        tw.normal_weekday(day).alias("canonical_day"), tw.ical_instant(ical).alias("ical_at"), F.array_join(tw.day_keys(F.to_date("start_time"), 14), ",").alias("day_keys"),
    )


_TAGS = "coalesce(tags, [])"
_HAPPY_SQL = f"(list_has_any({_TAGS}, ['happy-hour', 'happy_hour']) OR contains(lower(title || ' ' || coalesce(subcategory, '')), 'happy hour') OR contains(lower(title || ' ' || coalesce(subcategory, '')), 'happyhour'))"


@query(
    "feed_filters",
    f"""
WITH {FEED_SQL}
SELECT id, {_HAPPY_SQL} AS happy_hour, category NOT IN ('movies') AND NOT list_has_any({_TAGS}, ['21+', 'adult']) AS shown,
  category IN ('food', 'music') AND list_has_any({_TAGS}, ['free', 'social']) AS in_sheet,
  abs(lat - {ORIGIN[0]}) < 0.05 AND abs(lng - {ORIGIN[1]}) < 0.05 AS in_view,
  contains(lower(title), 'night') OR contains(lower(coalesce(description, '')), 'night') OR contains(lower(address), 'night') OR contains(lower(coalesce(subcategory, '')), 'night')
    OR len(list_filter({_TAGS}, lambda t: contains(lower(t), 'night'))) > 0 AS found,
  abs(lat - {ORIGIN[0]}) < 5.0 / 69 AND abs(lng - {ORIGIN[1]}) < 5.0 / 69 AS in_rough_box,
  lat > 26.4 AS abusive
FROM feed
""",
)
def feed_filters(spark, sf_dir):
    """Every filter as a flag, computed by filtering and marking the rows that stay."""
    base = feed_events(spark, sf_dir)
    kept = lambda df, name: df.select("id", F.lit(True).alias(name))
    out = base.select("id", "lat", "lng", score.happy_hour().alias("happy_hour"), geo.rough_box(F.col("lat"), F.col("lng"), ORIGIN, 5).alias("in_rough_box"))
    out = out.withColumn("abusive", geo.is_abusive(F.col("lat"), F.col("lng"), F.when(F.col("lat") > 26.4, 101.0).otherwise(5.0)))
    parts = {
        "shown": feed.hide(base, ["movies"], ["21+", "adult"]),
        "in_sheet": feed.sheet(base, ["food", "music"], ["free", "social"]),
        "in_view": feed.viewport(feed.mappable(base), ORIGIN, (0.1, 0.1)),
        "found": feed.search(base, " Night "),
    }
    for name, df in parts.items():
        out = out.join(kept(df, name), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("lat", "lng")


def _mood_sql(mood: str) -> str:
    cats, tags, pattern = score.MOODS[mood]
    lst = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    text = f"lower(title || ' ' || coalesce(description, '') || ' ' || coalesce(subcategory, '') || ' ' || array_to_string({_TAGS}, ' '))"
    if mood == "cheap":
        return f"(is_free OR list_contains({_TAGS}, 'free') OR contains({text}, 'free '))"
    return f"(list_contains({lst(cats)}, category) OR list_has_any({_TAGS}, {lst(tags)}) OR regexp_matches({text}, '{pattern}'))"


def _mood_score_sql(mood: str) -> str:
    cats, tags, _ = score.MOODS[mood]
    lst = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    return f"(CASE WHEN list_contains({lst(cats)}, category) THEN 12 ELSE 0 END + 8 * len(list_filter({_TAGS}, lambda t: list_contains({lst(tags)}, t))) + CASE WHEN {_mood_sql(mood)} THEN 5 ELSE 0 END)"


@query("feed_moods", f"WITH {FEED_SQL} SELECT id, " + ", ".join(f"{_mood_sql(m)} AS m_{m}, CAST({_mood_score_sql(m)} AS INTEGER) AS s_{m}" for m in score.MOODS if m != "any") + " FROM feed")
def feed_moods(spark, sf_dir):
    """F11, X56."""
    moods = [m for m in score.MOODS if m != "any"]
    return feed_events(spark, sf_dir).select("id", *[x for m in moods for x in (score.matches_mood(m).alias(f"m_{m}"), score.mood_score(m).cast("int").alias(f"s_{m}"))])


def _goal_sql(goals: list[str]) -> str:
    parts = [f"CASE WHEN list_contains({_TAGS}, '{t}') THEN 3 ELSE 0 END" for g in goals for t in score.GOALS[g][0]]
    parts += [f"CASE WHEN category = '{c}' THEN 2 ELSE 0 END" for g in goals for c in score.GOALS[g][1]]
    if "find-partner" in goals:
        parts.append(f"CASE WHEN list_contains({_TAGS}, 'singles') THEN 10 ELSE 0 END")
    return "(" + " + ".join(parts) + ")"


GOALS = ["find-partner", "live-music", "get-active"]


@query("feed_goal_picks", f"WITH {FEED_SQL} SELECT id, {_goal_sql(GOALS)} AS score FROM feed WHERE {_goal_sql(GOALS)} > 0 ORDER BY score DESC, pos LIMIT 6")
def feed_goal_picks(spark, sf_dir):
    """L4, X53."""
    return feed.top(feed_events(spark, sf_dir), score.goal_score(GOALS), 6, F.col("score") > 0).select("id", "score")


_URGENCY_SQL = f"""({_mood_score_sql("party")}
  + CASE WHEN eff_start <= {TS} AND eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} THEN 120 WHEN mins BETWEEN 0 AND 60 THEN 95 WHEN mins <= 180 THEN 72 WHEN mins <= 360 THEN 48
      WHEN eff_end > {TS} AND eff_start <= date_trunc('day', {TS}) + INTERVAL 27 HOUR THEN 28 ELSE 0 END
  + greatest(0.0::DOUBLE, 24 - distance * 2) + CASE WHEN source IN ('ticketmaster', 'meetup', 'university') THEN 8 WHEN source IN ('scraped', 'claude') THEN 4 ELSE 0 END
  + CASE WHEN is_free THEN 5 ELSE 0 END + CASE WHEN coalesce(image_url, '') <> '' THEN 3 ELSE 0 END)"""


@query(
    "feed_now_queue",
    f"""
WITH {TIMED_SQL}, far AS (
  SELECT *, {_haversine(str(ORIGIN[0]), str(ORIGIN[1]))} AS distance, CAST(floor(CAST(epoch_us(eff_start) - epoch_us({TS}) AS DOUBLE) / 60000000 + 0.5) AS BIGINT) AS mins FROM timed
), pool AS (
  SELECT *, {_URGENCY_SQL} AS score FROM far WHERE (CASE WHEN eff_start > {TS} THEN eff_start <= {TS} + INTERVAL 6 HOUR ELSE eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} END)
    OR (eff_end > {TS} AND eff_start <= date_trunc('day', {TS}) + INTERVAL 27 HOUR)
)
SELECT id, round(score, 6) AS score FROM pool ORDER BY pool.score DESC, pos LIMIT 5
""",
)
def feed_now_queue(spark, sf_dir):
    """L5, X57."""
    return feed.now_queue(with_distance(timed(spark, sf_dir)), now_column(), "party").select("id", F.round("score", 6).alias("score"))


def _hero_sql(goals: list[str]) -> str:
    lst = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]::VARCHAR[]"
    hits = [f"len(list_filter({_TAGS}, lambda t: list_contains({lst(score.GOALS[g][0])}, t)))" for g in goals]
    cats = [f"CASE WHEN list_contains({lst(score.GOALS[g][1])}, category) THEN 1 ELSE 0 END" for g in goals]
    matched = "(" + " + ".join(f"CASE WHEN {h} + {c} > 0 THEN 1 ELSE 0 END" for h, c in zip(hits, cats, strict=True)) + ")"
    base = " + ".join(f"{h} * 5 + {c} * 2" for h, c in zip(hits, cats, strict=True))
    days = f"(CAST(epoch_us(eff_start) - epoch_us({TS}) AS DOUBLE) / 86400000000)"
    return f"""CASE WHEN NOT list_contains({_TAGS}, 'adult') AND {days} >= 0 THEN {base} + CASE WHEN {matched} >= 2 THEN 12 ELSE 0 END + CASE WHEN {matched} >= 3 THEN 6 ELSE 0 END
      + CASE WHEN list_contains({_TAGS}, 'singles') THEN 15 ELSE 0 END - CASE WHEN list_contains({_TAGS}, 'family') THEN 8 ELSE 0 END
      + CASE WHEN {days} < 1 THEN 10 WHEN {days} < 2 THEN 7 WHEN {days} < 4 THEN 5 WHEN {days} < 7 THEN 2 WHEN {days} > 14 THEN -5 ELSE 0 END END"""


@query(
    "feed_hero",
    f"WITH {TIMED_SQL} SELECT id, CAST(s AS INTEGER) AS score, least(97, 78 + CAST(floor(greatest(0, s) * 0.5 + 0.5) AS INTEGER)) AS match_percent FROM (SELECT *, {_hero_sql(GOALS)} AS s FROM timed) WHERE s >= 5 ORDER BY s DESC, pos LIMIT 1",
)
def feed_hero(spark, sf_dir):
    """L8, X54, X55."""
    best = feed.top(timed(spark, sf_dir), score.hero_score(GOALS, now_column()), 1, F.col("score") >= 5)
    return best.select("id", F.col("score").cast("int").alias("score"), score.match_percent(F.col("score")).cast("int").alias("match_percent"))


@query(
    "feed_similar",
    f"""WITH {FEED_SQL}, one AS (SELECT {_TAGS} AS own_tags, category AS own_category FROM feed WHERE id = 30)
SELECT id, score FROM (SELECT id, pos, CAST(len(list_intersect({_TAGS}, own_tags)) AS INTEGER) + CASE WHEN category = own_category THEN 2 ELSE 0 END AS score FROM feed, one WHERE id <> 30)
WHERE score > 0 ORDER BY score DESC, pos LIMIT 5""",
)
def feed_similar(spark, sf_dir):
    """L7, J12."""
    return feed.similar(feed_events(spark, sf_dir), 30).select("id", "score")


_CAPPED = "SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(venue_id AS VARCHAR), nullif(address, ''), title) ORDER BY pos) AS nth FROM feed"


@query("feed_venue_cap", f"WITH {FEED_SQL} SELECT id, pos FROM ({_CAPPED}) WHERE nth <= 3")
def feed_venue_cap(spark, sf_dir):
    """W1."""
    return feed.venue_cap(feed_events(spark, sf_dir), 3).select("id", "pos")


@query("feed_diversify", f"WITH {FEED_SQL}, capped AS ({_CAPPED}) SELECT id FROM capped WHERE nth <= CASE WHEN (SELECT count(*) FROM capped WHERE nth <= 3) >= 120 THEN 3 ELSE 8 END")
def feed_diversify(spark, sf_dir):
    """Variety where supply allows, else volume."""
    return feed.diversify(feed_events(spark, sf_dir), target=120).select("id")


def _balance_sql(column: str, least: int | None) -> str:
    kind = f"coalesce(nullif({column}, ''), 'unknown')"
    cut = f"WHERE kind_no <= {least} - (SELECT count(*) FROM kinds)" if least else ""
    wanted = "source IN ('ticketmaster', 'meetup')" if column == "source" else "category IN ('nightlife', 'outdoors')"
    return f"""
WITH {TIMED_SQL}, pool AS (SELECT *, {kind} AS kind FROM timed), chosen AS (SELECT * FROM pool WHERE {wanted}),
kinds AS (SELECT kind, count(*) AS n, min(pos) AS first_pos FROM chosen GROUP BY kind),
top AS (SELECT kind, n FROM kinds ORDER BY n DESC, first_pos LIMIT 1),
lacking AS (SELECT kind, min(pos) AS kind_pos FROM pool GROUP BY kind HAVING count(*) >= 2 AND kind NOT IN (SELECT kind FROM kinds)),
fresh AS (SELECT p.*, kind_pos, row_number() OVER (PARTITION BY p.kind ORDER BY pos) AS nth, dense_rank() OVER (ORDER BY kind_pos) AS kind_no FROM pool p JOIN lacking USING (kind) WHERE id NOT IN (SELECT id FROM chosen)),
added AS (SELECT * FROM fresh {cut}), two AS (SELECT * FROM added WHERE nth <= 2 AND (SELECT count(*) FROM chosen) >= 20),
dropped AS (SELECT CASE WHEN n >= 3 THEN least((SELECT count(*) FROM two), n - 2) ELSE 0 END AS k, kind FROM top),
stays AS (SELECT c.* FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY pos) AS nth FROM chosen) c, dropped d WHERE NOT (c.kind = d.kind AND c.nth <= d.k)),
both_ AS (SELECT id, eff_start, 0 AS side, 0 AS kind_pos, pos FROM stays UNION ALL SELECT id, eff_start, 1, kind_pos, pos FROM two)
SELECT id, CASE WHEN (SELECT count(*) FROM two) > 0 THEN row_number() OVER (ORDER BY eff_start, side, kind_pos, pos) ELSE pos END AS pos FROM both_
"""


@query("feed_balance_sources", _balance_sql("source", None))
def feed_balance_sources(spark, sf_dir):
    """W3, A8, J9, L3."""
    pool = timed(spark, sf_dir)
    return feed.balance(pool.filter("source IN ('ticketmaster', 'meetup')"), pool, "source").select("id", "pos")


@query("feed_balance_categories", _balance_sql("category", 3))
def feed_balance_categories(spark, sf_dir):
    """W4."""
    pool = timed(spark, sf_dir)
    return feed.balance(pool.filter("category IN ('nightlife', 'outdoors')"), pool, "category", 3).select("id", "pos")


@query(
    "feed_widen",
    f"""
WITH {FEED_SQL}, far AS (
  SELECT id, {_haversine(str(ORIGIN[0] + 0.2), str(ORIGIN[1]))} AS distance FROM feed
), tiered AS (SELECT *, CASE WHEN distance <= 5 THEN 0 WHEN distance <= 15 THEN 1 WHEN distance <= 30 THEN 2 WHEN distance <= 50 THEN 3 WHEN distance <= 100 THEN 4 END AS tier FROM far),
counts AS (SELECT tier, count(*) AS n FROM tiered WHERE tier IS NOT NULL GROUP BY tier),
wanted AS (SELECT tier FROM (SELECT tier, coalesce(sum(n) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counts) WHERE tier = 0 OR before < 20)
SELECT id, tier FROM tiered WHERE tier IN (SELECT tier FROM wanted)
""",
)
def feed_widen(spark, sf_dir):
    """Wider radii until the feed is long enough."""
    near = feed_events(spark, sf_dir).withColumn("distance", geo.haversine_miles(F.lit(ORIGIN[0] + 0.2), F.lit(ORIGIN[1]), F.col("lat"), F.col("lng")))
    return feed.widen(near, 5.0).select("id", "tier")


@query(
    "feed_rank_merge",
    f"WITH {FEED_SQL}, ranking AS (SELECT id, (id % 97) / 97.0::DOUBLE AS rank_score FROM feed WHERE category IN ('music', 'food', 'arts')) SELECT e.id, r.rank_score, row_number() OVER (ORDER BY coalesce(rank_score, -1) DESC, CASE WHEN source = 'claude' THEN 0 ELSE 1 END, pos) AS place FROM feed e LEFT JOIN ranking r ON e.id = r.id",
)
def feed_rank_merge(spark, sf_dir):
    """J6, L11."""
    own = feed_events(spark, sf_dir)
    ranking = own.filter("category IN ('music', 'food', 'arts')").select(F.col("id").alias("event_id"), (F.col("id") % 97 / F.lit(97.0)).alias("rank_score"), F.lit("why").alias("blurb"))
    return feed.numbered(feed.apply_ranking(own, ranking).select("id", "rank_score", "source", "pos"), feed.ranking_keys(), "place").select("id", "rank_score", "place")


_IN_ROW = {
    "happening-now": f"CASE WHEN eff_start > {TS} THEN eff_start <= {TS} + INTERVAL 12 HOUR ELSE eff_start >= {TS} - INTERVAL 6 HOUR AND eff_end > {TS} END",
    "goal-find-partner": f"list_has_any({_TAGS}, ['singles', 'date-night']) OR (category IN ('nightlife', 'arts') AND NOT {_HAPPY_SQL})",
    "goal-live-music": f"category = 'music' OR list_contains({_TAGS}, 'live-music')",
    "goal-get-active": f"category IN ('sports', 'fitness') OR list_contains({_TAGS}, 'active')",
    "free-tonight": f"is_free AND CAST(eff_start AS DATE) = CAST({TS} AS DATE)",
    "happy-hours": _HAPPY_SQL,
    "within-one-mile": "distance < 1",
    "this-weekend": "eff_start >= TIMESTAMP '2024-01-20' AND eff_start < TIMESTAMP '2024-01-22'",
}


@query(
    "feed_rows",
    f"WITH {TIMED_SQL}, far AS (SELECT *, {_haversine(str(ORIGIN[0]), str(ORIGIN[1]))} AS distance FROM timed), members AS ("
    + " UNION ALL ".join(f"SELECT {n} AS no, '{k}' AS row_id, id, pos, eff_start FROM far WHERE {c}" for n, (k, c) in enumerate(_IN_ROW.items()) if k != "goal-live-music")
    + """), sizes AS (SELECT no, row_id, row_number() OVER (ORDER BY no) AS row_no FROM members GROUP BY no, row_id HAVING count(*) >= CASE WHEN no = 0 THEN 1 ELSE 3 END)
SELECT row_no, row_id, id, row_number() OVER (PARTITION BY row_id ORDER BY eff_start, pos) AS place FROM members JOIN sizes USING (no, row_id) WHERE row_no <= 6""",
)
def feed_rows(spark, sf_dir):
    """Titled rows with thresholds, hidden rows and the cap."""
    own = with_distance(timed(spark, sf_dir))
    return feed.discovery_rows(own, now_column(), GOALS, hidden=["goal-live-music"])


@query("feed_merge_unique", f"WITH {FEED_SQL} SELECT id FROM feed WHERE category <> 'movies' UNION SELECT id FROM feed WHERE source <> 'reddit'")
def feed_merge_unique(spark, sf_dir):
    """Rows of a second list whose id is new."""
    own = feed_events(spark, sf_dir)
    return feed.merge_unique(own.filter("category <> 'movies'"), own.filter("source <> 'reddit'")).select("id")


@query("feed_saved_sections", f"WITH {TIMED_SQL} SELECT id, section, row_number() OVER (PARTITION BY section ORDER BY eff_start, pos) AS place FROM (SELECT *, CASE WHEN eff_start <= {TS} AND eff_end <= {TS} THEN 'past' ELSE 'upcoming' END AS section FROM timed WHERE category IN ('music', 'food'))")
def feed_saved_sections(spark, sf_dir):
    """Saved events in sections."""
    own = timed(spark, sf_dir)
    saved = feed.only_ids(own, own.filter("category IN ('music', 'food')")).withColumn("section", F.when(tw.is_past(now_column()), "past").otherwise("upcoming"))
    return saved.select("id", "section", F.row_number().over(Window.partitionBy("section").orderBy("eff_start", "pos")).alias("place"))

