"""Queries of telemetry, upserts, maintenance and crawl state, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import classify as cl
from eventloom.functions import score
from eventloom.functions import timewin as tw
from eventloom.operators import feed, maintain, scans, telemetry
from eventloom.plans.content_queries import _BRANDS, _THEATRES, _any_language, _chain
from eventloom.plans.feed_queries import TIMED_SQL, TS, now_column, timed
from eventloom.plans.views import FEED_SQL, ORIGIN, RUNS_SQL, VENUES_SQL, feed_events, runs, table, venues
from eventloom.sources import tables
from eventloom.streaming import state

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_TAGS = "coalesce(tags, [])"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _runs(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("cost_usd", F.col("cost_units").cast("double") / 128)


_DAY = f"phase = 'discover' AND started_at > {TS} - INTERVAL 24 HOUR"


@query("telemetry_cost", f"WITH {RUNS_SQL} SELECT date_trunc('hour', started_at) AS hour, count(*) AS runs, sum(cost_units / 128.0::DOUBLE) AS cost_usd, avg(cost_units / 128.0::DOUBLE) AS avg_run_cost FROM runs WHERE {_DAY} GROUP BY 1")
def telemetry_cost(spark, sf_dir):
    """A1, X17. Costs are multiples of 1/128, so sums are exact in any order."""
    return telemetry.cost_per_hour(_runs(spark, sf_dir), now_column())


@query("telemetry_funnel", f"WITH {RUNS_SQL}, r AS (SELECT unnest(reasons) AS reason FROM runs WHERE {_DAY}) SELECT reason, count(*) AS rejected, (SELECT CAST(sum(events_emitted) AS BIGINT) FROM runs WHERE {_DAY}) AS emitted, (SELECT CAST(sum(events_persisted) AS BIGINT) FROM runs WHERE {_DAY}) AS persisted FROM r GROUP BY reason")
def telemetry_funnel(spark, sf_dir):
    """A2, J5, X72."""
    return telemetry.rejection_funnel(_runs(spark, sf_dir), now_column())


@query("telemetry_hit_rate", f"WITH {RUNS_SQL}, c AS (SELECT count(*) FILTER (phase = 'rank') AS rank_calls, count(*) FILTER (phase = 'discover' AND status IN ('ok', 'partial')) AS discover_calls FROM runs WHERE started_at > {TS} - INTERVAL 24 HOUR) SELECT *, CASE WHEN rank_calls = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - discover_calls::DOUBLE / rank_calls END AS pool_hit_rate FROM c")
def telemetry_hit_rate(spark, sf_dir):
    """A3."""
    return telemetry.hit_rate(_runs(spark, sf_dir), now_column())


@query("telemetry_latency", f"WITH {RUNS_SQL}, t AS (SELECT epoch(finished_at - started_at)::DOUBLE AS s FROM runs WHERE {_DAY} AND status IN ('ok', 'partial')) SELECT round(quantile_cont(s, 0.95), 6) AS p95_seconds, round(quantile_cont(s, 0.5), 6) AS p50_seconds FROM t")
def telemetry_latency(spark, sf_dir):
    """A4."""
    return telemetry.latency(_runs(spark, sf_dir), now_column()).select(F.round("p95_seconds", 6).alias("p95_seconds"), F.round("p50_seconds", 6).alias("p50_seconds"))


_OK = f"phase = 'discover' AND status IN ('ok', 'partial') AND started_at > {TS} - INTERVAL 30 MINUTE"


@query("telemetry_cooldown", f"WITH {RUNS_SQL} SELECT NOT EXISTS (SELECT 1 FROM runs WHERE user_id = 7 AND {_OK}) AS user_allowed, EXISTS (SELECT 1 FROM runs WHERE geohash = 'cell4' AND events_persisted > 0 AND {_OK}) AS cell_fresh, (SELECT max(started_at) FROM runs WHERE geohash = 'cell4' AND phase = 'discover') AS last_run_at")
def telemetry_cooldown(spark, sf_dir):
    """A5, J4, T3."""
    return telemetry.cooldown(_runs(spark, sf_dir), "cell4", 7, now_column())


@query("telemetry_rate_window", "SELECT event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(ts AS TIMESTAMP) RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS calls FROM events")
def telemetry_rate_window(spark, sf_dir):
    """All calls counted; the self-limiting form is stream_rate_limit."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("client_id"), F.col("ts").cast("timestamp").alias("called_at"))
    return telemetry.calls_in_window(calls).select("id", "calls")


@query("telemetry_category_hint", f"WITH {FEED_SQL}, c AS (SELECT category, count(*) AS n FROM feed GROUP BY category), o AS (SELECT unnest({telemetry.HINT_ORDER}) AS category, generate_subscripts({telemetry.HINT_ORDER}, 1) AS k), j AS (SELECT o.*, coalesce(n, 0) AS n, (SELECT sum(n) FROM c) AS total FROM o LEFT JOIN c USING (category)) SELECT coalesce(string_agg(category, ',' ORDER BY k) FILTER (n >= greatest(2, total * 0.15)), '') AS well_covered, coalesce(string_agg(category, ',' ORDER BY k) FILTER (n < 2), '') AS under_represented FROM j")
def telemetry_category_hint(spark, sf_dir):
    """A7."""
    found = telemetry.category_hint(feed_events(spark, sf_dir))
    return found.select(F.array_join("well_covered", ",").alias("well_covered"), F.array_join("under_represented", ",").alias("under_represented"))


@query("telemetry_dominant", f"WITH {FEED_SQL} SELECT source, count(*) AS n FROM feed GROUP BY source ORDER BY n DESC, min(pos) LIMIT 1")
def telemetry_dominant(spark, sf_dir):
    """A8."""
    return telemetry.dominant(feed_events(spark, sf_dir), "source")


@query("telemetry_sources", f"WITH {FEED_SQL} SELECT source, count(*) AS events FROM feed GROUP BY source")
def telemetry_sources(spark, sf_dir):
    """A14, A13."""
    return feed_events(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("events"))


@query("telemetry_streaks", f"SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT CAST(ts AS DATE)) >= 3 AS prompt FROM events WHERE CAST(ts AS DATE) BETWEEN CAST({TS} AS DATE) - 6 AND CAST({TS} AS DATE) GROUP BY user_id")
def telemetry_streaks(spark, sf_dir):
    """A12, T9."""
    days = table(spark, sf_dir, "events").select("user_id", F.to_date(F.col("ts").cast("timestamp")).alias("day"))
    return telemetry.streaks(days, F.to_date(now_column()))


@query("telemetry_run_cost", "SELECT event_id AS id, round((event_id * 3.0::DOUBLE + (event_id % 50) * 0.3::DOUBLE + (event_id % 300) * 15.0::DOUBLE) / 1000000 + (event_id % 5) * 0.01::DOUBLE, 8) AS cost FROM events")
def telemetry_run_cost(spark, sf_dir):
    """X46."""
    i = F.col("event_id")
    return table(spark, sf_dir, "events").select(i.alias("id"), F.round(score.run_cost("large", i, i % 300, i % 50, i % 5), 8).alias("cost"))


_BATCH = "SELECT source, source_id, max(id) AS id FROM feed WHERE category <> 'arts' GROUP BY source, source_id"


@query("upsert_events", f"WITH {FEED_SQL}, base AS (SELECT source, source_id, min(id) AS id, 'old' AS title, 1 AS kept FROM feed WHERE category <> 'movies' GROUP BY source, source_id), batch AS ({_BATCH}) SELECT coalesce(b.source, n.source) AS source, coalesce(b.source_id, n.source_id) AS source_id, coalesce(n.id, b.id) AS id, CASE WHEN n.id IS NOT NULL THEN 'new' ELSE b.title END AS title, b.kept FROM base b FULL OUTER JOIN batch n ON b.source = n.source AND b.source_id = n.source_id")
def upsert_events(spark, sf_dir):
    """K1-K3, A10: insert or overwrite the supplied columns; the last of repeated keys counts."""
    own = feed_events(spark, sf_dir).select("source", "source_id", "id", "category")
    base = feed.first_by(own.filter("category <> 'movies'"), ["source", "source_id"], [F.col("id")]).drop("category").withColumns({"title": F.lit("old"), "kept": F.lit(1)})
    return tables.upserted(base, own.filter("category <> 'arts'").drop("category").withColumn("title", F.lit("new")), ["source", "source_id"], [F.col("id")])


@query("union_sources", f"WITH {FEED_SQL} SELECT id, k FROM (SELECT id, k, row_number() OVER (PARTITION BY source, source_id ORDER BY k, pos) AS nth FROM (SELECT *, 0 AS k FROM feed WHERE category IN ('music', 'food', 'arts') UNION ALL SELECT *, 1 FROM feed WHERE category NOT IN ('music', 'food') UNION ALL SELECT *, 2 FROM feed) WHERE start_time IS NOT NULL) WHERE nth = 1")
def union_sources(spark, sf_dir):
    """Batches in fixed order, the first of every key."""
    own = feed_events(spark, sf_dir)
    lists = ("category IN ('music', 'food', 'arts')", "category NOT IN ('music', 'food')", "true")
    parts = [own.filter(of).withColumn("k", F.lit(k)) for k, of in enumerate(lists)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("start_time IS NOT NULL")
    return feed.first_by(whole, ["source", "source_id"], [F.col("k"), F.col("pos")]).select("id", "k")


_PLAIN = "nullif(trim(" + _chain("description", (r"\[caption[^\[]*?\[/caption\]", "", "gi"), (r"\[/?[a-zA-Z][^\]]*\]", "", "g"), ("<[^>]+>", " ", "g"), ("&[#a-zA-Z0-9]+;", " ", "g"), (r"\s+", " ", "g")) + "), '')"


@query(
    "maintain_descriptions",
    f"""WITH {FEED_SQL}, c AS (SELECT *, CASE WHEN regexp_matches(description, '<[a-zA-Z!]|\\[|&[#a-zA-Z0-9]+;') THEN {_PLAIN} ELSE description END AS d FROM feed)
SELECT id, CASE WHEN length(d) > 500 THEN left(d, 500) || '…' ELSE d END AS description, array_to_string(CASE WHEN list_contains(tags, 'active') AND category NOT IN ('sports', 'fitness')
  AND NOT regexp_matches(title || ' ' || coalesce(d, ''), '\\b(?:{"|".join(cl.KEYWORDS["active"])})\\b', 'i') THEN list_filter(tags, lambda t: t <> 'active') ELSE tags END, ',') AS tags FROM c""",
)
def maintain_descriptions(spark, sf_dir):
    """M2, X28."""
    return maintain.cleaned_descriptions(feed_events(spark, sf_dir)).select("id", "description", F.array_join("tags", ",").alias("tags"))


@query(
    "maintain_adult_tags",
    f"""WITH {FEED_SQL}, {VENUES_SQL}, t AS (SELECT f.id, f.title, coalesce(description, '') AS d, coalesce(v.name, '') AS vn, list_filter({_TAGS}, lambda t: t <> 'adult') AS own FROM feed f LEFT JOIN venues v ON f.venue_id = v.id)
SELECT id, array_to_string(CASE WHEN regexp_matches(vn, '\\b(?:{_BRANDS})\\b', 'i') OR (regexp_matches(vn, '\\b[a-z]{{3,}}\\s+cabaret\\b', 'i') AND lower(vn) NOT IN ({_THEATRES})) OR {_any_language("vn")} OR {_any_language("title || ' ' || d")}
  OR regexp_matches(title, '\\b(?:{_BRANDS})\\b', 'i') OR (regexp_matches(title, '\\bat\\s+[a-z''\\s]+\\s+cabaret\\b', 'i')) THEN list_append(own, 'adult') ELSE own END, ',') AS tags FROM t""",
)
def maintain_adult_tags(spark, sf_dir):
    """Tags withdrawn and given anew."""
    return maintain.retagged_adult(feed_events(spark, sf_dir), venues(spark, sf_dir)).select("id", F.array_join("tags", ",").alias("tags"))


@query("maintain_adult_venues", f"WITH {FEED_SQL}, {VENUES_SQL}, bad AS (SELECT id FROM venues WHERE regexp_matches(name, '\\b(?:{_BRANDS})\\b', 'i') OR {_any_language('name')} OR (regexp_matches(name, '\\b[a-z]{{3,}}\\s+cabaret\\b', 'i') AND lower(name) NOT IN ({_THEATRES}))) SELECT 'event' AS kind, id FROM feed WHERE venue_id IS NULL OR venue_id NOT IN (SELECT id FROM bad) UNION ALL SELECT 'venue', id FROM venues WHERE id NOT IN (SELECT id FROM bad)")
def maintain_adult_venues(spark, sf_dir):
    """M1, J3."""
    events, places = maintain.without_adult_venues(feed_events(spark, sf_dir), venues(spark, sf_dir))
    return events.select(F.lit("event").alias("kind"), "id").union(places.select(F.lit("venue"), "id"))


_GEN = " OR ".join(f"regexp_matches(title, '{p}', 'i')" for p in cl.GENERIC_TITLES if p != r"^\s*\w+\s+night\s*$")
_RULE = "CASE lower(regexp_extract(recurrence_rule, '(?i)^every\\s+([a-z]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN 'every {tw.DAY_NAMES[v]}'" for k, v in tw.WEEKDAYS.items()) + " ELSE recurrence_rule END"


@query(
    "maintain_rules",
    f"""WITH {FEED_SQL} SELECT id, {_RULE} AS recurrence_rule, CASE WHEN end_time - start_time > INTERVAL 12 HOUR AND NOT is_recurring THEN start_time + INTERVAL 3 HOUR ELSE end_time END AS end_time FROM feed
WHERE NOT (source = 'scraped' AND ({_GEN} OR description IS NULL OR length(trim(regexp_replace(description, '^\\s*(recurring|weekly|nightly|special)\\s+event\\.?\\s*$', '', 'i'))) < 24))""",
)
def maintain_rules(spark, sf_dir):
    """M6-M8, X38, X18, X14."""
    own = maintain.capped_ends(maintain.canonical_rules(maintain.without_generic(feed_events(spark, sf_dir))))
    return own.select("id", "recurrence_rule", "end_time")


_CRAWL = """
crawl AS (SELECT v.*, id % 3 AS passed, id % 7 AS found, (id % 5) * 20.0::DOUBLE AS q, id % 6 AS empties, id % 4 AS errs, id % 9 <> 0 AS known, ['ok', 'unchanged', 'error', 'empty'][1 + id % 4] AS outcome FROM venues v)"""


@query(
    "crawl_scores",
    f"""WITH {VENUES_SQL}, {_CRAWL}
SELECT id, CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in score.VENUE_POINTS.items())} ELSE 4 END + CASE WHEN regexp_matches(lower(coalesce(website, '')), '{score.EVENT_SITE}') THEN 16 ELSE 0 END
    + CASE WHEN known THEN least(35, 3 * passed) + least(25.0::DOUBLE, q / 3) - least(40, 10 * empties) - least(45, 15 * errs) ELSE 8 END AS priority,
  CASE WHEN passed > 0 THEN 6.0::DOUBLE WHEN outcome = 'unchanged' AND found > 0 THEN 12 WHEN outcome = 'error' THEN least(168, 6 * pow(2, errs)) ELSE least(168, 12 * pow(2, least(empties, 4))) END AS next_hours,
  CASE WHEN passed > 0 THEN least(100, 55 + least(25, 6 * passed) + CASE WHEN found = passed THEN 5 ELSE 0 END) WHEN found > 0 THEN 35 ELSE 15 END AS quality FROM crawl WHERE website IS NOT NULL""",
)
def crawl_scores(spark, sf_dir):
    """S6, X58-X60."""
    i = F.col("id")
    own = venues(spark, sf_dir).filter("website IS NOT NULL")
    outcome = F.get(F.array(*map(F.lit, ["ok", "unchanged", "error", "empty"])), (i % 4).cast("int"))
    return own.select(
        "id", score.scan_priority(F.col("category"), F.col("website"), i % 3, (i % 5) * F.lit(20.0), i % 6, i % 4, i % 9 != 0).alias("priority"),
        score.next_scan_hours(outcome, i % 3, i % 7, i % 6, i % 4).alias("next_hours"), score.estimated_quality(i % 7, i % 3, F.col("website")).alias("quality"),
    )


@query("stream_rate_limit")
def stream_rate_limit(spark, sf_dir):
    """At most ten allowed calls an hour; denied calls do not count."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("client_id"), F.col("ts").cast("timestamp").alias("called_at"))
    return state.rate_limited(calls, most=3, minutes=600)


# The fold as a recursion over each venue's scans in order.
_HEALTH_SQL = """
WITH RECURSIVE scans AS (
  SELECT user_id % 40 AS venue_id, event_id % 3 * (event_id % 2) AS passed, event_id % 4 AS found, CASE WHEN event_id % 11 = 0 THEN 'error' WHEN event_id % 3 = 0 THEN 'no_signal' ELSE 'ok' END AS outcome,
    CASE WHEN event_id % 11 <> 0 THEN sha1(CAST(event_id // 120 AS VARCHAR)) END AS page_hash, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS nth FROM events
), quality AS (
  SELECT *, CASE WHEN passed > 0 THEN least(100, 55 + least(25, 6 * passed) + 10 + CASE WHEN found = passed THEN 5 ELSE 0 END) WHEN found > 0 THEN 35 ELSE 15 END AS q FROM scans
), health AS (
  SELECT venue_id, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS total_passed, CAST(0 AS BIGINT) AS consecutive_empty, CAST(0 AS BIGINT) AS consecutive_errors, CAST(0 AS DOUBLE) AS avg_quality, CAST(0 AS DOUBLE) AS next_hours, CAST(NULL AS VARCHAR) AS page_hash, CAST(0 AS BIGINT) AS last_passed
  FROM (SELECT DISTINCT venue_id FROM scans)
  UNION ALL
  SELECT venue_id, nth, total_passed + p, CASE WHEN p > 0 THEN 0 WHEN outcome = 'error' THEN consecutive_empty ELSE consecutive_empty + 1 END, CASE WHEN outcome = 'error' THEN consecutive_errors + 1 ELSE 0 END,
    floor((CASE WHEN avg_quality > 0 THEN (avg_quality * (nth - 1) + bq) / nth ELSE bq END) * 100 + 0.5::DOUBLE) / 100,
    CASE WHEN p > 0 THEN 6 WHEN same AND last_passed > 0 THEN 12 WHEN outcome = 'error' THEN least(168, 6 * pow(2, consecutive_errors)) ELSE least(168, 12 * pow(2, least(consecutive_empty, 4))) END,
    coalesce(page_hash, last_hash), p
  FROM (
    SELECT s.venue_id, s.nth, s.outcome, s.page_hash, h.page_hash AS last_hash, h.total_passed, h.consecutive_empty, h.consecutive_errors, h.avg_quality, h.last_passed,
      coalesce(s.outcome <> 'error' AND s.page_hash = h.page_hash, false) AS same, CAST(CASE WHEN s.outcome = 'ok' AND NOT coalesce(s.page_hash = h.page_hash, false) THEN s.passed ELSE 0 END AS BIGINT) AS p,
      CAST(CASE WHEN s.outcome = 'ok' AND NOT coalesce(s.page_hash = h.page_hash, false) THEN s.q ELSE 15 END AS DOUBLE) AS bq
    FROM health h JOIN quality s ON s.venue_id = h.venue_id AND s.nth = h.nth + 1
  )
)
SELECT venue_id, nth AS total_scans, total_passed, consecutive_empty, consecutive_errors, avg_quality, next_hours, page_hash FROM health QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY nth DESC) = 1
"""


@query("stream_crawl_health", _HEALTH_SQL)
def stream_crawl_health(spark, sf_dir):
    """Crawl state after each venue's scans, changed pages told by their hashes."""
    i = F.col("event_id")
    scans = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).alias("venue_id"), i.alias("seq"), (i % 3 * (i % 2)).alias("passed"), (i % 4).alias("found"),
        F.when(i % 11 == 0, "error").when(i % 3 == 0, "no_signal").otherwise("ok").alias("outcome"), F.when(i % 11 != 0, F.sha1(F.floor(i / 120).cast("string").cast("binary"))).alias("page_hash"), F.lit("https://v.example.com/events").alias("source_url"),
    )
    return state.crawl_health(scans)


@query("stream_sync_cooldown", "WITH s AS (SELECT event_id AS id, 'g' || CAST(user_id % 30 AS VARCHAR) AS grid_key, CAST(ts AS TIMESTAMP) AS t, event_id % 25 AS event_count, lag(CAST(ts AS TIMESTAMP)) OVER w AS last_at, lag(event_id % 25) OVER w AS last_count FROM events WINDOW w AS (PARTITION BY user_id % 30 ORDER BY CAST(ts AS TIMESTAMP), event_id)) SELECT id, coalesce((last_count >= 20 AND t < last_at + INTERVAL 2 HOUR) OR (last_count BETWEEN 1 AND 19 AND t < last_at + INTERVAL 15 MINUTE), false) AS cooling FROM s")
def stream_sync_cooldown(spark, sf_dir):
    """Whether a cell still rests after its last sync."""
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("g"), (F.col("user_id") % 30).cast("string")).alias("grid_key"), F.col("ts").cast("timestamp").alias("synced_at"), (F.col("event_id") % 25).alias("event_count"))
    return state.with_cooldown(own).select("id", "cooling")


@query("stream_sessions")
def stream_sessions(spark, sf_dir):
    """The refresh state machine folded over each session's actions."""
    i = F.col("event_id")
    kinds = ["START", "COOLDOWN_RESULT", "STATUS", "FOUND_EVENT", "STREAM_DONE", "RANK_RESULT", "ERROR", "CANCEL"]
    actions = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), i.alias("seq"), F.get(F.array(*map(F.lit, kinds)), (i % 8).cast("int")).alias("type"), (i % 3 == 0).alias("user_allowed"), (i % 5 == 0).alias("cell_fresh"),
        F.lit("s").alias("text"), F.lit("m").alias("message"),
    )
    return state.refresh_states(actions)


_HEALTH = f"""
placed AS (SELECT *, {ORIGIN[0]}::DOUBLE + (id % 11 - 5) * 0.02::DOUBLE AS lat, {ORIGIN[1]}::DOUBLE + (id % 7 - 3) * 0.01::DOUBLE AS lng FROM venues WHERE website IS NOT NULL),
health AS (SELECT id AS venue_id, id % 3 AS total_events_passed, (id % 5) * 20.0::DOUBLE AS avg_quality_score, id % 6 AS consecutive_empty, id % 4 AS consecutive_errors,
  CASE WHEN id % 10 <> 1 THEN {TS} + INTERVAL 1 HOUR * (id % 5 - 3) END AS next_scan_at FROM venues WHERE id % 9 <> 0)"""


def _health(spark, sf_dir):
    """Places with websites and coordinates, and the scan health of most of them."""
    own, i = venues(spark, sf_dir), F.col("id")
    placed = own.filter("website IS NOT NULL").withColumns({"lat": F.lit(ORIGIN[0]) + (i % 11 - 5) * F.lit(0.02), "lng": F.lit(ORIGIN[1]) + (i % 7 - 3) * F.lit(0.01)})
    health = own.filter("id % 9 <> 0").select(
        i.alias("venue_id"), (i % 3).alias("total_events_passed"), (i % 5 * F.lit(20.0)).alias("avg_quality_score"), (i % 6).alias("consecutive_empty"), (i % 4).alias("consecutive_errors"),
        F.when(i % 10 != 1, now_column() + F.expr("INTERVAL '1' HOUR") * (i % 5 - 3)).alias("next_scan_at"),
    )
    return placed, health


@query(
    "scan_due",
    f"""WITH {VENUES_SQL}, {_HEALTH}, bad AS (SELECT id FROM venues WHERE regexp_matches(name, '\\b(?:{_BRANDS})\\b', 'i') OR {_any_language('name')} OR (regexp_matches(name, '\\b[a-z]{{3,}}\\s+cabaret\\b', 'i') AND lower(name) NOT IN ({_THEATRES})))
SELECT id, round(CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in score.VENUE_POINTS.items())} ELSE 4 END + CASE WHEN regexp_matches(lower(website), '{score.EVENT_SITE}') THEN 16 ELSE 0 END
  + CASE WHEN venue_id IS NULL THEN 8 ELSE least(35, 3 * total_events_passed) + least(25.0::DOUBLE, avg_quality_score / 3) - least(40, 10 * consecutive_empty) - least(45, 15 * consecutive_errors) END, 6) AS priority
FROM placed p LEFT JOIN health h ON p.id = h.venue_id
WHERE p.id NOT IN (SELECT id FROM bad) AND abs(lat - {ORIGIN[0]}) < 5.0 / 69 AND abs(lng - {ORIGIN[1]}) < 5.0 / 69 AND (next_scan_at IS NULL OR next_scan_at <= {TS})
ORDER BY priority DESC, id LIMIT 18""",
)
def scan_due(spark, sf_dir):
    """Places due for a scan, best first, within the budget (18 where fast sources gave forty events)."""
    placed, health = _health(spark, sf_dir)
    return scans.due(placed, health, ORIGIN, 5.0, now_column(), scans.budget(fast_events=45, thin=False)).select("id", F.round("priority", 6).alias("priority"))


@query("sync_latest", "SELECT event_id AS id FROM events WHERE user_id % 30 = 3 OR event_id % 20 = 4 ORDER BY CAST(ts AS TIMESTAMP) DESC, event_id DESC LIMIT 1")
def sync_latest(spark, sf_dir):
    """The newest sync of a cell by geohash or grid key."""
    i = F.col("event_id")
    syncs = table(spark, sf_dir, "events").select(i.alias("id"), F.concat(F.lit("g"), (F.col("user_id") % 30).cast("string")).alias("grid_key"), F.concat(F.lit("cell"), (i % 20).cast("string")).alias("geohash"), F.col("ts").cast("timestamp").alias("synced_at"))
    return scans.latest_sync(syncs, "cell4", "g3").select("id")


@query("maintain_rate_limits", f"SELECT event_id AS id FROM events WHERE CAST(ts AS TIMESTAMP) >= {TS} - INTERVAL 1 HOUR")
def maintain_rate_limits(spark, sf_dir):
    """Calls that the purge leaves."""
    calls = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("called_at"))
    return maintain.recent_calls(calls, now_column()).select("id")


@query(
    "reminders_reconciled",
    f"""WITH {TIMED_SQL}, saved AS (SELECT * FROM timed WHERE category IN ('music', 'food')), planned AS (SELECT id FROM timed WHERE category IN ('food', 'arts'))
SELECT id, 'cancel' AS action FROM planned WHERE id NOT IN (SELECT id FROM saved) UNION ALL SELECT id, 'schedule' FROM saved WHERE id NOT IN (SELECT id FROM planned) AND eff_start > {TS}""",
)
def reminders_reconciled(spark, sf_dir):
    """Reminders to cancel and to schedule."""
    own = timed(spark, sf_dir)
    saved, planned = own.filter("category IN ('music', 'food')"), own.filter("category IN ('food', 'arts')").select("id")
    return feed.reconciled_reminders(saved, planned, now_column())
