"""Queries of images, preferences, feedback, saved events, rating prompts and page changes, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import images
from eventloom.operators import profile, scans
from eventloom.plans.feed_queries import _TAGS, TIMED_SQL, TS, now_column, timed
from eventloom.plans.views import FEED_SQL, feed_events, pick, sql_pick, sql_text, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


def _list(values) -> str:
    return "[" + ", ".join(map(sql_text, values)) + "]::VARCHAR[]"


def _url(photo: str) -> str:
    return sql_text(images.PHOTO.format(photo))


_CROWD = "category IN ('nightlife', 'community')"
_TAG_PHOTO = "CASE t " + " ".join(f"WHEN '{t}' THEN {_url(images.SUBCATEGORIES[k])}" for t, k in images.TAGS.items()) + " END"
_USABLE = f"list_filter({_TAGS}, lambda x: list_contains({_list(images.TAGS)}, x) AND NOT ({_CROWD} AND x IN ('date-night', 'couples')))"
_STRONG = f"list_filter(CASE WHEN {_CROWD} THEN ['singles', 'live-music', 'happy-hour'] ELSE ['date-night', 'couples', 'singles'] END, lambda x: list_contains({_USABLE}, x))"


@query(
    "feed_images",
    f"""WITH {FEED_SQL}, texts AS (SELECT *, lower(coalesce(title, '') || ' ' || coalesce(description, '') || ' ') AS x, coalesce(({_STRONG})[1], ({_USABLE})[1]) AS t FROM feed)
SELECT id, coalesce(nullif(image_url, ''), CASE {" ".join("WHEN " + " OR ".join(f"contains(x, {sql_text(w)})" for w in words) + f" THEN {_url(images.SUBCATEGORIES[k])}" for words, k in images.WORDS)} END,
  CASE subcategory {" ".join(f"WHEN '{k}' THEN {_url(p)}" for k, p in images.SUBCATEGORIES.items())} END, {_TAG_PHOTO},
  CASE category {" ".join(f"WHEN '{k}' THEN {_url(p)}" for k, p in images.CATEGORIES.items())} ELSE {_url(images.CATEGORIES["community"])} END) AS image FROM texts""",
)
def feed_images(spark, sf_dir):
    """The image of every event."""
    return images.with_image(feed_events(spark, sf_dir)).select("id", "image")


_GOAL_NAMES = list(profile.START_GOALS)
_ANSWERS = {
    "budget": ["free", "budget", None, "premium"],
    "blocker": ["too-expensive", "no-one", None],
    "social": ["solo", "friends", None, "date", "group"],
    "happy_hour": ["hide", "show", None, "love", "fine", "hide", "show"],
}


def _answers(spark, sf_dir):
    i = F.col("event_id")
    goals = F.array_compact(F.array(*[F.when(i % n == 0, F.lit(g)) for n, g in enumerate(_GOAL_NAMES, 2)]))
    given = [pick(values, i).alias(name) for name, values in _ANSWERS.items()]
    return table(spark, sf_dir, "events").select(i.alias("user_id"), F.when(i % 13 != 0, goals).alias("goals"), *given)


_ANSWERS_SQL = f"""answers AS (SELECT event_id AS user_id, CASE WHEN event_id % 13 <> 0 THEN list_filter([{", ".join(f"CASE WHEN event_id % {n} = 0 THEN '{g}' END" for n, g in enumerate(_GOAL_NAMES, 2))}], lambda x: x IS NOT NULL) END AS goals,
  {", ".join(f"{sql_pick(values, 'event_id')} AS {name}" for name, values in _ANSWERS.items())} FROM events)"""


def _ordered(entries: list[tuple[str, str]]) -> str:
    """First occurrence of each word among the lists whose conditions hold."""
    words = list(dict.fromkeys(w for w, _ in entries))
    first = "least(" + "{})"
    at = {w: first.format(", ".join(f"CASE WHEN {c} THEN {n} ELSE 999 END" for n, (v, c) in enumerate(entries) if v == w) + ", 999") for w in words}
    pairs = ", ".join(f"{{'n': {at[w]}, 'w': '{w}'}}" for w in words)
    return f"array_to_string(list_transform(list_sort(list_filter([{pairs}], lambda p: p.n < 999)), lambda p: p.w), ',')"


_HAS = "coalesce(list_contains(goals, '{}'), false)"
_PREF_TAGS = [(t, _HAS.format(g)) for g, (own, _) in profile.START_GOALS.items() for t in own]
_PREF_TAGS += [("free", "coalesce(budget = 'free', false)"), ("free", "coalesce(blocker = 'too-expensive', false)"), ("singles", f"(coalesce(social = 'solo', false) OR {_HAS.format('find-partner')})")]
_PREF_CATEGORIES = [(c, _HAS.format(g)) for g, (_, own) in profile.START_GOALS.items() for c in own] + [("community", "coalesce(social = 'solo', false)")]


@query("user_preferences", f"WITH {_ANSWERS_SQL} SELECT user_id, {_ordered(_PREF_TAGS)} AS tags, {_ordered(_PREF_CATEGORIES)} AS categories, CAST(10 AS INTEGER) AS radius, coalesce(happy_hour <> 'hide', true) AS happy_hour_enabled FROM answers")
def user_preferences(spark, sf_dir):
    """Preferences from the answers given at the start."""
    own = profile.preferences(_answers(spark, sf_dir))
    return own.select("user_id", F.array_join("tags", ",").alias("tags"), F.array_join("categories", ",").alias("categories"), "radius", "happy_hour_enabled")


@query("user_profiles", f"WITH {_ANSWERS_SQL} SELECT user_id AS id, array_to_string(coalesce(goals, []), ',') AS goals, len(coalesce(goals, [])) AS n_goals, 0 AS n_hidden, social, coalesce(happy_hour, 'true') AS happy_hour, CAST(NULL AS DOUBLE) AS default_lat, {TS} AS updated_at FROM answers")
def user_profiles(spark, sf_dir):
    """Profile rows of preferences, with defaults."""
    none = F.lit(None).cast("string")
    given = profile.preferences(_answers(spark, sf_dir)).withColumns({"vibe": none, "schedule": none, "hidden_categories": F.lit(None).cast("array<string>"), "hidden_tags": F.lit(None).cast("array<string>"), "lat": F.lit(None).cast("double"), "lng": F.lit(None).cast("double")})
    own = profile.profile_rows(given, now_column())
    return own.select("id", F.array_join("goals", ",").alias("goals"), F.size("goals").cast("long").alias("n_goals"), (F.size("hidden_tags") + F.size("hidden_categories")).alias("n_hidden"), "social", "happy_hour", "default_lat", "updated_at")


_TOLD = "SELECT ['loved', 'ok', 'missed', 'loved'][1 + id % 4] AS status, category, coalesce(tags, []) AS tags FROM feed WHERE source IN ('meetup', 'claude')"


@query(
    "feed_feedback_bias",
    f"""WITH {FEED_SQL}, told AS (SELECT status, category, list_sort(tags) AS tags, count(*) AS n FROM ({_TOLD}) WHERE status <> 'ok' GROUP BY ALL), shown AS (SELECT DISTINCT category, {_TAGS} AS tags FROM feed),
bias AS (SELECT s.category, s.tags, sum(n * CASE WHEN t.status = 'loved' THEN 1 ELSE -1 END * (CASE WHEN t.category = s.category THEN 1 ELSE 0 END + least(2, len(list_filter(t.tags, lambda x: list_contains(s.tags, x)))))) AS bias FROM shown s, told t GROUP BY ALL)
SELECT id, CAST(coalesce(bias, 0) AS BIGINT) AS bias FROM feed f LEFT JOIN bias b ON f.category = b.category AND coalesce(f.tags, []) = b.tags""",
)
def feed_feedback_bias(spark, sf_dir):
    """Every event against the feedback on others."""
    own = feed_events(spark, sf_dir)
    told = own.filter("source IN ('meetup', 'claude')").select(pick(["loved", "ok", "missed", "loved"], F.col("id")).alias("status"), "category", "tags")
    return profile.feedback_bias(own, told).select("id", F.col("bias").cast("long").alias("bias"))


@query("feed_random_pick", f"WITH {FEED_SQL} SELECT id FROM feed ORDER BY md5('lucky:' || CAST(id AS VARCHAR)), id LIMIT 1")
def feed_random_pick(spark, sf_dir):
    """One event by chance."""
    return profile.random_pick(feed_events(spark, sf_dir), "lucky").select("id")


def _sections_sql(mode: str) -> str:
    ahead = "'UPCOMING'" if mode != "upcoming" else f"CASE WHEN eff_start < date_trunc('day', {TS}) + INTERVAL 7 DAY THEN 'GOING SOON' ELSE 'THINKING ABOUT IT' END"
    asks = " || ' — DID YOU GO?'" if mode == "upcoming" else ""
    return f"""SELECT '{mode}' AS mode, id, list_position({_list(profile.SECTIONS[mode])}, section) AS section_no,
    CASE section WHEN 'MISSED' THEN section || ' (' || count(*) OVER w || ')'{asks} WHEN 'WENT' THEN section || ' (' || count(*) OVER w || ')' ELSE section END AS title,
    row_number() OVER (PARTITION BY section ORDER BY CASE WHEN past THEN -epoch_us(eff_start) ELSE epoch_us(eff_start) END, pos) AS place
  FROM (SELECT *, CASE WHEN NOT past THEN {ahead} WHEN status IN ('loved', 'ok') THEN 'WENT' ELSE 'MISSED' END AS section FROM saved) WHERE list_contains({_list(profile.SECTIONS[mode])}, section) WINDOW w AS (PARTITION BY section)"""


@query(
    "saved_sections",
    f"WITH {TIMED_SQL}, saved AS (SELECT *, coalesce(eff_start < {TS}, false) AS past, CASE WHEN id % 3 <> 0 THEN ['loved', 'ok', 'missed'][1 + id % 5 % 3] END AS status FROM timed WHERE category IN ('music', 'food'))\n"
    + "\nUNION ALL ".join(map(_sections_sql, profile.SECTIONS)),
)
def saved_sections(spark, sf_dir):
    """U4: saved events in the sections of each mode."""
    saved = timed(spark, sf_dir).filter("category IN ('music', 'food')")
    told = saved.filter("id % 3 <> 0").select("id", pick(["loved", "ok", "missed"], F.col("id") % 5).alias("status"))
    parts = [profile.saved_sections(saved, told, mode, now_column()).select(F.lit(mode).alias("mode"), "id", "section_no", "title", "place") for mode in profile.SECTIONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RATINGS = ["pending", "rated", None, "feedback_sent", "dismissed", None]


@query(
    "rating_prompts",
    f"""WITH users AS (SELECT DISTINCT user_id FROM events), ratings AS (SELECT user_id, {sql_pick(_RATINGS, "user_id")} AS state, CASE WHEN user_id % 3 = 0 THEN {TS} - INTERVAL 1 HOUR * (user_id % 300) END AS shown,
  CASE WHEN user_id % 7 = 0 THEN {TS} - INTERVAL 1 HOUR * (user_id * 41 % 97) END AS put_off FROM users),
week AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS days FROM events WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) >= {TS} - INTERVAL 7 DAY GROUP BY user_id)
SELECT user_id, CASE WHEN coalesce(state IN ('rated', 'feedback_sent'), false) THEN 'none' WHEN put_off <= {TS} - INTERVAL 48 HOUR THEN 'delayed' WHEN days >= 3 AND coalesce(shown <= {TS} - INTERVAL 7 DAY, true) THEN 'streak' ELSE 'none' END AS prompt
FROM ratings LEFT JOIN week USING (user_id)""",
)
def rating_prompts(spark, sf_dir):
    """Whom to ask for a rating now."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    ago = lambda n: now_column() - F.expr("INTERVAL '1' HOUR") * n
    ratings = e.select("user_id").distinct().select("user_id", pick(_RATINGS, u).alias("state"), F.when(u % 3 == 0, ago(u % 300)).alias("streak_shown_at"), F.when(u % 7 == 0, ago(u * 41 % 97)).alias("dismissed_at"))
    days = e.select("user_id", F.to_date(F.col("ts").cast("timestamp")).alias("day"))
    return profile.rating_prompts(ratings, days, now_column()).select("user_id", "prompt")


@query(
    "scan_page_changes",
    """WITH log AS (SELECT event_id AS seq, user_id % 40 AS venue_id, event_id % 3 AS passed, event_id % 4 AS found, CASE WHEN event_id % 11 = 0 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id // 400 AS VARCHAR) END AS page_hash FROM events),
marked AS (SELECT *, coalesce(outcome <> 'error' AND page_hash = last_value(page_hash IGNORE NULLS) OVER (PARTITION BY venue_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS same FROM log)
SELECT seq, CASE WHEN same THEN 'unchanged' ELSE outcome END AS outcome, CASE WHEN same THEN 0 ELSE found END AS found, CASE WHEN same THEN 0 ELSE passed END AS passed FROM marked""",
)
def scan_page_changes(spark, sf_dir):
    """T5: scans whose page is the one read last."""
    i = F.col("event_id")
    log = table(spark, sf_dir, "events").select(
        i.alias("seq"), (F.col("user_id") % 40).alias("venue_id"), (i % 3).alias("passed"), (i % 4).alias("found"), F.when(i % 11 == 0, "error").otherwise("ok").alias("outcome"),
        F.when(i % 11 != 0, F.floor(i / 400).cast("string")).alias("page_hash"),
    )
    return scans.unchanged_pages(log).select("seq", "outcome", "found", "passed")
