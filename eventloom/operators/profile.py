"""A user's side of the feed: preferences, feedback, saved events and rating prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import timewin as tw

# Tags and categories of the goals asked for at the start, and tags of answers about budget and obstacle.
START_GOALS = {
    "meet-people": (["social"], ["community", "nightlife"]),
    "find-partner": (["date-night"], ["nightlife", "food", "arts"]),
    "get-active": (["active"], ["sports", "fitness"]),
    "drinks-nightlife": (["drinking", "21+"], ["nightlife", "food"]),
    "live-music": (["live-music"], ["music"]),
    "try-food": (["food"], ["food"]),
    "explore-arts": ([], ["arts", "movies"]),
    "family-fun": (["family", "all-ages"], ["community", "outdoors"]),
    "outdoor-fun": (["outdoor"], ["outdoors", "fitness"]),
}
BUDGET_TAGS = {"free": ["free"]}
BLOCKER_TAGS = {"too-expensive": ["free"]}
START_RADIUS = 10


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _if(condition: Column, values: list[str]) -> Column:
    return F.when(condition, _words(values)).otherwise(_words([]))


def preferences(answers: DataFrame) -> DataFrame:
    """Add tags, categories, radius and happy_hour_enabled derived from (goals, budget, blocker, social, happy_hour).

    Both lists follow the order of the goals above, not of the answers; a null answer is none.
    """
    goals = F.coalesce(F.col("goals"), _words([]))
    has = {g: F.array_contains(goals, g) for g in START_GOALS}
    answer = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    solo = answer("social", "solo")
    tags = [_if(has[g], own) for g, (own, _) in START_GOALS.items()]
    tags += [_if(answer(c, v), own) for c, by in (("budget", BUDGET_TAGS), ("blocker", BLOCKER_TAGS)) for v, own in by.items()]
    tags.append(_if(solo | has["find-partner"], ["singles"]))
    categories = [*(_if(has[g], own) for g, (_, own) in START_GOALS.items()), _if(solo, ["community"])]
    return answers.withColumns(
        {
            "tags": F.array_distinct(F.concat(*tags)), "categories": F.array_distinct(F.concat(*categories)), "radius": F.lit(START_RADIUS),
            "happy_hour_enabled": ~answer("happy_hour", "hide"),
        }
    )


def profile_rows(prefs: DataFrame, now: Column) -> DataFrame:
    """Preferences as profile rows keyed by id: lists that are null become empty, a null wish for happy hours is yes."""
    lists = [F.coalesce(F.col(c), _words([])).alias(c) for c in ("goals", "categories", "tags", "hidden_categories", "hidden_tags")]
    happy = F.coalesce(F.col("happy_hour"), F.lit("true")).alias("happy_hour")
    place = [F.col("lat").alias("default_lat"), F.col("lng").alias("default_lng")]
    return prefs.select(F.col("user_id").alias("id"), *lists, "vibe", "social", "schedule", "blocker", "budget", happy, *place, now.alias("updated_at"))


def feedback_bias(candidates: DataFrame, feedback: DataFrame) -> DataFrame:
    """Add ``bias``: for each loved event of the feedback (status, category, tags), plus one for an equal category
    and one for each common tag, at most two; minus that for a missed one.

    The category's part is a sum per category. For the tags, equal lists count together:
    only different lists meet, and only over a tag that both have. A tag that a feedback
    row repeats counts as often. Null or empty categories and tags match nothing.
    """
    weight = F.when(F.col("status") == "loved", 1).when(F.col("status") == "missed", -1)
    told = feedback.select(weight.alias("w"), F.nullif(F.col("category"), F.lit("")).alias("category"), F.array_sort("tags").alias("f_tags")).filter("w IS NOT NULL")
    by_category = told.filter("category IS NOT NULL").groupBy("category").agg(F.sum("w").alias("__by_category"))
    liked = told.groupBy("f_tags").agg(F.sum("w").alias("w")).filter("w <> 0").withColumn("tag", F.explode("f_tags"))
    keyed = candidates.withColumn("__tags", F.array_sort(F.array_distinct("tags")))
    shown = keyed.select("__tags").distinct().withColumn("tag", F.explode("__tags"))
    pairs = shown.join(liked, "tag").groupBy("__tags", "f_tags").agg(F.least(F.lit(2), F.count(F.lit(1))).alias("n"), F.first("w").alias("w"))
    by_tags = pairs.groupBy("__tags").agg(F.sum(F.col("n") * F.col("w")).alias("__by_tags"))
    bias = F.coalesce(F.col("__by_category"), F.lit(0)) + F.coalesce(F.col("__by_tags"), F.lit(0))
    return keyed.join(by_category, "category", "left").join(by_tags, "__tags", "left").withColumn("bias", bias).drop("__tags", "__by_category", "__by_tags")


def random_pick(events: DataFrame, seed: str) -> DataFrame:
    """One event, each as likely, the same for the same seed; none of an empty table."""
    return events.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id").cast("string"))), "id").limit(1)


# Sections of each way to show saved events, in order.
SECTIONS = {"all": ["UPCOMING", "WENT", "MISSED"], "past": ["WENT", "MISSED"], "upcoming": ["GOING SOON", "THINKING ABOUT IT", "MISSED", "WENT"]}


def saved_sections(saved: DataFrame, feedback: DataFrame, mode: str, now: Column, tz: str = "UTC", owner: str | None = None) -> DataFrame:
    """Saved events with section, section_no, title and place: what comes by start, what is past latest first.

    Past events with feedback (id, status) loved or ok were gone to, the rest missed;
    without a start an event is still to come. ``owner`` names the column of the user
    where many users' lists are given (then feedback has it too).
    """
    keys = [owner, "id"] if owner else ["id"]
    went = feedback.filter(F.col("status").isin("loved", "ok")).select(*keys).distinct().withColumn("__went", F.lit(True))
    past = F.col("start_time").isNotNull() & F.coalesce(F.col("eff_start") < now, F.lit(False))
    today = F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(now, tz)), tz)
    ahead = F.lit("UPCOMING") if mode != "upcoming" else F.when(F.col("eff_start") < today + tw.hours(7 * 24), "GOING SOON").otherwise("THINKING ABOUT IT")
    order = F.array(*map(F.lit, SECTIONS[mode]))
    own = saved.join(went, keys, "left").withColumn("__past", past)
    own = own.withColumn("section", F.when(F.col("__past"), F.when(F.col("__went"), "WENT").otherwise("MISSED")).otherwise(ahead))
    own = own.withColumn("section_no", F.array_position(order, F.col("section")).cast("int")).filter("section_no > 0")
    of_section = Window.partitionBy(*([owner] if owner else []), "section")
    micros = F.unix_micros("eff_start")
    by_start = of_section.orderBy(F.when(F.col("__past"), -micros).otherwise(micros), "pos")
    counted = F.concat(F.col("section"), F.lit(" ("), F.count(F.lit(1)).over(of_section).cast("string"), F.lit(")"))
    asks = F.concat(counted, F.lit(" — DID YOU GO?")) if mode == "upcoming" else counted
    title = F.when(F.col("section") == "MISSED", asks).when(F.col("section") == "WENT", counted).otherwise(F.col("section"))
    return own.withColumns({"title": title, "place": F.row_number().over(by_start)}).drop("__went", "__past")


# States in which nothing is asked any more.
DONE_RATING = ["rated", "feedback_sent"]


def rating_prompts(ratings: DataFrame, days: DataFrame, now: Column) -> DataFrame:
    """Ratings (user_id, state, streak_shown_at, dismissed_at) with ``prompt``: delayed, streak or none.

    A rating is pending unless its state is ``rated`` or ``feedback_sent``; a user without
    a state has not rated. Only a pending rating is asked for: again from 48 hours after it was put off, else on
    three different days (user_id, day) of which none began over seven days ago, unless
    that was shown within seven days.
    """
    of_week = days.filter(F.col("day").cast("timestamp") >= now - tw.hours(7 * 24)).groupBy("user_id").agg(F.countDistinct("day").alias("__days"))
    pending = F.coalesce(~F.col("state").isin(DONE_RATING), F.lit(True))
    delayed = pending & (F.col("dismissed_at") <= now - tw.hours(48))
    rested = F.coalesce(F.col("streak_shown_at") <= now - tw.hours(7 * 24), F.lit(True))
    streak = pending & (F.col("__days") >= 3) & rested
    return ratings.join(of_week, "user_id", "left").withColumn("prompt", F.when(delayed, "delayed").when(streak, "streak").otherwise("none")).drop("__days")
