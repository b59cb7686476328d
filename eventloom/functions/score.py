"""Scores and matching rules of the feed, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.functions import timewin as tw

# Points per source, goals and moods.
SOURCE_POINTS = {
    "ticketmaster": 35, "meetup": 32, "university": 30, "espn": 28, "pickleheads": 28,
    "highschool": 22, "scraped": 20, "claude": 20, "reddit": 16, "community": 12,
}
GOALS = {
    "meet-people": (["social"], ["community", "nightlife"]),
    "find-partner": (["singles", "date-night"], ["nightlife", "food", "arts"]),
    "get-active": (["active"], ["sports", "fitness"]),
    "drinks-nightlife": (["drinking", "21+"], ["nightlife", "food"]),
    "live-music": (["live-music"], ["music"]),
    "try-food": ([], ["food"]),
    "explore-arts": ([], ["arts", "movies"]),
    "family-fun": (["family", "all-ages"], ["community", "outdoors"]),
    "outdoor-fun": (["outdoor"], ["outdoors", "fitness"]),
}
MOODS = {
    "any": ([], [], ""),
    "play": (["sports", "fitness", "outdoors"], ["active", "outdoor"], "pickleball|basketball|soccer|volleyball|tennis|run club|running|yoga|pickup"),
    "drinks": (["nightlife", "food"], ["drinking", "21+"], "happy hour|brewery|cocktail|wine|beer|bar|tasting"),
    "party": (["nightlife", "music"], ["late-night", "drinking", "live-music", "21+"], "dj|dance|club|party|latin night|salsa|bachata|late night"),
    "meet": (["community", "nightlife", "sports", "fitness"], ["singles", "date-night", "active"], "singles|mixer|trivia|game night|open mic|meetup|social"),
    "cheap": ([], ["free"], ""),
    "hidden": (["arts", "community", "movies", "outdoors"], ["live-music", "outdoor"], "popup|pop-up|gallery|festival|comedy|open mic|market|workshop|oddities"),
}


def tags() -> Column:
    """The event's tags, never null."""
    return F.coalesce(F.col("tags"), F.array().cast("array<string>"))


def has_tag(*names: str) -> Column:
    return F.arrays_overlap(tags(), F.array(*map(F.lit, names))) if names else F.lit(False)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def source_quality() -> Column:
    """Points of source, links, image, description, venue and kind."""
    known = F.element_at(F.create_map(*[F.lit(x) for pair in SOURCE_POINTS.items() for x in pair]), F.col("source"))
    n = F.length(text_or_empty("description"))
    points = lambda c, yes, no=0: F.when(c, yes).otherwise(no)
    return (
        F.coalesce(known, F.lit(10))
        + points(F.col("source_url").isNotNull(), 8)
        + points(F.col("image_url").isNotNull(), 8)
        + F.when(n >= 80, 8).when(n >= 32, 4).otherwise(-8)
        + points(F.col("venue_id").isNotNull(), 5)
        + points(F.col("is_recurring"), -3, 4)
    )


def happy_hour() -> Column:
    words = F.lower(F.concat(F.col("title"), F.lit(" "), text_or_empty("subcategory")))
    return has_tag("happy-hour", "happy_hour") | words.contains("happy hour") | words.contains("happyhour")


def goal_score(goals: list[str]) -> Column:
    """Three points per matching tag and two per matching category of each goal; singles count ten more for a partner."""
    score = F.lit(0)
    for goal in goals:
        own_tags, categories = GOALS.get(goal, ([], []))
        for t in own_tags:
            score = score + F.when(F.array_contains(tags(), t), 3).otherwise(0)
        for c in categories:
            score = score + F.when(F.col("category") == c, 2).otherwise(0)
    if "find-partner" in goals:
        score = score + F.when(F.array_contains(tags(), "singles"), 10).otherwise(0)
    return score


def event_text() -> Column:
    return F.lower(F.concat_ws(" ", F.col("title"), text_or_empty("description"), text_or_empty("subcategory"), F.array_join(tags(), " ")))


def matches_mood(mood: str) -> Column:
    if mood == "any" or mood not in MOODS:
        return F.lit(True)
    categories, own_tags, pattern = MOODS[mood]
    if mood == "cheap":
        return F.coalesce(F.col("is_free"), F.lit(False)) | has_tag("free") | event_text().contains("free ")
    return F.col("category").isin(categories) | has_tag(*own_tags) | event_text().rlike(pattern)


def mood_score(mood: str) -> Column:
    if mood == "any" or mood not in MOODS:
        return F.lit(0)
    categories, own_tags, _ = MOODS[mood]
    in_category = F.col("category").isin(categories) if categories else F.lit(False)
    hits = F.size(F.filter(tags(), lambda t: t.isin(own_tags)))
    return F.when(in_category, 12).otherwise(0) + 8 * hits + F.when(matches_mood(mood), 5).otherwise(0)


def urgency(now: Column, mood: str, tz: str = "UTC") -> Column:
    """How much an event asks for attention now; ``distance`` may be null."""
    minutes = tw.rounded((F.unix_micros("eff_start") - F.unix_micros(now)) / F.lit(60_000_000))
    soon = (
        F.when(tw.is_live(now), 120)
        .when(minutes.between(0, 60), 95)
        .when(minutes <= 180, 72)  # negative minutes too, as they always did
        .when(minutes <= 360, 48)
        .when(tw.is_tonight(now, tz), 28)
        .otherwise(0)
    )
    near = F.coalesce(F.greatest(F.lit(0.0), 24 - F.col("distance") * 2), F.lit(0.0))
    source = F.when(F.col("source").isin("ticketmaster", "meetup", "university"), 8).when(F.col("source").isin("scraped", "claude"), 4).otherwise(0)
    return mood_score(mood) + soon + near + source + F.when(F.col("is_free"), 5).otherwise(0) + F.when(F.coalesce(F.col("image_url"), F.lit("")) != "", 3).otherwise(0)


def hero_score(goals: list[str], now: Column) -> Column:
    """Score of the one event shown first; null for adult or past events."""
    score, matched = F.lit(0), F.lit(0)
    for goal in goals:
        own_tags, categories = GOALS.get(goal, ([], []))
        hits = F.size(F.array_intersect(tags(), F.array(*map(F.lit, own_tags)))) if own_tags else F.lit(0)
        in_category = F.when(F.col("category").isin(categories), 1).otherwise(0) if categories else F.lit(0)
        score = score + hits * 5 + in_category * 2
        matched = matched + F.when(hits + in_category > 0, 1).otherwise(0)
    score = score + F.when(matched >= 2, 12).otherwise(0) + F.when(matched >= 3, 6).otherwise(0)
    if "find-partner" in goals:
        score = score + F.when(has_tag("singles"), 15).otherwise(0)
    if not {"drinks-nightlife", "find-partner", "live-music"} & set(goals):
        score = score - F.when(has_tag("21+"), 18).otherwise(0)
    if goals and "family-fun" not in goals:
        score = score - F.when(has_tag("family"), 8).otherwise(0)
    days = (F.unix_micros("eff_start") - F.unix_micros(now)) / F.lit(86_400_000_000)
    recency = F.when(days < 1, 10).when(days < 2, 7).when(days < 4, 5).when(days < 7, 2).when(days > 14, -5).otherwise(0)
    return F.when(~has_tag("adult") & (days >= 0), score + recency)


def match_percent(score: Column) -> Column:
    return F.least(F.lit(97), 78 + tw.rounded(F.greatest(F.lit(0), score) * 0.5))


# Points per venue category and paths that hint at events.
VENUE_POINTS = {"venue": 30, "bar": 26, "theater": 24, "club": 22, "restaurant": 18, "park": 16, "gym": 14, "cinema": 12, "stadium": 10, "other": 4}
EVENT_SITE = "events?|calendar|shows?|live-music|whats-on|entertainment"
EVENT_PATH = r"(?i)/(events?|calendar|shows?|live-music|whats-on|entertainment)(/|$)"


def scan_priority(category: Column, website: Column, passed: Column, quality: Column, empty: Column, errors: Column, known: Column) -> Column:
    """Priority of scanning a venue's page from its category and crawl history."""
    points = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VENUE_POINTS.items() for x in pair]), category), F.lit(4))
    history = F.least(F.lit(35), 3 * passed) + F.least(F.lit(25.0), quality / 3) - F.least(F.lit(40), 10 * empty) - F.least(F.lit(45), 15 * errors)
    site = F.when(F.lower(F.coalesce(website, F.lit(""))).rlike(EVENT_SITE), 16).otherwise(0)
    return points + site + F.when(known, history).otherwise(F.lit(8.0))


def next_scan_hours(outcome: Column, passed: Column, before_passed: Column, before_empty: Column, before_errors: Column) -> Column:
    """Hours to a venue's next scan: soon after success, backing off after errors and empty pages."""
    return (
        F.when(passed > 0, F.lit(6.0))
        .when((outcome == "unchanged") & (before_passed > 0), F.lit(12.0))
        .when(outcome == "error", F.least(F.lit(168.0), 6 * F.pow(F.lit(2.0), before_errors.cast("double"))))
        .otherwise(F.least(F.lit(168.0), 12 * F.pow(F.lit(2.0), F.least(before_empty, F.lit(4)).cast("double"))))
    )


def estimated_quality(found: Column, passed: Column, source_url: Column) -> Column:
    path = F.when(source_url.rlike(EVENT_PATH), 10).otherwise(0)
    good = F.least(F.lit(100), 55 + F.least(F.lit(25), 6 * passed) + path + F.when(found == passed, 5).otherwise(0))
    return F.when(passed > 0, good).when(found > 0, 35).otherwise(15)


# Dollars per million tokens in and out, and per search.
PRICES = {"large": (3.0, 15.0), "small": (1.0, 5.0)}


def run_cost(model: str, fresh: Column, output: Column, cached: Column, searches: Column) -> Column:
    """Dollars of a model run; cached input costs a tenth."""
    price_in, price_out = PRICES[model]
    return (fresh * price_in + cached * (price_in * 0.1) + output * price_out) / 1_000_000 + searches * 0.01
