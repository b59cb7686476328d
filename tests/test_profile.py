"""Profiles, feedback, images, caches and page changes on small tables, against plain loops."""

import datetime as dt

from pyspark.sql import functions as F

from eventloom.functions import images
from eventloom.operators import profile, scans
from eventloom.plans import catalog
from tests.conftest import SF

NOW = dt.datetime(2024, 1, 15, 18)


def test_image_takes_the_strongest_sign(spark):
    rows = [
        (1, "https://own/x.jpg", "Karaoke", None, None, ["singles"], "music"),
        (2, "", "A Glow Bowl for couples", None, "trivia", None, "nightlife"),
        (3, None, "Evening", None, "jazz", ["trivia"], "music"),
        (4, None, "Evening", None, "", ["date-night", "trivia"], "nightlife"),
        (5, None, "Evening", None, None, ["trivia", "date-night"], "arts"),
        (6, None, None, None, None, None, None),
        (7, None, "Evening", None, None, [], "fitness"),
    ]
    events = spark.createDataFrame(rows, "id long, image_url string, title string, description string, subcategory string, tags array<string>, category string")
    found = {r["id"]: r["image"] for r in images.with_image(events).collect()}
    photo = lambda kind: images.PHOTO.format(images.SUBCATEGORIES[kind])
    by_category = lambda c: images.PHOTO.format(images.CATEGORIES[c])
    assert found == {1: "https://own/x.jpg", 2: photo("bowling"), 3: photo("jazz"), 4: photo("trivia"), 5: photo("date_night"), 6: by_category("community"), 7: by_category("fitness")}


def test_preferences_follow_the_goals_order(spark):
    answers = spark.createDataFrame([(1, ["live-music", "find-partner"], "free", "too-expensive", "solo", "hide"), (2, None, None, None, None, None)], "user_id long, goals array<string>, budget string, blocker string, social string, happy_hour string")
    one, none = profile.preferences(answers).orderBy("user_id").collect()
    assert one["tags"] == ["date-night", "live-music", "free", "singles"] and one["categories"] == ["nightlife", "food", "arts", "music", "community"]
    assert (none["tags"], none["categories"], none["radius"], one["happy_hour_enabled"], none["happy_hour_enabled"]) == ([], [], 10, False, True)


def test_feedback_bias_against_a_plain_loop(spark):
    told = [("loved", "music", ["a", "b", "c"]), ("loved", "music", ["c", "b", "a"]), ("missed", "", ["a", "a"]), ("ok", "music", ["a"]), ("missed", None, None), ("loved", "food", ["d"])]
    shown = [(1, "music", ["a", "b", "c"]), (2, "food", ["a"]), (3, None, None), (4, "", ["d", "d"]), (5, "music", [])]
    wanted = {}
    for i, category, tags in shown:
        wanted[i] = 0
        for status, c, own in told:
            likeness = int(bool(c) and c == category) + min(2, sum(t in (tags or []) for t in own or []))
            wanted[i] += {"loved": 1, "missed": -1, "ok": 0}[status] * likeness
    frames = spark.createDataFrame(shown, "id long, category string, tags array<string>"), spark.createDataFrame(told, "status string, category string, tags array<string>")
    assert {r["id"]: r["bias"] for r in profile.feedback_bias(*frames).collect()} == wanted
    assert {r["bias"] for r in profile.feedback_bias(frames[0], frames[1].limit(0)).collect()} == {0}


def test_random_pick(spark):
    events = spark.range(50)
    picks = [profile.random_pick(events, str(seed)).first()["id"] for seed in range(12)]
    assert len(set(picks)) > 4 and picks[0] == profile.random_pick(events.orderBy(F.col("id").desc()), "0").first()["id"]
    assert profile.random_pick(events.limit(0), "0").count() == 0


def test_rating_prompts_edges(spark):
    ago = lambda h: NOW - dt.timedelta(hours=h)
    ratings = spark.createDataFrame([(1, "pending", None, ago(48)), (2, "pending", None, ago(47)), (3, "pending", ago(168), None), (4, "pending", ago(167), None), (5, "rated", None, ago(99)), (6, None, None, None), (7, "feedback_sent", None, None), (8, "later", None, None)], "user_id long, state string, streak_shown_at timestamp, dismissed_at timestamp")
    days = spark.createDataFrame([(u, dt.date(2024, 1, d)) for u in (2, 3, 4, 5, 6, 7, 8) for d in (9, 10, 15, 15)] + [(1, dt.date(2024, 1, 8))], "user_id long, day date")
    found = profile.rating_prompts(ratings, days, F.lit(NOW))
    assert {r["user_id"]: r["prompt"] for r in found.collect()} == {1: "delayed", 2: "streak", 3: "streak", 4: "none", 5: "none", 6: "streak", 7: "none", 8: "streak"}


def test_unchanged_pages(spark):
    rows = [(1, 1, "x", "ok", 3, 2), (1, 2, None, "error", 0, 0), (1, 3, "x", "ok", 3, 2), (1, 4, "y", "ok", 1, 1), (2, 1, "y", "ok", 1, 1), (2, 2, None, "empty", 0, 0)]
    found = scans.unchanged_pages(spark.createDataFrame(rows, "venue_id long, seq long, page_hash string, outcome string, found int, passed int"))
    assert [(r["outcome"], r["found"], r["passed"]) for r in found.orderBy("venue_id", "seq").collect()] == [("ok", 3, 2), ("error", 0, 0), ("unchanged", 0, 0), ("ok", 1, 1), ("ok", 1, 1), ("empty", 0, 0)]


def test_queries_meet_every_case(spark):
    """The derived tables reach all outcomes of pages, every section and prompt."""
    values = lambda name, column: {r[0] for r in catalog.QUERIES[name](spark, SF).select(column).distinct().collect()}
    assert values("scan_page_changes", "outcome") == {"ok", "error", "unchanged"}
    assert values("rating_prompts", "prompt") == {"delayed", "streak", "none"}
    assert len(values("feed_feedback_bias", "bias")) > 3
    assert len(values("feed_images", "image")) > 10
