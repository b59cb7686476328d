"""Literal cases of functions: geography, time, text and classification."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions import classify, geo, score, text
from eventloom.functions import timewin as tw


def one(spark, *columns, rows=((1,),), schema="x int"):
    return spark.createDataFrame(list(rows), schema).select(*columns).first()


@pytest.mark.parametrize(("lat", "lng", "expected"), [(0.0, 0.0, "s0000"), (37.7749, -122.4194, "9q8yy"), (95.0, 0.0, None), (90.0, 180.0, "zzzzz")])
def test_geohash(spark, lat, lng, expected):
    assert one(spark, geo.geohash(F.lit(lat), F.lit(lng)))[0] == expected


def test_geohash_same_cell_and_prefix(spark):
    a, b, c = one(spark, geo.geohash(F.lit(26.3683), F.lit(-80.1289)), geo.geohash(F.lit(26.37), F.lit(-80.13)), geo.geohash(F.lit(26.3683), F.lit(-80.1289), 7))
    assert a == b and c.startswith(a)


def test_grid_key_rounds_halves_upward(spark):
    assert one(spark, geo.grid_key(F.lit(26.35), F.lit(-80.05)), geo.grid_key(F.lit(0.02), F.lit(-0.04)))[:] == ("26.4,-80", "0,0")


def test_distances(spark):
    row = one(spark, geo.haversine_miles(F.lit(26.36), F.lit(-80.13), F.lit(26.40), F.lit(-80.10)), geo.haversine_miles(F.lit(26.36), F.lit(-80.13), F.lit(27.95), F.lit(-82.46)))
    assert row[0] < 15 * 1.2 < row[1]
    df = geo.spheroid_miles(spark.range(1), F.lit(50.06632), F.lit(-5.71475), F.lit(58.64402), F.lit(-3.07009), "miles")
    assert df.first()["miles"] * geo.METRES_PER_MILE == pytest.approx(969954.1, abs=1.0)
    same, null = (geo.spheroid_miles(spark.range(1), F.lit(50.0), F.lit(x).cast("double"), F.lit(50.0), F.lit(7.0), "miles").first()["miles"] for x in (7.0, None))
    assert same == 0 and null is None


def test_why_shows_display_labels(spark):
    """Categories and tags by their labels, at most two tags; an unknown tag shows as it is."""
    why = lambda category, tags: text.why_this(F.lit(None).cast("string"), F.lit(category), F.array(*map(F.lit, tags)), F.lit(False), F.lit("scraped"), ["food", "x"], ["live-music", "odd", "free"])
    row = one(spark, why("food", ["live-music", "odd", "free"]), why("x", ["other"]), why("music", ["other"]))
    assert row[0] == "Matches you on: matches your food & drink interest, tagged Live Music + odd."
    assert row[1] == "Matches you on: matches your x interest."
    assert row[2] == "Showing because it's nearby and on your radar."


EVENTS = "id long, start_time timestamp, end_time timestamp, is_recurring boolean, recurrence_rule string"
NOW = "2026-04-16 14:00:00"  # a Thursday


def timed(spark, start, end=None, recurring=False, rule=None, tz="UTC", now=NOW):
    ts = lambda x: dt.datetime.fromisoformat(x) if x else None
    df = spark.createDataFrame([(1, ts(start), ts(end), recurring, rule)], EVENTS)
    return tw.with_times(df, tw.at(now), tz)


@pytest.mark.parametrize(("start", "expected"), [("2026-04-16 20:00", True), ("2026-04-17 02:30", True), ("2026-04-17 12:00", False), ("2026-04-16 08:00", False)])
def test_tonight(spark, start, expected):
    assert timed(spark, start).select(tw.is_tonight(tw.at(NOW))).first()[0] is expected


@pytest.mark.parametrize(
    ("rule", "expected"),
    [("every friday", "2026-04-17 19:30"), ("Every WED", "2026-04-22 19:30"), ("every thursday", "2026-04-16 19:30"), ("every blursday", "2026-03-05 19:30"), ("weekly", "2026-03-05 19:30"), (None, "2026-03-05 19:30")],
)
def test_recurrence(spark, rule, expected):
    assert timed(spark, "2026-03-05 19:30", None, True, rule).first()["eff_start"] == dt.datetime.fromisoformat(expected)


def test_recurrence_today_rolls_when_over(spark):
    assert timed(spark, "2026-03-05 09:00", "2026-03-05 10:00", True, "every thursday").first()["eff_start"] == dt.datetime(2026, 4, 23, 9)
    assert timed(spark, "2026-03-05 13:00", None, True, "every thursday").first()["eff_start"] == dt.datetime(2026, 4, 16, 13)


def test_recurrence_keeps_the_wall_clock_over_a_clock_change(spark):
    # 19:00 in New York is 00:00 UTC in winter and 23:00 UTC in summer.
    found = timed(spark, "2026-03-06 00:00", None, True, "every friday", tz="America/New_York").first()["eff_start"]
    assert found == dt.datetime(2026, 4, 17, 23)


@pytest.mark.parametrize(("start", "live"), [("2026-04-16 13:00", True), ("2026-04-16 07:59", False), ("2026-04-16 15:00", False)])
def test_live(spark, start, live):
    assert timed(spark, start, "2026-04-17 00:00").select(tw.is_live(tw.at(NOW))).first()[0] is live


def test_quiet_hours_wrap(spark):
    moved = one(spark, *[tw.after_quiet_hours(tw.at(f"2026-04-16 {h}:15:00"), 22, 8) for h in ("23", "07", "12")])
    assert [x.isoformat(" ") for x in moved] == ["2026-04-17 08:00:00", "2026-04-16 08:00:00", "2026-04-16 12:15:00"]


def test_text(spark):
    raw = '<p>Hi &amp; <b>bye</b></p><script>x()</script> https://x.example.com [caption id=1]c[/caption]&copy;'
    row = one(spark, text.clean_text(F.lit(raw)), text.clean_text(F.lit("<p></p>")), text.clean_text(F.lit(None).cast("string")), text.ids_hash(F.array(F.lit("abc"))), text.first_json(F.lit("say [1, 2] ok")))
    assert row[:] == ("Hi & bye", None, None, "1a47e90b", "[1, 2]")
    a, b = one(spark, text.ids_hash(F.array(F.lit("b"), F.lit("a"))), text.ids_hash(F.array(F.lit("a"), F.lit("b"))))
    assert a == b


@pytest.mark.parametrize(("source", "url", "expected"), [("scraped", "https://www.eventbrite.com/e/123", "eventbrite.com"), ("scraped", "not a url", "source"), ("scraped", None, "source"), ("espn", None, "ESPN"), ("zzz", None, None)])
def test_source_name(spark, source, url, expected):
    assert one(spark, text.source_name(F.lit(source), F.lit(url).cast("string")))[0] == expected


@pytest.mark.parametrize(
    ("a", "b", "venue", "expected"),
    [
        ("Brews and Tunes", "Brews & Tunes", "", True),
        ("Karaoke", "Karaoke at Harbor Hall", "Harbor Hall", True),
        ("Event A", "Event B", "", False),
        ("Live Music Night", "Live Music Night with the Blue Band", "", True),
        ("C++ (beta) Meetup", "C++ (beta) Meetup at A.B", "A.B", True),
    ],
)
def test_similar_titles(spark, a, b, venue, expected):
    assert one(spark, text.similar_titles(F.lit(a), F.lit(b), F.lit(venue)))[0] is expected


def test_word_boundaries_are_ascii(spark):
    row = one(spark, F.lit("éa").rlike(text.word("a")), F.lit("brunch").rlike(text.word("run")), F.lit("a run!").rlike(text.word("run")))
    assert row[:] == (True, False, True)


@pytest.mark.parametrize(("name", "expected"), [("Cheetah Pompano Beach", True), ("Supper Cabaret", False), ("Vixens Cabaret", True), ("Club de striptease", True), ("City Park", False), (None, False)])
def test_adult_venue(spark, name, expected):
    assert one(spark, classify.is_adult_venue(F.lit(name).cast("string")))[0] is expected


def test_scraped_gate(spark):
    long = "A description that is long enough."
    cases = [("", long, "empty title"), ("Open", long, 'title too short: "Open"'), ("Trivia Night", long, None), ("Pizza Night", long, 'generic title: "Pizza Night"'), ("Fine Title", "Recurring event.", 'description too short: "Recurring event."')]
    for title, said, expected in cases:
        assert one(spark, classify.scraped_reason(F.lit(title), F.lit(said), F.lit(None).cast("string")))[0] == expected


def test_run_cost(spark):
    assert one(spark, score.run_cost("large", F.lit(30_000), F.lit(2_500), F.lit(0), F.lit(4)))[0] == pytest.approx(0.1675)
