"""Pages: where reading ends, the data source, odd payloads."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventloom.plans import paged_queries
from eventloom.sources import paged
from eventloom.sources.page_source import PageReader, PageSource
from tests.conftest import SF, duck

PAGES = "request_id string, query_no int, page_no int, ok boolean, payload string"
AT = dt.datetime(2024, 1, 15, 18)


def requests(spark, *ids, expand=True):
    return spark.createDataFrame([(r, AT, expand) for r in ids], "request_id string, at timestamp, expand boolean")


def test_reading_ends_at_the_first_page_that_failed_was_empty_or_the_last(spark):
    def page(*ids, more=True):
        venue = {"latitude": "1.5", "longitude": "2.5"}
        return json.dumps({"events": [{"id": i, "name": {"text": f"Walk {i}"}, "start": {"utc": "2024-01-16T20:00:00Z"}, "venue": venue} for i in ids], "pagination": {"has_more_items": more}})

    rows = [
        ("a", 0, 1, True, page("1")), ("a", 0, 2, False, page("2")), ("a", 0, 3, True, page("3")),  # the second failed
        ("a", 1, 1, True, page("1", "4")), ("a", 1, 2, True, page("5", more=False)), ("a", 1, 3, True, page("6")),  # the second was the last
        ("a", 2, 1, True, page("7")), ("a", 2, 3, True, page("8")),  # the second was never fetched
        ("a", 3, 1, True, page()), ("a", 3, 2, True, page("9")),  # the first was empty
        ("b", 0, 1, True, "no json"), ("b", 0, 2, True, page("1")), ("c", 0, 1, None, None),
        ("d", 0, 1, True, page("1")), ("d", 0, 2, True, page("2")), ("d", 0, 3, True, page("3")), ("d", 0, 4, True, page("4")), ("d", 0, 5, True, page("5")), ("d", 9, 1, True, page("x")),
    ]
    found = paged.eventbrite(spark.createDataFrame(rows, PAGES), requests(spark, "a", "b", "c", "d"))
    got = {}
    for r in found.collect():
        got.setdefault(r["request_id"], []).append(r["source_id"])
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["eb-1", "eb-4", "eb-5", "eb-7"], "d": ["eb-1", "eb-2", "eb-3", "eb-4"]}


def test_the_window_of_a_request(spark):
    days = ["2024-01-14", "2024-01-16", "2024-01-21", "2024-01-22", "2024-02-10", "2024-02-15"]
    events = [{"id": d, "name": {"text": "Walk"}, "start": {"utc": f"{d}T20:00:00Z"}, "venue": {"latitude": "1.5", "longitude": "2.5"}} for d in days]
    pages = spark.createDataFrame([(r, 0, 1, True, json.dumps({"events": events})) for r in ("week", "month")], PAGES)
    asked = requests(spark, "week", expand=False).union(requests(spark, "month"))
    found = {(r["request_id"], r["source_id"][3:]) for r in paged.eventbrite(pages, asked).collect()}
    assert found == {("week", d) for d in days[1:3]} | {("month", d) for d in days[1:5]}


def test_page_source(spark):
    spark.dataSource.register(PageSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = spark.read.format("fetched_pages").option("fetcher", "tests.fetchers:pages").option("requests", json.dumps(["a", "down"])).option("queries", 4).option("pages", 4).load()
    assert pages.rdd.getNumPartitions() == 32
    some = pages.filter("request_id = 'a' AND query_no IN (0, 2) AND from_time >= TIMESTAMP '2024-01-18 00:00:00' AND to_time <= TIMESTAMP '2024-01-25 00:00:00'")
    assert some.rdd.getNumPartitions() == 8
    listed = paged.eventbrite(some.drop("from_time", "to_time"), requests(spark, "a"))
    assert {r["source_id"] for r in listed.collect()} == {f"eb-{p}-{q}-{n}" for p in (1, 2) for q in (0, 1) for n in (0, 1)}
    assert {r["start_time"] for r in listed.collect()} == {dt.datetime(2024, 1, 18, 20)}
    whole = {(r["request_id"], r["query_no"], r["page_no"]): r["ok"] for r in pages.collect()}
    assert len(whole) == 32 and whole["a", 0, 1] and not whole["down", 0, 1] and not whole["a", 3, 2]


def test_page_source_prunes():
    from pyspark.sql.datasource import EqualTo, In

    reader = PageReader({"fetcher": "x:y", "requests": '["a", "b"]', "queries": "3", "pages": "2"})
    assert len(reader.partitions()) == 12
    assert len(list(reader.pushFilters([EqualTo(("request_id",), "b"), In(("page_no",), (2, 7))]))) == 2
    assert [(p.request_id, p.query_no, p.page_no) for p in reader.partitions()] == [("b", 0, 2), ("b", 1, 2), ("b", 2, 2)]


@pytest.mark.parametrize("name", sorted(paged_queries.QUERIES))
def test_odd_payloads(spark, name):
    rows = [("a", 0, 1, True, "no json"), ("a", 0, 2, True, None), ("a", 1, 1, True, "{}"), ("a", 1, 1, True, '{"events": [null, {}, {"event": null}]}'), ("a", None, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    schools = spark.createDataFrame([("a", "Uni", None, None, None, None)], "request_id string, name string, address string, lat double, lng double, website string")
    reads = {
        "source_eventbrite": lambda p: paged.eventbrite(p, requests(spark, "a")), "source_seatgeek": paged.seatgeek, "source_meetup": lambda p: paged.meetup(p, p), "source_localist": lambda p: paged.localist(p, schools),
    }
    found = reads[name](pages)
    assert found.filter(F.coalesce("title", F.lit("")) != "").count() == 0
    assert reads[name](pages.limit(0)).count() == 0
    assert duck(SF).execute(f"SELECT count(*) FROM ({paged_queries.ORACLE_SQL[name]})").fetchone()[0] > 20
