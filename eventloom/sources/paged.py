"""Connectors over fetched pages: what was asked, page by page, and which of it counts.

A row of pages is (request_id, query_no, page_no, ok, payload): one answer of a source to
one query of a request. Reading stops at the first page that failed, was empty or said that
it was the last; what was fetched beyond is not looked at. All connectors give the
columns of :data:`eventloom.sources.connectors.COLUMNS`, with the request.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import classify as cl
from eventloom.functions import text
from eventloom.functions import timewin as tw
from eventloom.operators.feed import first_by, first_tier
from eventloom.sources.connectors import COLUMNS, not_adult, truthy

# Queries of the ticket listing, keyword buckets of the meeting site, and bounds.
EVENTBRITE_QUERIES = ["", "singles dating speed dating mixer", "happy hour trivia karaoke", "pickleball basketball volleyball pickup soccer running club tennis"]
EVENTBRITE_PAGES = 4
EXPANDED_DAYS = 30
MEETUP_BUCKETS = [
    ("pickleball", "pickleball"), ("basketball pickup", "basketball"), ("soccer pickup", "soccer"), ("volleyball pickup", "volleyball"), ("tennis", "tennis"),
    ("running club", "running"), ("hiking", "hiking"), ("yoga outdoor", "yoga"), ("singles social", "singles_mixer"),
]
SEATGEEK_ROWS = 100
LOCALIST_ROWS = 25


def _rows(rows: DataFrame, **columns: Column) -> DataFrame:
    """The request and the common columns; those not given are null."""
    return rows.select("request_id", *[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _cut(c: Column) -> Column:
    return F.substring(c, 1, 500)


def pages_read(pages: DataFrame, most: int, items: Column, more: Column | None = None) -> DataFrame:
    """The pages of each (request, query) that are read: from the first on while each was there, ok, not empty and not the last."""
    goes_on = F.coalesce(F.col("ok") & (F.size(items) > 0), F.lit(False))
    own = pages.filter(F.col("page_no").between(1, most)).withColumn("__ok", goes_on).withColumn("__more", goes_on & (F.coalesce(more, F.lit(False)) if more is not None else F.lit(True)))
    query = Window.partitionBy("request_id", "query_no").orderBy("page_no")
    before = F.coalesce(F.min("__more").over(query.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    # A page that was never fetched ends the reading too.
    unbroken = F.row_number().over(query) == F.col("page_no")
    return own.withColumn("__read", before & unbroken & F.col("__ok")).filter("__read").drop("__ok", "__more", "__read")


def week_end(at: Column) -> Column:
    """The midnight that ends the Sunday of an instant's week."""
    return F.date_trunc("week", at) + tw.hours(7 * 24)


def in_window(requests: DataFrame) -> DataFrame:
    """(request_id, from_time, to_time): this week, or thirty days where the request asks for more."""
    end = F.when(F.col("expand"), F.col("at") + tw.hours(EXPANDED_DAYS * 24)).otherwise(week_end(F.col("at")))
    return requests.select("request_id", F.col("at").alias("from_time"), end.alias("to_time"))


EVENTBRITE = """struct<events:array<struct<id:string,name:struct<text:string>,description:struct<text:string>,url:string,is_free:boolean,start:struct<utc:timestamp>,end:struct<utc:timestamp>,logo:struct<url:string>,
  venue:struct<name:string,latitude:string,longitude:string,address:struct<address_1:string,city:string,region:string>>>>,pagination:struct<has_more_items:boolean>>"""


def eventbrite(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Ticket listings of requests (request_id, at, expand): four queries of at most four pages, the first of every id, within the window."""
    parsed = pages.withColumn("p", F.from_json("payload", EVENTBRITE.replace("\n", "")))
    read = pages_read(parsed, EVENTBRITE_PAGES, F.col("p.events"), F.col("p.pagination.has_more_items"))
    e = read.filter(F.col("query_no") < len(EVENTBRITE_QUERIES)).select("request_id", "query_no", "page_no", F.posexplode("p.events").alias("n", "e")).select("request_id", "query_no", "page_no", "n", "e.*")
    e = first_by(e, ["request_id", "id"], [F.col("query_no"), F.col("page_no"), F.col("n")])
    timely = e.join(in_window(requests), "request_id").filter(F.col("start.utc").isNull() | F.col("start.utc").between(F.col("from_time"), F.col("to_time")))
    rows = timely.withColumns(
        {
            "title": F.coalesce("name.text", F.lit("")), "info": F.col("description.text"), "place": F.col("venue.name"), "la": truthy(F.col("venue.latitude").try_cast("double")), "ln": truthy(F.col("venue.longitude").try_cast("double")),
            "free": F.coalesce("is_free", F.lit(False)),
        }
    )
    rows = not_adult(rows.filter("la IS NOT NULL AND ln IS NOT NULL"), "title", "info", "place")
    kind, sub = F.lit("community"), F.lit("event")
    tags = cl.generate_tags(F.col("title"), F.col("info"), sub, kind, F.col("free"), F.hour("start.utc"), F.col("url"), F.lit(None).cast("string"))
    return _rows(
        rows, source=kind, source_id=text.source_id("eb", F.col("id")), title=F.col("title"), description=_given(_cut(F.col("info"))), category=kind, subcategory=sub, lat=F.col("la"), lng=F.col("ln"),
        address=text.joined_address(F.col("venue.address.address_1"), F.col("venue.address.city"), F.col("venue.address.region")), image_url=_given(F.col("logo.url")), start_time=F.col("start.utc"), end_time=F.col("end.utc"),
        is_free=F.col("free"), ticket_url=_given(F.col("url")), source_url=_given(F.col("url")), tags=tags,
    )


SEATGEEK = """struct<events:array<struct<id:long,title:string,short_title:string,description:string,type:string,url:string,datetime_utc:timestamp,stats:struct<lowest_price:double,highest_price:double>,
  performers:array<struct<image:string>>,venue:struct<address:string,city:string,state:string,location:struct<lat:double,lon:double>>>>>"""


def seatgeek(pages: DataFrame) -> DataFrame:
    """The legacy ticketing page, one of a hundred rows; its source is outside the declared list."""
    shown = F.slice(F.from_json("payload", SEATGEEK.replace("\n", ""))["events"], 1, SEATGEEK_ROWS)
    e = pages.filter("ok AND page_no = 1").select("request_id", F.explode(shown).alias("e")).select("request_id", "e.*")
    rows = e.withColumns({"name": F.coalesce(_given(F.col("short_title")), F.col("title")), "c": cl.seat_category(F.coalesce("type", F.lit("")))})
    tags = cl.generate_tags(F.col("name"), F.col("description"), F.col("c.subcategory"), F.col("c.category"), F.lit(False), F.hour("datetime_utc"), F.col("url"), F.lit(None).cast("string"))
    part = lambda c: F.coalesce(c, F.lit(""))
    return _rows(
        rows, source=F.lit("seatgeek"), source_id=F.col("id").cast("string"), title=F.col("name"), description=_given(F.col("description")), category=F.col("c.category"), subcategory=F.col("c.subcategory"),
        lat=F.col("venue.location.lat"), lng=F.col("venue.location.lon"), address=F.concat_ws(", ", part(F.col("venue.address")), part(F.col("venue.city")), part(F.col("venue.state"))),
        image_url=_given(F.get("performers", F.lit(0))["image"]), start_time=F.col("datetime_utc"), is_free=F.lit(False), price_min=truthy(F.col("stats.lowest_price")), price_max=truthy(F.col("stats.highest_price")),
        ticket_url=F.col("url"), source_url=F.col("url"), tags=tags,
    )


MEETUP = """struct<data:struct<keywordSearch:struct<edges:array<struct<node:struct<result:struct<id:string,title:string,description:string,dateTime:string,eventUrl:string,isAttendingFree:struct<accepts:string,amount:double>,
  venue:struct<name:string,address:string,city:string,state:string>>>>>>>>"""
MEETUP_SCRAPED = "array<struct<title:string,description:string,start_time:string,venue_name:string,address_hint:string,is_free:boolean,source_url:string>>"


def meetup(api: DataFrame, scraped: DataFrame) -> DataFrame:
    """Meetings of nine keyword buckets (query_no): of the API, else, for a request to which that gave none, as a model read them from pages."""
    bucket = lambda k: F.get(F.array(*[F.lit(b[k]) for b in MEETUP_BUCKETS]), F.col("query_no"))
    said = lambda of: F.coalesce(_given(of), F.concat(bucket(0), F.lit(" via Meetup")))
    edges = F.from_json("payload", MEETUP.replace("\n", ""))["data"]["keywordSearch"]["edges"]
    e = api.filter("ok").select("request_id", "query_no", F.explode(edges).alias("e")).select("request_id", "query_no", "e.node.result.*")
    fee = F.col("isAttendingFree")
    free = F.coalesce(_given(fee["accepts"]), F.lit("")).eqNullSafe("") | (F.coalesce(fee["amount"], F.lit(0.0)) == 0)
    of_api = e.filter("coalesce(id, '') <> '' AND coalesce(dateTime, '') <> ''").select(
        "request_id", F.lit(0).alias("tier"), F.coalesce("title", F.lit("")).alias("title"), said(F.col("description")).alias("info"), bucket(1).alias("sub"), F.col("venue.name").alias("place"),
        text.joined_address(F.col("venue.address"), F.col("venue.city"), F.col("venue.state")).alias("address"), F.try_to_timestamp("dateTime").alias("start"), free.alias("free"), F.coalesce(_given(F.col("eventUrl")), F.lit("https://www.meetup.com")).alias("link"),
    )
    s = scraped.filter("ok").select("request_id", "query_no", F.explode(F.from_json(text.first_json(F.col("payload")), MEETUP_SCRAPED)).alias("e")).select("request_id", "query_no", "e.*")
    of_pages = s.filter("coalesce(title, '') <> '' AND coalesce(start_time, '') <> ''").select(
        "request_id", F.lit(1).alias("tier"), "title", said(F.col("description")).alias("info"), bucket(1).alias("sub"), F.col("venue_name").alias("place"), F.coalesce("address_hint", F.lit("")).alias("address"),
        F.try_to_timestamp("start_time").alias("start"), F.coalesce("is_free", F.lit(True)).alias("free"), F.coalesce(_given(F.col("source_url")), F.lit("https://www.meetup.com")).alias("link"),
    )
    rows = first_tier(of_api.unionByName(of_pages), ["request_id"], "tier")
    return _rows(
        rows, source=F.lit("meetup"), source_id=text.source_id("meetup", text.slug(F.col("title"), 40), F.date_format("start", "yyyyMMdd")), title=F.col("title"), description=text.clean_text(F.col("info")), category=F.lit("sports"),
        subcategory=F.col("sub"), address=text.joined_address(F.col("place"), F.col("address")), start_time=F.col("start"), is_free=F.col("free"), source_url=F.col("link"),
    )


LOCALIST = """struct<events:array<struct<event:struct<id:long,title:string,description:string,description_text:string,tags:array<string>,first_date:string,venue_name:string,address:string,ticket_cost:string,photo_url:string,localist_url:string,
  url:string,geo:struct<latitude:double,longitude:double>,event_instances:array<struct<event_instance:struct<start:string,end:string>>>>>>>"""


def localist(pages: DataFrame, universities: DataFrame) -> DataFrame:
    """Campus calendars: each university's candidate addresses (query_no) in order, and of the first that gives an event, the events.

    ``universities``: request_id, name, address, lat, lng, website. Of a page the first 25
    entries count; those without a start, title or description go.
    """
    shown = F.slice(F.from_json("payload", LOCALIST.replace("\n", ""))["events"], 1, LOCALIST_ROWS)
    e = pages.filter("ok").select("request_id", "query_no", F.explode(shown).alias("w")).select("request_id", "query_no", "w.event.*")
    first = F.get("event_instances", F.lit(0))["event_instance"]
    rows = e.withColumns({"start": F.try_to_timestamp(F.coalesce(_given(first["start"]), F.col("first_date"))), "end": F.try_to_timestamp(first["end"]), "info": _cut(F.coalesce(_given(F.col("description_text")), F.col("description")))})
    rows = first_tier(rows.filter("start IS NOT NULL AND coalesce(title, '') <> '' AND coalesce(info, '') <> ''"), ["request_id"], "query_no")
    own = universities.select("request_id", F.col("name").alias("uni"), F.col("address").alias("uni_address"), F.col("lat").alias("uni_lat"), F.col("lng").alias("uni_lng"), "website")
    rows = rows.join(own, "request_id")
    listed = F.when(F.coalesce("id", F.lit(0)) != 0, F.col("id").cast("string")).otherwise(text.slug(F.concat_ws("-", "uni", "title"), 80))
    return _rows(
        rows, source=F.lit("university"), source_id=text.source_id("uni", listed), title=F.col("title"), description=F.col("info"), category=cl.category_of(F.col("title"), F.col("info"), F.coalesce("tags", F.array().cast("array<string>"))),
        subcategory=cl.subcategory_of(F.col("title"), F.col("info")), lat=F.coalesce(truthy(F.col("geo.latitude")), "uni_lat"), lng=F.coalesce(truthy(F.col("geo.longitude")), "uni_lng"),
        address=text.joined_address(F.coalesce(_given(F.col("venue_name")), F.col("uni")), F.coalesce(_given(F.col("address")), F.col("uni_address"))), image_url=_given(F.col("photo_url")), start_time=F.col("start"), end_time=F.col("end"),
        is_free=F.coalesce(_given(F.col("ticket_cost")), F.lit("")) == "", source_url=F.coalesce(_given(F.col("localist_url")), _given(F.col("url")), F.col("website")),
    )
