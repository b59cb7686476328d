"""Gates of emitted events: schema, grounding, reachability, content and geography.

The gates of one event run in that order and the first failure counts. What was
fetched (status, page, search results) comes as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.functions import timewin as tw
from eventloom.functions.text import host_and_port, without_tags

# Categories and bounds.
CATEGORIES = ["nightlife", "sports", "food", "outdoors", "arts", "music", "community", "movies", "fitness"]
GEO_SLACK = 1.2


def _text(name: str, most: int) -> Column:
    return F.coalesce(F.length(name).between(1, most), F.lit(False))


def _number(name: str, low: float, high: float) -> Column:
    return F.coalesce(F.col(name).between(low, high) & ~F.isnan(name), F.lit(False))


def _https(name: str) -> Column:
    return F.coalesce(F.col(name).rlike(r"(?i)^https://\S+$"), F.lit(False))


def schema_detail(now: Column) -> Column:
    """The first field that breaks its bounds; null if none does."""
    start, end = F.col("start_time"), F.col("end_time")
    checks = [
        ("title", _text("title", 200)),
        ("venue_name", _text("venue_name", 120)),
        ("address", _text("address", 300)),
        ("lat", _number("lat", -90, 90)),
        ("lng", _number("lng", -180, 180)),
        ("start_iso fmt", start.isNotNull()),
        ("start_iso past", start >= now - tw.hours(6)),
        ("start_iso future", start <= now + tw.hours(60 * 24)),
        ("end before start", end.isNull() | (end >= start)),
        ("category", F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))),
        ("tags", F.col("tags").isNotNull() & ~F.exists("tags", lambda t: t.isNull())),
        ("price_min", F.col("price_min").isNull() | _number("price_min", 0, 100_000)),
        ("price_max", F.col("price_max").isNull() | _number("price_max", 0, 100_000)),
        ("is_free", F.col("is_free").isNotNull()),
        ("image_url", F.col("image_url").isNull() | _https("image_url")),
        ("source_url", _https("source_url")),
        ("description", _text("description", 500)),
    ]
    return F.coalesce(*[F.when(~ok, F.lit(name)) for name, ok in checks])


def grounded(url: Column, results: Column) -> Column:
    """Whether the url's host, with its port, stands in the search results."""
    return F.coalesce(F.contains(F.lower(results), host_and_port(url)), F.lit(False))


def reachable(status: Column, ranged_status: Column) -> Column:
    """200 to 399; where the probe's method was refused, the ranged request decides."""
    return F.when(status == 405, ranged_status.between(200, 399)).otherwise(status.between(200, 399))


def title_found(title: Column, page: Column) -> Column:
    """Three title words on the page, or all of fewer; a title without words counts as found."""
    words = F.regexp_extract_all(F.lower(title), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    hits = F.size(F.filter(words, lambda w: F.contains(page, w)))
    return (hits >= 3) | ((F.size(words) < 3) & (hits == F.size(words)))


def date_found(page: Column, start: Column, now: Column) -> Column:
    """The start's date on the page, in one of the usual forms, or by its nearness."""
    month, day = F.lower(F.date_format(start, "MMMM")), F.date_format(start, "d")
    ahead = tw.rounded((F.unix_micros(start) - F.unix_micros(now)) / F.lit(86_400_000_000))
    near = F.contains(page, F.lit("tonight")) | ((ahead == 1) & F.contains(page, F.lit("tomorrow"))) | F.contains(page, F.lower(F.date_format(start, "EEEE")))
    return (
        F.contains(page, F.date_format(start, "yyyy-MM-dd"))
        | F.contains(page, F.concat_ws(" ", month, day))
        | F.contains(page, F.concat_ws("/", F.date_format(start, "M"), day))
        | (ahead.between(0, 7) & near)
    )


def content_found(title: Column, venue: Column, html: Column, start: Column, now: Column) -> Column:
    page = F.lower(without_tags(html))
    name = title_found(title, page) | (F.coalesce(F.length(venue) > 0, F.lit(False)) & F.contains(page, F.lower(venue)))
    return name & date_found(page, start, now)


def geo_sane(lat: Column, lng: Column, origin: tuple[float | Column, float | Column], miles: float | Column) -> Column:
    at = [c if isinstance(c, Column) else F.lit(c) for c in (*origin, miles)]
    return geo.haversine_miles(at[0], at[1], lat, lng) <= at[2] * GEO_SLACK


def gate(events: DataFrame, origin: tuple[float | Column, float | Column], miles: float | Column, now: Column, is_grounded: Column | None = None) -> DataFrame:
    """Add reject_reason and reject_detail; both null for accepted events.

    Needs the event's fields and search_blob (unless ``is_grounded`` is given),
    http_status, ranged_status, html.
    """
    is_grounded = grounded(F.col("source_url"), F.col("search_blob")) if is_grounded is None else is_grounded
    found = events.withColumn("reject_detail", schema_detail(now))
    reason = (
        F.when(F.col("reject_detail").isNotNull(), "schema")
        .when(~F.coalesce(is_grounded, F.lit(False)), "grounding")
        .when(~F.coalesce(reachable(F.col("http_status"), F.col("ranged_status")), F.lit(False)), "head")
        .when(~F.coalesce(content_found(F.col("title"), F.col("venue_name"), F.col("html"), F.col("start_time"), now), F.lit(False)), "content")
        .when(~F.coalesce(geo_sane(F.col("lat"), F.col("lng"), origin, miles), F.lit(False)), "geo")
    )
    return found.withColumn("reject_reason", reason)
