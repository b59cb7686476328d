"""Rows out of pages, calendars and event streams: one input row gives any number."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from eventloom.functions.text import attributes, host_and_port
from eventloom.operators.feed import first_by

# Words of links to event pages, and of links that are none.
LINK_WORDS = ["events", "calendar", "live music", "shows", "entertainment", "trivia", "karaoke", "open mic", "comedy", "music calendar", "things to do", "whats on", "what's on"]
NO_LINK_WORDS = [
    "private event", "private events", "wedding", "weddings", "catering", "careers", "jobs", "menu", "menus", "gift card", "contact", "about",
    "privacy", "terms", "facebook", "instagram", "mailto:", "tel:",
]
EVENT_PATH = r"(?i)/(events?|calendar|shows?|live-music|whats-on|entertainment)(/|$)"
LD_JSON = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


@F.pandas_udf(StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link as an absolute http(s) url; null if it is none. The library has no native form of this."""

    def one(b: str | None, x: str | None) -> str | None:
        try:
            found = urljoin(b or "", x or "")
        except ValueError:
            return None
        return found if x and found.startswith(("http://", "https://")) else None

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype="object")


def image_url(base: Column, raw: Column) -> Column:
    """An absolute image url; null for vectors, icons, logos and fillers."""
    url = resolved(base, F.trim(raw))
    return F.when(~F.lower(url).rlike(r"\.svg|favicon|logo|placeholder|spacer"), url)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, href, label) of all links of pages (page_id, url, html)."""
    pattern = r"""(?is)<a[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(pattern), F.lit(2)).alias("label"))
    found = pages.select("page_id", "url", F.posexplode(pairs).alias("pos", "l"))
    label = F.trim(F.regexp_replace(F.regexp_replace("l.label", "<[^>]+>", " "), r"\s+", " "))
    return found.select("page_id", "url", "pos", F.col("l.href").alias("href"), label.alias("label"))


def event_pages(pages: DataFrame) -> DataFrame:
    """The best link to a page of events on the same host, per page: (page_id, event_url, score)."""
    own = links(pages).withColumn("text", F.lower(F.concat_ws(" ", "href", "label")))
    own = own.filter(~F.col("text").rlike("|".join(NO_LINK_WORDS))).withColumn("event_url", resolved(F.col("url"), F.col("href")))
    points = F.when(F.regexp_replace("event_url", r"^https?://[^/?#]*|[?#].*$", "").rlike(EVENT_PATH), 6).otherwise(0)
    for w in LINK_WORDS:
        points = points + F.when(F.contains("text", F.lit(w)), 4 if " " in w else 3).otherwise(0)
    scored = own.filter(host_and_port(F.col("event_url")) == host_and_port(F.col("url"))).withColumn("score", points).filter("score >= 4")
    return first_by(scored, ["page_id"], [F.col("score").desc(), F.col("pos")]).select("page_id", "event_url", "score")


def athletics_pages(pages: DataFrame) -> DataFrame:
    """The first link whose words or address speak of athletics or sports, per page."""
    own = links(pages).filter(F.lower(F.concat_ws(" ", "href", "label")).rlike("athletic|sports")).withColumn("athletics_url", resolved(F.col("url"), F.col("href")))
    return first_by(own.filter("athletics_url IS NOT NULL"), ["page_id"], [F.col("pos")]).select("page_id", "athletics_url")


def _ld_items(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, item) of every JSON-LD object of pages, members of ``@graph`` too; bad JSON is skipped."""
    script = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(LD_JSON), F.lit(1))).alias("pos", "json"))
    root = script.withColumn("v", F.expr("try_parse_json(json)")).filter("v IS NOT NULL")
    many = F.expr("coalesce(try_variant_get(v, '$', 'array<variant>'), array(v))")
    each = root.select("page_id", "url", "pos", F.explode(many).alias("v"))
    graph = F.expr("coalesce(try_variant_get(v, '$.@graph', 'array<variant>'), array())")
    return each.select("page_id", "url", "pos", F.explode(F.concat(F.array("v"), graph)).alias("item"))


def _is_event() -> Column:
    kinds = F.expr("coalesce(try_variant_get(item, '$.@type', 'array<string>'), array(try_variant_get(item, '$.@type', 'string')))")
    return F.array_contains(kinds, "Event")


def _ld_image() -> Column:
    """The image of a JSON-LD object: text, the first of a list, or an object's url."""
    return F.expr(
        "coalesce(try_variant_get(item, '$.image[0]', 'string'), try_variant_get(item, '$.image.url', 'string'), try_variant_get(item, '$.image.contentUrl', 'string'), try_variant_get(item, '$.image[0].url', 'string'), try_variant_get(item, '$.image', 'string'))"
    )


def schema_events(pages: DataFrame) -> DataFrame:
    """Events that pages declare in JSON-LD."""
    items = _ld_items(pages).filter(_is_event())
    get = lambda path, kind: F.expr(f"try_variant_get(item, '{path}', '{kind}')")
    return items.select(
        "page_id", F.coalesce(get("$.name", "string"), F.lit("")).alias("title"), F.coalesce(get("$.description", "string"), F.lit("")).alias("description"), F.lit("community").alias("category"),
        F.lit("event").alias("subcategory"), F.expr("try_cast(try_variant_get(item, '$.startDate', 'string') AS timestamp)").alias("start_time"), F.expr("try_cast(try_variant_get(item, '$.endDate', 'string') AS timestamp)").alias("end_time"),
        F.coalesce(get("$.isAccessibleForFree", "boolean"), F.lit(False)).alias("is_free"), get("$.offers.price", "double").alias("price_min"), image_url(F.col("url"), _ld_image()).alias("image_url"),
    )


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, image_url): of the page's meta tags, else of its JSON-LD events."""
    metas = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0))).alias("pos", "tag"))
    metas = metas.withColumn("own", attributes(F.col("tag")))
    named, content = F.lower(F.coalesce(F.nullif(F.col("own")["property"], F.lit("")), F.col("own")["name"])), F.col("own")["content"]
    of_meta = metas.filter(named.isin("og:image", "og:image:url", "twitter:image", "twitter:image:src")).select("page_id", F.lit(0).alias("kind"), "pos", image_url(F.col("url"), content).alias("image_url"))
    of_ld = _ld_items(pages).filter(_is_event()).select("page_id", F.lit(1).alias("kind"), "pos", image_url(F.col("url"), _ld_image()).alias("image_url"))
    return first_by(of_meta.union(of_ld).filter("image_url IS NOT NULL"), ["page_id"], [F.col("kind"), F.col("pos")]).select("page_id", "image_url")


def ical_events(calendars: DataFrame) -> DataFrame:
    """Events of calendar texts (calendar_id, text): unfolded lines, the last of repeated fields, summary and start needed."""
    blocks = F.transform(F.slice(F.split("text", "(?i)BEGIN:VEVENT"), 2, 1_000_000), lambda b: F.when(F.contains(b, F.lit("END:VEVENT")), F.split_part(b, F.lit("END:VEVENT"), F.lit(1))))
    block = calendars.select("calendar_id", F.posexplode(F.array_compact(blocks)).alias("pos", "body"))
    lines = F.split(F.regexp_replace("body", r"\r?\n\s", ""), r"\r?\n")
    fields = ("SUMMARY", "DESCRIPTION", "DTSTART", "DTEND", "LOCATION", "URL")
    rows = block.select("calendar_id", "pos", *[_last_field(lines, name).alias(name.lower()) for name in fields])
    tidy = F.replace(F.replace(F.coalesce("description", F.lit("")), F.lit("\\n"), F.lit(" ")), F.lit("\\,"), F.lit(","))
    return rows.withColumn("description", tidy).filter("coalesce(summary, '') <> '' AND coalesce(dtstart, '') <> ''")


def _last_field(lines: Column, name: str) -> Column:
    """The value of the last line with the field; null where no line has it."""
    pattern = f"^{name}(?:;[^:]*)?:(.*)$"
    own = F.filter(lines, lambda x: x.rlike(pattern))
    return F.when(F.size(own) > 0, F.trim(F.regexp_extract(F.element_at(own, -1), pattern, 1)))


def stream_frames(logs: DataFrame) -> DataFrame:
    """Frames of event-stream texts (run_id, text): (run_id, pos, event, data); frames without both lines are skipped."""
    frames = logs.select("run_id", F.posexplode(F.split("text", r"\n\n")).alias("pos", "frame"))
    rows = frames.select("run_id", "pos", F.regexp_extract("frame", r"(?m)^event: (.*)$", 1).alias("event"), F.regexp_extract("frame", r"(?m)^data: (.*)$", 1).alias("data"))
    return rows.filter("event <> '' AND data <> '' AND try_parse_json(data) IS NOT NULL")
