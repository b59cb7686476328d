"""Maintenance of stored events: one rewrite per group of statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import classify as cl
from eventloom.functions import timewin as tw
from eventloom.functions.score import tags
from eventloom.functions.text import replaced, word


def without_adult_venues(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and venues without adult venues; the events are decided before the venues go."""
    adult = venues.filter(cl.is_adult_venue(F.col("name")))
    return events.join(adult.select(F.col("id").alias("venue_id")), "venue_id", "left_anti"), venues.join(adult.select("id"), "id", "left_anti")


def cleaned_descriptions(events: DataFrame) -> DataFrame:
    """Descriptions with markup, shortcodes or entities rewritten, long ones cut, and the tag of activity withdrawn where nothing speaks for it."""
    d = F.col("description")
    plain = F.trim(replaced(d, (r"(?i)\[caption[^\[]*?\[/caption\]", ""), (r"\[/?[a-zA-Z][^\]]*\]", ""), ("<[^>]+>", " "), ("&[#a-zA-Z0-9]+;", " "), (r"\s+", " ")))
    own = events.withColumn("description", F.when(d.rlike(r"<[a-zA-Z!]|\[|&[#a-zA-Z0-9]+;"), F.nullif(plain, F.lit(""))).otherwise(d))
    own = own.withColumn("description", F.when(F.length("description") > 500, F.concat(F.substring("description", 1, 500), F.lit("…"))).otherwise(F.col("description")))
    said = F.concat(F.col("title"), F.lit(" "), F.coalesce("description", F.lit(""))).rlike("(?i)" + word("|".join(cl.KEYWORDS["active"])))
    idle = F.array_contains("tags", "active") & ~F.col("category").isin("sports", "fitness") & ~said
    return own.withColumn("tags", F.when(idle, F.array_remove("tags", "active")).otherwise(F.col("tags")))


def retagged_adult(events: DataFrame, venues: DataFrame) -> DataFrame:
    """The tag ``adult`` taken away everywhere and given anew by venue, text and brand."""
    names = venues.select(F.col("id").alias("venue_id"), F.col("name").alias("__venue"))
    hit = cl.adult_reason(F.col("title"), F.col("description"), F.col("__venue")).isNotNull()
    reset = F.array_remove(tags(), "adult")
    return events.join(names, "venue_id", "left").withColumn("tags", F.when(hit, F.array_append(reset, F.lit("adult"))).otherwise(reset)).drop("__venue")


def without_generic(events: DataFrame) -> DataFrame:
    """Without scraped events whose title or description says nothing; a bare "<word> night" stays."""
    generic = F.col("title").rlike("|".join(f"(?i:{p.replace(chr(92) + 'w', '[A-Za-z0-9_]')})" for p in cl.GENERIC_TITLES if p != r"^\s*\w+\s+night\s*$"))
    said = F.trim(F.regexp_replace(F.coalesce("description", F.lit("")), r"(?i)^\s*(recurring|weekly|nightly|special)\s+event\.?\s*$", ""))
    return events.filter(~((F.col("source") == "scraped") & (generic | F.col("description").isNull() | (F.length(said) < 24))))


def canonical_rules(events: DataFrame) -> DataFrame:
    """Weekly rules as ``every <weekday>`` in lower case; other rules as they are."""
    rule = F.col("recurrence_rule")
    day = tw.normal_weekday(F.regexp_extract(rule, r"(?i)^every\s+([a-z]+)$", 1))
    return events.withColumn("recurrence_rule", F.when(day.isNotNull(), F.concat(F.lit("every "), day)).otherwise(rule))


def capped_ends(events: DataFrame) -> DataFrame:
    return events.withColumn("end_time", tw.capped_end(F.col("start_time"), F.col("end_time"), F.col("is_recurring")))


def recent_calls(calls: DataFrame, now: Column, n: float = 1) -> DataFrame:
    """Calls of the rate limit that a purge leaves: those of the last hours."""
    return calls.filter(F.col("called_at") >= now - tw.hours(n))
