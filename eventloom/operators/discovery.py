"""Discovery runs: frames of a run to accepted events, rejected ones and the run's metrics.

A frame is a row (run_id, pos, at, kind, payload). Kinds: ``web_search`` with the text of
its results, ``emit_event`` with an event as JSON, ``usage`` with token counts as JSON,
``error`` with a message; others are ignored. An event is judged by what its run had
searched before it, so the same rows come out however the frames are cut into batches.
Frames without a run, and those later than the wall-clock cap after the run's start, count for
nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions import score
from eventloom.functions.text import host_and_port
from eventloom.operators import validate
from eventloom.sources.connectors import COLUMNS

FRAMES = "run_id string, pos long, at timestamp, kind string, payload string"
#: Seconds from a run's start after which its frames no longer count.
WALL_CLOCK = 90

EMITTED = """title string, venue_name string, address string, lat double, lng double, start_iso string, end_iso string, category string, tags array<string>,
  price_min double, price_max double, is_free boolean, image_url string, source_url string, description string"""
USAGE = "input_tokens long, output_tokens long, cache_read_input_tokens long"


@dataclass(frozen=True)
class Discovered:
    """accepted: event rows with run_id and pos; rejected: run_id, pos, reason, title, source_url, detail; metrics: sums per run."""

    accepted: DataFrame
    rejected: DataFrame
    metrics: DataFrame


def timely(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Frames of known runs within the wall-clock cap, with the run's started_at, run_lat, run_lng and run_miles."""
    known = runs.select("run_id", "started_at", F.col("lat").alias("run_lat"), F.col("lng").alias("run_lng"), F.col("miles").alias("run_miles"))
    age = F.unix_micros("at") - F.unix_micros("started_at")
    return frames.join(known, "run_id").filter(F.coalesce(age <= WALL_CLOCK * 1_000_000, F.lit(True)))


def emitted(frames: DataFrame) -> DataFrame:
    """The events of ``emit_event`` frames; a field of a wrong type, and all of a payload that is no JSON, are null."""
    own = frames.filter("kind = 'emit_event'").withColumn("e", F.from_json("payload", EMITTED.replace("\n", "")))
    times = {"start_time": F.try_to_timestamp("e.start_iso"), "end_time": F.try_to_timestamp("e.end_iso")}
    return own.select("run_id", "pos", "at", "run_lat", "run_lng", "run_miles", "e.*", *[c.alias(name) for name, c in times.items()])


def discover(frames: DataFrame, runs: DataFrame, fetched: DataFrame, earlier: DataFrame | None = None) -> Discovered:
    """Judge the frames of runs (run_id, started_at, lat, lng, miles).

    ``fetched`` has what was found at each address: source_url, http_status,
    ranged_status, html. ``earlier``: web_search frames (run_id, pos, payload) that came
    in earlier batches.
    """
    own = timely(frames, runs)
    searches = own.filter("kind = 'web_search'").select("run_id", F.col("pos").alias("search_pos"), F.lower("payload").alias("results"))
    if earlier is not None:
        searches = searches.unionByName(earlier.select("run_id", F.col("pos").alias("search_pos"), F.lower("payload").alias("results")))
    events = emitted(own)
    # An event is grounded if one of its run's searches before it names the host: an equi-join on the run.
    named = events.select("run_id", "pos", host_and_port(F.col("source_url")).alias("host")).filter("host IS NOT NULL")
    met = named.join(searches, "run_id").filter((F.col("search_pos") < F.col("pos")) & F.contains("results", "host")).select("run_id", "pos").distinct().withColumn("is_grounded", F.lit(True))
    pages = fetched.select("source_url", "http_status", "ranged_status", "html")
    judged = validate.gate(
        events.join(met, ["run_id", "pos"], "left").join(pages, "source_url", "left"),
        (F.col("run_lat"), F.col("run_lng")),
        F.col("run_miles"),
        F.col("at"),
        F.col("is_grounded"),
    )
    return Discovered(_accepted(judged), _rejected(judged), _metrics(own, judged))


def _accepted(judged: DataFrame) -> DataFrame:
    """Event rows keyed by (source, source_id), the id a hash of the address."""
    own = {"source": F.lit("claude"), "source_id": F.sha1("source_url"), "ticket_url": F.col("source_url"), "subcategory": F.lit(None)}
    columns = [own.get(c, F.col(c) if c in judged.columns else F.lit(None)).cast(kind).alias(c) for c, kind in COLUMNS.items()]
    return judged.filter("reject_reason IS NULL").select("run_id", "pos", *columns)


def _rejected(judged: DataFrame) -> DataFrame:
    return judged.filter("reject_reason IS NOT NULL").select("run_id", "pos", F.col("reject_reason").alias("reason"), "title", "source_url", F.col("reject_detail").alias("detail"))


SUMS = ["events_emitted", "events_persisted", "events_rejected", "web_searches", "input_tokens", "output_tokens", "cached_input_tokens", "errors"]


def _metrics(frames: DataFrame, judged: DataFrame) -> DataFrame:
    """Sums per run: what :func:`run_metrics` adds up over batches."""
    usage = F.from_json("payload", USAGE)
    tokens = lambda name: F.coalesce(F.when(F.col("kind") == "usage", usage[name]), F.lit(0))
    kind = lambda name: F.when(F.col("kind") == name, 1).otherwise(0)
    counted = frames.select(
        "run_id", kind("emit_event").alias("events_emitted"), F.lit(0).alias("events_persisted"), F.lit(0).alias("events_rejected"), kind("web_search").alias("web_searches"),
        tokens("input_tokens").alias("input_tokens"), tokens("output_tokens").alias("output_tokens"), tokens("cache_read_input_tokens").alias("cached_input_tokens"), kind("error").alias("errors"),
    )
    ok = F.col("reject_reason").isNull().cast("int")
    none = [F.lit(0)] * 5
    verdicts = judged.select("run_id", F.lit(0), ok, 1 - ok, *none)
    return counted.union(verdicts).groupBy("run_id").agg(*[F.sum(c).cast("long").alias(c) for c in SUMS])


def run_metrics(sums: DataFrame) -> DataFrame:
    """Metrics of whole runs from the sums of their batches, with cost_usd of the large model."""
    whole = sums.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in SUMS])
    return whole.withColumn("cost_usd", score.run_cost("large", F.col("input_tokens"), F.col("output_tokens"), F.col("cached_input_tokens"), F.col("web_searches")))
