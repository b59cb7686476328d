"""Run telemetry: costs per hour, rejection funnel, hit rate, latency, cooldowns and streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.timewin import hours

REJECTIONS = "array<struct<reason:string,title:string,source_url:string,detail:string>>"


def recent(runs: DataFrame, now: Column, n: float = 24) -> DataFrame:
    return runs.filter(F.col("started_at") > now - hours(n))


def cost_per_hour(runs: DataFrame, now: Column) -> DataFrame:
    own = recent(runs.filter("phase = 'discover'"), now)
    return own.groupBy(F.date_trunc("hour", "started_at").alias("hour")).agg(F.count(F.lit(1)).alias("runs"), F.sum("cost_usd").alias("cost_usd"), F.avg("cost_usd").alias("avg_run_cost"))


def rejection_funnel(runs: DataFrame, now: Column) -> DataFrame:
    """Rejections per reason beside the totals of emitted and persisted events."""
    own = recent(runs.filter("phase = 'discover'"), now)
    totals = own.agg(F.sum("events_emitted").alias("emitted"), F.sum("events_persisted").alias("persisted"))
    reasons = own.select(F.explode(F.from_json("rejections", REJECTIONS)).alias("r")).groupBy(F.col("r.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rejected"))
    return reasons.crossJoin(F.broadcast(totals))  # one row


def hit_rate(runs: DataFrame, now: Column) -> DataFrame:
    counted = recent(runs, now).agg(F.count_if(F.col("phase") == "rank").alias("rank_calls"), F.count_if((F.col("phase") == "discover") & F.col("status").isin("ok", "partial")).alias("discover_calls"))
    return counted.withColumn("pool_hit_rate", F.when(F.col("rank_calls") == 0, 0.0).otherwise(1.0 - F.col("discover_calls").cast("double") / F.col("rank_calls")))


def latency(runs: DataFrame, now: Column) -> DataFrame:
    own = recent(runs.filter("phase = 'discover' AND status IN ('ok', 'partial')"), now)
    took = own.select(((F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1_000_000)).alias("s"))
    return took.agg(F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY s)").alias("p95_seconds"), F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY s)").alias("p50_seconds"))


def cooldown(runs: DataFrame, geohash: str, user_id: int, now: Column, minutes: int = 30) -> DataFrame:
    """Whether a user may discover, whether a cell is fresh, and the cell's last run: one row from one scan."""
    fresh = (F.col("phase") == "discover") & F.col("status").isin("ok", "partial") & (F.col("started_at") > now - hours(minutes / 60))
    of_cell = F.col("geohash") == geohash
    return runs.agg(
        (~F.coalesce(F.bool_or(fresh & (F.col("user_id") == user_id)), F.lit(False))).alias("user_allowed"),
        F.coalesce(F.bool_or(fresh & of_cell & (F.col("events_persisted") > 0)), F.lit(False)).alias("cell_fresh"),
        F.max(F.when(of_cell & (F.col("phase") == "discover"), F.col("started_at"))).alias("last_run_at"),
    )


def calls_in_window(calls: DataFrame, minutes: int = 60) -> DataFrame:
    """Calls of a client in the window that ends at each call, all of them counted."""
    window = Window.partitionBy("client_id").orderBy(F.unix_micros("called_at")).rangeBetween(-minutes * 60_000_000, 0)
    return calls.withColumn("calls", F.count(F.lit(1)).over(window))


def dominant(events: DataFrame, column: str) -> DataFrame:
    """The commonest value and its count; of equals the one seen first."""
    counts = events.groupBy(column).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    return counts.agg(F.max_by(F.struct(column, "n"), F.struct("n", -F.col("first_pos"))).alias("top")).select("top.*")


# Calls that a client may make, and the minutes in which.
MOST_CALLS, CALL_MINUTES = 10, 60


def calls_left(calls: DataFrame, now: Column, endpoint: str) -> DataFrame:
    """Per client of calls (client_id, endpoint, called_at): used, the exact number within the hour, and what it leaves.

    Counted in the scan's tasks; no row of the log leaves them. A client without a call in
    the hour has none of its quota used and is not listed; after one more call ``remaining`` are left.
    """
    of_hour = calls.filter((F.col("endpoint") == endpoint) & (F.col("called_at") >= now - hours(CALL_MINUTES / 60)) & F.col("client_id").isNotNull())
    counted = of_hour.groupBy("client_id").agg(F.count(F.lit(1)).alias("used"))
    allowed = F.col("used") < MOST_CALLS
    return counted.select("client_id", "used", allowed.alias("allowed"), F.when(allowed, MOST_CALLS - F.col("used") - 1).otherwise(0).alias("remaining"))


# The order of categories in a hint.
HINT_ORDER = ["music", "sports", "food", "nightlife", "arts", "community", "fitness", "outdoors", "movies"]


def category_hint(events: DataFrame) -> DataFrame:
    """Categories that are well covered, and those that are not, one row."""
    counts = events.groupBy(F.coalesce(F.nullif("category", F.lit("")), F.lit("community")).alias("category")).count()
    whole = counts.agg(F.map_from_entries(F.collect_list(F.struct("category", "count"))).alias("by"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    order = F.array(*map(F.lit, HINT_ORDER))
    of = lambda c: F.coalesce(F.element_at("by", c), F.lit(0))
    return whole.select(
        F.filter(order, lambda c: of(c) >= F.greatest(F.lit(2.0), F.col("n") * 0.15)).alias("well_covered"), F.filter(order, lambda c: of(c) < 2).alias("under_represented")
    )


def streaks(days: DataFrame, today: Column) -> DataFrame:
    """Whether a user was there on three different days of the last seven."""
    own = days.filter(F.col("day").between(F.date_sub(today, 6), today))
    return own.groupBy("user_id").agg(F.countDistinct("day").alias("days")).withColumn("prompt", F.col("days") >= 3)
