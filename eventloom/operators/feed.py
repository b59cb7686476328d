"""The feed: ranked discovery around a point, filters, diversification and rows.

Operators take and return DataFrames. Input order is the column ``pos``; it breaks
every tie. Global conditions (is the feed long enough?) are one-row aggregates that
join the rows, so nothing is counted on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import geo, score
from eventloom.functions import timewin as tw
from eventloom.sources.tables import keep

FEED_FLOOR = 20
DEFAULT_RADIUS = 5.0
WIDER_RADII = (15.0, 30.0, 50.0, 100.0)


def venue_struct(venues: DataFrame) -> DataFrame:
    """Venues as (venue_id, venue) with the fields that a feed row shows."""
    fields = F.struct("id", "name", "category", "photo_url", "rating", "live_busyness")
    return venues.select(F.col("id").alias("venue_id"), fields.alias("venue"))


def visible(now: Column, categories: list[str] | None = None, all_tags: list[str] | None = None) -> Column:
    """Not ended, within the horizon, of the wanted categories and tags, not adult. Absent filters vanish from the plan."""
    recurring = F.coalesce(F.col("is_recurring"), F.lit(False))
    found = (recurring | F.col("end_time").isNull() | (F.col("end_time") > now - tw.hours(1))) & (recurring | (F.col("start_time") < now + tw.hours(7 * 24)))
    if categories is not None:
        found = found & F.col("category").isin(categories)
    if all_tags is not None:
        found = found & (F.size(F.array_except(F.array(*map(F.lit, all_tags)).cast("array<string>"), score.tags())) == 0)
    return found & ~F.array_contains(score.tags(), "adult")


def rank_keys(now: Column) -> list[Column]:
    """The feed's order: live, soon, quality, start, distance; the id breaks ties."""
    live = (F.col("start_time") <= now) & (F.col("end_time").isNull() | (F.col("end_time") > now))
    soon = F.col("start_time") < now + tw.hours(48)
    return [F.when(live, 0).otherwise(1), F.when(soon, 0).otherwise(1), F.col("quality").desc(), F.col("start_time"), F.col("distance"), F.col("id")]


def discover(events: DataFrame, venues: DataFrame, origin: tuple[float, float], miles: float, now: Column, categories: list[str] | None = None, tags: list[str] | None = None, method: str = "sphere") -> DataFrame:
    """Events around a point with venue, distance, quality and ``rank`` order keys applied.

    The box around the circle and the other filters are plain comparisons that reach
    the scan; venues join by id, broadcast where Spark finds them small.
    """
    near = events.filter(geo.covering_box(F.col("lat"), F.col("lng"), origin, miles * 1.01) & visible(now, categories, tags))
    if method == "spheroid":
        near = geo.spheroid_miles(near, F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lng"), "distance")
    else:
        near = near.withColumn("distance", geo.haversine_miles(F.lit(origin[0]), F.lit(origin[1]), F.col("lat"), F.col("lng")))
    near = near.filter(F.col("distance") <= miles).withColumn("tags", score.tags()).withColumn("quality", score.source_quality())
    return near.join(venue_struct(venues), "venue_id", "left").orderBy(*rank_keys(now))


def hide(events: DataFrame, categories: list[str], tags: list[str]) -> DataFrame:
    """Without hidden categories and without any hidden tag."""
    kept = events
    if categories:
        kept = kept.filter(~F.coalesce(F.col("category").isin(categories), F.lit(False)))
    return kept.filter(~score.has_tag(*tags)) if tags else kept


def sheet(events: DataFrame, categories: list[str], any_tags: list[str]) -> DataFrame:
    """Of any wanted category and with any wanted tag; an empty list wants all."""
    kept = events.filter(F.col("category").isin(categories)) if categories else events
    return kept.filter(score.has_tag(*any_tags)) if any_tags else kept


def search(events: DataFrame, query: str) -> DataFrame:
    """Events with the trimmed, lower-cased query in a text field or a tag; none for an empty query."""
    q = query.strip().lower()
    if not q:
        return events.limit(0)
    fields = [F.lower(score.text_or_empty(c)).contains(q) for c in ("title", "description", "address", "subcategory")]
    if "venue" in events.columns:
        fields.append(F.lower(F.coalesce(F.col("venue.name"), F.lit(""))).contains(q))
    found = F.exists(score.tags(), lambda t: F.lower(t).contains(q))
    for f in fields:
        found = found | f
    return events.filter(found)


def mappable(events: DataFrame) -> DataFrame:
    """With id, start and finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return events.filter(F.col("id").isNotNull() & finite("lat") & finite("lng") & F.col("start_time").isNotNull())


def viewport(events: DataFrame, centre: tuple[float, float], delta: tuple[float, float]) -> DataFrame:
    """Strictly inside a map's window."""
    return events.filter((F.abs(F.col("lat") - centre[0]) < delta[0] / 2) & (F.abs(F.col("lng") - centre[1]) < delta[1] / 2))


def only_ids(events: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ``ids`` (saved events, or the members of a map cluster)."""
    return events.join(ids.select("id").distinct(), "id", "left_semi")


def in_view(events: DataFrame, centre: tuple[float, float] | None = None, delta: tuple[float, float] | None = None, cluster: DataFrame | None = None) -> DataFrame:
    """What a map lists: the members of the cluster that was opened, else what lies in its window, else all."""
    if cluster is not None:
        return only_ids(events, cluster)
    return viewport(events, centre, delta) if centre is not None and delta is not None else events


#: Ids of one lookup that count.
MOST_IDS = 60


def looked_up(events: DataFrame, requests: DataFrame, most: int = MOST_IDS) -> DataFrame:
    """The events of requests (request_id, ids): of the first ``most`` ids, in the order given, those that exist; each once."""
    wanted = requests.select("request_id", F.explode(F.slice("ids", 1, most)).alias("id")).distinct()
    return events.select("id", "title", "category", "tags", "start_time", "description").join(wanted, "id")


def merge_unique(base: DataFrame, extra: DataFrame, key: str = "id") -> DataFrame:
    """Base rows in order, then rows of ``extra`` whose key is new; of repeats the first."""
    both = base.withColumn("__side", F.lit(0)).unionByName(extra.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return first_by(both, [key], [F.col("__side"), F.col("pos")]).drop("__side")


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__nth = 1").drop("__nth")


def first_tier(rows: DataFrame, keys: list[str], tier: str) -> DataFrame:
    """Of every key the rows of its lowest tier: the first candidate that gave something.

    One exchange by key; a key's lowest tier is known before its rows are read again, so
    no list of them is built.
    """
    return rows.withColumn("__first", F.min(tier).over(Window.partitionBy(*keys))).filter(F.col("__first") == F.col(tier)).drop("__first")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2 and so on in an order that is without ties.

    Rows are dealt into ranges of the order, and each range counts on from the end of
    those before it, so no task holds all rows. The ranges are written, since their
    bounds are drawn anew whenever they are computed.
    """
    ranges = keep(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sizes = ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranges.join(F.broadcast(starts), "__range").withColumn(name, F.col("__start") + within).drop("__range", "__start")


def venue_key() -> Column:
    """What counts as one place: venue, else address, else title."""
    return F.coalesce(F.col("venue_id").cast("string"), F.nullif(F.col("address"), F.lit("")), F.col("title"))


def venue_cap(events: DataFrame, most: int) -> DataFrame:
    """At most so many rows per place, in input order."""
    nth = F.row_number().over(Window.partitionBy(venue_key()).orderBy("pos"))
    return events.withColumn("__nth", nth).filter(F.col("__nth") <= most).drop("__nth")


def diversify(events: DataFrame, target: int = FEED_FLOOR, tight: int = 3, loose: int = 8) -> DataFrame:
    """The tight cap where it leaves enough rows, else the loose one."""
    ranked = events.withColumn("__nth", F.row_number().over(Window.partitionBy(venue_key()).orderBy("pos")))
    # One row says which cap holds; it joins all rows.
    enough = ranked.agg((F.count_if(F.col("__nth") <= tight) >= target).alias("__enough"))
    return ranked.crossJoin(F.broadcast(enough)).filter(F.col("__nth") <= F.when(F.col("__enough"), tight).otherwise(loose)).drop("__nth", "__enough")


def balance(feed: DataFrame, pool: DataFrame, column: str, least_kinds: int | None = None) -> DataFrame:
    """Bring kinds (sources or categories) of the pool that the feed lacks into the feed.

    Every lacking kind with two pool rows gives its first two; as many rows of the
    feed's commonest kind leave, first ones first, but two stay. With ``least_kinds``
    only as many kinds come as the feed lacks to that number, in pool order. A feed
    under the floor, or without additions, stays as it is. ``pos`` is renumbered when
    rows were added: by start, then by former place.
    """
    kind = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("unknown"))
    feed, pool = feed.withColumn("__kind", kind), pool.withColumn("__kind", kind)
    kinds = feed.groupBy("__kind").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))
    # The tables of kinds are as small as the enumeration of sources or categories.
    whole = kinds.agg(F.sum("n").alias("feed_rows"), F.count(F.lit(1)).alias("n_kinds"), F.max(F.struct("n", (-F.col("first_pos")).alias("earlier"), "__kind")).alias("top"))
    of_pool = pool.groupBy("__kind").agg(F.count(F.lit(1)).alias("pool_rows"), F.min("pos").alias("first_pos"))
    lacking = of_pool.filter("pool_rows >= 2").join(kinds.select("__kind"), "__kind", "left_anti")
    fresh = pool.join(lacking.select("__kind", F.col("first_pos").alias("__kind_pos")), "__kind").join(feed.select("id"), "id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("__kind").orderBy("pos"))
    fresh = fresh.withColumn("__nth", nth).filter("__nth <= 2")
    if least_kinds is not None:
        order = fresh.groupBy("__kind").agg(F.min("__kind_pos").alias("p")).withColumn("__kind_no", F.row_number().over(Window.orderBy("p"))).drop("p")
        fresh = fresh.join(order, "__kind").crossJoin(F.broadcast(whole.select("n_kinds"))).filter(F.col("__kind_no") <= least_kinds - F.col("n_kinds")).drop("__kind_no", "n_kinds")
    fresh = fresh.crossJoin(F.broadcast(whole.select("feed_rows"))).filter(F.col("feed_rows") >= FEED_FLOOR).drop("feed_rows")
    added = whole.crossJoin(fresh.agg(F.count(F.lit(1)).alias("n_added"))).select(
        "n_added", F.col("top.__kind").alias("top_kind"), F.when(F.col("top.n") >= 3, F.least("n_added", F.col("top.n") - 2)).otherwise(0).alias("to_drop")
    )
    in_kind = F.row_number().over(Window.partitionBy("__kind").orderBy("pos"))
    stays = feed.withColumn("__in_kind", in_kind).crossJoin(F.broadcast(added)).filter(~((F.col("__kind") == F.col("top_kind")) & (F.col("__in_kind") <= F.col("to_drop"))))
    both = stays.drop("__in_kind", "top_kind", "to_drop").withColumns({"__side": F.lit(0), "__kind_pos": F.lit(0).cast("long"), "__nth": F.lit(0)}).unionByName(
        fresh.crossJoin(F.broadcast(added.select("n_added"))).withColumn("__side", F.lit(1))
    )
    by_start = [F.when(F.col("n_added") > 0, F.col("eff_start")), F.col("__side"), F.col("__kind_pos"), F.col("pos"), F.col("id")]
    placed = numbered(both, by_start, "__place")
    return placed.withColumn("pos", F.when(F.col("n_added") > 0, F.col("__place")).otherwise(F.col("pos"))).drop("__kind", "__side", "__kind_pos", "__nth", "n_added", "__place")


def reconciled_reminders(saved: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """(id, action): reminders of events no longer saved are cancelled; saved events that start later and have none get one."""
    cancel = planned.select("id").distinct().join(saved.select("id"), "id", "left_anti").withColumn("action", F.lit("cancel"))
    new = saved.filter(F.col("eff_start") > now).select("id").distinct().join(planned.select("id"), "id", "left_anti")
    return cancel.union(new.withColumn("action", F.lit("schedule")))


def top(events: DataFrame, points: Column, n: int, least: Column | None = None) -> DataFrame:
    """The n best rows by points, then input order; points must pass ``least`` if given."""
    scored = events.withColumn("score", points)
    return (scored.filter(least) if least is not None else scored).orderBy(F.col("score").desc(), "pos").limit(n)


def now_queue(events: DataFrame, now: Column, mood: str, tz: str = "UTC") -> DataFrame:
    """The five most urgent events of the next hours or tonight."""
    return top(events.filter(tw.is_live_or_soon(now, 6) | tw.is_tonight(now, tz)), score.urgency(now, mood, tz), 5)


def similar(events: DataFrame, to_id: int, n: int = 5) -> DataFrame:
    """Events with most tags in common with one, two more points for its category."""
    one = events.filter(F.col("id") == to_id).select(score.tags().alias("own_tags"), F.col("category").alias("own_category"))
    scored = events.filter(F.col("id") != to_id).crossJoin(F.broadcast(one.limit(1)))
    points = F.size(F.array_intersect(score.tags(), F.col("own_tags"))) + F.when(F.col("category") == F.col("own_category"), 2).otherwise(0)
    return top(scored, points, n, F.col("score") > 0).drop("own_tags", "own_category")


def widen(ranked: DataFrame, miles: float, floor: int = FEED_FLOOR, explicit: bool = False) -> DataFrame:
    """Rows of the first radius, then of wider ones until there are enough.

    ``ranked`` was found at the widest radius; its order is ``pos``. Every row belongs
    to the first radius that holds it; rows per radius are counted, and a radius
    counts while those before it hold fewer rows than the floor.
    """
    radii = [miles] if explicit or miles != DEFAULT_RADIUS else [miles, *(max(r, miles) for r in WIDER_RADII)]
    tier = F.lit(len(radii))
    for i in reversed(range(len(radii))):
        tier = F.when(F.col("distance") <= radii[i], i).otherwise(tier)
    tiered = ranked.withColumn("tier", tier).filter(F.col("tier") < len(radii))
    counts = tiered.groupBy("tier").count()
    before = Window.orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)  # over at most five rows
    wanted = counts.withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).filter((F.col("tier") == 0) | (F.col("__before") < floor)).select("tier")
    return tiered.join(F.broadcast(wanted), "tier", "left_semi")


def ranking_keys() -> list[Column]:
    """Best rank first, model finds first among equals, then input order."""
    return [F.coalesce("rank_score", F.lit(-1.0)).desc(), F.when(F.col("source") == "claude", 0).otherwise(1), F.col("pos")]


def apply_ranking(events: DataFrame, ranking: DataFrame) -> DataFrame:
    """Events with rank_score and blurb of a ranking (event_id, rank_score, blurb), best first, model finds first among equals."""
    joined = events.join(ranking.withColumnRenamed("event_id", "id"), "id", "left")
    return joined.orderBy(*ranking_keys())


# Rows of goals, and when an event belongs to them.
GOAL_ROWS = {
    "get-active": lambda: F.col("category").isin("sports", "fitness") | score.has_tag("active"),
    "find-partner": lambda: score.has_tag("singles", "date-night") | (F.col("category").isin("nightlife", "arts") & ~score.happy_hour()),
    "meet-people": lambda: score.has_tag("social") | (F.col("category") == "community"),
    "drinks-nightlife": lambda: (F.col("category") == "nightlife") & ~score.happy_hour(),
    "live-music": lambda: (F.col("category") == "music") | score.has_tag("live-music"),
    "try-food": lambda: (F.col("category") == "food") & ~score.happy_hour(),
    "explore-arts": lambda: F.col("category").isin("arts", "movies"),
    "family-fun": lambda: score.has_tag("family", "all-ages") | (F.col("category").isin("community", "outdoors") & ~score.has_tag("21+")),
    "outdoor-fun": lambda: (F.col("category") == "outdoors") | score.has_tag("outdoor"),
}
MOST_ROWS = 6


def discovery_rows(events: DataFrame, now: Column, goals: list[str], hidden: list[str] = (), picks: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """Titled rows of events: row_no, row_id, id, place (by start within the row).

    Every event is matched against all builders at once; rows with too few events
    or hidden ones vanish, and the first six of the rest stay.
    """
    weekday = F.dayofweek(F.from_utc_timestamp(now, tz)).between(2, 6)
    distance = F.col("distance") if "distance" in events.columns else F.lit(None).cast("double")
    builders: list[tuple[str, Column, int]] = [
        ("happening-now", tw.is_live_or_soon(now, 12), 1),
        *((f"goal-{g}", GOAL_ROWS[g](), 3) for g in goals if g in GOAL_ROWS),
        ("free-tonight", F.col("is_free") & tw.is_same_day(now, tz), 3),
        ("happy-hours", score.happy_hour(), 3),
        ("within-one-mile", distance < 1, 3),
        ("this-weekend", weekday & tw.is_weekend(now, tz), 3),
    ]
    order = ["happening-now", "picked-for-you", *(name for name, _, _ in builders[1:])]
    matched = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("row_id"), F.lit(n).alias("least"))) for name, c, n in builders]))
    members = events.select("id", "pos", "eff_start", F.explode(matched).alias("r")).select("id", "pos", "eff_start", "r.row_id", "r.least")
    if picks is not None:
        members = members.unionByName(picks.select("id", "pos", "eff_start", F.lit("picked-for-you").alias("row_id"), F.lit(3).alias("least")))
    if hidden:
        members = members.filter(~F.col("row_id").isin(list(hidden)))
    sizes = members.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).filter("n >= least")
    place = F.array_position(F.array(*map(F.lit, order)), F.col("row_id"))
    numbered = sizes.withColumn("row_no", F.row_number().over(Window.orderBy(place))).filter(F.col("row_no") <= MOST_ROWS)
    within = Window.partitionBy("row_id").orderBy("eff_start", "pos")
    return members.join(F.broadcast(numbered.select("row_id", "row_no")), "row_id").select("row_no", "row_id", "id", F.row_number().over(within).alias("place"))
