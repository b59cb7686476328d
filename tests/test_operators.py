"""Operators on small tables: rows, balancing, clusters, gates, upserts and state."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventloom.functions import timewin as tw
from eventloom.operators import feed, resolve, spatial, telemetry
from eventloom.plans.views import NOW, feed_events
from eventloom.sources import tables
from eventloom.streaming import state
from tests.conftest import SF, executions, rows_of

T0 = dt.datetime(2024, 1, 15, 20)


def events(spark, rows, start=T0):
    base = {"venue_id": 1, "source": "scraped", "title": "Test", "description": "", "category": "nightlife", "subcategory": "", "address": "", "is_free": False, "tags": [], "venue_name": None, "lat": 0.0, "lng": 0.0}
    schema = "id long, pos long, venue_id long, source string, title string, description string, category string, subcategory string, address string, is_free boolean, tags array<string>, venue_name string, lat double, lng double, start_time timestamp, end_time timestamp, is_recurring boolean, recurrence_rule string"
    full = [{**base, "id": i, "pos": i, "start_time": start, "end_time": None, "is_recurring": False, "recurrence_rule": None, **r} for i, r in enumerate(rows)]
    return tw.with_times(spark.createDataFrame(full, schema), tw.at(NOW))


def test_clusters(spark):
    df = events(spark, [{"title": "Brews and Tunes"}, {"title": "Brews & Tunes"}, {"title": "Event A"}, {"title": "Event B"}, {"title": "Brews and Tunes", "venue_id": 2}])
    found = {r["id"]: r for r in resolve.merge_same_day(df, tw.at(NOW)).collect()}
    assert sorted(found) == [0, 2, 3, 4]
    assert found[0]["cluster_size"] == 2 and found[0]["additional_starts"] == [T0]


def test_cluster_takes_the_next_showing(spark):
    df = events(spark, [{"start_time": T0.replace(hour=9)}, {"start_time": T0.replace(hour=19)}, {"start_time": T0.replace(hour=21)}])
    assert [r["id"] for r in resolve.merge_same_day(df, tw.at(NOW)).collect()] == [1]


def test_cluster_against_plain_loop(spark):
    """Greedy, in feed order: the first cluster of the day and place whose first member is similar takes an event."""
    from eventloom.functions import text

    df = tw.with_times(feed_events(spark, SF), tw.at(NOW)).withColumn("venue_name", F.lit(None).cast("string"))
    venue = F.coalesce(F.nullif(text.venue_word(F.col("address")), F.lit("")), F.lit(""))
    bare = text.without_venue(F.col("title"), venue)
    rows = df.select("id", "pos", "venue_id", text.venue_word(F.col("address")).alias("address"), F.to_date("eff_start").alias("day"), bare.alias("title"), text.tokens(bare).alias("words")).collect()
    leaders: dict = {}
    wanted = {}
    for r in sorted(rows, key=lambda r: (r["pos"], r["id"])):
        place = ("venue", r["venue_id"]) if r["venue_id"] is not None else ("address", r["address"]) if r["address"] else None
        own, mine = leaders.setdefault((r["day"], place), []), set(r["words"])
        for lead in own:
            other = set(lead["words"])
            both, fewer = len(mine & other), min(len(mine), len(other))
            if r["title"] == lead["title"] or (fewer >= 2 and (both == fewer or both / len(mine | other) >= 0.65)):
                wanted[r["id"]] = lead["id"]
                break
        else:
            own.append(r)
            wanted[r["id"]] = r["id"]
    found: dict = {}
    for r in resolve.cluster(df).select("id", "cluster").collect():
        found.setdefault(r["cluster"], set()).add(r["id"])
    together: dict = {}
    for i, lead in wanted.items():
        together.setdefault(lead, set()).add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, together.values()))
    assert len(together) < len(rows)


def test_clusters_of_a_block_without_a_place(spark):
    """Long chains of similar titles, common words and copies in the one block of a day that has no place."""
    import random

    rng = random.Random(6)
    words = ["jazz", "night", "river", "blues", "market", "late", "open", "garden", "salsa", "quiz"]
    titles = [" ".join(rng.sample(words, rng.randint(1, 5))) for _ in range(150)] + ["Jazz Night"] * 20 + ["", "a", None, "the of"]
    df = events(spark, [{"title": t, "venue_id": None, "address": "", "venue_name": None, "pos": rng.randint(0, 40)} for t in titles])
    from eventloom.functions import text

    rows = df.select("id", "pos", F.coalesce(text.without_venue(F.col("title"), F.lit("")), F.lit("")).alias("t"), "title").withColumn("w", text.tokens(F.col("t"))).collect()
    leaders, wanted = [], {}
    for r in sorted(rows, key=lambda r: (r["pos"], r["id"])):
        mine = set(r["w"])
        for lead in leaders:
            both, fewer = len(mine & set(lead["w"])), min(len(mine), len(lead["w"]))
            if r["t"] == lead["t"] or (fewer >= 2 and (both == fewer or both / len(mine | set(lead["w"])) >= 0.65)):
                wanted[r["id"]] = lead["id"]
                break
        else:
            leaders.append(r)
            wanted[r["id"]] = r["id"]
    assert {r["id"]: int(r["cluster"].rpartition("|")[2]) for r in resolve.cluster(df).select("id", "cluster").collect()} == wanted
    own = df.select("id", "title", F.lit(1).alias("b"))
    pairs = {(a["id"], c["id"]) for a in rows for c in rows if a["id"] < c["id"] and a["title"] is not None and c["title"] is not None and (a["t"] == c["t"] or (min(len(a["w"]), len(c["w"])) >= 2 and (
        len(set(a["w"]) & set(c["w"])) == min(len(a["w"]), len(c["w"])) or len(set(a["w"]) & set(c["w"])) / len(set(a["w"]) | set(c["w"])) >= 0.65)))}
    found = resolve.similar_pairs(own, ["b"], F.lit("")).collect()
    assert {tuple(r) for r in found} == pairs and len(found) == len(pairs)


def test_no_join_of_a_whole_block(spark):
    """Titles meet by block and word; the plan has no join on the block alone."""
    import re

    df = spark.createDataFrame([(1, "a b", 1)], "id long, title string, hall int")
    plan = resolve.similar_pairs(df, ["hall"], F.lit(""))._jdf.queryExecution().optimizedPlan().toString()
    joins = re.findall(r"Join Inner, .*", plan)
    assert joins and all(j.count(" = ") >= 2 for j in joins)


def test_pairs_of_a_title_of_many_rows_come_in_blocks(spark, monkeypatch):
    """Titles are cleaned once, before rows meet; blocks of a title lose and repeat no pair."""
    monkeypatch.setattr(resolve, "BLOCK", 7, raising=False)
    titles = ["Jazz Night"] * 40 + ["Jazz Night Late"] * 25 + ["Chess", None]
    rows = [(i, t, i % 2) for i, t in enumerate(titles)]
    found = resolve.similar_pairs(spark.createDataFrame(rows, "id long, title string, hall int"), ["hall"], F.lit(""))
    assert "regexp_replace" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(a, b) for a in range(65) for b in range(a + 1, 65) if a % 2 == b % 2]


def test_rows(spark):
    few = events(spark, [{"is_free": True}])
    four = events(spark, [{"is_free": True}] * 4)
    names = lambda df, **k: {r["row_id"] for r in feed.discovery_rows(df, tw.at(NOW), k.get("goals", []), k.get("hidden", [])).collect()}
    assert "free-tonight" not in names(few)
    assert "free-tonight" in names(four)
    assert "free-tonight" not in names(four, hidden=["free-tonight"])
    many = events(spark, [{"is_free": True, "tags": ["active", "singles", "live-music", "happy-hour", "outdoor", "family", "social"], "category": "music"}] * 30)
    assert len(names(many, goals=list(feed.GOAL_ROWS))) == 6


def test_balance_is_off_under_the_floor_and_never_loses_a_source(spark):
    pool = events(spark, [{"source": s} for s in ["a"] * 25 + ["b"] * 3 + ["c"]])
    small = pool.filter("id < 10")
    assert feed.balance(small, pool, "source").count() == 10
    big = pool.filter("id < 22")
    out = feed.balance(big, pool, "source")
    by = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert by == {"a": 20, "b": 2}


def test_order_of_input_rows_does_not_matter(spark):
    df = tw.with_times(feed_events(spark, SF), tw.at(NOW))
    once = sorted(r["id"] for r in feed.venue_cap(df, 2).collect())
    again = sorted(r["id"] for r in feed.venue_cap(df.orderBy(F.rand(3)).repartition(3), 2).collect())
    assert once == again


def test_spatial_join_against_all_pairs(spark):
    rng = [(i, 60 + (i * 37 % 100) / 50, 179.0 + (i * 53 % 100) / 60) for i in range(80)]
    a = spark.createDataFrame(rng[:60], "id long, lat double, lng double")
    b = spark.createDataFrame(rng[60:], "place_id long, plat double, plng double")
    found = {(r["id"], r["place_id"]) for r in spatial.within_distance(a, b, 20.0).collect()}
    from eventloom.functions.geo import haversine_miles

    whole = a.crossJoin(b).filter(haversine_miles(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng")) <= 20.0)
    assert found == {(r["id"], r["place_id"]) for r in whole.collect()} and found


def test_spatial_join_works_once_per_pair_of_spots(spark, monkeypatch):
    """Many points at few spots: cells are per spot, not per point, and blocks of a spot lose and repeat no pair."""
    i = F.col("id")
    points = spark.range(20_000).select("id", (26.0 + i % 20 / F.lit(100.0)).alias("lat"), F.lit(-80.0).alias("lng"))
    places = spark.range(10).select(i.alias("place_id"), (26.0 + i % 5 / F.lit(50.0)).alias("plat"), F.lit(-80.01).alias("plng"))
    places = places.union(spark.createDataFrame([(90, None, 1.0)], "place_id long, plat double, plng double"))
    monkeypatch.setattr(spatial, "BLOCK", 300, raising=False)
    before = executions(spark)
    found = spatial.within_distance(points, places, 2.0)
    from eventloom.functions.geo import haversine_miles

    miles = haversine_miles(F.col("plat"), F.col("plng"), F.col("lat"), F.col("lng"))
    wanted = points.crossJoin(places).filter(miles <= 2.0).select("id", "place_id", F.round(miles, 9).alias("miles"))
    found.groupBy("id").count().collect()
    rows = rows_of(spark, "Generate", before)
    assert rows and max(rows) < 20_000
    pairs = found.select("id", "place_id", F.round("miles", 9).alias("miles"))
    assert pairs.exceptAll(wanted).isEmpty() and wanted.exceptAll(pairs).isEmpty() and not wanted.isEmpty()


def test_upsert_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.write_upsert(spark, path, spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string"), ["k"]) == 1
    old = tables.read_version(spark, path)
    assert tables.write_upsert(spark, path, spark.createDataFrame([(1, "b"), (2, "c"), (None, "n")], "k int, v string"), ["k"]) == 2
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    wanted = sorted([(1, "b"), (2, "c"), (None, "n"), (None, "n")], key=repr)
    assert rows(tables.read_version(spark, path)) == wanted
    assert rows(old) == rows(tables.read_version(spark, path, 1)) == sorted([(1, "a"), (None, "n")], key=repr)  # a reader keeps the version that it opened
    tables.vacuum(spark, path, 1)
    assert rows(tables.read_version(spark, path)) == wanted and tables.current_version(spark, path) == 2


def test_a_writer_that_stops_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    rows = lambda: sorted(map(tuple, tables.read_version(spark, path).collect()))
    tables.write_upsert(spark, path, frame((1, "a")), ["k"])
    # Stopped after its files were written, before the commit.
    frame((1, "lost")).write.parquet(f"{path}/v2-unfinished")
    assert rows() == [(1, "a")] and tables.current_version(spark, path) == 1
    # Stopped within the write: a task fails after other tasks wrote.
    broken = spark.range(0, 100, 1, 10).selectExpr("CAST(id AS INT) AS k", "CASE WHEN id = 95 THEN raise_error('stopped') ELSE 'x' END AS v")
    with pytest.raises(Exception, match="stopped"):
        tables.write_upsert(spark, path, broken, ["k"])
    assert rows() == [(1, "a")]
    assert tables.write_upsert(spark, path, frame((2, "b")), ["k"]) == 2 and rows() == [(1, "a"), (2, "b")]
    tables.vacuum(spark, path)
    assert not tables.exists(spark, f"{path}/v2-unfinished") and rows() == [(1, "a"), (2, "b")]


def test_the_slower_of_two_writers_meets_the_faster_ones_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    tables.write_upsert(spark, path, frame((1, "a")), ["k"])
    tables.commit_version(path, frame((1, "a"), (2, "faster")), 1)
    with pytest.raises(tables.Conflict):
        tables.commit_version(path, frame((1, "slower")), 1)
    assert tables.write_upsert(spark, path, frame((3, "slower")), ["k"]) == 3
    assert sorted(map(tuple, tables.read_version(spark, path).collect())) == [(1, "a"), (2, "faster"), (3, "slower")]


def test_streak(spark):
    day = lambda n: dt.date(2024, 1, 15) - dt.timedelta(n)
    days = spark.createDataFrame([("a", day(0)), ("a", day(1)), ("b", day(0)), ("b", day(2)), ("b", day(6)), ("c", day(0)), ("c", day(1)), ("c", day(9))], "user_id string, day date")
    assert {r["user_id"]: r["prompt"] for r in telemetry.streaks(days, F.to_date(tw.at(NOW))).collect()} == {"a": False, "b": True, "c": False}


def test_denied_calls_do_not_count(spark):
    calls = [(i, "c", T0 + dt.timedelta(minutes=m)) for i, m in enumerate([0, 1, 2, 3, 59, 61, 62, 63])]
    df = spark.createDataFrame(calls, "id long, client_id string, called_at timestamp")
    assert [r["allowed"] for r in state.rate_limited(df, most=3).orderBy("id").collect()] == [True, True, True, False, False, True, True, True]


def test_crawl_state():
    now = dict(state._START)
    for passed, outcome in [(0, "error"), (0, "error"), (0, "ok"), (2, "ok"), (0, "unchanged"), (0, "unchanged")]:
        now = state.next_health(now, passed, 60.0 if passed else 15.0, outcome, "h")
        yield_ = now["next_hours"]
        assert yield_ > 0
    assert now["consecutive_empty"] == 2 and now["total_passed"] == 2 and now["next_hours"] == 24.0


def test_calls_without_a_client(spark):
    calls = [(i, None if i % 2 else "c", T0 + dt.timedelta(minutes=i)) for i in range(8)]
    found = {r["id"]: r["allowed"] for r in state.rate_limited(spark.createDataFrame(calls, "id long, client_id string, called_at timestamp"), most=3).collect()}
    assert found == {i: i < 6 for i in range(8)}


def streamed(spark, tmp_path, df, parts, operator, mode):
    """What a stream over the parts, one file each, gives; it ends when all are read."""
    for k, part in enumerate(parts):
        df.filter(part).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    name = f"{operator.__name__}_{len(parts)}"
    out = operator(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp"))
    run = out.trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(240)
    finally:
        run.stop()
    return spark.table(name).collect()


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    calls = [(i, f"c{i % 3}" if i % 7 else None, T0 + dt.timedelta(minutes=i)) for i in range(60)]
    df = spark.createDataFrame(calls, "id long, client_id string, called_at timestamp")

    def limited(rows):
        return state.rate_limit_stream(rows, most=3)

    found = {r["id"]: r["allowed"] for r in streamed(spark, tmp_path, df, ["id < 30", "id >= 30"], limited, "append")}
    assert found == {r["id"]: r["allowed"] for r in state.rate_limited(df, most=3).collect()}


@pytest.fixture
def rocksdb(spark):
    own = {"spark.sql.streaming.stateStore.providerClass": state.ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


SCANS = "venue_id long, seq long, passed long, found long, outcome string, page_hash string, source_url string"


def test_crawl_health_stream_equals_batch(spark, tmp_path, rocksdb):
    """Raw hashes in, a restart of the query after each part: the page read last is compared within the state."""
    outcomes = ["ok", "ok", "error", "no_signal", "ok"]
    scans = [(v, n, (v + n) % 3 if outcomes[(v * 2 + n) % 5] == "ok" else 0, 4, outcomes[(v * 2 + n) % 5], f"h{n // 2}" if n % 5 else None, "https://x.org/events") for v in range(3) for n in range(12)]
    df = spark.createDataFrame([*scans, (None, 1, 1, 1, "ok", "h", None), (9, 1, None, None, None, None, None)], SCANS)
    source, name = tmp_path / "in", "crawl_health"
    last: dict = {}
    for k in range(3):
        df.filter(F.col("seq").between(4 * k, 4 * k + 3)).coalesce(1).write.parquet(f"{source}/b={k}")
        own = spark.readStream.schema(df.schema).parquet(f"{source}/b=*")
        sink = str(tmp_path / "out")
        write = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{sink}/{batch}")
        run = state.crawl_health_stream(own).writeStream.queryName(name).foreachBatch(write).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert run.awaitTermination(240) and run.exception() is None
        for r in spark.read.parquet(f"{sink}/*").collect():
            last[r["venue_id"]] = max(last.get(r["venue_id"], r), r, key=lambda r: r["total_scans"])
    assert {tuple(r) for r in last.values()} == {tuple(r) for r in state.crawl_health(df).collect()}
    assert set(last) == {0, 1, 2, 9} and all(last[v]["total_scans"] == 12 for v in range(3))


def test_twelve_hours_once_after_an_unchanged_page(spark):
    """A page that passed, then stays the same: twelve hours once, then the back-off for empty scans."""
    hours = []
    now = dict(state._START)
    for outcome, page in [("ok", "a"), ("ok", "a"), ("ok", "a"), ("ok", "a"), ("error", None), ("ok", "a"), ("ok", "b")]:
        now = state.after_scan(now, 2, 70.0, outcome, page)
        hours.append(now["next_hours"])
    assert hours == [6.0, 12.0, 24.0, 48.0, 6.0, 96.0, 6.0]
    assert now["total_passed"] == 4 and now["consecutive_empty"] == 0


def test_crawl_health_needs_rocksdb(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        state.crawl_health_stream(spark.createDataFrame([], SCANS))


def test_refresh_machine(spark):
    log = [("START", True, False), ("COOLDOWN_RESULT", True, False), ("FOUND_EVENT", True, False), ("FOUND_EVENT", True, False), ("STREAM_DONE", True, False), ("RANK_RESULT", True, False)]
    rows = [("s", i, t, a, f, "x", "m") for i, (t, a, f) in enumerate(log)]
    rows += [("blocked", 0, "START", False, True, "x", "m"), ("blocked", 1, "COOLDOWN_RESULT", False, True, "x", "m")]
    df = spark.createDataFrame(rows, "session_id string, seq long, type string, user_allowed boolean, cell_fresh boolean, text string, message string")
    found = {r["session_id"]: r for r in state.refresh_states(df).collect()}
    assert (found["s"]["state"], found["s"]["n_found"]) == ("done", 2)
    assert found["blocked"]["state"] == "idle"


