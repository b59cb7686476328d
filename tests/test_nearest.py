"""Nearest places against all pairs."""

import random
from collections import defaultdict
from math import asin, cos, radians, sin

import pytest

from eventloom.functions.geo import RADIUS_MILES
from eventloom.operators import nearest
from tests.conftest import SF, executions, rows_of


def miles(a, b):
    h = sin(radians(b[0] - a[0]) / 2) ** 2 + cos(radians(a[0])) * cos(radians(b[0])) * sin(radians(b[1] - a[1]) / 2) ** 2
    return 2 * RADIUS_MILES * asin(min(1, h**0.5))


@pytest.mark.parametrize(("k", "most", "cell"), [(8, float("inf"), 0.25), (1, float("inf"), 5.0), (3, 500.0, 1.0)])
def test_against_all_pairs(spark, k, most, cell):
    rng = random.Random(4)
    spots = [(26.3 + rng.random(), -80.1 + rng.random()) for _ in range(60)]  # a town
    spots += [(rng.uniform(-3, 3), rng.choice([-1, 1]) * rng.uniform(178, 180)) for _ in range(25)]  # both sides of the date line
    spots += [(rng.choice([-1, 1]) * rng.uniform(84, 90), rng.uniform(-180, 180)) for _ in range(25)]  # poles
    spots += [(90.0, 0.0), (-90.0, 12.0), (0.0, 180.0), (0.0, -180.0), (55.0, 37.0)]
    points = [(i, *s) for i, s in enumerate(rng.sample(spots, 40) + [(40.0, 100.0), (89.9, 179.9), (0.0, 180.0)])]
    places = [(i, *s) for i, s in enumerate(spots)]
    df = spark.createDataFrame([*points, (900, None, 1.0), (901, 95.0, 0.0), (902, float("nan"), 0.0)], "id long, lat double, lng double")
    there = spark.createDataFrame([*places, (800, None, None), (801, 0.0, 400.0)], "place_id long, plat double, plng double")
    found = defaultdict(list)
    for r in nearest.nearest(df, there, k, most, cell).orderBy("id", "rank").collect():
        found[r["id"]].append((r["rank"], r["place_id"], r["miles"]))
    for i, *at in points:
        wanted = sorted((round(miles(at, s), 6), p) for p, *s in places if miles(at, s) <= most)[:k]
        assert [round(d, 6) for _, _, d in found[i]] == [d for d, _ in wanted]
        assert [n for n, _, _ in found[i]] == list(range(1, len(wanted) + 1))
    assert set(found) <= {i for i, *_ in points}


def test_fewer_places_than_asked_for(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 60.0, 179.0)], "id long, lat double, lng double")
    places = spark.createDataFrame([(7, 0.0, -179.0), (5, 0.0, -179.0)], "place_id long, plat double, plng double")
    assert [(r["id"], r["place_id"], r["rank"]) for r in nearest.nearest(points, places, 8).orderBy("id", "rank").collect()] == [(1, 5, 1), (1, 7, 2), (2, 5, 1), (2, 7, 2)]
    assert nearest.nearest(points, places.limit(0), 8).collect() == [] == nearest.nearest(points.limit(0), places, 8).collect()


def test_schools_take_part_only_with_a_website(spark):
    from eventloom.plans import nearby_queries

    rows = nearby_queries.QUERIES["source_nearest_schools"](spark, SF).collect()
    assert rows and max(r["rank"] for r in rows) == 8


def test_a_point_meets_few_places_in_and_outside_a_dense_town(spark):
    """Cells of one size met all places of the town from everywhere near it."""
    from pyspark.sql import functions as F

    i = F.col("id")
    places = spark.range(20_000).select(i.alias("place_id"), (26.0 + i * 7919 % 20011 / F.lit(1e5)).alias("plat"), (-80.0 + i * 104729 % 20021 / F.lit(1e5)).alias("plng"))
    places = places.union(spark.range(20_000, 22_000).select(i, F.lit(26.05), F.lit(-80.1)))  # copies of one spot
    points = spark.range(300).select("id", (25.6 + i * 37 % 300 / F.lit(300.0)).alias("lat"), (-80.4 + i * 53 % 300 / F.lit(300.0)).alias("lng"))
    before = executions(spark)
    found = nearest.nearest(points, places, 8, 40.0)
    assert found.count() == 300 * 8
    rows = rows_of(spark, "Join", before)
    assert rows and max(rows) < 300 * 400
    at = {r["place_id"]: (r["plat"], r["plng"]) for r in places.collect()}
    for p in points.filter("id % 60 = 7").collect():
        wanted = sorted((round(miles((p["lat"], p["lng"]), s), 6), q) for q, s in at.items())[:8]
        assert [round(r["miles"], 6) for r in found.filter(F.col("id") == p["id"]).orderBy("rank").collect()] == [d for d, _ in wanted]


def shuffled(spark, after: int) -> int:
    """Rows written to shuffles in executions later than so many."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found = 0
    for n in range(after, store.executionsCount()):
        execution = store.executionsList().apply(n).executionId()
        values, nodes = store.executionMetrics(execution), store.planGraph(execution).allNodes()
        for metrics in (nodes.apply(i).metrics() for i in range(nodes.size())):
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "shuffle records written" and values.contains(m.accumulatorId()):
                    found += int(values.apply(m.accumulatorId()).replace(",", ""))
    return found


def test_boxes_go_to_the_points(spark):
    """Where Spark sends no table by itself, each level shuffled all boxes that a point meets, and all places near it were sorted."""
    from pyspark.sql import functions as F

    i = F.col("id")
    places = spark.range(20_000).select(i.alias("place_id"), (26.0 + i * 7919 % 20011 / F.lit(1e5)).alias("plat"), (-80.0 + i * 104729 % 20021 / F.lit(1e5)).alias("plng"))
    points = spark.range(1_000).select("id", (26.0 + i * 37 % 1009 / F.lit(5e3)).alias("lat"), (-80.0 + i * 53 % 1013 / F.lit(5e3)).alias("lng"))
    before, most = executions(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert nearest.nearest(points, places, 8, 40.0).count() == 1_000 * 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    rows = shuffled(spark, before)
    assert 0 < rows < 120_000


def test_games_read_the_schools_once_and_name_a_game_once(spark, tmp_path):
    import duckdb

    from eventloom.plans import nearby_queries
    from tests.conftest import same_rows

    own = duckdb.connect()
    for name, times in (("customer", 2), ("supplier", 1)):
        own.execute(f"COPY (SELECT t.* FROM '{SF}/{name}.parquet' t, range({times})) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    games = nearby_queries.QUERIES["source_school_games"](spark, str(tmp_path))
    same_rows(games, own, nearby_queries.ORACLE_SQL["source_school_games"])
    assert games._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet [c_custkey") == 1
