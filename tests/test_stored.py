"""Stored cells: files left unread, rows equal to the search over the whole feed."""

import random
import re

import pytest
from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.functions import timewin as tw
from eventloom.operators import feed, stored
from eventloom.plans.views import NOW, ORIGIN, feed_events, venues
from tests.conftest import SF


def test_discover_from_cells(spark, tmp_path):
    path = str(tmp_path / "cells")
    whole = feed_events(spark, SF).withColumn("lng", F.when(F.col("id") % 3 == 0, F.col("lng") - 60).otherwise(F.col("lng"))).withColumn("lat", F.when(F.col("id") % 50 != 1, F.col("lat")))
    stored.write_cells(whole, path)
    near = stored.read_near(spark, path, ORIGIN, 10.0)
    found = feed.discover(near, venues(spark, SF), ORIGIN, 10.0, tw.at(NOW)).select("id", "distance").collect()
    assert found == feed.discover(whole, venues(spark, SF), ORIGIN, 10.0, tw.at(NOW)).select("id", "distance").collect() and found
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*cell#\d+ IN \(", plan)
    assert 0 < len(near.inputFiles()) <= len(spark.read.parquet(path).inputFiles())
    listed = near.selectExpr("input_file_name() AS f").distinct().count()
    assert listed < len(spark.read.parquet(path).inputFiles())
    assert sorted(r[0] for r in spark.read.parquet(path).select("id").collect()) == sorted(r[0] for r in whole.select("id").collect())


@pytest.mark.parametrize("precision", [1, 3, 5])
def test_cells_hold_the_circle(spark, precision):
    rng = random.Random(precision)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(400)]
    origins = [(26.3, -80.1, 30.0), (0.0, 179.9, 200.0), (0.0, -179.99, 900.0), (89.5, 10.0, 100.0), (-89.9, 0.0, 50.0), (70.0, 20.0, 2000.0), (10.0, 10.0, 13_000.0)]
    for lat, lng, miles in origins:
        points += [(max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * miles / 69)), (lng + rng.uniform(-1, 1) * miles / 30 + 540) % 360 - 180) for _ in range(150)]
    df = spark.createDataFrame(points, "lat double, lng double").withColumn("cell", geo.geohash(F.col("lat"), F.col("lng"), precision)).persist()
    for lat, lng, miles in origins:
        cells = stored.covering_cells((lat, lng), miles, precision)
        inside = df.filter(geo.haversine_miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= miles)
        assert len(set(cells)) == len(cells) <= stored.MOST_CELLS
        assert inside.filter(~F.substring("cell", 1, len(cells[0])).isin(cells)).count() == 0
    near = stored.covering_cells((26.3, -80.1), 5.0, 5)
    assert "dhwyf"[:2] in {c[:2] for c in near} and len(near) < 30
