"""The k nearest places of every point, by boxes of places that are opened only where a near one may lie inside."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions import geo
from eventloom.sources.tables import keep, passing

#: Boxes in a box, and the least number of places in one of the smallest.
FAN = 16
#: Most boxes that are sent to all tasks.
MOST_SENT = 1 << 19
#: The part of Spark's increasing ids that counts within a partition.
IN_RANGE = (1 << 33) - 1
#: By so much bounds are widened, since sines are rounded.
SLACK = 1e-9


def _haversine(lat: Column, d_lat: Column, cos_there: Column, d_lng: Column) -> Column:
    """The term under the root of the great-circle distance; it grows with both differences, up to 180 degrees, and the cosine."""
    return F.pow(F.sin(F.radians(d_lat) / 2), 2) + F.cos(F.radians(lat)) * cos_there * F.pow(F.sin(F.radians(d_lng) / 2), 2)


def _least_and_most(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Bounds of :func:`_haversine` from a point to all places of a box (south, north, west, east)."""
    south, north, west, east = map(F.col, ("south", "north", "west", "east"))
    to_west, to_east = F.abs(lng - west), F.abs(lng - east)
    around = lambda d: F.least(d, 360 - d)
    near_lng = F.when(lng.between(west, east), 0.0).otherwise(F.least(around(to_west), around(to_east)))
    # Half around the globe is as far as it gets; a box may hold the point's opposite meridian.
    far_lng = F.when(F.greatest(to_west, to_east) <= 180, F.greatest(to_west, to_east)).when(~lng.between(west, east) & (F.least(to_west, to_east) >= 180), 360 - F.least(to_west, to_east)).otherwise(180.0)
    near_lat, far_lat = F.greatest(F.lit(0.0), south - lat, lat - north), F.greatest(F.abs(lat - south), F.abs(lat - north))
    return _haversine(lat, near_lat, F.col("least_cos"), near_lng), _haversine(lat, far_lat, F.col("most_cos"), far_lng)


def _along_curve(places: DataFrame, size: float) -> DataFrame:
    """Add ``cell``: the place on a Z-order curve through cells of ``size`` degrees, the bits of both coordinates in turn."""
    bits = max(1, min(31, math.ceil(math.log2(360 / size))))
    steps = lambda degrees: F.least(F.floor(degrees / (360 / (1 << bits))), F.lit((1 << bits) - 1)).cast("long")
    places = places.withColumns({"__x": steps(F.col("plng") + 180), "__y": steps(F.col("plat") + 90)})
    for apart, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        places = places.withColumns({c: F.col(c).bitwiseOR(F.shiftleft(c, apart)).bitwiseAND(F.lit(mask)) for c in ("__x", "__y")})
    return places.withColumn("cell", F.col("__x").bitwiseOR(F.shiftleft("__y", 1))).drop("__x", "__y")


def _packed(places: DataFrame, size: float, most: int) -> DataFrame:
    """Write the places in ranges of the curve, and add ``leaf``: the number of the smallest box, a run of at most so many places of a range."""
    curve = ["cell", "plat", "plng"]
    placed = _along_curve(places, size).repartitionByRange(*curve).sortWithinPartitions(*curve, "place_id")
    placed = placed.select("place_id", "plat", "plng", F.monotonically_increasing_id().alias("n"))  # a range's number, then its places from 0
    return keep(placed.select("place_id", "plat", "plng", (F.col("n") - F.col("n").bitwiseAND(F.lit(IN_RANGE)) % most).alias("leaf")), "places")


def _leaves(packed: DataFrame, most: int) -> DataFrame:
    """Write the smallest boxes; ``node`` counts them along the curve without gaps."""
    boxes = packed.groupBy("leaf").agg(F.min("plat").alias("south"), F.max("plat").alias("north"), F.min("plng").alias("west"), F.max("plng").alias("east"), F.count(F.lit(1)).alias("n"))
    boxes = boxes.withColumn("range", F.col("leaf") - F.col("leaf").bitwiseAND(F.lit(IN_RANGE)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = boxes.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    node = F.col("start") + F.floor((F.col("leaf") - F.col("range")) / most)
    return keep(boxes.join(F.broadcast(starts), "range").select("leaf", node.cast("long").alias("node"), "south", "north", "west", "east", "n"), "boxes")


def _boxes(leaves: DataFrame, level: int) -> DataFrame:
    """The boxes so many levels above the smallest, with the number of the box around each."""
    node = F.floor(F.col("node") / FAN**level).cast("long")
    own = leaves
    if level:
        own = leaves.groupBy(node.alias("node")).agg(*[f(c).alias(c) for f, c in ((F.min, "leaf"), (F.min, "south"), (F.max, "north"), (F.min, "west"), (F.max, "east"), (F.sum, "n"))])
    cosines = [F.cos(F.radians(c)) for c in ("south", "north")]
    most = F.when((F.col("south") <= 0) & (F.col("north") >= 0), 1.0).otherwise(F.greatest(*cosines))
    return own.withColumns({"around": F.floor(F.col("node") / FAN).cast("long"), "least_cos": F.least(*cosines), "most_cos": most})


def nearest(points: DataFrame, places: DataFrame, k: int, most_miles: float = float("inf"), first_cell: float = 0.0005) -> DataFrame:
    """(id, place_id, miles, rank): the ``k`` places nearest to each point, at most ``most_miles`` away.

    ``points`` (id, lat, lng) and ``places`` (place_id, plat, plng); equal distances go to
    the smaller place_id. Places are packed along a curve through cells of ``first_cell``
    degrees (which decides on speed alone): runs of them are a box, runs of boxes a larger
    one. From the largest boxes down, a point opens those that begin no farther than the
    nearest box of ``k`` places or more ends, so it meets about as many boxes and places
    wherever it lies and however dense they are. Of places at one spot the first ``k`` take part, and
    points at one spot are one. Points or places without valid coordinates have no
    part; with fewer than ``k`` places in reach a point gets those.
    """
    spark = points.sparkSession
    valid = lambda lat, lng: F.coalesce(F.col(lat).between(-90, 90) & F.col(lng).between(-180, 180), F.lit(False))
    with passing(spark):
        own = keep(points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng")).filter(valid("lat", "lng")), "points")
        spots = keep(own.select("lat", "lng").distinct().withColumn("spot", F.monotonically_increasing_id()), "spots")
        at_spot = F.row_number().over(Window.partitionBy("plat", "plng").orderBy("place_id"))
        there = places.select("place_id", F.col("plat").cast("double").alias("plat"), F.col("plng").cast("double").alias("plng")).filter(valid("plat", "plng"))
        there = there.withColumn("nth", at_spot).filter(F.col("nth") <= k).drop("nth")
        packed = _packed(there, first_cell, max(FAN, k))
        leaves = _leaves(packed, max(FAN, k))
        n_leaves, n_spots = leaves.count(), spots.count()
        levels = next(n for n in range(64) if FAN ** (n + 1) >= n_leaves)
        # Few rows become many, so their bytes do not tell how many tasks they need.
        tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n_spots // 1000)
        lat, lng = F.col("lat"), F.col("lng")
        whole = math.sin(min(most_miles / (2 * geo.RADIUS_MILES), math.pi / 2)) ** 2
        open_boxes = spots.repartition(tasks, "spot").select("spot", lat, lng, F.lit(whole * (1 + SLACK)).alias("most"), F.lit(0).cast("long").alias("around"))
        for level in reversed(range(levels + 1)):
            least, most = _least_and_most(lat, lng)
            boxes = _boxes(leaves, level)
            # Boxes that are sent to all tasks leave a spot's rows where they are, in their order.
            boxes = F.broadcast(boxes) if n_leaves <= MOST_SENT * FAN**level else boxes
            met = open_boxes.join(boxes, "around").select("spot", lat, lng, "most", "node", "leaf", "n", least.alias("least"), most.alias("farthest")).filter(F.col("least") <= F.col("most"))
            ended = F.min(F.when(F.col("n") >= k, F.col("farthest") * (1 + SLACK) + 1e-18)).over(Window.partitionBy("spot"))
            met = met.withColumn("most", F.least("most", ended)).filter(F.col("least") <= F.col("most"))
            open_boxes = met.select("spot", lat, lng, "most", F.col("node").alias("around"), "leaf").drop(*(["leaf"] if level else ["around"]))
        # What lies beyond the nearest box of k places is left out before it is sorted.
        term = _haversine(lat, F.col("plat") - lat, F.cos(F.radians("plat")), F.col("plng") - lng)
        met = open_boxes.join(packed, "leaf").filter(term <= F.col("most")).withColumn("miles", geo.haversine_miles(lat, lng, F.col("plat"), F.col("plng"))).filter(F.col("miles") <= most_miles)
        # Spark cuts each task's rows to the first k of a spot before it shuffles them.
        nth = F.row_number().over(Window.partitionBy("spot").orderBy("miles", "place_id"))
        best = met.select("spot", "place_id", "miles", nth.alias("rank")).filter(F.col("rank") <= k)
        found = own.join(spots, ["lat", "lng"]).join(best, "spot")
        return keep(found.select("id", "place_id", "miles", "rank"), "nearest-places", lasting=True)
