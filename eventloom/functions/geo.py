"""Distances, geohash cells and grid keys on plain latitude and longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The earth's radius in miles, metres per mile, the geohash alphabet and the WGS 84 ellipsoid.
RADIUS_MILES = 3958.8
METRES_PER_MILE = 1609.34
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def haversine_miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * RADIUS_MILES) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def spheroid_miles(df: DataFrame, lat1: Column, lng1: Column, lat2: Column, lng2: Column, name: str, rounds: int = 8) -> DataFrame:
    """Add the geodesic distance on WGS 84 (Vincenty's inverse formula, a fixed number of rounds).

    The rounds are one fold over a struct, so the plan does not grow with their number.
    """
    f, b = FLATTENING, SEMI_MAJOR * (1 - FLATTENING)
    u1, u2, d = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2))), F.radians(lng2 - lng1)
    ends = {"sin1": F.sin(u1), "cos1": F.cos(u1), "sin2": F.sin(u2), "cos2": F.cos(u2), "d": d}
    e = lambda n: F.col("__ends")[n]

    def let(value: Column, body) -> Column:
        """A value used several times, computed once."""
        return F.transform(F.array(value), body)[0]

    def angle(l: Column, then) -> Column:  # noqa: E741
        """``then`` of the arc between the points, if they lie ``l`` apart on the auxiliary sphere."""
        sin_s = F.sqrt(F.pow(e("cos2") * F.sin(l), 2) + F.pow(e("cos1") * e("sin2") - e("sin1") * e("cos2") * F.cos(l), 2))
        cos_s = e("sin1") * e("sin2") + e("cos1") * e("cos2") * F.cos(l)
        first = F.struct(l.alias("l"), sin_s.alias("ss"), cos_s.alias("cs"))

        def second(x: Column) -> Column:
            a = F.when(x["ss"] == 0, 0.0).otherwise(e("cos1") * e("cos2") * F.sin(x["l"]) / x["ss"])
            return let(a, lambda a: third(x, a))

        def third(x: Column, a: Column) -> Column:
            c2 = 1 - a * a
            m = F.when(c2 == 0, 0.0).otherwise(x["cs"] - 2 * e("sin1") * e("sin2") / c2)
            return let(F.struct(x["ss"].alias("ss"), x["cs"].alias("cs"), F.atan2(x["ss"], x["cs"]).alias("s"), a.alias("a"), c2.alias("c2"), m.alias("m")), then)

        return let(first, second)

    def next_l(x: Column) -> Column:
        k = f / 16 * x["c2"] * (4 + f * (4 - 3 * x["c2"]))
        return e("d") + (1 - k) * f * x["a"] * (x["s"] + k * x["ss"] * (x["m"] + k * x["cs"] * (2 * x["m"] * x["m"] - 1)))

    def metres(x: Column) -> Column:
        u = x["c2"] * ((SEMI_MAJOR**2 - b**2) / b**2)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m2 = 2 * x["m"] * x["m"] - 1
        delta = big_b * x["ss"] * (x["m"] + big_b / 4 * (x["cs"] * m2 - big_b / 6 * x["m"] * (4 * x["ss"] * x["ss"] - 3) * (4 * x["m"] * x["m"] - 3)))
        return b * big_a * (x["s"] - delta)

    # The last round's arc comes from the value before it.
    own = df.withColumn("__ends", F.struct(*[v.alias(k) for k, v in ends.items()]))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(rounds - 1)), e("d"), lambda l, _: angle(l, next_l))  # noqa: E741
    return own.withColumn("__last", last).withColumn(name, angle(F.col("__last"), metres) / METRES_PER_MILE).drop("__ends", "__last")


def _bits(value: Column, low: float, high: float, n: int) -> Column:
    """The first n bisection bits of a value within [low, high] as a number; the upper half includes its bound."""
    cells = 1 << n
    return F.least(F.greatest(F.floor((value - low) / F.lit((high - low) / cells)), F.lit(0)), F.lit(cells - 1)).cast("long")


def geohash(lat: Column, lng: Column, precision: int = 5) -> Column:
    """Geohash of a point; null outside the valid ranges."""
    total = 5 * precision
    n_lng, n_lat = (total + 1) // 2, total // 2
    of_lat, of_lng = _bits(lat, -90.0, 90.0, n_lat), _bits(lng, -180.0, 180.0, n_lng)
    letters = []
    for letter in range(precision):
        code = F.lit(0).cast("long")
        for bit in range(5):
            k = 5 * letter + bit
            from_lng, nth = k % 2 == 0, k // 2
            source, n = (of_lng, n_lng) if from_lng else (of_lat, n_lat)
            code = code * 2 + F.shiftright(source, n - 1 - nth).bitwiseAND(F.lit(1).cast("long"))
        letters.append(F.substring(F.lit(BASE32), code.cast("int") + 1, F.lit(1)))
    return F.when(lat.between(-90, 90) & lng.between(-180, 180), F.concat(*letters))


def half_up(x: Column, scale: float) -> Column:
    return F.floor(x * scale + F.lit(0.5)) / F.lit(float(scale))


def grid_key(lat: Column, lng: Column) -> Column:
    """Both coordinates to one decimal, halves upward, whole numbers without a decimal."""
    shown = lambda x: F.regexp_replace(half_up(x, 10).cast("string"), r"^-?0\.0$|\.0$", "")
    text = lambda x: F.when(half_up(x, 10) == 0, "0").otherwise(shown(x))
    return F.concat(text(lat), F.lit(","), text(lng))


def rough_box(lat: Column, lng: Column, origin: tuple[float, float], miles: float) -> Column:
    """Within miles/69 degrees on both axes, whatever the latitude."""
    return (F.abs(lat - origin[0]) < miles / 69) & (F.abs(lng - origin[1]) < miles / 69)


def covering_box(lat: Column, lng: Column, origin: tuple[float, float], miles: float) -> Column:
    """A box that surely holds the circle: plain comparisons that reach the Parquet scan."""
    d_lat = math.degrees(miles / RADIUS_MILES) * 1.01
    d_lng = d_lat / max(0.01, math.cos(math.radians(min(89.0, abs(origin[0]) + d_lat))))
    return lat.between(origin[0] - d_lat, origin[0] + d_lat) & lng.between(origin[1] - d_lng, origin[1] + d_lng)


def within(lat: Column, lng: Column, origin: tuple[float, float], miles: float) -> Column:
    """Radius filter: the covering box first, then the distance."""
    return covering_box(lat, lng, origin, miles) & (haversine_miles(F.lit(origin[0]), F.lit(origin[1]), lat, lng) <= miles)


def is_abusive(lat: Column, lng: Column, miles: Column) -> Column:
    """Coordinates or radius that no honest request has."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return ~(finite(lat) & finite(lng) & finite(miles) & lat.between(-90, 90) & lng.between(-180, 180) & miles.between(0, 100))
